"""Fill-down over many ranges of a sheet."""

from __future__ import annotations

from tessera.operators import dictionary


def test_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cells = [(i, f"AMENITIES_PRIORITY_{i % 5}" if i in (7, 30, 31, 700) else f"word{i}") for i in range(1000)]
        out = dictionary.fill_down(spark.createDataFrame(cells, "row_no long, cell string").repartition(4))
        got = sorted((r["row_no"], r["tier"]) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tier, want = None, []
    for i, c in cells:
        if c.startswith("AMENITIES"):
            tier = i % 5
        elif tier is not None:
            want.append((i, tier))
    assert got == want
    assert "windowspecdefinition(_range" in out._jdf.queryExecution().toString()
