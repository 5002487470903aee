"""A table kept current by a stream: chunks are merged into versioned files, and a ledger says which chunks are in."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import upsert

#: Parts of a table by the hash of its key; a chunk writes only those that it touches.
PARTS = 16


class Snapshots:
    """A table under `root`, in any file system that Spark writes to.

    root/data/chunk=N/part=P holds part P as it was after chunk N; root/ledger/N.json, which comes by a rename once all of
    them are written, says which chunk each part is to be read from, and the counts so far. A chunk that failed half-way
    left no ledger entry, so its files are unseen and written over when it comes again; one that is in the ledger is
    passed over. So each chunk counts once, whenever and however often a stream hands it out.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: str, parts: int = PARTS) -> None:
        """keys: what tells rows apart, null-safe; order: the column by which the last change of a key in a chunk wins."""
        self.spark, self.root, self.keys, self.order, self.parts = spark, root.rstrip("/"), keys, order, parts
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._files = jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entries(self) -> dict[int, str]:
        folder = self._path(f"{self.root}/ledger")
        if not self._files.exists(folder):
            return {}
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return {int(n.removesuffix(".json")): n for n in names if n.endswith(".json")}

    def entry(self) -> dict | None:
        """The last entry of the ledger: chunk, parts (part to chunk), schema, and inserted and updated of all chunks."""
        entries = self._entries()
        if not entries:
            return None
        # by Spark's reader, as the driver may not see the files
        rows = self.spark.read.text(f"{self.root}/ledger/{entries[max(entries)]}", wholetext=True).collect()
        return json.loads(rows[0]["value"])

    def _read(self, entry: dict, parts: set[int] | None = None) -> DataFrame:
        """The table as an entry has it, or some of its parts."""
        schema = entry["schema"]
        paths = [f"{self.root}/data/chunk={c}/part={p}" for p, c in entry["parts"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self) -> DataFrame | None:
        """The table after the last chunk, None before the first."""
        entry = self.entry()
        return self._read(entry) if entry else None

    def merge(self, changes: DataFrame, chunk: int, before_commit: Callable[[], None] = lambda: None) -> None:
        """Merges a chunk of changes (the table's columns and the order column) once; made for foreachBatch."""
        last = self.entry()
        if last and chunk <= last["chunk"]:
            return
        columns = [c for c in changes.columns if c != self.order]
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")
        changes = changes.withColumn("_part", part)
        touched = {r["_part"] for r in changes.select("_part").distinct().collect()}  # self.parts at most
        bare = changes.select(*columns)
        before = self._read(last, touched) if last else self.spark.createDataFrame([], bare.schema)
        after = upsert.merged(before, changes.drop("_part"), self.keys, self.order)
        target = f"{self.root}/data/chunk={chunk}"
        after.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(target)
        written = self.spark.read.parquet(target) if touched else None
        counts = {"inserted": 0, "updated": 0}
        if written is not None:
            row = written.agg(F.count_if(F.col("action") == "inserted").alias("i"), F.sum(F.when(F.col("action") == "updated", F.col("n_changes")).when(F.col("action") == "inserted", F.col("n_changes") - 1).otherwise(0)).alias("u")).first()
            counts = {"inserted": row["i"], "updated": row["u"] or 0}
        total = {n: counts[n] + (last[n] if last else 0) for n in counts}
        before_commit()
        entry = {"chunk": chunk, "parts": (last["parts"] if last else {}) | {str(p): chunk for p in sorted(touched)}, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bare.schema.fields), "chunk_counts": counts, **total}
        draft = self._path(f"{self.root}/drafts/{chunk}.json")
        stream = self._files.create(draft, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        self._files.mkdirs(self._path(f"{self.root}/ledger"))
        if not self._files.rename(draft, self._path(f"{self.root}/ledger/{chunk}.json")):
            raise OSError(f"chunk {chunk} could not be entered in the ledger")

    def counters(self) -> DataFrame:
        """chunk, inserted, updated, and both of all chunks so far, from the ledger."""
        kinds = "chunk long, chunk_counts struct<inserted: long, updated: long>, inserted long, updated long"
        if not self._entries():
            return self.spark.createDataFrame([], "chunk long, inserted long, updated long, all_inserted long, all_updated long")
        rows = self.spark.read.schema(kinds).json(f"{self.root}/ledger")
        return rows.select("chunk", "chunk_counts.inserted", "chunk_counts.updated", F.col("inserted").alias("all_inserted"), F.col("updated").alias("all_updated"))

    def clean(self) -> int:
        """Deletes files that no part is read from any more, and says how many folders they were."""
        entry = self.entry()
        if not entry:
            return 0
        used = {(int(c), int(p)) for p, c in entry["parts"].items()}
        gone = 0
        for chunk in self._files.listStatus(self._path(f"{self.root}/data")):
            n = int(chunk.getPath().getName().removeprefix("chunk="))
            for part in self._files.listStatus(chunk.getPath()):
                name = part.getPath().getName()
                if n <= entry["chunk"] and name.startswith("part=") and (n, int(name.removeprefix("part="))) not in used:
                    gone += bool(self._files.delete(part.getPath(), True))
        return gone


def keep_current(changes: DataFrame, snapshots: Snapshots, checkpoint: str):
    """A query that merges what a stream of changes has for now, chunk by chunk, and ends."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(snapshots.merge).trigger(availableNow=True).start()
