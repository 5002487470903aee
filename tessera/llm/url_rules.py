"""URL filters: list rules, and association rules that FP-growth mines from URLs whose verdict is known."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import cut

# The list's rules as action and host with path.
LIST = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

_BLOCK, _ALLOW = "=block", "=allow"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands after the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def list_rules(spark: SparkSession, rules: tuple[tuple[str, str], ...] = LIST) -> DataFrame:
    """rule, action, rule_host, rule_path; the host is what stands before the rule's first slash."""
    df = spark.createDataFrame([(r, a) for a, r in rules], "rule string, action string").dropDuplicates(["rule"])
    return df.select("rule", "action", F.substring_index("rule", "/", 1).alias("rule_host"), F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("rule_path"))


def listed(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, action for those of places (host, path; distinct) that a rule fits; the longest rule wins.

    A rule fits its host and all subdomains where the path starts with the rule's. Each host meets the rules by its own
    name and those of its parents that have no more labels than the longest rule, an inverted index, so the number of
    rules doesn't matter. Of two equally long rules the smaller text wins.
    """
    labels = F.split("host", "\\.")
    longest = rules.agg(F.max(F.size(F.split("rule_host", "\\."))).alias("n")).first()["n"] or 1
    first = F.greatest(F.lit(1), F.size(labels) - longest + 1)
    parents = F.transform(F.sequence(first, F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = places.where("host <> ''").withColumn("rule_host", F.explode(F.array_distinct(parents))).join(rules, "rule_host")
    fits = met.where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), F.struct(-F.length("rule"), F.col("rule"))).alias("r"))
    return best.select("host", "path", "r.rule", "r.action")


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: domain labels, label parts between hyphens, and path segments with digits folded."""
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    parts = F.flatten(F.transform(labels, lambda x: F.when(x.contains("-"), F.split(x, "-")).otherwise(F.array().cast("array<string>"))))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(segments, lambda x: F.concat(F.lit("/"), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("."), x)), F.transform(parts, lambda x: F.concat(F.lit("-"), x)), segments))


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.9, most_tokens: int = 4) -> DataFrame:
    """rule_id, groups, verdict, confidence, support of rules from labelled (host, path, action), distinct URLs; actions
    are block, allow or none, which no rule predicts.

    FP-growth finds token combinations with a verdict. Kept are combinations of two or more tokens, up to most_tokens,
    whose verdict holds for min_confidence of the URLs that have them all; a longer rule that is no surer than a
    shorter one within it goes. Tokens too rare for any rule are left out before mining, which changes no rule.

    Tokens that stand in the very same URLs, like the segments of a long shared path, are one group, and groups are mined:
    any choice of a token from each of several groups has the support and confidence of the groups, and more tokens of
    one group make a rule longer and no surer. So groups ARRAY<ARRAY<STRING>> stands for a rule for each choice of a
    token from each group; a single group for a rule for each two of its tokens. The work grows with the combinations of
    groups, not of tokens.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, groups array<array<string>>, verdict string, confidence double, support double")
    rows = labelled.select(tokens(F.col("host"), F.col("path")).alias("t"), F.concat(F.lit("="), F.col("action")).alias("a"))
    rows = cut(rows.withColumn("id", F.monotonically_increasing_id()), "labelled-urls")
    n = rows.count()
    if n == 0:
        return empty
    entries = rows.select("id", "a", F.explode("t").alias("token"))
    # the same URLs: equal counts, and equal sums of two hashes of their ids
    where = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    common = entries.groupBy("token").agg(F.count("*").alias("c"), *where).where(F.col("c") >= min_support * n)
    groups = common.groupBy("c", "h1", "h2").agg(F.min("token").alias("group"), F.sort_array(F.collect_list("token")).alias("members"))  # no more than one URL has
    groups = cut(groups.select("group", "members"), "token-groups")
    used = entries.join(groups, entries["token"] == groups["group"]).select("id", "a", "group")  # a group stands where its first token does
    baskets = used.groupBy("id").agg(F.concat(F.collect_list("group"), F.array(F.first("a"))).alias("items"))
    grown = FPGrowth(minSupport=min_support, minConfidence=min_confidence).fit(baskets.unionByName(rows.join(used.select("id").distinct(), "id", "left_anti").select("id", F.array("a").alias("items"))))
    rules = grown.associationRules.where(F.array_contains("consequent", _BLOCK) | F.array_contains("consequent", _ALLOW))
    plain = ~F.arrays_overlap("antecedent", F.array(*map(F.lit, (_BLOCK, _ALLOW, "=none"))))
    rules = rules.where(plain & F.size("antecedent").between(1, most_tokens))
    rules = rules.select(F.sort_array("antecedent").alias("items"), F.substring(F.element_at("consequent", 1), 2, 9).alias("verdict"), "confidence", "support")
    rules = cut(rules, "rules")
    short = rules.where("size(items) > 1").select(F.col("items").alias("sub"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    # a rule meets the shorter rules within it by its own subsets, not by all pairs of rules
    own = rules.withColumn("sub", F.explode(_subsets(most_tokens))).where(F.size("sub") < F.size("items"))
    weaker = own.join(short, (own["sub"] == short["sub"]) & (own["verdict"] == short["v"]) & (short["c"] >= own["confidence"])).select("items", "verdict").distinct()
    kept = rules.join(weaker, ["items", "verdict"], "left_anti").withColumn("rule_id", F.xxhash64("items", "verdict"))
    kept = kept.select("rule_id", "verdict", "confidence", "support", F.explode("items").alias("group")).join(groups, "group")
    kept = kept.groupBy("rule_id", "verdict", "confidence", "support").agg(F.sort_array(F.collect_list("members")).alias("groups"))  # most_tokens at most
    return kept.where((F.size("groups") > 1) | (F.size(F.get("groups", F.lit(0))) > 1)).select("rule_id", "groups", "verdict", "confidence", "support")


def _subsets(most: int) -> Column:
    """Subsets of two or more of the items, each in the items' order."""
    grown = F.aggregate("items", F.array(F.array().cast("array<string>")), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    return F.filter(grown, lambda s: F.size(s) >= 2)


def fired(places: DataFrame, rules: DataFrame, least_token_count: int = 2) -> DataFrame:
    """host, path, verdict of the surest mined rule that fits each of places, if any.

    An inverted index on a rule's rarest group of tokens, by its URLs, picks candidates; its other groups decide.
    """
    known = places.withColumn("t", tokens(F.col("host"), F.col("path"))).where(F.size("t") >= least_token_count)
    entries = known.select("host", "path", F.explode("t").alias("token"))
    kept = cut(rules, "mined-rules")
    posts = kept.select("rule_id", F.explode("groups").alias("group")).select("rule_id", "group", F.explode("group").alias("token"))
    freq = entries.join(posts.select("token").distinct(), "token").groupBy("token").count()
    lead = posts.join(freq, "token", "left").groupBy("rule_id", "group").agg(F.sum(F.coalesce("count", F.lit(0))).alias("n"))
    lead = lead.groupBy("rule_id").agg(F.min(F.struct("n", "group"))["group"].alias("group")).join(kept, "rule_id").withColumn("token", F.explode("group")).drop("group")
    several = F.when(F.size("groups") > 1, F.forall("groups", lambda g: F.arrays_overlap(g, F.col("t")))).otherwise(F.size(F.array_intersect(F.get("groups", F.lit(0)), F.col("t"))) > 1)
    met = known.select("host", "path", "t", F.explode("t").alias("token")).join(lead, "token").where(several)
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.greatest(F.size("groups"), F.lit(2)), F.col("verdict"), F.col("rule_id"))
    return met.groupBy("host", "path").agg(F.min_by("verdict", order).alias("mined"))


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = LIST, labels: DataFrame | None = None, url: str = "url", min_support: float = 0.005, min_confidence: float = 0.9) -> DataFrame:
    """pages with host, path, rule (of the list, or null) and verdict, allow or block.

    The list's rule decides where one fits. Elsewhere the mined rules do, the surest first, and where none of them fits
    the verdict is allow. They are mined from labels (url, action) if given, else from the URLs that the list decides:
    what its blocked URLs have in common, and its allowed ones have not, blocks others too. Work is done once for each
    distinct host and path, however many pages share it. A null url has an empty host and path, which no rule fits, and
    an empty table or label set leaves the list alone to decide. Columns named host, path, rule or verdict are replaced
    by the results, all others are kept.
    """
    spark = pages.sparkSession
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(F.struct(*(f"`{c}`" for c in rest)).alias("_row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    places = cut(split.select("host", "path").distinct(), "places")
    by_list = cut(listed(places, list_rules(spark, rules)), "listed")
    if labels is None:
        known = by_list.select("host", "path", "action")
    else:
        known = labels.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "action").distinct()
    mined = mine(known, min_support, min_confidence)
    others = places.join(by_list, ["host", "path"], "left_anti")
    verdicts = by_list.select("host", "path", "rule", F.col("action").alias("verdict")).unionByName(fired(others, mined).select("host", "path", F.lit(None).cast("string").alias("rule"), F.col("mined").alias("verdict")))
    out = split.join(cut(verdicts, "verdicts"), ["host", "path"], "left")
    return out.select("_row.*", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
