"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, factorisation, language, licenses, line_dedup, minhash, mixing, quality_rules, runs, simhash, token_store, url_rules, variants
from tessera.llm.samples import fold, labelled_texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: A file of the tokenizers library, by its name in the public_tokenizers package that every executor has.
TOKENIZER = "byte_bpe_50k.json"


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Labelled documents that a line model learns from, at most about so many.
LINE_SAMPLE = 800


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs, line_model(docs, _table(spark, sf_dir, "labels")))


def line_model(docs: DataFrame, labels: DataFrame) -> quality_rules.LineModel | None:
    rows = sorted(labelled_texts(docs, labels, LINE_SAMPLE))
    return quality_rules.train([r["text"].encode() for r in rows], [r["label"] for r in rows])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", "n_passages", "cut_bytes", F.sha2("text", 256).alias("text_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, fold(F.col("doc_id")) != 0)
    return language.predicted(docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text"), model)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(_table(spark, sf_dir, "pages").select("page_id", "url"), url="url").drop("url")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sorted(labelled_texts(docs, _table(spark, sf_dir, "labels"), factorisation.SAMPLE, learn=fold(F.col("doc_id")) != 0))
    machine = factorisation.train([r["text"] for r in rows], [r["label"] for r in rows])
    return factorisation.scored(docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text"), machine)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.with_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"), edit=runs.repeated_tail))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"), edit=variants.misspelt)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_token_store": op2_token_store,
        "op3_licenses": op3_licenses,
        "op4_simhash": op4_simhash,
        "op5_line_dedup": op5_line_dedup,
        "op6_language": op6_language,
        "op7_url_rules": op7_url_rules,
        "op8_line_quality": op8_line_quality,
        "op9_mixing": op9_mixing,
        "op10_quality": op10_quality,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.SQL, "op9_mixing": mixing.SQL, "op12_spelling_variants": variants.SQL, "op13_minhash": minhash.SQL}
