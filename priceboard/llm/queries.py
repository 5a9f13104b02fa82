"""The queries of the document operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, language_model, line_dedup, mixing, near_duplicates, pii, quality_rules, resampling, sharding, source_audit, toxicity, vector_codes


#: The registered query keeps to one secret, so that its reruns agree; a real corpus needs one of its own.
QUERY_SECRET = "of the registered query alone"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.cleaned(_table(spark, sf_dir, "documents"))
    return done.select(F.col("__id").alias("doc_id"), F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.md5(F.coalesce("__text", F.lit(""))).alias("text_md5"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs, labels.filter(~held))
    scored = toxicity.score(docs, model, spans=True)
    scored = scored.withColumnRenamed("id", "doc_id").withColumn("held_out", F.coalesce(held, F.lit(False)))
    digest = F.md5(F.concat_ws("\n", "offending.sentence").cast("binary"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), digest.alias("offending_md5"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "covered", "item_words", "slots", "changed", "verbatim")


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.replaced(_table(spark, sf_dir, "documents"), QUERY_SECRET)
    return done.select(F.col("__id").alias("doc_id"), F.col("__n").alias("n_entities"), F.col("__text").alias("text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    names = {"__nw": "n_words", "__wc": "word_chars", "__sym": "n_symbols", "__dup": "n_dup_lines", "__rep": "n_repeat_words", "__fail": "base_failed", "__kept": "kept"}
    return judged.select("__row.doc_id", *(F.col(k).alias(v) for k, v in names.items()))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op9_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "log_weight", F.col("key").alias("sample_key"), "selected")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = vector_codes.coded(_table(spark, sf_dir, "embeddings"))
    return done.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(exact_dedup.build(_table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_language_model, op3_line_dedup, op4_toxicity, op5_decontaminate,
        op6_surrogates, op7_quality_rules, op8_shard, op9_resample, op10_near_duplicates,
        op11_vector_codes, op12_exact_dedup, op13_source_audit,
    )
}
SQL: dict[str, str] = {"op3_line_dedup": line_dedup.SQL, "op11_vector_codes": vector_codes.SQL, "op12_exact_dedup": exact_dedup.SQL, "op13_source_audit": source_audit.SQL}
