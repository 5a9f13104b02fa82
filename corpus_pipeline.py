"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, mixing, sharding.

Defined cases: a null, empty or blank text has fewer than ten words, so the first stage drops it; a null id, lang or source is a value
like any other, and rows keep it; of repeated rows and near copies the second stage keeps the row of the least id (a null
id counts last, and of rows with equal ids and texts one stays); a document that holds a benchmark item goes whole; after mixing a
document may come back as two rows, one for each pass that takes words of it, or not at all, so ids repeat; equal ids go to one
shard.  Columns of other names, whatever they are called, are kept by every stage; the last one adds slot and shard (in place of
columns of these names).  An empty table gives an empty result with the same columns, and an empty benchmark removes nothing; texts of any
length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from priceboard.llm.common import stored
from priceboard.llm.decontamination import decontaminate
from priceboard.llm.mixing import mixed_documents
from priceboard.llm.near_duplicates import one_of_each
from priceboard.llm.quality_rules import quality_rules
from priceboard.llm.sharding import shard


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", place),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Concentration steps, sketches and draws have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None
