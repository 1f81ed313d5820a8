"""From raw documents to shuffled shards of a clean, mixed corpus.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps,
with the columns and values of documents, whatever other columns are there;
the last adds shard and slot, which replace columns of these names.  Null and
empty texts are not toxic and hold no leak; they are one near-duplicate group,
of which the row with the smallest doc_id stays until mixing, which takes
nothing of texts without words.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.llm import decontamination, mixing, sharding, simhash, toxicity
from annotide.llm.common import checkpoint, quoted


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7."""
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(docs, model, score="__toxicity").where("__toxicity < 0.7").select(*map(quoted, docs.columns))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.without_near_duplicates(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    rows = decontamination.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), leaks="__leaks")
    return rows.where(F.size("__leaks") == 0).select(*map(quoted, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document taken twice has two rows."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, shuffled into 24 shards."""
    return sharding.shuffled_shards(docs, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8, 24)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", leaks_out),
    ("mixing", mix),
    ("sharding", shard),
]

#: The first three stages learn a model or search by hashes that SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the checkpoint folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
