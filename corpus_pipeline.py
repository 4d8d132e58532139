"""From raw documents to shards for training.

Each stage works on all that the one before kept and is written as Parquet, from which the next one reads. All but the last return the columns of
documents; the last adds the place of each document in the shuffled shards.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, neardup, sharding, toxicity
from tidemark.llm.registry import table
from tidemark.llm.words import word_count
from tidemark.session import shared_folder

#: A trained scorer and a hash-based sketch are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None
SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3, by a model of the labels. A null or empty text has no toxic word and is scored like any other; each row is judged on its own."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), cut=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group. Texts without words are like no other and stay, as do documents without id."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none, null and empty items are held by none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source asks for, none, once or more, with all its columns as they are.

    A null source is a source; documents without words come along in their source's rate; repeated documents are sampled one by one; of no documents none are left.
    """
    row = F.struct(*docs.columns).alias("row")  # so that no name of the mix meets one of a document
    sized = docs.select(row, F.col("doc_id").alias("key"), F.col("source").alias("source"), word_count(F.col("text")).alias("words"))
    return mixing.emit(mixing.mix(sized, key="key", size="words")).select("row.*")


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds row_number, shard and slot of the reproducible shuffle; a column of a document with one of these names goes on as ``<name>_given``.

    Nulls are values like others in the order of rows; repeated documents get places of their own; of no documents none are left.
    """
    given = docs.withColumnsRenamed({c: f"{c}_given" for c in ("row_number", "shard", "slot") if c in docs.columns})
    return sharding.shard(given, ["doc_id", "source", "lang", "text"], SHARDS, seed=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The tables between them go to a folder of their own in the folder that the session shares; a table goes when the next one is written, the
    last one stays for the caller."""
    docs = table(spark, sf_dir, "documents")
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:
            remove(spark, last)
        last = f"{folder}/{name}"
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table by the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
