"""Benchmark decontamination: short test items found inside long documents.

Items are parted by size (doubling number of shingles). In a part whose items have at most ``u`` shingles, an item's sketch is the ``floor((1 - t) * u) + 1``
smallest MinHash values of its shingle set. A document that holds a share of ``t`` or more of the item misses at most ``(1 - t) * u`` shingles, so it
holds at least one of the sketch: looking up a document's shingles in the sketches misses nothing, however long the document is. Candidates are
then verified by exact containment of the shingles themselves. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import with_shingles, word_array
from tidemark.session import stage

#: Sides of a join up to this many rows are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def with_hash_set(df: DataFrame, text: str, k: int, hashes: str) -> DataFrame:
    """Adds the hashes of the k-word shingles; of the whole sequence for fewer words; none for no words."""
    df = with_shingles(df, text, k, "__words", "__many")
    whole = F.when(F.size("__words") > 0, F.array(F.xxhash64("__words", F.lit(k)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(hashes, F.when(F.size("__words") >= k, F.col("__many")).otherwise(whole)).drop("__words", "__many")


def exploded(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, __hash): one row for each shingle.

    The outer form: the plain one lets the optimizer filter by the size of the array first, and works the whole array out again for that.
    """
    return with_hash_set(df, text, k, "__hashes").select(key, F.explode_outer("__hashes").alias("__hash")).filter(F.col("__hash").isNotNull())


def with_shingle_set(df: DataFrame, text: str, k: int, name: str) -> DataFrame:
    """Adds the shingles themselves."""
    df = df.withColumn("__words", word_array(F.col(text)))
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__words") - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice("__words", i, k), " "))
    return df.withColumn(name, F.when(F.size("__words") > 0, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))).drop("__words")


def _small(df: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if its counted rows allow it."""
    staged = stage(df)
    return F.broadcast(staged) if staged.count() <= BROADCAST_ROWS else staged


def sketches(items: DataFrame, item: str, text: str, k: int, least: float) -> DataFrame:
    """(item, hash): the sketch of each item by its size part."""
    grams = exploded(items.select(F.col(item).alias("__item"), F.col(text).alias("__text")), "__item", "__text", k).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("__item"))
    upper = F.pow(F.lit(2.0), F.floor(F.log2("__n")) + 1) - 1
    length = F.floor((1 - least) * upper + 1e-9) + 1
    rank = F.row_number().over(Window.partitionBy("__item").orderBy(F.xxhash64("__hash", F.lit(4)), "__hash"))
    return grams.withColumn("__n", n).withColumn("__rank", rank).filter(F.col("__rank") <= length).select("__item", "__hash")


def candidates(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 5, least: float = 0.75) -> DataFrame:
    """(key, item) of documents that hold an entry of the item's sketch."""
    found = exploded(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__key", "__text", k)
    return found.join(_small(sketches(items, item, item_text, k, least)), "__hash").select("__key", "__item").distinct()


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 5, least: float = 0.75) -> DataFrame:
    """Pairs of a document and an item of whose shingles it holds a share of ``least`` or more.

    Columns: the key, the item, ``shared`` and ``item_shingles`` (long), ``containment``. Words are lower-cased (A-Z). A text with 1 to k-1 words has one
    shingle, its whole sequence, so a very short item is found only in documents that say just that. Texts that are null or have no words
    hold nothing and are held by nothing. Null keys are kept as such; rows that share a key are each verified and give one pair each, equal ones
    once; items that share an id likewise. Other columns are not read.
    """
    pairs = _small(candidates(docs, items, key, text, item, item_text, k, least))
    wanted = with_shingle_set(items.select(F.col(item).alias("__item2"), F.col(item_text).alias("__text")), "__text", k, "__wanted").select("__item2", "__wanted").filter(F.size("__wanted") > 0)
    pairs = pairs.join(_small(wanted), F.col("__item").eqNullSafe(F.col("__item2"))).drop("__item2").withColumnRenamed("__key", "__key2")
    if pairs.count() <= BROADCAST_ROWS // 10:
        pairs = F.broadcast(pairs)
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    both = texts.join(pairs, F.col("__key").eqNullSafe(F.col("__key2")))
    both = with_shingle_set(both, "__text", k, "__held")
    shared = F.size(F.array_intersect("__wanted", "__held")).cast("long")
    # an aggregate, so that the figure is worked out once and not again in the filter
    counted = both.groupBy("__key", "__item", F.xxhash64("__text"), F.size("__wanted").cast("long").alias("item_shingles")).agg(F.max(shared).alias("shared"))
    held = counted.filter(F.col("shared") >= F.lit(least) * F.col("item_shingles"))
    held = held.select(F.col("__key").alias(key), F.col("__item").alias(item), "shared", "item_shingles").distinct()
    return held.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item; all columns are kept."""
    hits = contained(docs, items, key, **options).select(F.col(key).alias("__hit")).distinct()
    return docs.join(_small(hits), F.col(key).eqNullSafe(F.col("__hit")), "left_anti")
