"""Audit of how filters interact, over a sparse document-term matrix.

Documents are cut into shards of a bounded number of bytes. A shard is a block of the matrix in compressed sparse rows, with words numbered inside the shard;
its word list goes to the buckets of a global dictionary, which number the distinct words of all shards, and the shard's numbers are translated by what comes back. So
the words that are shuffled are those of the lists, never those of every document. Row sums are word counts, nonzero counts are distinct words.

What a document fails is a set of filters, kept as bits. All figures of all orders of the filters follow from the number of documents per set of failures.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tidemark.llm import words as W
from tidemark.session import shuffle_width, stage

#: About the bytes of text of a shard. A document is never cut, so a longer one makes a longer shard.
SHARD_BYTES = 4 << 20


def packed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[W.Words, pa.Array]:
    """The words of some texts, and their bytes in one array."""
    words = W.find_words(data, offsets)
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    return words, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(ends), pa.py_buffer(data[~W.SPACE[data]])])


def csr(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Row starts, word numbers and counts of whole texts; the words by number, and the bucket of each. Words are told apart by their bytes and numbered bucket by bucket."""
    words, packed = packed_words(data, offsets)
    coded = packed.dictionary_encode()
    names = coded.dictionary
    flat, ends = W.text_bytes(names)
    bucket = (W.span_hashes(flat, ends[:-1], ends[1:]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    size = max(len(names), 1)
    cells, counts = np.unique(words.doc * size + number[coded.indices.to_numpy()], return_counts=True)
    return np.searchsorted(cells, np.arange(len(offsets)) * size), cells % size, counts, names.take(pa.array(order)), bucket[order]


def _listed(values: pa.Array) -> pa.Array:
    """An array as the one entry of a column of arrays."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def local_shards(df: DataFrame, text: str, carried: list[str], counted: dict[str, np.ndarray], buckets: int) -> DataFrame:
    """One row per shard: ``shard``, ``rows`` (the carried columns of each document and how many of its bytes are in each counted set), ``indptr``, ``indices``, ``data``, ``words``.

    A shard's number comes from its partition and its place there. Words: maximal runs of bytes other than blanks; a null text has none. ``words`` has the words of
    each bucket in one entry, with blanks between them, in the order of their numbers.
    """
    row = StructType([*(df.schema[c] for c in carried), *(StructField(c, LongType()) for c in counted)])
    kinds = StructType().add("shard", LongType()).add("rows", ArrayType(row))
    for name in ("indptr", "indices", "data"):
        kinds = kinds.add(name, ArrayType(IntegerType()))
    kinds = kinds.add("words", ArrayType(StructType().add("bucket", IntegerType()).add("joined", BinaryType())))

    def one(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        data, offsets = W.text_bytes(whole.column(text))
        indptr, indices, counts, words, bucket = csr(data, offsets, buckets)
        held, first = np.unique(bucket, return_index=True)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([*first, len(bucket)], pa.int32()), words.cast(pa.binary())), b" ")
        figures = []
        for wanted in counted.values():
            total = np.concatenate([[0], np.cumsum(wanted[data])])
            figures.append(pa.array(total[offsets[1:]] - total[offsets[:-1]]))
        fields = [*(whole.schema.field(c) for c in carried), *(pa.field(c, pa.int64()) for c in counted)]
        rows = pa.StructArray.from_arrays([*(whole.column(c).combine_chunks() for c in carried), *figures], fields=fields)
        numbers = [_listed(pa.array(x.astype(np.int32))) for x in (indptr, indices, counts)]
        lists = pa.StructArray.from_arrays([pa.array(held.astype(np.int32)), joined], ["bucket", "joined"])
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), _listed(rows), *numbers, _listed(lists)], kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            offsets = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(text)).fill_null(0).to_numpy())])
            lo = 0
            while lo < b.num_rows:
                hi = min(b.num_rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SHARD_BYTES - size, "right")) - 1))
                held.append(b.slice(lo, hi - lo))
                size, lo = size + int(offsets[hi] - offsets[lo]), hi
                if size >= SHARD_BYTES or lo < b.num_rows:
                    yield one(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield one(number, held)

    return df.select(text, *carried).mapInArrow(run, kinds)


def _numbered(joined: pa.Array, bucket: int, buckets: int) -> tuple[W.Words, pa.Array, pa.Array]:
    """Words of one bucket: where they stand, the number of each, and the distinct words in ascending order. A number follows from the place of the word among the bucket's
    sorted words, so it is the same whatever order the lists come in."""
    words, packed = packed_words(*W.text_bytes(joined))
    coded = packed.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return words, pa.array(rank[coded.indices.to_numpy()] * buckets + bucket), coded.dictionary.take(order)


def dictionary(shards: DataFrame, buckets: int) -> DataFrame:
    """``word`` (its bytes) and ``word_id``: each distinct word of all shards and its number."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        names = _numbered(table.column("joined"), bucket, buckets)[2].cast(pa.binary())
        return pa.table({"word": names, "word_id": pa.array(np.arange(len(names)) * buckets + bucket)})

    return shards.select(F.inline("words")).groupBy("bucket").applyInArrow(run, "word binary, word_id long")


def encoded(shards: DataFrame, buckets: int) -> DataFrame:
    """Shards whose ``indices`` are global word numbers, ascending within a row; the word lists are gone.

    What is shuffled by words are the lists of the shards: a word comes once per shard, however often documents hold it. A bucket of the dictionary is as large as the lists
    of all shards divided by the number of buckets; the numbers of a shard come together in one row, which is bounded as the shard is.
    """

    def number(key: tuple, table: pa.Table) -> pa.Table:
        words, ids, _ = _numbered(table.column("joined"), key[0].as_py(), buckets)
        lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), ids)
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "ids": lists})

    lists = shards.select("shard", F.inline("words")).groupBy("bucket").applyInArrow(number, "shard long, bucket int, ids array<long>")
    numbers = lists.groupBy("shard").agg(F.flatten(F.array_sort(F.collect_list(F.struct("bucket", "ids")))["ids"]).alias("numbers"))
    # a shard of texts without words has no list
    both = shards.drop("words").join(numbers, "shard", "left").withColumn("numbers", F.coalesce("numbers", F.array().cast("array<long>")))
    kinds = StructType([StructField("indices", ArrayType(LongType())) if f.name == "indices" else f for f in shards.drop("words").schema])

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                indptr, indices, data, numbers = (one.column(n).flatten().to_numpy() for n in ("indptr", "indices", "data", "numbers"))
                ids = numbers[indices] if len(indices) else indices.astype(np.int64)
                order = np.lexsort((ids, np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))))
                new = {"indices": pa.array(ids[order]), "data": pa.array(data[order])}
                yield pa.RecordBatch.from_arrays([_listed(new[n]) if n in new else one.column(n) for n in kinds.names], kinds.names)

    return both.mapInArrow(translate, kinds)


def document_term_matrix(df: DataFrame, text: str, carried: list[str], counted: dict[str, np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """The matrix in shards of compressed sparse rows, and the dictionary of its columns.

    Shards: ``shard``, ``rows`` (array of the carried columns, one entry per document, with the number of bytes in each set of ``counted``), ``indptr`` (one entry more), ``indices`` (global word
    numbers) and ``data`` (counts). The shards as texts gave them are written to the shared folder and read from there. Word numbers are unique; they have gaps of about
    the spread of bucket sizes. A null or empty text is a row without entries, repeated rows are rows of their own, an empty table gives no shard.
    """
    buckets = max(64, 2 * shuffle_width(df.sparkSession))
    shards = stage(local_shards(df, text, carried, counted or {}, buckets))
    return encoded(shards, buckets), dictionary(shards, buckets)


def row_figures(matrix: DataFrame) -> DataFrame:
    """The carried columns of each document with ``row_sum`` (words) and ``nonzeros`` (distinct words)."""
    names = matrix.schema["rows"].dataType.elementType.names

    def figures(row: Column, i: Column) -> Column:
        start, end = F.get("indptr", i), F.get("indptr", i + 1)
        counts = F.slice("data", start + 1, end - start)
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda x, n: x + n)
        return F.struct(*[row[c].alias(c) for c in names], total.alias("row_sum"), (end - start).cast("long").alias("nonzeros"))

    return matrix.select(F.inline(F.transform("rows", figures)))


# ---------------------------------------------------------------- filters and their orders

def first_copies(df: DataFrame, digest: str, key: str, by: list[str]) -> DataFrame:
    """Rows per (by, ``copy``) as ``n``: ``copy`` is true for rows whose text stands under a smaller key too. Texts are equal if their digests are.

    Rows are first counted per text, key and group, which parts a text held by very many documents; what is left per text and group is combined before it is
    shuffled again. A null key is not smaller than any other, nor larger.
    """
    each = df.groupBy(digest, key, *by).agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy(digest, F.col(key).isNull().alias("__none"), *by).agg(F.sum("n").alias("__all"), F.min(key).alias("__first"), F.min(F.struct(key, "n"))["n"].alias("__at"))
    least = groups.groupBy(digest).agg(F.min("__first").alias("__least"))
    joined = groups.join(least, digest)
    firsts = F.when(F.col("__none"), F.col("__all")).when(F.col("__first") == F.col("__least"), F.col("__at")).otherwise(F.lit(0))
    split = joined.withColumn("__split", F.explode(F.array(F.struct(F.lit(False).alias("copy"), firsts.alias("n")), F.struct(F.lit(True).alias("copy"), (F.col("__all") - firsts).alias("n")))))
    return split.select(*by, "__split.copy", "__split.n").filter("n > 0").groupBy(*by, "copy").agg(F.sum("n").alias("n"))


def failed_bits(conditions: list[Column]) -> Column:
    """Bit i is set if condition i holds; null counts as false."""
    bits = F.lit(0)
    for i, c in enumerate(conditions):
        bits = bits + F.when(c, 1 << i).otherwise(0)
    return bits


def interactions(counts: DataFrame, part: str, bits: str, letters: str, totals: dict[str, Column]) -> DataFrame:
    """Figures of each part, order of all filters and step, from numbers of documents per set of failed filters.

    ``counts`` has columns part, bits and what the totals read; ``n`` is the number of documents. Per step: ``kept`` after it, ``removed`` by it, ``redundant`` (fails its filter, removed
    before), ``unique_fails`` (fails its filter only), ``shapley`` (removed by its filter, at any step, over all orders), and for each further total what the
    step removed of it. Every part has all orders and steps. Rows are those of parts and sets, not of documents.
    """
    assert len(letters) <= 5, "the shares of an order are whole numbers for up to five filters"
    orders = ["".join(p) for p in permutations(letters)]
    bit = {c: 1 << i for i, c in enumerate(letters)}
    values = [{"filter_order": o, "step": i + 1, "before": sum(bit[c] for c in o[:i]), "bit": bit[x]} for o in orders for i, x in enumerate(o)]
    steps = F.from_json(F.lit(json.dumps(values)), "array<struct<filter_order: string, step: int, before: int, bit: int>>")
    small = counts.groupBy(part, bits).agg(F.sum("n").alias("n"), *[F.sum(c).alias(f"__{name}") for name, c in totals.items()])
    each = small.select(part, bits, "n", *[f"__{name}" for name in totals], F.explode(steps).alias("at")).select("*", "at.*")
    fails = F.col(bits).bitwiseAND(F.col("bit")) != 0
    gone = F.col(bits).bitwiseAND(F.col("before")) != 0
    removed = fails & ~gone
    share = F.lit(len(orders)) / F.greatest(F.bit_count(F.col(bits)), F.lit(1))

    def of(condition: Column, n: Column | str = "n") -> Column:
        return F.sum(F.when(condition, n if isinstance(n, Column) else F.col(n)).otherwise(F.lit(0))).cast("long")

    return each.groupBy(part, "filter_order", "step").agg(
        of(~fails & ~gone).alias("kept"), of(removed).alias("removed"), of(fails & gone).alias("redundant"), of(F.col(bits) == F.col("bit")).alias("unique_fails"),
        of(fails, F.col("n") * F.round(share).cast("long")).alias("shapley"), *[of(removed, f"__{name}").alias(name) for name in totals])
