"""Near-duplicate groups: one-permutation MinHash, banded buckets, star edges, links confirmed on full sets.

* A document's shingle hashes are dealt to 128 bins by their top bits; each bin keeps its smallest hash. An empty bin takes the value of a filled one that a
  fixed random walk of the bin reaches first (optimal densification). Four bins make a band; at a similarity of 0.75 two documents share none of 32 bands once in
  200,000 pairs.
* Documents with equal sets are one from here on, so the number of copies costs nothing.
* In each bucket every member is paired with one center, the document that meets most others over all its buckets (of a family of copies: the one that
  the others were made from): as many pairs as members, never all pairs. A document takes the pair whose sketches agree most, and the pair is confirmed by the full sets.
* What stars cannot link, two members that are alike while the center is like neither, is left in buckets that still hold several components. Only
  there, and only across components, are members compared with each other, by their full sets; what this gives are links that join components, fewer than members.
* Components come from alternating star contractions of the confirmed links, in staged tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.decontaminate import BROADCAST_ROWS
from tidemark.session import stage

BINS = 128
ROWS = 4
#: Sketch bits that two documents with a similarity of 0.75 share at least (of 256, five standard deviations below the mean), if their sets fill the bins.
LEAST_BITS = 192
#: Shingles of a bucket that are compared in one task; a bucket with more is cut into blocks.
BLOCK = 400_000
#: Links that one task contracts at least; a step over few links is a few tasks, however many partitions the session shuffles into.
LINKS_PER_TASK = 100_000


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their text, sorted by both, without repeats."""
    low = W.FOLD[data]
    found = W.find_words(low, offsets)
    h, doc = W.shingles(W.span_hashes(low, found.start, found.end), found, k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def signatures(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """MinHash values, texts x bins, of texts with at least one shingle (others: zeros)."""
    cell = doc * BINS + (h >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = cell[1:] != cell[:-1]
    values, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    values[cell[first]], filled[cell[first]] = h[first], True
    values, filled = values.reshape(n, BINS), filled.reshape(n, BINS)
    at, bin_ = np.nonzero(~filled & filled.any(1)[:, None])
    for attempt in count(1):
        if not len(at):
            return values
        donor = (W.mix((bin_ + attempt * BINS).astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)
        hit = filled[at, donor]
        values[at[hit], bin_[hit]] = values[at[hit], donor[hit]]
        at, bin_ = at[~hit], bin_[~hit]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """One hash for each band, which tells the bands apart too."""
    parts = values.reshape(len(values), BINS // ROWS, ROWS)
    out = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        out = W.mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out


def sketch_bits(values: np.ndarray) -> np.ndarray:
    """Two bits of each bin, in four longs."""
    mixed = W.mix(values)
    both = np.stack([mixed & np.uint64(1), (mixed >> np.uint64(1)) & np.uint64(1)], 2).astype(np.uint8).reshape(len(values), 2 * BINS)
    return np.packbits(both, axis=1).view(np.int64).reshape(len(values), -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))


def sketches(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """__key, n_shingles, two hashes of the whole set, bands, bits: one row per input row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.pieces(*W.text_bytes(batch.column(1))):
                h, doc = distinct_shingles(data, offsets, k)
                border = np.searchsorted(doc, np.arange(hi - lo + 1))
                sums = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h ^ np.uint64(salt)), dtype=np.uint64)])
                    sums.append((total[border[1:]] - total[border[:-1]]).view(np.int64))
                values = signatures(h, doc, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(border)), pa.array(sums[0]), pa.array(sums[1]), _lists(bands(values)), _lists(sketch_bits(values))],
                                                 names=["__key", "n_shingles", "__a", "__b", "__bands", "__bits"])

    return docs.select(key, text).mapInArrow(run, f"__key {kind}, n_shingles long, __a long, __b long, __bands array<long>, __bits array<long>")


def full_sets(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """__key, __set: all shingle hashes of each text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.pieces(*W.text_bytes(batch.column(1))):
                h, doc = distinct_shingles(data, offsets, k)
                border = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(border), pa.array(h.view(np.int64)))], names=["__key", "__set"])

    return docs.select(key, text).mapInArrow(run, f"__key {kind}, __set array<long>")


def _renamed(df: DataFrame, mark: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + mark for c in df.columns})


def shared_bits() -> Column:
    """Sketch bits in which the pair (1, 2) agrees."""
    same = F.lit(2 * BINS)
    for i in range(2 * BINS // 64):
        same = same - F.bit_count(F.col("__bits1")[i].bitwiseXOR(F.col("__bits2")[i]))
    return same


def may_link(percent: int) -> Column:
    """What sizes and sketch bits of the pair (1, 2) allow. The bits count only where both sets are large enough to fill the bins."""
    small, large = F.least("__n1", "__n2"), F.greatest("__n1", "__n2")
    alike = (small * 100 >= large * percent)
    return alike & ((small < 2 * BINS) | (shared_bits() >= LEAST_BITS)) if percent >= 75 else alike


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (__u, __v) whose full sets are alike enough."""
    one, two = _renamed(sets, "1"), _renamed(sets, "2")
    both = pairs.join(one, pairs["__v"] == one["__key1"]).join(two, F.col("__u") == two["__key2"])
    shared = F.size(F.array_intersect("__set1", "__set2"))
    return both.filter(shared * 100 >= (F.size("__set1") + F.size("__set2") - shared) * percent).select("__u", "__v")


def links_within(node: pa.Array, comp: pa.Array, side: np.ndarray, border: np.ndarray, values: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Positions (u, v) of links that join different components of some documents with their full sets; no more links than documents.

    Sets become rows of bits over the shingles that stand in more than one of them, so that an intersection is a count of common bits. Of two sides
    only pairs across are compared.
    """
    n = np.diff(border)
    parts = comp.flatten() if pa.types.is_struct(comp.type) else [comp]
    _, root = np.unique(np.stack([x.dictionary_encode().indices.to_numpy(zero_copy_only=False) for x in parts]), axis=1, return_inverse=True)
    if len(n) < 2 or (root == root[0]).all():
        return [], []
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(n)), n)
    common = times[place] > 1
    row, place = row[common], column[place[common]]
    width = int(place.max()) // 64 + 1 if len(place) else 1
    bits = np.zeros(len(n) * width, np.uint64)
    np.add.at(bits, row * width + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    bits = bits.reshape(len(n), width)
    two = (side != side[0]).any()
    us, vs = [], []
    for i in range(len(n) - 1):
        later = slice(i + 1, None)
        may = (root[later] != root[i]) & (np.minimum(n[later], n[i]) * 100 >= np.maximum(n[later], n[i]) * percent)
        if two:
            may &= side[later] != side[i]
        at = np.flatnonzero(may) + i + 1
        if not len(at):
            continue
        shared = np.bitwise_count(bits[at] & bits[i]).sum(1, dtype=np.int64)
        for j in at[shared * 100 >= (n[at] + n[i] - shared) * percent]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                us.append(i)
                vs.append(int(j))
    return us, vs


def links_across(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(__u, __v): links between different components inside the buckets of ``left`` (__bucket, __node, __comp, __blocks).

    A bucket whose sets are too many for one task is cut into blocks, and each two blocks meet in a task of their own. Nothing is left out, and what comes out are links, not pairs.
    """
    block = F.pmod(F.xxhash64("__node", F.lit(6)), F.col("__blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    dealt = left.withColumn("__side", block).withColumn("__other", other)
    dealt = dealt.withColumn("__group", F.xxhash64("__bucket", F.least("__side", "__other"), F.greatest("__side", "__other"))).select("__group", "__side", "__node", "__comp")
    full = dealt.join(sets, F.col("__node") == F.col("__key")).select("__group", "__side", "__node", "__comp", "__set")
    full = full.repartition("__group").sortWithinPartitions("__group")
    kind = left.schema["__node"].dataType.simpleString()

    def settle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        group, side = rows["__group"].to_numpy(), rows["__side"].to_numpy()
        node, comp, sets_ = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows["__node"], rows["__comp"], rows["__set"]))
        border, values = sets_.offsets.to_numpy(), sets_.values.to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        us, vs = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            u, v = links_within(node[lo:hi], comp[lo:hi], side[lo:hi], border[lo:hi + 1] - border[lo], values[border[lo]:border[hi]], percent)
            us += [lo + x for x in u]
            vs += [lo + x for x in v]
        return pa.RecordBatch.from_arrays([node.take(pa.array(us, pa.int64())), node.take(pa.array(vs, pa.int64()))], names=["__u", "__v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            group = held["__group"].to_numpy()
            cut = int(np.searchsorted(group, group[-1], "left")) if len(group) else 0
            if cut:
                yield settle(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield settle(held)

    return full.mapInArrow(run, f"__u {kind}, __v {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(__node, __comp): the smallest node reachable, for nodes with an edge. Star contractions, in turn around larger and smaller neighbours, until nothing moves.

    Minima are pre-aggregated on the map side and joined back, so a hub is no task of its own.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("__v").alias("__u"), F.col("__u").alias("__v")))

    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy(F.col("__u").alias("__hub")).agg(F.least(F.min("__v"), F.first("__u")).alias("__least"))

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("__u", "__v").cast("decimal(20,0)"))).first()

    edges = stage(edges.select(F.greatest("__u", "__v").alias("__u"), F.least("__u", "__v").alias("__v")).filter("__u > __v").distinct())
    seen = mark(edges)
    while True:
        tasks = 1 + seen[0] // LINKS_PER_TASK
        wide = both(edges.coalesce(tasks))
        large = wide.join(minima(wide), F.col("__u") == F.col("__hub")).filter("__v > __u").select(F.col("__v").alias("__u"), F.col("__least").alias("__v")).coalesce(tasks).distinct()
        down = stage(large.coalesce(tasks))
        small = down.join(minima(down), F.col("__u") == F.col("__hub")).coalesce(tasks)
        edges = stage(small.select(F.col("__v").alias("__u"), F.col("__least").alias("__v")).union(small.select("__u", F.col("__least"))).filter("__u > __v").distinct().coalesce(tasks))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("__u").alias("__node"), F.col("__v").alias("__comp")).union(edges.select("__v", "__v").distinct())


def _labelled(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """One row per input row: ``__key``, ``n_shingles``, ``__comp`` (smallest key reachable by texts). Keys that repeat must tell texts apart."""
    all_rows = stage(sketches(docs, key, text, k))
    rows = all_rows.filter("n_shingles > 0 AND __key IS NOT NULL")
    same = ["__a", "__b", "n_shingles"]
    nodes = stage(rows.groupBy(*same).agg(F.min("__key").alias("__node"), F.first("__bands").alias("__bands"), F.first("__bits").alias("__bits")))
    sketch = nodes.select("__node", F.col("n_shingles").alias("__n"), "__bits")
    buckets = nodes.select("__node", F.explode("__bands").alias("__bucket"))
    sizes = buckets.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__members")).filter("__members > 1")
    crowded = stage(buckets.join(sizes, "__bucket"))
    weights = crowded.groupBy("__node").agg(F.sum("__members").alias("__weight"))
    stars = crowded.join(weights, "__node").groupBy("__bucket").agg(F.max_by("__node", F.struct("__weight", "__node")).alias("__center"))
    pairs = crowded.join(stars, "__bucket").filter("__node != __center").select(F.col("__center").alias("__u"), F.col("__node").alias("__v")).distinct()
    one, two = _renamed(sketch, "1"), _renamed(sketch, "2")
    pairs = pairs.join(one, F.col("__u") == F.col("__node1")).join(two, F.col("__v") == F.col("__node2")).filter(may_link(percent))
    best = pairs.groupBy("__v").agg(F.max_by("__u", F.struct(shared_bits(), "__u")).alias("__u")).select("__u", "__v")
    ends = crowded.select(F.col("__node").alias("__end")).distinct()
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    sets = stage(full_sets(docs.join(ends, docs[key] == F.col("__end"), "left_semi"), key, text, k))
    links = stage(confirmed(best, sets, percent))
    comp = components(links)

    labelled = crowded.select("__bucket", "__node").join(comp, "__node", "left").withColumn("__comp", F.coalesce("__comp", "__node"))
    sized = labelled.join(sketch.select("__node", "__n"), "__node")
    mixed = sized.groupBy("__bucket").agg((F.min("__comp") != F.max("__comp")).alias("__mixed"), (F.floor(F.sum("__n") / BLOCK) + 1).cast("int").alias("__blocks")).filter("__mixed")
    left = stage(labelled.join(mixed.select("__bucket", "__blocks"), "__bucket"))
    comp = stage(components(links.union(links_across(left, sets, percent))))

    groups = nodes.select(*same, "__node").join(comp, "__node", "left").select(*same, F.coalesce("__comp", "__node").alias("__comp"))
    out = all_rows.select("__key", *same).join(groups, same, "left")
    return out.select("__key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("__comp", "__key")).otherwise(F.col("__key")).alias("__comp"))


def _repeats(docs: DataFrame, key: str) -> bool:
    ids = docs.select(key).filter(F.col(key).isNotNull())
    return ids.count() != ids.distinct().count()


def _text_key(key: str, text: str) -> Column:
    """The key with two hashes of the text, so that it tells texts apart and is ordered by key first."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: the key, ``n_shingles``, ``component_id`` (smallest key reachable), ``kept`` (the key is that one).

    Words are lower-cased (A-Z); a text with 1 to k-1 words has its whole sequence as its one shingle; a null text or one without words has
    none and is linked with nothing. Rows that share a key are one node with the links of all of them. A row without key is linked with
    nothing; its component is null and it is kept. Other columns are not read.
    """
    if _repeats(docs, key):  # texts are nodes of their own, and joined by their keys once their links are known
        found = stage(_labelled(docs.select(_text_key(key, text).alias(key), text), key, text, k, percent))
        found = found.select(F.col("__key.key").alias("__key"), "n_shingles", F.col("__comp.key").alias("__first"))
        comp = components(found.filter("__key != __first").select(F.col("__key").alias("__u"), F.col("__first").alias("__v")))
        out = found.join(comp, F.col("__key") == F.col("__node"), "left").select("__key", "n_shingles", F.coalesce("__comp", "__key").alias("__comp"))
    else:
        out = _labelled(docs, key, text, k, percent)
    alone = F.col("__key").isNull()
    return out.select(F.col("__key").alias(key), "n_shingles", F.when(~alone, F.col("__comp")).alias("component_id"), (alone | (F.col("__key") == F.col("__comp"))).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """The documents without near duplicates of a smaller key; all columns are kept. Rows without key stay.

    Rows that share a key are judged text by text: of texts that are alike the one with the smallest key stays (under one key, the one with the smallest
    hash), and of rows that share key and text the first by the JSON of their columns. A text that is like no other always stays.
    """
    repeats = _repeats(docs, key)
    rows = docs.withColumn("__id", _text_key(key, text) if repeats else F.col(key))
    found = _labelled(rows.select("__id", text), "__id", text, k, percent)
    gone = stage(found.filter("__key != __comp").select(F.col("__key").alias("__gone")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    left = rows.join(gone, F.col("__id") == F.col("__gone"), "left_anti")
    if not repeats:
        return left.drop("__id")
    row = F.struct(*[left[c] for c in docs.columns])
    once = left.filter(F.col("__id").isNotNull()).groupBy("__id").agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return once.unionByName(left.filter(F.col("__id").isNull()).drop("__id"))
