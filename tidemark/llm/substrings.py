"""Removal of byte strings that occur earlier, by column-wise construction of a multi-text Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes (a window) that covers it also starts earlier: in a text with a smaller key, or earlier in the same text.

Dealing out the work. The anchor of a window is the ``k``-byte string in it with the smallest hash, the leftmost of equals. Equal windows have the same anchor at the same
place, so the windows of one anchor can be settled on their own. Consecutive windows with one anchor form a segment of less than two window lengths.
Equal segments are settled without a look at their bytes: all but the first go. Segments that share an anchor, but differ, are contested, and only
their bytes are moved.

Column-wise construction. The contested segments of a task are lined up at their anchors. Going from the last column to the first, each round inserts one symbol of every
segment: the symbols in the order of the suffixes so far are this column's section of the transform; a stable sort by them gives the order of
the suffixes that are one byte longer, and range minima over the old common-prefix array give the new one. As equal windows stand in the same column, sections of different columns need no merge.
Runs with a common prefix of ``length`` or more are equal windows; all but the first of a run go. A task works through its segments in runs of bounded size, one after the other.

An anchor with very many different segments is split: its windows are settled one by one, by their hash, with minima that are pre-aggregated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.decontaminate import BROADCAST_ROWS
from tidemark.session import shuffle_width, stage

K = 24
PLACE = 28  # bits for the place of an anchor in a run of texts; the others hold the top of its hash
RUN = 1 << 18  # bytes of text that are looked at together
SEGMENTS = 40_000  # contested segments that are lined up together
HOT = 20_000  # different segments of one anchor from which its windows are settled one by one


def pack(start: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (start << 32) | (windows << 8) | offset


def _start(place: Column) -> Column:
    return F.shiftright(place, 32)


def _windows(place: Column) -> Column:
    return F.shiftright(place, 8).bitwiseAND(F.lit((1 << 24) - 1))


def segments(data: np.ndarray, offsets: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, text, first window, number of windows, offset of the anchor: of all segments in some texts."""
    n, none = len(data), np.zeros(0, np.int64)
    if n >= 1 << PLACE:
        raise ValueError(f"a text of {n} bytes; the limit is {(1 << PLACE) - 1}")
    ends = offsets[1:]
    count = np.maximum(np.diff(offsets) - (length - 1), 0)
    if not count.sum():
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    powers, inverses = W._powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(W._BYTE[data] * powers[:n], out=total[1:])
    grams = W.mix((total[k:] - total[:-k]) * inverses[:n - k + 1])
    best = (grams & np.uint64(~((1 << PLACE) - 1) & (1 << 64) - 1)) | np.arange(len(grams), dtype=np.uint64)
    width, wide = 1, length - k + 1
    while 2 * width <= wide:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < wide:
        best = np.minimum(best[:len(best) - (wide - width)], best[wide - width:])
    at = np.arange(count.sum()) + np.repeat(ends - (length - 1) - np.cumsum(count), count)  # window starts that stay in their text
    anchor = (best[at] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(at)))
    begin, place = at[first], anchor[first]
    stop = begin + windows + (length - 1)
    content = W.mix((total[stop] - total[begin]) * inverses[begin] + (stop - begin).astype(np.uint64))
    doc = np.searchsorted(offsets, begin, "right") - 1
    return grams[place], content, doc, begin - offsets[doc], windows, place - begin


def found_segments(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, content, doc, place, again) for texts in columns (doc long, text).

    What a task sees twice it settles itself (``again``), in runs as long as they come: a hot segment leaves a task once for each batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            for lo, _, data, offsets in W.pieces(*W.text_bytes(batch.column(1)), RUN):
                a, c, d, *rest = segments(data, offsets, length)
                parts.append((a, c, d + lo, *rest))
            if not parts:
                continue
            anchor, content, doc, start, windows, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            both = W.mix(anchor + content)
            order = np.lexsort((start, ids[doc], both))
            same = both[order][1:] == both[order][:-1]
            again = np.zeros(len(order), bool)
            again[order[1:][same]] = True
            go = np.flatnonzero(again)
            joined = np.zeros(len(go), bool)
            joined[1:] = (doc[go[1:]] == doc[go[:-1]]) & (start[go[1:]] == start[go[:-1]] + windows[go[:-1]])
            joined[1:] &= (np.arange(len(go)) % 65536 != 0)[1:]
            head = np.flatnonzero(~joined)
            total = np.add.reduceat(windows[go], head) if len(go) else windows[go]
            go = go[head]
            keep = np.flatnonzero(~again)
            rows = np.concatenate([keep, go])
            place = pack(start[rows], np.concatenate([windows[keep], total]), np.where(np.arange(len(rows)) < len(keep), offset[rows], 0))
            spread = np.concatenate([anchor[keep], W.mix(anchor[go] + doc[go].astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + start[go].astype(np.uint64))])
            yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), pa.array(content[rows].view(np.int64)), pa.array(ids[doc[rows]]), pa.array(place), pa.array(np.arange(len(rows)) >= len(keep))],
                                             names=["anchor", "content", "doc", "place", "again"])

    return docs.mapInArrow(run, "anchor long, content long, doc long, place long, again boolean")


def columns(parts: pa.Array, offset: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments as columns around their anchors (column x segment), and the first and last column of each."""
    data, borders = W.text_bytes(parts)
    size = np.diff(borders)
    left = length - k
    table = np.zeros((left + length, len(size)), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    table[np.arange(len(data)) - np.repeat(borders[:-1] - left + offset, size), row] = data
    first = left - offset
    return table, first, first + size - 1


def repeated_windows(table: np.ndarray, first: np.ndarray, last: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of windows that an entry of smaller rank has in the same column.

    ``order`` holds the suffixes that start in the column before, sorted; ``common`` the length of the prefix that each shares with the one above it.
    """
    entering = np.argsort(-last, kind="stable")
    come = np.searchsorted(-last[entering], -np.arange(len(table) + 1), "right")  # segments that end in a column or after it
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int16)
    out = []
    seen = 0
    for column in range(len(table) - 1, -1, -1):
        if come[column] > seen:  # segments that end here: their suffix so far is empty and sorts first
            fresh = entering[seen:come[column]]
            order, common, seen = np.concatenate([fresh, order]), np.concatenate([np.zeros(len(fresh), np.int16), common]), come[column]
            if len(common) > len(fresh):
                common[len(fresh)] = 0
        stays = first[order] <= column
        if not stays.all():  # segments that have begun leave; what they shared is carried to the next entry that stays
            kept = np.flatnonzero(stays)
            common = np.minimum.reduceat(common[:kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1])) if len(kept) else common[:0]
            order = order[kept]
        if not len(order):
            continue
        symbols = table[column, order]  # this column's section of the transform
        perm = np.argsort(symbols, kind="stable")
        lows = np.minimum.reduceat(np.append(common, np.int16(0)), perm + 1)
        common = np.zeros(len(order), np.int16)
        equal = symbols[perm[1:]] == symbols[perm[:-1]]
        common[1:][equal] = lows[:-1][equal] + 1
        order = order[perm]
        if column + length <= len(table):
            new = common < length
            if not new.all():
                starts = np.flatnonzero(new)
                least = np.minimum.reduceat(rank[order], starts)
                later = rank[order] > least[np.cumsum(new) - 1]
                seg = order[later]
                out.append((seg, column - first[seg]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def contested_windows(parts: DataFrame, length: int) -> DataFrame:
    """(doc, start, windows) that go, of contested segments (anchor, doc, place, bytes); rows of one anchor stand together in a task."""
    def settle(batch: pa.Table) -> pa.RecordBatch:
        doc, place = batch["doc"].to_numpy(), batch["place"].to_numpy()
        start, offset = place >> 32, place & 255
        order = np.lexsort((start + offset, doc))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        seg, window = repeated_windows(*columns(batch["bytes"], offset, length), rank, length)
        by = np.lexsort((window, seg))
        seg, window = seg[by], window[by]
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (window[1:] != window[:-1] + 1)
        head = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(doc[seg[head]]), pa.array(start[seg[head]] + window[head]), pa.array(np.diff(np.append(head, len(seg))))], names=["doc", "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) < SEGMENTS:
                continue
            anchor = held["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1], "left"))
            if cut:
                yield settle(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield settle(held)

    return parts.mapInArrow(run, "doc long, start long, windows long")


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, doc, place, bytes, hot) of the wanted segments, cut from their texts."""
    ids = stage(wanted.select(F.col("doc").alias("id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("wanted"))
    both = docs.join(ids, docs["doc"] == ids["id"], "left_semi").join(lists, "doc").select("doc", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            lists = batch.column(2)
            flat = lists.flatten()
            anchor, place, hot = flat.flatten()
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            at = place.to_numpy()
            windows = (at >> 8) & ((1 << 24) - 1)
            for lo in range(0, len(at), SEGMENTS):
                part = slice(lo, lo + SEGMENTS)
                begin, size = offsets[row[part]] + (at[part] >> 32), windows[part] + (length - 1)
                borders = np.concatenate([[0], np.cumsum(size)])
                took = data[np.arange(borders[-1]) + np.repeat(begin - borders[:-1], size)]
                cut = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(took)])
                n = len(size)
                yield pa.RecordBatch.from_arrays([anchor.slice(lo, n), batch.column(0).take(pa.array(row[part])), place.slice(lo, n), cut, hot.slice(lo, n)], names=["anchor", "doc", "place", "bytes", "hot"])

    return both.mapInArrow(run, "anchor long, doc long, place long, bytes binary, hot boolean")


def _single_windows(parts: DataFrame, length: int) -> DataFrame:
    """Windows that go, of hot segments: every window but the first of its content."""
    at = F.posexplode(F.transform(F.sequence(F.lit(1), _windows(F.col("place")).cast("int")), lambda i: F.substring("bytes", i, F.lit(length))))
    each = parts.select("doc", "place", at.alias("i", "window")).select("doc", (_start(F.col("place")) + F.col("i")).alias("start"), F.xxhash64("window").alias("a"), F.xxhash64(F.lit(1), "window").alias("b"))
    first = each.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return each.join(first, ["a", "b"]).filter(F.struct("doc", "start") != F.col("least")).select("doc", "start", F.lit(1).cast("long").alias("windows"))


def removed_windows(docs: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(doc, start, windows): runs of windows whose content starts earlier. ``docs`` has (doc long, text); docs tell rows apart."""
    by_anchor = Window.partitionBy("anchor")
    alike = by_anchor.orderBy("content", "doc", "place")
    found = found_segments(docs, length).withColumn("later", F.coalesce(F.lag("content").over(alike) == F.col("content"), F.lit(False)) | F.col("again"))
    found = found.withColumn("differ", F.min("content").over(by_anchor) != F.max("content").over(by_anchor))
    found = stage(found.filter("later OR differ").select("anchor", "doc", "place", "later"))
    plain = found.filter("later").select("doc", _start(F.col("place")).alias("start"), _windows(F.col("place")).alias("windows"))
    wanted = found.filter("NOT later").select("anchor", "doc", "place")
    crowded = stage(wanted.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor", F.lit(True).alias("hot")))
    some = crowded.count()
    wanted = wanted.join(crowded, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if some else wanted.withColumn("hot", F.lit(False))
    parts = stage(_cut(docs, wanted, length)) if some else _cut(docs, wanted, length)
    tasks = max(shuffle_width(docs.sparkSession), wanted.count() // SEGMENTS + 1)
    cold = parts.filter("NOT hot").drop("hot").repartition(tasks, "anchor").sortWithinPartitions("anchor")
    out = plain.union(contested_windows(cold, length))
    return out.union(_single_windows(parts.filter("hot"), length)) if some else out


def _numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """(key, doc, text) with a long that orders the rows by key, and whether it tells all rows apart. Keys that repeat
    take the slower way of numbering their texts by one sort, in which the texts of one key may lie in several tasks; any whole number and any number of texts will do."""
    rows = docs.select(F.col(key), F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if rows.count() == rows.select("doc").distinct().count():
        return rows.withColumn("doc", F.coalesce("doc", F.lit(-(1 << 63)))), True
    rows = rows.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text")})
    each = rows.dropDuplicates(["doc", "a", "b"]).sort("doc", "text").select(F.col("doc").alias("id"), F.col("a").alias("a1"), F.col("b").alias("b1"), F.monotonically_increasing_id().alias("made"))
    both = rows.join(stage(each), F.col("doc").eqNullSafe(F.col("id")) & (F.col("a") == F.col("a1")) & (F.col("b") == F.col("b1")))
    return stage(both.select(rows[key], F.col("made").alias("doc"), "text")), False


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, hot: int = HOT) -> DataFrame:
    """One row per input row: key, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``spans`` (start, end in bytes), ``kept`` (remaining bytes).

    The key is a whole number; a null one is the smallest. A null text is an empty one. Rows that share key and text are one document; rows that
    share a key only are ordered by text. Texts shorter than ``length`` keep all. Matches never cross texts. Other columns are not read.
    """
    rows, distinct = _numbered(docs, key, text)
    texts = rows.select("doc", "text")
    gone = stage(removed_windows(texts if distinct else texts.dropDuplicates(["doc"]), length, hot))
    lists = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("gone"))
    both = rows.join(lists, "doc", "left").select(key, "text", "gone")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            lists = batch.column(2)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().fill_null(0).to_numpy())
            begin = offsets[row] + flat.field(0).to_numpy()
            stop = begin + flat.field(1).to_numpy() + (length - 1)
            depth = np.bincount(begin, minlength=len(data) + 1)[:len(data) + 1] - np.bincount(stop, minlength=len(data) + 1)[:len(data) + 1]
            cut = np.cumsum(depth[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(cut)])
            edge = cut.copy()
            edge[1:] &= ~cut[:-1]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            edge[heads] = cut[heads]
            tail = cut.copy()
            tail[:-1] &= ~cut[1:]
            ends = offsets[1:][offsets[1:] > 0] - 1
            tail[ends] = cut[ends]
            start, end = np.flatnonzero(edge), np.flatnonzero(tail) + 1
            border = np.searchsorted(start, offsets)
            owner = offsets[np.repeat(np.arange(len(batch)), np.diff(border))]
            spans = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start - owner), pa.array(end - owner)], ["start", "end"]))
            kept = [data[a:b][~cut[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]]), pa.array(np.diff(border)), spans, pa.array(kept, pa.binary()),
                                              pa.array([hashlib.sha256(x).hexdigest() for x in kept])], names=[key, "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    return both.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string")
