"""Line dedup by pairwise alignment.

Two documents overlap if they share a window: a shortest run of lines with as many bytes as a block needs. Every block that a document shares with any earlier one is
made up of windows. Each window points from every document that holds it to the first one (smallest key), so there are at most as many pairs as shared windows, never all
pairs, and windows that very many texts hold count like any other. Each pair is aligned by patience diff, by lines and then by windows until nothing common is left, and the aligned
common blocks are deleted from the later document. A block that several documents share stays in the first of them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.decontaminate import BROADCAST_ROWS
from tidemark.session import stage


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions of equal entries, rising on both sides, as patience diff finds them."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, x, j, y = todo.pop()
        while i < x and j < y and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < x and j < y and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
            out.append((x, y))
        if i == x or j == y:
            continue
        in_a, in_b = Counter(a[i:x]), Counter(b[j:y])
        once = {a[p]: p for p in range(i, x) if in_a[a[p]] == 1}
        both = [(once[b[q]], q) for q in range(j, y) if in_b[b[q]] == 1 and b[q] in once]
        tails, at, back = [], [], [-1] * len(both)
        for n, (p, _) in enumerate(both):
            k = bisect_left(tails, p)
            tails[k:k + 1], at[k:k + 1] = [p], [n]
            back[n] = at[k - 1] if k else -1
        chain, n = [], at[-1] if at else -1
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        if not chain:
            continue
        for p, q in [*reversed(chain), (x, y)]:  # what lies between two anchors is aligned on its own, beginning with the first of them
            todo.append((i, p, j, q))
            i, j = p, q
    return sorted(set(out))


def shared_windows(a: list, b: list, size: list[int], least: int, gone: np.ndarray) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Windows of ``b`` that stand in ``a`` too and are not gone as a whole, each with its first place on both sides: their numbers in the order of ``a`` and of ``b``; first line and end in ``b`` by number."""
    number = {x: n for n, x in enumerate(dict.fromkeys(a), 1)}
    there = np.array([number.get(x, 0) for x in b], np.uint64)
    start, end = windows(np.array(size, np.int64), np.array([0, len(b)]), least)
    lost, cut = (np.concatenate([[0], np.cumsum(x)]) for x in (there == 0, gone))
    open_ = (lost[end] == lost[start]) & (cut[end] - cut[start] < end - start)
    start, end = start[open_], end[open_]
    one, two = W.mix(np.array([number[x] for x in a], np.uint64)), W.mix(there)
    units = []
    for n in np.unique(end - start):
        at, first = np.unique(start[end - start == n]), np.arange(max(0, len(a) - n + 1))
        known, place = np.unique(W.range_hashes(one, first, first + n), return_index=True)
        mine, q = np.unique(W.range_hashes(two, at, at + n), return_index=True)
        found = np.isin(mine, known)
        units += [(int(first[p]), int(at[i]), int(at[i] + n)) for p, i in zip(place[np.searchsorted(known, mine[found])], q[found], strict=True)]
    in_a, in_b = (sorted(range(len(units)), key=lambda u, side=side: (units[u][side], units[u][2])) for side in (0, 1))
    return in_a, in_b, np.array([u[1] for u in units], np.int64), np.array([u[2] for u in units], np.int64)


def common_blocks(a: list, b: list, size: list[int], least: int) -> list[int]:
    """Positions in ``b`` of common blocks (runs that are consecutive on both sides) of ``least`` bytes or more, in whatever order and however often they stand there.

    Lines are aligned first. What that leaves, passages in another order or several times, is aligned again with windows as units, until no window of ``b`` that ``a`` has
    is left; every such alignment takes one window at least.
    """
    gone, run, pairs = np.zeros(len(b), bool), [], aligned(a, b)
    for n, (p, q) in enumerate(pairs):
        if run and (p, q) != (pairs[n - 1][0] + 1, pairs[n - 1][1] + 1):
            gone[run] = sum(size[x] for x in run) >= least
            run = []
        run.append(q)
    if run:
        gone[run] = sum(size[x] for x in run) >= least
    while not gone.all():
        in_a, in_b, start, end = shared_windows(a, b, size, least, gone)
        chain = aligned(in_a, in_b)
        if not chain:
            break
        for _, q in chain:
            gone[start[in_b[q]]:end[in_b[q]]] = True
    return np.flatnonzero(gone).tolist()


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """__key, two hashes of the text, hashes of its lines (0 for a line without words) and their bytes."""
    body = F.coalesce(F.col(text), F.lit(""))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.pieces(*W.text_bytes(batch.column(3))):
                breaks = np.flatnonzero(data == 10)
                start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
                end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
                border = np.concatenate([[0], np.cumsum(1 + np.diff(np.searchsorted(breaks, offsets)))]).astype(np.int32)
                filled = np.concatenate([[0], np.cumsum(~W.SPACE[data])])
                h = np.where(filled[end] > filled[start], W.span_hashes(data, start, end), np.uint64(0)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(3)], pa.ListArray.from_arrays(pa.array(border), pa.array(h)), pa.ListArray.from_arrays(pa.array(border), pa.array((end - start).astype(np.int32)))],
                                                 names=["__key", "__a", "__b", "__lines", "__sizes"])

    return docs.select(F.col(key), F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"), body.alias("t")).mapInArrow(run, f"__key {kind}, __a long, __b long, __lines array<long>, __sizes array<int>")


def windows(size: np.ndarray, border: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and end of the shortest runs of ``least`` bytes from each line on and up to each line, within texts: at most two a line.

    Any run of ``least`` bytes is made up of such runs: a line of it lies in the one from the run's first line or from itself on, or else in the one up to the run's last line.
    """
    total, n = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), len(size)
    doc = np.repeat(np.arange(len(border) - 1), np.diff(border))
    line = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + least, "left"), line + 1)
    start = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, line)
    on, back = end <= border[doc + 1], start >= border[doc]
    return np.concatenate([line[on], start[back]]), np.concatenate([end[on], line[back] + 1])


def units(nodes: DataFrame, least: int) -> DataFrame:
    """(__node, __unit): hashes of the windows of each text that have a line with words, once with lines without words as equal and empty, once as they measure."""
    kind = nodes.schema["__node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            border = batch.column(1).offsets.to_numpy().astype(np.int64)
            lines, size = (batch.column(i).values.to_numpy()[border[0]:border[-1]] for i in (1, 2))
            border = border - border[0]
            filled, docs, found = np.concatenate([[0], np.cumsum(lines != 0)]), [], []
            for values, bytes_ in ((lines, np.where(lines == 0, 0, size)), (np.where(lines == 0, size, lines), size)):
                start, end = windows(bytes_, border, least)
                some = filled[end] > filled[start]
                docs.append(np.searchsorted(border, start[some], "right") - 1)
                found.append(W.range_hashes(values.view(np.uint64), start[some], end[some]))
            doc, unit = np.concatenate(docs), np.concatenate(found)
            order = np.lexsort((unit, doc))
            doc, unit = doc[order], unit[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (unit[1:] != unit[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[new])), pa.array(unit[new].view(np.int64))], names=["__node", "__unit"])

    return nodes.select("__node", "__lines", "__sizes").mapInArrow(run, f"__node {kind}, __unit long")


def overlaps(nodes: DataFrame, least: int) -> DataFrame:
    """Pairs (__u, __v) of an earlier and a later text: the first text that holds a window, and each other one that holds it, however many they are."""
    held = units(nodes, least)
    spread = held.groupBy("__unit").agg(F.min("__node").alias("__u"), F.count(F.lit(1)).alias("__texts")).filter("__texts > 1").drop("__texts")
    return held.join(spread, "__unit").filter(F.col("__u") != F.col("__node")).select("__u", F.col("__node").alias("__v")).distinct()


def removals(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Per later text: the lines to delete and the earlier texts that have them."""
    light = nodes.select("__node", "__lines", "__sizes")
    both = pairs.join(light.select(F.col("__node").alias("__u"), F.col("__lines").alias("__one")), "__u").join(light.withColumnRenamed("__node", "__v"), "__v")
    kind = nodes.schema["__node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [common_blocks(a, b, s, least) for a, b, s in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.list_(pa.int32()))], names=["__u", "__v", "__cut"])

    cut = both.select("__u", "__v", "__one", "__lines", "__sizes").mapInArrow(run, f"__u {kind}, __v {kind}, __cut array<int>").filter(F.size("__cut") > 0)
    return cut.groupBy(F.col("__v").alias("__node")).agg(F.array_distinct(F.flatten(F.collect_list("__cut"))).alias("__cut"), F.sort_array(F.collect_set("__u")).alias("__from"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 100) -> DataFrame:
    """One row per input row: key, cleaned ``text`` (under its own name), ``n_lines``, ``n_removed``, ``partners`` (keys of earlier documents with deleted blocks).

    Lines are parts between line feeds; a null text is an empty one, and an empty text has one empty line. A document whose text equals that of a smaller
    key loses everything. Rows that share key and text are one document; rows that share a key only are judged text by text. A document without
    key is left as it is, and nothing is deleted because of it. Lines without words are equal to each other and never make a pair on
    their own: a block whose bytes reach ``least`` only with them is looked for where they have the same lengths. No window is too frequent to
    count. Columns other than key and text are not read.
    """
    rows = stage(line_rows(docs, key, text))
    known = rows.filter(F.col("__key").isNotNull())
    nodes = stage(known.groupBy("__a", "__b").agg(F.min("__key").alias("__first"), F.first("__lines").alias("__lines"), F.first("__sizes").alias("__sizes"))
                  .withColumn("__node", F.struct(F.col("__first").alias("key"), "__a", "__b")))
    cut = removals(overlaps(nodes, least), nodes, least)
    texts = nodes.select("__a", "__b", "__first", "__node").join(cut, "__node", "left").select("__a", "__b", "__first", "__cut", F.transform("__from", lambda x: x["key"]).alias("__from"))
    whole = F.col("__key") != F.col("__first")
    changed = known.select("__key", "__a", "__b", F.size("__lines").alias("__n")).filter(F.col("__n") > 0).distinct().join(texts, ["__a", "__b"]).filter(whole | F.col("__cut").isNotNull())
    changed = stage(changed.select(F.col("__key").alias("__k"), "__a", "__b", whole.alias("__whole"), F.when(~whole, F.col("__cut")).alias("__cut"), F.when(whole, F.array("__first")).otherwise(F.col("__from")).alias("partners")))
    changed = F.broadcast(changed) if changed.count() <= BROADCAST_ROWS // 5 else changed

    body = F.coalesce(F.col(text), F.lit(""))
    at = docs.select(F.col(key), body.alias(text), F.xxhash64(body).alias("__a1"), F.xxhash64(F.lit(1), body).alias("__b1"))
    both = at.join(changed, (at[key] == changed["__k"]) & (F.col("__a1") == F.col("__a")) & (F.col("__b1") == F.col("__b")), "left")
    lines = F.split(at[text], "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__cut"))
    cleaned = F.when(F.col("__whole"), "").when(F.col("__cut").isNotNull(), F.array_join(F.transform(left, lambda i: lines[i]), "\n")).otherwise(at[text])
    gone = F.when(F.col("__whole"), F.size(lines)).otherwise(F.coalesce(F.size("__cut"), F.lit(0)))
    return both.select(at[key], cleaned.alias(text), F.size(lines).cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"),
                       F.coalesce("partners", F.array().cast(f"array<{docs.schema[key].dataType.simpleString()}>")).alias("partners"))
