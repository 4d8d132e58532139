import math
from collections import Counter, defaultdict

import pytest
from messy import rows, table
from pyspark.sql import functions as F

from tidemark.llm import mixing, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000])
def test_permutation_is_one_to_one_and_can_be_undone(spark, n):
    got = spark.range(n).select("id", sharding.permute(F.col("id"), n, 5).alias("p")).withColumn("back", sharding.permute(F.col("p"), n, 5, back=True)).collect()
    assert sorted(r["p"] for r in got) == list(range(n))
    assert all(r["back"] == r["id"] for r in got)


def test_seeds_and_rows_are_shuffled(spark):
    got = spark.range(1000).select(sharding.permute(F.col("id"), 1000, 1).alias("a"), sharding.permute(F.col("id"), 1000, 2).alias("b")).collect()
    assert sum(r["a"] == r["b"] for r in got) < 20
    assert sum(r["a"] == i for i, r in enumerate(got)) < 20


def test_shards_are_even_gapless_and_reproducible(spark):
    df = table(spark)
    got = sharding.shard(df, ["doc_id", "text"], 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows())
    assert set(df.columns) <= set(got[0].asDict())
    again = sharding.shard(df.repartition(7), ["doc_id", "text"], 4).collect()
    assert Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in got) == Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in again)
    one = spark.createDataFrame([(r["shard"], r["slot"], r["row_number"]) for r in got], "shard int, slot long, row_number long")
    assert one.filter(sharding.row_at(F.col("shard"), F.col("slot"), len(got), 4) != F.col("row_number")).count() == 0


def test_empty_tables(spark):
    assert sharding.shard(table(spark, []), ["doc_id"], 4).count() == 0
    assert mixing.mix(table(spark, []).withColumn("size", F.lit(1).cast("long"))).count() == 0


def reshared(sizes, weights=(1, 2, 3), most=3):
    """The contract word for word: stop at the cap, reshare the excess by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def test_targets_are_those_of_resharing(spark):
    for sizes in ({"a": 100, "b": 5, "c": 1000, None: 3, "é": 0}, {"a": 1}, {None: 7, "z": 7}, {"a": 0, "b": 0}):
        got = mixing.weighted_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = reshared(sizes)
        assert {r["source"]: pytest.approx(r["target"], abs=1e-6) for r in got} == want


def test_mix_takes_each_class_in_proportion(spark):
    data = [(i, f"s{i % 4}" if i % 9 else None, (i * 7919) % 500) for i in range(2000)]
    df = spark.createDataFrame(data, "doc_id long, source string, size long")
    got = mixing.mix(df).collect()
    assert len(got) == len(data)
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        if r["source_size"]:
            rate = r["target"] / r["source_size"]
            assert math.floor(rate) <= r["copies"] <= math.ceil(rate)
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 500 for s in target)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}
    assert mixing.emit(mixing.mix(df)).count() == sum(r["copies"] for r in got)


def test_mix_of_messy_rows(spark):
    df = table(spark).withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    assert mixing.mix(df).count() == len(rows())


def test_small_cells_do_not_change_the_share(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", 50)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"))
    assert abs(mixing.mix(df).agg(F.sum("taken")).first()[0] - 10000) <= 10
