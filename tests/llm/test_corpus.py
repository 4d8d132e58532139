import os

import duckdb
import pytest
from messy import SCHEMA, rows
from test_dedup import groups, shingles

import __spark_entry__
import corpus_pipeline
from tidemark.llm import toxicity
from tidemark.llm.queries import ORACLES, QUERIES
from tools.check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_every_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


@have
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def check_stages(spark, docs, folder, labels, items, tmp_path):
    """Each stage on its own input, against brute force or what it promises."""
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        given[name], docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sharding":
            assert docs.columns == given[name].columns
    out = {name: spark.read.parquet(f"{tmp_path}/{name}").collect() for name, _ in corpus_pipeline.STAGES}
    model = toxicity.train(given["toxicity"], labels)
    scored = toxicity.tag(given["toxicity"], model).collect()
    assert sorted(str(r["doc_id"]) for r in out["toxicity"]) == sorted(str(r["doc_id"]) for r in scored if r["score"] < 0.3)
    comp = groups([(r["doc_id"], r["text"]) for r in out["toxicity"]])
    assert sorted(r["doc_id"] for r in out["near_dedup"] if r["doc_id"] is not None) == sorted(i for i, c in comp.items() if i == c)
    wanted = [shingles(r["text"]) for r in items.collect()]
    dirty = {str(r["doc_id"]) for r in out["near_dedup"] if any(w and len(w & shingles(r["text"])) >= 0.75 * len(w) for w in wanted)}
    assert sorted(str(r["doc_id"]) for r in out["decontamination"]) == sorted(str(r["doc_id"]) for r in out["near_dedup"] if str(r["doc_id"]) not in dirty)
    assert {str(r["doc_id"]) for r in out["mixing"]} <= {str(r["doc_id"]) for r in out["decontamination"]}
    assert sorted(str(r["doc_id"]) for r in out["sharding"]) == sorted(str(r["doc_id"]) for r in out["mixing"])
    assert len({(r["shard"], r["slot"]) for r in out["sharding"]}) == len(out["mixing"])
    return out


def test_mixing_and_sharding_keep_every_column(spark):
    """Columns with the names that the operators use themselves keep their values and types."""
    own = ["target", "taken", "copies", "source_size", "copy", "row", "key", "words", "size"]
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 9), "en", f"s{i % 3}", i, *[f"{c}{i}" for c in own], f"sh{i}") for i in range(200)],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in own) + ", shard string").repartition(3)
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.schema == docs.schema
    given = {r["doc_id"]: r for r in docs.collect()}
    out = mixed.collect()
    assert out and all(r == given[r["doc_id"]] for r in out)
    dealt = corpus_pipeline.deal_shards(spark, docs, "")
    assert dealt.columns == [*docs.columns[:-1], "shard_given", "row_number", "shard", "slot"]
    assert all(r["shard_given"] == f"sh{r['doc_id']}" and all(r[c] == given[r["doc_id"]][c] for c in docs.columns[:-1]) for r in dealt.collect())


@have
def test_stages_on_driver_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = check_stages(spark, docs, SF, spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"), tmp_path)
    assert 0 < len(out["near_dedup"]) < docs.count() and out["sharding"]
    again = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again.collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in out["sharding"])


@pytest.mark.parametrize("some", [True, False])
def test_stages_on_messy_and_empty_tables(spark, tmp_path, some):
    folder = f"{tmp_path}/in"
    labels = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(rows() if some else [], SCHEMA)
    out = check_stages(spark, docs.drop("shard", "row_number"), folder, labels, items, tmp_path)
    assert bool(out["decontamination"]) == some
