"""Replicate kernels, left-out layers, exact halves and hourly slices against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.numeric import draw_hash, hash32, poisson_count
from tidemark.operators import bootstrap as B
from tidemark.operators import calibration as C
from tidemark.operators import resampled as P
from tidemark.operators import sampling as L
from tidemark.operators import timeline as T

R = 40
SCHEMA = "entity string, g string, bin int, y int, p double"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(7)
    out = []
    for i in range(400):
        # one score holds a third of all rows, one group has one class only
        p = 0.3 if r.random() < 0.33 else round(float(r.uniform(0.05, 0.9)), 2)
        g = str(r.choice(["a", "b", "c"]))
        out.append((f"e{r.integers(0, 90)}", g, int(r.integers(0, 4)), 0 if g == "c" else int(r.random() < p), p))
    return out + [("e1", "a", 0, None, 0.5), ("e2", "b", 1, 1, None), ("e3", "b", 1, 1, float("nan"))]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def weights(spark, rows):
    """Multiplicities by the column expressions, which every kernel has to agree with."""
    units = spark.createDataFrame(sorted({(x[0],) for x in rows}), "entity string")
    drawn = units.select("entity", F.explode(F.sequence(F.lit(1), F.lit(R)).cast("array<bigint>")).alias("b")).withColumn("w", poisson_count(draw_hash(B.draw_base(["entity"], 42), F.col("b"))))
    return {(x["entity"], x["b"]): x["w"] for x in drawn.collect()}


def known(rows, g=None):
    return [x for x in rows if x[3] is not None and x[4] is not None and not math.isnan(x[4]) and g in (None, x[1])]


def area(pairs):
    """Pairs (weight, y, p): weighted AUROC and average precision by comparing scores."""
    np_, nn = sum(w for w, y, _ in pairs if y), sum(w for w, y, _ in pairs if not y)
    if not np_ or not nn:
        return np_, nn, None, None
    pos, neg = [x for x in pairs if x[1]], [x for x in pairs if not x[1]]
    auc = sum(w * v * ((p > q) + (p == q) / 2) for w, _, p in pos for v, _, q in neg) / (np_ * nn)
    ap = 0.0
    for s in {p for *_, p in pairs}:
        tp, fp = sum(w for w, _, p in pos if p >= s), sum(w for w, _, p in neg if p >= s)
        ap += sum(w for w, _, p in pos if p == s) / np_ * (tp / (tp + fp) if tp + fp else 0)
    return np_, nn, auc, ap


@pytest.mark.parametrize("points,block", [(None, 25_000), ([0.2, 0.3, 0.5], 30), ([0.3], 7)])
def test_discrimination_of_every_replicate(df, rows, weights, monkeypatch, points, block):
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", block)
    got = {(x["g"], x["replicate"]): x for x in B.bootstrap_discrimination(df, ["entity"], replicates=R, by=["g"], points=points).collect()}
    plain = {(x["g"], x["replicate"]): x["auroc"] for x in B.bootstrap_auroc(df, ["entity"], replicates=R, by=["g"], points=points).collect()}
    assert len(got) == 3 * R
    for (g, b), x in got.items():
        np_, nn, auc, ap = area([(weights[e, b], y, p) for e, _, _, y, p in known(rows, g)])
        assert (x["n_pos"], x["n_neg"]) == (np_, nn)
        for mine, want in ((x["auroc"], auc), (plain[g, b], auc), (x["auprc"], ap)):
            assert mine is None if want is None else mine == pytest.approx(want, abs=1e-12)


def test_tied_scores_make_more_blocks_not_larger_ones(df, rows, monkeypatch):
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", 10)
    sizes = B.score_blocks(df, ["entity"], points=[0.3]).groupBy(B.PIECE, "_chunk").count().filter(B.single()).collect()
    tied = sum(x[4] == 0.3 for x in known(rows))
    assert sum(x["count"] for x in sizes) == tied and len(sizes) >= tied / 20 and max(x["count"] for x in sizes) < tied / 3


def test_areas_by_stratum(df, rows, weights, monkeypatch):
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", 20)
    got = {(x["g"], x["replicate"], x["bin"]): x for x in B.bootstrap_areas(df, ["entity"], "bin", [0, 1, 2, 3], replicates=R, by=["g"], points=[0.2, 0.3, 0.6]).collect()}
    assert len(got) == 3 * R * 4
    for (g, b, k), x in got.items():
        mine = known(rows, g)
        pos = [(weights[e, b], p) for e, _, q, y, p in mine if y and q == k]
        neg = [(weights[e, b], p) for e, _, _, y, p in mine if not y]
        assert x["n_pos"] == sum(w for w, _ in pos) and x["n_neg"] == sum(w for w, _ in neg)
        assert x["area"] == pytest.approx(sum(w * v * ((p > q) + (p == q) / 2) for w, p in pos for v, q in neg), abs=1e-8)


@pytest.mark.parametrize("points,block", [(None, 25_000), ([0.2, 0.3, 0.5], 30)])
def test_calibration_of_every_replicate(df, rows, weights, monkeypatch, points, block):
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", block)
    got = P.calibration_replicates(df, ["entity"], R, -0.2, 0.7, points=points).collect()
    assert len(got) == 2 * R
    for x in got:
        data = [(weights[e, x["replicate"]], y, p if x["version"] == "raw" else 1 / (1 + math.exp(0.2 - 0.7 * math.log(p / (1 - p))))) for e, _, _, y, p in known(rows)]
        w, y, p = (np.repeat([d[i] for d in data], [d[0] for d in data]) for i in (0, 1, 2))
        assert x["n"] == len(y) and x["brier"] == pytest.approx(((p - y) ** 2).mean()) and x["prevalence"] == pytest.approx(y.mean())
        edges = np.unique(np.quantile(p, np.arange(11) / 10))
        at = np.maximum(np.searchsorted(edges, p, "left") - 1, 0)
        ece = sum((at == k).mean() * abs(y[at == k].mean() - p[at == k].mean()) for k in set(at))
        assert x["ece"] == pytest.approx(ece, abs=1e-9), x
        z, a, b = np.log(p / (1 - p)), math.log(y.mean() / (1 - y.mean())), 0.0
        for _ in range(12):
            mu = 1 / (1 + np.exp(-(a + b * z)))
            h = mu * (1 - mu)
            step = np.linalg.solve([[h.sum(), (h * z).sum()], [(h * z).sum(), (h * z * z).sum()]], [(y - mu).sum(), ((y - mu) * z).sum()])
            a, b = a + step[0], b + step[1]
        assert x["slope"] == pytest.approx(b, abs=1e-7)


def test_replicates_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert B.bootstrap_discrimination(none, ["entity"], replicates=3).collect() == []
    assert B.bootstrap_areas(none, ["entity"], "bin", [0, 1], replicates=3).collect() == []
    assert P.calibration_replicates(none, ["entity"], 3, 0.0, 1.0).collect() == []
    assert C.held_out_layers(none, "g").collect() == [] and L.exact_halves(none, ["entity"], 2).collect() == []


@pytest.mark.parametrize("rate", [None, 0.0, 0.6, 0.99])
def test_exact_draws_have_the_size_of_the_table(spark, rows, rate):
    units = sorted({x[0] for x in rows})
    df = spark.createDataFrame([(u, 1, 0.5) for u in units], "entity string, y int, p double").repartition(3)
    draws = B.exact_draws(df, ["entity"], 200, rate=rate)
    got = {x["replicate"]: x["n_pos"] for x in B.bootstrap_auroc(df, ["entity"], replicates=200, draws=draws).collect()}
    assert len(got) == 200 and set(got.values()) == {len(units)}
    # counts of one unit behave like draws with replacement: mean 1, variance 1 - 1/n
    each = df.join(draws.extras, "entity", "left").select("entity", B.draw_base(["entity"], 42).alias("_base"), "_extra").toPandas()
    total = np.concatenate([w for _, _, w in B.multiplicities(each, 200, (draws.cuts, draws.streams))], axis=1)
    assert total.sum(0).tolist() == [len(units)] * 200 and abs(total.var() - (1 - 1 / len(units))) < 0.05


def test_cuts_of_rate_one_are_the_fixed_ones():
    assert B.poisson_cuts(1.0)[:len(B.POISSON_CUTS)] == pytest.approx(B.POISSON_CUTS, abs=1)


def layer(rows):
    z = np.log([p / (1 - p) for *_, p in rows])
    y = np.array([x[3] for x in rows], float)
    a, b = math.log(y.mean() / (1 - y.mean())), 0.0
    for _ in range(12):
        mu = 1 / (1 + np.exp(-(a + b * z)))
        h = mu * (1 - mu)
        step = np.linalg.solve([[h.sum(), (h * z).sum()], [(h * z).sum(), (h * z * z).sum()]], [(y - mu).sum(), ((y - mu) * z).sum()])
        a, b = a + step[0], b + step[1]
    return a, b


def test_left_out_layers_by_group(df, rows):
    got = {(x["g"], x["bin"]): x for x in C.held_out_layers(df.filter("g <> 'c'"), "bin", by=["g"]).collect()}
    assert len(got) == 8
    for (g, k), x in got.items():
        others = [r for r in known(rows, g) if r[2] != k]
        assert x["n_rows"] == len(others) and x["n_pos"] == sum(r[3] for r in others)
        assert (x["a"], x["b"]) == pytest.approx(layer(others), abs=1e-8)
    # a group with one class has layers without parameters
    assert all(x["a"] is None and x["b"] is None for x in C.held_out_layers(df.filter("g = 'c'"), "bin").collect())


def test_evaluation_of_left_out_layers(df, rows):
    least = 25
    out = {x["bin"]: x for x in C.leave_out_evaluation(df.withColumn("p_tr", F.col("p") * 0.5), "bin", least_pos=least).collect()}
    sized = {k: [r for r in known(rows) if r[2] == k] for k in range(4)}
    assert set(out) == {k for k, v in sized.items() if sum(r[3] for r in v) >= least} and out
    for k, x in out.items():
        a, b = layer([r for r in known(rows) if r[2] != k])
        local = [(*r[:4], 1 / (1 + math.exp(-(a + b * math.log(r[4] / (1 - r[4])))))) for r in sized[k]]
        moved = [(*r[:4], r[4] * 0.5) for r in sized[k]]
        assert (x["n"], x["n_pos"], x["b"]) == (len(local), sum(r[3] for r in local), pytest.approx(b, abs=1e-7))
        assert x["slope_local"] == pytest.approx(layer(local)[1], abs=1e-6) and x["slope_transported"] == pytest.approx(layer(moved)[1], abs=1e-6)
    summary = C.leave_out_summary(C.leave_out_evaluation(df.withColumn("p_tr", F.col("p") * 0.5), "bin", least_pos=least)).first()
    assert summary["n_sites"] == len(out) and summary["slope_local_median"] == pytest.approx(float(np.median([x["slope_local"] for x in out.values()])))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300])
def test_halves_are_exact_and_differ(spark, n):
    df = spark.createDataFrame([(i, i % 3) for i in range(n)], "k int, x int").repartition(3)
    got = L.exact_halves(df, ["k"], 6).collect()
    sides = {b: {x["k"] for x in got if x["repeat"] == b and x["half"] == 0} for b in range(1, 7)}
    assert len(got) == 6 * n and all(len(s) == n // 2 for s in sides.values())
    assert n < 7 or len({frozenset(s) for s in sides.values()}) > 1


def test_hourly_slices_against_a_loop(spark):
    r = np.random.default_rng(2)
    series = [(int(r.integers(0, 4)), str(r.choice(["u", "v", "w"])), float(r.uniform(-5, 130)), float(r.integers(0, 9))) for _ in range(500)] + [(1, "u", 3.0, None)]
    points = [(e, t) for e in range(5) for t in (0.0, 1.0, 23.0, 24.0, 47.5, 49.0, 100.0)]
    got = T.hourly_slices(spark.createDataFrame(points, "e int, t_hr double"), spark.createDataFrame(series, "e int, fam string, hr double, val double"), ["e"], ["u", "v"], back=30, summed=["v"]).collect()
    assert len(got) == len(points)
    for x in got:
        for i, f in enumerate(("u", "v")):
            for k in range(30):
                hour = int(x["t_hr"]) - 30 + k
                cell = [(h, v) for e, g, h, v in series if (e, g) == (x["e"], f) and v is not None and math.floor(h) == hour]
                want = None if not cell else (sum(v for _, v in cell) if f == "v" else max(cell)[1])
                assert x["mask"][i][k] == int(want is not None) and x["values"][i][k] == pytest.approx(want or 0.0)


def test_given_points_leave_no_block_that_grows_with_the_table(spark, monkeypatch):
    rows = spark.range(4000).select(F.col("id").alias("entity"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.hash("id") / 4294967296.0 + 0.5).alias("p"))
    assert B.enough_points(rows, "y", "p", [0.5]) == [0.5]  # fewer rows than a block may have
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", 200)
    cut = B.score_blocks(rows, ["entity"], points=B.enough_points(rows, "y", "p", [0.5]))
    assert max(r["count"] for r in cut.groupBy("_piece", "_chunk").count().collect()) < 400


def test_further_draws_are_packed_counts(spark):
    df = spark.range(0, 900, 1, 3).selectExpr("cast(id as string) AS entity")
    draws = B.exact_draws(df, ["entity"], 130, rate=0.3)
    placed = {r["entity"]: r["_position"] for r in L.unit_positions(df, ["entity"], 42).collect()}
    packed = {r["entity"]: bytes(r["_extra"]) for r in draws.extras.collect()}
    assert max(map(len, packed.values())) < 400  # 91 draws a unit: as a list of numbers 728 bytes or more
    base = np.array([r["_base"] for r in df.select(B.draw_base(["entity"], 42).alias("_base")).collect()])
    missing = 900 - B._poisson_matrix(base, draws.streams, draws.cuts).sum(0).astype(int)
    rows = spark.createDataFrame([(i, int(s), slot) for i, (s, m) in enumerate(zip(draws.streams, missing)) for slot in range(1, m + 1)], "at int, stream long, slot long")
    want = np.zeros((900, 130), int)
    for r in rows.select("at", F.floor(B.draw_hash(F.col("slot"), F.col("stream")) / F.lit(4294967296.0) * 900).alias("position")).collect():
        want[r["position"], r["at"]] += 1
    for entity, position in placed.items():
        assert (B._extra_counts([packed.get(entity)], 130)[0] == want[position]).all()


def test_few_scores_are_summed_without_blocks(spark):
    rows = [(f"e{i % 90}", None if i % 5 == 0 else i % 2, i % 3 - 1, i % 7 // 4, (i * 7 % 11) / 11) for i in range(900)]
    df = spark.createDataFrame(rows, "entity string, g int, bin int, y int, p double").repartition(4)
    assert B._few_scores(df, ["g", "y", "p"], 70)
    by_score = {(r["g"], r["replicate"]): tuple(r) for r in B.bootstrap_auroc(df, replicates=70, by=["g"]).collect()}
    blocks = {(r["g"], r["replicate"]): tuple(r) for r in B.bootstrap_auroc(df, replicates=70, by=["g"], points=[0.2, 0.5]).collect()}
    assert by_score.keys() == blocks.keys() and all(by_score[k] == pytest.approx(blocks[k]) for k in blocks if k[0] is not None)
    assert all(by_score[k][1:] == pytest.approx(blocks[k][1:]) for k in blocks)
    areas = [{(r["g"], r["replicate"], r["bin"]): tuple(r)[3:] for r in B.bootstrap_areas(df, ["entity"], "bin", [0, 1], replicates=70, by=["g"], points=points).collect()} for points in (None, [0.2, 0.5])]
    assert areas[0].keys() == areas[1].keys() and all(areas[0][k] == pytest.approx(areas[1][k]) for k in areas[0])


def test_border_of_a_half_is_looked_for_in_a_band(spark, monkeypatch):
    df = spark.range(0, 5000, 1, 3).selectExpr("id AS k", "id / 7 AS t")
    units = df.select("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("repeat"), *[hash32("k", "t", "repeat", seed=s).alias(c) for s, c in ((42, "h"), (42 + L.TIE, "g"))]).collect()
    want = {b: {x["k"] for x in sorted((x for x in units if x["repeat"] == b), key=lambda x: (x["h"], x["g"]))[:2500]} for b in (1, 2, 3)}
    listed = []
    keep = L.stage
    for band in (4, 0):  # the second band is too narrow at first and is widened
        monkeypatch.setattr(L, "BAND", band)
        monkeypatch.setattr(L, "stage", lambda rows: listed.append(keep(rows)) or listed[-1])
        got = L.exact_halves(df, ["k", "t"], 3).filter("half = 0").collect()
        assert {b: {x["k"] for x in got if x["repeat"] == b} for b in (1, 2, 3)} == want
        assert listed[0].count() < 3 * 1000


def test_calibration_of_few_scores_needs_no_blocks(spark, monkeypatch):
    rows = [(f"e{i % 90}", None if i % 50 == 0 else int(i * 13 % 7 < 3), float("nan") if i % 60 == 1 else (i * 7 % 11 + 1) / 13) for i in range(900)]
    df = spark.createDataFrame(rows, "entity string, y int, p double").repartition(4)
    blocks = {(r["replicate"], r["version"]): tuple(r)[2:] for r in P.calibration_replicates(df, ["entity"], 70, -0.2, 0.7, points=[0.2, 0.5]).collect()}
    monkeypatch.setattr(P, "score_blocks", None)
    got = {(r["replicate"], r["version"]): tuple(r)[2:] for r in P.calibration_replicates(df, ["entity"], 70, -0.2, 0.7).collect()}
    assert len(got) == 140 and got.keys() == blocks.keys() and all(got[k] == pytest.approx(blocks[k], abs=1e-9) for k in got)


def test_calibration_of_a_single_class_has_no_slope(spark):
    df = spark.createDataFrame([(f"e{i % 9}", 1, 0.3 + i % 2 / 10) for i in range(90)], "entity string, y int, p double")
    got = P.calibration_replicates(df, ["entity"], 5, -0.2, 0.7).collect()
    assert len(got) == 10 and all(r["slope"] is None and r["n"] > 0 and r["ece"] is not None for r in got)


def test_calibration_of_few_scores_takes_no_blocks_under_given_cuts(spark, monkeypatch):
    rows = [(f"e{i % 90}", None if i % 50 == 0 else int(i * 13 % 7 < 3), (i * 7 % 11 + 1) / 13) for i in range(900)]
    df = spark.createDataFrame(rows, "entity string, y int, p double").repartition(4)
    with monkeypatch.context() as m:
        m.setattr(P, "_few_scores", lambda *args: False)
        blocks = {(r["replicate"], r["version"]): tuple(r)[2:] for r in P.calibration_replicates(df, ["entity"], 70, -0.2, 0.7, points=[0.2, 0.5]).collect()}
    monkeypatch.setattr(P, "score_blocks", None)
    got = {(r["replicate"], r["version"]): tuple(r)[2:] for r in P.calibration_replicates(df, ["entity"], 70, -0.2, 0.7, points=[0.2, 0.5]).collect()}
    assert len(got) == 140 and got.keys() == blocks.keys() and all(got[k] == pytest.approx(blocks[k], abs=1e-9) for k in got)
