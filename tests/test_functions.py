import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import text as X


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_number_reads_or_gives_null(spark):
    got = one(spark, a=N.number(F.lit("1.5")), b=N.number(F.lit("x")), c=N.number(F.lit("NaN")))
    assert (got.a, got.b, got.c) == (1.5, None, None)


def test_hour_bin_floors_negative_hours(spark):
    got = one(spark, a=N.hour_bin(F.lit(-0.5)), b=N.hour_bin(F.lit(6.0)), c=N.hour_bin(F.lit(5.99)))
    assert (got.a, got.b, got.c) == (-6.0, 6.0, 0.0)


def test_band_is_right_open(spark):
    rows = spark.createDataFrame([(p,) for p in (0.0999, 0.10, 0.1499, 0.15, 0.6, None)], "p double").select(N.band("p").alias("b")).collect()
    assert [r.b for r in rows] == [0, 1, 1, 2, 2, None]


def test_logit_clips_and_keeps_missing(spark):
    got = one(spark, a=N.logit(F.lit(0.5)), b=N.logit(F.lit(1.0), 1e-6), c=N.logit(F.lit(None).cast("double")))
    assert got.a == 0.0 and round(got.b, 3) == 13.816 and got.c is None


def test_recalibration_is_monotone_and_identity_at_0_1(spark):
    got = one(spark, a=N.recalibrate(F.lit(0.3), 0.0, 1.0), b=N.recalibrate(F.lit(0.3), -0.3, 0.8), c=N.recalibrate(F.lit(0.4), -0.3, 0.8))
    assert round(got.a, 12) == 0.3 and got.b < got.c


def test_unknown_condition_is_false(spark):
    got = one(spark, a=N.true_or_false(F.lit(None).cast("double") >= 1), b=N.true_or_false(F.lit(2.0) >= 1))
    assert (got.a, got.b) == (0, 1)


def test_code_stem_stops_at_the_dot(spark):
    got = one(spark, a=X.code_stem(F.lit(" i25.2 ")), b=X.code_stem(F.lit("I252")), c=X.code_stem(F.lit("252")))
    assert (got.a, got.b, got.c) == ("I25", "I252", "")


def test_matching_modes(spark):
    pairs = [("norepinephrine", "norepi"), ("epinephrine", "epi"), ("propofol", "prop")]
    got = one(spark, a=X.first_match(F.lit("NorEpinephrine drip"), pairs), b=X.every_match(F.lit("NorEpinephrine drip"), pairs), c=X.first_match(F.lit("saline"), pairs))
    assert got.a == "norepi" and got.b == ["norepi", "epi"] and got.c is None


def test_ordinal_score(spark):
    table = {"oriented": 5, "intubated": None}
    rows = spark.createDataFrame([(v,) for v in ("oriented", "intubated", "4-->x", "3", "9", "junk", None)], "v string")
    got = rows.select(X.ordinal_score("v", table).alias("s"), X.ordinal_unmapped("v", table).alias("u")).collect()
    assert [r.s for r in got] == [5.0, None, 4.0, 3.0, None, None, None]
    assert [r.u for r in got] == [False, False, False, False, False, True, False]


def test_age_and_year(spark):
    got = one(spark, a=X.age_years(F.lit("> 89")), b=X.age_years(F.lit("> 89"), cap_value=89), c=X.calendar_year(F.lit("2011 - 2013"), F.lit(2185), F.lit(2180)),
              d=X.calendar_year(F.lit("2011 - 2014"), F.lit(2180), F.lit(2180)))
    assert (got.a, got.b, got.c, got.d) == (90.0, 89.0, 2017, 2012)


def test_defaults_have_one_row(spark):
    from tidemark.operators import cleaning as C

    df = spark.createDataFrame([(1, None), (2, 3.0)], "id long, x double")
    one = spark.createDataFrame([(5.0,)], "x double")
    assert sorted(r["x"] for r in C.fill_from(df, one, ["x"]).collect()) == [3.0, 5.0]
    with pytest.raises(Exception, match="more than one row"):
        C.fill_from(df, one.union(one), ["x"]).collect()


def test_a_session_of_many_processes_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidemark.session import shared_folder

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
        assert shared_folder(session(master, "hdfs:///shared")) == "hdfs:///shared"
    assert shared_folder(session("local[8]"))
