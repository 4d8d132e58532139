"""Queries for sources, sinks, projections, filters and row-level cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import text as X
from tidemark.operators import cleaning as C
from tidemark.operators import cohort as H
from tidemark.operators import models as M
from tidemark.operators import quality as Q
from tidemark.plans.fixtures import FAMILIES, LAYER, predictions, r, rounded, scratch, series, stays, table, with_ctes
from tidemark.plans.registry import query
from tidemark.sources import readers as R
from tidemark.sources import writers as W

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("S1_text_scan", f"SELECT o_orderstatus, count(*) AS n, {r('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY 1")
def text_scan(spark, sf):
    path = scratch(spark, "orders-csv")
    W.write_csv(table(spark, sf, "orders").select(*ORDER_COLUMNS), path)
    raw = R.read_text_table(spark, path, ORDER_COLUMNS)
    return rounded(raw.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(N.number("o_totalprice")).alias("total")), 2)


@query("S2_typed_gzip_scan", f"SELECT c_nationkey, count(*) AS n, {r('max(c_acctbal)')} AS top FROM customer GROUP BY 1")
def gzip_scan(spark, sf):
    path = scratch(spark, "customer-csv")
    table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal").write.option("header", True).option("compression", "gzip").csv(path)
    df = R.read_typed_csv(spark, path, {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"}, spread_by="c_custkey")
    return rounded(df.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("top")))


@query("S3_column_list_scan", "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def column_list(spark, sf):
    path = scratch(spark, "orders-csv")
    W.write_csv(table(spark, sf, "orders").select(*ORDER_COLUMNS), path)
    df = R.read_text_table(spark, path, ORDER_COLUMNS, select=["o_custkey", "o_orderpriority", "o_orderstatus"])
    return df.filter("o_orderstatus = 'F'").select(N.number("o_custkey").cast("bigint").alias("o_custkey"), "o_orderpriority")


@query("S4_parquet_columns", "SELECT l_returnflag, max(l_tax) AS top FROM lineitem WHERE l_quantity > 45 GROUP BY 1")
def parquet_scan(spark, sf):
    df = R.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_tax", "l_quantity"])
    return df.filter("l_quantity > 45").groupBy("l_returnflag").agg(F.max("l_tax").alias("top"))


_CUSTOMER = ("c_acctbal", "c_mktsegment", "c_name", "c_nationkey")


@query("S5_schema_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) / count(*)::DOUBLE')} AS share FROM customer" for c in _CUSTOMER))
def schema_columns(spark, sf):
    """Candidate columns come from the file footers; each is then audited over the whole table."""
    names = R.parquet_columns(spark, f"{sf}/customer.parquet", exclude=["c_custkey"])
    return rounded(C.missing_shares(table(spark, sf, "customer"), names))


@query("S6_parquet_sink", with_ctes("SELECT fam, count(*) AS n, max(val) AS top FROM series GROUP BY 1", "series"))
def parquet_sink(spark, sf):
    path = scratch(spark, "series")
    W.write_parquet(series(spark, sf), path, partition_by=["fam"])
    return R.read_parquet(spark, path).groupBy("fam").agg(F.count("*").alias("n"), F.max("val").alias("top"))


@query("S7_csv_sink", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def csv_sink(spark, sf):
    path = scratch(spark, "customer-csv")
    W.write_csv(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path)
    return R.read_typed_csv(spark, path, {"c_custkey": "bigint", "c_mktsegment": "string", "c_acctbal": "double"})


@query("S8_report_json", "SELECT o_orderstatus AS cohort, CAST(count(*) AS DOUBLE) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1")
def report_json(spark, sf):
    path = scratch(spark, "report")
    per = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("cohort")).agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("top"))
    W.write_json(W.nest_report(Q.long_metrics(per, ["n", "top"], ["cohort"]), "cohort"), path)
    back = R.read_metrics(spark, path, "cohort string, metrics map<string,double>")
    return back.select("cohort", F.col("metrics.n").alias("n"), F.col("metrics.top").alias("top"))


@query("S9_extract_with_counts", with_ctes("SELECT 'purchases' AS name, count(*) AS \"rows\", count(DISTINCT entity) AS entities FROM series WHERE fam = 'purchase'", "series"))
def extract_counts(spark, sf):
    facts = W.extract(series(spark, sf).filter("fam = 'purchase'"), scratch(spark, "purchases"), "purchases", "entity")
    return C.small_table(spark, [(facts["name"], facts["rows"], facts["entities"])], "name string, rows bigint, entities bigint")


@query("S10_table_fingerprint", """
    SELECT count(*) AS "rows", bit_xor(d) AS xor_digest, CAST(sum(d) AS BIGINT) AS sum_digest FROM (
      SELECT ('0x' || substr(md5(concat_ws('|', coalesce(l_linestatus, '~'), coalesce(CAST(l_orderkey AS VARCHAR), '~'), coalesce(CAST(l_partkey AS VARCHAR), '~'),
        coalesce(l_returnflag, '~'))), 1, 8))::BIGINT AS d FROM lineitem)""")
def table_fingerprint(spark, sf):
    return Q.fingerprint(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag", "l_linestatus"])


@query("S10_file_fingerprints")
def file_fingerprint(spark, sf):
    return R.file_fingerprints(spark, sf, "*.parquet")


PART_FLAGS = {"f_promo": ["PROMO"], "f_small": ["SMALL", "MEDIUM"], "f_economy": ["ECONOMY"]}
TAGS = [("f_promo", "promo"), ("f_economy", "economy"), ("f_small", "small")]


def order_parts(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return li.join(table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_name"), F.col("l_partkey") == F.col("p_partkey"))


_FLAGS = ("SELECT l_orderkey, max(CASE WHEN p_type LIKE 'PROMO%' THEN 1 ELSE 0 END) AS f_promo, "
          "max(CASE WHEN p_type LIKE 'SMALL%' OR p_type LIKE 'MEDIUM%' THEN 1 ELSE 0 END) AS f_small, "
          "max(CASE WHEN p_type LIKE 'ECONOMY%' THEN 1 ELSE 0 END) AS f_economy FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")


def order_flags(spark, sf):
    return H.flags_by_prefix(order_parts(spark, sf), ["l_orderkey"], "p_type", PART_FLAGS)


@query("P1_flags_by_prefix", _FLAGS)
def flags_by_prefix(spark, sf):
    return order_flags(spark, sf)


@query("P2_any_flag", f"SELECT count(*) AS n FROM ({_FLAGS}) WHERE f_promo + f_small > 0")
def any_flag(spark, sf):
    return order_flags(spark, sf).filter(H.any_flag(["f_promo", "f_small"])).agg(F.count("*").alias("n"))


@query("P3_inclusion_filter", with_ctes("SELECT entity, round(los_h, 6) AS los_h FROM stays WHERE los_h >= 600 AND entity >= 18", "stays"))
def inclusion(spark, sf):
    return rounded(stays(spark, sf).filter((F.col("los_h") >= 600) & (F.col("entity") >= 18)))


_TAG = "CASE WHEN f_promo = 1 THEN 'promo' WHEN f_economy = 1 THEN 'economy' WHEN f_small = 1 THEN 'small' ELSE 'other' END"


@query("P4_priority_tag", f"SELECT {_TAG} AS tag, count(*) AS n FROM ({_FLAGS}) GROUP BY 1")
def priority_tag(spark, sf):
    return order_flags(spark, sf).groupBy(H.priority_tag(TAGS).alias("tag")).agg(F.count("*").alias("n"))


@query("P5_subject_history_flags", """
    WITH c AS (SELECT l_orderkey, max(CASE WHEN (p_size % 2) = 0 AND p_type LIKE 'PROMO%' OR (p_size % 2) = 1 AND p_type LIKE 'LARGE%' THEN 1 ELSE 0 END) AS f
               FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
         s AS (SELECT o_custkey, max(f) AS f FROM orders JOIN c ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT o_orderkey, o_custkey, coalesce(f, 0) AS f_mixed FROM orders LEFT JOIN s USING (o_custkey)""")
def history_flags(spark, sf):
    codes = order_parts(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), "p_type", (F.col("p_size") % 2).alias("version"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return H.subject_history_flags(orders, orders, codes, "o_orderkey", "o_custkey", "o_orderkey", "p_type", {"f_mixed": ["0:PROMO", "1:LARGE"]}, "version")


# Brands play the code system: 'Brand#12' -> '12'.
RULES = {"low": ["11-14", "2"], "mid": ["15-19"], "high": ["20-25", "9"]}


def brand_codes(spark, sf):
    return order_parts(spark, sf).select("l_orderkey", F.substring("p_brand", 7, 10).alias("code"))


_CATEGORY = ("SELECT l_orderkey, max(CASE WHEN substr(c, 1, 2) BETWEEN '11' AND '14' AND length(substr(c, 1, 2)) = 2 OR substr(c, 1, 1) = '2' THEN 1 ELSE 0 END) AS low, "
             "max(CASE WHEN substr(c, 1, 2) BETWEEN '15' AND '19' AND length(substr(c, 1, 2)) = 2 THEN 1 ELSE 0 END) AS mid, "
             "max(CASE WHEN substr(c, 1, 2) BETWEEN '20' AND '25' AND length(substr(c, 1, 2)) = 2 OR substr(c, 1, 1) = '9' THEN 1 ELSE 0 END) AS high "
             "FROM (SELECT l_orderkey, {code} AS c FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1")
_BRAND = "substr(p_brand, 7, 10)"


@query("P6_category_flags", _CATEGORY.format(code=_BRAND))
def category_flags(spark, sf):
    return H.category_flags(brand_codes(spark, sf), ["l_orderkey"], "code", RULES)


@query("P6_comma_list_codes", """
    SELECT lang, count(*) AS items, count(DISTINCT c) AS distinct_items, CAST(sum(CASE WHEN c = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty
    FROM (SELECT lang, replace(trim(u, ' '), '.', '') AS c FROM (SELECT lang, unnest(string_split(coalesce("text", ''), ',')) AS u FROM documents)) GROUP BY 1""")
def comma_lists(spark, sf):
    items = table(spark, sf, "documents").select("lang", F.explode(X.split_cell("text")).alias("u")).select("lang", X.plain_code("u").alias("c"))
    return items.groupBy("lang").agg(F.count("*").alias("items"), F.count_distinct("c").alias("distinct_items"), F.count_if(F.col("c") == "").alias("empty"))


@query("P7_code_stem", """
    SELECT regexp_extract(upper(trim(c_mktsegment || '.' || c_nationkey)), '^([A-Z][0-9]*)', 1) AS stem1,
           regexp_extract(upper(trim('c' || c_nationkey || '.7')), '^([A-Z][0-9]*)', 1) AS stem2, count(*) AS n FROM customer GROUP BY 1, 2""")
def code_stem(spark, sf):
    cu = table(spark, sf, "customer")
    dotted = F.concat_ws(".", "c_mktsegment", F.col("c_nationkey").cast("string"))
    coded = F.concat(F.lit("c"), F.col("c_nationkey").cast("string"), F.lit(".7"))
    return cu.groupBy(X.code_stem(dotted).alias("stem1"), X.code_stem(coded).alias("stem2")).agg(F.count("*").alias("n"))


@query("P8_weighted_score", f"SELECT l_orderkey, mid + greatest(low, 3 * high) AS score FROM ({_CATEGORY.format(code=_BRAND)})")
def weighted_score(spark, sf):
    flags = H.category_flags(brand_codes(spark, sf), ["l_orderkey"], "code", RULES)
    return flags.select("l_orderkey", H.weighted_score({"mid": 1}, [("low", 1, "high", 3)]).alias("score"))


_NO22 = _CATEGORY.format(code=f"CASE WHEN {_BRAND} LIKE '22%' THEN NULL ELSE {_BRAND} END")


@query("P9_exclusion_flags", f"SELECT CAST(sum(high) AS BIGINT) AS flagged, (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {_BRAND} LIKE '22%') AS excluded_rows FROM ({_NO22})")
def exclusion_flags(spark, sf):
    codes = brand_codes(spark, sf)
    flagged = H.category_flags(codes, ["l_orderkey"], "code", RULES, exclude=["22"]).agg(F.sum("high").alias("flagged"))
    probe = codes.agg(F.count_if(F.col("code").startswith("22")).alias("excluded_rows"))
    return flagged.crossJoin(probe)


@query("P10_item_mapping", with_ctes("SELECT CASE WHEN fam IN ('click', 'view') THEN 'attention' ELSE 'conversion' END AS family, count(*) AS n, max(val) AS top FROM series WHERE fam IN ('click', 'view', 'purchase') GROUP BY 1", "series"))
def item_mapping(spark, sf):
    mapped = C.map_items(series(spark, sf), "fam", {"attention": ["click", "view"], "conversion": ["purchase"]}, "family")
    return mapped.groupBy("family").agg(F.count("*").alias("n"), F.max("val").alias("top"))


CLASSES = [("red", "warm"), ("widget", "part_w"), ("ring", "part_r"), ("small", "size_s")]


@query("P11_first_match_class", """
    SELECT CASE WHEN contains(lower(p_name), 'red') THEN 'warm' WHEN contains(lower(p_name), 'widget') THEN 'part_w' WHEN contains(lower(p_name), 'ring') THEN 'part_r'
                WHEN contains(lower(p_name), 'small') THEN 'size_s' END AS class, count(*) AS n FROM part GROUP BY 1""")
def first_match(spark, sf):
    return table(spark, sf, "part").groupBy(X.first_match("p_name", CLASSES).alias("class")).agg(F.count("*").alias("n"))


_EVERY = " UNION ALL ".join(f"SELECT '{tag}' AS class FROM part WHERE contains(lower(p_name), '{word}')" for word, tag in CLASSES)


@query("P11_every_match_class", f"SELECT class, count(*) AS n FROM ({_EVERY}) GROUP BY 1")
def every_match(spark, sf):
    return table(spark, sf, "part").select(F.explode(X.every_match("p_name", CLASSES)).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("P12_contains_but_not", "SELECT doc_id FROM documents WHERE (\"text\" ILIKE '%the%' OR \"text\" ILIKE '%elle%') AND NOT (\"text\" ILIKE '%copyright%')")
def contains_but_not(spark, sf):
    return table(spark, sf, "documents").filter(X.contains_but_not("text", ["the", "elle"], ["copyright"])).select("doc_id")


@query("P13_exclude_substring", "SELECT count(*) AS n FROM part WHERE NOT contains(p_name, 'ring')")
def exclude_substring(spark, sf):
    return table(spark, sf, "part").filter(~F.col("p_name").contains("ring")).agg(F.count("*").alias("n"))


@query("P14_unit_conversion", with_ctes(f"""
    WITH m AS (SELECT quantile_cont(CASE WHEN fam = 'view' THEN val END, 0.5) AS med FROM series),
         c AS (SELECT fam, CASE WHEN fam = 'click' THEN val * (1 / 88.4::DOUBLE) WHEN fam = 'error' THEN val * 18.02::DOUBLE
                                WHEN fam = 'view' AND med < 60 THEN val * 100 ELSE val END AS val FROM series, m)
    SELECT fam, count(*) AS n, {r('sum(val)', 3)} AS total FROM c GROUP BY 1""", "series"))
def unit_conversion(spark, sf):
    scaled = C.scale_by_median(C.convert_units(series(spark, sf), {"click": 1 / 88.4, "error": 18.02}), "view", limit=60.0)
    return rounded(scaled.groupBy("fam").agg(F.count("*").alias("n"), F.sum("val").alias("total")), 3)


@query("P15_plausible_medians", with_ctes(f"SELECT fam, {r('quantile_cont(val, 0.5)')} AS median, CASE WHEN quantile_cont(val, 0.5) BETWEEN 20 AND 60 THEN 1 ELSE 0 END AS ok FROM series GROUP BY 1", "series"))
def plausible(spark, sf):
    from tidemark.operators.ordered import quantiles

    medians = quantiles(series(spark, sf), "val", {"median": 0.5}, ["fam"])
    return rounded(medians.select("fam", "median", F.when(F.col("median").between(20.0, 60.0), 1).otherwise(0).alias("ok")))


@query("P16_value_bounds", with_ctes("SELECT fam, count(*) AS n, min(val) AS lo, max(val) AS hi FROM series WHERE CASE fam WHEN 'click' THEN val BETWEEN 1 AND 100 WHEN 'view' THEN val BETWEEN 0.1 AND 30 ELSE true END GROUP BY 1", "series"))
def value_bounds(spark, sf):
    kept = C.within_bounds(series(spark, sf), {"click": (1, 100), "view": (0.1, 30)})
    return kept.groupBy("fam").agg(F.count("*").alias("n"), F.min("val").alias("lo"), F.max("val").alias("hi"))


@query("P17_fahrenheit", with_ctes(f"SELECT CASE WHEN fam = 'signup' THEN 'view' ELSE fam END AS fam, count(*) AS n, {r('avg(CASE WHEN fam = ' + chr(39) + 'signup' + chr(39) + ' THEN (val - 32) / 1.8::DOUBLE ELSE val END)')} AS mean FROM series GROUP BY 1", "series"))
def fahrenheit(spark, sf):
    return rounded(C.fahrenheit_to_celsius(series(spark, sf), "signup", "view").groupBy("fam").agg(F.count("*").alias("n"), F.avg("val").alias("mean")))


PRIORITY_TEXT = {"2-HIGH": 2, "4-NOT SPECIFIED": None}


@query("P18_ordinal_score", """
    SELECT o_orderpriority, CASE WHEN o_orderpriority = '2-HIGH' THEN 2.0::DOUBLE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
      ELSE TRY_CAST(regexp_extract(o_orderpriority, '^([135])-', 1) AS DOUBLE) END AS score, count(*) AS n FROM orders GROUP BY 1, 2""")
def ordinal(spark, sf):
    od = table(spark, sf, "orders")
    return od.groupBy("o_orderpriority", X.ordinal_score("o_orderpriority", PRIORITY_TEXT, r"^([135])-").alias("score")).agg(F.count("*").alias("n"))


@query("P18_ordinal_unmapped", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('2-HIGH', '4-NOT SPECIFIED') AND NOT regexp_matches(o_orderpriority, '^[13]-') GROUP BY 1")
def ordinal_unmapped(spark, sf):
    return C.unmapped_values(table(spark, sf, "orders"), "o_orderpriority", PRIORITY_TEXT, r"^([13])-")


@query("P19_preferred_variant", "SELECT o_custkey, count(*) AS n, min(rk) AS rank FROM (SELECT *, min(rk) OVER (PARTITION BY o_custkey) AS best FROM (SELECT *, CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 3 END AS rk FROM orders)) WHERE rk = best GROUP BY 1")
def preferred(spark, sf):
    p = F.col("o_orderpriority")
    rank = F.when(p.startswith("1"), 1).when(p.startswith("2"), 2).otherwise(3)
    kept = C.preferred_variant(table(spark, sf, "orders"), ["o_custkey"], rank)
    return kept.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min(rank).alias("rank"))


@query("P20_best_single_value", with_ctes("SELECT entity, arg_min(val, (CASE fam WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 9 END, hr, val)) AS val FROM series GROUP BY 1", "series"))
def best_value(spark, sf):
    priority = F.when(F.col("fam") == "purchase", 0).when(F.col("fam") == "view", 1).otherwise(9)
    return C.best_single_value(series(spark, sf), "entity", "val", priority, "hr")


@query("P21_sum_if_all_parts", with_ctes(f"SELECT entity, {r('a + b + c')} AS total FROM (SELECT entity, max(CASE WHEN fam = 'click' AND hr < 100 THEN val END) AS a, max(CASE WHEN fam = 'view' AND hr < 100 THEN val END) AS b, max(CASE WHEN fam = 'error' AND hr < 100 THEN val END) AS c FROM series GROUP BY 1)", "series"))
def sum_parts(spark, sf):
    def part(f):
        return F.max(F.when((F.col("fam") == f) & (F.col("hr") < 100), F.col("val")))

    return rounded(series(spark, sf).groupBy("entity").agg((part("click") + part("view") + part("error")).alias("total")))


@query("P22_logit_sigmoid", with_ctes(f"SELECT entity, t_hr, {r('ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p))))', 8)} AS z, {r('1 / (1 + exp(-q))', 8)} AS s FROM pred", "pred"))
def logit_sigmoid(spark, sf):
    return rounded(predictions(spark, sf).select("entity", "t_hr", N.logit("p", 1e-6).alias("z"), N.sigmoid("q").alias("s")), 8)


P_REC = "1 / (1 + exp(-(-0.3::DOUBLE + 0.8::DOUBLE * ln(p / (1 - p)))))"


@query("P23_recalibrated", with_ctes(f"SELECT entity, t_hr, {r(P_REC, 8)} AS p_rec FROM pred", "pred"))
def recalibrated(spark, sf):
    return rounded(predictions(spark, sf).select("entity", "t_hr", N.recalibrate("p", *LAYER).alias("p_rec")), 8)


@query("P24_risk_band", with_ctes("SELECT CASE WHEN p < 0.2 THEN 0 WHEN p < 0.3 THEN 1 ELSE 2 END AS band, count(*) AS n FROM pred GROUP BY 1", "pred"))
def risk_band(spark, sf):
    return predictions(spark, sf).groupBy(N.band("p", (0.2, 0.3)).alias("band")).agg(F.count("*").alias("n"))


@query("P25_numeric_coercion", "SELECT count(*) AS n, count(TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS DOUBLE)) AS readable, count(TRY_CAST(props AS DOUBLE)) AS unreadable, CAST(sum(TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS DOUBLE)) AS DOUBLE) AS total FROM events")
def coercion(spark, sf):
    ev = table(spark, sf, "events")
    digits = N.number(F.regexp_replace("props", "[^0-9]", ""))
    return ev.agg(F.count("*").alias("n"), F.count(digits).alias("readable"), F.count(N.number("props")).alias("unreadable"), F.sum(digits).alias("total"))


def sparse_wide(spark, sf):
    """Wide table with natural gaps: the largest early value of each family per entity."""
    s = series(spark, sf)
    return s.groupBy("entity").agg(*[F.max(F.when((F.col("fam") == f) & (F.col("hr") < 24.0 * (i + 1)), F.col("val"))).alias(f) for i, f in enumerate(FAMILIES)])


_SPARSE = "SELECT entity, " + ", ".join(f"max(CASE WHEN fam = '{f}' AND hr < {24 * (i + 1)} THEN val END) AS {f}" for i, f in enumerate(FAMILIES)) + " FROM series GROUP BY 1"


@query("P26_zero_fill", with_ctes("SELECT entity, coalesce(click, 0) AS click, coalesce(error, 0) AS error, purchase FROM (" + _SPARSE + ")", "series"))
def zero_fill(spark, sf):
    return C.fill_zero(sparse_wide(spark, sf), ["click", "error"]).select("entity", "click", "error", "purchase")


@query("P27_median_fill", with_ctes(f"WITH w AS ({_SPARSE}), m AS (SELECT quantile_cont(click, 0.5) AS a, quantile_cont(error, 0.5) AS b FROM w) SELECT entity, {r('coalesce(click, a)')} AS click, {r('coalesce(error, b)')} AS error FROM w, m", "series"))
def median_fill(spark, sf):
    wide = sparse_wide(spark, sf).select("entity", "click", "error")
    catalogue = M.feature_catalogue(wide, ["click", "error"])
    return rounded(C.fill_from(wide, M.profile_row(catalogue, ["click", "error"]), ["click", "error"]))


@query("P28_default_profile", with_ctes(f"""
    WITH w AS ({_SPARSE}), m AS (SELECT quantile_cont(click, 0.5) AS click_d, quantile_cont(signup, 0.5) AS signup_d FROM w),
    b AS (SELECT entity, greatest(coalesce(error, 0), 0.1::DOUBLE) AS base, greatest(coalesce(purchase, 0), 0.1::DOUBLE) AS cur FROM w)
    SELECT entity, {r('base')} AS x_cr_base, {r('cur / base')} AS x_cr_ratio_base, {r('cur - base')} AS x_cr_delta_since_adm, {r('click_d')} AS x_click, {r('signup_d')} AS x_signup FROM b, m""", "series"))
def default_profile(spark, sf):
    wide = sparse_wide(spark, sf)
    features = ["cr_base", "cr_ratio_base", "cr_delta_since_adm", "click", "signup"]
    catalogue = M.feature_catalogue(wide, ["click", "signup"])
    inputs = wide.select("entity", F.coalesce("error", F.lit(0.0)).alias("base"), F.coalesce("purchase", F.lit(0.0)).alias("cur"), F.lit(54.0).alias("hour"))
    derived = M.bedside_features("base", "cur", "cur", "base", "hour")
    full = M.fill_profile(inputs, M.profile_row(catalogue, features), features, derived)
    return rounded(full.select("entity", *[f"x_{f}" for f in features]))


@query("P29_drop_sparse", with_ctes("SELECT entity, error, purchase, signup, view FROM (" + _SPARSE + ")", "series"))
def drop_sparse(spark, sf):
    wide = sparse_wide(spark, sf)
    return C.drop_sparse(wide, list(FAMILIES), 0.53)


@query("P30_feature_domain", with_ctes("""
    SELECT CASE WHEN starts_with(fam, 'cl') OR starts_with(fam, 'vi') THEN 'attention' WHEN fam = 'purchase' THEN 'conversion' ELSE 'other' END AS domain, count(DISTINCT fam) AS features, count(*) AS n FROM series GROUP BY 1""", "series"))
def feature_domain(spark, sf):
    domain = X.name_domain("fam", [("cl", "attention"), ("vi", "attention")], [("purchase", "conversion")])
    return series(spark, sf).groupBy(domain.alias("domain")).agg(F.count_distinct("fam").alias("features"), F.count("*").alias("n"))


@query("P31_calendar_year", """
    SELECT o_orderkey, CAST(round_even((lo + lo + 3) / 2.0::DOUBLE + (year(o_orderdate) - 1995), 0) AS INT) AS year
    FROM (SELECT *, 1990 + 3 * (o_custkey % 4) AS lo FROM orders)""")
def calendar_year(spark, sf):
    od = table(spark, sf, "orders").withColumn("lo", F.lit(1990) + 3 * (F.col("o_custkey") % 4))
    text = F.concat_ws(" - ", F.col("lo").cast("string"), (F.col("lo") + 3).cast("string"))
    return od.select("o_orderkey", X.calendar_year(text, F.year("o_orderdate"), F.lit(1995)).alias("year"))


@query("P32_fixed_rule", with_ctes("SELECT CASE WHEN coalesce(click < 5, false) OR coalesce(error >= 1.5 * purchase, false) OR coalesce(error - purchase >= 30, false) THEN 1 ELSE 0 END AS flag, count(*) AS n FROM (" + _SPARSE + ") GROUP BY 1", "series"))
def fixed_rule(spark, sf):
    c = F.col
    rule = N.true_or_false((c("click") < 5) | (c("error") >= 1.5 * c("purchase")) | (c("error") - c("purchase") >= 30))
    return sparse_wide(spark, sf).groupBy(rule.alias("flag")).agg(F.count("*").alias("n"))


@query("P33_hour_bin", with_ctes("SELECT floor((hr - 300) / 6) * 6 AS t_hr, count(*) AS n FROM series GROUP BY 1", "series"))
def hour_bins(spark, sf):
    return series(spark, sf).groupBy(N.hour_bin(F.col("hr") - 300.0).cast("double").alias("t_hr")).agg(F.count("*").alias("n"))


@query("P34_boolean_text", "SELECT CASE WHEN starts_with(lower(c_mktsegment), 'mach') THEN 1 ELSE 0 END AS flag, count(*) AS n FROM customer GROUP BY 1")
def boolean_text(spark, sf):
    return table(spark, sf, "customer").groupBy(X.says_yes("c_mktsegment", "mach").alias("flag")).agg(F.count("*").alias("n"))
