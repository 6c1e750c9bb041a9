"""Registered queries over the given tables, each with its DuckDB SQL where SQL can say it.

Names begin with the number of the operator in the inventory. Doubles are rounded to four decimals on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CLOSURE_CUTS, MAP_SIZES, PORT_FEATURES, SEASON_CUTS
from .functions import exprs as x
from .operators import decode, evaluate, features, forecast, marts, models, panel, stats, weather
from .plans.declarations import BREAKS, CARGO, FOLDS, THRESHOLD, declarations, declarations_apart, hourly_weather, table, weather_config
from .sources import pages, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = ["port", "direction"]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to so many digits. They are moved by a thousandth of the last digit first: sums that differ by their order alone then never lie on two sides of a half."""
    return df.select(*[(F.round(F.col(c) + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 4):
    """Registers a query; doubles: result columns of the SQL that are rounded to so many digits."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            body = f"SELECT * REPLACE ({', '.join(f'round({c} + 1e-{digits + 3}, {digits}) + 0.0 AS {c}' for c in doubles.split())}) FROM ({sql})" if doubles else sql
            ORACLES[name] = body
        return f

    return add


DECL = """decl AS (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, sn.n_name AS port,
    CASE WHEN l_linestatus = 'O' THEN 'import' ELSE 'export' END AS direction, l_extendedprice AS value_usd, CASE WHEN l_linestatus <> 'O' THEN l_quantity * 10 END AS weight_kg,
    l_quantity AS quantity, p_type AS hs2, p_brand AS hs4, p_name AS hs6, cn.n_name AS country, r_name AS continent, o_orderpriority AS cargo, l_returnflag AS clause
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN part ON l_partkey = p_partkey)"""
_MODES = panel.MODES


def _mode_sql(of: str, source: str, keys: str) -> str:
    return f"(SELECT {keys}, {of} AS v FROM (SELECT {keys}, {of}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {of}) AS r FROM {source} WHERE {of} IS NOT NULL GROUP BY {keys}, {of}) WHERE r = 1)"


_PK = "port, direction, year, month"
PANEL = DECL + f""", panel AS (SELECT {_PK}, count(*) AS shipment_count, coalesce(sum(value_usd), 0) AS total_value_usd, sum(weight_kg) / 1000 AS total_weight_mt, coalesce(sum(quantity), 0) AS total_quantity,
    count(DISTINCT hs2) AS commodity_diversity, count(DISTINCT hs4) AS hs4_diversity, count(DISTINCT country) AS country_diversity, count(DISTINCT continent) AS continent_diversity,
    {", ".join(f"count(*) FILTER (cargo ILIKE '%{w}%') AS {c}" for c, w in CARGO.items())}, avg(value_usd) AS avg_value_per_shipment_usd FROM decl GROUP BY {_PK})"""
FEATURES = PANEL + """, f0 AS (SELECT *, lag(shipment_count, 1) OVER w AS lag_1, lag(shipment_count, 2) OVER w AS lag_2, lag(shipment_count, 3) OVER w AS lag_3, lag(shipment_count, 12) OVER w AS lag_12,
    lag(shipment_count, 24) OVER w AS _lag_24, lag(shipment_count, 36) OVER w AS _lag_36, lag(shipment_count, 48) OVER w AS _lag_48, lag(total_value_usd, 12) OVER w AS lag_value_12, lag(total_weight_mt, 12) OVER w AS lag_weight_12,
    avg(shipment_count) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_3_mean, avg(shipment_count) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rolling_12_mean,
    avg(total_value_usd) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rolling_value_12_mean,
    coalesce(CAST(lag(year, 12) OVER w IN (1998, 1999, 9999) AS INT), 0) AS lag_12_is_break, avg(shipment_count) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3_inclusive
    FROM panel WINDOW w AS (PARTITION BY port, direction ORDER BY year, month)),
    f1 AS (SELECT *, (shipment_count - lag_12) / nullif(lag_12, 0)::DOUBLE AS yoy_growth, (total_value_usd - lag_value_12) / nullif(lag_value_12, 0) AS yoy_value_growth,
    CASE WHEN lag_12_is_break = 0 THEN lag_12 WHEN year - 2 NOT IN (1998, 1999) AND _lag_24 IS NOT NULL THEN _lag_24 WHEN year - 3 NOT IN (1998, 1999) AND _lag_36 IS NOT NULL THEN _lag_36
    WHEN year - 4 NOT IN (1998, 1999) AND _lag_48 IS NOT NULL THEN _lag_48 ELSE lag_12 END AS lag_12_clean FROM f0),
    feats AS (SELECT *, CASE WHEN lag_12_is_break = 0 THEN yoy_growth ELSE (shipment_count - lag_12_clean) / nullif(lag_12_clean, 0)::DOUBLE END AS yoy_growth_clean FROM f1 WHERE lag_1 IS NOT NULL AND lag_12 IS NOT NULL)"""
INDEX = FEATURES + """, norms AS (SELECT *, (shipment_count - min(shipment_count) OVER s) / nullif(max(shipment_count) OVER s - min(shipment_count) OVER s, 0)::DOUBLE AS sc_norm,
    (total_value_usd - min(total_value_usd) OVER s) / nullif(max(total_value_usd) OVER s - min(total_value_usd) OVER s, 0) AS v_norm, (coalesce(total_weight_mt, 0) - min(coalesce(total_weight_mt, 0)) OVER s) / nullif(max(coalesce(total_weight_mt, 0)) OVER s - min(coalesce(total_weight_mt, 0)) OVER s, 0) AS w_norm,
    (commodity_diversity - min(commodity_diversity) OVER s) / nullif(max(commodity_diversity) OVER s - min(commodity_diversity) OVER s, 0)::DOUBLE AS cd_norm, cnt_container / shipment_count::DOUBLE AS pct_container, cnt_refrigerated / shipment_count::DOUBLE AS pct_refrigerated FROM feats WINDOW s AS (PARTITION BY port, direction)),
    ci AS (SELECT *, CASE WHEN direction = 'import' THEN 0.4 * coalesce(sc_norm, 0) + 0.3 * coalesce(v_norm, 0) + 0.2 * coalesce(cd_norm, 0) + 0.1 * coalesce(pct_container, 0)
    ELSE 0.4 * coalesce(w_norm, 0) + 0.3 * coalesce(sc_norm, 0) + 0.2 * coalesce(v_norm, 0) + 0.1 * coalesce(pct_refrigerated, 0) END AS congestion_index FROM norms)"""


def the_panel(spark: SparkSession, d: str, modes=()) -> DataFrame:
    """The panel with the labels `modes` and no others, made from line items, orders and parts that lie apart and written once.

    That is exact where each line item has one order and one part, which the stored panel tells; otherwise the declarations are joined.
    """
    found = tables.stored(panel.monthly_panel_apart(*declarations_apart(spark, d), cargo=CARGO, modes=modes), "panel")
    if not found.where("not whole").isEmpty():
        tables.discard(found)
        return tables.stored(panel.monthly_panel(declarations(spark, d), cargo=CARGO, modes=modes), "panel")
    out = found.drop("whole")
    out.stored_at = found.stored_at
    return out


def the_features(spark: SparkSession, d: str, modes=()) -> DataFrame:
    return features.build_features(the_panel(spark, d, modes), breaks=BREAKS)


def the_index(spark: SparkSession, d: str, modes=()) -> DataFrame:
    return features.congestion_index(the_features(spark, d, modes))


# ---- A: sources and sinks ------------------------------------------------------------------------------------------

@query("a3_split_valid", """SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM (SELECT CASE WHEN len(m) > 0 THEN array_to_string(m, ',') END AS reason FROM (
    SELECT list_filter([CASE WHEN nullif(l_returnflag, 'R') IS NULL THEN 'l_returnflag' END, CASE WHEN nullif(l_linenumber, 7) IS NULL THEN 'l_linenumber' END], lambda v: v IS NOT NULL) AS m FROM lineitem)) GROUP BY 1""")
def _(s, d):
    rows = table(s, d, "lineitem").withColumns({"l_returnflag": F.nullif("l_returnflag", F.lit("R")), "l_linenumber": F.nullif("l_linenumber", F.lit(7))})
    return tables.rejection_counts(rows, ["l_returnflag", "l_linenumber"])


@query("a8_year_audit", "SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    return tables.year_audit(table(s, d, "lineitem").select(F.year("l_shipdate").alias("year")))


@query("a14_append_missing", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tables.missing_rows(o, o.where("o_orderstatus = 'F'"), ["o_orderkey"]).drop("o_orderstatus")


@query("a17_nan_to_null", "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal FROM supplier", "s_acctbal")
def _(s, d):
    return tables.nan_to_null(table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal")).alias("s_acctbal")))


@query("a18_reconcile", """SELECT 'orders' AS "table", (SELECT count(*) FROM orders) AS n_left, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS n_right, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') = 0 AS same
    UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), (SELECT count(*) FROM nation), true""")
def _(s, d):
    o, n = table(s, d, "orders"), table(s, d, "nation")
    return tables.reconcile({"orders": o, "nation": n}, {"orders": o.where("o_orderstatus <> 'P'"), "nation": n})


@query("a10_bucketed_features", f"WITH {FEATURES} SELECT {_PK}, lag_1, lag_12, lag_12_clean, rolling_12_mean, yoy_growth_clean FROM feats", "rolling_12_mean yoy_growth_clean")
def _(s, d):
    cache = tables.save_bucketed(the_panel(s, d), f"panel_{uuid.uuid4().hex}")
    return features.build_features(cache, breaks=BREAKS).select(*KEYS, "year", "month", "lag_1", "lag_12", "lag_12_clean", "rolling_12_mean", "yoy_growth_clean")


@query("a20_panel_meta", f"WITH {PANEL} SELECT min(year) AS first_year, max(year) AS last_year, count(*) AS n_rows, count(DISTINCT (port, direction)) AS n_series FROM panel")
def _(s, d):
    return tables.panel_meta(the_panel(s, d), KEYS)


# ---- B: expressions ------------------------------------------------------------------------------------------------

@query("b1_parse_dirty_text", """SELECT l_orderkey, l_linenumber, l_extendedprice AS price, CAST(l_suppkey AS INT) AS code_strict, CAST(l_suppkey AS INT) AS code, substr(lpad(CAST(l_partkey AS VARCHAR), 8, '0'), 1, 6) AS hs6, substr(lpad(CAST(l_partkey AS VARCHAR), 8, '0'), 1, 4) AS hs4, substr(lpad(CAST(l_partkey AS VARCHAR), 8, '0'), 1, 2) AS hs2 FROM lineitem""", "price")
def _(s, d):
    raw = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.replace(F.format_string("%.2f", "l_extendedprice"), F.lit("."), F.lit(",")).alias("p"), F.concat(F.lit(" "), "l_suppkey", F.lit(",0")).alias("c"), F.col("l_partkey").cast("string").alias("h"))
    return raw.select("l_orderkey", "l_linenumber", x.text_to_double(F.col("p")).alias("price"), x.code_to_int(F.col("c"), strict=True).alias("code_strict"), x.code_to_int(F.col("c")).alias("code"), *[c.alias(n) for n, c in x.hs_levels(F.col("h"), 8).items()])


@query("b6_not_airport", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE (n_name <> 'FRANCE') AND NOT n_name ILIKE 'uni%'")
def _(s, d):
    df = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return df.where(x.not_airport((F.col("n_name"), "=", "FRANCE"), (F.col("n_name"), "^", "uni"))).select("s_suppkey", "n_name")


@query("b5_transport_mode", "SELECT l_orderkey, l_linenumber, l_linenumber = 1 AS by_sea FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", x.is_transport_mode(F.concat(F.lit(" "), "l_linenumber", F.lit(",00 "))).alias("by_sea"))


@query("b24_season_strength", f"WITH {PANEL}, m AS (SELECT port, direction, month, avg(shipment_count) AS a FROM panel GROUP BY 1, 2, 3), f AS (SELECT port, direction, month, round(a / avg(a) OVER (PARTITION BY port, direction), 9) AS f FROM m) SELECT port, direction, month, least(1.0, greatest(0.0, (f - 0.1) / 2.9)) AS activity, CASE WHEN f < 0.9 THEN 'Low Season' WHEN f < 1.3 THEN 'Normal' ELSE 'High Season' END AS label FROM f", "activity")
def _(s, d):
    f = panel.seasonal_index(the_panel(s, d)).withColumn("f", F.round("factor_shipment_count", 9))
    return f.select(*KEYS, "month", x.activity_index(F.col("f")).alias("activity"), x.bin_label(F.col("f"), *SEASON_CUTS).alias("label"))


@query("b10_calendar", """SELECT o_orderkey, ['Summer', 'Autumn', 'Winter', 'Spring'][(m % 12) // 3 + 1] AS season, CAST((m - 1) // 3 + 1 AS DOUBLE) AS quarter, sin(2 * pi() * m / 12) AS month_sin, cos(2 * pi() * m / 12) AS month_cos,
    CAST((y * 12 + m - 1 + 5) // 12 AS INT) AS next_year, CAST((y * 12 + m - 1 + 5) % 12 + 1 AS INT) AS next_month, CAST(y * 100 + m AS INT) AS period, y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') AS label, CAST(make_date(y, m, 1) AS VARCHAR) AS month_start FROM (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)""", "month_sin month_cos quarter")
def _(s, d):
    df = table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    sin, cos = x.cyclic(F.col("m"))
    ny, nm = x.add_months(F.col("y"), F.col("m"), F.lit(5))
    return df.select("o_orderkey", x.season(F.col("m")).alias("season"), x.quarter(F.col("m")).alias("quarter"), sin.alias("month_sin"), cos.alias("month_cos"), ny.alias("next_year"), nm.alias("next_month"), x.period(F.col("y"), F.col("m")).alias("period"), x.month_label(F.col("y"), F.col("m")).alias("label"), x.month_start(F.col("y"), F.col("m")).cast("string").alias("month_start"))


@query("b17_clamp_labels", """SELECT s_suppkey, CASE WHEN s_acctbal IS NOT NULL THEN least(0.4, greatest(-0.3, coalesce(nullif(s_acctbal / 10000, 0), 0.025))) END AS growth, CASE WHEN s_acctbal < 2500 THEN 'Low' WHEN s_acctbal < 5000 THEN 'Moderate' WHEN s_acctbal < 7500 THEN 'High' ELSE 'Critical' END AS label,
    ln(1 + abs(s_acctbal)) AS log_value, 100 * pow(1 + 0.1, s_suppkey % 12 / 12.0) AS grown, CASE WHEN s_acctbal / 20000 >= 0.4 THEN 'Critical' WHEN s_acctbal / 20000 >= 0.25 THEN 'High' WHEN s_acctbal / 20000 >= 0.15 THEN 'Moderate' ELSE 'Low' END AS delay FROM supplier""", "growth log_value grown")
def _(s, d):
    a = F.col("s_acctbal")
    return table(s, d, "supplier").select("s_suppkey", x.clamp(a / 10000, -0.3, 0.4, 0.025).alias("growth"), x.bin_label(a, (2500, 5000, 7500), ("Low", "Moderate", "High", "Critical")).alias("label"), F.log1p(F.abs(a)).alias("log_value"), x.compound(F.lit(100.0), F.lit(0.1), F.col("s_suppkey") % 12).alias("grown"), x.delay_label(a / 20000, F.lit(0.0)).alias("delay"))


# ---- C: joins ------------------------------------------------------------------------------------------------------

@query("c1_star_decode", """SELECT l_orderkey, l_linenumber, s_name, a.n_name AS supplier_nation, c_name, b.n_name AS customer_nation, p_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation a ON s_nationkey = a.n_nationkey
    LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation b ON c_nationkey = b.n_nationkey LEFT JOIN part ON l_partkey = p_partkey""")
def _(s, d):
    t = lambda n: table(s, d, n)
    L = decode.Lookup
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    df = decode.decode(df, [L(t("supplier"), "l_suppkey", "s_suppkey", {"s_name": "s_name", "s_nationkey": "sn"}), L(t("nation"), "sn", "n_nationkey", {"n_name": "supplier_nation"}), L(t("orders"), "l_orderkey", "o_orderkey", {"o_custkey": "ck"}), L(t("customer"), "ck", "c_custkey", {"c_name": "c_name", "c_nationkey": "cn"}), L(t("nation"), "cn", "n_nationkey", {"n_name": "customer_nation"}), L(t("part"), "l_partkey", "p_partkey", {"p_name": "p_name"})])
    return df.select("l_orderkey", "l_linenumber", "s_name", "supplier_nation", "c_name", "customer_nation", "p_name")


@query("c2_export_decode", """SELECT l_orderkey, l_linenumber, s_name AS exporter, n_name AS country, r_name AS region, o_orderpriority AS cargo, l_returnflag AS clause FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE l_linestatus <> 'O'""")
def _(s, d):
    t = lambda n: table(s, d, n)
    L = decode.Lookup
    df = t("lineitem").where("l_linestatus <> 'O'").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("clause"))
    df = decode.decode(df, [L(t("supplier"), "l_suppkey", "s_suppkey", {"s_name": "exporter"}), L(t("orders"), "l_orderkey", "o_orderkey", {"o_custkey": "ck", "o_orderpriority": "cargo"}), L(t("customer"), "ck", "c_custkey", {"c_nationkey": "cn"}), L(t("nation"), "cn", "n_nationkey", {"n_name": "country", "n_regionkey": "rk"}), L(t("region"), "rk", "r_regionkey", {"r_name": "region"})])
    return df.select("l_orderkey", "l_linenumber", "exporter", "country", "region", "cargo", "clause")


@query("c5_prefix_fallback", """WITH dim AS (SELECT CASE WHEN p_type LIKE 'S%' THEN left(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), 4) ELSE lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS code, p_name FROM part), ex AS (SELECT code, min(p_name) AS n FROM dim GROUP BY 1), pre AS (SELECT left(code, 4) AS p, arg_min(p_name, (code, p_name)) AS n FROM dim GROUP BY 1)
    SELECT l_orderkey, l_linenumber, coalesce(ex.n, pre.n) AS description FROM lineitem LEFT JOIN ex ON ex.code = lpad(CAST(l_partkey AS VARCHAR), 6, '0') LEFT JOIN pre ON pre.p = left(lpad(CAST(l_partkey AS VARCHAR), 6, '0'), 4)""")
def _(s, d):
    code = F.lpad(F.col("p_partkey").cast("string"), 6, "0")  # standard and small parts have no code of their own, only a prefix
    dim = table(s, d, "part").select(F.when(F.col("p_type").startswith("S"), F.left(code, F.lit(4))).otherwise(code).alias("code"), "p_name")
    facts = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.lpad(F.col("l_partkey").cast("string"), 6, "0").alias("c"))
    return decode.prefix_fallback(facts, dim, "c", "code", "p_name", "description").drop("c")


@query("c14_active_series", f"WITH {PANEL} SELECT port, direction FROM panel GROUP BY 1, 2 HAVING count(*) >= 36 AND max(year) >= 2001")
def _(s, d):
    p = the_panel(s, d)
    return panel.eligible_series(p).select(*KEYS).join(p.where("year >= 2001").select(*KEYS).distinct(), KEYS, "left_semi")


@query("d8_miss_report", "SELECT count(*) AS n_rows, count(*) FILTER (n_name IS NULL) AS miss_nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def _(s, d):
    df = decode.decode(table(s, d, "supplier"), [decode.Lookup(table(s, d, "nation").where("n_regionkey <> 2"), "s_nationkey", "n_nationkey", {"n_name": "nation"})])
    return decode.miss_report(df, ["nation"])


@query("d9_leak_check", """SELECT 'orders' AS "table", (SELECT count(*) FROM orders WHERE o_totalprice < 0) AS n_leaks UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem WHERE l_discount > 0.05)""")
def _(s, d):
    return decode.leak_check({"orders": (table(s, d, "orders"), F.col("o_totalprice") < 0), "lineitem": (table(s, d, "lineitem"), F.col("l_discount") > 0.05)})


# ---- D: panels and aggregates --------------------------------------------------------------------------------------

@query("d1_monthly_panel", f"WITH {PANEL} SELECT p.*, {', '.join(f'm{i}.v AS {out}' for i, out in enumerate(_MODES))} FROM panel p " + " ".join(f"LEFT JOIN {_mode_sql(of, 'decl', _PK)} m{i} USING ({_PK})" for i, of in enumerate(_MODES.values())), "total_value_usd total_weight_mt total_quantity avg_value_per_shipment_usd")
def _(s, d):
    return the_panel(s, d, _MODES)


_CK = "hs2, port, direction, year, month"


@query("d2_commodity_panel", f"WITH {DECL}, p AS (SELECT {_CK}, count(*) AS shipment_count, coalesce(sum(value_usd), 0) AS total_value_usd, coalesce(sum(weight_kg) / 1000, 0) AS total_weight_mt, coalesce(sum(quantity), 0) AS total_quantity FROM decl GROUP BY {_CK}) SELECT p.*, m.v AS dominant_description FROM p LEFT JOIN {_mode_sql('hs6', 'decl', _CK)} m USING ({_CK})", "total_value_usd total_weight_mt total_quantity")
def _(s, d):
    return panel.commodity_panel(declarations(s, d))


@query("d3_panel_extra_key", f"WITH {DECL} SELECT port, direction, clause, year, month, count(*) AS shipment_count, sum(value_usd) AS total_value_usd FROM decl GROUP BY port, direction, clause, year, month", "total_value_usd")
def _(s, d):
    return panel.monthly_panel(declarations(s, d), [*KEYS, "clause"], CARGO).select(*KEYS, "clause", "year", "month", "shipment_count", "total_value_usd")


@query("d10_seasonal_index", f"WITH {PANEL}, m AS (SELECT port, direction, month, avg(shipment_count) AS a, avg(total_value_usd) AS b FROM panel WHERE year >= 1996 GROUP BY 1, 2, 3) SELECT port, direction, month, a / avg(a) OVER w AS factor_shipment_count, b / avg(b) OVER w AS factor_total_value_usd FROM m WINDOW w AS (PARTITION BY port, direction)", "factor_shipment_count factor_total_value_usd")
def _(s, d):
    return panel.seasonal_index(the_panel(s, d), KEYS, ["shipment_count", "total_value_usd"], 1996)


@query("d11_seasonal_two_level", f"WITH {DECL}, p AS (SELECT hs2, port, direction, year, month, sum(value_usd) AS v FROM decl GROUP BY {_CK}), w AS (SELECT hs2, port, direction, count(DISTINCT year) AS n_years, avg(v) AS a FROM p GROUP BY 1, 2, 3 HAVING count(DISTINCT year) >= 4) SELECT p.hs2, p.port, p.direction, month, any_value(n_years) AS n_years, count(*) AS n, avg(v) / any_value(a) AS season_factor FROM p JOIN w ON p.hs2 = w.hs2 AND p.port = w.port AND p.direction = w.direction GROUP BY 1, 2, 3, 4", "season_factor")
def _(s, d):
    return panel.seasonal_index_two_level(panel.commodity_panel(declarations(s, d)))


@query("d13_positive_growth", f"WITH {PANEL}, g AS (SELECT port, direction, shipment_count, total_value_usd, lag(shipment_count, 12) OVER w AS a, lag(total_value_usd, 12) OVER w AS b FROM panel WINDOW w AS (PARTITION BY port, direction ORDER BY year, month)) SELECT port, direction, avg(CASE WHEN a > 0 THEN shipment_count / a::DOUBLE - 1 END) AS growth_shipment_count, avg(CASE WHEN b > 0 THEN total_value_usd / b - 1 END) AS growth_total_value_usd, count(*) AS n_obs, avg(shipment_count) * count(*) AS weight FROM g GROUP BY 1, 2 HAVING count(*) >= 48", "growth_shipment_count growth_total_value_usd weight")
def _(s, d):
    return panel.mean_positive_growth(the_panel(s, d), ["shipment_count", "total_value_usd"], KEYS)


_Q = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query("d15_describe", f"WITH {PANEL} SELECT direction, count(*) AS n, avg(shipment_count) AS mean, stddev_samp(shipment_count) AS std, min(shipment_count) AS min, max(shipment_count) AS max, {', '.join(f'quantile_cont(shipment_count, {q}) AS p{round(100 * q)}' for q in _Q)} FROM panel GROUP BY 1", "mean std " + " ".join(f"p{round(100 * q)}" for q in _Q))
def _(s, d):
    return stats.describe_by(the_panel(s, d), "direction", "shipment_count", _Q)


@query("d16_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS n_null, 100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS pct_null, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS example FROM orders""" for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_orderpriority", "string"))), "pct_null")
def _(s, d):
    return stats.profile(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("d17_coverage", f"WITH {PANEL} SELECT port, direction, min(year) AS first_year, max(year) AS last_year, count(*) AS n_months, CAST(max(year) - min(year) + 1 AS INT) AS span_years FROM panel GROUP BY 1, 2")
def _(s, d):
    return stats.coverage(the_panel(s, d), KEYS)


@query("d18_volatility", f"WITH {PANEL} SELECT port, direction, avg(shipment_count) AS mean, stddev_samp(shipment_count) AS std, count(*) AS n, max(year) AS last_year, stddev_samp(shipment_count) / avg(shipment_count) AS cv FROM panel GROUP BY 1, 2", "mean std cv")
def _(s, d):
    return stats.volatility(the_panel(s, d), KEYS, "shipment_count")


@query("d19_break_impact", f"WITH {PANEL}, b AS (SELECT port, direction, avg(shipment_count) FILTER (year BETWEEN 1995 AND 1997) AS pre_mean, avg(shipment_count) FILTER (year = 1998) AS y1_mean, avg(shipment_count) FILTER (year = 1999) AS y2_mean, count(*) FILTER (year IN (1998, 1999)) AS n_touched FROM panel GROUP BY 1, 2) SELECT *, 100 * (y1_mean - pre_mean) / pre_mean AS change_y1_pct, 100 * (y2_mean - pre_mean) / pre_mean AS change_y2_pct FROM b WHERE pre_mean IS NOT NULL AND y1_mean IS NOT NULL AND y2_mean IS NOT NULL", "pre_mean y1_mean y2_mean change_y1_pct change_y2_pct")
def _(s, d):
    return stats.break_impact(the_panel(s, d), KEYS, "shipment_count", (1995, 1997), 1998, 1999)


@query("d20_national_series", f"WITH {PANEL} SELECT year, month, direction, CAST(sum(shipment_count) AS BIGINT) AS shipment_count FROM panel GROUP BY 1, 2, 3")
def _(s, d):
    return panel.national_series(the_panel(s, d))


@query("d21_national_totals", f"WITH {PANEL} SELECT year, coalesce(direction, 'total') AS direction, CAST(sum(shipment_count) AS BIGINT) AS shipment_count FROM panel GROUP BY GROUPING SETS ((year, direction), (year))")
def _(s, d):
    return panel.national_totals(the_panel(s, d))


_CORR = ("shipment_count", "total_value_usd", "total_quantity", "country_diversity")


@query("d23_corr_matrix", f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM panel" for i, a in enumerate(_CORR) for b in _CORR[i:]), "rho")
def _(s, d):
    return stats.corr_matrix(the_panel(s, d), _CORR)


@query("d24_leak_corr", f"WITH {FEATURES}, c AS (SELECT port, direction, corr(shipment_count, rolling_3_inclusive) AS rho FROM feats GROUP BY 1, 2) SELECT count(*) AS n_series, min(rho) AS min_rho, max(rho) AS max_rho, avg(rho) AS mean_rho, avg(CAST(abs(rho) > 0.999 AS INT)) AS share_one FROM c WHERE rho IS NOT NULL AND NOT isnan(rho)", "min_rho max_rho mean_rho share_one")
def _(s, d):
    p = the_panel(s, d).withColumn("rolling_3_inclusive", features.rolling_inclusive("shipment_count", 3, KEYS))
    return stats.leak_corr(features.build_features(p, breaks=BREAKS), KEYS, "shipment_count", "rolling_3_inclusive")


@query("d34_leak_identity", f"WITH {FEATURES}, g AS (SELECT shipment_count::DOUBLE AS y, 3 * rolling_3_inclusive - lag_1 - lag_2 AS g FROM feats) SELECT count(*) AS n, max(abs(y - g)) AS max_residual, avg(abs(y - g)) AS mean_residual, 1 - sum((y - g) ** 2) / (count(*) * var_pop(y)) AS r2 FROM g", "max_residual mean_residual r2")
def _(s, d):
    p = the_panel(s, d).withColumn("rolling_3_inclusive", features.rolling_inclusive("shipment_count", 3, KEYS))
    return stats.leak_identity(features.build_features(p, breaks=BREAKS), "shipment_count")


@query("d25_medians", f"WITH {PANEL} SELECT port, median(shipment_count) AS median_count FROM panel GROUP BY 1", "median_count")
def _(s, d):
    return the_panel(s, d).groupBy("port").agg(F.median("shipment_count").alias("median_count"))


@query("d26_wavg", "SELECT o_orderpriority, sum(o_totalprice * o_custkey) FILTER (o_custkey > 0) / sum(o_custkey) FILTER (o_custkey > 0) AS w FROM orders GROUP BY 1", "w")
def _(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(x.wavg(F.col("o_totalprice"), F.col("o_custkey")).alias("w"))


@query("d32_label_dist", "SELECT event_type, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM events GROUP BY 1", "pct")
def _(s, d):
    return stats.label_dist(table(s, d, "events"), "event_type")


@query("d52_repair_rate", f"WITH {FEATURES} SELECT count(*) FILTER (lag_12 IS DISTINCT FROM lag_12_clean) AS n_repaired, 100 * avg(CAST(lag_12 IS DISTINCT FROM lag_12_clean AS INT)) AS pct_repaired FROM feats", "pct_repaired")
def _(s, d):
    return stats.repair_rate(the_features(s, d))


@query("d53_histogram", f"WITH {PANEL}, l AS (SELECT 'shipment_count' AS c, shipment_count::DOUBLE AS v FROM panel UNION ALL SELECT 'total_value_usd', total_value_usd FROM panel), e AS (SELECT c, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1) SELECT c AS \"column\", CAST(CASE WHEN hi > lo THEN least(20, floor((v - lo) / (hi - lo) * 20) + 1) ELSE 1 END AS INT) AS bin, count(*) AS n FROM l JOIN e USING (c) GROUP BY 1, 2")
def _(s, d):
    return stats.histogram(the_panel(s, d), ["shipment_count", "total_value_usd"], 20)


@query("d54_box_summary", f"WITH {PANEL}, q AS (SELECT port, count(*) AS n, quantile_cont(shipment_count, 0.25) AS q1, quantile_cont(shipment_count, 0.5) AS median, quantile_cont(shipment_count, 0.75) AS q3 FROM panel GROUP BY 1) SELECT port, any_value(n) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, min(shipment_count) AS whisker_low, max(shipment_count) AS whisker_high FROM panel JOIN q USING (port) WHERE shipment_count BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1", "q1 median q3")
def _(s, d):
    return stats.box_summary(the_panel(s, d), ["port"], "shipment_count")


# ---- E and H: features, index, models, forecasts -------------------------------------------------------------------

_FEATURE_SQL = {
    **{c: c for c in "lag_1 lag_2 lag_3 lag_12 lag_12_clean lag_value_12 lag_weight_12 rolling_3_mean rolling_12_mean rolling_value_12_mean yoy_growth yoy_value_growth yoy_growth_clean lag_12_is_break".split()},
    "season": "['Summer', 'Autumn', 'Winter', 'Spring'][(month % 12) // 3 + 1]", "quarter": "CAST((month - 1) // 3 + 1 AS DOUBLE)", "year_index": "CAST(year - 1995 AS INT)",
    "month_sin": "sin(2 * pi() * month / 12)", "month_cos": "cos(2 * pi() * month / 12)", "is_shock": "CAST(year = 1998 AS INT)", "is_rebound": "CAST(year = 1999 AS INT)", "is_aftershock": "CAST(year = 9999 AS INT)",
    "weight_per_shipment_mt": "coalesce(total_weight_mt, 0) / shipment_count", "avg_quantity_per_shipment": "total_quantity / shipment_count",
}
_PORT_SQL = {**_FEATURE_SQL, **{f"pct_{m}": f"cnt_{m} / shipment_count::DOUBLE" for m in ("general", "bulk", "refrigerated", "container")}}
_FEATURE_DOUBLES = "lag_value_12 lag_weight_12 rolling_3_mean rolling_12_mean rolling_value_12_mean yoy_growth yoy_value_growth yoy_growth_clean quarter month_sin month_cos weight_per_shipment_mt avg_quantity_per_shipment"
_PORT_DOUBLES = f"{_FEATURE_DOUBLES} pct_general pct_bulk pct_refrigerated pct_container"


@query("h1_features", f"WITH {FEATURES} SELECT {_PK}, {', '.join(f'{e} AS {c}' for c, e in _PORT_SQL.items())} FROM feats", _PORT_DOUBLES)
def _(s, d):
    return the_features(s, d).select(*KEYS, "year", "month", *_PORT_SQL)


#: The panel of a commodity at a port, and its features by the same rules as a port's.
COMMODITY = DECL + f""", cpanel AS (SELECT hs2, {_PK}, count(*) AS shipment_count, coalesce(sum(value_usd), 0) AS total_value_usd, coalesce(sum(weight_kg) / 1000, 0) AS total_weight_mt, coalesce(sum(quantity), 0) AS total_quantity,
    arg_min(hs6, (-n6, hs6)) FILTER (hs6 IS NOT NULL) AS dominant_description FROM (SELECT *, count(*) OVER (PARTITION BY hs2, {_PK}, hs6) AS n6 FROM decl) GROUP BY hs2, {_PK})"""
COMMODITY_FEATURES = COMMODITY + FEATURES[len(PANEL):].replace("FROM panel", "FROM cpanel").replace("PARTITION BY port, direction", "PARTITION BY hs2, port, direction")
CK = ["hs2", *KEYS]


def the_commodities(s, d) -> DataFrame:
    return panel.commodity_panel(declarations(s, d))


@query("h2_commodity_features", f"WITH {COMMODITY_FEATURES} SELECT hs2, {_PK}, total_value_usd / shipment_count AS avg_value_per_shipment_usd, {', '.join(f'{e} AS {c}' for c, e in _FEATURE_SQL.items())} FROM feats", f"{_FEATURE_DOUBLES} avg_value_per_shipment_usd")
def _(s, d):
    return features.build_features(the_commodities(s, d), CK, BREAKS, mix=()).select(*CK, "year", "month", "avg_value_per_shipment_usd", *_FEATURE_SQL)


_AVERAGES = ("yoy_growth", "yoy_value_growth", "shipment_count", "total_value_usd", "total_weight_mt", "commodity_diversity", "hs4_diversity", "country_diversity", "pct_general", "pct_bulk", "pct_refrigerated", "pct_container", "weight_per_shipment_mt", "avg_quantity_per_shipment")


@query("d12_trend_params", f"WITH {FEATURES} SELECT port, direction, CAST(max(year * 100 + month) // 100 AS INT) AS last_year, CAST(max(year * 100 + month) % 100 AS INT) AS last_month, {', '.join(f'avg({_PORT_SQL.get(c, c) if c != _AVERAGES[4] else f'coalesce({c}, 0)'}) AS avg_{c}' for c in _AVERAGES)}, count(*) AS n_obs FROM feats WHERE year >= 1996 GROUP BY 1, 2 HAVING count(*) >= 24", " ".join(f"avg_{c}" for c in _AVERAGES))
def _(s, d):
    f = the_features(s, d).withColumn("total_weight_mt", F.coalesce("total_weight_mt", F.lit(0.0)))
    return panel.trend_params(f, _AVERAGES, year_floor=1996)


@query("d12_trend_modes", f"WITH {DECL}, md AS (SELECT {_PK}, {', '.join(f'{c}.v AS {c}' for c in _MODES)} FROM (SELECT DISTINCT {_PK} FROM decl) {' '.join(f'LEFT JOIN {_mode_sql(of, chr(100) + chr(101) + chr(99) + chr(108), _PK)} {c} USING ({_PK})' for c, of in _MODES.items())}) SELECT port, direction, {', '.join(f'arg_min({c}, (-n_{c}, {c})) FILTER ({c} IS NOT NULL) AS {c}' for c in _MODES)} FROM (SELECT *, {', '.join(f'count(*) OVER (PARTITION BY port, direction, {c}) AS n_{c}' for c in _MODES)} FROM md) GROUP BY 1, 2 HAVING count(*) >= 24")
def _(s, d):
    return panel.trend_params(the_panel(s, d, _MODES), (), list(_MODES)).select(*KEYS, *_MODES)


@query("b9_year_filter", f"WITH {PANEL} SELECT {_PK}, shipment_count FROM panel WHERE year BETWEEN 1996 AND 1999")
def _(s, d):
    return panel.monthly_panel(declarations(s, d), cargo=CARGO, years=(1996, 1999)).select(*KEYS, "year", "month", "shipment_count")


@query("e11_largest_series", f"WITH {PANEL} SELECT port, direction, count(*) AS n_months, avg(shipment_count) AS avg_volume FROM panel GROUP BY 1, 2 HAVING count(*) >= 36 ORDER BY avg_volume DESC, port, direction LIMIT 12", "avg_volume")
def _(s, d):
    return panel.eligible_series(the_panel(s, d), largest=12)


@query("a18_overall", "SELECT 2::BIGINT AS n_tables, CAST((SELECT count(*) FROM orders WHERE o_orderstatus = 'P') > 0 AS BIGINT) AS n_different, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') = 0 AS all_same")
def _(s, d):
    o, n = table(s, d, "orders"), table(s, d, "nation")
    return tables.all_same(tables.reconcile({"orders": o, "nation": n}, {"orders": o.where("o_orderstatus <> 'P'"), "nation": n}))


@query("h5_trend_clean_lag", f"""WITH {FEATURES}, g AS (SELECT *, avg(CASE WHEN year < 1998 THEN shipment_count END) OVER (PARTITION BY port, direction, month) AS base, coalesce(median(CASE WHEN year NOT IN (1998, 1999) AND year - 1 NOT IN (1998, 1999) THEN yoy_growth END) OVER (PARTITION BY port, direction), 0.03) AS g FROM feats)
    SELECT {_PK}, CASE WHEN year - 1 IN (1998, 1999) AND base IS NOT NULL THEN greatest(1.0, base * pow(1 + least(0.15, greatest(-0.15, g)), year - 1 - 1997)) ELSE lag_12::DOUBLE END AS lag_12_trend, CASE WHEN year - 1 IN (1998, 1999) THEN g ELSE yoy_growth END AS growth_trend FROM g""", "lag_12_trend growth_trend")
def _(s, d):
    return features.trend_clean_lag(the_features(s, d), breaks=BREAKS).select(*KEYS, "year", "month", "lag_12_trend", "growth_trend")


@query("h6_congestion_index", f"WITH {INDEX} SELECT {_PK}, sc_norm, v_norm, w_norm, cd_norm, congestion_index, CASE WHEN congestion_index < 0.25 THEN 'Low' WHEN congestion_index < 0.5 THEN 'Moderate' WHEN congestion_index < 0.75 THEN 'High' ELSE 'Critical' END AS label FROM ci", "sc_norm v_norm w_norm cd_norm congestion_index")
def _(s, d):
    from .config import CONGESTION_CUTS

    df = the_index(s, d).withColumn("label", x.bin_label(F.col("congestion_index"), *CONGESTION_CUTS))
    return df.select(*KEYS, "year", "month", "sc_norm", "v_norm", "w_norm", "cd_norm", "congestion_index", "label")


@query("e9_latest_per_key", f"WITH {DECL}, p AS (SELECT {_CK}, count(*) AS shipment_count FROM decl GROUP BY {_CK}) SELECT hs2, arg_max(shipment_count, (year, month, shipment_count)) AS shipment_count FROM p GROUP BY 1")
def _(s, d):
    return features.latest_per_key(panel.commodity_panel(declarations(s, d)), ["hs2"], "shipment_count")


@query("e12_last_rows", f"WITH {PANEL} SELECT port, direction, year, month, shipment_count FROM panel QUALIFY row_number() OVER (PARTITION BY port, direction ORDER BY year DESC, month DESC) <= 12")
def _(s, d):
    return features.last_rows(the_panel(s, d), 12).select(*KEYS, "year", "month", "shipment_count")


@query("e13_acf", f"""WITH {PANEL}, z AS (SELECT port, direction, row_number() OVER (PARTITION BY port, direction ORDER BY year, month) AS i, shipment_count - avg(shipment_count) OVER (PARTITION BY port, direction) AS v FROM panel), q AS (SELECT port, direction, sum(v * v) AS q, count(*) AS n FROM z GROUP BY 1, 2)
    SELECT port, direction, CAST(k AS INT) AS lag, (SELECT sum(a.v * b.v) FROM z a JOIN z b ON a.port = b.port AND a.direction = b.direction AND b.i = a.i + k WHERE a.port = q.port AND a.direction = q.direction) / nullif(q, 0) AS acf FROM q, range(0, 37) r(k) WHERE k < n""", "acf")
def _(s, d):
    return features.acf(the_panel(s, d), "shipment_count")


_DENSE = f"WITH {PANEL}, r AS (SELECT port, direction, min(year * 12 + month - 1) AS a, max(year * 12 + month - 1) AS b FROM panel GROUP BY 1, 2), sp AS (SELECT port, direction, unnest(range(a, b + 1)) AS p FROM r) SELECT sp.port, sp.direction, CAST(p // 12 AS INT) AS year, CAST(p % 12 + 1 AS INT) AS month, shipment_count FROM sp LEFT JOIN panel x ON x.port = sp.port AND x.direction = sp.direction AND x.year = p // 12 AND x.month = p % 12 + 1"


@query("t1_densify", _DENSE)
def _(s, d):
    return panel.densify(the_panel(s, d)).select(*KEYS, "year", "month", "shipment_count")


@query("h9_eligible_series", f"WITH {PANEL} SELECT port, direction, count(*) AS n_months, avg(shipment_count) AS avg_volume FROM panel GROUP BY 1, 2 HAVING count(*) >= 36", "avg_volume")
def _(s, d):
    return panel.eligible_series(the_panel(s, d))


WALK = FEATURES + """, folds(train_end, fold_year) AS (VALUES (1998, 1999), (1999, 2000), (2000, 2001)), wf0 AS (SELECT feats.*, fold_year, year = fold_year AS is_test FROM feats JOIN folds ON year <= train_end OR year = fold_year),
    wf AS (SELECT * FROM wf0 QUALIFY sum(CAST(NOT is_test AS INT)) OVER (PARTITION BY port, direction, fold_year) >= 24 AND sum(CAST(is_test AS INT)) OVER (PARTITION BY port, direction, fold_year) > 0)"""
_NAIVE = "greatest(1.0, coalesce(lag_12_clean, 1) * (1 + coalesce(least(0.2, greatest(-0.2, yoy_growth_clean)), 0)))"
_FALLBACK = "greatest(1.0, coalesce(nullif(lag_12_clean, 0), nullif(rolling_12_mean, 0), 1) * (1 + coalesce(least(0.2, greatest(-0.2, yoy_growth_clean)), 0)))"
_ROLL = "greatest(1.0, coalesce(rolling_12_mean, 1.0))"
_EXPRESSIONS = {"naive": _NAIVE, "naive_fallback": _FALLBACK, "rolling": _ROLL}


def _predictions_sql(names, keys: str = "port, direction") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, fold_year, '{n}' AS model, shipment_count::DOUBLE AS y, {_EXPRESSIONS[n]} AS p FROM wf WHERE is_test" for n in names)


def _scores_sql(predictions: str, keys: str = "port, direction", panel_name: str = "panel", threshold: float = 15) -> str:
    """Scores of the predictions, mean scores, best model and hybrid selection."""
    same = " AND ".join(f"c.{k} = b.{k}" for k in keys.split(", "))
    return f""", preds AS ({predictions}),
    scores AS (SELECT {keys}, fold_year, model, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, 100 * avg(CASE WHEN y > 0 THEN abs(y - p) / y END) AS mape, CASE WHEN count(*) > 1 THEN 1 - sum((y - p) ** 2) / nullif(regr_sxx(y, y), 0) END AS r2, count(*) AS n FROM preds GROUP BY {keys}, fold_year, model),
    vol AS (SELECT {keys}, avg(shipment_count) AS avg_volume FROM {panel_name} GROUP BY {keys}),
    cv AS (SELECT {keys}, model, round(avg(mape), 9) AS m FROM scores GROUP BY {keys}, model), best AS (SELECT {keys}, arg_min(model, (m, model)) AS best_model, min(m) AS best_cv_mape FROM cv WHERE m IS NOT NULL GROUP BY {keys}),
    sel AS (SELECT {', '.join(f'b.{k}' for k in keys.split(', '))}, avg_volume, CASE WHEN avg_volume >= {threshold} THEN 'naive' ELSE best_model END AS selected_model, best_model, best_cv_mape, c.m AS baseline_cv_mape, CASE WHEN avg_volume >= {threshold} THEN c.m ELSE best_cv_mape END AS final_cv_mape FROM best b LEFT JOIN vol USING ({keys}) LEFT JOIN cv c ON {same} AND c.model = 'naive')"""


SCORES = WALK + _scores_sql(_predictions_sql(_EXPRESSIONS))


def the_scores(s, d, p: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = the_panel(s, d) if p is None else p
    folds = evaluate.walk_forward(features.build_features(p, breaks=BREAKS), FOLDS)
    found = evaluate.evaluate(folds, {"naive": evaluate.seasonal_naive(), "naive_fallback": evaluate.naive_with_fallback(), "rolling": evaluate.rolling_mean()})
    volumes = p.groupBy(*KEYS).agg(F.avg("shipment_count").alias("avg_volume"))
    return found, volumes, evaluate.select_hybrid(found, volumes, THRESHOLD)


@query("h13_walk_forward", f"WITH {WALK} SELECT fold_year, is_test, count(*) AS n, count(DISTINCT (port, direction)) AS n_series FROM wf GROUP BY 1, 2")
def _(s, d):
    return evaluate.walk_forward(the_features(s, d), FOLDS).groupBy("fold_year", "is_test").agg(F.count("*").alias("n"), F.count_distinct(F.struct(*KEYS)).alias("n_series"))


@query("h14_evaluate", f"WITH {SCORES} SELECT * FROM scores", "mae rmse mape r2")
def _(s, d):
    return the_scores(s, d)[0]


@query("h26_select_hybrid", f"WITH {SCORES} SELECT * FROM sel", "avg_volume best_cv_mape baseline_cv_mape final_cv_mape")
def _(s, d):
    return the_scores(s, d)[2]


@query("d27_summarise", f"WITH {SCORES} SELECT model, fold_year, count(DISTINCT (port, direction)) AS n_series, {', '.join(f'sum({m} * avg_volume) FILTER ({m} IS NOT NULL) / sum(avg_volume) FILTER ({m} IS NOT NULL) AS w{m}' for m in ('mae', 'rmse', 'mape', 'r2'))} FROM scores JOIN vol USING (port, direction) GROUP BY 1, 2", "wmae wrmse wmape wr2")
def _(s, d):
    found, volumes, _sel = the_scores(s, d)
    return stats.summarise(found.join(volumes, KEYS))


@query("d29_pivot_scores", f"WITH {SCORES} SELECT port, direction, {', '.join(f'avg(mape) FILTER (model = {chr(39)}{m}{chr(39)}) AS {m}' for m in ('naive', 'naive_fallback', 'rolling'))} FROM scores GROUP BY 1, 2", "naive naive_fallback rolling")
def _(s, d):
    return stats.pivot_scores(the_scores(s, d)[0], KEYS, "model", ["naive", "naive_fallback", "rolling"], "mape")


@query("d30_head_to_head", f"WITH {SCORES}, j AS (SELECT a.mape AS ma, b.mape AS mb FROM scores a JOIN scores b USING (port, direction, fold_year) WHERE a.model = 'naive' AND b.model = 'rolling' AND a.mape IS NOT NULL AND b.mape IS NOT NULL) SELECT count(*) AS n, avg(CAST(ma < mb AS INT)) AS win_rate, median(ma - mb) AS median_gap, avg(ma - mb) AS mean_gap, count(*) FILTER (ma < mb) AS wins, count(*) FILTER (ma > mb) AS losses FROM j", "win_rate median_gap mean_gap")
def _(s, d):
    return stats.head_to_head(the_scores(s, d)[0], "naive", "rolling", [*KEYS, "fold_year"])


@query("d33_residuals", f"WITH {SCORES} SELECT avg(y - p) AS mean, stddev_pop(y - p) AS std, count(*) AS n, abs(avg(y - p)) < 0.1 * stddev_pop(y - p) AS unbiased FROM preds WHERE model = 'naive'", "mean std")
def _(s, d):
    folds = evaluate.walk_forward(the_features(s, d), FOLDS).where("is_test")
    return stats.residual_stats(folds.select(F.col("shipment_count").cast("double").alias("y"), evaluate.seasonal_naive().alias("prediction")))


@query("h28_compare_strategies", f"WITH {SCORES}, r AS (SELECT scores.*, avg_volume, selected_model FROM scores JOIN sel USING (port, direction) WHERE fold_year = 2001), e AS (SELECT *, model AS strategy FROM r UNION ALL SELECT *, 'hybrid' FROM r WHERE model = selected_model) SELECT strategy, count(*) AS n_series, sum(mape * avg_volume) FILTER (mape IS NOT NULL) / sum(avg_volume) FILTER (mape IS NOT NULL) AS wmape FROM e GROUP BY 1", "wmape")
def _(s, d):
    found, _v, sel = the_scores(s, d)
    return evaluate.compare_strategies(found, sel, 2001)


@query("c12_improvement", f"WITH {SCORES} SELECT port, direction, a.mape AS selected_mape, b.mape AS baseline_mape, b.mape - a.mape AS gain FROM sel JOIN scores a USING (port, direction) JOIN scores b USING (port, direction) WHERE a.model = selected_model AND b.model = 'naive' AND a.fold_year = 2001 AND b.fold_year = 2001", "selected_mape baseline_mape gain")
def _(s, d):
    found, _v, sel = the_scores(s, d)
    return evaluate.improvement(found, sel, 2001)


@query("c13_compare_metrics", f"WITH {SCORES}, a AS (SELECT port, direction, mape FROM scores WHERE model = 'naive' AND fold_year = 1999), b AS (SELECT port, direction, mape FROM scores WHERE model = 'naive' AND fold_year = 2001) SELECT port, direction, a.mape AS left_value, b.mape AS right_value, b.mape - a.mape AS delta FROM a FULL JOIN b USING (port, direction)", "left_value right_value delta")
def _(s, d):
    found = the_scores(s, d)[0].where("model = 'naive'")
    return evaluate.compare_metrics(found.where("fold_year = 1999"), found.where("fold_year = 2001"), KEYS)


@query("h29_winner", f"WITH {SCORES}, w AS (SELECT model, sum(mape * avg_volume) FILTER (mape IS NOT NULL) / sum(avg_volume) FILTER (mape IS NOT NULL) AS wmape FROM scores JOIN vol USING (port, direction) WHERE fold_year = 2001 GROUP BY 1) SELECT arg_min(model, (wmape, model)) AS winner, min(wmape) AS wmape FROM w", "wmape")
def _(s, d):
    found, volumes, _sel = the_scores(s, d)
    return evaluate.winner(found.join(volumes, KEYS), 2001)


_BOARD = "SELECT model, round(sum(mape * avg_volume) FILTER (mape IS NOT NULL) / sum(avg_volume) FILTER (mape IS NOT NULL) + 1e-9, 2) AS wmape, round(sum(mae * avg_volume) FILTER (mae IS NOT NULL) / sum(avg_volume) FILTER (mae IS NOT NULL) + 1e-9, 0) AS wmae, round(sum(r2 * avg_volume) FILTER (r2 IS NOT NULL) / sum(avg_volume) FILTER (r2 IS NOT NULL) + 1e-9, 3) AS wr2, count(DISTINCT (port, direction)) AS n_series FROM scores JOIN vol USING (port, direction)"


@query("d28_leaderboard", f"WITH {SCORES} {_BOARD} GROUP BY 1", "wmape wmae wr2")
def _(s, d):
    found, volumes, _sel = the_scores(s, d)
    return stats.leaderboard(found.join(volumes, KEYS))


@query("d28_leaderboard_fold", f"WITH {SCORES} {_BOARD} WHERE fold_year = 2001 GROUP BY 1", "wmape wmae wr2")
def _(s, d):
    found, volumes, _sel = the_scores(s, d)
    return stats.leaderboard(found.join(volumes, KEYS), 2001)


@query("h27_best_model", f"WITH {SCORES} SELECT port, direction, best_model, best_cv_mape FROM best", "best_cv_mape")
def _(s, d):
    return evaluate.best_model(the_scores(s, d)[0])


@query("h28_strategy_gain", f"WITH {SCORES}, g AS (SELECT avg_volume, a.mape AS sm, b.mape AS bm FROM sel JOIN scores a USING (port, direction) JOIN scores b USING (port, direction) WHERE a.model = selected_model AND b.model = 'naive' AND a.fold_year = 2001 AND b.fold_year = 2001), t AS (SELECT sum(bm * avg_volume) FILTER (bm IS NOT NULL) / sum(avg_volume) FILTER (bm IS NOT NULL) AS baseline_wmape, sum(sm * avg_volume) FILTER (sm IS NOT NULL) / sum(avg_volume) FILTER (sm IS NOT NULL) AS hybrid_wmape, count(*) FILTER (bm - sm > 0) AS n_improved, count(*) AS n_series, median(bm - sm) AS median_gain FROM g) SELECT *, baseline_wmape - hybrid_wmape AS gain_pp FROM t", "baseline_wmape hybrid_wmape median_gain gain_pp")
def _(s, d):
    found, _v, sel = the_scores(s, d)
    return evaluate.strategy_gain(found, sel, 2001)


@query("c19_default_model", f"WITH {SCORES} SELECT p.port, p.direction, coalesce(CASE WHEN avg_volume < 15 THEN selected_model END, 'naive') AS selected_model FROM (SELECT DISTINCT port, direction FROM panel) p LEFT JOIN sel USING (port, direction)")
def _(s, d):
    p = the_panel(s, d)
    small = the_scores(s, d, p)[2].where(F.col("avg_volume") < THRESHOLD)
    return evaluate.with_default(p.select(*KEYS).distinct(), small, KEYS, "selected_model", "naive")


@query("f4_both_ends", f"WITH {SCORES}, r AS (SELECT port, direction, mape, row_number() OVER (ORDER BY round(mape, 9) DESC, port, direction) AS a, row_number() OVER (ORDER BY round(mape, 9), port, direction) AS b FROM scores WHERE model = 'naive' AND fold_year = 2001 AND mape IS NOT NULL) SELECT port, direction, mape, 'largest' AS side FROM r WHERE a <= 8 UNION ALL SELECT port, direction, mape, 'smallest' FROM r WHERE b <= 8", "mape")
def _(s, d):
    rows = the_scores(s, d)[0].where("model = 'naive' and fold_year = 2001").select(*KEYS, F.round("mape", 9).alias("mape"))
    return marts.both_ends(rows, "mape", 8, *KEYS)


_FEATURE_LIST = tuple(c for c in PORT_FEATURES)
_PAIRS = ", ".join(f"{{'a': {i}, 'b': {j}, 'r': corr(x{i}, x{j})}}" for j in range(len(_FEATURE_LIST)) for i in range(j))


@query("h11_select_features", f"WITH {FEATURES}, named AS (SELECT year, {', '.join(f'{ {**{c: c for c in PORT_FEATURES}, **_PORT_SQL}[c]} AS n_{c}' for c in _FEATURE_LIST)} FROM feats), x AS (SELECT {', '.join(f'coalesce(n_{c}, 0)::DOUBLE AS x{i}' for i, c in enumerate(_FEATURE_LIST))} FROM named WHERE year <= 1999), pairs AS (SELECT unnest([{_PAIRS}]) AS p FROM x), dropped AS (SELECT DISTINCT p.b AS pos FROM pairs WHERE NOT isnan(p.r) AND abs(p.r) > 0.95) SELECT CAST(pos AS INT) AS pos, feature FROM (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(_FEATURE_LIST))}) f(pos, feature) WHERE pos NOT IN (SELECT pos FROM dropped)")
def _(s, d):
    f = tables.stored(the_features(s, d).where("year <= 1999").select(*_FEATURE_LIST), "features")  # the correlations make several jobs
    kept = stats.select_features(f, _FEATURE_LIST)
    return s.createDataFrame([(i, c) for i, c in enumerate(_FEATURE_LIST) if c in kept], "pos int, feature string")


PARAMS = FEATURES + """, params AS (SELECT port, direction, max(year * 100 + month) // 100 AS ly, max(year * 100 + month) % 100 AS lm, avg(shipment_count) AS a, avg(total_value_usd) AS b, avg(yoy_growth) AS g FROM feats GROUP BY 1, 2 HAVING count(*) >= 24),
    sm AS (SELECT port, direction, month, avg(shipment_count) AS a, avg(total_value_usd) AS b FROM panel GROUP BY 1, 2, 3), si AS (SELECT port, direction, month, a / avg(a) OVER w AS fa, b / avg(b) OVER w AS fb FROM sm WINDOW w AS (PARTITION BY port, direction)),
    grid AS (SELECT params.*, CAST(k AS INT) AS step, CAST((ly * 12 + lm - 1 + k) // 12 AS INT) AS year, CAST((ly * 12 + lm - 1 + k) % 12 + 1 AS INT) AS month, least(0.4, greatest(-0.3, coalesce(nullif(g, 0), 0.025))) AS growth FROM params, range(1, 13) r(k)),
    fc AS (SELECT grid.port, grid.direction, year, grid.month, step, growth, grid.a * coalesce(fa, 1) * pow(1 + growth, step / 12.0) AS pred_shipment_count, grid.b * coalesce(fb, 1) * pow(1 + growth, step / 12.0) AS pred_total_value_usd FROM grid LEFT JOIN si ON si.port = grid.port AND si.direction = grid.direction AND si.month = grid.month)"""


def the_forecast(s, d, p: DataFrame | None = None) -> DataFrame:
    p = the_panel(s, d) if p is None else p
    params = panel.trend_params(features.build_features(p, breaks=BREAKS), ["shipment_count", "total_value_usd", "yoy_growth"])
    seasonal = panel.seasonal_index(p, KEYS, ["shipment_count", "total_value_usd"])
    return forecast.seasonal_trend_forecast(params, seasonal, {"shipment_count": "factor_shipment_count", "total_value_usd": "factor_total_value_usd"}, "avg_yoy_growth")


@query("h7_seasonal_trend_forecast", f"WITH {PARAMS} SELECT * FROM fc", "growth pred_shipment_count pred_total_value_usd")
def _(s, d):
    return the_forecast(s, d)


_PORT_PROFILE = {c: _PORT_SQL.get(c, c) for c in forecast.PROFILE}
_GROWN = "pow(1 + least(0.4, greatest(-0.3, coalesce(nullif({}, 0), 0.025))), k / 12.0)"
PORT_FORECAST = INDEX + f""", md AS (SELECT {_PK}, {', '.join(f'{c}.v AS {c}' for c in forecast.PROFILE_MODES)} FROM (SELECT DISTINCT {_PK} FROM decl) {' '.join(f"LEFT JOIN {_mode_sql(_MODES[c], 'decl', _PK)} {c} USING ({_PK})" for c in forecast.PROFILE_MODES)}),
    recent AS (SELECT ci.*, {', '.join(f'count(*) OVER (PARTITION BY port, direction, {c}) AS n_{c}, {c}' for c in forecast.PROFILE_MODES)} FROM ci JOIN md USING ({_PK}) WHERE year >= 1997),
    lastp AS (SELECT port, direction, max(year * 100 + month) // 100 AS ly, max(year * 100 + month) % 100 AS lm FROM ci GROUP BY 1, 2),
    pp AS (SELECT port, direction, avg(yoy_growth) FILTER (lag_12 > 0) AS g, avg(yoy_value_growth) AS gv, avg(shipment_count) AS a_n, avg(total_value_usd) AS a_v, avg(coalesce(total_weight_mt, 0)) AS a_w, avg(total_quantity / shipment_count) AS a_q,
        {', '.join(f'avg({e}) AS avg_{c}' for c, e in _PORT_PROFILE.items())}, {', '.join(f'arg_min({c}, (-n_{c}, {c})) FILTER ({c} IS NOT NULL) AS {c}' for c in forecast.PROFILE_MODES)} FROM recent GROUP BY 1, 2 HAVING count(*) >= 24),
    s0 AS (SELECT port, direction, month, avg(shipment_count) AS a, avg(coalesce(total_weight_mt, 0)) AS b, avg(congestion_index) AS h FROM ci WHERE year >= 1996 GROUP BY 1, 2, 3),
    s1 AS (SELECT port, direction, month, a / nullif(avg(a) OVER w, 0) AS fa, b / nullif(avg(b) OVER w, 0) AS fb, h FROM s0 WINDOW w AS (PARTITION BY port, direction)),
    pg AS (SELECT pp.*, k, CAST((ly * 12 + lm - 1 + k) // 12 AS INT) AS year, CAST((ly * 12 + lm - 1 + k) % 12 + 1 AS INT) AS month FROM pp JOIN lastp USING (port, direction), range(1, 13) r(k)),
    pf AS (SELECT pg.*, least(3.0, greatest(0.1, coalesce(fa, 1.0))) AS sn, least(3.0, greatest(0.1, coalesce(fb, 1.0))) AS sw, coalesce(h, 0.35) AS h, {_GROWN.format('g')} AS xn, {_GROWN.format('gv')} AS xv FROM pg LEFT JOIN s1 USING (port, direction, month)),
    pi AS (SELECT *, least(1.0, greatest(0.0, h * least(1.5, greatest(0.5, sn)) * least(1.1, greatest(0.95, xn)))) AS i FROM pf)"""


@query("h7_port_forecast", f"""WITH {PORT_FORECAST} SELECT port, direction, year, month, ['Summer', 'Autumn', 'Winter', 'Spring'][(month % 12) // 3 + 1] AS season, CAST(greatest(1, round_even(a_n * sn * xn, 0)) AS INT) AS pred_shipment_count, CASE WHEN direction = 'export' THEN a_w * sw * xv END AS pred_weight_mt,
    a_q * a_n * sn * xn AS pred_total_quantity, a_v * sn * xv AS pred_value_usd, i AS congestion_index, CASE WHEN i < 0.25 THEN 'Low' WHEN i < 0.5 THEN 'Moderate' WHEN i < 0.75 THEN 'High' ELSE 'Critical' END AS congestion_label, {', '.join(f'avg_{c}' for c in forecast.PROFILE)}, {', '.join(forecast.PROFILE_MODES)} FROM pi""",
    "pred_weight_mt pred_total_quantity pred_value_usd congestion_index " + " ".join(f"avg_{c}" for c in forecast.PROFILE), 3)
def _(s, d):
    indexed = tables.stored(the_index(s, d, forecast.PROFILE_MODES), "index")
    return forecast.port_forecast(forecast.port_params(indexed, year_floor=1997), forecast.port_seasons(indexed, year_floor=1996), digits=False)


@query("k8_forecast_index", f"WITH {PARAMS}, h AS (SELECT port, direction, min(shipment_count) AS lo, max(shipment_count) AS hi FROM panel GROUP BY 1, 2) SELECT fc.port, fc.direction, year, month, least(1.0, greatest(0.0, (pred_shipment_count - lo) / nullif(hi - lo, 0))) AS hist_index, pred_shipment_count >= hi AS at_or_above_hist_peak FROM fc JOIN h ON h.port = fc.port AND h.direction = fc.direction", "hist_index")
def _(s, d):
    p = the_panel(s, d)
    return forecast.forecast_index(the_forecast(s, d, p), p, "pred_shipment_count", "shipment_count").select(*KEYS, "year", "month", "hist_index", "at_or_above_hist_peak")


#: The recursion is run step by step: a month takes the latest value of its kind, or the mean of all rows so far.
_SEED = """, sd AS (SELECT * FROM feats WHERE year < 2001 QUALIFY CASE WHEN max(CAST(year = 2000 AS INT)) OVER (PARTITION BY port, direction) = 1 THEN year = 2000 ELSE row_number() OVER (PARTITION BY port, direction ORDER BY year DESC, month DESC) <= 12 END),
    seed AS (SELECT port, direction, list(shipment_count::DOUBLE ORDER BY year, month) AS v, list(month::INT ORDER BY year, month) AS m, max(year * 12 + month - 1) AS p, coalesce(least(0.15, greatest(-0.15, coalesce(median(yoy_growth_clean) FILTER (year NOT IN (1998, 1999)), CASE WHEN count(*) FILTER (year NOT IN (1998, 1999)) = 0 THEN median(yoy_growth_clean) END))), 0) AS g FROM sd GROUP BY 1, 2)"""
_SAME = "coalesce(v[len(m) - list_position(list_reverse(m), CAST((p + 1) % 12 + 1 AS INT)) + 1], list_avg(v))"
RECURSE = "RECURSIVE " + FEATURES + _SEED + f""",
    steps AS (SELECT port, direction, v, m, p, g, 0 AS i FROM seed UNION ALL SELECT port, direction,
        list_append(v, greatest(1.0, {_SAME} * (1 + g))), list_append(m, CAST((p + 1) % 12 + 1 AS INT)), p + 1, g, i + 1 FROM steps WHERE i < 12),
    rec AS (SELECT port, direction, CAST(p // 12 AS INT) AS year, CAST(p % 12 + 1 AS INT) AS month, v[-1] AS prediction FROM steps WHERE i > 0)"""


def the_recursion(s, d, p: DataFrame | None = None) -> DataFrame:
    f = the_features(s, d) if p is None else features.build_features(p, breaks=BREAKS)
    return forecast.recursive_naive(f, 2001, clean_years=[y for y in range(BREAKS.base_year, 2001) if y not in BREAKS.years])


@query("h30_recursive_naive", f"WITH {RECURSE} SELECT * FROM rec", "prediction")
def _(s, d):
    return the_recursion(s, d)


@query("h32_published", f"WITH {RECURSE} SELECT year, month, port, direction, prediction AS pred_shipment_count, 'naive' AS model, CAST(round_even(prediction, 0) AS INT) AS forecast_shipments FROM rec", "pred_shipment_count")
def _(s, d):
    return forecast.published(the_recursion(s, d), F.lit("naive")).drop("created_at")


@query("h33_forecast_totals", f"WITH {RECURSE} SELECT direction, sum(prediction) AS total FROM rec GROUP BY 1", "total")
def _(s, d):
    return forecast.forecast_totals(the_recursion(s, d))


@query("d22_annual_growth", f"WITH {RECURSE}, a AS (SELECT direction, CAST(sum(shipment_count) AS BIGINT) AS actual FROM panel WHERE year = 2000 GROUP BY 1), f AS (SELECT direction, sum(prediction) AS forecast FROM rec GROUP BY 1) SELECT direction, forecast, actual, 100 * (forecast - actual) / nullif(actual, 0) AS growth_pct FROM f FULL JOIN a USING (direction)", "forecast growth_pct")
def _(s, d):
    p = the_panel(s, d)
    return forecast.annual_growth(p, the_recursion(s, d, p), 2000)


@query("h34_forecast_all", f"WITH {RECURSE}{PARAMS[len(FEATURES):]}, every AS (SELECT 'naive' AS model, port, direction, prediction FROM rec UNION ALL SELECT 'trend', port, direction, pred_shipment_count FROM fc) SELECT model, sum(prediction) FILTER (direction = 'import') AS import, sum(prediction) FILTER (direction = 'export') AS export, coalesce(sum(prediction) FILTER (direction = 'import'), 0) + coalesce(sum(prediction) FILTER (direction = 'export'), 0) AS total FROM every GROUP BY 1", "import export total")
def _(s, d):
    p = the_panel(s, d)
    every = forecast.forecast_all({"naive": the_recursion(s, d, p), "trend": the_forecast(s, d, p).withColumnRenamed("pred_shipment_count", "prediction")})
    return forecast.totals_by_model(every)


_CM = ("total_value_usd", "total_weight_mt", "shipment_count")
COMMODITY_FORECAST = COMMODITY + f""", lagged AS (SELECT *, {', '.join(f'lag({m}, 12) OVER w AS b_{m}' for m in _CM)}, lag(year, 12) OVER w AS there FROM cpanel WINDOW w AS (PARTITION BY hs2, port, direction ORDER BY year, month)),
    labels AS (SELECT hs2, port, direction, arg_min(dominant_description, (-n, dominant_description)) AS dominant_description FROM (SELECT hs2, port, direction, dominant_description, count(*) AS n FROM lagged WHERE there IS NOT NULL AND dominant_description IS NOT NULL GROUP BY ALL) GROUP BY 1, 2, 3),
    cparams AS (SELECT hs2, port, direction, max(year * 100 + month) // 100 AS ly, max(year * 100 + month) % 100 AS lm, count(there) AS n_obs, {', '.join(f'avg({m}) FILTER (there IS NOT NULL) AS a_{m}, avg({m} / b_{m}::DOUBLE - 1) FILTER (b_{m} > 0) AS g_{m}' for m in _CM)} FROM lagged GROUP BY 1, 2, 3 HAVING count(there) >= 48),
    cm AS (SELECT hs2, port, direction, month, avg(total_value_usd) AS a, avg(total_weight_mt) AS b FROM cpanel GROUP BY 1, 2, 3, 4), cs AS (SELECT hs2, port, direction, month, a / nullif(avg(a) OVER w, 0) AS fa, b / nullif(avg(b) OVER w, 0) AS fb FROM cm WINDOW w AS (PARTITION BY hs2, port, direction)),
    cgrid AS (SELECT p.*, k, CAST((ly * 12 + lm - 1 + k) // 12 AS INT) AS year, CAST((ly * 12 + lm - 1 + k) % 12 + 1 AS INT) AS month FROM cparams p, range(1, 13) r(k)),
    cf AS (SELECT g.*, least(3.0, greatest(0.1, coalesce(fa, 1.0))) AS sv, least(3.0, greatest(0.1, coalesce(fb, 1.0))) AS sw FROM cgrid g LEFT JOIN cs USING (hs2, port, direction, month)),
    cfc AS (SELECT cf.hs2, cf.port, cf.direction, year, month, ['Summer', 'Autumn', 'Winter', 'Spring'][(month % 12) // 3 + 1] AS season, {', '.join(f'a_{m} * {f} * pow(1 + least(0.4, greatest(-0.3, coalesce(nullif(g_{m}, 0), 0.025))), k / 12.0) AS x_{m}' for m, f in zip(_CM, ('sv', 'sw', 'sv')))}, sv, dominant_description, n_obs FROM cf LEFT JOIN labels USING (hs2, port, direction)),
    cout AS (SELECT hs2, port, direction, year, month, season, round(x_total_value_usd, 2) AS pred_value_usd, round(x_total_weight_mt, 2) AS pred_weight_mt, CAST(greatest(1, round(x_shipment_count)) AS INT) AS pred_shipment_count, round(least(1.0, greatest(0.0, (sv - 0.1) / 2.9)), 4) AS season_activity_index,
        CASE WHEN sv < 0.9 THEN 'Low Season' WHEN sv < 1.3 THEN 'Normal' ELSE 'High Season' END AS season_label, dominant_description, n_obs AS historical_months FROM cfc)"""


def _label_of(p: DataFrame) -> str | None:
    return "dominant_description" if "dominant_description" in p.columns else None


def the_commodity_forecast(s, d, p: DataFrame | None = None) -> DataFrame:
    p = tables.stored(the_commodities(s, d), "commodities") if p is None else p
    return forecast.commodity_forecast(panel.series_params(p, _CM, label=_label_of(p)), panel.seasonal_index(p, CK, _CM[:2]))


@query("h8_commodity_forecast", f"WITH {COMMODITY_FORECAST} SELECT * REPLACE (round(pred_value_usd, 0) AS pred_value_usd, round(pred_weight_mt, 1) AS pred_weight_mt) FROM cout", "season_activity_index pred_value_usd pred_weight_mt")
def _(s, d):
    return the_commodity_forecast(s, d).withColumns({"pred_value_usd": F.round("pred_value_usd", 0), "pred_weight_mt": F.round("pred_weight_mt", 1)})


@query("h31_active_commodities", f"WITH {COMMODITY_FORECAST}, act AS (SELECT DISTINCT hs2, port, direction FROM cpanel WHERE year * 12 + month >= 2001 * 12 + 10), ld AS (SELECT hs2, port, direction, arg_max(dominant_description, (year, month, dominant_description)) AS latest FROM cpanel GROUP BY 1, 2, 3) SELECT hs2, port, direction, year, month, pred_shipment_count, latest AS description FROM cout SEMI JOIN act USING (hs2, port, direction) LEFT JOIN ld USING (hs2, port, direction)")
def _(s, d):
    p = tables.stored(the_commodities(s, d), "commodities")
    found = the_commodity_forecast(s, d, p).drop("dominant_description").join(forecast.active_series(p, 2001, month=10), CK, "left_semi")
    return evaluate.with_descriptions(found, p).select(*CK, "year", "month", "pred_shipment_count", F.col("dominant_description").alias("description"))


@query("d49_top_commodities", f"WITH {COMMODITY_FORECAST}, t AS (SELECT port, hs2, sum(pred_shipment_count) AS total FROM cout GROUP BY 1, 2) SELECT port, hs2, CAST(total AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY port ORDER BY total DESC, hs2) AS INT) AS rank FROM t QUALIFY rank <= 8")
def _(s, d):
    p = tables.stored(the_commodities(s, d).drop("dominant_description"), "commodities")  # descriptions are counted over all rows, and nobody reads them
    return marts.top_commodities(the_commodity_forecast(s, d, p))


@query("f2_by_computed", f"WITH {COMMODITY_FORECAST} SELECT hs2, port, direction, n_obs, a_total_value_usd AS avg_total_value_usd FROM cparams ORDER BY round(a_total_value_usd * n_obs, 2) DESC, hs2, port, direction LIMIT 25", "avg_total_value_usd", 2)
def _(s, d):
    params = panel.series_params(the_commodities(s, d), _CM)
    return marts.top_rows(params, F.round(F.col("avg_total_value_usd") * F.col("n_obs"), 2), 25, *CK).select(*CK, "n_obs", "avg_total_value_usd")


@query("f6_first_in_rank", f"WITH {PANEL} SELECT port, year, month, shipment_count, CAST(row_number() OVER (PARTITION BY port ORDER BY shipment_count DESC, year, month, direction) AS INT) AS rank FROM panel QUALIFY rank <= 10")
def _(s, d):
    return marts.first_in_rank(the_panel(s, d), ["port"], "shipment_count", 10, "year", "month", "direction").select("port", "year", "month", "shipment_count", "rank")


@query("g6_year_sets", "SELECT CAST(year(l_shipdate) AS INT) AS year FROM lineitem EXCEPT SELECT * FROM (VALUES (1998), (1999)) b(year) INTERSECT SELECT CAST(year(o_orderdate) AS INT) FROM orders")
def _(s, d):
    shipped = table(s, d, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    ordered = table(s, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    breaks = shipped.where(F.col("year").isin(*BREAKS.years)).intersect(ordered)
    return shipped.exceptAll(breaks)


@query("h10_single_series", f"WITH {PANEL} SELECT year, month, shipment_count FROM panel WHERE port = 'CHINA' AND direction = 'import' OR port = 'NATION_3' AND direction = 'import'")
def _(s, d):
    return panel.single_series(the_panel(s, d).where("port in ('CHINA', 'NATION_3')"), direction="import").select("year", "month", "shipment_count")


_RIDGE = ("lag_12_clean", "rolling_12_mean")


@query("j5_per_series_ridge", f"""WITH {WALK}, g AS (SELECT port, direction, fold_year, count(*)::DOUBLE AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x1, x2) AS c12 FROM (SELECT port, direction, fold_year, is_test, coalesce(lag_12_clean, 0)::DOUBLE AS x1, coalesce(rolling_12_mean, 0) AS x2, shipment_count::DOUBLE AS y FROM wf) WHERE NOT is_test GROUP BY 1, 2, 3),
    z AS (SELECT *, (n + 1.0) * (n + 1.0) - (n * c12 / (s1 * s2)) ** 2 AS det, n * c1 / s1 AS b1, n * c2 / s2 AS b2, n * c12 / (s1 * s2) AS a12 FROM g WHERE s1 > 0 AND s2 > 0),
    w AS (SELECT *, ((n + 1.0) * b1 - a12 * b2) / det / s1 AS k1, ((n + 1.0) * b2 - a12 * b1) / det / s2 AS k2 FROM z)
    SELECT port, direction, fold_year, year, month, greatest(1.0, my + k1 * (coalesce(lag_12_clean, 0) - m1) + k2 * (coalesce(rolling_12_mean, 0) - m2)) AS prediction FROM wf JOIN w USING (port, direction, fold_year) WHERE is_test""", "prediction", 3)
def _(s, d):
    folds = evaluate.walk_forward(the_features(s, d), FOLDS)
    return models.SeriesRidge(_RIDGE, 1.0, (*KEYS, "fold_year")).fit(folds.where("not is_test")).transform(folds.where("is_test")).select(*KEYS, "fold_year", "year", "month", "prediction")


@query("h30_recursive_linear", f"""WITH RECURSIVE {PANEL}, h AS (SELECT port, direction, list(shipment_count::DOUBLE ORDER BY year, month) AS v, max(year * 100 + month) AS lp FROM panel GROUP BY 1, 2 HAVING count(*) >= 3),
    r AS (SELECT port, direction, lp, v[-3:] AS v, 0 AS i FROM h UNION ALL SELECT port, direction, lp, list_append(v, greatest(1.0, 1.0 + 0.5 * v[-1] + 0.3 * v[-2] + 0.1 * v[-3])), i + 1 FROM r WHERE i < 12)
    SELECT port, direction, CAST(((lp // 100) * 12 + lp % 100 - 1 + i) // 12 AS INT) AS year, CAST(((lp // 100) * 12 + lp % 100 - 1 + i) % 12 + 1 AS INT) AS month, v[-1] AS prediction FROM r WHERE i > 0""", "prediction", 7)
def _(s, d):
    return forecast.recursive_linear(the_panel(s, d), (0.5, 0.3, 0.1), 1.0)


@query("h37_decompose", f"""WITH {PANEL}, t AS (SELECT port, direction, year, month, shipment_count::DOUBLE AS value, CASE WHEN count(*) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN (sum(shipment_count) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(shipment_count, 6) OVER w + lead(shipment_count, 6) OVER w) / 2.0) / 12 END AS trend FROM panel WINDOW w AS (PARTITION BY port, direction ORDER BY year, month)),
    u AS (SELECT *, avg(value - trend) OVER (PARTITION BY port, direction, month) AS s0 FROM t), v AS (SELECT *, s0 - avg(s0) OVER (PARTITION BY port, direction) AS season FROM u) SELECT port, direction, year, month, value, trend, season, value - trend - season AS remainder FROM v""", "value trend season remainder")
def _(s, d):
    return stats.decompose(the_panel(s, d), "shipment_count")


@query("h38_df_test", f"""WITH {PANEL}, l AS (SELECT port, direction, lag(shipment_count) OVER (PARTITION BY port, direction ORDER BY year, month)::DOUBLE AS v, shipment_count::DOUBLE AS now FROM panel), z AS (SELECT port, direction, v, now - v AS dy FROM l WHERE v IS NOT NULL),
    g AS (SELECT port, direction, count(*) AS n, regr_slope(dy, v) AS b, regr_sxx(dy, v) AS sxx, regr_syy(dy, v) AS syy, regr_sxy(dy, v) AS sxy FROM z GROUP BY 1, 2) SELECT port, direction, n, b / nullif(sqrt((syy - b * sxy) / (n - 2) / nullif(sxx, 0)), 0) AS t_stat, b / nullif(sqrt((syy - b * sxy) / (n - 2) / nullif(sxx, 0)), 0) < -2.86 AS stationary FROM g WHERE n > 3""", "t_stat")
def _(s, d):
    return stats.df_test(the_panel(s, d), "shipment_count")


_INNER = """v AS (SELECT *, CASE WHEN CY0 < CY1 THEN CY1 END AS vy, row_number() OVER (PARTITION BY port, direction, fold_year ORDER BY is_test, year DESC, month DESC) AS b FROM wf)""".replace("CY0", "min(CASE WHEN NOT is_test AND year NOT IN (1998, 1999) THEN year END) OVER (PARTITION BY port, direction, fold_year)").replace("CY1", "max(CASE WHEN NOT is_test AND year NOT IN (1998, 1999) THEN year END) OVER (PARTITION BY port, direction, fold_year)")


@query("h15_inner_validation", f"WITH {WALK}, {_INNER} SELECT fold_year, year, count(*) FILTER (NOT is_test AND coalesce(year < vy, b > 12)) AS n_train, count(*) FILTER (NOT is_test AND coalesce(year = vy, b <= 12)) AS n_valid, count(*) AS n FROM v GROUP BY 1, 2")
def _(s, d):
    rows = evaluate.inner_validation(evaluate.walk_forward(the_features(s, d), FOLDS), BREAKS.years)
    return rows.groupBy("fold_year", "year").agg(F.count_if("is_train").alias("n_train"), F.count_if("is_valid").alias("n_valid"), F.count("*").alias("n"))


@query("h12_sample_weight", f"WITH {PANEL} SELECT year, sum(CASE year WHEN 1998 THEN 0.1 WHEN 1999 THEN 0.4 ELSE 1.0 END) AS w FROM panel GROUP BY 1", "w")
def _(s, d):
    return the_panel(s, d).groupBy("year").agg(F.sum(evaluate.sample_weight({1998: 0.1, 1999: 0.4})).alias("w"))


#: Boosted rounds of registered queries; a tree costs MLlib six Spark jobs, about 0.3 s however small the table is. Pooled itself goes up to 500.
_ROUNDS = 100
_LEARNERS = ("ridge", "lasso", "elastic_net", "random_forest", "gbt", "gbt_sampled", "gbt_absolute")


def _learnt(kind: str):
    drop = BREAKS.years if kind in ("ridge", "lasso", "elastic_net", "random_forest") else ()

    def run(s, d):
        folds = tables.stored(evaluate.walk_forward(the_features(s, d), FOLDS), "folds")  # fitting reads a fold some twenty times
        model = models.Pooled(kind, PORT_FEATURES, drop, {1998: 0.1, 1999: 0.4}, BREAKS.years, rounds=_ROUNDS)
        return evaluate.evaluate_models(folds, {kind: model}, [f for _, f in FOLDS]).withColumn("features_used", F.concat_ws(",", "features_used"))

    return run


for _kind in _LEARNERS:
    query(f"h18_model_{_kind}")(_learnt(_kind))


@query("h24_trend_seasonal")
def _(s, d):
    p = the_panel(s, d)
    return models.trend_seasonal(p.where("year <= 2000"), p.where("year = 2001").select(*KEYS, "year", "month"), (1997, 1998, 1999, 2000))


_CLEAN = [y for y in range(BREAKS.base_year, 2001) if y not in BREAKS.years]


@query("h30_recursive_trees")
def _(s, d):
    f = tables.stored(the_features(s, d), "features")
    fitted = models.Pooled("random_forest", PORT_FEATURES, BREAKS.years, break_years=BREAKS.years).fit(f.where("year <= 2000")).settled()
    return forecast.recursive_forecast(f, fitted, 2001, clean_years=_CLEAN, base_year=BREAKS.base_year)


@query("h30_recursive_ridge")
def _(s, d):
    f = tables.stored(the_features(s, d), "features")
    fitted = models.SeriesRidgePath(PORT_FEATURES, drop_years=BREAKS.years, break_years=BREAKS.years).fit(f.where("year <= 2000")).settled()
    return forecast.recursive_forecast(f, fitted, 2001, clean_years=_CLEAN, base_year=BREAKS.base_year)


# ---- H14, H21, H26 to H34 over learners: each series is scored, selected and forecast by a model of its own ----------------------

def _ridge_sql(name: str, source: str, keys: str) -> str:
    """CTEs of the ridge path of each series on two features: {name}_c has keys, penalty, slopes k1 and k2 and the intercept k0."""

    def slopes(f: str, a: str) -> str:
        n, b1, b2, z = f"n{f}", f"(n{f} * c1{f} / s1{f})", f"(n{f} * c2{f} / s2{f})", f"(n{f} * c12{f} / (s1{f} * s2{f}))"
        u1, u2 = f"s1{f} > 1e-9 * greatest(1, abs(m1{f}))", f"(s2{f} > 1e-9 * greatest(1, abs(m2{f})) AND NOT twin)"
        det = f"(({n} + {a}) * ({n} + {a}) - {z} * {z})"
        return f"""CASE WHEN {u1} AND {u2} THEN (({n} + {a}) * {b1} - {z} * {b2}) / {det} / s1{f} WHEN {u1} THEN {b1} / ({n} + {a}) / s1{f} ELSE 0 END AS k1,
            CASE WHEN {u1} AND {u2} THEN (({n} + {a}) * {b2} - {z} * {b1}) / {det} / s2{f} WHEN {u2} THEN {b2} / ({n} + {a}) / s2{f} ELSE 0 END AS k2"""

    def moments(f: str, only: str) -> str:
        parts = {"n": "count(*)", "m1": "avg(x1)", "m2": "avg(x2)", "my": "avg(y)", "s1": "stddev_pop(x1)", "s2": "stddev_pop(x2)", "c1": "covar_pop(x1, y)", "c2": "covar_pop(x2, y)", "c12": "covar_pop(x1, x2)"}
        return ", ".join(f"{e}{only}{'::DOUBLE' if k == 'n' else ''} AS {k}{f}" for k, e in parts.items())

    return f""", {name}_t AS (SELECT {keys}, year, month, coalesce(lag_12_clean, 0)::DOUBLE AS x1, coalesce(rolling_12_mean, 0)::DOUBLE AS x2, shipment_count::DOUBLE AS y FROM {source} WHERE year NOT IN (1998, 1999)),
    {name}_v AS (SELECT *, CASE WHEN y0 < y1 THEN year < y1 ELSE b > 12 END AS fit, CASE WHEN y0 < y1 THEN year = y1 ELSE b <= 12 END AS valid FROM (SELECT *, min(year) OVER (PARTITION BY {keys}) AS y0, max(year) OVER (PARTITION BY {keys}) AS y1, row_number() OVER (PARTITION BY {keys} ORDER BY year DESC, month DESC) AS b FROM {name}_t)),
    {name}_g AS (SELECT *, coalesce(s1 > 1e-9 * greatest(1, abs(m1)) AND s2 > 1e-9 * greatest(1, abs(m2)) AND abs(c12 / (s1 * s2)) > 0.95, false) AS twin FROM (SELECT {keys}, {moments('', '')}, {moments('_f', ' FILTER (fit)')} FROM {name}_v GROUP BY {keys})),
    {name}_k AS (SELECT *, {slopes('_f', 'a')} FROM {name}_g, (VALUES (0.01::DOUBLE), (0.1), (1.0), (10.0), (100.0)) p(a) WHERE n_f >= 2),
    {name}_e AS (SELECT {keys}, a, avg((y - my_f - k1 * (x1 - m1_f) - k2 * (x2 - m2_f)) ** 2) AS e FROM {name}_v JOIN {name}_k USING ({keys}) WHERE valid GROUP BY {keys}, a),
    {name}_b AS (SELECT {keys}, arg_min(a, (e, a)) AS a FROM {name}_e GROUP BY {keys}),
    {name}_c AS (SELECT {keys}, penalty, k1, k2, my - k1 * m1 - k2 * m2 AS k0 FROM (SELECT *, {slopes('', 'penalty')} FROM (SELECT g.*, coalesce(a, 1.0::DOUBLE) AS penalty FROM {name}_g g LEFT JOIN {name}_b USING ({keys}))))"""


def _learned_sql(keys: str, walk: str, panel_name: str, threshold: float) -> str:
    ridge = f"SELECT {keys}, fold_year, 'ridge' AS model, shipment_count::DOUBLE AS y, greatest(1.0, k0 + k1 * coalesce(lag_12_clean, 0) + k2 * coalesce(rolling_12_mean, 0)) AS p FROM wf JOIN cvr_c USING ({keys}, fold_year) WHERE is_test"
    return walk + _ridge_sql("cvr", "(SELECT * FROM wf WHERE NOT is_test)", f"{keys}, fold_year") + _scores_sql(_predictions_sql(("naive", "rolling"), keys) + " UNION ALL " + ridge, keys, panel_name, threshold)


LEARNED = _learned_sql("port, direction", WALK, "panel", 15)
_TWO = ("lag_12_clean", "rolling_12_mean")


def the_models(keys=KEYS) -> dict:
    """Two expressions, and a ridge of each series that chooses its penalty."""
    return {"naive": evaluate.seasonal_naive(), "rolling": evaluate.rolling_mean(), "ridge": models.SeriesRidgePath(_TWO, drop_years=BREAKS.years, break_years=BREAKS.years, keys=keys)}


def the_learned(s, d, models_of=None, p: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, scores and selection; panel and features are written once, as each fit and fold reads them."""
    p = the_panel(s, d) if p is None else p
    f = tables.stored(features.build_features(p, breaks=BREAKS), "features")
    found = evaluate.cross_validate(evaluate.walk_forward(f, FOLDS), models_of or the_models(), [y for _, y in FOLDS])
    return f, found, evaluate.select_hybrid(found, p.groupBy(*KEYS).agg(F.avg("shipment_count").alias("avg_volume")), THRESHOLD)


@query("h21_ridge_path", f"WITH {WALK}{_ridge_sql('cvr', '(SELECT * FROM wf WHERE NOT is_test)', 'port, direction, fold_year')} SELECT port, direction, fold_year, penalty, k0 AS intercept, k1 AS slope_lag_12, k2 AS slope_rolling_12 FROM cvr_c", "intercept slope_lag_12 slope_rolling_12")
def _(s, d):
    train = evaluate.walk_forward(the_features(s, d), FOLDS).where("not is_test")
    found = models.SeriesRidgePath(_TWO, drop_years=BREAKS.years, break_years=BREAKS.years, keys=(*KEYS, "fold_year")).fit(train).coefficients
    return found.select(*KEYS, "fold_year", "penalty", "intercept", F.col("coefficients")[0].alias("slope_lag_12"), F.col("coefficients")[1].alias("slope_rolling_12"))


@query("h14_learner_scores", f"WITH {LEARNED} SELECT * FROM scores", "mae rmse mape r2")
def _(s, d):
    return the_learned(s, d)[1]


@query("h26_learner_selection", f"WITH {LEARNED} SELECT * FROM sel", "avg_volume best_cv_mape baseline_cv_mape final_cv_mape")
def _(s, d):
    return the_learned(s, d)[2]


#: Every model's recursion of every series; the selected ones are those of the hybrid.
LEARNED_RECURSE = "RECURSIVE " + LEARNED + _SEED + _ridge_sql("fin", "(SELECT * FROM feats WHERE year <= 2000)", "port, direction") + f""",
    steps AS (SELECT s.port, s.direction, model, v, m, p, g, k0, k1, k2, 0 AS i FROM seed s CROSS JOIN (VALUES ('naive'), ('rolling'), ('ridge')) a(model) LEFT JOIN fin_c c ON c.port = s.port AND c.direction = s.direction UNION ALL SELECT port, direction, model,
        list_append(v, greatest(1.0, CASE model WHEN 'naive' THEN {_SAME} * (1 + g) WHEN 'rolling' THEN list_avg(v[-12:]) ELSE k0 + k1 * {_SAME} + k2 * list_avg(v[-12:]) END)), list_append(m, CAST((p + 1) % 12 + 1 AS INT)), p + 1, g, k0, k1, k2, i + 1 FROM steps WHERE i < 12),
    every AS (SELECT port, direction, model, CAST(p // 12 AS INT) AS year, CAST(p % 12 + 1 AS INT) AS month, v[-1] AS prediction FROM steps WHERE i > 0),
    chosen AS (SELECT every.* FROM every LEFT JOIN sel USING (port, direction) WHERE model = coalesce(selected_model, 'naive'))"""


def the_selected(s, d) -> DataFrame:
    f, _scores, selection = the_learned(s, d)
    fitted = evaluate.fit_models(f.where("year <= 2000"), the_models())
    return forecast.forecast_selected(f, selection, fitted, 2001, clean_years=_CLEAN, base_year=BREAKS.base_year)


@query("h30_selected_forecast", f"WITH {LEARNED_RECURSE} SELECT * FROM chosen", "prediction")
def _(s, d):
    return the_selected(s, d)


@query("h33_selected_totals", f"WITH {LEARNED_RECURSE} SELECT direction, model, sum(prediction) AS total FROM chosen GROUP BY 1, 2", "total")
def _(s, d):
    return forecast.forecast_totals(the_selected(s, d), by=("direction", "model"))


@query("h34_learner_totals", f"WITH {LEARNED_RECURSE} SELECT model, sum(prediction) FILTER (direction = 'import') AS import, sum(prediction) FILTER (direction = 'export') AS export, coalesce(sum(prediction) FILTER (direction = 'import'), 0) + coalesce(sum(prediction) FILTER (direction = 'export'), 0) AS total FROM (SELECT * FROM every UNION ALL SELECT * REPLACE ('hybrid' AS model) FROM chosen) GROUP BY 1", "import export total")
def _(s, d):
    f, _scores, selection = the_learned(s, d)
    fitted = evaluate.fit_models(f.where("year <= 2000"), the_models())
    series = f.select(*KEYS).distinct()
    wanted = series.withColumn("model", F.explode(F.array(*[F.lit(n) for n in fitted])))
    every = forecast.forecast_by_model(f, wanted, fitted, 2001, clean_years=_CLEAN, base_year=BREAKS.base_year)
    hybrid = every.join(selection.select(*KEYS, "selected_model"), KEYS, "left").where(F.col("model") == F.coalesce("selected_model", F.lit("naive"))).drop("selected_model").withColumn("model", F.lit("hybrid"))
    return forecast.totals_by_model(every.unionByName(hybrid))


_COMMODITY_WALK = COMMODITY_FEATURES + WALK[len(FEATURES):].replace("PARTITION BY port, direction", "PARTITION BY hs2, port, direction").replace("FROM feats JOIN folds", "FROM (SELECT * FROM feats QUALIFY count(*) OVER (PARTITION BY hs2, port, direction) >= 36) feats JOIN folds")
COMMODITY_LEARNED = _learned_sql("hs2, port, direction", _COMMODITY_WALK, "cpanel", 1e300)


def the_commodity_scores(s, d) -> DataFrame:
    f = tables.stored(features.build_features(the_commodities(s, d), CK, BREAKS, mix=()).drop("dominant_description"), "features")
    long = panel.eligible_series(f, CK)
    folds = evaluate.walk_forward(f.join(long, CK, "left_semi"), FOLDS, CK)
    return evaluate.cross_validate(folds, the_models(CK), [y for _, y in FOLDS], keys=CK)


@query("h39_leak_report", f"""WITH {LEARNED}, r AS (SELECT abs(corr(shipment_count, rolling_3_inclusive)) > 0.999 AS one, corr(shipment_count, rolling_3_inclusive) AS rho FROM feats GROUP BY port, direction), r2 AS (SELECT abs(corr(shipment_count, lag_1)) > 0.999 AS one, corr(shipment_count, lag_1) AS rho FROM feats GROUP BY port, direction),
    w AS (SELECT model, sum(mape * avg_volume) FILTER (mape IS NOT NULL) / sum(avg_volume) FILTER (mape IS NOT NULL) AS wmape FROM scores JOIN vol USING (port, direction) GROUP BY 1), g AS (SELECT least(min(wmape) FILTER (model = 'naive'), min(wmape) FILTER (model = 'rolling')) - min(wmape) FILTER (model = 'ridge') AS v FROM w)
    SELECT 'share_one_rolling_3_inclusive' AS "check", avg(one::INT) AS value, coalesce(avg(one::INT), 0) > 0 AS alarm FROM r WHERE rho IS NOT NULL AND NOT isnan(rho) UNION ALL SELECT 'share_one_lag_1', avg(one::INT), coalesce(avg(one::INT), 0) > 0 FROM r2 WHERE rho IS NOT NULL AND NOT isnan(rho)
    UNION ALL SELECT 'identity_rolling_3_inclusive', max(abs(shipment_count - (3 * rolling_3_inclusive - lag_1 - lag_2))), max(abs(shipment_count - (3 * rolling_3_inclusive - lag_1 - lag_2))) < 1e-6 FROM feats UNION ALL SELECT 'simple_beats_tuned', v, coalesce(v > 2, false) FROM g""", "value")
def _(s, d):
    p = the_panel(s, d)
    f = features.build_features(p.withColumn("rolling_3_inclusive", features.rolling_inclusive("shipment_count", 3, KEYS)), breaks=BREAKS)
    scores = the_learned(s, d, p=p)[1].join(p.groupBy(*KEYS).agg(F.avg("shipment_count").alias("avg_volume")), KEYS)
    return stats.leak_report(f, scores, ("rolling_3_inclusive", "lag_1"), ("ridge",), ("naive", "rolling"), roll="rolling_3_inclusive")


@query("h36_linear_attribution", f"WITH {FEATURES}{_ridge_sql('fin', '(SELECT * FROM feats WHERE year <= 2000)', 'port, direction')}, a AS (SELECT port, direction, k1 * (coalesce(lag_12_clean, 0) - avg(coalesce(lag_12_clean, 0)) OVER w) AS c1, k2 * (coalesce(rolling_12_mean, 0) - avg(coalesce(rolling_12_mean, 0)) OVER w) AS c2 FROM feats JOIN fin_c USING (port, direction) WINDOW w AS (PARTITION BY port, direction)) SELECT port, direction, 'lag_12_clean' AS feature, avg(abs(c1)) AS mean_abs FROM a GROUP BY 1, 2 UNION ALL SELECT port, direction, 'rolling_12_mean', avg(abs(c2)) FROM a GROUP BY 1, 2", "mean_abs")
def _(s, d):
    f = tables.stored(the_features(s, d), "features")
    return models.mean_attribution(models.linear_attribution(the_models()["ridge"].fit(f.where("year <= 2000")), f), KEYS)


@query("h35_importance")
def _(s, d):
    f = tables.stored(the_features(s, d).where("year <= 2000"), "features")
    forest = models.Pooled("random_forest", PORT_FEATURES, BREAKS.years, break_years=BREAKS.years).fit(f)
    lasso = models.Pooled("lasso", PORT_FEATURES, BREAKS.years, break_years=BREAKS.years).fit(f)
    return models.importance(forest).withColumn("model", F.lit("random_forest")).unionByName(models.importance(lasso).withColumn("model", F.lit("lasso")), allowMissingColumns=True)


@query("h36_permutation_importance")
def _(s, d):
    f = tables.stored(the_features(s, d, _MODES), "features")  # rows are dealt by a hash of all columns
    return models.permutation_importance(the_models()["ridge"].fit(f.where("year <= 2000")), f.where("year = 2001"))


@query("h14_commodity_scores", f"WITH {COMMODITY_LEARNED} SELECT * FROM scores", "mae rmse mape r2")
def _(s, d):
    return the_commodity_scores(s, d)


@query("h27_commodity_selection", f"WITH {COMMODITY_LEARNED} SELECT hs2, port, direction, best_model, best_cv_mape FROM best", "best_cv_mape")
def _(s, d):
    return evaluate.best_model(the_commodity_scores(s, d), CK)


def the_learners(kinds=("ridge", "gbt")) -> dict:
    """The seasonal naive model, the ridge of each series, and learners over all series, with all features of ports."""
    drop = {"gbt": ()}
    pooled = {k: models.Pooled(k, PORT_FEATURES, drop.get(k, BREAKS.years), {1998: 0.1, 1999: 0.4}, BREAKS.years, rounds=_ROUNDS) for k in kinds}
    return {"naive": evaluate.seasonal_naive(), "series_ridge": models.SeriesRidgePath(PORT_FEATURES, drop_years=BREAKS.years, break_years=BREAKS.years), **pooled}


@query("h30_learned_forecast")
def _(s, d):
    f, found, selection = the_learned(s, d, the_learners())
    selection = tables.stored(selection, "selection")
    used = {r[0] for r in selection.select("selected_model").distinct().collect()} | {"naive"}  # one row for each model
    fitted = evaluate.fit_models(f.where("year <= 2000"), {n: m for n, m in the_learners().items() if n in used})
    return forecast.forecast_selected(f, selection, fitted, 2001, clean_years=_CLEAN, base_year=BREAKS.base_year)


# ---- D35 and K: weather and marts ----------------------------------------------------------------------------------

#: The configuration as doubles, as Spark has it: decimals would be subtracted exactly.
_CFG = "cfg AS (SELECT port_code, CAST(ht AS DOUBLE) AS ht, CAST(hc AS DOUBLE) AS hc, CAST(wt AS DOUBLE) AS wt, CAST(wc AS DOUBLE) AS wc, CAST(gt AS DOUBLE) AS gt, CAST(gc AS DOUBLE) AS gc, CAST(ex AS DOUBLE) AS ex, CAST(sw AS DOUBLE) AS sw FROM (VALUES ('click', 0.5, 1.5, 40.0, 90.0, 100.0, 150.0, 1.0, 1.0), ('view', 0.5, 1.2, 40.0, 80.0, 90.0, 140.0, 1.1, 0.9), ('purchase', 0.4, 1.5, 30.0, 90.0, 100.0, 160.0, 0.9, 1.2), ('signup', 0.6, 1.4, 35.0, 85.0, 95.0, 150.0, 1.0, 1.0)) v(port_code, ht, hc, wt, wc, gt, gc, ex, sw))"
WEATHER = _CFG + """, hourly AS (SELECT event_type AS port_code, date_trunc('hour', ts) AS ts, avg(value) / 100 AS wave, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) / 20 AS swell, avg(value) AS wind, max(value) AS gusts FROM events GROUP BY 1, 2),
    risk AS (SELECT h.*, coalesce(least(1, greatest(0, (greatest(wave * coalesce(ex, 1), swell * coalesce(sw, 1)) - ht) / (hc - ht))), 0) AS wave_risk, coalesce(least(1, greatest(0, (wind - wt) / (wc - wt))), 0) AS wind_risk, coalesce(least(1, greatest(0, (gusts - gt) / (gc - gt))), 0) AS gusts_risk, coalesce(swell > wave, false) AS swell_dominant FROM hourly h LEFT JOIN cfg USING (port_code)),
    r1 AS (SELECT *, greatest(wave_risk, wind_risk, gusts_risk) AS combined_risk FROM risk),
    scored AS (SELECT *, 100 * (1 - combined_risk) AS operability, CASE WHEN combined_risk < 0.25 THEN 'Open' WHEN combined_risk < 0.5 THEN 'Watch' WHEN combined_risk < 1 THEN 'Warning' ELSE 'Closed' END AS risk_label, CASE WHEN combined_risk < 1 THEN NULL WHEN wave_risk = combined_risk THEN 'wave' WHEN wind_risk = combined_risk THEN 'wind' ELSE 'gusts' END AS closure_driver FROM r1),
    daily AS (SELECT port_code, CAST(ts AS DATE) AS day, count(*) AS n_hours, count(*) FILTER (risk_label = 'Closed') AS hours_closed, count(*) FILTER (risk_label = 'Warning') AS hours_warning, count(*) FILTER (closure_driver = 'wave') AS closed_by_wave, count(*) FILTER (closure_driver = 'wind') AS closed_by_wind, count(*) FILTER (closure_driver = 'gusts') AS closed_by_gusts,
    count(*) FILTER (risk_label = 'Closed') / count(*) AS pct_closed, count(*) FILTER (risk_label = 'Warning') / count(*) AS pct_warning, avg(operability) AS avg_operability, min(operability) AS min_operability, max(wave) AS max_wave, max(wind) AS max_wind, count(*) FILTER (risk_label = 'Closed') >= 6 AS closure_day FROM scored GROUP BY 1, 2),
    monthly AS (SELECT port_code, CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month, CAST(sum(n_hours) AS BIGINT) AS n_hours, CAST(sum(hours_closed) AS BIGINT) AS hours_closed, CAST(sum(hours_warning) AS BIGINT) AS hours_warning, CAST(sum(closed_by_wave) AS BIGINT) AS closed_by_wave, CAST(sum(closed_by_wind) AS BIGINT) AS closed_by_wind, CAST(sum(closed_by_gusts) AS BIGINT) AS closed_by_gusts,
    sum(hours_closed) / sum(n_hours) AS pct_closed, sum(hours_warning) / sum(n_hours) AS pct_warning, sum(avg_operability * n_hours) / sum(n_hours) AS avg_operability, min(min_operability) AS min_operability, max(max_wave) AS max_wave, max(max_wind) AS max_wind, count(*) FILTER (closure_day) AS closure_days FROM daily GROUP BY 1, 2, 3),
    clim AS (SELECT port_code, month, avg(pct_closed) AS closed, avg(pct_warning) AS warn, avg(avg_operability) AS operability, avg(closure_days) AS closure_days, sum(closed_by_wave) / nullif(sum(hours_closed), 0)::DOUBLE AS share_wave, sum(closed_by_wind) / nullif(sum(hours_closed), 0)::DOUBLE AS share_wind, sum(closed_by_gusts) / nullif(sum(hours_closed), 0)::DOUBLE AS share_gusts, min(pct_closed) AS closed_min, max(pct_closed) AS closed_max FROM monthly GROUP BY 1, 2)"""


def the_scored(s, d) -> DataFrame:
    return weather.score_operability(hourly_weather(s, d), weather_config(s))


@query("k6_score_operability", f"WITH {WEATHER} SELECT port_code, epoch(ts)::BIGINT AS ts, wave_risk, wind_risk, gusts_risk, combined_risk, swell_dominant, operability, risk_label, closure_driver FROM scored", "wave_risk wind_risk gusts_risk combined_risk operability", 7)
def _(s, d):
    return the_scored(s, d).drop("wave", "swell", "wind", "gusts").withColumn("ts", F.unix_timestamp("ts"))


_W = "pct_closed pct_warning avg_operability min_operability max_wave max_wind"


@query("d35_weather_daily", f"WITH {WEATHER} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM daily", _W)
def _(s, d):
    return weather.weather_daily(the_scored(s, d)).withColumn("day", F.col("day").cast("string"))


@query("d36_weather_monthly", f"WITH {WEATHER} SELECT * FROM monthly", _W)
def _(s, d):
    return weather.weather_monthly(weather.weather_daily(the_scored(s, d)))


@query("d37_climatology", f"WITH {WEATHER} SELECT * FROM clim", "closed warn operability closure_days share_wave share_wind share_gusts closed_min closed_max")
def _(s, d):
    return weather.weather_climatology(weather.weather_monthly(weather.weather_daily(the_scored(s, d))))


@query("k13_weather_ranking", f"WITH {WEATHER}, every AS (SELECT port_code FROM cfg UNION SELECT n_name FROM nation), y AS (SELECT port_code, 100 * avg(closed) AS closed_pct FROM every LEFT JOIN clim USING (port_code) GROUP BY 1) SELECT port_code, closed_pct, CAST(rank() OVER (ORDER BY coalesce(round(closed_pct, 9), -1) DESC) AS INT) AS rank, CASE WHEN closed_pct IS NULL THEN 'No data' WHEN closed_pct < 1 THEN 'Low' WHEN closed_pct < 3 THEN 'Moderate' WHEN closed_pct < 8 THEN 'High' ELSE 'Critical' END AS label FROM y", "closed_pct")
def _(s, d):
    clim = weather.weather_climatology(weather.weather_monthly(weather.weather_daily(the_scored(s, d))))
    ports = weather_config(s).select("port_code").union(table(s, d, "nation").select("n_name")).distinct()
    year = ports.join(clim, "port_code", "left").groupBy("port_code").agg(F.round(100 * F.avg("closed"), 9).alias("closed_pct"))
    return marts.mode_ranking(year, "closed_pct", CLOSURE_CUTS, "port_code")


@query("d38_driver_split", f"WITH {WEATHER} SELECT port_code, avg(closed) AS annual_closed, avg(share_wave) AS share_wave, avg(share_wind) AS share_wind, avg(share_gusts) AS share_gusts FROM clim GROUP BY 1", "annual_closed share_wave share_wind share_gusts")
def _(s, d):
    return weather.driver_split(weather.weather_climatology(weather.weather_monthly(weather.weather_daily(the_scored(s, d)))))


@query("i3_windowed_rollup", "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, avg(value) AS mean, max(value) AS max FROM events GROUP BY 1, 2", "mean max")
def _(s, d):
    from .streaming.rollup import windowed_rollup

    return windowed_rollup(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "value").select("event_type", F.col("window_start").cast("date").cast("string").alias("day"), "n", "mean", "max")


_ADJ = INDEX + ", " + WEATHER + """, bridge AS (SELECT n_name AS port, ['click', 'view', 'purchase', 'signup', 'error'][n_nationkey % 5 + 1] AS port_code FROM nation), wm AS (SELECT port_code, month, avg(pct_closed) AS pct_closed, avg(pct_warning) AS pct_warning FROM monthly GROUP BY 1, 2),
    adj AS (SELECT ci.port, direction, year, ci.month, congestion_index, b.port_code, coalesce(wm.pct_closed, 0) AS pct_closed, 1 + coalesce(wm.pct_closed, 0) + 0.5 * coalesce(wm.pct_warning, 0) AS weather_multiplier FROM ci LEFT JOIN bridge b ON b.port = ci.port LEFT JOIN wm ON wm.port_code = b.port_code AND wm.month = ci.month),
    adj2 AS (SELECT *, least(1, congestion_index * weather_multiplier) AS ci_adjusted FROM adj)"""


def the_bridge(s, d) -> DataFrame:
    codes = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "error")))
    return table(s, d, "nation").select(F.col("n_name").alias("port"), F.element_at(codes, F.col("n_nationkey") % 5 + 1).alias("port_code"))


def the_months(s, d, label: str | None = None) -> DataFrame:
    """The declarations by commodity, port and month, read and joined once; marts over both levels are derived from it."""
    return tables.stored(panel.commodity_months(declarations(s, d), cargo=CARGO, label=label), "months")


def the_adjusted(s, d, ports: DataFrame | None = None) -> DataFrame:
    """The weather of the given month stands for that calendar month of all years."""
    months = weather.weather_monthly(weather.weather_daily(the_scored(s, d))).groupBy("port_code", "month").agg(F.avg("pct_closed").alias("pct_closed"), F.avg("pct_warning").alias("pct_warning"))
    index = the_index(s, d) if ports is None else features.congestion_index(features.build_features(ports, breaks=BREAKS))
    return weather.weather_adjust(index, months, the_bridge(s, d), on=("month",))


@query("k7_weather_adjust", f"WITH {_ADJ} SELECT port, direction, year, month, weather_multiplier, ci_adjusted, CASE WHEN weather_multiplier < 1.01 THEN 'none' WHEN weather_multiplier < 1.03 THEN 'minor' WHEN weather_multiplier < 1.08 THEN 'moderate' ELSE 'severe' END AS adjustment_type FROM adj2", "weather_multiplier ci_adjusted")
def _(s, d):
    return the_adjusted(s, d).select(*KEYS, "year", "month", "weather_multiplier", "ci_adjusted", "adjustment_type")


_OVER = _ADJ + ", ov AS (SELECT port, avg(congestion_index) AS ci_raw, avg(ci_adjusted) AS ci_adjusted, 100 * avg(pct_closed) AS closed_pct FROM adj2 GROUP BY 1)"


def the_overview(s, d, ports: DataFrame | None = None) -> DataFrame:
    months = the_adjusted(s, d, ports).select("port", F.col("congestion_index").alias("ci_raw"), "ci_adjusted", F.coalesce("pct_closed", F.lit(0.0)).alias("pct_closed"))
    return marts.mart_port_overview(months, the_bridge(s, d), ["KENYA"])


@query("k9_port_overview", f"""WITH {_OVER} SELECT ov.*, port_code, CASE WHEN ci_adjusted < 0.15 THEN 'Low' WHEN ci_adjusted < 0.25 THEN 'Moderate' WHEN ci_adjusted < 0.4 THEN 'High' ELSE 'Critical' END AS congestion_label, CASE WHEN closed_pct < 1 THEN 'Low' WHEN closed_pct < 3 THEN 'Moderate' WHEN closed_pct < 8 THEN 'High' ELSE 'Critical' END AS closure_label,
    CASE WHEN ci_adjusted >= 0.4 OR closed_pct >= 8 THEN 'Critical' WHEN ci_adjusted >= 0.25 OR closed_pct >= 3 THEN 'High' WHEN ci_adjusted >= 0.15 OR closed_pct >= 1 THEN 'Moderate' ELSE 'Low' END AS delay_label, coalesce(closed_pct >= 1, false) AS exposed FROM ov LEFT JOIN bridge USING (port) WHERE port <> 'KENYA'""", "ci_raw ci_adjusted closed_pct")
def _(s, d):
    return the_overview(s, d)


@query("k9_map_ports", f"""WITH {_ADJ}, places AS (SELECT n_name AS port, -20.0 - n_nationkey AS lat, -70.0 - n_regionkey / 10.0 AS lng FROM nation WHERE n_regionkey <> 4), mp AS (SELECT direction, port, avg(congestion_index) AS ci_raw, avg(ci_adjusted) AS ci_adjusted, 100 * avg(pct_closed) AS closed_pct FROM adj2 WHERE port <> 'KENYA' GROUP BY 1, 2)
    SELECT mp.*, lat, lng, port_code, CASE WHEN ci_adjusted < 0.15 THEN 'Low' WHEN ci_adjusted < 0.25 THEN 'Moderate' WHEN ci_adjusted < 0.4 THEN 'High' ELSE 'Critical' END AS congestion_label, CASE WHEN ci_adjusted >= 0.4 OR closed_pct >= 8 THEN 'Critical' WHEN ci_adjusted >= 0.25 OR closed_pct >= 3 THEN 'High' WHEN ci_adjusted >= 0.15 OR closed_pct >= 1 THEN 'Moderate' ELSE 'Low' END AS delay_label FROM mp JOIN places USING (port) LEFT JOIN bridge USING (port)""", "ci_raw ci_adjusted closed_pct lat lng")
def _(s, d):
    months = the_adjusted(s, d).select(*KEYS, F.col("congestion_index").alias("ci_raw"), "ci_adjusted", "pct_closed")
    places = table(s, d, "nation").where("n_regionkey <> 4").select(F.col("n_name").alias("port"), (-20.0 - F.col("n_nationkey")).alias("lat"), (-70.0 - F.col("n_regionkey") / 10.0).alias("lng"))
    codes = the_bridge(s, d).withColumn("port_code", F.concat("port_code", F.lit("001")))
    return marts.map_ports(months.withColumn("pct_closed", F.coalesce("pct_closed", F.lit(0.0))), codes, places, ["KENYA"])


_COMPARE = _OVER + ", cm AS (SELECT hs2, direction, port, count(*) AS volume FROM decl GROUP BY 1, 2, 3), cmp AS (SELECT cm.*, ci_adjusted, closed_pct, rank() OVER (PARTITION BY hs2, direction ORDER BY volume * (1 - coalesce(ci_adjusted, 0)) DESC) AS rank_in_commodity FROM cm LEFT JOIN (SELECT * FROM ov WHERE port <> 'KENYA') USING (port))"


def the_compare(s, d) -> DataFrame:
    """Volumes by commodity are counts of goods alone, so that no measures are shuffled, where the declarations may be counted apart."""
    apart = [tables.stored(view, name) for view, name in zip(declarations_apart(s, d), ("items", "buyers", "goods"))]
    if panel.is_whole(*apart):
        volume = apart[2].where("first").select("hs2", "direction", "port", F.col("n").alias("shipments"))
        ports = panel.monthly_panel_apart(*apart, cargo=CARGO, modes=()).drop("whole")
    else:
        months = the_months(s, d)
        volume, ports = months.select("hs2", "direction", "port", F.col("shipment_count").alias("shipments")), panel.ports_of(months, CARGO)
    return marts.mart_port_compare(volume, the_overview(s, d, ports))


@query("k10_port_compare", f"WITH {_COMPARE} SELECT hs2, direction, port, CAST(volume AS BIGINT) AS volume, ci_adjusted, closed_pct, CAST(rank_in_commodity AS INT) AS rank_in_commodity FROM cmp", "ci_adjusted closed_pct")
def _(s, d):
    return the_compare(s, d)


@query("k11_recommend_port", f"WITH {_COMPARE}, b AS (SELECT hs2, direction, min(port) AS best_port FROM cmp WHERE rank_in_commodity = 1 GROUP BY 1, 2) SELECT hs2, direction, port, CAST(rank_in_commodity AS INT) AS rank_in_commodity, best_port, best_port <> port AS better_option FROM cmp LEFT JOIN b USING (hs2, direction)")
def _(s, d):
    return marts.recommend_port(the_compare(s, d))


@query("k12_commodity_month", f"WITH {COMMODITY_FORECAST}, {_ADJ[len(DECL) + 2:]}, im AS (SELECT port, month, avg(congestion_index) AS ci_raw, avg(ci_adjusted) AS ci_adjusted FROM adj2 GROUP BY 1, 2), ck AS (SELECT DISTINCT hs2, port, direction FROM cout) SELECT ck.hs2, ck.port, ck.direction, CAST(k AS INT) AS month, CAST(coalesce(f.v, 0) AS BIGINT) AS forecast, ci_raw, ci_adjusted FROM ck CROSS JOIN range(1, 13) r(k) LEFT JOIN (SELECT hs2, port, direction, month, sum(pred_shipment_count) AS v FROM cout GROUP BY 1, 2, 3, 4) f ON f.hs2 = ck.hs2 AND f.port = ck.port AND f.direction = ck.direction AND f.month = k LEFT JOIN im ON im.port = ck.port AND im.month = k", "ci_raw ci_adjusted")
def _(s, d):
    months = the_months(s, d)
    index = the_adjusted(s, d, panel.ports_of(months, CARGO)).groupBy("port", "month").agg(F.avg("congestion_index").alias("ci_raw"), F.avg("ci_adjusted").alias("ci_adjusted"))
    p = panel.commodities_of(months)
    found = the_commodity_forecast(s, d, p)
    return marts.mart_commodity_month(found, index).withColumn("forecast", F.col("forecast").cast("long"))


@query("k14_map_sizes", f"WITH {_OVER} SELECT port, CAST(CASE WHEN ci_adjusted > 0.3 THEN 10 WHEN ci_adjusted > 0.15 THEN 7 ELSE 5 END AS INT) AS size_by_index, CAST(CASE WHEN closed_pct >= 8 THEN 10 WHEN closed_pct >= 3 THEN 7 ELSE 5 END AS INT) AS size_by_weather FROM ov WHERE port <> 'KENYA'")
def _(s, d):
    return the_overview(s, d).select("port", x.size_class(F.col("ci_adjusted"), MAP_SIZES["index"]).alias("size_by_index"), x.size_class(F.col("closed_pct"), MAP_SIZES["closed_pct"], True).alias("size_by_weather"))


@query("d40_peak_month", f"WITH {PANEL}, m AS (SELECT port, month, sum(shipment_count) AS v FROM panel GROUP BY 1, 2) SELECT port, arg_max(month, (v, -month)) AS peak_month, arg_min(month, (v, month)) AS low_month FROM m GROUP BY 1")
def _(s, d):
    return marts.peak_month(the_panel(s, d).groupBy("port", "month").agg(F.sum("shipment_count").alias("v")), ["port"], "v")


@query("d41_year_summary", f"WITH {PANEL}, n AS (SELECT year, month, CAST(sum(shipment_count) AS BIGINT) AS v FROM panel GROUP BY 1, 2) SELECT year, count(*) AS n_months, CAST(sum(v) AS BIGINT) AS total, avg(v) AS mean, arg_max(month, (v, -month)) AS peak, arg_min(month, (v, month)) AS low FROM n GROUP BY 1", "mean")
def _(s, d):
    return marts.year_summary(the_panel(s, d).groupBy("year", "month").agg(F.sum("shipment_count").alias("v")), "v")


@query("d42_yoy_pivot", f"WITH {PANEL} SELECT month, {', '.join(f'CAST(sum(shipment_count) FILTER (year = {y}) AS BIGINT) AS y{y}' for y in (1999, 2000, 2001))} FROM panel WHERE true GROUP BY 1")
def _(s, d):
    return marts.yoy_pivot(the_panel(s, d), "shipment_count", (1999, 2000, 2001))


@query("d43_season_means", f"WITH {PANEL} SELECT ['Summer', 'Autumn', 'Winter', 'Spring'][(month % 12) // 3 + 1] AS season, avg(shipment_count) AS mean FROM panel GROUP BY 1", "mean")
def _(s, d):
    return the_panel(s, d).groupBy(x.season(F.col("month")).alias("season")).agg(F.avg("shipment_count").alias("mean"))


@query("d44_month_deviation", f"WITH {PANEL}, v AS (SELECT port, direction, year, month, shipment_count, 100 * (shipment_count - avg(shipment_count) OVER w) / avg(shipment_count) OVER w AS deviation_pct FROM panel WINDOW w AS (PARTITION BY port, direction, year)) SELECT *, CASE WHEN deviation_pct > 10 THEN 'high' WHEN deviation_pct < -10 THEN 'low' ELSE 'usual' END AS flag FROM v", "deviation_pct")
def _(s, d):
    return marts.month_deviation(the_panel(s, d), "shipment_count", KEYS)


@query("d45_top_n_share", f"WITH {DECL}, s AS (SELECT direction, port, sum(value_usd) AS v FROM decl GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY v DESC, port) AS r FROM s), g AS (SELECT direction, CASE WHEN r <= 5 THEN port ELSE 'Others' END AS port, sum(v) AS v FROM r GROUP BY 1, 2) SELECT *, 100 * v / sum(v) OVER (PARTITION BY direction) AS share_pct FROM g", "v share_pct")
def _(s, d):
    return marts.top_n_share(declarations(s, d), "port", "value_usd", 5, ["direction"])


@query("d46_category_mix", f"WITH {DECL} SELECT port, count(*) AS n, 100 * avg(CAST(clause = 'A' AS INT)) AS pct_a, 100 * avg(CAST(clause = 'N' AS INT)) AS pct_n, 100 * avg(CAST(clause = 'R' AS INT)) AS pct_r, 100 * avg(CAST(clause IN ('A', 'R') AS INT)) AS pct_target FROM decl GROUP BY 1", "pct_a pct_n pct_r pct_target")
def _(s, d):
    return marts.category_mix(declarations(s, d), "port", "clause", ["A", "N", "R"], ["A", "R"])


@query("d47_port_scorecard", f"WITH {DECL}, m AS (SELECT port, month, count(*) AS n FROM decl GROUP BY 1, 2), p AS (SELECT port, arg_max(month, (n, -month)) AS peak_month, arg_min(month, (n, month)) AS low_month FROM m GROUP BY 1), w AS (SELECT port, count(*) AS shipments, sum(value_usd) AS value_usd, count(DISTINCT country) AS n_countries, count(DISTINCT hs4) AS n_products FROM decl GROUP BY 1) SELECT * FROM w LEFT JOIN p USING (port)", "value_usd")
def _(s, d):
    return marts.port_scorecard(declarations(s, d))


@query("d48_month_array", f"WITH {PANEL}, k AS (SELECT DISTINCT port, direction FROM panel WHERE year = 2001), g AS (SELECT port, direction, m AS month FROM k, range(1, 13) r(m)), v AS (SELECT g.port, g.direction, g.month, coalesce(CAST(p.shipment_count AS BIGINT), 0) AS v FROM g LEFT JOIN panel p ON p.port = g.port AND p.direction = g.direction AND p.month = g.month AND p.year = 2001) SELECT port, direction, string_agg(CAST(v AS VARCHAR), ',' ORDER BY month) AS months FROM v GROUP BY 1, 2")
def _(s, d):
    arrays = marts.month_array(the_panel(s, d).where("year = 2001"), KEYS, "shipment_count")
    return arrays.select(*KEYS, F.concat_ws(",", F.transform("months", lambda v: v.cast("long").cast("string"))).alias("months"))



@query("d51_product_profile", f"WITH {DECL}, g AS (SELECT port, hs2, count(*) AS n, sum(value_usd) AS v FROM decl GROUP BY 1, 2) SELECT *, 100.0 * n / sum(n) OVER w AS share_pct, CAST(rank() OVER (PARTITION BY port ORDER BY v DESC) AS INT) AS rank, v / max(v) OVER w AS of_largest FROM g WINDOW w AS (PARTITION BY port)", "v share_pct of_largest")
def _(s, d):
    return marts.product_profile(declarations(s, d), "port", "hs2", "value_usd")


@query("f3_top_series", f"WITH {PANEL} SELECT port, direction, avg(shipment_count) AS avg_volume FROM panel GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 8", "avg_volume")
def _(s, d):
    return marts.top_rows(the_panel(s, d).groupBy(*KEYS).agg(F.avg("shipment_count").alias("avg_volume")), "avg_volume", 8, *KEYS)


@query("g1_union_flows", f"WITH {DECL} SELECT direction, country, count(*) AS n FROM decl GROUP BY 1, 2")
def _(s, d):
    df = declarations(s, d)
    parts = [df.where(F.col("direction") == k).select("direction", "country") for k in ("import", "export")]
    return reduce(DataFrame.unionByName, parts).groupBy("direction", "country").agg(F.count("*").alias("n"))


@query("g3_distinct_labels", f"WITH {DECL} SELECT hs2, min(hs6) AS label, count(DISTINCT hs4) AS n FROM decl GROUP BY 1")
def _(s, d):
    return declarations(s, d).groupBy("hs2").agg(F.min("hs6").alias("label"), F.count_distinct("hs4").alias("n"))


# ---- K4, K5: pages -------------------------------------------------------------------------------------------------

@query("k4_extract_links", "SELECT page_id, generate_subscripts(m, 1) AS pos, regexp_extract(unnest(m), 'href=\"([^\"]*)\"', 1) AS href, regexp_extract(unnest(m), '>([^<]*)<', 1) AS label FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>') AS m FROM pages)")
def _(s, d):
    return pages.extract_rows(table(s, d, "pages"), '<a href="[^"]*">[^<]*</a>', {"href": 'href="([^"]*)"', "label": ">([^<]*)<"}).withColumn("pos", F.col("pos").cast("long"))


@query("k5_first_fields", "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') AS lang, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS heading FROM pages")
def _(s, d):
    return pages.first_fields(table(s, d, "pages"), {"title": "<title>([^<]*)</title>", "lang": '<html lang="([^"]*)"', "heading": "<h1>([^<]*)</h1>"})


#: Tags of a page as labels of fields: the first field that fits takes the tag, the last text of a field is kept.
_TAGS = {"title": ("title",), "heading": ("h1", "h2"), "link": ("a",), "text": ("p", "b")}
_TAG_PAIR = "<(title|h1|h2|a|b|p)(?: [^>]*)?>([^<]*)<"
_TAG_CASE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(l, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{n}'" for n, words in _TAGS.items()) + " END"


@query("k5_extract_fields", f"WITH m AS (SELECT page_id, regexp_extract_all(html, '{_TAG_PAIR}', 1) AS ls, regexp_extract_all(html, '{_TAG_PAIR}', 2) AS vs FROM pages), e AS (SELECT page_id, unnest(ls) AS l, trim(unnest(vs)) AS v, generate_subscripts(ls, 1) AS i FROM m), f AS (SELECT page_id, {_TAG_CASE} AS field, v, i FROM e WHERE v NOT IN ('', '-')) SELECT page_id, {', '.join(f'max_by(v, i) FILTER (field = {chr(39)}{n}{chr(39)}) AS {chr(34)}{n}{chr(34)}' for n in _TAGS)} FROM (SELECT page_id FROM pages) LEFT JOIN f USING (page_id) GROUP BY 1")
def _(s, d):
    return pages.extract_fields(table(s, d, "pages"), _TAG_PAIR, _TAGS)


@query("k4_page_counts", "SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links FROM pages")
def _(s, d):
    t = table(s, d, "pages")
    count = lambda row, name: pages.extract_rows(t, row, {}).groupBy("page_id").agg(F.count("*").alias(name))
    zero = F.lit(0).cast("long")
    both = t.select("page_id").join(count("<p>", "n_paragraphs"), "page_id", "left").join(count("<a href=", "n_links"), "page_id", "left")
    return both.select("page_id", F.coalesce("n_paragraphs", zero).alias("n_paragraphs"), F.coalesce("n_links", zero).alias("n_links"))
