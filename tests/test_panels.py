"""Cached panels, panels derived from one aggregate, landed files, closed-form port forecasts and map marks."""

import math

import pytest
from tidewright import catalog
from tidewright.plans import declarations
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewright.config import Breaks
from tidewright.functions import exprs
from tidewright.operators import evaluate, features, forecast, marts, panel
from tidewright.sources import snapshots, tables

KEYS = ["port", "direction"]
BREAKS = Breaks(1998, 1999, 9999, 1995)


def make_panel(spark, months=84):
    rows = [(p, d, 1995 + i // 12, i % 12 + 1, 10 + n + i, 100.0 * i, None, 5.0 * i, i % 4, 3, 1, 2, 0, 4) for n, p in enumerate("PQRS") for d in ("import", "export") for i in range(months)]
    return spark.createDataFrame(rows, "port string, direction string, year int, month int, shipment_count long, total_value_usd double, total_weight_mt double, total_quantity double, commodity_diversity long, country_diversity long, cnt_general long, cnt_bulk long, cnt_refrigerated long, cnt_container long")


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line or "Exchange SinglePartition" in line for line in plan.splitlines())


def selection(p):
    folds = evaluate.walk_forward(features.build_features(p, breaks=BREAKS), ((1998, 1999), (1999, 2000), (2000, 2001)))
    found = evaluate.evaluate(folds, {"naive": evaluate.seasonal_naive(), "rolling": evaluate.rolling_mean()})
    return evaluate.select_hybrid(found, p.groupBy(*KEYS).agg(F.avg("shipment_count").alias("avg_volume")), 50.0)


def test_bucketed_panel_needs_no_exchange(spark):
    p = make_panel(spark)
    cache = tables.save_bucketed(p, "panel_buckets", KEYS, rows_per_bucket=200)
    assert shuffles(features.build_features(p, breaks=BREAKS)) > 0
    for made in (lambda q: features.congestion_index(features.build_features(q, breaks=BREAKS)), selection):
        assert shuffles(made(cache)) == 0
        assert sorted(map(str, made(cache).collect())) == sorted(map(str, made(p).collect()))


def test_bucketed_panel_is_found_again(spark, tmp_path):
    p, at = make_panel(spark, 24), str(tmp_path / "kept")
    tables.save_bucketed(p, "panel_first", KEYS, rows_per_bucket=50, path=at)
    spark.sql("DROP TABLE panel_first")
    again = tables.open_bucketed(spark, at, "panel_again")
    assert again.schema == p.schema and sorted(map(str, again.collect())) == sorted(map(str, p.collect()))
    assert shuffles(again.groupBy(*KEYS).count()) == 0
    empty = tables.save_bucketed(p.limit(0), "panel_none", KEYS)
    assert empty.count() == 0 and empty.columns == p.columns


def test_panels_of_one_aggregate_equal_those_of_the_declarations(spark):
    rows = [(1995 + i % 2, i % 3 + 1, p, d, None if i % 7 == 0 else 10.0 * i, None if d == "import" else 2.0 * i, float(i), h, "a", f"{h}{i % 3}", "x", "y", c)
            for i in range(60) for p, d, h, c in [(("A", "B", None)[i % 3], ("import", "export")[i % 2], ("s", "t", None, "u")[i % 4], ("GENERAL", "granel", None)[i % 3])]]
    rows.append((None, 1, "A", "import", 1.0, 1.0, 1.0, "s", "a", "s1", "x", "y", "GENERAL"))
    decl = spark.createDataFrame(rows, "year int, month int, port string, direction string, value_usd double, weight_kg double, quantity double, hs2 string, hs4 string, hs6 string, country string, continent string, cargo string")
    months = panel.commodity_months(decl)
    whole = panel.ports_of(months)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(whole, panel.monthly_panel(decl).select(*whole.columns))
    assert same(panel.commodities_of(months), panel.commodity_panel(decl))
    assert panel.ports_of(months.limit(0)).count() == 0


def test_land_files(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "raw")
    source.mkdir()
    schema = StructType([StructField("k", StringType()), StructField("v", DoubleType())])
    for year in (2019, 2020):
        (source / f"salidas_{year}.csv").write_text(f"k;v\na;{year}\nb;1.5\n")
    (source / "ingresos2021.csv").write_text("k;v\nz;0\n")
    (source / "salidas2022.csv").write_text("k;v\nz;0\n")  # the other kind's pattern
    states = lambda df: {r["year"]: r["state"] for r in df.collect()}
    land = lambda *years, **more: states(tables.land_files(spark, str(source), target, "salidas", years, schema, ";", **more))
    assert land(2019, 2022) == {2019: "uploaded", 2022: "missing"}
    assert land(2019, 2020, 2020) == {2019: "skipped", 2020: "uploaded"}
    (source / "salidas_2019.csv").write_text("k;v\nc;7\n")
    assert land(2019, 2020) == {2019: "skipped", 2020: "skipped"}
    assert land(2019, force=True) == {2019: "uploaded"}
    got = tables.read_raw(spark, f"{target}/salidas", schema, ";").collect()
    assert sorted((r["k"], r["v"], r["year"]) for r in got) == [("a", 2020.0, 2020), ("b", 1.5, 2020), ("c", 7.0, 2019)]
    assert states(tables.land_files(spark, str(source), target, "ingresos", [2021], schema, ";")) == {2021: "uploaded"}


def test_port_forecast(spark):
    p = make_panel(spark).withColumns({"hs4_diversity": F.lit(2).cast("long"), "dominant_hs2": F.lit("x"), "dominant_cargo_type": F.lit(None).cast("string"), "dominant_continent": F.lit("c")})
    indexed = features.congestion_index(features.build_features(p, breaks=BREAKS))
    params, seasons = forecast.port_params(indexed, year_floor=1997), forecast.port_seasons(indexed, year_floor=1996)
    got = forecast.port_forecast(params, seasons).where("port = 'P'").collect()
    assert len(got) == 24 and {(r["year"], r["month"]) for r in got} == {(2002, m) for m in range(1, 13)}
    assert all((r["pred_weight_mt"] is None) == (r["direction"] == "import") for r in got)
    rows = [r for r in indexed.where("port = 'P' and direction = 'import'").collect()]
    recent = [r for r in rows if r["year"] >= 1997]
    growth = min(0.4, max(-0.3, sum(r["yoy_growth"] for r in recent) / len(recent)))
    months = {m: [r["shipment_count"] for r in rows if r["month"] == m] for m in range(1, 13)}
    means = {m: sum(v) / len(v) for m, v in months.items()}
    factor, index = means[3] / (sum(means.values()) / 12), [r["congestion_index"] for r in rows if r["month"] == 3]
    grown = (1 + growth) ** (3 / 12)
    march = next(r for r in got if r["direction"] == "import" and r["month"] == 3)
    assert march["pred_shipment_count"] == round(sum(r["shipment_count"] for r in recent) / len(recent) * factor * grown)
    assert math.isclose(march["congestion_index"], min(1, sum(index) / len(index) * factor * min(1.1, grown)), rel_tol=1e-9)
    assert march["dominant_cargo_type"] is None and march["dominant_hs2"] == "x" and march["season"] == "Autumn"
    bare = forecast.port_forecast(params, seasons.limit(0)).where("port = 'P' and direction = 'import' and month = 1").first()
    assert math.isclose(bare["congestion_index"], 0.35 * min(1.1, (1 + growth) ** (1 / 12)), rel_tol=1e-9)
    assert forecast.port_params(indexed, year_floor=2001).count() == 0


def test_map_ports(spark):
    months = spark.createDataFrame([("import", "A", 0.1, 0.1, 0.0), ("import", "A", 0.3, 0.5, 0.1), ("import", "B", 0.2, 0.2, 0.0), ("import", "C", 0.9, 0.9, 0.0), ("import", "JUNK", 1.0, 1.0, 1.0), ("import", None, 1.0, 1.0, 1.0)], "direction string, port string, ci_raw double, ci_adjusted double, pct_closed double")
    bridge = spark.createDataFrame([("A", "CLAAA001"), ("JUNK", "X001")], "port string, port_code string")
    places = spark.createDataFrame([("A", -33.0, -71.0), ("B", -20.0, -70.0), ("JUNK", 0.0, 0.0), (None, 1.0, 1.0)], "port string, lat double, lng double")
    got = [(r["port"], r["port_code"], r["lat"], round(r["ci_adjusted"], 6), round(r["closed_pct"], 6), r["congestion_label"], r["delay_label"]) for r in marts.map_ports(months, bridge, places, ["JUNK"]).collect()]
    assert got == [("A", "CLAAA", -33.0, 0.3, 5.0, "High", "High"), ("B", None, -20.0, 0.2, 0.0, "Moderate", "Moderate")]


def test_vessels_without_a_number_stay_apart(spark):
    rows = [("f1", "A", "t", "expected_vessels", "Mar Azul", None), ("f2", "A", "t", "expected_vessels", "MAR AZUL", None), ("f1", "A", "t", "expected_vessels", "Mar Azul II", None), ("f1", "A", "t", "expected_vessels", "Mar Bravo", " "), ("f1", "A", "t", "expected_vessels", "Mar Bravo II", ""), ("f1", "A", "t", "expected_vessels", None, "7")]
    df = spark.createDataFrame(rows, "file_name string, port_code string, scrape_timestamp string, list string, vessel_name string, imo string")
    got = sorted((r["vessel_name"], r["file_name"]) for r in snapshots.search_vessels(df, "mar").collect())
    assert got == [("MAR AZUL", "f2"), ("Mar Azul II", "f1"), ("Mar Bravo", "f1"), ("Mar Bravo II", "f1")]
    assert [r["imo"] for r in snapshots.search_vessels(df, "7").collect()] == ["7"]


def test_periods_and_weights(spark):
    df = spark.createDataFrame([(2020, 12), (2021, 1), (2022, 6), (2019, 10), (None, 3)], "year int, month int")
    year, month = exprs.of_period(exprs.period(F.col("year"), F.col("month")))
    got = [tuple(r) for r in df.select("year", "month", year, month, evaluate.sample_weight()).collect()]
    assert [g[2:4] for g in got] == [(2020, 12), (2021, 1), (2022, 6), (2019, 10), (None, None)] and [g[4] for g in got] == [0.1, 0.2, 0.4, 1.0, 1.0]


@pytest.mark.parametrize("name", ["c19_default_model", "d49_top_commodities", "h7_port_forecast", "h34_forecast_all"])
def test_declarations_are_read_once(spark, name):
    """What reads a panel more than once reads a stored one: the plan of the result holds no line items."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_partkey" not in plan


@pytest.mark.parametrize("name, labels", [
    ("c19_default_model", set()), ("h18_model_elastic_net", set()), ("h18_model_gbt_absolute", set()), ("h18_model_gbt_sampled", set()), ("h36_linear_attribution", set()),
    ("h7_port_forecast", {"dominant_hs2", "dominant_cargo_type", "dominant_continent"}),
])
def test_labels_that_nobody_reads_are_not_stored(spark, monkeypatch, name, labels):
    """What is stored is computed: the most frequent labels of a month are dear, so queries of numbers must not write them."""
    class Seen(Exception):
        pass

    def stored(df, _name):
        raise Seen(df)

    monkeypatch.setattr(catalog.tables, "stored", stored)
    with pytest.raises(Seen) as seen:
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    df = seen.value.args[0]
    assert {c for c in df.columns if c.startswith("dominant_")} == labels
    assert df._jdf.queryExecution().optimizedPlan().toString().count("mode(") == len(labels)


def test_names_are_looked_up_behind_the_last_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = declarations.declarations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    where = {k: next(i for i, line in enumerate(joins) if f"{k}#" in line) for k in ("s_nationkey", "c_nationkey", "l_partkey", "l_orderkey")}
    assert max(where["s_nationkey"], where["c_nationkey"]) < where["l_partkey"] < where["l_orderkey"]  # outer joins stand first


def test_declarations_of_odd_rows(spark, tmp_path):
    one = {"nation": "select 1L n_nationkey, 'PERU' n_name, 2L n_regionkey", "region": "select 2L r_regionkey, 'AMERICA' r_name", "supplier": "select 3L s_suppkey, 1L s_nationkey", "customer": "select 4L c_custkey, 1L c_nationkey",
           "part": "select 5L p_partkey, 't' p_type, 'b' p_brand, 'n' p_name", "orders": "select 6L o_orderkey, 4L o_custkey, 'low' o_orderpriority union all select 7L, 99L, 'low'",
           "lineitem": "select * from values (6L, 5L, 3L, date'1998-12-31', 'O', 2D), (6L, 5L, 3L, date'1998-01-01', 'F', 3D), (6L, 5L, 3L, null, null, 4D), (7L, 5L, 3L, date'1998-01-01', 'F', 5D), (6L, 55L, 3L, null, 'F', 6D), (6L, 5L, null, null, 'F', 7D) t(l_orderkey, l_partkey, l_suppkey, l_shipdate, l_linestatus, l_quantity)"}
    for name, sql in one.items():
        df = spark.sql(sql)
        (df.selectExpr("*", "l_quantity * 1.5D l_extendedprice", "'R' l_returnflag") if name == "lineitem" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = declarations.declarations(spark, str(tmp_path)).orderBy("quantity").collect()
    assert [(r.year, r.month, r.direction, r.weight_kg, r.quantity, r.port, r.continent) for r in rows] == [
        (1998, 12, "import", None, 2.0, "PERU", "AMERICA"), (1998, 1, "export", 30.0, 3.0, "PERU", "AMERICA"), (None, None, "export", None, 4.0, "PERU", "AMERICA"),
    ]


@pytest.mark.parametrize("name", ["d49_top_commodities", "h14_commodity_scores", "k12_commodity_month"])
def test_descriptions_that_nobody_reads_are_not_counted(spark, monkeypatch, name):
    """What is stored without its descriptions needs no names of parts, and no sort of all line items to count them."""
    plans = []
    kept = tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, what))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    of_items = [p for p in plans if "l_partkey" in p]
    assert len(of_items) == 1 and "p_type" in of_items[0] and "p_name" not in of_items[0]


def test_bucketed_features_count_no_labels(spark, monkeypatch):
    plans = []
    kept = tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, what))
    catalog.QUERIES["a10_bucketed_features"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "collect_set" in plans[0] and "mode(" not in plans[0]


#: Line items with and without dates, states, measures and labels; two nations of one name.
_ODD = {"nation": "select 1L n_nationkey, 'PERU' n_name, 2L n_regionkey union all select 8L, 'CHILE', 2L union all select 9L, 'CHILE', 2L", "region": "select 2L r_regionkey, 'AMERICA' r_name",
        "supplier": "select * from values (3L, 1L), (31L, 8L), (32L, 9L) t(s_suppkey, s_nationkey)", "customer": "select 4L c_custkey, 1L c_nationkey union all select 41L, 8L union all select 42L, 77L",
        "part": "select * from values (5L, 't', 'b', 'n'), (51L, null, 'b', 'n'), (52L, 'a', 'c', 'n') t(p_partkey, p_type, p_brand, p_name)",
        "orders": "select * from values (6L, 4L, 'low'), (61L, 41L, null), (62L, 41L, 'urgent') t(o_orderkey, o_custkey, o_orderpriority)",
        "lineitem": "select * from values (6L, 5L, 3L, date'1998-12-31', 'O', 2D), (61L, 51L, 31L, date'1998-01-01', 'F', 3D), (61L, 52L, 32L, date'1998-01-01', null, 4D), (62L, 52L, 31L, date'1998-01-02', 'F', null), (6L, 5L, 3L, null, null, 4D) t(l_orderkey, l_partkey, l_suppkey, l_shipdate, l_linestatus, l_quantity)"}


@pytest.mark.parametrize("more, whole", [
    ({}, True), ({"orders": "select 62L, 42L, 'low'"}, False),  # the second order has a customer of no nation
    ({"orders": "select 62L, 4L, 'low'"}, False), ({"part": "select 5L, 'u', 'b', 'n'"}, False), ({"nation": "select 1L, 'CUBA', 2L"}, False), ({"customer": "select 4L, 8L"}, False),
    ({"lineitem": "select 6L, 55L, 3L, date'1998-12-31', 'O', 6D union all select 6L, null, 3L, date'1998-12-31', 'O', 6D"}, False), ({"lineitem": "select 66L, 5L, 3L, date'1998-12-31', 'O', 7D"}, False),
    # one line item is lost and one is doubled, so that the counts agree
    ({"lineitem": "select 66L, 52L, 31L, date'1998-01-02', 'F', 7D", "orders": "select 62L, 4L, 'low'"}, False), ({"lineitem": "select 6L, 5L, null, date'1998-12-31', 'O', 8D"}, True),
])
def test_panels_of_declarations_apart_are_those_of_the_joined_ones(spark, tmp_path, more, whole):
    for name, sql in _ODD.items():
        df = spark.sql(f"{sql} union all {more[name]}" if name in more else sql)
        (df.selectExpr("*", "l_quantity * 1.5D l_extendedprice", "'R' l_returnflag") if name == "lineitem" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    apart = panel.monthly_panel_apart(*declarations.declarations_apart(spark, str(tmp_path)), cargo=declarations.CARGO)
    assert apart.where("not whole").isEmpty() == whole
    joined = panel.monthly_panel(declarations.declarations(spark, str(tmp_path)), cargo=declarations.CARGO)
    for modes in (tuple(panel.MODES), ("dominant_continent",), ()):
        got = catalog.the_panel(spark, str(tmp_path), modes)
        want = joined.drop(*[m for m in panel.MODES if m not in modes])
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["d1_monthly_panel", "h1_features", "k7_weather_adjust", "k9_map_ports", "k9_port_overview", "d12_trend_params", "h36_permutation_importance"])
def test_measures_are_not_shuffled_with_orders_or_parts(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def stored(df, _name):
        raise Seen(df)

    monkeypatch.setattr(catalog.tables, "stored", stored)
    with pytest.raises(Seen) as seen:
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = seen.value.args[0]._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "Project [" in line and ("l_orderkey#" in line or "l_partkey#" in line)]
    assert rows and not any("l_extendedprice" in line or "l_quantity" in line or ("l_orderkey#" in line and "l_partkey#" in line) for line in rows)


def test_ports_are_compared_by_counts_of_goods(spark, tmp_path, monkeypatch):
    plans = []
    kept = tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, what: plans.append((what, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df, what))
    catalog.QUERIES["k10_port_compare"](spark, "/root/testdata/sf0.001")
    assert [name for name, _ in plans] == ["items", "buyers", "goods"]
    assert not any("l_extendedprice" in line for name, plan in plans[1:] for line in plan.splitlines() if "Project [" in line)
    for part, whole in (("", True), (" union all select 5L, 'u', 'b', 'n'", False)):
        for name, sql in _ODD.items():
            df = spark.sql(sql + (part if name == "part" else ""))
            (df.selectExpr("*", "l_quantity * 1.5D l_extendedprice", "'R' l_returnflag") if name == "lineitem" else df).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        apart = declarations.declarations_apart(spark, str(tmp_path))
        assert panel.is_whole(*apart) == whole and panel.is_whole(*[view.limit(0) for view in apart])
        if whole:  # a line item without a date counts
            joined = declarations.declarations(spark, str(tmp_path)).groupBy("hs2", "direction", "port").count()
            goods = apart[2].where("first").groupBy("hs2", "direction", "port").sum("n")
            assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, goods.collect()), key=str)
