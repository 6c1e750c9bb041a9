"""Learners, recursion, vessel pages and saved tables against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.config import VESSEL_FIELDS, Breaks, clean_years
from tidewright.functions import exprs as x
from tidewright import catalog
from tidewright.operators import evaluate, features, forecast, marts, models, panel, stats
from tidewright.sources import pages, tables
from tidewright.streaming import rollup

BREAKS = Breaks(1998, 1999, 9999, 1995)
KEYS = ("port", "direction")


def feature_rows(spark, months=72, skip=()):
    """Two series with a season and a trend, as panels have them."""
    rows = []
    for port, level in (("P", 50.0), ("Q", 9.0)):
        for i in range(months):
            if (port, i) not in skip:
                n = float(level + i + 10 * np.sin(2 * np.pi * i / 12))
                rows.append((port, "import", 1995 + i // 12, i % 12 + 1, int(n), 10.0 * n, None if i % 5 == 0 else 2.0 * n, n, i % 4, 2, 3, 1, 1, 2, 0, 4, 10.0))
    names = "shipment_count long, total_value_usd double, total_weight_mt double, total_quantity double, commodity_diversity long, hs4_diversity long, country_diversity long, continent_diversity long, cnt_general long, cnt_bulk long, cnt_refrigerated long, cnt_container long, avg_value_per_shipment_usd double"
    return features.build_features(spark.createDataFrame(rows, f"port string, direction string, year int, month int, {names}"), breaks=BREAKS)


def test_ridge_of_each_series(spark):
    rng = np.random.default_rng(1)
    data = [("ab"[i % 2], "d", *map(float, rng.normal(size=2)), 7.0, None if i == 5 else float(rng.normal() + 30)) for i in range(60)]
    df = spark.createDataFrame(data, "port string, direction string, u double, v double, same double, y double")
    got = {r.port: r for r in models.SeriesRidge(("u", "v", "same"), 2.0, KEYS, "y").fit(df).coefficients.collect()}
    for port in "ab":
        z = np.array([r[2:4] for r in data if r[0] == port and r[5] is not None])
        y = np.array([r[5] for r in data if r[0] == port and r[5] is not None])
        s = (z - z.mean(0)) / z.std(0)
        b = np.linalg.solve(s.T @ s + 2 * np.eye(2), s.T @ (y - y.mean())) / z.std(0)
        left = y - y.mean() - (z - z.mean(0)) @ b
        assert got[port].coefficients == pytest.approx([*b, 0.0]) and got[port].intercept == pytest.approx(y.mean() - z.mean(0) @ b) and got[port].sigma == pytest.approx(left.std())


def test_trend_model_has_an_interval(spark):
    f = feature_rows(spark)
    got = models.trend_seasonal(f.where("year < 2000"), f.where("year = 2000").select(*KEYS, "year", "month"), (1997,), 1)
    rows = got.join(f.select(*KEYS, "year", "month", "shipment_count"), [*KEYS, "year", "month"]).collect()
    assert {r.port for r in rows} == {"P"} and len(rows) == 12  # only the largest series
    assert all(r.lower <= r.prediction <= r.upper for r in rows) and np.mean([abs(r.prediction - r.shipment_count) / r.shipment_count for r in rows]) < 0.1


def test_features_that_say_the_same_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 1.0), (2.0, 4.0, 1.0, 1.0), (3.0, 6.1, None, 1.0)], "a double, b double, c double, d double")
    assert stats.select_features(df, ["a", "b", "c", "d"]) == ["a", "c", "d"] and stats.select_features(df.limit(1), ["a", "b"]) == ["a", "b"]


@pytest.mark.parametrize("kind", ["ridge", "gbt"])
def test_learners_beat_nothing_and_errors_are_rows(spark, kind):
    class Broken:
        def fit(self, train):
            raise ValueError("no such thing " * 20)

    folds = evaluate.walk_forward(feature_rows(spark), ((1998, 1999), (1999, 2000)))
    model = models.Pooled(kind, ("lag_1", "lag_12_clean", "rolling_12_mean", "month_sin"), weights={1998: 0.5}, break_years=BREAKS.years, rounds=30, limit=2.0)
    got = evaluate.evaluate_models(folds, {kind: model, "broken": Broken()}, (1999, 2000)).collect()
    bad = [r for r in got if r.error]
    assert {(r.model, r.fold_year) for r in bad} == {("broken", 1999), ("broken", 2000)} and all(len(r.error) == 120 and r.port is None for r in bad)
    # boosted trees see nothing from the validation year on, and trees do not follow a trend beyond what they have seen
    assert len(got) == 6 and all(r.mape < {"ridge": 30, "gbt": 50}[kind] and r.features_used == ["lag_1", "lag_12_clean", "rolling_12_mean", "month_sin"] for r in got if not r.error)


class Naive:
    """A fitted model that says what the naive recursion says."""

    features = ("lag_12_clean", "yoy_growth_clean")

    def transform(self, df):
        return df.withColumn("prediction", F.greatest(F.lit(1.0), F.col("lag_12_clean") * (1 + F.col("yoy_growth_clean"))))


def test_recursion_takes_the_mean_for_a_missing_month_and_feeds_itself(spark):
    f = feature_rows(spark, skip={("Q", 64)})  # Q lacks a month of the seed
    years = clean_years(1995, 2000, BREAKS)
    plain = {}
    for port in "PQ":
        rows = sorted((r for r in f.where(f"year = 2000 and port = '{port}'").collect()), key=lambda r: r.month)
        g, state = float(np.clip(np.median([r.yoy_growth_clean for r in rows]), -0.15, 0.15)), [(r.month, float(r.shipment_count)) for r in rows]
        for m in range(1, 13):
            same = [v for k, v in state if k == m]
            state.append((m, max(1.0, (same[-1] if same else np.mean([v for _, v in state])) * (1 + g))))
            plain[port, m] = state[-1][1]
    for got in (forecast.recursive_naive(f, 2001, clean_years=years), forecast.recursive_forecast(f, Naive(), 2001, clean_years=years)):
        found = {(r.port, r.month): r.prediction for r in got.collect()}
        assert found == pytest.approx(plain) and {r.year for r in got.select("year").collect()} == {2001}


def test_recursion_of_a_fitted_learner(spark):
    f = feature_rows(spark)
    fitted = models.SeriesRidge(("lag_1", "lag_12_clean", "rolling_12_mean"), 1.0).fit(f.where("year < 2000"))
    got = forecast.recursive_forecast(f, fitted, 2000, base_year=1995).join(f.select(*KEYS, "year", "month", "shipment_count"), [*KEYS, "year", "month"]).collect()
    assert len(got) == 24 and np.mean([abs(r.prediction - r.shipment_count) / r.shipment_count for r in got]) < 0.25


def test_gate_looks_at_the_lagged_row(spark):
    skip = {("P", i) for i in range(36, 42)}  # half of 1998 is missing, so rows of 2000 lag into 1998
    rows = {(r.year, r.month): r for r in feature_rows(spark, skip=skip).where("port = 'P'").collect()}
    for r in rows.values():
        assert r.lag_12_is_break in (0, 1) and (r.lag_12_is_break or r.lag_12_clean == r.lag_12)
    assert rows[2000, 1].lag_12_is_break == 1 and rows[1999, 2].lag_12_is_break == 0 and rows[1999, 2].lag_12_clean == rows[1999, 2].lag_12


def test_index_takes_a_null_weight_as_nothing(spark):
    f = features.congestion_index(feature_rows(spark))
    assert f.where("w_norm is null or cd_norm is null").count() == 0 and f.where("total_weight_mt is null").agg(F.max("w_norm"), F.max("weight_per_shipment_mt")).first() == (0.0, 0.0)


PORT_PAGE = """<div class="pei"><span>Expected ships: <b>12</b></span> Ships in port: 3</div>
<section id="expected"><table><tbody>
<tr><td>Jan 1, 10:00</td><td><a class="named-item" href="/vessels/details/9811000"><div class="m-flag-small" title="Chile"></div><div class="named-title">MAR
 AZUL</div><div class="named-subtitle">Container Ship</div></a></td><td class="v5 col-y">2018</td><td class="col-gt">219,079</td><td class="col-dwt">-</td><td class="col-sizes">400 x 59</td></tr>
<tr><td>only a time</td></tr></tbody></table></section>
<section class="s" id="in-port"><tr><td></td><td><div class="named-title">OTRO</div></td><td class="col-y">x</td></tr></section>"""


def test_vessel_rows(spark):
    df = spark.createDataFrame([(1, PORT_PAGE), (2, None), (3, "")], "page_id long, html string")
    assert [tuple(r) for r in pages.port_counters(df).orderBy("page_id").collect()] == [(1, 12, 3), (2, None, None), (3, None, None)]
    got = [tuple(r) for r in pages.vessel_rows(df).orderBy("list", "pos").collect()]
    assert got == [(1, "expected", 1, "Jan 1, 10:00", "MAR AZUL", "Container Ship", "9811000", "Chile", 2018, 219079, None, "400 x 59"), (1, "in-port", 1, None, "OTRO", None, None, None, None, None, None, None)]
    html = "".join(f"<tr><th>{a}</th><td>{b}</td></tr>" for a, b in (("Flag", "Chile"), ("Ship type", "Tanker"), ("Year built", "1999"), ("Draught", "-"), ("Country", "Peru")))
    r = pages.extract_fields(spark.createDataFrame([(1, html)], "page_id long, html string"), "<th>([^<]*)</th><td>([^<]*)</td>", VESSEL_FIELDS).first()
    assert (r.flag, r.vessel_type, r.built, r.draught, r.eta) == ("Peru", "Tanker", "1999", None, None)


def test_small_expressions(spark):
    df = spark.createDataFrame([(" 1,00", 0.1), ("10", 1.55), (None, None), ("1", 9.0)], "c string, f double")
    got = df.select(x.is_transport_mode(F.col("c")), x.activity_index(F.col("f")), x.size_class(F.col("f"), (0.15, 0.3))).collect()
    assert [tuple(r) for r in got] == [(True, 0.0, 5), (False, pytest.approx(0.5), 10), (None, None, 5), (True, 1.0, 10)]
    assert clean_years(1996, 2001, BREAKS, (2001,)) == [1996, 1997, 2000]


def test_panels_and_tables_are_kept(spark, tmp_path):
    f = feature_rows(spark)
    panel_path = str(tmp_path / "panel")
    tables.save_panel(f, panel_path)
    one = panel.single_series(tables.load_panel(spark, panel_path), port="Q", direction="import")
    assert one.count() == f.where("port = 'Q'").count() and "EqualTo(port,Q)" in one._jdf.queryExecution().toString()
    (tmp_path / "raw" / "year=1999").mkdir(parents=True)
    (tmp_path / "raw" / "year=1999" / "a.csv").write_text("a;b\n1;x\n")
    raw = tables.read_raw(spark, str(tmp_path / "raw"), T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())]), ";")
    assert [tuple(r) for r in raw.collect()] == [(1, "x", 1999)]
    tables.write_table(raw, "parquet", "overwrite", path=str(tmp_path / "w"))
    assert tables.read_table(spark, "parquet", path=str(tmp_path / "w")).collect() == raw.collect()
    assert tables.materialize(raw, "kept_rows").count() == 1
    tables.export_feed(raw, str(tmp_path / "feed"))
    assert spark.read.json(str(tmp_path / "feed")).first().b == "x"
    assert tables.coerce_schema(spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as t")).dtypes == [("t", "timestamp_ntz")]


def test_rankings(spark):
    df = spark.createDataFrame([("p", "a", 1), ("p", "b", 3), ("p", "c", 3), ("q", "a", None)], "port string, hs2 string, v int")
    assert [(r.hs2, r.side) for r in marts.both_ends(df, "v", 1, "hs2").collect()] == [("b", "largest"), ("a", "smallest")]
    assert [(r.hs2, r.rank) for r in marts.first_in_rank(df, ["port"], "v", 2, "hs2").where("port = 'p'").orderBy("rank").collect()] == [("b", 1), ("c", 2)]


def test_shares_without_a_key(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.0), ("a", 1.0), ("d", None)], "name string, v double")
    assert {(r.name, r.v, r.share_pct) for r in marts.top_n_share(df, "name", "v", 2).collect()} == {("a", 6.0, 60.0), ("b", 3.0, 30.0), ("Others", 1.0, 10.0)}
    assert [(r.name, r.share_pct) for r in marts.top_n_share(df.where("name = 'a'"), "name", "v", 2).collect()] == [("a", 100.0)]


def test_scores_of_one_batch_do_not_tie_by_chance(spark, tmp_path):
    rows = [("A", "2024-01-01 00:00:00", 5.0, 1), ("A", "2024-01-01 00:00:00", 3.0, 2), ("A", "2024-01-01 00:00:00", 9.0, 1)]
    spark.createDataFrame(rows, "port_code string, ts string, operability double, seen int").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("port_code string, ts timestamp, operability double, seen int").parquet(str(tmp_path / "s"))
    for name, order, want in (("o1", "seen", 3.0), ("o2", None, 9.0)):
        rollup.stream_scores(stream, str(tmp_path / name), str(tmp_path / f"{name}-ck"), order).awaitTermination(120)
        assert [r.operability for r in spark.read.parquet(str(tmp_path / name)).collect()] == [want]


# ---- early stopping, penalty paths, routing, importance ----

def test_patience_outlasts_a_plateau():
    plateau = [9.0, 8.0, 7.0, 7.0, 7.1, 7.0, 6.5, 6.6, 6.7, 6.8, 6.9]
    assert models.best_round(plateau, 2) == (3, True)  # stops on the plateau
    assert models.best_round(plateau, 4) == (7, True)  # the best round lies behind it
    assert models.best_round(plateau, 5) == (7, False) and models.best_round([5.0], 3) == (1, False)


def test_trees_are_cut_at_the_best_round(spark):
    f = feature_rows(spark).where("year < 2000")
    model = models.Pooled("gbt", ("lag_12_clean", "month_sin"), break_years=BREAKS.years, rounds=12, patience=3, limit=2.0)
    fitted = model.fit(f)
    assert 1 <= fitted.chosen["rounds"] <= 12 and fitted.fitted.getNumTrees == fitted.chosen["rounds"]
    table = models.importance(fitted)
    rows = {r.feature: r for r in table.collect()}
    splits = sum(t.numNodes // 2 for t in fitted.fitted.trees)
    assert sum(r.split_count for r in rows.values()) == splits > 0 and sum(r.gain for r in rows.values()) == pytest.approx(1)
    one = models.Pooled("random_forest", ("lag_12_clean", "month_sin"), trees=1, depth=1, limit=2.0).fit(f)
    assert sorted(r.split_count for r in models.importance(one).collect()) == [0, 1]
    of_commodities = models.Pooled.of_commodities("gbt")
    assert (of_commodities.rounds, of_commodities.short, len(of_commodities.features)) == (300, (12, 3, 6), 22)


def test_penalty_path_of_a_series():
    rng = np.random.default_rng(5)
    for case in range(20):
        n, k = 40, 4
        x = rng.normal(size=(n, k)) * [1, 10, 0.1, 1] + [5, 0, 1, 3]
        x[:, 3] = x[:, 1] * 2 + (0 if case % 2 else 30) * rng.normal(size=n)  # a twin in half of the cases
        y = 3 + x @ [1, 0.2, -4, 0] + rng.normal(size=n) * (1 + case)
        train, valid = np.arange(n) < 25, (np.arange(n) >= 25) & (np.arange(n) < 35)
        keep = [0, 1, 2] if abs(np.corrcoef(x[:, 1], x[:, 3])[0, 1]) > 0.95 else [0, 1, 2, 3]

        def plain(rows, a):
            z = (x[rows][:, keep] - x[rows][:, keep].mean(0)) / x[rows][:, keep].std(0)
            w = np.linalg.solve(z.T @ z + a * np.eye(len(keep)), z.T @ (y[rows] - y[rows].mean())) / x[rows][:, keep].std(0)
            return y[rows].mean() - w @ x[rows][:, keep].mean(0), w

        penalties = (0.01, 0.1, 1.0, 10.0, 100.0)
        errors = [np.mean((y[valid] - b - x[valid][:, keep] @ w) ** 2) for b, w in (plain(train, a) for a in penalties)]
        b, w = plain(np.ones(n, bool), penalties[int(np.argmin(errors))])
        got = models.ridge_path(x, y, train, valid, penalties)
        assert got[3] == penalties[int(np.argmin(errors))] and got[0] == pytest.approx(b) and got[1][keep] == pytest.approx(w) and (len(keep) == 4 or got[1][3] == 0)
    none = np.zeros(n, bool)
    assert models.ridge_path(x, y, none, valid, penalties)[3] == models.ridge_path(x, y, train, none, penalties)[3] == 1.0
    assert models.ridge_path(np.ones((3, 2)), np.array([1.0, 2.0, 3.0]), none[:3], none[:3], penalties)[:1] == (2.0,)


def test_validation_rows_follow_all_training_rows(spark):
    rows = [(p, "d", y, m, t) for p, years in (("two", (1995, 1996, 1997, 1998)), ("one", (1997, 1998))) for y in years for m in range(1, 13) for t in [False]] + [("two", "d", 1999, 1, True)]
    df = spark.createDataFrame(rows, "port string, direction string, year int, month int, is_test boolean")
    got = evaluate.inner_validation(df, (1998,), KEYS).collect()
    pick = lambda flag, port: sorted({r.year for r in got if r[flag] and r.port == port})
    assert pick("is_train", "two") == [1995, 1996] and pick("is_valid", "two") == [1997]  # 1998 follows and is in neither
    assert pick("is_train", "one") == [1997] and pick("is_valid", "one") == [1998]
    assert not any(r.is_train or r.is_valid for r in got if r.is_test)
    brief = evaluate.inner_validation(df.where("port = 'one' and month < 9"), (1998,), KEYS, short=(12, 3, 6)).collect()
    assert sum(r.is_valid for r in brief) == 6 and sum(r.is_train for r in brief) == 10


def test_series_are_forecast_by_their_own_model(spark):
    f = feature_rows(spark)
    years = clean_years(1995, 1999, BREAKS)
    kinds = {"naive": evaluate.seasonal_naive(), "rolling": evaluate.rolling_mean(), "ridge": models.SeriesRidgePath(("lag_1", "lag_12_clean"), break_years=BREAKS.years), "other": Naive()}
    fitted = evaluate.fit_models(f.where("year < 2000"), {n: m for n, m in kinds.items() if n != "other"}) | {"other": kinds["other"]}
    how = {"clean_years": years, "base_year": 1995}
    every = forecast.forecast_by_model(f, f.select(*KEYS).distinct().withColumn("model", F.explode(F.array(*map(F.lit, fitted)))), fitted, 2000, **how)
    plain = {(r.port, r.model, r.month): r.prediction for r in every.collect()}
    assert len(plain) == 2 * 4 * 12
    for name, model in fitted.items():
        if name in ("ridge", "other"):
            alone = {(r.port, r.month): r.prediction for r in forecast.recursive_forecast(f, model, 2000, **how).collect()}
            assert alone == pytest.approx({(p, m): v for (p, n, m), v in plain.items() if n == name})
    naive = {(r.port, r.month): r.prediction for r in forecast.recursive_naive(f, 2000, clean_years=years).collect()}
    assert naive == pytest.approx({(p, m): v for (p, n, m), v in plain.items() if n == "naive"})
    selection = spark.createDataFrame([("P", "import", "ridge")], "port string, direction string, selected_model string")
    chosen = forecast.forecast_selected(f, selection, fitted, 2000, **how).collect()
    assert {(r.port, r.model) for r in chosen} == {("P", "ridge"), ("Q", "naive")} and all(r.prediction == pytest.approx(plain[r.port, r.model, r.month]) for r in chosen)
    with pytest.raises(ValueError):
        forecast.forecast_selected(f, selection, {"naive": kinds["naive"]}, 2000)


def test_scores_of_expressions_and_learners_stand_together(spark):
    folds = evaluate.walk_forward(feature_rows(spark), ((1998, 1999), (1999, 2000)))
    got = evaluate.cross_validate(folds, {"naive": evaluate.seasonal_naive(), "ridge": models.SeriesRidgePath(("lag_1", "lag_12_clean"), break_years=BREAKS.years)}, (1999, 2000))
    assert sorted((r.port, r.model, r.fold_year) for r in got.collect()) == sorted((p, m, y) for p in "PQ" for m in ("naive", "ridge") for y in (1999, 2000))

    class Lost:
        def fit(self, train):
            raise RuntimeError("the cluster is gone")

    with pytest.raises(RuntimeError):  # no result of a comparison
        evaluate.evaluate_models(folds, {"lost": Lost()}, (1999,))


def test_attribution_adds_up(spark):
    f = feature_rows(spark)
    fitted = models.SeriesRidgePath(("lag_1", "lag_12_clean", "month_sin")).fit(f.where("year < 2000"))
    parts = models.linear_attribution(fitted, f)
    sums = parts.groupBy(*KEYS, "year", "month").agg(F.sum("contribution").alias("c"))
    rows = fitted.transform(f).join(sums, [*KEYS, "year", "month"]).collect()
    for port in "PQ":
        mine = [r for r in rows if r.port == port]
        mean = np.mean([r.prediction for r in mine])  # no prediction is at the floor
        assert all(r.prediction - mean == pytest.approx(r.c, abs=1e-6) for r in mine)
    rise = {r.feature: r.rise for r in models.permutation_importance(Naive(), f.where("yoy_growth_clean is not null")).collect()}
    assert set(rise) == {"lag_12_clean", "yoy_growth_clean"} and rise["lag_12_clean"] > 5


def test_training_rows_lie_in_few_partitions(spark, monkeypatch):
    """A tree is several jobs over the training rows: they must not have a task for each shuffle partition."""
    seen = []

    def grown(self, rows):
        seen.append(rows.rdd.getNumPartitions())
        return None, {}

    monkeypatch.setattr(models.Pooled, "_fit_boosted", grown)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        models.Pooled("gbt", ("lag_1", "lag_12_clean"), break_years=BREAKS.years).fit(feature_rows(spark))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert seen == [1]


# ---- rows of boosted learners ----

def test_sampled_trees_do_not_depend_on_the_layout_of_rows(spark):
    f = feature_rows(spark).where("year < 2000")
    model = models.Pooled("gbt_sampled", ("lag_1", "lag_12_clean", "month_sin"), break_years=BREAKS.years, rounds=4, patience=1, limit=2.0)
    found = []
    for n in (1, 7):
        spread = f.repartition(n, "month").cache()  # no shuffle of its own brings these in one order
        found.append(sorted((r.port, r.direction, r.year, r.month, r.prediction) for r in model.fit(spread).transform(f).collect()))
    assert found[0] == found[1]


@pytest.mark.parametrize("kind", ["gbt_absolute", "gbt_sampled"])
def test_folds_and_scales_are_stored(spark, monkeypatch, kind):
    """Fitting reads a fold many times, so neither its windows nor the means of its series are computed with each reading."""
    monkeypatch.setattr(catalog, "_ROUNDS", 2)
    plan = catalog.QUERIES[f"h18_model_{kind}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1  # the scores
