"""Forecasts: closed-form trend with seasonality, and twelve-step recursion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONGESTION_CUTS, SEASON_CUTS
from ..functions.exprs import activity_index, add_months, bin_label, clamp, compound, cyclic, half_even, quarter, safe_div, season

from ..sources.tables import discard, stored
from .models import Fitted


def forecast_grid(params: DataFrame, horizon: int = 12) -> DataFrame:
    """Each series times steps 1..horizon, with the year and month of the step."""
    df = params.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    year, month = add_months(F.col("last_year"), F.col("last_month"), F.col("step"))
    return df.withColumns({"year": year, "month": month})


def seasonal_trend_forecast(params: DataFrame, seasonal: DataFrame, measures: dict[str, str], growth: str, keys: Sequence[str] = ("port", "direction"), horizon: int = 12, default_growth: float = 0.025, bounds: tuple[float, float] = (-0.30, 0.40)) -> DataFrame:
    """pred_<measure> = average * factor of the month (1 if unknown) * (1 + growth) ^ (step / 12), growth within bounds, 0 or null growth as the default.

    measures: measure -> its factor column in `seasonal`; params has avg_<measure>.
    """
    df = forecast_grid(params, horizon).join(seasonal, [*keys, "month"], "left")
    g = clamp(F.coalesce(F.nullif(F.col(growth), F.lit(0.0)), F.lit(default_growth)), *bounds)
    return df.select(*keys, "year", "month", "step", g.alias("growth"), *[compound(F.col(f"avg_{m}") * F.coalesce(F.col(f), F.lit(1.0)), g, F.col("step")).alias(f"pred_{m}") for m, f in measures.items()])


def commodity_forecast(params: DataFrame, seasonal: DataFrame, keys: Sequence[str] = ("hs2", "port", "direction"), horizon: int = 12, default_growth: float = 0.025, bounds: tuple[float, float] = (-0.30, 0.40)) -> DataFrame:
    """Closed-form forecast of value, weight and count of each commodity at a port, with the season's activity and label.

    params: series_params() of total_value_usd, total_weight_mt and shipment_count; seasonal: keys, month, factor_total_value_usd
    and factor_total_weight_mt. Factors are held between 0.1 and 3 (1 if unknown); counts follow the value's season, at least 1.
    The description of a commodity is passed on where params have it.
    """
    df = forecast_grid(params, horizon).join(seasonal, [*keys, "month"], "left")
    s_value, s_weight = (clamp(F.coalesce(F.col(f"factor_{m}"), F.lit(1.0)), 0.1, 3.0) for m in ("total_value_usd", "total_weight_mt"))

    def grown(measure: str, factor: Column) -> Column:
        g = clamp(F.coalesce(F.nullif(F.col(f"growth_{measure}"), F.lit(0.0)), F.lit(default_growth)), *bounds)
        return compound(F.col(f"avg_{measure}") * factor, g, F.col("step"))

    return df.select(
        *keys, "year", "month", season(F.col("month")).alias("season"), F.round(grown("total_value_usd", s_value), 2).alias("pred_value_usd"), F.round(grown("total_weight_mt", s_weight), 2).alias("pred_weight_mt"),
        F.greatest(F.lit(1), F.round(grown("shipment_count", s_value))).cast("int").alias("pred_shipment_count"), F.round(activity_index(s_value), 4).alias("season_activity_index"),
        bin_label(s_value, *SEASON_CUTS).alias("season_label"), *[c for c in ("dominant_description",) if c in params.columns], F.col("n_obs").alias("historical_months"),
    )


#: Averages that a port's closed form publishes beside its predictions, with their digits.
PROFILE = {"commodity_diversity": 1, "hs4_diversity": 1, "country_diversity": 1, "pct_general": 4, "pct_bulk": 4, "pct_refrigerated": 4, "pct_container": 4}
PROFILE_MODES = ("dominant_hs2", "dominant_cargo_type", "dominant_continent")


def port_params(indexed: DataFrame, keys: Sequence[str] = ("port", "direction"), year_floor: int = 2018, least: int = 24) -> DataFrame:
    """Of each series with at least `least` months from year_floor on: its last period, and over these months growths, means and modes."""
    recent = F.col("year") >= year_floor
    weight = F.coalesce(F.col("total_weight_mt"), F.lit(0.0))
    means = {"shipment_count": F.col("shipment_count"), "total_value_usd": F.col("total_value_usd"), "total_weight_mt": weight, "quantity_per_shipment": F.col("avg_quantity_per_shipment"), **{c: F.col(c) for c in PROFILE}}
    out = indexed.groupBy(*keys).agg(
        F.max(F.struct("year", "month")).alias("_last"), F.count_if(recent).alias("n_obs"),
        F.avg(F.when(recent & (F.col("lag_12") > 0), F.col("yoy_growth"))).alias("growth_count"), F.avg(F.when(recent, F.col("yoy_value_growth"))).alias("growth_value"),
        *[F.avg(F.when(recent, c)).alias(f"avg_{name}") for name, c in means.items()], *[F.mode(F.when(recent, F.col(c)), True).alias(c) for c in PROFILE_MODES],
    ).where(F.col("n_obs") >= least)
    return out.withColumns({"last_year": F.col("_last.year"), "last_month": F.col("_last.month")}).drop("_last")


def port_seasons(indexed: DataFrame, keys: Sequence[str] = ("port", "direction"), year_floor: int = 2015) -> DataFrame:
    """keys, month, season_count, season_weight (the month's mean over the mean of the months) and season_index (mean index of the month)."""
    weight = F.coalesce(F.col("total_weight_mt"), F.lit(0.0))
    means = indexed.where(F.col("year") >= year_floor).groupBy(*keys, "month").agg(F.avg("shipment_count").alias("_n"), F.avg(weight).alias("_w"), F.avg("congestion_index").alias("season_index"))
    whole = Window.partitionBy(*keys)
    return means.select(*keys, "month", safe_div(F.col("_n"), F.avg("_n").over(whole)).alias("season_count"), safe_div(F.col("_w"), F.avg("_w").over(whole)).alias("season_weight"), "season_index")


def port_forecast(params: DataFrame, seasons: DataFrame, keys: Sequence[str] = ("port", "direction"), horizon: int = 12, default_growth: float = 0.025, bounds: tuple[float, float] = (-0.30, 0.40), default_index: float = 0.35, digits: bool = True) -> DataFrame:
    """Closed-form forecast of a port: counts, weight (null for imports), quantity, value, congestion index with label, and the series' profile.

    params: port_params(); seasons: port_seasons(). Factors are held between 0.1 and 3 (1 if unknown), counts are at least 1. The
    index is that of the month (default_index if unknown) times the factor of counts within 0.5 and 1.5 and its growth within
    0.95 and 1.1, from 0 to 1. digits=False leaves sums and means unrounded.
    """
    df = forecast_grid(params, horizon).join(seasons, [*keys, "month"], "left")
    s_count, s_weight = (clamp(F.coalesce(F.col(c), F.lit(1.0)), 0.1, 3.0) for c in ("season_count", "season_weight"))
    g_count, g_value = (compound(F.lit(1.0), clamp(F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(default_growth)), *bounds), F.col("step")) for c in ("growth_count", "growth_value"))
    counts = F.col("avg_shipment_count") * s_count * g_count
    index = clamp(F.coalesce(F.col("season_index"), F.lit(default_index)) * clamp(s_count, 0.5, 1.5) * clamp(g_count, 0.95, 1.1), 0.0, 1.0)

    def shown(c: Column, n: int) -> Column:
        return F.round(c, n) if digits else c

    return df.select(
        *keys, "year", "month", season(F.col("month")).alias("season"), F.greatest(F.lit(1), half_even(counts)).cast("int").alias("pred_shipment_count"),
        F.when(F.col("direction") == "export", shown(F.col("avg_total_weight_mt") * s_weight * g_value, 2)).alias("pred_weight_mt"), shown(F.col("avg_quantity_per_shipment") * counts, 2).alias("pred_total_quantity"),
        shown(F.col("avg_total_value_usd") * s_count * g_value, 2).alias("pred_value_usd"), index.alias("congestion_index"), bin_label(index, *CONGESTION_CUTS).alias("congestion_label"),
        *[shown(F.col(f"avg_{c}"), n).alias(f"avg_{c}") for c, n in PROFILE.items()], *PROFILE_MODES,
    )


def active_series(panel: DataFrame, since: int, keys: Sequence[str] = ("hs2", "port", "direction"), month: int = 1) -> DataFrame:
    """The keys of series that were seen in or after a month of a year."""
    return panel.where(F.col("year") * 12 + F.col("month") >= since * 12 + month).select(*keys).distinct()


def forecast_all(forecasts: dict[str, DataFrame], keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """The forecasts of several models in one table: model, keys, year, month, prediction."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("model"), *keys, "year", "month", F.col("prediction").cast("double").alias("prediction")) for name, df in forecasts.items()])


def totals_by_model(forecasts: DataFrame, values: Sequence[str] = ("import", "export"), column: str = "direction") -> DataFrame:
    """Sums of each model by direction, side by side, with their total."""
    out = forecasts.groupBy("model").pivot(column, list(values)).agg(F.sum("prediction"))
    return out.withColumn("total", reduce(lambda a, b: a + b, [F.coalesce(F.col(v), F.lit(0.0)) for v in values]))


def seed_rows(features: DataFrame, target_year: int, keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """The rows that a recursion begins from: of the year before the target, or of a series' last twelve rows if it has none."""
    w = Window.partitionBy(*keys)
    has = F.max((F.col("year") == target_year - 1).cast("int")).over(w)
    back = F.row_number().over(w.orderBy(F.desc("year"), F.desc("month")))
    rows = features.where(F.col("year") < target_year).withColumn("_has", has).withColumn("_b", back)
    return rows.where(((F.col("_has") == 1) & (F.col("year") == target_year - 1)) | ((F.col("_has") == 0) & (F.col("_b") <= 12))).drop("_has", "_b")


def recursive_naive(features: DataFrame, target_year: int, keys: Sequence[str] = ("port", "direction"), limit: float = 0.15, clean_years: Sequence[int] | None = None, horizon: int = 12) -> DataFrame:
    """Recursion of the seasonal naive model over the months that follow the seed: the latest value of the same month, grown by the seed's growth.

    A month that the seed lacks takes the mean of the seed, its own predictions included. The growth is the median growth of the
    seed's clean rows (of all its rows if none is clean) within +-limit; a missing median counts as no growth. Each series is one
    array and the steps are a fold over it, so all series are forecast in one pass.
    """
    clean = F.lit(True) if clean_years is None else F.col("year").isin(*clean_years)
    seeds = seed_rows(features, target_year, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("year", "month", F.col("shipment_count").cast("double").alias("v")))).alias("h"),
        F.coalesce(F.median(F.when(clean, F.col("yoy_growth_clean"))), F.when(~F.max(clean), F.median("yoy_growth_clean"))).alias("g"),
    )
    g = F.coalesce(clamp(F.col("g"), -limit, limit), F.lit(0.0))

    def step(rows: Column, _: Column) -> Column:
        end = F.element_at(rows, -1)
        year, month = add_months(end["year"], end["month"], F.lit(1))
        same = F.filter(rows, lambda r: r["month"] == month)
        mean = F.aggregate(rows, F.lit(0.0), lambda total, r: total + r["v"]) / F.size(rows)
        base = F.when(F.size(same) > 0, F.element_at(same, -1)["v"]).otherwise(mean)
        return F.concat(rows, F.array(F.struct(year.alias("year"), month.alias("month"), F.greatest(F.lit(1.0), base * (1 + F.col("g"))).alias("v"))))

    state = F.transform("h", lambda r: F.struct(r["year"].cast("int").alias("year"), r["month"].cast("int").alias("month"), r["v"].alias("v")))
    out = seeds.select(*keys, "h", g.alias("g")).withColumn("n", F.size("h"))
    out = out.select(*keys, F.explode(F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), state, step), F.col("n") + 1, horizon)).alias("p"))
    return out.select(*keys, F.col("p.year").alias("year"), F.col("p.month").alias("month"), F.col("p.v").alias("prediction"))


#: Features whose mean over the seed stands for the months ahead.
STABLE = (
    "commodity_diversity", "hs4_diversity", "country_diversity", "continent_diversity", "pct_general", "pct_bulk", "pct_refrigerated", "pct_container", "avg_value_per_shipment_usd",
    "weight_per_shipment_mt", "avg_quantity_per_shipment", "lag_value_12", "lag_weight_12", "rolling_value_12_mean", "yoy_value_growth",
)


def recursive_forecast(features: DataFrame, fitted: Fitted, target_year: int, keys: Sequence[str] = ("port", "direction"), limit: float = 0.15, clean_years: Sequence[int] | None = None, base_year: int = 2005, horizon: int = 12) -> DataFrame:
    """Recursion of one fitted model over all series; see forecast_by_model()."""
    every = features.select(*keys).distinct().withColumn("model", F.lit("fitted"))
    return forecast_by_model(features, every, {"fitted": fitted}, target_year, keys, limit, clean_years, base_year, horizon).drop("model")


def _by_model(rows: DataFrame, models: dict[str, Fitted | Column]) -> DataFrame:
    """rows with `prediction` by the model that their column `model` names: all expressions in one pass, one transform for each learner."""
    plain = {n: m for n, m in models.items() if isinstance(m, Column)}
    parts = []
    if plain:
        value = reduce(lambda e, item: F.when(F.col("model") == item[0], item[1].cast("double")).otherwise(e), plain.items(), F.lit(None).cast("double"))
        parts.append(rows.where(F.col("model").isin(*plain)).withColumn("prediction", value))
    for name, fitted in models.items():
        if name not in plain:
            parts.append(fitted.transform(rows.where(F.col("model") == name)))
    columns = [*rows.columns, "prediction"]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def forecast_by_model(features: DataFrame, assigned: DataFrame, models: dict[str, Fitted | Column], target_year: int, keys: Sequence[str] = ("port", "direction"), limit: float = 0.15, clean_years: Sequence[int] | None = None, base_year: int = 2005, horizon: int = 12) -> DataFrame:
    """Recursion of each series by the models assigned to it: keys, model, year, month, prediction.

    assigned: keys and model, a row for each forecast that is wanted, so a series may have several; series that features lack have
    none. models: a fitted learner or an expression over the features for each name. A step builds the features of all series'
    next month from their last 24 values, their own predictions included, makes one pass over the expressions and one transform
    for each learner, and is stored, so that plans do not grow; there is no loop over series. The growth and the means of the
    stable features are those of the seed's clean rows.
    """
    names = [r["model"] for r in assigned.select("model").distinct().limit(len(models) + 1).collect()]
    if set(names) - set(models):
        raise ValueError(f"no model is given for {sorted(set(names) - set(models))}")
    models = {n: m for n, m in models.items() if n in names}
    clean = F.lit(True) if clean_years is None else F.col("year").isin(*clean_years)
    there = [c for c in STABLE if c in features.columns]
    seeds = seed_rows(features, target_year, keys).withColumn("_clean", clean)
    any_clean = F.max("_clean").over(Window.partitionBy(*keys))
    source = seeds.withColumn("_use", F.col("_clean") | ~any_clean)
    state = source.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"), F.col("shipment_count").cast("double").alias("v")))).alias("h"),
        F.coalesce(clamp(F.median(F.when(F.col("_use"), F.col("yoy_growth_clean"))), -limit, limit), F.lit(0.0)).alias("g"), *[F.avg(F.when(F.col("_use"), F.col(c).cast("double"))).alias(c) for c in there],
    )
    state = stored(state.join(assigned.select(*keys, "model").distinct(), list(keys)), "step")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda total, r: total + r["v"]) / F.size(a)
    end = F.element_at("h", -1)
    year, month = add_months(F.col("_y"), F.col("_m"), F.lit(1))
    same = F.filter("h", lambda r: r["month"] == F.col("month"))
    lag_12 = F.when(F.size(same) > 0, F.element_at(same, -1)["v"]).otherwise(mean(F.col("h")))
    back = lambda n: F.when(F.size("h") >= n, F.element_at("h", -n)["v"]).otherwise(F.col("lag_12"))
    last = lambda n: F.slice("h", -F.least(F.size("h"), F.lit(n)), n)
    sin, cos = cyclic(F.col("month"))
    known = {
        "lag_1": end["v"], "lag_2": back(2), "lag_3": back(3), "lag_12_clean": F.col("lag_12"), "rolling_3_mean": mean(last(3)), "rolling_12_mean": mean(last(12)), "yoy_growth": F.col("g"), "yoy_growth_clean": F.col("g"),
        "month_sin": sin, "month_cos": cos, "quarter": quarter(F.col("month")), "year_index": F.col("year") - base_year, **{c: F.lit(0) for c in ("is_shock", "is_rebound", "is_aftershock", "lag_12_is_break")},
    }
    new = F.struct("year", "month", F.greatest(F.lit(1.0), F.col("prediction")).alias("v"))
    longer = F.slice(F.concat("h", F.array("_new")), -F.least(F.size("h") + 1, F.lit(24)), 24)
    for _ in range(horizon if models else 0):  # the same expressions over another state
        rows = state.withColumns({"_y": end["year"], "_m": end["month"]}).withColumns({"year": year, "month": month}).drop("_y", "_m").withColumn("lag_12", lag_12).withColumns(known)
        done = _by_model(rows, models).select(*keys, "model", "h", "g", *there, new.alias("_new"))
        before, state = state, stored(done.withColumn("h", longer).drop("_new"), "step")
        discard(before)
    out = state.select(*keys, "model", F.explode(F.slice("h", -horizon, horizon)).alias("p"))
    return out.select(*keys, "model", F.col("p.year").alias("year"), F.col("p.month").alias("month"), F.col("p.v").alias("prediction"))


def forecast_selected(features: DataFrame, selection: DataFrame, models: dict[str, Fitted | Column], target_year: int, default: str = "naive", keys: Sequence[str] = ("port", "direction"), **how) -> DataFrame:
    """Recursion of every series of features by the model selected for it (selected_model), by the default where nothing is selected."""
    chosen = features.select(*keys).distinct().join(selection.select(*keys, F.col("selected_model").alias("model")), list(keys), "left")
    return forecast_by_model(features, chosen.withColumn("model", F.coalesce("model", F.lit(default))), models, target_year, keys, **how)


def recursive_linear(history: DataFrame, coefficients: Sequence[float], intercept: float, horizon: int = 12, keys: Sequence[str] = ("port", "direction"), target: str = "shipment_count") -> DataFrame:
    """Recursion of a linear model on the last len(coefficients) values (newest first) as a fold over the steps: its own predictions feed it.

    history: the panel; one array of values for each series is the state, so there is no loop on the driver.
    """
    k = len(coefficients)
    series = history.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("year", "month", F.col(target).cast("double").alias("v")))).alias("h")).where(F.size("h") >= k)
    last = F.element_at("h", -1)
    state = F.slice(F.transform("h", lambda s: s["v"]), -k, k)
    weights = F.array(*[F.lit(float(c)) for c in reversed(coefficients)])

    def step(values: Column, _: Column) -> Column:
        dot = F.aggregate(F.zip_with(F.slice(values, -k, k), weights, lambda a, b: a * b), F.lit(float(intercept)), lambda s, x: s + x)
        return F.concat(values, F.array(F.greatest(F.lit(1.0), dot)))

    out = series.select(*keys, last["year"].alias("ly"), last["month"].alias("lm"), F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), state, step).alias("p"))
    out = out.select(*keys, "ly", "lm", F.posexplode(F.slice("p", k + 1, horizon)).alias("i", "prediction"))
    year, month = add_months(F.col("ly"), F.col("lm"), F.col("i") + 1)
    return out.select(*keys, year.alias("year"), month.alias("month"), "prediction")


def published(forecast: DataFrame, model: Column, keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """The output table: raw prediction, its half-even rounding, the model and the time of writing."""
    return forecast.select("year", "month", *keys, F.col("prediction").alias("pred_shipment_count"), model.alias("model"), half_even(F.col("prediction")).cast("int").alias("forecast_shipments"), F.current_timestamp().alias("created_at"))


def forecast_totals(forecast: DataFrame, column: str = "prediction", by: Sequence[str] = ("direction",)) -> DataFrame:
    return forecast.groupBy(*by).agg(F.sum(column).alias("total"))


def annual_growth(panel: DataFrame, forecast: DataFrame, year: int, measure: str = "shipment_count", by: Sequence[str] = ("direction",)) -> DataFrame:
    """Forecast sum against the sum of a year of the panel, in percent."""
    actual = panel.where(F.col("year") == year).groupBy(*by).agg(F.sum(measure).alias("actual"))
    return forecast.groupBy(*by).agg(F.sum("prediction").alias("forecast")).join(actual, list(by), "full_outer").withColumn("growth_pct", 100 * (F.col("forecast") - F.col("actual")) / F.nullif(F.col("actual").cast("double"), F.lit(0.0)))


def forecast_index(forecast: DataFrame, history: DataFrame, column: str, measure: str, keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """Place of a forecast between the series' quietest (0) and busiest month (1), and whether it reaches the peak."""
    ends = history.groupBy(*keys).agg(F.min(measure).alias("_lo"), F.max(measure).alias("_hi"))
    df = forecast.join(ends, list(keys), "left")
    span = F.nullif((F.col("_hi") - F.col("_lo")).cast("double"), F.lit(0.0))
    return df.withColumns({"hist_index": clamp((F.col(column) - F.col("_lo")) / span, 0.0, 1.0), "at_or_above_hist_peak": F.col(column) >= F.col("_hi")}).drop("_lo", "_hi")
