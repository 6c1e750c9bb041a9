"""Lags, rolling means, break-aware features and the congestion index. All windows of a series share one shuffle and sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Breaks, CongestionWeights
from ..functions.exprs import break_flag, clamp, cyclic, growth, quarter, safe_div, season


def series_window(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("year", "month")


def rolling_past(c: str, n: int, keys: Sequence[str]) -> Column:
    """Mean of the n rows before this one."""
    return F.avg(c).over(series_window(keys).rowsBetween(-n, -1))


def rolling_inclusive(c: str, n: int, keys: Sequence[str]) -> Column:
    """Mean of n rows up to this one: it sees its own month, so it is for analysis only."""
    return F.avg(c).over(series_window(keys).rowsBetween(-(n - 1), 0))


def minmax_norm(c: str, keys: Sequence[str]) -> Column:
    """Place of a value between the least and the greatest of its series; null if they are equal. Looks at the whole history."""
    w = Window.partitionBy(*keys)
    return safe_div(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))


def build_features(panel: DataFrame, keys: Sequence[str] = ("port", "direction"), breaks: Breaks = Breaks(), mix: Sequence[str] = ("general", "bulk", "refrigerated", "container"), drop_warm_up: bool = True) -> DataFrame:
    """The feature panel of a monthly panel; mix: cargo classes with a count column cnt_<class>, none at commodity level."""
    w = series_window(keys)
    sin, cos = cyclic(F.col("month"))
    df = panel.withColumns({
        "season": season(F.col("month")), "quarter": quarter(F.col("month")), "year_index": F.col("year") - breaks.base_year, "month_sin": sin, "month_cos": cos,
        **{f"pct_{m}": safe_div(F.col(f"cnt_{m}"), F.col("shipment_count")) for m in mix},
        "weight_per_shipment_mt": safe_div(F.coalesce(F.col("total_weight_mt"), F.lit(0.0)), F.col("shipment_count")),
        "avg_quantity_per_shipment": safe_div(F.col("total_quantity"), F.col("shipment_count")),
        **({} if "avg_value_per_shipment_usd" in panel.columns else {"avg_value_per_shipment_usd": safe_div(F.col("total_value_usd"), F.col("shipment_count"))}),
        **{f"lag_{n}": F.lag("shipment_count", n).over(w) for n in (1, 2, 3, 12)},
        **{f"_lag_{n}": F.lag("shipment_count", n).over(w) for n in (24, 36, 48)},
        "lag_value_12": F.lag("total_value_usd", 12).over(w), "lag_weight_12": F.lag("total_weight_mt", 12).over(w),
        "rolling_3_mean": rolling_past("shipment_count", 3, keys), "rolling_12_mean": rolling_past("shipment_count", 12, keys), "rolling_value_12_mean": rolling_past("total_value_usd", 12, keys),
        "is_shock": break_flag(F.col("year"), breaks.shock), "is_rebound": break_flag(F.col("year"), breaks.rebound), "is_aftershock": break_flag(F.col("year"), breaks.aftershock),
        "lag_12_is_break": F.coalesce(F.lag("year", 12).over(w).isin(*breaks.years).cast("int"), F.lit(0)),
    })
    df = df.withColumns({"yoy_growth": growth(F.col("shipment_count"), F.col("lag_12")), "yoy_value_growth": growth(F.col("total_value_usd"), F.col("lag_value_12"))})
    df = clean_lag(df, breaks)
    return df.where(F.col("lag_1").isNotNull() & F.col("lag_12").isNotNull()) if drop_warm_up else df


def clean_lag(df: DataFrame, breaks: Breaks = Breaks()) -> DataFrame:
    """lag_12_clean: where the row of lag_12 lies in a break year, the first of two, three or four years before that is none, else lag_12; and the growth over it.

    The gate looks at the lagged row, which in a series with gaps is not of the year before.
    """
    good = F.col("lag_12_is_break") == 0
    out = F.when(good, F.col("lag_12"))
    for years, lag in ((2, "_lag_24"), (3, "_lag_36"), (4, "_lag_48")):
        out = out.when(~(F.col("year") - years).isin(*breaks.years) & F.col(lag).isNotNull(), F.col(lag))
    df = df.withColumn("lag_12_clean", out.otherwise(F.col("lag_12")))
    return df.withColumn("yoy_growth_clean", F.when(good, F.col("yoy_growth")).otherwise(growth(F.col("shipment_count"), F.col("lag_12_clean"))))


def trend_clean_lag(df: DataFrame, keys: Sequence[str] = ("port", "direction"), breaks: Breaks = Breaks(), measure: str = "shipment_count") -> DataFrame:
    """Variant: a lag that falls into a break year becomes the month's mean before the break, grown by the clean median growth.

    lag_12_trend = mean of the calendar month before the shock * (1 + g) ^ years since, g the series' median clean growth within
    +-.15, at least 1; growth_trend = that median (.03 if there is none) where the lag was replaced.
    """
    month, whole = Window.partitionBy(*keys, "month"), Window.partitionBy(*keys)
    before = F.avg(F.when(F.col("year") < breaks.shock, F.col(measure))).over(month)
    clean = ~F.col("year").isin(*breaks.years) & ~(F.col("year") - 1).isin(*breaks.years)
    g = F.coalesce(F.median(F.when(clean, F.col("yoy_growth"))).over(whole), F.lit(0.03))
    df = df.withColumns({"_base": before, "_g": g, "lag_12_in_break": (F.col("year") - 1).isin(*breaks.years).cast("int")})
    grown = F.greatest(F.lit(1.0), F.col("_base") * F.pow(1 + clamp(F.col("_g"), -0.15, 0.15), (F.col("year") - 1 - (breaks.shock - 1)).cast("double")))
    return df.withColumns({
        "lag_12_trend": F.when((F.col("lag_12_in_break") == 1) & F.col("_base").isNotNull(), grown).otherwise(F.col("lag_12").cast("double")),
        "growth_trend": F.when(F.col("lag_12_in_break") == 1, F.col("_g")).otherwise(F.col("yoy_growth")),
    }).drop("_base", "_g")


def congestion_index(features: DataFrame, keys: Sequence[str] = ("port", "direction"), weights: CongestionWeights = CongestionWeights()) -> DataFrame:
    """Norms of counts, value, weight (null is 0) and commodity diversity within each series, and their weighted sum by direction (null counts 0)."""
    df = features.withColumn("_weight", F.coalesce(F.col("total_weight_mt"), F.lit(0.0)))
    df = df.withColumns({out: minmax_norm(c, keys) for out, c in (("sc_norm", "shipment_count"), ("v_norm", "total_value_usd"), ("w_norm", "_weight"), ("cd_norm", "commodity_diversity"))}).drop("_weight")

    def total(parts: dict[str, float]) -> Column:
        return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0))

    return df.withColumn("congestion_index", F.when(F.col("direction") == "import", total(weights.imports)).otherwise(total(weights.exports)))


def latest_per_key(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The value of a column in the last month of each key; equal months give the greatest."""
    return df.groupBy(*keys).agg(F.max(F.struct("year", "month", column))[column].alias(column))


def last_rows(df: DataFrame, n: int, keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("year"), F.desc("month"))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def acf(df: DataFrame, column: str, max_lag: int = 36, keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """keys, lag, acf: autocorrelation of each series at lags 0 to max_lag."""
    w, whole = series_window(keys), Window.partitionBy(*keys)
    rows = df.select(*keys, "year", "month", (F.col(column) - F.avg(column).over(whole)).alias("x")).withColumn("i", F.row_number().over(w))
    rows = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("xs"))
    k = F.explode(F.sequence(F.lit(0), F.least(F.lit(max_lag), F.size("xs") - 1))).alias("lag")
    rows = rows.select(*keys, "xs", k)
    n = F.size("xs") - F.col("lag")
    products = F.zip_with(F.slice("xs", F.lit(1), n), F.slice("xs", F.col("lag") + 1, n), lambda a, b: a * b)
    square = F.aggregate("xs", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select(*keys, "lag", safe_div(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), square).alias("acf"))
