"""Descriptive statistics, error metrics, diagnostics. All are single or two-step aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import correlation, safe_div, wavg
from .features import series_window


def describe_by(df: DataFrame, key: str, column: str, points: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    q = F.percentile(column, F.array(*map(F.lit, points)))
    out = df.groupBy(key).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), q.alias("_q"))
    return out.select(key, "n", "mean", "std", "min", *[F.col("_q")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(points)], "max")


def profile(df: DataFrame) -> DataFrame:
    """column, dtype, n_null, pct_null, n_distinct, example (smallest) of every column, from one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.count_if(F.col(c).isNull()).alias("n_null"), safe_div(100.0 * F.count_if(F.col(c).isNull()), F.count("*")).alias("pct_null"), F.count_distinct(c).alias("n_distinct"), F.min(c).cast("string").alias("example")) for c, t in df.dtypes]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def coverage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("n_months"), (F.max("year") - F.min("year") + 1).alias("span_years"))


def volatility(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.count(column).alias("n"), F.max("year").alias("last_year")).withColumn("cv", safe_div(F.col("std"), F.col("mean")))


def break_impact(df: DataFrame, keys: Sequence[str], column: str, pre: tuple[int, int], first: int, second: int) -> DataFrame:
    """Means before a break and in its first two years, change in percent; series without all three are left out."""
    y = F.col("year")
    out = df.groupBy(*keys).agg(F.avg(F.when(y.between(*pre), F.col(column))).alias("pre_mean"), F.avg(F.when(y == first, F.col(column))).alias("y1_mean"), F.avg(F.when(y == second, F.col(column))).alias("y2_mean"), F.count_if(y.isin(first, second)).alias("n_touched"))
    out = out.where("pre_mean is not null and y1_mean is not null and y2_mean is not null")
    return out.withColumns({f"change_{c}_pct": 100 * safe_div(F.col(f"{c}_mean") - F.col("pre_mean"), F.col("pre_mean")) for c in ("y1", "y2")})


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, rho for every pair of columns, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("rho")) for a, b in pairs]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def leak_corr(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Correlation of two columns within each series, summed up: least, greatest, mean, share of series at 1."""
    per = df.groupBy(*keys).agg(correlation(a, b).alias("rho")).where("rho is not null and not isnan(rho)")
    return per.agg(F.count("*").alias("n_series"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"), F.avg("rho").alias("mean_rho"), F.avg((F.abs("rho") > 0.999).cast("int")).alias("share_one"))


def leak_identity(df: DataFrame, target: str, roll: str = "rolling_3_inclusive") -> DataFrame:
    """An inclusive mean of three gives the target away: 3 * mean - lag_1 - lag_2. Greatest and mean residual, and R2."""
    guess = 3 * F.col(roll) - F.col("lag_1") - F.col("lag_2")
    rows = df.select(F.col(target).cast("double").alias("y"), guess.alias("g")).where("y is not null and g is not null")
    return rows.agg(F.count("*").alias("n"), F.max(F.abs(F.col("y") - F.col("g"))).alias("max_residual"), F.avg(F.abs(F.col("y") - F.col("g"))).alias("mean_residual"), (1 - safe_div(F.sum((F.col("y") - F.col("g")) ** 2), F.count("*") * F.var_pop("y"))).alias("r2"))


def score(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "prediction") -> DataFrame:
    """mae, rmse, mape (percent, y > 0 only), r2 (null for one row or equal y) and n."""
    e = F.col(y) - F.col(p)
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.when(F.col(y) > 0, F.abs(e) / F.col(y)))).alias("mape"),
        F.when(F.count("*") > 1, 1 - safe_div(F.sum(e * e), F.regr_sxx(F.col(y), F.col(y)))).alias("r2"), F.count("*").alias("n"),
    )


def summarise(scores: DataFrame, by: Sequence[str] = ("model", "fold_year"), weight: str = "avg_volume", series: Sequence[str] = ("port", "direction")) -> DataFrame:
    """Volume-weighted means of the metrics over series."""
    return scores.groupBy(*by).agg(F.count_distinct(F.struct(*series)).alias("n_series"), *[wavg(F.col(m), F.col(weight)).alias(f"w{m}") for m in ("mae", "rmse", "mape", "r2")])


def pivot_scores(scores: DataFrame, rows: Sequence[str], column: str, values: Sequence, metric: str) -> DataFrame:
    return scores.groupBy(*rows).pivot(column, list(values)).agg(F.avg(metric))


def head_to_head(scores: DataFrame, a: str, b: str, keys: Sequence[str], metric: str = "mape") -> DataFrame:
    """One row: how often model a beats b on the same key, and the gap."""
    x = scores.where(F.col("model") == a).select(*keys, F.col(metric).alias("ma"))
    y = scores.where(F.col("model") == b).select(*keys, F.col(metric).alias("mb"))
    return x.join(y, list(keys)).where("ma is not null and mb is not null").agg(
        F.count("*").alias("n"), F.avg((F.col("ma") < F.col("mb")).cast("int")).alias("win_rate"), F.median(F.col("ma") - F.col("mb")).alias("median_gap"), F.avg(F.col("ma") - F.col("mb")).alias("mean_gap"),
        F.count_if(F.col("ma") < F.col("mb")).alias("wins"), F.count_if(F.col("ma") > F.col("mb")).alias("losses"),
    )


def label_dist(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("pct", 100 * safe_div(F.col("n"), F.lit(df.count())))


def residual_stats(df: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    e = F.col(y) - F.col(p)
    out = df.agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.count(e).alias("n"))
    return out.withColumn("unbiased", F.abs("mean") < 0.1 * F.col("std"))


def repair_rate(df: DataFrame, raw: str = "lag_12", clean: str = "lag_12_clean") -> DataFrame:
    changed = ~F.col(raw).eqNullSafe(F.col(clean))
    return df.agg(F.count_if(changed).alias("n_repaired"), (100 * F.avg(changed.cast("int"))).alias("pct_repaired"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 40) -> DataFrame:
    """column, bin (1..bins) and n: equal widths between least and greatest; the greatest is in the last bin."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*").where("x is not null")
    ends = long.groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1)).otherwise(F.lit(1))
    return long.join(F.broadcast(ends), "column").groupBy("column", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row of ends for each column


def box_summary(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Quartiles and whiskers (the last values within 1.5 times the quartile range)."""
    q = df.groupBy(*by).agg(F.percentile(column, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"), F.count(column).alias("n"))
    q = q.select(*by, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, list(by)).where(F.col(column).between(F.col("q1") - spread, F.col("q3") + spread))
    return inside.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("n", "q1", "median", "q3")], F.min(column).alias("whisker_low"), F.max(column).alias("whisker_high"))


def decompose(df: DataFrame, column: str, keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """Classical decomposition of period 12: centred 2 x 12 mean as trend, month means of the rest as season, remainder."""
    w, whole = series_window(keys), Window.partitionBy(*keys)
    near, wide = w.rowsBetween(-5, 5), w.rowsBetween(-6, 6)
    trend = F.when(F.count(column).over(wide) == 13, (F.sum(column).over(near) + (F.lag(column, 6).over(w) + F.lead(column, 6).over(w)) / 2) / 12)
    rows = df.select(*keys, "year", "month", F.col(column).cast("double").alias("value"), trend.alias("trend"))
    rows = rows.withColumn("_rest", F.col("value") - F.col("trend")).withColumn("_season", F.avg("_rest").over(Window.partitionBy(*keys, "month")))
    rows = rows.withColumn("season", F.col("_season") - F.avg("_season").over(whole))
    return rows.select(*keys, "year", "month", "value", "trend", "season", (F.col("value") - F.col("trend") - F.col("season")).alias("remainder"))


def df_test(df: DataFrame, column: str, keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """Dickey-Fuller t statistic (constant, no further lags) of each series; stationary at 5 % if it is below -2.86."""
    w = series_window(keys)
    rows = df.select(*keys, F.lag(F.col(column).cast("double")).over(w).alias("x"), F.col(column).cast("double").alias("now")).where("x is not null")
    rows = rows.withColumn("dy", F.col("now") - F.col("x"))
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("dy", "x").alias("slope"), F.regr_sxx("dy", "x").alias("sxx"), F.regr_syy("dy", "x").alias("syy"), F.regr_sxy("dy", "x").alias("sxy"))
    rss = F.col("syy") - F.col("slope") * F.col("sxy")
    t = safe_div(F.col("slope"), F.sqrt(safe_div(safe_div(rss, (F.col("n") - 2)), F.col("sxx"))))
    return s.where("n > 3").select(*keys, "n", t.alias("t_stat")).withColumn("stationary", F.col("t_stat") < -2.86)


def select_features(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> list[str]:
    """Columns in order, without those that correlate with an earlier kept or dropped one beyond the limit; nulls count as 0.

    One pass over the rows makes the k x k correlations; a column that does not vary correlates with none.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    rows = VectorAssembler(inputCols=list(columns), outputCol="x").transform(filled).select("x")
    if len(rows.head(2)) < 2:
        return list(columns)
    rho = Correlation.corr(rows, "x").first()[0].toArray()
    return [b for j, b in enumerate(columns) if not any(rho[i, j] == rho[i, j] and abs(rho[i, j]) > limit for i in range(j))]


def leaderboard(scores: DataFrame, fold: int | None = None, weight: str = "avg_volume", series: Sequence[str] = ("port", "direction")) -> DataFrame:
    """Models from the least volume-weighted error up, over all folds or one: rounded wmape (2), wmae (0) and wr2 (3), and series."""
    rows = scores if fold is None else scores.where(F.col("fold_year") == fold)
    out = rows.groupBy("model").agg(
        *[F.round(wavg(F.col(m), F.col(weight)), d).alias(f"w{m}") for m, d in (("mape", 2), ("mae", 0), ("r2", 3))], F.count_distinct(F.struct(*series)).alias("n_series"),
    )
    return out.orderBy(F.col("wmape").asc_nulls_last(), "model")


def leak_report(features: DataFrame, scores: DataFrame, suspects: Sequence[str], simple: Sequence[str], tuned: Sequence[str], target: str = "shipment_count", roll: str | None = None, margin: float = 2.0, keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """check, value, alarm: one row for each guardrail against features that give the target away.

    share_one_<feature>: share of series in which a suspect feature is the target on another scale (alarm above 0).
    identity_<roll>: greatest residual of the target rebuilt from an inclusive mean of three and two lags (alarm if there is none).
    simple_beats_tuned: by how many points of volume-weighted error the best simple model beats the best tuned one (alarm beyond
    the margin; such a margin on noisy data is seldom earned). scores holds avg_volume.
    """
    parts = [leak_corr(features, keys, target, c).select(F.lit(f"share_one_{c}").alias("check"), F.col("share_one").alias("value"), (F.coalesce("share_one", F.lit(0.0)) > 0).alias("alarm")) for c in suspects]
    if roll:
        parts.append(leak_identity(features, target, roll).select(F.lit(f"identity_{roll}").alias("check"), F.col("max_residual").alias("value"), F.coalesce(F.col("max_residual") < 1e-6, F.lit(False)).alias("alarm")))
    errors = summarise(scores, ("model",), series=keys)
    best = lambda names: F.min(F.when(F.col("model").isin(*names), F.col("wmape")))
    gap = errors.agg((best(tuned) - best(simple)).alias("value"))
    parts.append(gap.select(F.lit("simple_beats_tuned").alias("check"), "value", F.coalesce(F.col("value") > margin, F.lit(False)).alias("alarm")))
    return reduce(DataFrame.unionByName, parts)
