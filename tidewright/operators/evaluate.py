"""Walk-forward validation and model selection over all series at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import YEAR_WEIGHTS
from ..functions.exprs import clamp, wavg
from . import stats
from .features import latest_per_key
from .models import Fitted, Model


def seasonal_naive(limit: float = 0.2) -> Column:
    """The break-aware value of a year ago, grown by the growth within +-limit; at least 1."""
    g = F.coalesce(clamp(F.col("yoy_growth_clean"), -limit, limit), F.lit(0.0))
    return F.greatest(F.lit(1.0), F.coalesce(F.col("lag_12_clean"), F.lit(1)) * (1 + g))


def naive_with_fallback(limit: float = 0.2) -> Column:
    """As seasonal_naive, but an absent or zero lag becomes the mean of twelve months, then 1."""
    zero = F.lit(0.0)
    base = F.coalesce(F.nullif(F.col("lag_12_clean").cast("double"), zero), F.nullif(F.col("rolling_12_mean"), zero), F.lit(1.0))
    g = F.coalesce(clamp(F.col("yoy_growth_clean"), -limit, limit), zero)
    return F.greatest(F.lit(1.0), base * (1 + g))


def rolling_mean() -> Column:
    return F.greatest(F.lit(1.0), F.coalesce(F.col("rolling_12_mean"), F.lit(1.0)))


def walk_forward(features: DataFrame, folds: Sequence[tuple[int, int]], keys: Sequence[str] = ("port", "direction"), least_train: int = 24) -> DataFrame:
    """Rows of each fold with fold_year and is_test; series with fewer than least_train training rows or no test row are left out of the fold."""
    table = F.explode(F.array(*[F.struct(F.lit(a).alias("train_end"), F.lit(b).alias("fold_year")) for a, b in folds]))
    rows = features.withColumn("_f", table).where((F.col("year") <= F.col("_f.train_end")) | (F.col("year") == F.col("_f.fold_year")))
    rows = rows.withColumn("fold_year", F.col("_f.fold_year")).withColumn("is_test", F.col("year") == F.col("fold_year")).drop("_f")
    w = Window.partitionBy(*keys, "fold_year")
    rows = rows.withColumns({"_train": F.sum((~F.col("is_test")).cast("int")).over(w), "_test": F.sum(F.col("is_test").cast("int")).over(w)})
    return rows.where((F.col("_train") >= least_train) & (F.col("_test") > 0)).drop("_train", "_test")


def inner_validation(rows: DataFrame, break_years: Sequence[int], keys: Sequence[str] = ("port", "direction", "fold_year"), last: int = 12, short: tuple[int, int, int] | None = None) -> DataFrame:
    """is_train and is_valid among training rows (neither for test rows).

    A series with two or more years that are no break years validates on the last of them and trains on the rows before it; what
    comes after it is left out. Other series validate on their last rows. short = (train, valid, n): a series that is left with
    fewer training or validation rows validates on its last n rows.
    """
    w = Window.partitionBy(*keys)
    train = ~F.col("is_test")
    clean = F.when(train & ~F.col("year").isin(*break_years), F.col("year"))
    back = F.row_number().over(w.orderBy(F.col("is_test"), F.desc("year"), F.desc("month")))
    df = rows.withColumns({"_y": F.when(F.min(clean).over(w) < F.max(clean).over(w), F.max(clean).over(w)), "_b": back})
    df = df.withColumns({"is_train": train & F.coalesce(F.col("year") < F.col("_y"), F.col("_b") > last), "is_valid": train & F.coalesce(F.col("year") == F.col("_y"), F.col("_b") <= last)})
    if short is not None:
        enough = (F.count_if("is_train").over(w) >= short[0]) & (F.count_if("is_valid").over(w) >= short[1])
        df = df.withColumn("_enough", enough)
        df = df.withColumns({"is_train": F.when(F.col("_enough"), F.col("is_train")).otherwise(train & (F.col("_b") > short[2])), "is_valid": F.when(F.col("_enough"), F.col("is_valid")).otherwise(train & (F.col("_b") <= short[2]))}).drop("_enough")
    return df.drop("_y", "_b")


def sample_weight(weights: dict[int, float] = YEAR_WEIGHTS) -> Column:
    """The weight of a row's year in training; years that are not listed, and null, count 1."""
    out = F.lit(1.0)
    for year, value in weights.items():
        out = F.when(F.col("year") == year, F.lit(value)).otherwise(out)
    return out


def evaluate(folds: DataFrame, models: dict[str, Column | Callable[[DataFrame], DataFrame]], target: str = "shipment_count", keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """Scores of each series, model and fold. A model is an expression over the test rows, or a function of the folds that adds `prediction`."""
    plain = [F.struct(F.lit(name).alias("model"), model.cast("double").alias("prediction")) for name, model in models.items() if isinstance(model, Column)]
    parts = []
    if plain:  # all expressions in one pass over the test rows
        rows = folds.where("is_test").select(*keys, "fold_year", F.col(target).cast("double").alias("y"), F.explode(F.array(*plain)).alias("_m"))
        parts.append(rows.select(*keys, "fold_year", "y", "_m.model", "_m.prediction"))
    for name, model in models.items():
        if not isinstance(model, Column):
            parts.append(model(folds).where("is_test").select(*keys, "fold_year", F.col(target).cast("double").alias("y"), F.lit(name).alias("model"), "prediction"))
    return stats.score(reduce(DataFrame.unionByName, parts), [*keys, "fold_year", "model"])


#: What a learner raises that cannot handle its data; failures of the cluster are no result and go on.
LEARNER_ERRORS = (ValueError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException)


def at_once(spark: SparkSession, jobs: Sequence[Callable], most: int) -> list:
    """Results of independent jobs in their order; up to `most` run as concurrent Spark jobs."""
    if most <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(min(most, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def evaluate_models(folds: DataFrame, models: dict[str, Model], fold_years: Sequence[int], target: str = "shipment_count", keys: Sequence[str] = ("port", "direction"), most_at_once: int = 4) -> DataFrame:
    """As evaluate() for learners: each is fitted on the training rows of each fold. With features_used and error.

    Fits are independent, so up to most_at_once of them run at the same time. A model that cannot fit a fold leaves one row
    without a series and scores, with the first 120 characters of what went wrong.
    """
    spark = folds.sparkSession

    def fit(name: str, year: int) -> tuple[DataFrame | None, tuple | None]:
        part = folds.where(F.col("fold_year") == year)
        try:
            if part.where("not is_test").isEmpty():
                return None, None
            fitted = models[name].fit(part.where("not is_test"))
            rows = fitted.transform(part.where("is_test")).select(*keys, "fold_year", F.col(target).cast("double").alias("y"), F.lit(name).alias("model"), "prediction")
            return rows.withColumn("features_used", F.array(*[F.lit(c) for c in fitted.features])), None
        except LEARNER_ERRORS as e:
            return None, (year, name, str(e)[:120])

    found = at_once(spark, [partial(fit, name, year) for name in models for year in fold_years], most_at_once)
    parts, failed = [rows for rows, _ in found if rows is not None], [error for _, error in found if error is not None]
    errors = spark.createDataFrame(failed, "fold_year int, model string, error string")
    if not parts:
        return errors
    scores = stats.score(reduce(DataFrame.unionByName, parts), [*keys, "fold_year", "model", "features_used"])
    return scores.unionByName(errors, allowMissingColumns=True)


def fit_models(train: DataFrame, models: dict[str, Model | Column], most_at_once: int = 4) -> dict[str, Fitted | Column]:
    """Every learner fitted on all of train, several at the same time, and its tables written; expressions stay as they are."""

    def fit(name: str) -> Fitted:
        fitted = models[name].fit(train)
        return fitted.settled() if hasattr(fitted, "settled") else fitted

    names = [n for n, m in models.items() if not isinstance(m, Column)]
    fitted = at_once(train.sparkSession, [partial(fit, n) for n in names], most_at_once)
    return {n: m for n, m in models.items() if isinstance(m, Column)} | dict(zip(names, fitted))


def cross_validate(folds: DataFrame, models: dict[str, Model | Column], fold_years: Sequence[int], target: str = "shipment_count", keys: Sequence[str] = ("port", "direction"), most_at_once: int = 4) -> DataFrame:
    """Scores of expressions and learners in one table, as selection takes them; folds that a learner failed on have no row."""
    plain = {n: m for n, m in models.items() if isinstance(m, Column)}
    learners = {n: m for n, m in models.items() if not isinstance(m, Column)}
    parts = [evaluate(folds, plain, target, keys)] if plain else []
    if learners:
        found = evaluate_models(folds, learners, fold_years, target, keys, most_at_once)
        parts += [found.where("error is null").drop("error", "features_used")] if "mape" in found.columns else []
    return reduce(DataFrame.unionByName, parts)


def mean_scores(scores: DataFrame, keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """Mean error over folds, to nine decimals: models that differ only by the order of additions are equal."""
    return scores.groupBy(*keys, "model").agg(F.round(F.avg("mape"), 9).alias("cv_mape"))


def best_model(scores: DataFrame, keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """The model of the least mean error of each series; equal errors give the first name."""
    best = mean_scores(scores, keys).where("cv_mape is not null").groupBy(*keys).agg(F.min(F.struct("cv_mape", "model")).alias("_b"))
    return best.select(*keys, F.col("_b.model").alias("best_model"), F.col("_b.cv_mape").alias("best_cv_mape"))


def select_hybrid(scores: DataFrame, volumes: DataFrame, threshold: float = 500, baseline: str = "naive", keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """Series of at least the threshold's volume take the baseline, the others their best model; with the score of what was taken."""
    best = F.min(F.when(F.col("cv_mape").isNotNull(), F.struct("cv_mape", "model")))
    df = mean_scores(scores, keys).groupBy(*keys).agg(best.alias("_b"), F.max(F.when(F.col("model") == baseline, F.col("cv_mape"))).alias("baseline_cv_mape")).where("_b is not null")
    df = df.select(*keys, F.col("_b.model").alias("best_model"), F.col("_b.cv_mape").alias("best_cv_mape"), "baseline_cv_mape").join(volumes, list(keys), "left")
    large = F.col("avg_volume") >= threshold
    return df.select(
        *keys, "avg_volume", F.when(large, F.lit(baseline)).otherwise(F.col("best_model")).alias("selected_model"), "best_model", "best_cv_mape", "baseline_cv_mape",
        F.when(large, F.col("baseline_cv_mape")).otherwise(F.col("best_cv_mape")).alias("final_cv_mape"),
    )


def compare_strategies(scores: DataFrame, selection: DataFrame, fold: int, keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """strategy, n_series, wmape on one fold: the hybrid beside each pure model."""
    rows = scores.where(F.col("fold_year") == fold).join(selection.select(*keys, "avg_volume", "selected_model"), list(keys))
    hybrid = rows.where(F.col("model") == F.col("selected_model")).withColumn("strategy", F.lit("hybrid"))
    every = rows.withColumn("strategy", F.col("model")).unionByName(hybrid)
    return every.groupBy("strategy").agg(F.count("*").alias("n_series"), wavg(F.col("mape"), F.col("avg_volume")).alias("wmape"))


def improvement(scores: DataFrame, selection: DataFrame, fold: int, baseline: str = "naive", keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """Per series: error of the baseline less that of the selected model."""
    rows = scores.where(F.col("fold_year") == fold)
    a = rows.join(selection.select(*keys, "selected_model"), list(keys)).where(F.col("model") == F.col("selected_model")).select(*keys, F.col("mape").alias("selected_mape"))
    b = rows.where(F.col("model") == baseline).select(*keys, F.col("mape").alias("baseline_mape"))
    return a.join(b, list(keys)).withColumn("gain", F.col("baseline_mape") - F.col("selected_mape"))


def compare_metrics(a: DataFrame, b: DataFrame, keys: Sequence[str], metric: str = "mape") -> DataFrame:
    """Full outer join of two metric tables with the difference."""
    x, y = a.select(*keys, F.col(metric).alias("left_value")), b.select(*keys, F.col(metric).alias("right_value"))
    return x.join(y, list(keys), "outer").withColumn("delta", F.col("right_value") - F.col("left_value"))


def winner(scores: DataFrame, fold: int, weight: str = "avg_volume") -> DataFrame:
    sums = scores.where(F.col("fold_year") == fold).groupBy("model").agg(wavg(F.col("mape"), F.col(weight)).alias("wmape"))
    return sums.where("wmape is not null").agg(F.min(F.struct("wmape", "model")).alias("w")).select(F.col("w.model").alias("winner"), F.col("w.wmape").alias("wmape"))


def with_descriptions(df: DataFrame, panel: DataFrame, keys: Sequence[str] = ("hs2", "port", "direction"), label: str = "dominant_description") -> DataFrame:
    """df with the latest label of each series."""
    return df.join(latest_per_key(panel, list(keys), label), list(keys), "left")


def with_default(df: DataFrame, lookup: DataFrame, keys: Sequence[str], column: str, default: str) -> DataFrame:
    """df with a column of the lookup, and the default where its key is missing there."""
    found = lookup.groupBy(*keys).agg(F.min(column).alias("_v"))
    return df.join(found, list(keys), "left").withColumn(column, F.coalesce("_v", F.lit(default))).drop("_v")


def strategy_gain(scores: DataFrame, selection: DataFrame, fold: int, baseline: str = "naive", keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """One row for one fold: volume-weighted error of baseline and hybrid, the gain in points, how many series improved and the median gain."""
    rows = improvement(scores, selection, fold, baseline, keys).join(selection.select(*keys, "avg_volume"), list(keys))
    w = F.col("avg_volume")
    sums = rows.agg(
        wavg(F.col("baseline_mape"), w).alias("baseline_wmape"), wavg(F.col("selected_mape"), w).alias("hybrid_wmape"), F.count_if(F.col("gain") > 0).alias("n_improved"), F.count("*").alias("n_series"), F.median("gain").alias("median_gain"),
    )
    return sums.withColumn("gain_pp", F.col("baseline_wmape") - F.col("hybrid_wmape"))
