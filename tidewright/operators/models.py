"""Learners behind one protocol: fit(train) -> fitted, fitted.transform(rows) adds `prediction`.

Learners of MLlib are fitted once over all series of a fold instead of one model for each series. Their targets are divided by
the training mean of their series, so that large and small series weigh alike; predictions are scaled back and never below 1.
SeriesRidge fits each series by itself from sums that Spark makes, SeriesRidgePath from the rows of a series, which are months.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BOOSTING_ROUNDS, COMMODITY_FEATURES, FOREST_TREES, NET_PENALTIES, NET_SHARES, PATIENCE, PENALTIES
from ..sources.tables import stored, stored_path

SCALED = ("lag_1", "lag_2", "lag_3", "lag_12", "lag_12_clean", "rolling_3_mean", "rolling_12_mean")


class Fitted(Protocol):
    """What fit() gives: transform(df) adds `prediction` (at least 1) to rows that hold the features."""

    features: Sequence[str]

    def transform(self, df: DataFrame) -> DataFrame: ...


class Model(Protocol):
    """A learner over all series at once: fit(train) takes training rows with keys, year, month, target and features."""

    def fit(self, train: DataFrame) -> Fitted: ...


def _vectors(df: DataFrame, scales: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """df with scale (the training mean of its series, 1 if unknown), the vector x and, where df has the target, label. Nulls are 0."""
    df = df.join(scales, list(keys), "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    df = df.withColumns({f"_x_{c}": F.coalesce((F.col(c) / F.col("scale") if c in SCALED else F.col(c)).cast("double"), F.lit(0.0)) for c in features})
    if target in df.columns:
        df = df.withColumn("label", F.col(target) / F.col("scale"))
    return VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="x").transform(df).drop(*[f"_x_{c}" for c in features])


@dataclass(frozen=True)
class Pooled:
    """One learner of MLlib for all series: ridge, lasso, elastic_net, random_forest, gbt, gbt_sampled or gbt_absolute.

    Features that correlate beyond `limit` with an earlier one in the training rows are left out. Linear learners choose their
    penalty by the error on the inner validation rows (`default_penalty` if there are none) and are fitted again on all rows;
    penalties are those of the usual forms of the losses, see _linear(). Boosted trees are grown on the inner training rows and cut
    at the round that `patience` further rounds do not better on the validation rows. Training rows lie in one partition for each
    rows_per_task of them.
    """

    kind: str
    features: Sequence[str]
    drop_years: Sequence[int] = ()
    weights: dict[int, float] = field(default_factory=dict)
    break_years: Sequence[int] = ()
    keys: Sequence[str] = ("port", "direction")
    target: str = "shipment_count"
    rounds: int = BOOSTING_ROUNDS["port"]
    trees: int = FOREST_TREES["port"]
    depth: int = 5
    limit: float = 0.95
    seed: int = 42
    patience: int = PATIENCE
    default_penalty: float = 1.0
    short: tuple[int, int, int] | None = None
    rows_per_task: int = 50_000

    @classmethod
    def of_commodities(cls, kind: str, **how) -> Pooled:
        """The form for series of a commodity at a port: its features, fewer rounds and trees, short series validate on six rows."""
        return cls(kind, **{"features": COMMODITY_FEATURES, "keys": ("hs2", "port", "direction"), "rounds": BOOSTING_ROUNDS["commodity"], "trees": FOREST_TREES["commodity"], "short": (12, 3, 6), **how})

    def _linear(self, share: float, penalty: float, n: float, spread: float) -> LinearRegression:
        """The learner of MLlib whose minimum is that of the usual loss over n rows with labels of the given standard deviation.

        MLlib minimises squares / (2 n) + penalty * (share * |w| + (1 - share) * w^2 / (2 spread)) on standardised features. The
        usual ridge has squares + a * w^2, the usual lasso and elastic net squares / (2 n) + a * (r * |w| + (1 - r) * w^2 / 2).
        """
        if share == 0:
            reg, r = penalty * spread / n, 0.0
        else:
            reg = penalty * share + spread * penalty * (1 - share)
            r = penalty * share / reg
        return LinearRegression(regParam=reg, elasticNetParam=r, featuresCol="x", labelCol="label", weightCol="weight", standardization=True, maxIter=100)

    def _fit_linear(self, rows: DataFrame):
        grid = {"ridge": [(0.0, a) for a in PENALTIES], "lasso": [(1.0, a) for a in PENALTIES], "elastic_net": [(r, a) for r in NET_SHARES for a in NET_PENALTIES]}[self.kind]
        size = lambda df: tuple(df.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.stddev_samp("label"), F.lit(0.0))).first())
        inner, valid = rows.where("is_train"), rows.where("is_valid")
        (n, spread), best = size(inner), next(i for i, (_, a) in enumerate(grid) if a == self.default_penalty)
        if n > 1 and not valid.isEmpty():
            error = lambda m: m.transform(valid).agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0]
            best = min(range(len(grid)), key=lambda i: (error(self._linear(*grid[i], n, max(spread, 1e-9)).fit(inner)), i))
        n, spread = size(rows)
        return self._linear(*grid[best], max(n, 1.0), max(spread, 1e-9)).fit(rows), {"share": grid[best][0], "penalty": grid[best][1]}

    def _fit_boosted(self, rows: DataFrame):
        loss = "absolute" if self.kind == "gbt_absolute" else "squared"
        sampled = {} if self.kind == "gbt" else {"subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
        inner, valid = rows.where("is_train"), rows.where("is_valid")
        grow = lambda n: GBTRegressor(featuresCol="x", labelCol="label", weightCol="weight", seed=self.seed, maxDepth=self.depth, stepSize=0.05, lossType=loss, maxIter=n, **sampled).fit(inner)
        if valid.isEmpty() or inner.isEmpty():
            inner = rows
            return grow(self.rounds), {"rounds": self.rounds}
        # the first rounds of a longer run are those of a shorter one, so runs are doubled until the best round is behind
        n = min(self.rounds, 3 * self.patience)
        while True:
            model = grow(n)
            best, over = best_round(model.evaluateEachIteration(valid, loss), self.patience)
            if over or n == self.rounds:
                break
            n = min(2 * n, self.rounds)
        return _first_rounds(model, best), {"rounds": best}

    def fit(self, train: DataFrame) -> FittedPooled:
        from .evaluate import inner_validation, sample_weight
        from .stats import select_features

        train = train.where(F.col(self.target).isNotNull() & ~F.col("year").isin(*self.drop_years)) if self.drop_years else train.where(F.col(self.target).isNotNull())
        used = select_features(train, self.features, self.limit)
        scales = stored(train.groupBy(*self.keys).agg(F.greatest(F.lit(1e-9), F.avg(F.col(self.target).cast("double"))).alias("scale")), "scales")
        rows = _vectors(train, scales, used, self.target, self.keys).withColumn("weight", sample_weight(self.weights)).withColumn("is_test", F.lit(False))
        rows = inner_validation(rows, self.break_years, self.keys, short=self.short)
        # each tree is several short jobs over these rows: a task for each shuffle partition, or a plan that is sent along with every task, would cost more than their work
        # samples are drawn by the place of a row, so rows lie in order
        rows = rows.coalesce(max(1, -(-train.count() // self.rows_per_task))).sortWithinPartitions(*self.keys, "year", "month")
        rows = stored(rows.select("x", "label", "weight", "is_train", "is_valid"), "training").cache()
        try:
            if self.kind in ("ridge", "lasso", "elastic_net"):
                fitted, chosen = self._fit_linear(rows)
            elif self.kind == "random_forest":
                fitted, chosen = RandomForestRegressor(featuresCol="x", labelCol="label", seed=self.seed, maxDepth=self.depth, numTrees=self.trees, minInstancesPerNode=2, featureSubsetStrategy="sqrt").fit(rows), {"trees": self.trees}
            elif self.kind in ("gbt", "gbt_sampled", "gbt_absolute"):
                fitted, chosen = self._fit_boosted(rows)
            else:
                raise ValueError(f"no learner is called {self.kind}")
            return FittedPooled(fitted, scales, used, self, chosen)
        finally:
            rows.unpersist()


def _first_rounds(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The ensemble of the first n trees, by the public constructor of the JVM's class."""
    if n == model.getNumTrees:
        return model
    java = model._java_obj
    gateway = SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i, (tree, weight) in enumerate(zip(java.trees()[:n], java.treeWeights()[:n])):
        trees[i], weights[i] = tree, weight
    cut = GBTRegressionModel(gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights))
    cut._java_obj.setFeaturesCol(java.getFeaturesCol())
    return cut


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """Number of rounds (from 1) that early stopping keeps, and whether it would have stopped: the best round, once `patience` rounds have not bettered it."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


@dataclass(frozen=True)
class FittedPooled:
    fitted: object
    scales: DataFrame
    features: Sequence[str]
    model: Pooled
    #: What fitting chose: share and penalty, or the rounds that were kept.
    chosen: dict = field(default_factory=dict)

    def settled(self) -> FittedPooled:
        """The same: its table of scales is written by fit()."""
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = _vectors(df, self.scales, self.features, self.model.target, self.model.keys)
        out = self.fitted.transform(rows.drop("prediction"))
        return out.withColumn("prediction", F.greatest(F.lit(1.0), F.col("prediction") * F.col("scale"))).drop("x", "scale", "label")


@dataclass(frozen=True)
class SeriesRidge:
    """Ridge regression of each series by itself on standardised features, from sums of squares and products.

    The sums are one Spark aggregate over all series; only the solution of a k x k system for each series runs in Python. Null
    features count as 0; features that do not vary in a series have no weight there; penalty 0 is least squares.
    """

    features: Sequence[str]
    penalty: float = 1.0
    keys: Sequence[str] = ("port", "direction")
    target: str = "shipment_count"

    def fit(self, train: DataFrame) -> FittedSeries:
        k = len(self.features)
        names = [f"_x{i}" for i in range(k)]
        rows = train.select(*self.keys, F.col(self.target).cast("double").alias("_y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, self.features)]).where("_y is not null")
        every = ["_y", *names]
        # centred at the series' mean before anything is squared, so that large levels cost no digits
        w = Window.partitionBy(*self.keys)
        centred = rows.select(*self.keys, *every, *[(F.col(c) - F.avg(c).over(w)).alias(f"_c{i}") for i, c in enumerate(every)])
        sums = centred.groupBy(*self.keys).agg(
            F.count("*").alias("_n"), F.array(*[F.avg(c) for c in every]).alias("_m"), F.array(*[F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")) for i in range(k + 1) for j in range(k + 1)]).alias("_s"),
        )
        schema = T.StructType([*sums.select(*self.keys).schema.fields, T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("sigma", T.DoubleType())])
        keys, penalty = list(self.keys), self.penalty

        def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                found = []
                for n, means, s in zip(part["_n"], part["_m"], part["_s"]):
                    s, means = np.array(list(s), float).reshape(k + 1, k + 1), np.array(list(means), float)
                    sd = np.sqrt(np.maximum(np.diag(s)[1:], 0) / n)
                    used = np.flatnonzero(sd > 1e-9 * np.maximum(1, np.abs(means[1:])))
                    slope = np.zeros(k)
                    if len(used):
                        z = s[1:, 1:][np.ix_(used, used)] / np.outer(sd[used], sd[used]) + penalty * np.eye(len(used))
                        slope[used] = np.linalg.lstsq(z, s[1:, 0][used] / sd[used], rcond=1e-12)[0] / sd[used]
                    left = s[0, 0] - 2 * slope @ s[1:, 0] + slope @ s[1:, 1:] @ slope
                    found.append((float(means[0] - slope @ means[1:]), slope.tolist(), float(np.sqrt(max(left, 0) / n))))
                out = part[keys].copy()
                out["intercept"], out["coefficients"], out["sigma"] = [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]
                yield out

        return FittedSeries(self, sums.mapInPandas(solve, schema))


@dataclass(frozen=True)
class FittedSeries:
    model: SeriesRidge | SeriesRidgePath
    coefficients: DataFrame

    @property
    def features(self) -> Sequence[str]:
        return self.model.features

    def settled(self) -> FittedSeries:
        """The same with its table of coefficients written, for use in many plans."""
        return replace(self, coefficients=stored(self.coefficients, "coefficients"))

    def transform(self, df: DataFrame) -> DataFrame:
        """df of series that were fitted, with prediction (at least 1) and sigma, the residuals' standard deviation."""
        dot = F.aggregate(F.zip_with("coefficients", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.model.features]), lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)
        return df.join(self.coefficients, list(self.model.keys)).withColumn("prediction", F.greatest(F.lit(1.0), F.col("intercept") + dot)).drop("intercept", "coefficients", "penalty")


def ridge_path(x: np.ndarray, y: np.ndarray, train: np.ndarray, valid: np.ndarray, penalties: Sequence[float], limit: float = 0.95, default: float = 1.0) -> tuple[float, np.ndarray, float, float]:
    """intercept, slopes, standard deviation of the residuals and penalty of a ridge regression of one series.

    Columns that correlate beyond the limit with an earlier one, or do not vary, have no slope. The penalty is the one with the
    least squared error on the rows `valid` after fitting on the rows `train`: one eigendecomposition gives the fits of all. It is
    `default` where there are less than two training rows or none to validate on. The result is fitted on all rows.
    """
    k = x.shape[1]

    def varying(z: np.ndarray) -> np.ndarray:
        return z.std(axis=0) > 1e-9 * np.maximum(1, np.abs(z.mean(axis=0))) if len(z) else np.zeros(k, bool)

    varies = varying(x)
    keep = np.ones(k, bool)
    if len(x) > 1:
        rho = np.zeros((k, k))
        at = np.flatnonzero(varies)
        if len(at):
            rho[np.ix_(at, at)] = np.corrcoef(x[:, at], rowvar=False).reshape(len(at), len(at))
        keep = ~(np.triu(np.abs(rho), 1) > limit).any(axis=0)

    def fits(z: np.ndarray, t: np.ndarray, wanted: Sequence[float]) -> list[tuple[float, np.ndarray]]:
        used = np.flatnonzero(keep & varying(z))
        mean, sd = z.mean(axis=0), z[:, used].std(axis=0)
        s = (z[:, used] - mean[used]) / sd
        values, vectors = np.linalg.eigh(s.T @ s)
        turned = vectors.T @ (s.T @ (t - t.mean()))
        out = []
        for a in wanted:
            slope = np.zeros(k)
            slope[used] = vectors @ (turned / (np.maximum(values, 0) + a)) / sd
            out.append((float(t.mean() - slope @ mean), slope))
        return out

    best = default
    if train.sum() >= 2 and valid.any():
        errors = [float(np.mean((y[valid] - b - x[valid] @ w) ** 2)) for b, w in fits(x[train], y[train], penalties)]
        best = penalties[int(np.argmin(errors))]
    intercept, slopes = fits(x, y, [best])[0]
    return intercept, slopes, float((y - intercept - x @ slopes).std()), float(best)


@dataclass(frozen=True)
class SeriesRidgePath:
    """Ridge regression of each series by itself, with a penalty and a choice of features of its own; see ridge_path().

    Years in drop_years are left out of fitting; the inner validation is that of inner_validation(). The rows of a series are its
    months, so a group is bounded by the length of the history; they are shuffled once, by the keys. Null features count as 0.
    """

    features: Sequence[str]
    penalties: Sequence[float] = PENALTIES
    drop_years: Sequence[int] = ()
    break_years: Sequence[int] = ()
    keys: Sequence[str] = ("port", "direction")
    target: str = "shipment_count"
    limit: float = 0.95
    default_penalty: float = 1.0
    short: tuple[int, int, int] | None = None

    def fit(self, train: DataFrame) -> FittedSeries:
        from .evaluate import inner_validation

        rows = train.where(F.col(self.target).isNotNull()).withColumn("is_test", F.lit(False))
        rows = rows.where(~F.col("year").isin(*self.drop_years)) if self.drop_years else rows
        rows = inner_validation(rows, self.break_years, self.keys, short=self.short)
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features])
        rows = rows.select(*self.keys, F.col(self.target).cast("double").alias("_y"), x.alias("_x"), "is_train", "is_valid")
        schema = T.StructType([*rows.select(*self.keys).schema.fields, T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("sigma", T.DoubleType()), T.StructField("penalty", T.DoubleType())])
        keys, penalties, limit, default = list(self.keys), tuple(self.penalties), self.limit, self.default_penalty

        def solve(part: pd.DataFrame) -> pd.DataFrame:
            intercept, slopes, sigma, penalty = ridge_path(np.stack(part["_x"].to_list()).astype(float), part["_y"].to_numpy(float), part["is_train"].to_numpy(bool), part["is_valid"].to_numpy(bool), penalties, limit, default)
            out = part[keys].head(1).copy()
            out["intercept"], out["coefficients"], out["sigma"], out["penalty"] = intercept, [slopes.tolist()], sigma, penalty
            return out

        return FittedSeries(self, rows.groupBy(*keys).applyInPandas(solve, schema))


def trend_seasonal(history: DataFrame, future: DataFrame, changepoints: Sequence[int] = (2008, 2010, 2020, 2022), series: int = 12, target: str = "shipment_count", keys: Sequence[str] = ("port", "direction"), z: float = 1.2815515655446004) -> DataFrame:
    """Trend with hinges and yearly seasonality of the `series` largest series, multiplicative: fitted to log(1 + target).

    Returns keys, year, month of future with prediction and the bounds of an 80 % interval from the spread of the residuals.
    """
    largest = history.groupBy(*keys).agg(F.avg(target).alias("_v")).orderBy(F.desc("_v"), *keys).limit(series).select(*keys)
    rows, columns = trend_features(history.join(largest, list(keys), "left_semi").withColumn("_log", F.log1p(F.col(target).cast("double"))), changepoints)
    ahead, _ = trend_features(future.join(largest, list(keys), "left_semi"), changepoints)
    fitted = SeriesRidge(tuple(columns), 0.01, tuple(keys), "_log").fit(rows)
    # the floor of transform() is that of counts; here the prediction is a logarithm, so the sum is made anew
    dot = F.aggregate(F.zip_with("coefficients", F.array(*[F.col(c).cast("double") for c in columns]), lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)
    found = ahead.join(fitted.coefficients, list(keys)).withColumn("_l", F.col("intercept") + dot)
    value = lambda e: F.greatest(F.lit(1.0), F.expm1(e))
    return found.select(*keys, "year", "month", value(F.col("_l")).alias("prediction"), value(F.col("_l") - z * F.col("sigma")).alias("lower"), value(F.col("_l") + z * F.col("sigma")).alias("upper"))


def importance(fitted: FittedPooled) -> DataFrame:
    """One row for each feature of a fitted learner of MLlib, from the most important one down.

    Linear learners: coefficient (of the standardised feature's unit, as MLlib gives it) and whether it is not zero. Trees: gain, the
    share of the reduction of error by all splits of a feature weighted by the rows that they see, and split_count over all trees.
    """
    spark, names, model = fitted.scales.sparkSession, list(fitted.features), fitted.fitted
    if not hasattr(model, "featureImportances"):
        rows = [(n, float(c), bool(c != 0)) for n, c in zip(names, model.coefficients.toArray())]
        return spark.createDataFrame(rows, "feature string, coefficient double, selected boolean").orderBy(F.desc(F.abs("coefficient")), "feature")
    splits = _tree_nodes(spark, model).where("split >= 0").groupBy(F.col("split").alias("i")).agg(F.count("*").alias("split_count"))
    gains = dict(enumerate(model.featureImportances.toArray()))  # a cut ensemble knows its features up to the last one that it splits
    rows = spark.createDataFrame([(i, n, float(gains.get(i, 0.0))) for i, n in enumerate(names)], "i int, feature string, gain double")
    return rows.join(splits, "i", "left").select("feature", "gain", F.coalesce("split_count", F.lit(0)).alias("split_count")).orderBy(F.desc("gain"), "feature")


def _tree_nodes(spark: SparkSession, model) -> DataFrame:
    """tree and split (number of the feature, -1 for a leaf) of every node of an ensemble, read from its stored form."""
    path = stored_path(spark, "ensemble")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    return nodes.select(F.col("treeID").alias("tree"), F.col("nodeData.split.featureIndex").alias("split"))


def linear_attribution(fitted: FittedSeries, rows: DataFrame) -> DataFrame:
    """keys, year, month, feature, contribution: what each feature adds to a linear prediction, exactly: slope * (value - mean of the series).

    The means are those of the given rows; contributions of a row add up to its prediction (before the floor) less the series' mean one.
    """
    model = fitted.model
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    means = rows.groupBy(*model.keys).agg(F.array(*[F.avg(value(c)) for c in model.features]).alias("_means"))
    df = rows.join(fitted.coefficients, list(model.keys)).join(means, list(model.keys))
    parts = [F.struct(F.lit(c).alias("feature"), (F.col("coefficients")[i] * (value(c) - F.col("_means")[i])).alias("contribution")) for i, c in enumerate(model.features)]
    return df.select(*model.keys, "year", "month", F.explode(F.array(*parts)).alias("_p")).select(*model.keys, "year", "month", "_p.feature", "_p.contribution")


def mean_attribution(attribution: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """feature (within `by`) and the mean absolute contribution."""
    return attribution.groupBy(*by, "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def permutation_importance(fitted: Fitted, rows: DataFrame, target: str = "shipment_count", features: Sequence[str] | None = None, seed: int = 7) -> DataFrame:
    """feature and rise: how much the mean absolute error grows when the feature's values are dealt anew among the rows.

    All features are dealt in one pass: rows take the values of the row that follows theirs in a random order of their bucket,
    each feature in an order of its own, and are scored once, a copy of a row for each feature. Buckets are random and of bounded size
    (about `rows / 1000` of them), so there is no sort of all rows.
    """
    features = list(fitted.features if features is None else features)
    rows = rows.where(F.col(target).isNotNull())
    buckets = max(1, rows.count() // 1000)
    marked = rows.withColumns({"_row": F.xxhash64(*[c for c in rows.columns], F.lit(seed))}).withColumn("_bucket", F.pmod("_row", F.lit(buckets)))
    whole = Window.partitionBy("_bucket")
    dealt = {}
    for i, c in enumerate(features):
        w = whole.orderBy(F.xxhash64("_row", F.lit(i)))
        dealt[f"_new_{i}"] = F.coalesce(F.lead(F.col(c).cast("double")).over(w), F.first(F.col(c).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    marked = marked.withColumns(dealt)
    copies = marked.withColumn("_which", F.explode(F.array(F.lit(-1), *[F.lit(i) for i in range(len(features))])))
    copies = copies.withColumns({c: F.when(F.col("_which") == i, F.col(f"_new_{i}")).otherwise(F.col(c)) for i, c in enumerate(features)})
    errors = fitted.transform(copies).groupBy("_which").agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("_error"))
    base = errors.where("_which = -1").select(F.col("_error").alias("_base"))
    name = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("_which") + 1)
    # one row beside one for each feature
    return errors.where("_which >= 0").join(F.broadcast(base)).select(name.alias("feature"), (F.col("_error") - F.col("_base")).alias("rise"))


def trend_features(df: DataFrame, changepoints: Sequence[int] = (2008, 2010, 2020, 2022), terms: int = 2) -> tuple[DataFrame, list[str]]:
    """Trend with hinges at the years of change, and Fourier terms of the month: the design of the trend and seasonality model."""
    t = F.col("year") + (F.col("month") - 1) / 12.0
    columns = {"t": t - 2000, **{f"hinge_{c}": F.greatest(F.lit(0.0), t - c) for c in changepoints}}
    for k in range(1, terms + 1):
        columns |= {f"sin_{k}": F.sin(F.col("month") * (6.283185307179586 * k / 12)), f"cos_{k}": F.cos(F.col("month") * (6.283185307179586 * k / 12))}
    return df.withColumns(columns), list(columns)
