"""Monthly panels, seasonal indices and parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import contains_any_case, safe_div

#: Words that name the four cargo classes; a text may match several.
CARGO = {"cnt_general": "GENERAL", "cnt_bulk": "GRANEL", "cnt_refrigerated": "FRIGORIZAD", "cnt_container": "CONTAINER"}


#: Labels of declarations and their columns in the panel: numbers of different ones and the most frequent ones.
DIVERSITIES = {"hs2": "commodity_diversity", "hs4": "hs4_diversity", "country": "country_diversity", "continent": "continent_diversity"}
MODES = {"dominant_hs2": "hs2", "dominant_cargo_type": "cargo", "dominant_country": "country", "dominant_continent": "continent"}


def _of_month(rows: DataFrame, keys: Sequence[str], years: tuple[int, int] | None = None) -> DataFrame:
    rows = _complete(rows, [*keys, "year", "month"])
    return rows.where(F.col("year").between(*years)) if years else rows


def _sums() -> list:
    """Counts and sums of the measures of a month; the mean value stands last."""
    zero = F.lit(0.0)
    return [
        F.count("*").alias("shipment_count"), F.coalesce(F.sum("value_usd"), zero).alias("total_value_usd"), (F.sum("weight_kg") / 1000).alias("total_weight_mt"),
        F.coalesce(F.sum("quantity"), zero).alias("total_quantity"), F.avg("value_usd").alias("avg_value_per_shipment_usd"),
    ]


def _labels(columns: Sequence[str], modes: Sequence[str]) -> list:
    """Each label's values of a month are collected as a set once, not by expanding the rows."""
    return [*[F.mode(c, True).alias(out) for out, c in MODES.items() if out in modes and c in columns], *[F.size(F.collect_set(c)).cast("long").alias(out) for c, out in DIVERSITIES.items() if c in columns]]


def _cargo(cargo: dict[str, str]) -> list:
    return [F.count_if(contains_any_case(F.col("cargo"), word)).alias(name) for name, word in cargo.items()]


def _panel_columns(keys: Sequence[str], cargo: dict[str, str], modes: Sequence[str]) -> list[str]:
    return [*keys, "year", "month", "shipment_count", "total_value_usd", "total_weight_mt", "total_quantity", *[m for m in MODES if m in modes], *DIVERSITIES.values(), *cargo, "avg_value_per_shipment_usd"]


def monthly_panel(decl: DataFrame, keys: Sequence[str] = ("port", "direction"), cargo: dict[str, str] = CARGO, years: tuple[int, int] | None = None, modes: Sequence[str] = tuple(MODES)) -> DataFrame:
    """One row for each key and month of declarations with year, month, value_usd, weight_kg, quantity, hs2, hs4, country, continent, cargo."""
    sums = _of_month(decl, keys, years).groupBy(*keys, "year", "month").agg(*_sums(), *_labels([*DIVERSITIES, "cargo"], modes), *_cargo(cargo))
    return sums.select(*_panel_columns(keys, cargo, modes))


def _told(rows: DataFrame, month: Sequence[str], labels: Sequence[str], modes: Sequence[str], more: Sequence = ()) -> DataFrame:
    """Of each month of counts n by label: the number of rows (_n), whether all are known (_known), its labels, and `more` over n by label."""
    counts = rows.groupingSets([[*month, c] for c in labels], *month, *labels).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("first"), F.col("n"))).alias("_rows"), F.bool_and("known").alias("_known"), F.grouping(labels[0]).alias("_other"))
    modes = {out: MODES[out] for out in modes if MODES[out] in labels}
    w = Window.partitionBy(*month)
    best = {out: F.when(F.col("n") == F.max(F.when(F.col(c).isNotNull(), F.col("n"))).over(w), F.col(c)).alias(f"_{out}") for out, c in modes.items()}
    return counts.select("*", *best.values()).groupBy(*month).agg(
        F.sum(F.when(F.col("_other") == 0, F.col("_rows"))).alias("_n"), F.bool_and("_known").alias("_known"), *[F.mode(f"_{out}", True).alias(out) for out in modes], *_labels(labels, ()), *more,
    )


def monthly_panel_apart(items: DataFrame, buyers: DataFrame, goods: DataFrame, keys: Sequence[str] = ("port", "direction"), cargo: dict[str, str] = CARGO, modes: Sequence[str] = tuple(MODES)) -> DataFrame:
    """monthly_panel() of declarations that are counted apart, and `whole`: whether each row of the month has one buyer and one kind of goods.

    items holds n, n_values and the sums of the measures, buyers counts n of country with continent and of cargo, goods of hs2 and of
    hs4, the last two with `known` and `first` (of the first of both). Where `whole` is false the month has to be told from the
    joined declarations. Labels are counted before they are collected, as sets and modes of rows need a sort of all of them.
    """
    month, zero = [*keys, "year", "month"], F.lit(0.0)
    of_cargo = [F.coalesce(F.sum(F.when(contains_any_case(F.col("cargo"), word), F.col("n"))), F.lit(0)).alias(name) for name, word in cargo.items()]
    sides = {"buyers": _told(_of_month(buyers, keys), month, ["country", "continent", "cargo"], modes, of_cargo), "goods": _told(_of_month(goods, keys), month, ["hs2", "hs4"], modes)}
    found = _of_month(items, keys).groupBy(*month).agg(
        F.sum("n").alias("shipment_count"), F.coalesce(F.sum("value_usd"), zero).alias("total_value_usd"), (F.sum("weight_kg") / 1000).alias("total_weight_mt"), F.coalesce(F.sum("quantity"), zero).alias("total_quantity"),
        safe_div(F.sum("value_usd"), F.sum("n_values")).alias("avg_value_per_shipment_usd"),
    )
    for name, side in sides.items():
        found = found.join(side.withColumnsRenamed({"_n": f"_n_{name}", "_known": f"_known_{name}"}), month)
    return found.select(*_panel_columns(keys, cargo, modes), F.expr("_n_buyers = shipment_count and _known_buyers and _n_goods = shipment_count and _known_goods").alias("whole"))


def is_whole(items: DataFrame, buyers: DataFrame, goods: DataFrame) -> bool:
    """Whether each row of declarations that are counted apart has one buyer and one kind of goods, those without month or port included."""
    of = lambda rows: rows.agg(F.coalesce(F.sum(F.when(F.col("first"), F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.bool_and("known"), F.lit(True)).alias("known")).first()
    n, sides = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], [of(buyers), of(goods)]
    return all(side["known"] and side["n"] == n for side in sides)


def commodity_panel(decl: DataFrame, keys: Sequence[str] = ("hs2", "port", "direction"), label: str = "hs6") -> DataFrame:
    """The panel of a commodity at a port: counts, sums and the most frequent description."""
    rows = decl.where(F.col("year").isNotNull() & F.col("month").isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    zero = F.lit(0.0)
    return rows.groupBy(*keys, "year", "month").agg(
        F.count("*").alias("shipment_count"), F.coalesce(F.sum("value_usd"), zero).alias("total_value_usd"), F.coalesce(F.sum("weight_kg") / 1000, zero).alias("total_weight_mt"),
        F.coalesce(F.sum("quantity"), zero).alias("total_quantity"), F.mode(label, True).alias("dominant_description"),
    )


def commodity_months(decl: DataFrame, keys: Sequence[str] = ("port", "direction"), by: str = "hs2", cargo: dict[str, str] = CARGO, label: str | None = "hs6") -> DataFrame:
    """Counts and sums of declarations by commodity, keys and month, from which ports_of() and commodities_of() derive both panels.

    Nothing is left out and sums stay null where all is null, so that the panels can decide. label=None saves its count.
    """
    return decl.groupBy(by, *keys, "year", "month").agg(
        F.count("*").alias("shipment_count"), F.count("value_usd").alias("n_values"), *[F.sum(c).alias(c) for c in ("value_usd", "weight_kg", "quantity")],
        *[F.count_if(contains_any_case(F.col("cargo"), word)).alias(name) for name, word in cargo.items()], *([F.mode(label, True).alias("dominant_description")] if label else []),
    )


def _complete(months: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        months = months.where(F.col(c).isNotNull())
    return months


def ports_of(months: DataFrame, cargo: dict[str, str] = CARGO, keys: Sequence[str] = ("port", "direction"), by: str = "hs2") -> DataFrame:
    """The monthly panel of a commodity_months() table, without the columns that it cannot tell: other diversities and modes."""
    zero = F.lit(0.0)
    return _complete(months, [*keys, "year", "month"]).groupBy(*keys, "year", "month").agg(
        F.sum("shipment_count").alias("shipment_count"), F.coalesce(F.sum("value_usd"), zero).alias("total_value_usd"), (F.sum("weight_kg") / 1000).alias("total_weight_mt"), F.coalesce(F.sum("quantity"), zero).alias("total_quantity"),
        F.count(by).alias("commodity_diversity"), *[F.sum(c).alias(c) for c in cargo], safe_div(F.sum("value_usd"), F.sum("n_values")).alias("avg_value_per_shipment_usd"),
    )


def commodities_of(months: DataFrame, keys: Sequence[str] = ("hs2", "port", "direction")) -> DataFrame:
    """commodity_panel() of a commodity_months() table: a projection, no further aggregate. Without descriptions where that has none."""
    zero = F.lit(0.0)
    return _complete(months, [*keys, "year", "month"]).select(
        *keys, "year", "month", "shipment_count", F.coalesce("value_usd", zero).alias("total_value_usd"), F.coalesce(F.col("weight_kg") / 1000, zero).alias("total_weight_mt"), F.coalesce("quantity", zero).alias("total_quantity"),
        *[c for c in ("dominant_description",) if c in months.columns],
    )


def seasonal_index(panel: DataFrame, keys: Sequence[str] = ("port", "direction"), measures: Sequence[str] = ("shipment_count",), year_floor: int | None = None) -> DataFrame:
    """Mean of each calendar month over the mean of the series' months, for each measure: factor_<measure>."""
    rows = panel if year_floor is None else panel.where(F.col("year") >= year_floor)
    means = rows.groupBy(*keys, "month").agg(*[F.avg(m).alias(m) for m in measures])
    w = Window.partitionBy(*keys)
    return means.select(*keys, "month", *[safe_div(F.col(m), F.avg(m).over(w)).alias(f"factor_{m}") for m in measures])


def seasonal_index_two_level(panel: DataFrame, keys: Sequence[str] = ("hs2", "port", "direction"), measure: str = "total_value_usd", least_years: int = 4) -> DataFrame:
    """As seasonal_index over series with at least least_years distinct years."""
    means = panel.groupBy(*keys, "month").agg(F.avg(measure).alias("month_mean"), F.count("*").alias("n"))
    whole = panel.groupBy(*keys).agg(F.count_distinct("year").alias("n_years"), F.avg(measure).alias("series_mean")).where(F.col("n_years") >= least_years)
    return means.join(whole, list(keys)).select(*keys, "month", "n_years", "n", safe_div(F.col("month_mean"), F.col("series_mean")).alias("season_factor"))


def trend_params(features: DataFrame, averages: Sequence[str], modes: Sequence[str] = (), keys: Sequence[str] = ("port", "direction"), year_floor: int | None = None, least: int = 24) -> DataFrame:
    """Last period, means, modes and n of each series with at least `least` months."""
    rows = features if year_floor is None else features.where(F.col("year") >= year_floor)
    return rows.groupBy(*keys).agg(
        F.max(F.struct("year", "month")).alias("_last"), *[F.avg(c).alias(f"avg_{c}") for c in averages], *[F.mode(c, True).alias(c) for c in modes], F.count("*").alias("n_obs"),
    ).where(F.col("n_obs") >= least).select(*keys, F.col("_last.year").alias("last_year"), F.col("_last.month").alias("last_month"), *[f"avg_{c}" for c in averages], *modes, "n_obs")


def mean_positive_growth(features: DataFrame, measures: Sequence[str], keys: Sequence[str] = ("hs2", "port", "direction"), lag: int = 12, least: int = 48) -> DataFrame:
    """For each measure the mean of x / x a year before - 1 over months whose base is positive; series of `least` months or more."""
    w = Window.partitionBy(*keys).orderBy("year", "month")
    rows = features.select(*keys, "year", "month", *measures, *[F.lag(m, lag).over(w).alias(f"_{m}") for m in measures])
    return rows.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(f"_{m}") > 0, F.col(m) / F.col(f"_{m}") - 1)).alias(f"growth_{m}") for m in measures], F.count("*").alias("n_obs"), (F.avg(measures[0]) * F.count("*")).alias("weight"),
    ).where(F.col("n_obs") >= least)


def national_series(panel: DataFrame, measures: Sequence[str] = ("shipment_count",)) -> DataFrame:
    return panel.groupBy("year", "month", "direction").agg(*[F.sum(m).alias(m) for m in measures])


def national_totals(panel: DataFrame, measure: str = "shipment_count") -> DataFrame:
    """Yearly sums by direction and, as direction 'total', over both."""
    rolled = panel.rollup("year", "direction").agg(F.sum(measure).alias(measure), F.grouping_id().alias("_g")).where("_g < 3")
    return rolled.select("year", F.when(F.col("_g") == 1, "total").otherwise(F.col("direction")).alias("direction"), measure)


def eligible_series(panel: DataFrame, keys: Sequence[str] = ("port", "direction"), least: int = 36, measure: str = "shipment_count", largest: int | None = None) -> DataFrame:
    """Series of at least `least` months with their mean volume; only the `largest` of them by volume if that is given."""
    found = panel.groupBy(*keys).agg(F.count("*").alias("n_months"), F.avg(measure).alias("avg_volume")).where(F.col("n_months") >= least)
    return found if largest is None else found.orderBy(F.desc("avg_volume"), *keys).limit(largest)


def densify(panel: DataFrame, keys: Sequence[str] = ("port", "direction")) -> DataFrame:
    """A row for every month between a series' first and last; measures of the added months are null."""
    p = F.col("year") * 12 + F.col("month") - 1
    spine = panel.groupBy(*keys).agg(F.min(p).alias("a"), F.max(p).alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("p"))
    spine = spine.select(*keys, F.floor(F.col("p") / 12).cast("int").alias("year"), (F.col("p") % 12 + 1).cast("int").alias("month"))
    return spine.join(panel, [*keys, "year", "month"], "left")


def single_series(panel: DataFrame, **key) -> DataFrame:
    """The rows of one series, e.g. port=..., direction=..., in order of time; the filter reaches the scan of a saved panel."""
    for name, value in key.items():
        panel = panel.where(F.col(name) == value)
    return panel.orderBy("year", "month")


def series_params(panel: DataFrame, measures: Sequence[str], keys: Sequence[str] = ("hs2", "port", "direction"), label: str | None = "dominant_description", least: int = 48, lag: int = 12) -> DataFrame:
    """Of each series with at least `least` months that have a month a year before: last period of the series, and over these months
    avg_<measure>, growth_<measure> (mean growth over positive bases), n_obs and the most frequent label."""
    w = Window.partitionBy(*keys).orderBy("year", "month")
    rows = panel.select("*", *[F.lag(m, lag).over(w).alias(f"_{m}") for m in measures], F.lag("year", lag).over(w).alias("_there"))
    had = F.col("_there").isNotNull()
    out = rows.groupBy(*keys).agg(
        F.max(F.struct("year", "month")).alias("_last"), F.count_if(had).alias("n_obs"), *([F.mode(F.when(had, F.col(label)), True).alias(label)] if label else []),
        *[F.avg(F.when(had, F.col(m))).alias(f"avg_{m}") for m in measures], *[F.avg(F.when(F.col(f"_{m}") > 0, F.col(m) / F.col(f"_{m}") - 1)).alias(f"growth_{m}") for m in measures],
    ).where(F.col("n_obs") >= least)
    return out.select(*keys, F.col("_last.year").alias("last_year"), F.col("_last.month").alias("last_month"), *[c for c in out.columns if c not in keys and c != "_last"])
