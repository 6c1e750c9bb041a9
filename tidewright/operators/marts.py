"""Published tables: rankings, profiles, shares, strips of months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLOSURE_CUTS, MAP_CUTS
from ..functions.exprs import bin_label, delay_label, normal_code, safe_div


def port_overview(months: DataFrame) -> DataFrame:
    """months(port, ci_raw, ci_adjusted, pct_closed as fraction): annual means of each port."""
    return months.groupBy("port").agg(F.avg("ci_raw").alias("ci_raw"), F.avg("ci_adjusted").alias("ci_adjusted"), (100 * F.avg("pct_closed")).alias("closed_pct"))


def mart_port_overview(months: DataFrame, bridge: DataFrame, junk: Sequence[str] = ()) -> DataFrame:
    """The overview with codes and labels, without junk ports."""
    df = port_overview(months.where(~F.col("port").isin(*junk)) if junk else months).join(bridge, "port", "left")
    return df.withColumns({"congestion_label": bin_label(F.col("ci_adjusted"), *MAP_CUTS), "closure_label": bin_label(F.col("closed_pct"), *CLOSURE_CUTS), "delay_label": delay_label(F.col("ci_adjusted"), F.col("closed_pct")), "exposed": F.coalesce(F.col("closed_pct") >= 1, F.lit(False))})


def map_ports(months: DataFrame, bridge: DataFrame, coordinates: DataFrame, junk: Sequence[str] = (), keys: Sequence[str] = ("direction", "port")) -> DataFrame:
    """The marks of the map: annual means and labels of each direction's ports that have coordinates, from the most congested down.

    bridge(port, port_code): codes with or without the number of a terminal; coordinates(port, lat, lng). Both have a row for
    each port at most, so no row is doubled. Ports without a code keep a null code.
    """
    rows = months.where(~F.col("port").isin(*junk)) if junk else months
    df = rows.groupBy(*keys).agg(F.avg("ci_raw").alias("ci_raw"), F.avg("ci_adjusted").alias("ci_adjusted"), (100 * F.avg("pct_closed")).alias("closed_pct"))
    codes = bridge.select("port", normal_code(F.col("port_code")).alias("port_code"))
    df = df.join(coordinates.select("port", "lat", "lng"), "port").join(codes, "port", "left")
    out = df.withColumns({"congestion_label": bin_label(F.col("ci_adjusted"), *MAP_CUTS), "delay_label": delay_label(F.col("ci_adjusted"), F.col("closed_pct"))})
    return out.orderBy(F.desc("ci_adjusted"), *keys)


def peak_month(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Months of the greatest and the least value; of equal values the earliest month."""
    hi = F.max_by("month", F.struct(F.col(value), -F.col("month")))
    lo = F.min_by("month", F.struct(F.col(value), F.col("month")))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(hi.alias("peak_month"), lo.alias("low_month"))


def year_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "year").agg(
        F.count("*").alias("n_months"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max_by("month", F.struct(F.col(value), -F.col("month"))).alias("peak"), F.min_by("month", F.struct(F.col(value), F.col("month"))).alias("low"),
    )


def yoy_pivot(df: DataFrame, value: str, years: Sequence[int]) -> DataFrame:
    out = df.groupBy("month").pivot("year", list(years)).agg(F.sum(value))
    return out.withColumnsRenamed({str(y): f"y{y}" for y in years})


def month_deviation(df: DataFrame, value: str, keys: Sequence[str], cut: float = 10.0) -> DataFrame:
    """Percent by which a month is off its year's mean, and a flag beyond the cut."""
    mean = F.avg(value).over(Window.partitionBy(*keys, "year"))
    return df.select(*keys, "year", "month", value, (100 * safe_div(F.col(value) - mean, mean)).alias("deviation_pct")).withColumn("flag", F.when(F.col("deviation_pct") > cut, "high").when(F.col("deviation_pct") < -cut, "low").otherwise("usual"))


def top_n_share(df: DataFrame, name: str, value: str, n: int = 5, keys: Sequence[str] = (), rest: str = "Others") -> DataFrame:
    """Shares of the n largest names of each key, the others in one row. Sums are made before anything is ranked."""
    sums = df.groupBy(*keys, name).agg(F.sum(value).alias("v"))
    if not keys:  # a distributed top n; nothing is sorted in one task
        top = sums.orderBy(F.desc("v"), name).limit(n)
        others = sums.join(top, name, "left_anti").agg(F.sum("v").alias("v")).where("v is not null").select(F.lit(rest).alias(name), "v")
        total = sums.agg(F.sum("v")).first()[0]
        return top.unionByName(others).withColumn("share_pct", 100 * safe_div(F.col("v"), F.lit(total)))
    part = Window.partitionBy(*keys)
    ranked = sums.withColumn("_r", F.row_number().over(part.orderBy(F.desc("v"), name)))
    few = ranked.groupBy(*keys, F.when(F.col("_r") <= n, F.col(name)).otherwise(F.lit(rest)).alias(name)).agg(F.sum("v").alias("v"))
    return few.withColumn("share_pct", 100 * safe_div(F.col("v"), F.sum("v").over(part)))


def category_mix(df: DataFrame, key: str, category: str, values: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Percent of rows of each category, and of the target categories together."""
    n = F.count("*")
    return df.groupBy(key).agg(n.alias("n"), *[(100 * safe_div(F.count_if(F.col(category) == v), n)).alias(f"pct_{v.lower()}") for v in values], (100 * safe_div(F.count_if(F.col(category).isin(*target)), n)).alias("pct_target"))


def port_scorecard(decl: DataFrame) -> DataFrame:
    months = decl.groupBy("port", "month").agg(F.count("*").alias("n"))
    whole = decl.groupBy("port").agg(F.count("*").alias("shipments"), F.sum("value_usd").alias("value_usd"), F.count_distinct("country").alias("n_countries"), F.count_distinct("hs4").alias("n_products"))
    return whole.join(peak_month(months, ["port"], "n"), "port", "left")


def month_array(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """months: twelve values, 0 where a month is absent."""
    maps = df.groupBy(*keys, "month").agg(F.sum(value).alias("v")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("month", "v"))).alias("m"))
    return maps.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.coalesce(F.element_at("m", i).cast("double"), F.lit(0.0))).alias("months"))


def product_profile(df: DataFrame, key: str, category: str, value: str) -> DataFrame:
    w = Window.partitionBy(key)
    sums = df.groupBy(key, category).agg(F.count("*").alias("n"), F.sum(value).alias("v"))
    return sums.select(key, category, "n", "v", (100 * safe_div(F.col("n"), F.sum("n").over(w))).alias("share_pct"), F.rank().over(w.orderBy(F.desc("v"))).alias("rank"), safe_div(F.col("v"), F.max("v").over(w)).alias("of_largest"))


def rank_ports(df: DataFrame, keys: Sequence[str] = ("hs2", "direction"), volume: str = "volume", index: str = "ci_adjusted") -> DataFrame:
    """Rank within a commodity by volume * (1 - index)."""
    return df.withColumn("rank_in_commodity", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(F.col(volume) * (1 - F.coalesce(index, F.lit(0.0)))))))


def mart_port_compare(commodity: DataFrame, congestion: DataFrame) -> DataFrame:
    """commodity(hs2, direction, port, shipments) with congestion(port, ci_adjusted, closed_pct): sums, means and the rank of each port."""
    sums = commodity.groupBy("hs2", "direction", "port").agg(F.sum("shipments").alias("volume"))
    return rank_ports(sums.join(congestion.select("port", "ci_adjusted", "closed_pct"), "port", "left"))


def recommend_port(compared: DataFrame) -> DataFrame:
    """For each commodity and port the best port, and whether it is another one."""
    best = compared.where("rank_in_commodity = 1").groupBy("hs2", "direction").agg(F.min("port").alias("best_port"))
    return compared.join(best, ["hs2", "direction"], "left").select("hs2", "direction", "port", "rank_in_commodity", "best_port", (F.col("best_port") != F.col("port")).alias("better_option"))


def top_rows(df: DataFrame, value: Column | str, n: int, *ties: str, ascending: bool = False) -> DataFrame:
    c = F.col(value) if isinstance(value, str) else value
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *ties).limit(n)


def both_ends(df: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The n rows of the greatest and the n of the least values, with `side`; nulls are in neither."""
    rows = df.where(F.col(value).isNotNull())
    return top_rows(rows, value, n, *ties).withColumn("side", F.lit("largest")).unionByName(top_rows(rows, value, n, *ties, ascending=True).withColumn("side", F.lit("smallest")))


def first_in_rank(df: DataFrame, keys: Sequence[str], value: Column | str, k: int, *ties: str) -> DataFrame:
    """Of each key the rows of the k greatest values, with their rank; equal values go by the ties."""
    c = F.col(value) if isinstance(value, str) else value
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(c.desc_nulls_last(), *ties))).where(F.col("rank") <= k)


def top_commodities(forecast: DataFrame, k: int = 8, keys: Sequence[str] = ("port",), commodity: str = "hs2", value: str = "pred_shipment_count") -> DataFrame:
    """The k commodities of a port with the greatest sum of forecasts."""
    sums = forecast.groupBy(*keys, commodity).agg(F.sum(value).alias("total"))
    return first_in_rank(sums, keys, "total", k, commodity)


def mart_commodity_month(forecast: DataFrame, index: DataFrame, keys: Sequence[str] = ("hs2", "port", "direction"), value: str = "pred_shipment_count") -> DataFrame:
    """Twelve rows for each commodity at a port: the month's forecast (0 if absent) beside index(port, month, ci_raw, ci_adjusted)."""
    months = forecast.select(*keys).distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    sums = forecast.groupBy(*keys, "month").agg(F.sum(value).alias("forecast"))
    return months.join(sums, [*keys, "month"], "left").withColumn("forecast", F.coalesce("forecast", F.lit(0))).join(index.select("port", "month", "ci_raw", "ci_adjusted"), ["port", "month"], "left")


def mode_ranking(df: DataFrame, value: str, cuts: tuple, *ties: str, missing: str = "No data") -> DataFrame:
    """Ports (a row for each) from the greatest value down, those without one last, with rank and label; the rank of a missing value is shared."""
    c = F.coalesce(F.col(value), F.lit(-1.0))
    sorted_values = df.agg(F.sort_array(F.collect_list(c), asc=False).alias("_all"))  # one number for each port
    rank = F.array_position("_all", c)
    out = df.join(F.broadcast(sorted_values)).withColumns({"rank": rank.cast("int"), "label": F.coalesce(bin_label(F.col(value), *cuts), F.lit(missing))}).drop("_all")
    return out.orderBy(c.desc(), *ties)
