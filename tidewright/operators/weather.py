"""Hourly weather against the limits of each port, and its daily, monthly and climatological rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bin_label, clamp, safe_div
from .decode import is_small

LEVELS = ((0.25, 0.5, 1.0), ("Open", "Watch", "Warning", "Closed"))
DRIVERS = ("wave", "wind", "gusts")


def _risk(x: Column, threshold: Column, closure: Column) -> Column:
    """0 at the threshold, 1 at the closure level; null measures carry no risk."""
    return F.coalesce(clamp(safe_div(x - threshold, closure - threshold), 0.0, 1.0), F.lit(0.0))


def score_operability(hourly: DataFrame, config: DataFrame) -> DataFrame:
    """hourly(port_code, ts, wave, swell, wind, gusts) with config(port_code, hs_threshold, hs_closure, wind_threshold, wind_closure,
    gusts_threshold, gusts_closure, exposure, swell_sensitivity): risks, operability 0 to 100, label, closure driver, swell_dominant.

    Ports without a row of config have no risk. The formula is this library's own: risk = clamp((x - threshold) / (closure -
    threshold)), waves are weighted by exposure and swell by sensitivity, operability is 100 * (1 - greatest risk).
    config holds a row for each port; it is broadcast if is_small() says so.
    """
    df = hourly.join(F.broadcast(config) if is_small(config, 100_000) else config, "port_code", "left")
    sea = F.greatest(F.col("wave") * F.coalesce("exposure", F.lit(1.0)), F.col("swell") * F.coalesce("swell_sensitivity", F.lit(1.0)))
    df = df.withColumns({
        "wave_risk": _risk(sea, F.col("hs_threshold"), F.col("hs_closure")), "wind_risk": _risk(F.col("wind"), F.col("wind_threshold"), F.col("wind_closure")),
        "gusts_risk": _risk(F.col("gusts"), F.col("gusts_threshold"), F.col("gusts_closure")), "swell_dominant": F.coalesce(F.col("swell") > F.col("wave"), F.lit(False)),
    })
    df = df.withColumn("combined_risk", F.greatest(*[f"{d}_risk" for d in DRIVERS]))
    driver = F.lit(None).cast("string")
    for d in reversed(DRIVERS):
        driver = F.when((F.col(f"{d}_risk") == F.col("combined_risk")) & (F.col("combined_risk") >= 1.0), F.lit(d)).otherwise(driver)
    keep = [*hourly.columns, *[f"{d}_risk" for d in DRIVERS], "combined_risk", "swell_dominant"]
    return df.select(*keep, (100 * (1 - F.col("combined_risk"))).alias("operability"), bin_label(F.col("combined_risk"), *LEVELS).alias("risk_label"), driver.alias("closure_driver"))


def weather_daily(scored: DataFrame) -> DataFrame:
    label, n = F.col("risk_label"), F.count("*")
    return scored.groupBy("port_code", F.to_date("ts").alias("day")).agg(
        n.alias("n_hours"), F.count_if(label == "Closed").alias("hours_closed"), F.count_if(label == "Warning").alias("hours_warning"),
        *[F.count_if(F.col("closure_driver") == d).alias(f"closed_by_{d}") for d in DRIVERS],
        safe_div(F.count_if(label == "Closed"), n).alias("pct_closed"), safe_div(F.count_if(label == "Warning"), n).alias("pct_warning"),
        F.avg("operability").alias("avg_operability"), F.min("operability").alias("min_operability"), F.max("wave").alias("max_wave"), F.max("wind").alias("max_wind"),
    ).withColumn("closure_day", F.col("hours_closed") >= 6)


def weather_monthly(daily: DataFrame) -> DataFrame:
    hours = F.sum("n_hours")
    return daily.groupBy("port_code", F.year("day").alias("year"), F.month("day").alias("month")).agg(
        hours.alias("n_hours"), F.sum("hours_closed").alias("hours_closed"), F.sum("hours_warning").alias("hours_warning"), *[F.sum(f"closed_by_{d}").alias(f"closed_by_{d}") for d in DRIVERS],
        safe_div(F.sum("hours_closed"), hours).alias("pct_closed"), safe_div(F.sum("hours_warning"), hours).alias("pct_warning"),
        safe_div(F.sum(F.col("avg_operability") * F.col("n_hours")), hours).alias("avg_operability"), F.min("min_operability").alias("min_operability"),
        F.max("max_wave").alias("max_wave"), F.max("max_wind").alias("max_wind"), F.count_if("closure_day").alias("closure_days"),
    )


def weather_climatology(monthly: DataFrame) -> DataFrame:
    """Over the years: mean, least and greatest share of closed hours of a port's calendar month, and who closed it."""
    closed = F.sum("hours_closed")
    return monthly.groupBy("port_code", "month").agg(
        F.avg("pct_closed").alias("closed"), F.avg("pct_warning").alias("warn"), F.avg("avg_operability").alias("operability"), F.avg("closure_days").alias("closure_days"),
        *[safe_div(F.sum(f"closed_by_{d}"), closed).alias(f"share_{d}") for d in DRIVERS], F.min("pct_closed").alias("closed_min"), F.max("pct_closed").alias("closed_max"),
    )


def driver_split(climatology: DataFrame) -> DataFrame:
    """Annual mean closure of a port and the share of each driver over the months that have closures."""
    return climatology.groupBy("port_code").agg(F.avg("closed").alias("annual_closed"), *[F.avg(f"share_{d}").alias(f"share_{d}") for d in DRIVERS])


def weather_adjust(congestion: DataFrame, monthly: DataFrame, bridge: DataFrame, minor: float = 1.01, moderate: float = 1.03, severe: float = 1.08, on: Sequence[str] = ("year", "month")) -> DataFrame:
    """congestion(port, year, month, congestion_index) by the weather of the port's code: multiplier 1 + closed + warning / 2, index at most 1.

    on: the columns of time that both share; ("month",) takes the weather of a calendar month for all years.
    """
    w = monthly.select("port_code", *on, "pct_closed", "pct_warning")
    df = congestion.join(bridge.select("port", "port_code"), "port", "left").join(w, ["port_code", *on], "left")
    times = 1 + F.coalesce("pct_closed", F.lit(0.0)) + 0.5 * F.coalesce("pct_warning", F.lit(0.0))
    return df.withColumns({"weather_multiplier": times, "ci_adjusted": F.least(F.lit(1.0), F.col("congestion_index") * times), "adjustment_type": bin_label(times, (minor, moderate, severe), ("none", "minor", "moderate", "severe"))})
