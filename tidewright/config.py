"""Constants of the domain, as parameters with defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Breaks:
    """Years in which series break, and the first year of the data."""

    shock: int = 2020
    rebound: int = 2021
    aftershock: int = 2022
    base_year: int = 2005

    @property
    def years(self) -> tuple[int, ...]:
        return (self.shock, self.rebound, self.aftershock)


#: Walk-forward folds as (last year of training, year of test).
FOLDS: tuple[tuple[int, int], ...] = ((2018, 2019), (2019, 2023), (2023, 2024), (2024, 2025))

#: Weights of training years; other years count 1.
YEAR_WEIGHTS: dict[int, float] = {2020: 0.1, 2021: 0.2, 2022: 0.4}


@dataclass(frozen=True)
class CongestionWeights:
    """Shares of the composite index by direction: counts, value, diversity, weight and one cargo share."""

    imports: dict[str, float] = field(default_factory=lambda: {"sc_norm": 0.40, "v_norm": 0.30, "cd_norm": 0.20, "pct_container": 0.10})
    exports: dict[str, float] = field(default_factory=lambda: {"w_norm": 0.40, "sc_norm": 0.30, "v_norm": 0.20, "pct_refrigerated": 0.10})


#: Cuts and labels.
CONGESTION_CUTS = ((0.25, 0.50, 0.75), ("Low", "Moderate", "High", "Critical"))
MAP_CUTS = ((0.15, 0.25, 0.40), ("Low", "Moderate", "High", "Critical"))
CLOSURE_CUTS = ((1.0, 3.0, 8.0), ("Low", "Moderate", "High", "Critical"))
SEASON_CUTS = ((0.90, 1.30), ("Low Season", "Normal", "High Season"))
#: Cuts of map sizes by index and by percent of hours closed.
MAP_SIZES = {"index": (0.15, 0.3), "closed_pct": (3.0, 8.0)}

#: The features that learners may use at port level; norms over the whole history are left out, they see the future.
PORT_FEATURES = (
    "lag_1", "lag_2", "lag_3", "lag_12_clean", "lag_value_12", "lag_weight_12", "yoy_growth_clean", "yoy_value_growth",
    "month_sin", "month_cos", "quarter", "year_index", "commodity_diversity", "hs4_diversity", "country_diversity", "continent_diversity",
    "pct_general", "pct_bulk", "pct_refrigerated", "pct_container", "avg_value_per_shipment_usd", "weight_per_shipment_mt", "avg_quantity_per_shipment",
    "rolling_3_mean", "rolling_12_mean", "rolling_value_12_mean", "is_shock", "is_rebound", "is_aftershock", "lag_12_is_break",
)
#: The features of learners at commodity level, in the order that decides which of two alike ones stays.
COMMODITY_FEATURES = (
    "lag_1", "lag_2", "lag_3", "lag_12_clean", "lag_value_12", "lag_weight_12", "yoy_growth_clean", "yoy_value_growth", "rolling_3_mean", "rolling_12_mean", "rolling_value_12_mean",
    "month_sin", "month_cos", "quarter", "year_index", "avg_value_per_shipment_usd", "weight_per_shipment_mt", "avg_quantity_per_shipment", "is_shock", "is_rebound", "is_aftershock", "lag_12_is_break",
)

#: Penalties that ridge and lasso choose from, those of the elastic net, and its shares of the absolute penalty.
PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0)
NET_PENALTIES = (0.01, 0.1, 1.0, 10.0)
NET_SHARES = (0.1, 0.5, 0.7, 0.9)

#: Rounds of boosted trees, rounds without a gain that end them, trees of a forest; at port and at commodity level.
BOOSTING_ROUNDS, PATIENCE, FOREST_TREES = {"port": 500, "commodity": 300}, 50, {"port": 400, "commodity": 300}


def clean_years(first: int, last: int, breaks: Breaks = Breaks(), incomplete: tuple[int, ...] = ()) -> list[int]:
    """All years but the breaks and those with months missing."""
    return sorted(set(range(first, last + 1)) - set(breaks.years) - set(incomplete))


#: Fields of a vessel page and the words, any of which in a label names the field; the first field that fits takes the label.
VESSEL_FIELDS: dict[str, tuple[str, ...]] = {
    "destination": ("destination", "dest", "destino"),
    "eta": ("eta", "estimated arrival"),
    "status": ("status", "navigation status", "nav status"),
    "speed": ("speed", "velocity"),
    "course": ("course", "heading", "direction"),
    "position": ("position", "coordinates", "lat/lon"),
    "flag": ("flag", "country"),
    "vessel_type": ("type", "ship type", "vessel type"),
    "mmsi": ("mmsi",),
    "callsign": ("call sign", "callsign"),
    "length": ("length", "loa"),
    "beam": ("beam", "width"),
    "draught": ("draught", "draft"),
    "dwt": ("dwt", "deadweight"),
    "gt": ("gt", "gross tonnage"),
    "built": ("built", "year built", "year"),
}
