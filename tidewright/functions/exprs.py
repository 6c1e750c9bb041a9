"""Column expressions: parsing of dirty text, calendar, ratios, labels. Nothing here needs a UDF."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_to_double(c: Column) -> Column:
    """Text with a decimal comma as double; '' and 'NaN' and anything else that is no number are null."""
    c = F.nullif(F.nullif(F.replace(c, F.lit(","), F.lit(".")), F.lit("")), F.lit("NaN"))
    return c.try_cast("double")


def code_to_int(c: Column, strict: bool = False) -> Column:
    """A code as integer: the part before the first comma (strict), or everything before the first other character than a digit."""
    c = F.trim(c)
    c = F.split_part(c, F.lit(","), F.lit(1)) if strict else F.regexp_replace(c, r"[^0-9].*$", "")
    return F.nullif(F.trim(c), F.lit("")).try_cast("int")


def hs_levels(code: Column, pad: int | None = None) -> dict[str, Column]:
    """The 6, 4 and 2 digit prefixes of a commodity code, after filling it up with zeros on the left if pad is given."""
    if pad:
        code = F.lpad(code, pad, "0")
    return {f"hs{n}": F.substring(code, 1, n) for n in (6, 4, 2)}


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def growth(now: Column, before: Column) -> Column:
    return safe_div(now - before, before)


def clamp(c: Column, low: float, high: float, default: float | None = None) -> Column:
    """c within bounds; with a default, null and 0 become it first."""
    if default is not None:
        c = F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(default))
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def compound(base: Column, rate: Column, months: Column) -> Column:
    """base grown at a yearly rate for so many months."""
    return base * F.pow(1 + rate, months / F.lit(12.0))


def season(month: Column, names: Sequence[str] = ("Summer", "Autumn", "Winter", "Spring")) -> Column:
    """Season of the southern hemisphere: December to February is the first name, then three months each."""
    return F.when(month.isNotNull(), F.element_at(F.array(*map(F.lit, names)), (F.floor((month % 12) / 3) + 1).cast("int")))


def quarter(month: Column) -> Column:
    return (F.floor((month - 1) / 3) + 1).cast("double")


def cyclic(c: Column, period: int = 12) -> tuple[Column, Column]:
    angle = c * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def break_flag(year: Column, value: int) -> Column:
    return F.coalesce((year == value).cast("int"), F.lit(0))


def bin_label(c: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the highest cut that c reaches; null stays null."""
    out = F.when(c < cuts[0], F.lit(labels[0]))
    for cut, label in zip(cuts[1:], labels[1:]):
        out = out.when(c < cut, F.lit(label))
    return out.when(c.isNotNull(), F.lit(labels[-1]))


def delay_label(congestion: Column, closed_pct: Column) -> Column:
    """The worse of two labels: congestion at .15/.25/.40 or hours closed at 1/3/8 percent."""
    c, p = F.coalesce(congestion, F.lit(0.0)), F.coalesce(closed_pct, F.lit(0.0))
    return F.when((c >= 0.40) | (p >= 8), "Critical").when((c >= 0.25) | (p >= 3), "High").when((c >= 0.15) | (p >= 1), "Moderate").otherwise("Low")


def period(year: Column, month: Column) -> Column:
    return year * 100 + month


def of_period(p: Column) -> tuple[Column, Column]:
    return F.floor(p / 100).cast("int"), (p % 100).cast("int")


def add_months(year: Column, month: Column, step: Column) -> tuple[Column, Column]:
    """Year and month `step` months later."""
    n = year * 12 + month - 1 + step
    return F.floor(n / 12).cast("int"), (n % 12 + 1).cast("int")


def month_label(year: Column, month: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def contains_any_case(c: Column, part: str) -> Column:
    return c.ilike(f"%{part}%")


def not_airport(*tests: tuple[Column, str, str]) -> Column:
    """True unless a column equals a value ('=') or starts with a text in any case ('^'); nulls pass."""
    out = F.lit(True)
    for c, how, value in tests:
        hit = (c == value) if how == "=" else c.ilike(f"{value}%")
        out = out & (c.isNull() | ~hit)
    return out


def wavg(x: Column, w: Column) -> Column:
    """Average weighted by w; rows with a null or a weight of 0 or less do not count."""
    ok = x.isNotNull() & w.isNotNull() & (w > 0)
    return safe_div(F.sum(F.when(ok, x * w)), F.sum(F.when(ok, w)))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def half_even(c: Column) -> Column:
    return F.rint(c)


def is_transport_mode(c: Column, code: str = "1") -> Column:
    """Whether the part of a dirty code text before its comma is the code of a mode of transport ('1': by sea)."""
    return F.split_part(F.trim(c), F.lit(","), F.lit(1)) == code


def activity_index(factor: Column) -> Column:
    """Place of a seasonal factor between 0.1 and 3, from 0 to 1."""
    return clamp((factor - 0.1) / 2.9, 0.0, 1.0)


def size_class(value: Column, cuts: tuple[float, float], inclusive: bool = False) -> Column:
    """Size of a port's mark on the map: 10 above the higher cut, 7 above the lower, else 5; null is small."""
    low, high = cuts
    above = (lambda cut: value >= cut) if inclusive else (lambda cut: value > cut)
    return F.when(above(high), 10).when(above(low), 7).otherwise(5)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Correlation of two columns, null where one of them does not vary."""
    return safe_div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def normal_code(c: Column, ending: str = "001") -> Column:
    """The code of a port without the number of its terminal: CLSAI001 is CLSAI."""
    return F.replace(c, F.lit(ending), F.lit(""))
