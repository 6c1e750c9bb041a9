"""Rows and labelled fields of HTML pages by regular expressions, inside Spark."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """'12,345' as long; '-' and what is no number are null."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("bigint")


def extract_rows(pages: DataFrame, row: str, fields: dict[str, str], html: str = "html") -> DataFrame:
    """page_id, pos (from 1) and the fields of every match of `row`; fields: name -> pattern with one group."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(row), 0)).alias("_i", "_row"))
    return rows.select("page_id", (F.col("_i") + 1).alias("pos"), *[F.regexp_extract("_row", p, 1).alias(n) for n, p in fields.items()])


def first_fields(pages: DataFrame, fields: dict[str, str], html: str = "html") -> DataFrame:
    """page_id and the first match of each pattern, null if there is none."""
    return pages.select("page_id", *[F.nullif(F.regexp_extract(html, p, 1), F.lit("")).alias(n) for n, p in fields.items()])


def extract_fields(pages: DataFrame, pair: str, keywords: dict[str, Sequence[str]], html: str = "html") -> DataFrame:
    """One row for each page with a column for each field.

    pair: pattern with two groups, label and value. A pair belongs to the first field of which any keyword lies in its label
    (any case); empty values and '-' do not count; of several pairs of a field the last is kept.
    """
    found = pages.select("page_id", F.posexplode_outer(F.regexp_extract_all(F.col(html), F.lit(pair), 0)).alias("pos", "_p"))
    label, value = F.lower(F.trim(F.regexp_extract("_p", pair, 1))), F.trim(F.regexp_extract("_p", pair, 2))
    found = found.select("page_id", "pos", label.alias("label"), F.when(~value.isin("", "-"), value).alias("value"))
    hits = {name: reduce(lambda a, b: a | b, [F.col("label").contains(w.lower()) for w in words]) for name, words in ((n, (w,) if isinstance(w, str) else w) for n, w in keywords.items())}
    field = F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in hits.items()])
    found = found.withColumn("field", F.when(F.col("value").isNotNull(), field))
    return found.groupBy("page_id").agg(*[F.max_by("value", F.when(F.col("field") == n, F.col("pos"))).alias(n) for n in keywords])


def port_counters(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, expected_ships and ships_in_port as the page's summary states them, null where it does not."""
    return pages.select("page_id", *[number(F.regexp_extract(html, rf"{label}:\s*(?:<[^>]*>\s*)*(\d+)", 1)).cast("int").alias(n) for n, label in (("expected_ships", "Expected ships"), ("ships_in_port", "Ships in port"))])


#: Lists of a port page by the id of their section.
PORT_LISTS = ("expected", "arrivals", "departures", "in-port")


def vessel_rows(pages: DataFrame, lists: Sequence[str] = PORT_LISTS, html: str = "html") -> DataFrame:
    """page_id, list, pos and the fields of every vessel row of a port page: time, name, type, imo, flag, built, gt, dwt, size.

    '-' and what is no number are null, thousands commas go; rows without a vessel name are left out.
    """
    sections = pages.select("page_id", F.explode(F.array(*[F.struct(F.lit(n).alias("list"), F.regexp_extract(html, rf'(?s)<section[^>]*\bid="{n}"[^>]*>(.*?)</section>', 1).alias("body")) for n in lists])).alias("s"))
    rows = sections.select("page_id", "s.list", F.posexplode(F.regexp_extract_all("s.body", F.lit(r"(?s)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("pos", "row"))

    def text(c: Column) -> Column:
        return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " ")), F.lit(""))

    def inside(kind: str, name: str) -> Column:
        return text(F.regexp_extract("row", rf'(?s)<{kind}[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</{kind}>', 1))

    size = F.nullif(inside("td", "col-sizes"), F.lit("-"))
    out = rows.select(
        "page_id", "list", (F.col("pos") + 1).alias("pos"), text(F.regexp_extract("row", r"(?s)<td\b[^>]*>(.*?)</td>", 1)).alias("time"), inside("div", "named-title").alias("vessel_name"), inside("div", "named-subtitle").alias("vessel_type"),
        F.nullif(F.regexp_extract("row", r'href="[^"]*/details/(\d+)', 1), F.lit("")).alias("imo"), F.nullif(F.regexp_extract("row", r'(?s)<div[^>]*class="[^"]*\bm-flag-small\b[^"]*"[^>]*title="([^"]*)"', 1), F.lit("")).alias("flag"),
        *[number(inside("td", f"col-{c}")).cast("int").alias(n) for c, n in (("y", "built"), ("gt", "gt"), ("dwt", "dwt"))], size.alias("size"),
    )
    return out.where("vessel_name is not null")
