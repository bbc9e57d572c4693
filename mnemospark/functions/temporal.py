"""Dates named in texts, resolved against a reference date; plain expressions of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()
SHORT_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_M = "|".join(MONTHS)
_S = "|".join(SHORT_MONTHS)


@dataclass(frozen=True)
class Rule:
    """A pattern over lower-case text, the date it means and, for a span, where that ends.

    The functions get the matched text and the reference date. A text that isn't a real
    date gives null and is dropped.
    """

    name: str
    pattern: str
    confidence: float
    start: Callable[[Column, Column], Column]
    end: Callable[[Column, Column], Column] | None = None


def _n(m: Column) -> Column:
    return F.regexp_extract(m, r"(\d+)", 1).try_cast("int")


def _month_no(m: Column, names: list[str]) -> Column:
    name = F.regexp_extract(m, f"({'|'.join(names)})", 1)
    return F.array_position(F.array(*[F.lit(x) for x in names]), name).cast("int")


def _year(m: Column) -> Column:
    return F.regexp_extract(m, r"(\d{4})", 1).try_cast("int")


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")


def _first(d: Column) -> Column:
    return F.trunc(d, "month").cast("date")


def _day(m: Column) -> Column:
    return F.regexp_extract(m, r"[a-z]+\s+(\d{1,2})", 1).try_cast("int")


RULES = [
    Rule("iso_date", r"\d{4}-\d{1,2}-\d{1,2}", 0.95, lambda m, r: _date(F.split(m, "-")[0], F.split(m, "-")[1], F.split(m, "-")[2])),
    Rule("month_year", rf"(?:{_M})\s+\d{{4}}", 0.9, lambda m, r: _date(_year(m), _month_no(m, MONTHS), F.lit(1)), lambda m, r: F.last_day(_date(_year(m), _month_no(m, MONTHS), F.lit(1)))),
    Rule("short_date", rf"(?:{_S})\s+\d{{1,2}},?\s+\d{{4}}", 0.95, lambda m, r: _date(_year(m), _month_no(m, SHORT_MONTHS), _day(m))),
    Rule("yesterday", "yesterday", 0.9, lambda m, r: F.date_sub(r, 1)),
    Rule("today", "today", 0.9, lambda m, r: r),
    Rule("days_ago", r"\d{1,4}\s+days?\s+ago", 0.85, lambda m, r: F.date_sub(r, _n(m))),
    Rule("last_week", r"last\s+week", 0.75, lambda m, r: F.date_sub(r, 7), lambda m, r: r),
    Rule("weeks_ago", r"\d{1,4}\s+weeks?\s+ago", 0.8, lambda m, r: F.date_sub(r, _n(m) * 7)),
    Rule("this_week", r"this\s+week", 0.8, lambda m, r: F.date_sub(r, F.weekday(r)), lambda m, r: r),
    Rule("last_month", r"last\s+month", 0.75, lambda m, r: _first(F.add_months(r, -1)), lambda m, r: F.last_day(F.add_months(r, -1))),
    Rule("months_ago", r"\d{1,4}\s+months?\s+ago", 0.8, lambda m, r: _first(F.add_months(r, -_n(m)))),
    Rule("this_month", r"this\s+month", 0.8, lambda m, r: _first(r), lambda m, r: r),
    Rule("last_year", r"last\s+year", 0.7, lambda m, r: _date(F.year(r) - 1, F.lit(1), F.lit(1)), lambda m, r: _date(F.year(r) - 1, F.lit(12), F.lit(31))),
    Rule("years_ago", r"\d{1,3}\s+years?\s+ago", 0.75, lambda m, r: _date(F.year(r) - _n(m), F.lit(1), F.lit(1))),
    Rule("since_year", r"since\s+\d{4}", 0.85, lambda m, r: _date(_year(m), F.lit(1), F.lit(1)), lambda m, r: r),
    Rule("since_month", rf"since\s+(?:{_M})(?:\s+\d{{4}})?", 0.8, lambda m, r: _date(F.coalesce(_year(m), F.year(r)), _month_no(m, MONTHS), F.lit(1)), lambda m, r: r),
    Rule("recently", r"recently|lately", 0.5, lambda m, r: F.date_sub(r, 14), lambda m, r: r),
]


def markers(text: Column, reference: Column) -> Column:
    """array<struct<rule, matched, starts, ends, confidence>> of all markers in a text, whole words only."""
    low = F.lower(text)

    def of(rule: Rule) -> Column:
        found = F.regexp_extract_all(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({rule.pattern})(?![\p{{L}}\p{{N}}_])"), 1)
        ends = rule.end or (lambda m, r: F.lit(None))
        return F.transform(
            found,
            lambda m: F.struct(
                F.lit(rule.name).alias("rule"), m.alias("matched"), rule.start(m, reference).cast("date").alias("starts"), ends(m, reference).cast("date").alias("ends"), F.lit(rule.confidence).alias("confidence")
            ),
        )

    return F.filter(F.concat(*[of(r) for r in RULES]), lambda x: x["starts"].isNotNull())


SESSION_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "dd/MM/yyyy")


def session_date(text: Column) -> Column:
    """The date of a session in one of the usual formats, or the first date inside the text; null else."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    whole = [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in SESSION_FORMATS]
    inside = F.try_to_timestamp(F.initcap(F.nullif(F.regexp_extract(F.lower(t), rf"(\d{{1,2}} (?:{_M}) \d{{4}})", 1), F.lit(""))), F.lit("d MMMM yyyy")).cast("date")
    iso = F.nullif(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")).try_cast("date")
    return F.coalesce(*whole, inside, iso)
