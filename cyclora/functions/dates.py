"""Dates: calendar features, the nearest year, and references to future dates in Dutch texts."""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

REFERENCES = "struct<refdates:array<date>,phrase:string,chunks:array<string>>"


def features(date: Column) -> dict[str, Column]:
    """Year, month, ISO week, day, weekday (Monday is 0) and the how manieth such weekday of its month it is."""
    return {
        "year": F.year(date),
        "month": F.month(date),
        "week": F.weekofyear(date),
        "day": F.dayofmonth(date),
        "weekday": F.weekday(date),
        "nth": F.floor((F.dayofmonth(date) - 1) / 7).cast("int") + 1,
    }


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def nearest_year(posted: Column, month: Column, day: Column) -> Column:
    """The year whose ``day`` of ``month`` is nearest to ``posted``.

    The current year wins only if it is strictly nearest, then the next year
    only if strictly nearer than the last, else the last. Null where one of
    the three dates does not exist.
    """
    gaps = [F.abs(F.datediff(_date(F.year(posted) + k, month, day), posted)) for k in (-1, 0, 1)]
    year = F.when((gaps[1] < gaps[0]) & (gaps[1] < gaps[2]), 0).when(gaps[2] < gaps[0], 1).otherwise(-1) + F.year(posted)
    return F.when(gaps[0].isNotNull() & gaps[1].isNotNull() & gaps[2].isNotNull(), year)


_NUMBERS = (
    "een twee drie vier vijf zes zeven acht negen tien elf twaalf dertien veertien vijftien zestien zeventien achttien "
    "negentien twintig eenentwintig tweeentwintig drieentwintig vierentwintig vijfentwintig zesentwintig zevenentwintig "
    "achtentwintig negenentwintig dertig eenendertig"
).split()
_NUMBER = {w: k + 1 for k, w in enumerate(_NUMBERS)} | {"achtien": 18}
_MONTH = {w: k + 1 for k, w in enumerate("januari februari maart april mei juni juli augustus september oktober november december".split())}
_MONTH |= {w[:3]: k for w, k in _MONTH.items()} | {"mrt": 3}
_WEEKDAY = {d + "dag": k for k, d in enumerate("maan dins woens donder vrij zater zon".split())}
_UNIT = {}
for _days, _forms in ((1, "dag dagen dagje daagjes nacht nachten nachtje nachtjes"), (7, "week weken weekje weekjes"), (30, "maand maanden maandje maandjes")):
    _UNIT |= dict.fromkeys(_forms.split(), _days)


_HEDGES = "bijna krap maar maximaal minimaal ongeveer pakweg ruim slechts tenminste".split()


def _any(names: dict | list) -> str:
    return "|".join(sorted(names, key=len, reverse=True))


@lru_cache
def _rules() -> list[tuple[str, re.Pattern]]:
    n = rf"(?P<n>\d+|{_any(_NUMBER)})"
    unit = rf"(?P<unit>{_any(_UNIT)})"
    hedge = rf"(?:(?:{_any(_HEDGES)}|(?:maar )?een kleine|(?:maar )?iets meer dan|(?:maar )?iets minder dan) )?"
    part = "(?: (?:avond|nacht|ochtend|middag))?"
    return [
        ("relative", re.compile(rf"\b(?:over|nog) {hedge}{n} {unit}(?= |$)")),
        ("relative", re.compile(rf"\b{n} {unit}(?: slapen)? tot\b")),
        ("relative", re.compile(rf"\bmet(?: nog)? {hedge}{n} {unit}(?: nog)? te gaan\b")),
        ("month", re.compile(rf"\b{n} (?P<m>{_any(_MONTH)})(?: (?P<y>\d{{4}}))?(?= |$)")),
        ("ymd-", re.compile(r"\b(?P<y>\d{4})-(?P<a>\d{1,2})-(?P<b>\d{1,2})\b")),
        ("dmy-", re.compile(r"\b(?P<a>\d{1,2})-(?P<b>\d{1,2})(?:-(?P<y>\d{4}|\d{2}))?\b")),
        ("ymd/", re.compile(r"\b(?P<y>\d{4})/(?P<a>\d{1,2})/(?P<b>\d{1,2})\b")),
        ("dmy/", re.compile(r"\b(?P<a>\d{1,2})/(?P<b>\d{1,2})(?:/(?P<y>\d{4}|\d{2}))?\b")),
        ("weekday", re.compile(rf"\b(?P<how>volgende week|komende|aankomende|deze) (?P<w>{_any(_WEEKDAY)}){part}\b")),
        ("day after", re.compile(rf"\bovermorgen\b{part}")),
    ]


def _make(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None


def _nearest(posted: dt.date, month: int, day: int) -> dt.date | None:
    last, this, coming = (_make(posted.year + k, month, day) for k in (-1, 0, 1))
    if not (last and this and coming):
        return None
    gap = lambda d: abs((d - posted).days)
    if gap(this) < gap(last) and gap(this) < gap(coming):
        return this
    return coming if gap(coming) < gap(last) else last


def references(text: str, posted: dt.date, dialect: str = "fixed") -> tuple[list[dt.date], str, list[str]] | None:
    """Dates after ``posted`` that a lower-case text refers to, the phrases, and the text cut at them; None without a phrase.

    In the dialect 'legacy' y-m-d is read with day and month exchanged, d/m
    needs a first number of at most 12, 'volgende week' gives no date, and a
    second numeral of at most 12 switches relative rules off.
    """
    legacy = dialect == "legacy"
    found: list[tuple[int, int, str, re.Match]] = []
    for kind, pattern in _rules():
        for m in pattern.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b, *_ in found):
                found.append((m.start(), m.end(), kind, m))
    if not found:
        return None
    found.sort(key=lambda x: x[:2])
    kinds = {x[2] for x in found}
    numeric = kinds & {"ymd-", "dmy-", "ymd/", "dmy/"}
    numerals = [m["n"] for *_, kind, m in found if kind in ("relative", "month") and m["n"].isdigit()]
    confused = legacy and any(1 <= int(x) <= 12 for x in numerals[1:])
    number = lambda x: int(x) if x.isdigit() else _NUMBER[x]
    dates: list[dt.date | None] = []
    for _, _, kind, m in found:
        if kind == "relative":
            days = number(m["n"]) * _UNIT[m["unit"]]
            if days > 0 and days < 10**5 and not numeric and "month" not in kinds and not confused:
                dates.append(posted + dt.timedelta(days=days))
        elif kind == "month":
            if m["y"]:
                dates.append(_make(int(m["y"]), _MONTH[m["m"]], number(m["n"])))
            else:
                dates.append(_nearest(posted, _MONTH[m["m"]], number(m["n"])))
        elif kind == "weekday":
            ahead = (_WEEKDAY[m["w"]] - posted.weekday()) % 7
            if numeric or kinds & {"month", "relative"}:
                continue
            if m["how"] == "volgende week":
                if not legacy:
                    dates.append(posted + dt.timedelta(days=7 - posted.weekday() + _WEEKDAY[m["w"]]))
            elif ahead:
                dates.append(posted + dt.timedelta(days=ahead))
        elif kind == "day after":
            dates.append(posted + dt.timedelta(days=2))
        else:
            a, b, year = int(m["a"]), int(m["b"]), m["y"]
            short = len(m["a"]) == len(m["b"]) == 1
            if kind.startswith("ymd"):
                month, day = (b, a) if legacy and kind == "ymd-" else (a, b)
                if 2010 <= int(year) <= 2019 and not (short and kind == "ymd/"):
                    dates.append(_make(int(year), month, day))
            elif year is None:
                if not short and not (legacy and kind == "dmy/" and not 1 <= a <= 12):
                    dates.append(_nearest(posted, b, a))
            else:
                full = int(year) if len(year) == 4 else 2000 + int(year)
                if 2010 <= full <= 2020 and (len(year) == 2 or full < 2020) and not (legacy and kind == "dmy/" and not 1 <= a <= 12):
                    dates.append(_make(full, b, a))
    future = list(dict.fromkeys(d for d in dates if d and d > posted))
    chunks, at = [], 0
    for start, end, *_ in found:
        chunks.append(text[at:start].strip())
        at = end
    chunks.append(text[at:].strip())
    return future, ", ".join(m[0].strip() for *_, m in found), [c for c in chunks if c]


def date_references(text: Column, posted: Column, dialect: str = "fixed") -> Column:
    """``references`` of each row as a struct; null without a phrase, or where text or date is null."""

    @pandas_udf(REFERENCES)
    def run(texts: pd.Series, dates: pd.Series) -> pd.DataFrame:
        rows = []
        for text, date in zip(texts, dates, strict=True):
            got = references(text, date, dialect) if isinstance(text, str) and isinstance(date, dt.date) else None
            rows.append(got or ([], None, []))
        return pd.DataFrame(rows, columns=["refdates", "phrase", "chunks"])

    found = run(F.lower(text), posted)
    return F.when(found["phrase"].isNotNull(), found)
