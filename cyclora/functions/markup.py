"""Tagged text: TIMEX3 annotations, bold parts of pages, entity labels of tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that say when: days, weeks, months, seasons and references to them.
TIMEX_VALUE = r"^(?:[0-9X]{4}-(?:[0-9X]{2}(?:-[0-9X]{2})?|W[0-9X]{2}(?:-WE|-[0-9X])?)|[0-9]{4}-(?:SP|SU|FA|WI)|UNDEF-.*|FUTURE_REF)(?:T.*)?$"
#: Words that name the day of writing or a neighbouring one.
NEAR = ["gisteren", "vandaag", "morgen"]


def timexes(text: Column) -> Column:
    """Array of (type, value, phrase) of the TIMEX3 tags in a text."""
    tag = '<TIMEX3[^>]*type="([^"]*)"[^>]*value="([^"]*)"[^>]*>([^<]*)</TIMEX3>'
    parts = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(tag), F.lit(k)) for k in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("type", "value", "phrase"), strict=True)]), lambda x: x)


def future_timexes(tags: Column, written: Column, lax: bool = False) -> Column:
    """The tags that refer to a time after the day of writing: dates later than it, times, and sets if ``lax``."""
    full = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"

    def keeps(t: Column) -> Column:
        later = F.when(t["value"].rlike(full), F.try_to_date(F.substring(t["value"], 1, 10)) > written).otherwise(F.lit(True))
        known = F.when(t["type"] == "DATE", later).when(t["type"] == "TIME", F.lit(True)).when(t["type"] == "SET", F.lit(lax)).otherwise(F.lit(False))
        return known & t["value"].rlike(TIMEX_VALUE) & ~F.lower(t["phrase"]).isin(NEAR)

    return F.filter(tags, lambda t: F.coalesce(keeps(t), F.lit(False)))


def bold(html: Column) -> Column:
    """What stands after each <b>, up to the next tag."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?i)<b>([^<]*)"), F.lit(1))


def labelled(tokens: Column, entities: Column) -> Column:
    """A label for each token: B-ORG where an entity (tokens joined by spaces) starts, I-ORG within it, O elsewhere."""
    parts = F.transform(entities, lambda e: F.split(e, " "))

    def at(_: Column, i: Column) -> Column:
        starts = lambda e, j: F.slice(tokens, j + 1, F.size(e)) == e
        begins = F.exists(parts, lambda e: starts(e, i))
        # inside: an entity started up to its length before
        inside = F.exists(
            parts, lambda e: (F.size(e) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(e) - 1, F.lit(1))), lambda k: (i - k >= 0) & starts(e, F.greatest(i - k, F.lit(0))))
        )
        return F.when(begins, "B-ORG").when(inside, "I-ORG").otherwise("O")

    return F.transform(tokens, at)
