"""Text as column expressions: tokens, n-grams, cleaning, entity overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hashtags, user names and addresses are one token; so are words; other signs stand alone.
TOKEN = r"https?://[^\s]+|[#@][a-z0-9_]+|[a-z0-9_à-ÿ]+(?:['-][a-z0-9_à-ÿ]+)*|[^\sa-z0-9_à-ÿ]"
#: Words as TF-IDF counts them.
TERM = "[a-zA-Z0-9_]{2,}"


def tokens(text: Column) -> Column:
    """Lower-cased tokens; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased words of two characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def words(text: Column) -> Column:
    """What stands between runs of spaces, tabs and line ends."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\r\\n]+", -1), lambda w: w != "")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's own loops use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(items: Column, longest: int = 5) -> Column:
    """All runs of one to ``longest`` neighbouring items, joined by spaces."""

    def runs(items: Column) -> Column:
        def of_size(n: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(items) - n + 1)
            return F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), " "))

        sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(items)))
        return F.when(F.size(items) > 0, F.flatten(F.transform(sizes, of_size))).otherwise(F.array().cast("array<string>"))

    return once(items, runs)


def linkable(ngram: Column) -> Column:
    """Whether an n-gram may be looked up: single words that start with ~ or a digit, or are 'ga', may not."""
    return F.contains(ngram, F.lit(" ")) | ~ngram.rlike(r"^(?:[~0-9]|ga$)")


def hashtags(items: Column) -> Column:
    """Tokens that are hashtags."""
    return F.filter(items, lambda t: t.rlike("^#."))


def mask_urls(text: Column) -> Column:
    """Words that start with http become URL; words are joined by single spaces."""
    return F.array_join(F.transform(words(text), lambda w: F.when(w.startswith("http"), "URL").otherwise(w)), " ")


def is_retweet(text: Column) -> Column:
    """Whether RT stands in a text as a word."""
    return F.coalesce(text, F.lit("")).rlike(r"\bRT\b")


def type_token_ratio(text: Column) -> Column:
    """Distinct words over words; null without words."""
    w = words(F.lower(text))
    return F.try_divide(F.size(F.array_distinct(w)).cast("double"), F.size(w))


MONTHS = "januari februari maart april mei juni juli augustus september oktober november december"
DATE_LIKE = rf"#?[0-9]+ ?(?:{'|'.join(MONTHS.split())})"


def clean_chunks(text: Column) -> Column:
    """Chunks of a text without runs of punctuation, day-month phrases, user names and addresses."""
    plain = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), " {2,}", " ")
    plain = F.regexp_replace(plain, r"[.,!?:;]+(?= |$)", "")
    cut = F.split(plain, rf"(?:{DATE_LIKE})|(?:^|(?<= ))@[a-z0-9_]+|(?:^|(?<= ))http[^ ]*", -1)
    return F.filter(F.transform(cut, lambda c: F.trim(c)), lambda c: c != "")


def wiki_text(text: Column) -> Column:
    """Lower case, with brackets and quotes gone and a space before commas, stops and colons."""
    return F.regexp_replace(F.translate(F.lower(text), '()"', ""), r"([,.:])", " $1")


def wiki_anchor(text: Column) -> Column:
    """Trimmed and in lower case, without the signs that ``wiki_text`` treats."""
    return F.translate(F.lower(F.trim(text)), '.,:)("', "")


def shares_word(a: Column, b: Column) -> Column:
    """Whether two phrases have a word in common."""
    return F.arrays_overlap(F.split(a, " "), F.split(b, " "))


def resolve_overlap(entities: Column) -> Column:
    """Of entities (struct of term and score), keep each that shares no word with one kept before.

    Higher scores come first; of equal ones those of more words, then in the
    order of the alphabet. # is left out and _ is a space when words are compared.
    """
    plain = lambda e: F.split(F.translate(e["term"], "_#", " "), " ")
    # what rows are compared by is made once for each, and so are the words that are taken
    keyed = F.transform(entities, lambda e: F.struct((-e["score"]).alias("o1"), (-F.size(plain(e))).alias("o2"), e["term"].alias("o3"), plain(e).alias("words"), e.alias("e")))
    start = lambda ordered: F.struct(F.slice(F.transform(ordered, lambda x: x["e"]), 1, 0).alias("kept"), F.array().cast("array<string>").alias("words"))

    def step(s: Column, x: Column) -> Column:
        more = F.struct(F.array_append(s["kept"], x["e"]).alias("kept"), F.concat(s["words"], F.coalesce(x["words"], F.array().cast("array<string>"))).alias("words"))
        return F.when(F.arrays_overlap(s["words"], x["words"]), s).otherwise(more)

    return once(F.array_sort(keyed), lambda ordered: F.aggregate(ordered, start(ordered), step, lambda s: s["kept"]))


def positions_before(text: Column, a: Column, b: Column) -> Column:
    """Whether both phrases are in a text, the first one earlier; null unless both are."""
    at, bt = F.instr(text, a), F.instr(text, b)
    return F.when((at > 0) & (bt > 0), at < bt)
