"""Names in texts, and words with tags and lemmas from taggers that are plugged in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cyclora.functions import text as T

TAGS = "array<struct<word:string,tag:string>>"
#: Tags of verbs, and of adjectives and nouns.
VERB, CONTENT = r"^WW\(", r"^(?:WW|ADJ|N)\("


def gazetteer(names: Iterable[str]) -> str:
    """A pattern for any of the names (compared in lower case) as whole words, longer names first."""
    ordered = sorted({n.strip().lower() for n in names if n.strip()}, key=lambda n: (-len(n), n))
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(map(re.escape, ordered))})(?![\p{{L}}\p{{N}}_])" if ordered else "(?!)"


def names_in(chunks: Column, pattern: str) -> Column:
    """The names in all chunks, in order."""
    return F.flatten(F.transform(chunks, lambda c: F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))))


def cut_names(chunks: Column, pattern: str) -> Column:
    """Chunks cut at the names in them; empty pieces go."""
    pieces = F.flatten(F.transform(chunks, lambda c: F.transform(F.split(F.lower(c), pattern, -1), lambda p: F.trim(p))))
    return F.filter(pieces, lambda p: p != "")


def tagged(text: Column, tagger: Callable[[list[str]], list[list[tuple[str, str]]]] | None = None) -> Column:
    """Words and tags of a text. ``tagger`` takes texts and gives (word, tag) pairs for each; without one every token is a noun."""
    if tagger is None:
        return F.transform(T.tokens(text), lambda t: F.struct(t.alias("word"), F.lit("N()").alias("tag")))

    @pandas_udf(TAGS)
    def run(texts: pd.Series) -> pd.Series:
        found = tagger([t if isinstance(t, str) else "" for t in texts])
        return pd.Series([[{"word": w, "tag": t} for w, t in words] for words in found])

    return run(text)


def content_words(tags: Column, verbs_only: bool = False) -> Column:
    """The tagged words that are verbs, adjectives or nouns."""
    return F.filter(tags, lambda t: t["tag"].rlike(VERB if verbs_only else CONTENT))


def lemmas(terms: Column, lemmatiser: Callable[[list[str]], list[str]] | None = None) -> Column:
    """A lemma for each word of the terms. ``lemmatiser`` takes words; without one a word is its own lemma."""
    words = F.flatten(F.transform(terms, lambda t: F.filter(F.split(t, " "), lambda w: w != "")))
    if lemmatiser is None:
        return words

    @pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        every = [[] if x is None else list(x) for x in lists]
        flat = iter(lemmatiser([w for x in every for w in x]))
        return pd.Series([[next(flat) for _ in x] for x in every])

    return run(words)
