"""Queries over whole texts: nothing after the first words, turns or steps is left out."""

import collections
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from cyclora.operators import periodic as P
from cyclora.plans import catalogue


@pytest.fixture
def written(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def grams(text, longest=5):
    w = re.findall("[a-z0-9_]{2,}", (text or "").lower())
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def test_ngrams_of_documents(spark, written):
    docs = ["one two three four five six seven eight " * 3, "seven eight nine", None, "filler " * 60]
    items = ["aa bb cc dd ee seven eight nine", None]
    written("documents", list(enumerate(docs)), "doc_id long, text string")
    d = written("benchmark", list(enumerate(items)), "item_id long, text string")
    seen = collections.Counter(g for t in docs for g in grams(t))
    anchors = collections.Counter(g for t in items for g in grams(t))
    got = {r["ngram"]: r["n_total"] for r in catalogue.QUERIES["document_ngram_1_5_counts"](spark, d).collect()}
    assert got == {g: n for g, n in seen.items() if n >= 3}
    got = {r["ngram"]: (r["n_anchor"], r["n_total"]) for r in catalogue.QUERIES["document_ngram_commonness"](spark, d).collect()}
    assert got == {g: (n, seen[g]) for g, n in anchors.items() if g in seen} and "seven eight nine" in got
    got = {r["ngram"]: r["n"] for r in catalogue.QUERIES["document_ngram_lookup"](spark, d).collect()}
    assert got == {g: seen[g] for g, n in anchors.items() if g in seen and n / seen[g] > 0.05}


def test_entities_of_whole_items(spark, written):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    d = written("benchmark", [(1, " ".join(words) + " longerword muchlonger")], "item_id long, text string")
    got = catalogue.QUERIES["resolved_entities"](spark, d).first()["entities"].split(" | ")
    assert "longerword muchlonger" in got  # the 121st gram


def test_entities_of_all_turns(spark, written):
    rows = [("c", 0, "aa bb cc dd ee ff gg hh"), ("c", 1, "zzzzz yyyyy"), ("e", 1, "later turn")]
    d = written("conversations", rows, "conv_id string, turn int, text string")
    got = {r["id"]: r["terms"].split(" | ") for r in catalogue.QUERIES["enriched_events"](spark, d).collect()}
    assert "zzzzz yyyyy" in got["c"] and "gg hh" in got["c"] and got["e"] == ["later turn"]


def test_weekly_predictions_reach_the_end(spark):
    first = dt.date(1990, 1, 9)
    rows = [("w", first + dt.timedelta(days=7 * k)) for k in range(5)]
    dates = P.term_dates(spark.createDataFrame(rows, "term string, date date"))
    chosen = P.select(P.score(P.sequences(dates, "week"), dates.groupBy("term").agg(F.count(F.lit(1)).alias("n_dates"))))
    last = dates.groupBy("term").agg(F.max("date").alias("last_date"))
    got = sorted(r["date"] for r in P.predict_calendar(chosen, last, F.lit("2003-12-31").cast("date")).collect())
    want = [rows[-1][1] + dt.timedelta(days=7 * k) for k in range(1, 900)]
    assert got == [d for d in want if d < dt.date(2003, 12, 31)]


def test_chunks_with_addresses_stay(spark, written):
    rows = [("c", 0, "mail a@b.com or reply here"), ("c", 1, "see xhttp://y with @jan at http://z now"), ("d", 0, "plain")]
    d = written("conversations", rows, "conv_id string, turn int, text string")
    got = sorted(map(tuple, catalogue.QUERIES["chunk_cleaning"](spark, d).collect()))
    assert got == [("c", 0, "mail a@b.com or reply here"), ("c", 1, "at"), ("c", 1, "now"), ("c", 1, "see xhttp://y with"), ("d", 0, "plain")]
