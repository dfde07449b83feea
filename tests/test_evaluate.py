"""Measures over judged results."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from cyclora.functions.numbers import rounded
from cyclora.operators import evaluate as E


def test_precision_and_recall(spark):
    rows = spark.createDataFrame([("x", 1, 1), ("x", 1, 0), ("x", 0, 1), ("y", 0, 0)], "k string, gold int, guess int")
    got = {r["k"]: r for r in E.prf(rows, "gold", "guess", "k").collect()}
    assert (got["x"]["precision"], got["x"]["recall"], got["x"]["f1"]) == (0.5, 0.5, 0.5)
    assert got["y"]["precision"] is None and got["y"]["f1"] is None


def test_entities(spark):
    gold = spark.createDataFrame([(1, "rode hond"), (1, "kat"), (2, "vis")], "id int, term string")
    system = spark.createDataFrame([(1, "hond"), (1, "kat"), (3, "x")], "id int, term string")
    strict, lax = (E.entity_scores(gold, system, lax).first() for lax in (False, True))
    assert (strict["n_right"], strict["precision"], strict["recall"]) == (1, 1 / 3, 1 / 3)
    assert (lax["n_right"], lax["precision"], lax["recall"]) == (2, 2 / 3, 2 / 3)
    assert E.entity_scores(gold, system.limit(0)).first()["precision"] is None


def test_pooled_recall(spark):
    a = spark.createDataFrame([("p", 1), ("q", 0), ("r", 1), ("r", 1)], "term string, correct int")
    b = spark.createDataFrame([("p", 1), ("s", 1)], "term string, correct int")
    got = {r["system"]: (r["precision"], r["recall"]) for r in E.pooled(a, b).collect()}
    assert got == {"a": (2 / 3, 2 / 3), "b": (1.0, 2 / 3)}


def test_sides_by_id(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id int, entities array<string>")
    got = {r["id"]: (r["first"], r["second"]) for r in E.three_way(frame([(1, ["a"]), (2, [])]), frame([(1, ["b"]), (9, ["z"])]), frame([(2, ["c", "d"])])).collect()}
    assert got == {1: (["b"], []), 2: ([], ["c", "d"])}


def test_thresholds(spark):
    judged = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1)], "score double, correct int")
    steps = spark.createDataFrame([(1.0,), (0.9,), (0.5,)], "threshold double")
    got = {r["threshold"]: (r["n"], r["accuracy"]) for r in E.accuracy_by_threshold(judged, steps).collect()}
    assert got == {1.0: (0, None), 0.9: (1, 1.0), 0.5: (3, 2 / 3)}
    below = {r["threshold"]: r["n"] for r in E.accuracy_by_threshold(judged, steps, at_most=True).collect()}
    assert below == {1.0: 3, 0.9: 3, 0.5: 2}


def test_shares_and_sets(spark):
    rows = spark.createDataFrame([(1,), (1,), (3,), (None,)], "x int")
    got = {r["bin"]: (r["n"], r["share"]) for r in E.histogram(rows, "x", 0, 3).collect()}
    assert got == {0: (0, 0.0), 1: (2, 2 / 3), 2: (0, 0.0), 3: (1, 1 / 3)}
    a, b, every = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 2, 2, 3], [3, 4], range(10)))
    assert tuple(E.compare_sets(a, b, "k").first()) == (3, 2, 1, 2, 1, 4)
    assert tuple(E.coverage(a, b, every, "k").first()) == (30.0, 20.0, 10.0, 40.0)


def test_votes(spark):
    votes = [[0, 0, 0, 0], [1, 0, 0, 0], [1, 1, 0, 0], [1, 1, 1, 0], [1, 1, 1, 1]]
    got = spark.createDataFrame([(v,) for v in votes], "v array<int>").select(E.event_vote(F.col("v"), 4), E.event_vote(F.slice("v", 1, 2), 2)).collect()
    assert [tuple(r) for r in got] == [("no_event", "no_event"), ("25", "50"), ("50", "event"), ("75", "event"), ("event", "event")]
    cases = {(1, 1): "GOOD", (3, 3): "BAD", (2, 2): "MED", (None, None): "MISS", (1, None): "GOOD", (None, 3): "BAD", (1, 3): "MIXED", (2, 3): "BAD", (1, 2): "MED"}
    rows = spark.createDataFrame(list(cases), "a int, b int").select("a", "b", E.term_vote(F.col("a"), F.col("b")).alias("v")).collect()
    assert {(r["a"], r["b"]): r["v"] for r in rows} == cases


def test_predictions(spark):
    day = dt.date(2014, 1, 1)
    seen = spark.createDataFrame([("a", day), ("b", day)], "term string, date date")
    rows = spark.createDataFrame([(["a", "c"], day), (["c"], day), (["b"], day + dt.timedelta(days=1)), (["b"], day)], "terms array<string>, date date")
    got = {(tuple(r["terms"]), r["date"]): r["correct"] for r in E.predictions_met(rows, seen).collect()}
    assert got == {(("a", "c"), day): 1, (("c",), day): 0, (("b",), day + dt.timedelta(days=1)): 0, (("b",), day): 1}
    assert {(tuple(r["terms"]), r["date"]) for r in E.first_predictions(rows).collect()} == {(("a", "c"), day), (("c",), day), (("b",), day)}


def test_allocation_is_even_and_distinct(spark):
    got = [tuple(r) for r in E.allocate(spark.range(250), 30, 2, 7).collect()]
    sets = {}
    for i, s in got:
        sets.setdefault(s, []).append(i)
    assert sorted(map(len, sets.values())) == [16] * 10 + [17] * 20
    assert len(set(got)) == 500


def test_steps_kinds_and_answers(spark):
    steps = [7, 7, 30, 365]
    r = E.step_statistics(spark.createDataFrame([(s,) for s in steps], "step int")).first()
    assert (r["n"], r["mean"], r["median"]) == (4, statistics.mean(steps), statistics.median(steps)) and abs(r["deviation"] - statistics.pstdev(steps)) < 1e-9
    kinds = {"<e,5,v,5,v,v>": "yearly date", "<e,v,20,v,2,v>": "yearly week", "<e,5,v,v,1,2>": "yearly nth weekday", "<v,e,v,5,v,v>": "monthly date", "<v,e,v,v,1,2>": "monthly nth weekday", "<v,v,e,v,0,v>": "weekly"}
    rows = spark.createDataFrame([(k,) for k in kinds], "p string").select("p", E.pattern_kind(F.col("p")).alias("k")).collect()
    assert {x["p"]: x["k"] for x in rows} == kinds
    allocated = spark.createDataFrame([(1, 0, "s", "i"), (2, 3, "s", "i"), (1, 1, "s", "j")], "survey int, pos int, system string, item string")
    given = spark.createDataFrame([(1, 0, "1"), (2, 3, "0"), (1, 1, "1"), (2, 0, "1")], "survey int, pos int, vote string")
    assert {r["item"]: r["votes"] for r in E.answers(allocated, given).collect()} == {"i": ["1", "0"], "j": ["1"]}


def test_rounding_is_that_of_sql(spark):
    duck = pytest.importorskip("duckdb")
    values = [k / 5000.0 for k in range(5001)] + [-0.145, None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    want = [r[0] for v in values for r in duck.execute("SELECT round(?::DOUBLE, 2)", [v]).fetchall()]
    assert [r[0] for r in rows.orderBy("k").select(rounded("v", 2)).collect()] == want
    assert want[725] == 0.14 and want[-1] is None


def test_threshold_at_a_half(spark, tmp_path):
    from cyclora.plans import catalogue

    spark.createDataFrame([(k, "en", n) for k, n in enumerate((725, 726, 750, None))], "doc_id long, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(4)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["threshold"]: r["n"] for r in catalogue.QUERIES["accuracy_by_threshold"](spark, str(tmp_path)).collect()}
    assert (got[0.14], got[0.15], got[1.0]) == (4, 3, 1)  # 725 / 5000 * 100 is below 14.5


def test_precision_is_rounded_as_in_sql(spark, tmp_path):
    from cyclora.plans import catalogue

    duck = pytest.importorskip("duckdb").connect()
    spark.createDataFrame([(k, "en", 700 + k % 60) for k in range(640)], "doc_id long, lang string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 7 < 3)) for k in range(640)], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.QUERIES["precision_at_k"](spark, str(tmp_path)).select("id", "rank", "precision").orderBy("rank").collect()]
    assert got == duck.execute(f"SELECT id, rank, precision FROM ({catalogue.SQL['precision_at_k']}) ORDER BY rank").fetchall()
