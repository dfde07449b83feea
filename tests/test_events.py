"""Ranking, counting over texts, merging and enrichment of events."""

import collections
import datetime as dt
import math
import random
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cyclora.functions import association as A
from cyclora.functions import text as T
from cyclora.operators import corpus, enrich, events, order, ranking

DAY = dt.date(2020, 1, 1)


def brute_g2(n, a, b, o):
    total = 0.0
    for seen, product in ((o, a * b), (a - o, a * (n - b)), (b - o, (n - a) * b), (n - a - b + o, (n - a) * (n - b))):
        if seen > 0 and product > 0:
            total += seen * math.log2(seen / (product / n))
    return total


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 40), st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=40))
def test_g_squared(spark, cells):
    rows = spark.createDataFrame(cells, "n long, a long, b long, o long")
    for r in rows.withColumn("x", A.g_squared(*map(F.col, "nabo"))).withColumn("y", A.g_squared(*map(F.col, "nbao"))).collect():
        assert math.isclose(r["x"], brute_g2(r["n"], r["a"], r["b"], r["o"]), abs_tol=1e-9)
        assert math.isclose(r["x"], r["y"], abs_tol=1e-9)


def test_g_squared_is_zero_for_independence(spark):
    row = spark.createDataFrame([(100, 20, 30, 6)], "n long, a long, b long, o long")
    assert abs(row.select(A.g_squared(*map(F.col, "nabo"))).first()[0]) < 1e-9
    assert math.isclose(row.select(A.pointwise_information(*map(F.col, "nabo"))).first()[0], 0.0, abs_tol=1e-12)
    assert row.select(A.overlap_ratio(F.col("a"), F.col("b"), F.col("o"))).first()[0] == 6 / 50


def pairs_of(spark, n=600):
    rng = random.Random(1)
    rows = [(DAY + dt.timedelta(days=rng.randrange(8)), f"e{rng.randrange(5)}", f"t{rng.randrange(40)}") for _ in range(n)]
    return rows, spark.createDataFrame(rows, "date date, entity string, text string")


def test_events_are_ranked(spark):
    rows, pairs = pairs_of(spark)
    both, dates, entities, texts = (collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set))
    for d, e, t in rows:
        both[d, e] += 1
        dates[d] += 1
        entities[e] += 1
        texts[d, e].add(t)
    want = {k: round(brute_g2(700, dates[k[0]], entities[k[1]], o), 6) for k, o in both.items() if len(texts[k]) >= 12}
    total = spark.createDataFrame([(700,)], "n_total long")
    got = ranking.rank_events(pairs.repartition(5), total, support=12, top=1000).collect()
    assert {(r["date"], r["entity"]): r["g2"] for r in got} == want
    assert [r["g2"] for r in got] == sorted(want.values(), reverse=True)
    assert len(ranking.rank_events(pairs, total, support=12, top=3).collect()) == 3
    assert ranking.rank_events(pairs.limit(0), total).count() == 0


def test_windows_of_days(spark):
    rows = spark.createDataFrame([(DAY + dt.timedelta(days=k * k), k) for k in range(9) for _ in range(k + 1)], "date date, k int")
    assert {r["k"] for r in ranking.recent_days(rows, 3).collect()} == {6, 7, 8}
    assert ranking.enough_days(rows, 9).count() == 45 and ranking.enough_days(rows, 10).count() == 0
    assert {r["k"] for r in ranking.warmed_up(rows, 5).collect()} == {5, 6, 7, 8}


def test_running_sums_and_precision(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0.1, 0.2, 0.5, None]), rng.randrange(2)) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, score double, good int").repartition(7)
    got = {r["id"]: (r["rank"], r["precision"]) for r in ranking.running_precision(df, "score", "good", "id").collect()}
    right = 0
    for k, (i, _, good) in enumerate(sorted(rows, key=lambda r: (-r[1] if r[1] is not None else math.inf, r[0]))):
        right += good
        assert got[i] == (k + 1, right / (k + 1))
    assert sorted(r["p"] for r in order.positions(df, ["id"], "p").collect()) == list(range(300))
    assert order.positions(df.limit(0), ["id"], "p").count() == 0


def test_counts_over_texts(spark):
    texts = {1: "de hond ziet de kat", 2: "de kat", 3: "", 4: "de hond ziet de kat"}
    items = spark.createDataFrame([(i, t.split()) for i, t in texts.items()], "id int, tokens array<string>")
    grams = collections.Counter(" ".join(t.split()[i : i + n]) for t in texts.values() for n in range(1, 6) for i in range(len(t.split()) - n + 1))
    assert {r["ngram"]: r["n_total"] for r in corpus.ngram_counts(items).collect()} == dict(grams)
    anchors = spark.createDataFrame([("de kat",), ("de kat",), ("hond",), ("vis",)], "ngram string")
    known = corpus.commonness(anchors, items)
    assert {r["ngram"]: r["commonness"] for r in known.collect()} == {"de kat": 2 / 3, "hond": 1 / 2}
    assert sorted((r["id"], r["ngram"]) for r in corpus.link(items, known, 0.5).collect()) == [(1, "de kat"), (2, "de kat"), (4, "de kat")]
    assert {r["term"]: list(r["postings"]) for r in corpus.inverted_index(items).collect()}["hond"] == [1, 4]
    names = spark.createDataFrame([("de kat",), ("ziet",)], "name string")
    assert sorted(tuple(r) for r in corpus.mentions(items, names).collect()) == [(1, "de kat"), (1, "ziet"), (2, "de kat"), (4, "de kat"), (4, "ziet")]


def test_tfidf_and_cosines(spark):
    texts = {1: "a a b", 2: "b c", 3: "d", 4: "a a b"}
    items = spark.createDataFrame([(i, t.split()) for i, t in texts.items()], "id int, tokens array<string>")
    df = collections.Counter(w for t in texts.values() for w in set(t.split()))
    want = {}
    for i, t in texts.items():
        raw = {w: n * (math.log((1 + 4) / (1 + df[w])) + 1) for w, n in collections.Counter(t.split()).items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        want |= {(i, w): x / size for w, x in raw.items()}
    weights = corpus.tfidf(items)
    got = {(r["id"], r["term"]): r["weight"] for r in weights.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a int, b int")
    sims = {r["b"]: r["cosine"] for r in corpus.cosines(pairs, weights).collect()}
    assert math.isclose(sims[4], 1) and sims[3] == 0 and 0 < sims[2] < 1
    assert [r["term"] for r in corpus.top_terms(weights, 1).where("id = 1").collect()] == ["a"]


def test_windows_are_merged(spark):
    schema = "event_id int, date date, score double, terms array<string>, text_ids array<int>"
    current = spark.createDataFrame([(1, DAY, 9.1, ["rode hond"], [1, 2, 3]), (2, DAY, 1.0, ["kat"], [7]), (3, DAY + dt.timedelta(days=1), 1.0, ["kat"], [1])], schema)
    new = spark.createDataFrame([(10, DAY, 10.2, ["hond"], [3, 4]), (11, DAY, 5.0, ["vis"], [9])], schema)
    got = {r["event_id"]: r for r in events.merge_windows(current, new).collect()}
    assert set(got) == {1, 2, 3, 11}
    assert (got[1]["score"], got[1]["terms"], got[1]["text_ids"]) == (10.2, ["rode hond"], [3, 4, 1, 2])
    assert got[2]["text_ids"] == [7] and got[3]["score"] == 1.0
    assert events.merge_windows(current.limit(0), new).count() == 2 and events.merge_windows(current, new.limit(0)).count() == 3


def test_places_and_terms(spark):
    places = spark.createDataFrame([(1, "utrecht")] * 9 + [(1, "breda")] + [(2, "a"), (2, "b")] + [(3, "nederland")], "id int, place string")
    assert [(r["id"], r["place"]) for r in events.place_vote(places).collect()] == [(1, "utrecht")]
    terms = spark.createDataFrame([(["5 mei", "breda", "feest"],), (["breda", "#12december"],), ([],)], "t array<string>")
    kept = [r[0] for r in terms.select(events.drop_dates_and_places(F.col("t"), F.array(F.lit("breda")))).collect()]
    assert kept == [["breda", "feest"], None, None]


def test_terms_follow_their_texts(spark):
    rows = spark.createDataFrame([(1, ["hond", "kat", "vis"], ["een kat en een hond", "kat hond vis", "vis"]), (2, [], ["x"]), (3, ["a", "a"], [])], "id int, entities array<string>, texts array<string>")
    got = {r["id"]: r["entities"] for r in events.order_by_position(rows).collect()}
    assert list(got[1]) == ["kat", "hond", "vis"] and list(got[2]) == [] and list(got[3]) == ["a"]


def test_representative_texts_differ(spark):
    rows = [(1, 1, "a b c d e", 0.9), (1, 2, "a b c d e #x", 0.8), (1, 3, "f g http://x", 0.5), (1, 4, "h", None), (1, 5, "i j", 0.7)]
    scored = spark.createDataFrame(rows, "event_id int, text_id int, text string, score double")
    assert events.representative(scored, 3).first()["texts"] == ["a b c d e", "i j", "f g URL"]
    assert events.representative(scored, 5).first()["texts"] == ["a b c d e", "i j", "f g URL", "h", "a b c d e #x"]


def test_events_are_enriched(spark):
    found = spark.createDataFrame([(1, [("rode hond", 0.9), ("hond", 0.4)]), (2, [])], "id int, entities array<struct<term:string,score:double>>")
    texts = spark.createDataFrame([(1, 1, "markt met rode hond"), (1, 2, "markt en rode hond 22"), (2, 1, "iets anders hier")], "id int, text_id int, text string")
    words = spark.createDataFrame([(1, "markt"), (1, "22"), (2, "anders")], "id int, word string")
    places = spark.createDataFrame([(1, "breda")], "id int, place string")
    got = {r["id"]: r for r in enrich.enrich(found, texts, words, places).collect()}
    assert list(got[1]["terms"]) == ["markt", "rode hond", "breda"] and list(got[2]["terms"]) == ["anders"]
    assert math.isclose(got[1]["ratio"], 6 / 9) and got[2]["ratio"] == 1


def test_order_is_that_of_every_pair():
    def slow(entities, texts):
        rank = {e: k for k, e in enumerate(entities)}
        for k, a in enumerate(entities):
            for b in entities[k + 1 :]:
                both = [(t.find(a), t.find(b)) for t in texts if a in t and b in t]
                before = sum(x < y for x, y in both)
                first, second = (a, b) if before > len(both) - before else (b, a)
                if 2 * before != len(both) and rank[first] > rank[second]:
                    goal, old = rank[second], rank[first]
                    rank |= {e: r + 1 for e, r in rank.items() if goal <= r < old} | {first: goal}
        return sorted(entities, key=rank.__getitem__)

    rng = random.Random(10)
    for _ in range(200):
        words = [f"w{k}" for k in range(rng.randint(0, 12))]
        texts = [" ".join(rng.sample(words, rng.randint(0, len(words)))) for _ in range(rng.randint(0, 5))]
        assert events._ordered(words, texts) == slow(words, texts)


def test_many_entities_are_ordered_and_resolved_in_time(spark):
    """A thousand entities in six texts; pairs aren't searched in the texts each by itself."""
    words = [f"word{k}" for k in range(1000)]
    texts = [" ".join(random.Random(s).sample(words, 1000)) for s in range(6)]
    start = time.perf_counter()
    events._ordered(words, texts)
    assert time.perf_counter() - start < 10
    row = spark.createDataFrame([([(f"{a} {b}", 1.0) for a, b in zip(words, words[1:])],)], "e array<struct<term:string,score:double>>")
    kept = row.select(F.transform(T.resolve_overlap(F.col("e")), lambda e: e["term"]).alias("x")).first()["x"]
    seen, want = set(), []
    for g in sorted(f"{a} {b}" for a, b in zip(words, words[1:])):
        if seen.isdisjoint(g.split()):
            want.append(g)
            seen.update(g.split())
    assert kept == want


def test_few_anchors_are_sent_to_the_corpus(spark):
    """The corpus's n-grams are looked up where they are: only those that are anchors are shuffled."""
    anchors = spark.createDataFrame([("de kat",), ("hond",)], "ngram string")
    items = spark.createDataFrame([(1, ["de", "kat", "hond"])], "id int, tokens array<string>")
    known = corpus.commonness(anchors, items)
    for plan in (known, corpus.link(items, known)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in text
