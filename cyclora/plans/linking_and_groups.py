"""Queries on names, tags, enrichment, groups of terms and judged systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.functions import linking as L
from cyclora.functions import text as T
from cyclora.functions.numbers import rounded
from cyclora.operators import corpus, enrich, events
from cyclora.operators import evaluate as E
from cyclora.operators import periodic as P
from cyclora.plans.registry import query
from cyclora.plans.standins import keyed_events, sparse_terms, table
from cyclora.sources.shared import shared_folder

# names of nations in texts that are written from customers

_NAMED = "SELECT c_custkey AS id, c_nationkey AS a, c_custkey % 30 AS b FROM customer"


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("Feest in Nation_%s, daarna naar nation_%s (%s)", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 30).cast("string"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("text"))


@query(f"SELECT id, array_to_string(['nation_' || a] || CASE WHEN b < 25 THEN ['nation_' || b] ELSE [] END, ',') AS places, CASE WHEN b < 25 THEN 3 ELSE 2 END AS n_chunks FROM ({_NAMED})")
def city_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a gazetteer in chunks, and the chunks cut at them."""
    pattern = L.gazetteer([f"Nation_{k}" for k in range(25)])
    chunks = F.array("text")
    rows = _visits(spark, sf_dir)
    return rows.select("id", F.array_join(L.names_in(chunks, pattern), ",").alias("places"), F.size(L.cut_names(chunks, pattern)).alias("n_chunks"))


@query(f"SELECT id, 'nation_' || unnest(CASE WHEN b < 25 THEN [a, b] ELSE [a] END) AS name FROM ({_NAMED})")
def gazetteer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of names."""
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"))
    return corpus.mentions(_visits(spark, sf_dir).select("id", T.tokens(F.col("text")).alias("tokens")), names)


def _suffix_tagger(texts: list[str]) -> list[list[tuple[str, str]]]:
    return [[(w, "WW(tgw)" if w.endswith("d") else "N(soort)" if w.endswith("t") else "LID(bep)") for w in t.split()] for t in texts]


@query(
    """WITH w AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT id, word, CASE WHEN word[-1] = 'd' THEN 'WW(tgw)' ELSE 'N(soort)' END AS tag, count(*) AS n FROM w WHERE word[-1] IN ('d', 't') GROUP BY ALL"""
)
def tagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of content words under a tagger that is plugged in."""
    tags = L.content_words(L.tagged(F.col("p_name"), _suffix_tagger))
    return enrich.tag_counts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tags.alias("tags")))


@query("SELECT p_partkey AS id, rtrim(string_split(p_name, ' ')[1], 'd') || ',' || rtrim(string_split(p_name, ' ')[2], 'd') AS lemmas FROM part")
def term_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas of terms under a lemmatiser that is plugged in."""
    found = L.lemmas(F.array("p_name"), lambda words: [w.rstrip("d") for w in words])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(found, ",").alias("lemmas"))


@query()
def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as events: overlapping entities resolved, salient words added, terms ordered, variety of the texts."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    texts = turns.select(F.col("conv_id").alias("id"), F.col("turn").alias("text_id"), "text")
    words = texts.select("id", F.explode(T.terms(F.col("text"))).alias("word"))
    entity = F.struct(F.col("term"), F.length("term").cast("double").alias("score"))
    found = texts.select("id", F.explode(T.ngrams(T.terms(F.col("text")), 2)).alias("term")).distinct().groupBy("id").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    got = enrich.enrich(found, texts, words)
    return got.select("id", F.array_join("terms", " | ").alias("terms"), rounded("ratio", 6).alias("ratio"))


@query("SELECT o_custkey AS cluster, max(o_totalprice) AS score, list_aggregate(list_sort(list(DISTINCT o_orderpriority)), 'string_agg', ', ') AS terms, count(*)::INTEGER AS n_texts FROM orders GROUP BY o_custkey")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cluster"), F.col("o_totalprice").alias("score"), F.array("o_orderpriority").alias("terms"), F.array("o_orderkey").alias("text_ids")
    )
    return events.merge_members(rows).select("cluster", "score", F.array_join("terms", ", ").alias("terms"), F.size("text_ids").alias("n_texts"))


# groups of terms


def _cosines_of(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    """Cosines of users from the numbers in their events."""
    tokens = keyed_events(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.collect_list(F.col("k").cast("string")).alias("tokens"))
    return corpus.cosines(pairs.select("a", "b"), corpus.tfidf(tokens))


@query()
def stdev_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that share days, grouped and scored together."""
    dates = P.term_dates(keyed_events(spark, sf_dir).select(F.col("user_id").alias("term"), "date"))
    gaps = P.intervals(dates)
    scores = P.relative_deviation(gaps, more_than=0)
    shared_folder(spark)
    near = P.similar_dates(dates.join(scores, "term", "left_semi"), gaps).checkpoint()
    groups = P.group_by_dates(scores, near, _cosines_of(spark, sf_dir, near), 0.6)
    got = P.merge_intervals(groups, scores, dates)
    return got.select("term", F.array_join(F.transform("terms", lambda t: t.cast("string")), ",").alias("terms"), rounded("score", 6).alias("score"), F.size("dates").alias("n_dates"), F.size("intervals").alias("n_intervals"))


@query()
def calendar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that order on one day of the year, grouped by cosine of their orders' words and scored together."""
    dates = P.term_dates(sparse_terms(spark, sf_dir))
    found = P.sequences(dates, "date")
    scored = P.select(P.score(found, dates.groupBy("term").agg(F.count(F.lit(1)).alias("n_dates")))).where("score > 0.25")
    shared_folder(spark)
    scored = scored.checkpoint()  # used three times
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("term"), F.to_date("o_orderdate").alias("date"), T.terms(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).alias("w"))
    each = P.texts_of_patterns(scored, orders.select("term", "date", F.col("w").alias("text_id")))
    docs = each.groupBy("term", "pattern").agg(F.flatten(F.collect_list("text_id")).alias("tokens")).withColumn("id", F.xxhash64("term", "pattern"))
    sims = corpus.similar_pairs(corpus.tfidf(docs.select("id", "tokens")), 0.7, docs.select("id", F.col("pattern").alias("key")))
    name = lambda k, *more: docs.select(F.col("id").alias(k), F.col("term").alias(f"t{k}"), *more)
    cosines = sims.join(name("a", "pattern"), "a").join(name("b"), "b").select("ta", "tb", "pattern", "cosine")
    groups = P.group_similar(scored, cosines, 0.7)
    got = P.merge_groups(scored, groups, dates)
    return got.select("term", "pattern", F.size("dates").alias("n"), "step", rounded("coverage", 6).alias("coverage"), rounded("consistency", 6).alias("consistency"))


@query(
    """WITH t AS (SELECT DISTINCT o_custkey AS term, o_orderdate::DATE AS date FROM orders),
p AS (SELECT term, month(date) AS m, day(date) AS d FROM t GROUP BY ALL HAVING count(*) > 2)
SELECT p.term, '<e,' || m || ',v,' || d || ',v,v>' AS pattern, o_orderdate::DATE AS date, o_orderkey AS text_id
FROM p JOIN orders ON o_custkey = p.term AND month(o_orderdate) = m AND day(o_orderdate) = d"""
)
def periodic_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.yearly(P.term_dates(sparse_terms(spark, sf_dir)), "date").withColumn("pattern", P.pattern_text())
    posts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("term"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("text_id"))
    return P.texts_of_patterns(found, posts).select("term", "pattern", "date", "text_id")


@query(
    """WITH t AS (SELECT DISTINCT o_custkey AS term, o_orderdate::DATE AS date FROM orders)
SELECT term, date FROM t WHERE term IN (SELECT term FROM t WHERE date >= DATE '2001-06-01')"""
)
def terms_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.since(P.term_dates(sparse_terms(spark, sf_dir)), "2001-06-01")


@query("WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events) SELECT event_id AS id, value FROM events, s WHERE abs(value - m) < d")
def inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.inliers(keyed_events(spark, sf_dir).select("id", "value"), "value")


@query(
    """WITH t AS (SELECT DISTINCT l_suppkey AS term, l_shipdate::DATE AS date FROM lineitem),
f AS (SELECT term, date, year(date) AS y, month(date) AS m, day(date) AS d, weekofyear(date) AS w, isodow(date) AS wd, (day(date) - 1) // 7 AS nth FROM t),
p AS (SELECT 'yearly date' AS kind FROM f GROUP BY term, m, d HAVING count(*) > 2
  UNION ALL SELECT 'yearly nth weekday' FROM f GROUP BY term, m, wd, nth HAVING count(*) > 2
  UNION ALL SELECT 'yearly week' FROM f GROUP BY term, w, wd HAVING count(*) > 2)
SELECT kind, count(*) AS n FROM p GROUP BY kind"""
)
def pattern_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = P.term_dates(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("term"), F.to_date("l_shipdate").alias("date")))
    found = P.yearly(dates, "date").unionByName(P.yearly(dates, "nth weekday")).unionByName(P.yearly(dates, "week"))
    return found.groupBy(E.pattern_kind(P.pattern_text()).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT DISTINCT o_custkey AS term, o_orderdate::DATE AS date FROM orders),
g AS (SELECT * FROM (SELECT term, row_number() OVER w - 1 AS pos, date - lag(date) OVER w AS i FROM t WINDOW w AS (PARTITION BY term ORDER BY date)) WHERE i > 1),
c AS (SELECT term, i, count(*) AS n, min(pos) AS first FROM g GROUP BY ALL),
s AS (SELECT i FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, first) AS k FROM c) WHERE k = 1)
SELECT count(*) AS n, round(avg(i), 6) AS mean, round(stddev_pop(i), 6) AS deviation, round(median(i), 6) AS median FROM s"""
)
def step_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and median of customers' modal intervals, single days aside."""
    gaps = P.intervals(P.term_dates(sparse_terms(spark, sf_dir))).where("interval > 1")
    got = E.step_statistics(P.modal_step(gaps))
    return got.select("n", *[rounded(c, 6).alias(c) for c in ("mean", "deviation", "median")])


# judged systems

_SIDES = """WITH g AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ')) AS term FROM part),
s AS (SELECT DISTINCT p_partkey AS id, unnest([string_split(p_name, ' ')[2], 'cold', lower(p_type)]) AS term FROM part)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    gold = part.select(F.col("p_partkey").alias("id"), F.explode(words).alias("term"))
    return gold, part.select(F.col("p_partkey").alias("id"), F.explode(F.array(words[1], F.lit("cold"), F.lower("p_type"))).alias("term"))


@query(
    _SIDES
    + """, n AS (SELECT (SELECT count(*) FROM g JOIN s USING (id, term)) AS n_right, (SELECT count(*) FROM s) AS n_system, (SELECT count(*) FROM g) AS n_gold)
SELECT *, round(n_right / n_system, 6) AS precision, round(n_right / n_gold, 6) AS recall, round(2 * n_right / (n_system + n_gold), 6) AS f1 FROM n"""
)
def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.entity_scores(*_sides(spark, sf_dir))
    return got.select("n_right", "n_system", "n_gold", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    _SIDES
    + """, m AS (SELECT g.id, g.term AS gt, s.term AS st FROM g JOIN s ON g.id = s.id AND (contains(g.term, s.term) OR contains(s.term, g.term))),
n AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT id, st FROM m)) AS n_right, (SELECT count(*) FROM s) AS n_system, (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM (SELECT DISTINCT id, gt FROM m)) AS met)
SELECT n_right, n_system, n_gold, round(n_right / n_system, 6) AS precision, round(met / n_gold, 6) AS recall, round(2 * (n_right / n_system) * (met / n_gold) / (n_right / n_system + met / n_gold), 6) AS f1 FROM n"""
)
def entity_scores_lax(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.entity_scores(*_sides(spark, sf_dir), lax=True)
    return got.select("n_right", "n_system", "n_gold", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """WITH x AS (SELECT 'a' AS system, doc_id AS term, quality AS correct FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT 'b', doc_id, quality FROM labels WHERE doc_id % 2 = 0),
m AS (SELECT system, avg(correct) AS p, sum(correct) / (SELECT count(DISTINCT term) FROM x WHERE correct = 1) AS r FROM x GROUP BY system)
SELECT system, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM m"""
)
def pooled_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("term"), F.col("quality").alias("correct"))
    got = E.pooled(judged.where("term % 3 <> 0"), judged.where("term % 2 = 0"))
    return got.select("system", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """SELECT p_partkey AS id, array_to_string(string_split(p_name, ' '), ',') AS gold, CASE WHEN p_size > 25 THEN lower(p_type) ELSE '' END AS first,
  CASE WHEN p_size % 2 = 0 THEN 'b,' || p_brand ELSE '' END AS second FROM part"""
)
def three_way_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    first = part.where("p_size > 25").select("id", F.array(F.lower("p_type")).alias("entities"))
    second = part.where("p_size % 2 = 0").select("id", F.array(F.lit("b"), F.col("p_brand")).alias("entities"))
    got = E.three_way(part.select("id", F.split("p_name", " ").alias("entities")), first, second)
    return got.select("id", *[F.array_join(c, ",").alias(c) for c in ("gold", "first", "second")])


@query(
    """WITH n AS (SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS t, (SELECT count(DISTINCT doc_id) FROM labels) AS a, (SELECT count(*) FROM documents WHERE n_chars >= 800) AS b,
  (SELECT count(DISTINCT doc_id) FROM labels JOIN documents USING (doc_id) WHERE n_chars >= 800) AS c)
SELECT round(100.0 * a / t, 6) AS share_a, round(100.0 * b / t, 6) AS share_b, round(100.0 * c / t, 6) AS share_both, round(100.0 * (a + b - c) / t, 6) AS share_any FROM n"""
)
def time_tag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = E.coverage(table(spark, sf_dir, "labels"), docs.where("n_chars >= 800"), docs, "doc_id")
    return got.select(*[rounded(c, 6).alias(c) for c in got.columns])


@query(
    """WITH x AS (SELECT o_orderkey % 30 AS survey, o_orderkey // 30 AS pos, o_orderpriority[1:1] AS system, o_custkey AS item, o_orderkey % 2 AS vote FROM orders)
SELECT system, item, array_to_string(list(vote ORDER BY survey, vote), ',') AS votes FROM x GROUP BY ALL"""
)
def survey_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes found by survey and position, gathered by system and item."""
    o = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 30).alias("survey"), F.expr("o_orderkey div 30").alias("pos"), F.substring("o_orderpriority", 1, 1).alias("system"), F.col("o_custkey").alias("item"), (F.col("o_orderkey") % 2).alias("vote")
    )
    got = E.answers(o.select("survey", "pos", "system", "item"), o.select("survey", "pos", "vote"))
    return got.select("system", "item", F.array_join(F.transform("votes", lambda v: v.cast("string")), ",").alias("votes"))
