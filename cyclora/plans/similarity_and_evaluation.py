"""Queries on similarity, merging, sets and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.functions import markup as M
from cyclora.functions import text as T
from cyclora.functions.numbers import rounded
from cyclora.operators import blocks as B
from cyclora.operators import cluster as C
from cyclora.operators import corpus, events, ranking
from cyclora.operators import evaluate as E
from cyclora.plans.registry import query
from cyclora.plans.standins import keyed_events, sparse_terms, table
from cyclora.sources.shared import spread

# turns of conversations stand for events of one date


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "text")


def _turn_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tfidf(_turns(spark, sf_dir).select("id", T.terms(F.col("text")).alias("tokens")))


_TURN_COSINES = """
WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id, text FROM conversations),
x AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]{2,}')) AS term FROM c),
tf AS (SELECT id, term, count(*) AS tf FROM x GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
r AS (SELECT id, term, tf * (ln((1.0 + (SELECT count(*) FROM c)) / (1.0 + df)) + 1.0) AS raw FROM tf JOIN df USING (term)),
w AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM r),
p AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.id < b.id),
s AS (SELECT a, b, sum(wa.weight * wb.weight) AS cosine FROM p JOIN w wa ON wa.id = a JOIN w wb ON wb.id = b AND wb.term = wa.term GROUP BY a, b)
"""


@query(_TURN_COSINES + "SELECT p.a, p.b, round(coalesce(cosine, 0), 6) AS cosine FROM p LEFT JOIN s ON s.a = p.a AND s.b = p.b")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = C.same_key_pairs(_turns(spark, sf_dir), "conv_id").select("a", "b")
    return corpus.cosines(pairs, _turn_weights(spark, sf_dir)).select("a", "b", rounded("cosine", 6).alias("cosine"))


@query(_TURN_COSINES + "SELECT a, b, round(cosine, 6) AS cosine FROM s WHERE cosine > 0.7")
def same_date_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _turns(spark, sf_dir).select("id", F.col("conv_id").alias("key"))
    return corpus.similar_pairs(_turn_weights(spark, sf_dir), 0.7, keys).select("a", "b", rounded("cosine", 6).alias("cosine"))


@query(_TURN_COSINES.replace("a.conv_id = b.conv_id AND ", "") + "SELECT a, b, round(cosine, 6) AS cosine FROM s WHERE cosine > 0.7")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of any conversation."""
    return corpus.similar_pairs(_turn_weights(spark, sf_dir), 0.7).select("a", "b", rounded("cosine", 6).alias("cosine"))


@query()
def same_date_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-linkage clusters of turns of one conversation."""
    turns = _turns(spark, sf_dir).select("id", F.col("conv_id").alias("date"), F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"))
    return C.merge_same_date(turns, _turn_weights(spark, sf_dir), 0.2)


@query(
    """WITH t AS (SELECT o_orderkey AS id, o_custkey AS term, o_orderdate::DATE AS d FROM orders),
r AS (SELECT term FROM t GROUP BY term HAVING count(*) < 0.03 * (SELECT count(*) FROM t))
SELECT DISTINCT x.id AS a, y.id AS b FROM t x JOIN t y ON x.term = y.term AND x.id < y.id JOIN r ON r.term = x.term
WHERE abs(y.d - x.d) BETWEEN 2 AND 800"""
)
def canopy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("term"), F.to_date("o_orderdate").alias("date"))
    return C.canopies(orders.select("id", "term"), orders.select("id", "date"))


@query("SELECT x.o_orderkey AS a, y.o_orderkey AS b FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey")
def entity_canopies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"))
    return C.same_key_pairs(orders, "entity").select("a", "b")


_EDGES = """
WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT x.id AS a, y.id AS b, round(list_dot_product(x.e, y.e), 6) AS sim FROM v x JOIN v y ON x.label = y.label AND x.id <> y.id),
n AS (SELECT a, b, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM p) WHERE rank <= 5),
m AS (SELECT x.a, x.b FROM n x JOIN n y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b)
"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of one label."""
    return B.nearest(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), F.col("embedding").alias("e")), 5)


@query(_EDGES + "SELECT a, b, sim, rank::INTEGER AS rank FROM n")
def topk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir)


@query(_EDGES + "SELECT a, b FROM m")
def mutual_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mutual(_nearest(spark, sf_dir)).select("a", "b")


@query(
    _EDGES
    + """, u AS (SELECT a, b FROM m UNION ALL SELECT b, a FROM m),
reach(id, r) AS (SELECT id, id FROM v UNION SELECT reach.id, u.b FROM reach JOIN u ON u.a = reach.r)
SELECT id, min(r) AS component FROM reach GROUP BY id"""
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = C.mutual(_nearest(spark, sf_dir))
    return C.components(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), edges)


@query(
    """WITH RECURSIVE o AS (SELECT o_custkey AS grp, o_orderkey AS id, o_orderdate::DATE AS date FROM orders),
k AS (SELECT *, (date - DATE '1970-01-01')::BIGINT * 4294967296 + id AS k FROM o),
r(grp, k) AS (SELECT grp, min(k) FROM k GROUP BY grp
  UNION ALL SELECT r.grp, min(k.k) FROM r JOIN k ON k.grp = r.grp AND k.k // 4294967296 > r.k // 4294967296 + 30 GROUP BY r.grp)
SELECT k.grp, k.id, k.date FROM k JOIN r ON r.grp = k.grp AND r.k = k.k WHERE k.grp IN (SELECT grp FROM r GROUP BY grp HAVING count(*) >= 3)"""
)
def spaced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer that are more than 30 days apart."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"))
    return C.spaced(orders, 30)


@query(
    """WITH t AS (SELECT DISTINCT user_id AS u, ts::DATE AS d FROM events),
s AS (SELECT u, count(*) AS n FROM t GROUP BY u)
SELECT x.u AS a, y.u AS b, count(*)::INTEGER AS shared FROM t x JOIN t y ON x.d = y.d AND x.u < y.u JOIN s sx ON sx.u = x.u JOIN s sy ON sy.u = y.u
GROUP BY x.u, y.u, sx.n, sy.n HAVING count(*) > 2 AND count(*) > 0.5 * sx.n AND count(*) > 0.5 * sy.n"""
)
def date_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that share more than two days, and more than half of the days of either: sets are compared by shared days."""
    t = keyed_events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("date").alias("item"))
    return C.overlapping_sets(t, 0.5).where("shared > 2")


# merging of windows


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = keyed_events(spark, sf_dir)
    day = F.datediff("date", F.lit("2024-01-01").cast("date")).cast("bigint")
    make = lambda key, n: e.groupBy("date", key).agg(
        F.max("value").alias("score"), F.array_sort(F.collect_set("user_id")).alias("text_ids")
    ).select(
        (day * 1000 + n).alias("event_id"),
        "date", "score", F.array(F.concat(F.lit("t "), F.col(key).cast("string"))).alias("terms"), "text_ids",
    )
    kinds = F.array(*map(F.lit, sorted(_KINDS)))
    return make("k", F.col("k").cast("bigint")), make("event_type", 500 + F.array_position(kinds, F.col("event_type")))


_KINDS = ["click", "error", "login", "logout", "purchase", "search", "signup", "view"]
_WINDOWS = """
WITH e AS (SELECT ts::DATE AS d, json_extract_string(props, '$.k')::INTEGER AS k, event_type AS t, user_id AS u, value AS v FROM events),
cur AS (SELECT (d - DATE '2024-01-01') * 1000 + k AS id, d, max(v) AS score, list(DISTINCT u) AS us FROM e GROUP BY d, k),
new AS (SELECT (d - DATE '2024-01-01') * 1000 + 500 + list_position([{kinds}], t) AS id, d, max(v) AS score, list(DISTINCT u) AS us FROM e GROUP BY d, t),
p AS (SELECT new.id AS new_id, cur.id AS current_id, len(list_intersect(new.us, cur.us)) AS n_shared, len(new.us) AS n_new
      FROM new JOIN cur ON cur.d = new.d WHERE len(list_intersect(new.us, cur.us)) > 0.10 * len(new.us))
""".format(kinds=", ".join(f"'{k}'" for k in sorted(_KINDS)))


@query(_WINDOWS + "SELECT new_id::BIGINT AS new_id, current_id::BIGINT AS current_id, n_shared::BIGINT AS n_shared, n_new::BIGINT AS n_new FROM p")
def window_dedup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, new = _windows(spark, sf_dir)
    flat = lambda df: df.select("event_id", "date", F.explode("text_ids").alias("text_id"))
    return events.overlapping(flat(new), flat(current))


@query(
    _WINDOWS
    + """SELECT cur.id::BIGINT AS event_id, cur.d AS date, greatest(any_value(cur.score), max(n.score)) AS score,
  len(list_distinct(flatten(list(n.us)) || any_value(cur.us)))::INTEGER AS n_texts
FROM cur JOIN p ON p.current_id = cur.id JOIN new n ON n.id = p.new_id GROUP BY cur.id, cur.d
UNION ALL SELECT id, d, score, len(us) FROM cur WHERE id NOT IN (SELECT current_id FROM p)
UNION ALL SELECT id, d, score, len(us) FROM new WHERE id NOT IN (SELECT new_id FROM p)"""
)
def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = events.merge_windows(*_windows(spark, sf_dir))
    return merged.select("event_id", "date", "score", F.size("text_ids").alias("n_texts"))


@query(
    """SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text"""
)
def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("text")


@query()
def resolved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest terms and pairs of words of each benchmark item without overlap, in the order of the text."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.terms(F.col("text")).alias("t"), F.lower("text").alias("text"))
    grams = F.array_distinct(T.ngrams(F.col("t"), 2))
    scored = F.transform(grams, lambda g: F.struct(g.alias("term"), F.floor(F.length(g) / 5).cast("double").alias("score")))
    kept = F.transform(T.resolve_overlap(scored), lambda e: e["term"])
    ordered = events.order_by_position(items.select("item_id", kept.alias("entities"), F.array("text").alias("texts")))
    return ordered.select("item_id", F.array_join("entities", " | ").alias("entities"))


@query()
def representative_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five turns that stand for each conversation."""
    turns = _turns(spark, sf_dir)
    weights = corpus.tfidf(turns.select(F.col("conv_id").alias("id"), T.terms(F.col("text")).alias("tokens")).groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("tokens")))
    texts = turns.select(F.col("conv_id").alias("event_id"), F.col("turn").alias("text_id"), "text")
    chosen = events.representative(events.text_scores(texts, weights.withColumnRenamed("id", "event_id")))
    return chosen.select("event_id", F.posexplode("texts").alias("rank", "text"))


@query("SELECT event_type, count(*) AS n FROM events WHERE NOT regexp_matches(event_type, '^#?[0-9]+ ?mei') AND event_type NOT IN ('view', 'click') GROUP BY ALL")
def drop_dates_and_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(F.col("event_type"), F.lit("5 mei"), F.lit("#12december"), F.lit("view"))
    kept = events.drop_dates_and_places(terms, F.array(F.lit("view"), F.lit("click")))
    rows = keyed_events(spark, sf_dir).withColumn("terms", kept).where("terms is not null")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# evaluation

_JUDGED = """
WITH j AS (SELECT d.doc_id AS id, d.lang, l.quality AS gold, CASE WHEN d.n_chars >= 800 THEN 1 ELSE 0 END AS guess,
  round(least(d.n_chars / 5000.0, 1.0), 2) AS score FROM documents d JOIN labels l USING (doc_id))
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), "lang", F.col("quality").alias("gold"), F.when(F.col("n_chars") >= 800, 1).otherwise(0).alias("guess"), rounded(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), 2).alias("score")
    )


@query(
    _JUDGED
    + """, m AS (SELECT lang, count(*) AS n, sum(gold * guess)::DOUBLE / nullif(sum(guess), 0) AS p, sum(gold * guess)::DOUBLE / nullif(sum(gold), 0) AS r FROM j GROUP BY lang)
SELECT lang, n, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM m"""
)
def prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.prf(_judged(spark, sf_dir), "gold", "guess", "lang")
    return got.select("lang", "n", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_RANKED = _JUDGED + ", r AS (SELECT id, row_number() OVER w AS rank, round(sum(gold) OVER w / row_number() OVER w, 6) AS precision FROM j WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranking.running_precision(_judged(spark, sf_dir), "score", "gold", "id")
    return got.select("id", F.col("rank").cast("bigint").alias("rank"), rounded("precision", 6).alias("precision"))


@query(_RANKED + " SELECT id, rank, precision FROM r")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


@query(_RANKED + " SELECT rank, precision FROM r WHERE rank % 50 = 0")
def accuracy_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).where("rank % 50 = 0").select("rank", "precision")


@query(
    _JUDGED
    + """, t AS (SELECT k / 100.0 AS threshold FROM range(0, 101) AS r(k))
SELECT threshold::DOUBLE AS threshold, count(id) AS n, round(avg(gold), 6) AS accuracy FROM t LEFT JOIN j ON j.score >= t.threshold GROUP BY threshold"""
)
def accuracy_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    thresholds = spark.range(0, 101).select((F.col("id") / 100.0).alias("threshold"))
    got = E.accuracy_by_threshold(_judged(spark, sf_dir), thresholds, correct="gold")
    return got.withColumn("accuracy", rounded("accuracy"))


@query(
    """WITH h AS (SELECT isodow(o_orderdate) - 1 AS bin, count(*) AS n FROM orders GROUP BY ALL)
SELECT b.bin::INTEGER AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM orders), 6) AS share FROM range(0, 10) AS b(bin) LEFT JOIN h ON h.bin = b.bin"""
)
def calendar_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays of orders; bins beyond Sunday show that missing ones are filled."""
    days = table(spark, sf_dir, "orders").select(F.weekday(F.to_date("o_orderdate")).alias("weekday"))
    return E.histogram(days, "weekday", 0, 9).withColumn("share", rounded("share", 6))


@query(
    """WITH g AS (SELECT o_custkey AS term, o_orderdate::DATE - lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE) AS i FROM (SELECT DISTINCT o_custkey, o_orderdate::DATE AS o_orderdate FROM orders)),
c AS (SELECT i AS step, count(*) AS n FROM g WHERE i > 1 GROUP BY i)
SELECT step::INTEGER AS step, n, round(n / sum(n) OVER (), 6) AS share FROM c"""
)
def interval_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cyclora.operators import periodic as P

    gaps = P.intervals(P.term_dates(sparse_terms(spark, sf_dir))).where("interval > 1").select(F.col("interval").alias("step"))
    return E.share_of(gaps, "step").withColumn("share", rounded("share", 6))


@query("SELECT quality AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY quality")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.share_of(table(spark, sf_dir, "labels").select(F.col("quality").alias("label")), "label")
    return got.withColumn("share", rounded("share", 6))


@query(
    """WITH a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), b AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars >= 800)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (doc_id)) AS n_both,
  (SELECT count(*) FROM a ANTI JOIN b USING (doc_id)) AS n_only_a, (SELECT count(*) FROM b ANTI JOIN a USING (doc_id)) AS n_only_b,
  (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_any"""
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compare_sets(table(spark, sf_dir, "labels").where("quality = 1"), table(spark, sf_dir, "documents").where("n_chars >= 800"), "doc_id")


_VOTES = "SELECT o_orderkey AS id, [o_orderkey % 2, o_orderkey // 2 % 2, o_orderkey // 4 % 2, o_orderkey // 8 % 2] AS v FROM orders"


def _votes() -> Column:
    return F.array(*[F.expr(f"o_orderkey div {d} % 2") for d in (1, 2, 4, 8)])


@query(
    f"SELECT id, CASE list_sum(v) WHEN 0 THEN 'no_event' WHEN 1 THEN '25' WHEN 2 THEN '50' WHEN 3 THEN '75' ELSE 'event' END AS four, "
    f"CASE list_sum(v[1:2]) WHEN 0 THEN 'no_event' WHEN 1 THEN '50' ELSE 'event' END AS two FROM ({_VOTES})"
)
def annotator_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), E.event_vote(_votes(), 4).alias("four"), E.event_vote(F.slice(_votes(), 1, 2), 2).alias("two")
    )


@query(
    """WITH v AS (SELECT o_orderkey AS id, nullif(o_orderkey % 4, 0) AS a, nullif(o_orderkey // 4 % 4, 0) AS b FROM orders),
n AS (SELECT id, a, b, ['GOOD', 'MED', 'BAD'][coalesce(a, b)] AS x, least(a, b) AS lo, greatest(a, b) AS hi FROM v)
SELECT id, CASE WHEN a IS NULL AND b IS NULL THEN 'MISS' WHEN a IS NULL OR b IS NULL OR a = b THEN x
  WHEN hi = 3 AND lo = 1 THEN 'MIXED' WHEN hi = 3 THEN 'BAD' ELSE 'MED' END AS verdict FROM n"""
)
def term_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    vote = lambda d: F.expr(f"nullif(o_orderkey div {d} % 4, 0)")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), E.term_vote(vote(1), vote(4)).alias("verdict"))


@query(
    """WITH g AS (SELECT p_partkey AS id, unnest(string_split(lower(p_name), ' ')) AS term FROM part), s AS (SELECT p_partkey AS id, lower(p_type) AS term FROM part)
SELECT g.id, g.term, bool_or(contains(g.term, s.term) OR contains(s.term, g.term)) AS matched FROM g JOIN s USING (id) GROUP BY g.id, g.term"""
)
def lax_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    gold = part.select(F.col("p_partkey").alias("id"), F.explode(F.split(F.lower("p_name"), " ")).alias("term")).distinct()
    return E.lax_match(gold, part.select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("term")))


@query(
    """WITH o AS (SELECT DISTINCT o_custkey AS term, o_orderdate::DATE AS date FROM orders), p AS (SELECT term, date + 7 AS date FROM o)
SELECT p.term, p.date, CASE WHEN o.term IS NULL THEN 0 ELSE 1 END AS correct FROM p LEFT JOIN o USING (term, date)"""
)
def prediction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = sparse_terms(spark, sf_dir).distinct()
    predicted = seen.select(F.array("term").alias("terms"), F.date_add("date", 7).alias("date"))
    return E.predictions_met(predicted, seen).select(F.col("terms")[0].alias("term"), "date", "correct")


@query("SELECT o_custkey AS term, min(o_orderdate::DATE) AS date FROM orders GROUP BY ALL")
def first_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sparse_terms(spark, sf_dir).select(F.array("term").alias("terms"), "date")
    return E.first_predictions(rows).select(F.col("terms")[0].alias("term"), "date")


@query(
    """WITH p AS (SELECT item_id AS id, row_number() OVER (ORDER BY md5('11:' || item_id), item_id) - 1 AS p FROM benchmark)
SELECT id, (p + k * 15) % 30 AS set FROM p, range(0, 2) AS r(k)"""
)
def annotator_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.allocate(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), 30, 2, seed=11).select("id", F.col("set").cast("bigint").alias("set"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'DATE' ELSE 'TIME' END AS type, (o_orderdate::DATE + (o_orderkey % 5)::INTEGER)::VARCHAR AS value
FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 = 0) AND o_orderkey % 3 <> 2"""
)
def timex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags in texts that are written from orders: dates later than the day of writing and times stay, sets don't."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    kind = F.element_at(F.array(F.lit("DATE"), F.lit("TIME"), F.lit("SET")), (F.col("id") % 3 + 1).cast("int"))
    value = F.date_add("d", (F.col("id") % 5).cast("int")).cast("string")
    text = F.format_string('Zie <TIMEX3 tid="t1" type="%s" value="%s">dan</TIMEX3> en <TIMEX3 type="DATE" value="2030-01-01">morgen</TIMEX3>', kind, value)
    tags = M.future_timexes(M.timexes(text), F.col("d"))
    return o.select("id", F.explode(tags).alias("t")).select("id", "t.type", "t.value")


@query(
    r"""SELECT p_partkey AS id, array_to_string([CASE WHEN i = 2 THEN 'B-ORG' WHEN i = 3 THEN 'I-ORG' ELSE 'O' END FOR w, i IN string_split(p_name, ' ')], ' ') AS labels
FROM (SELECT p_partkey, 'de ' || p_name || ' x' AS p_name FROM part WHERE len(string_split(p_name, ' ')) = 2 AND string_split(p_name, ' ')[1] <> string_split(p_name, ' ')[2])"""
)
def iob_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where((F.size(F.split("p_name", " ")) == 2) & (F.split("p_name", " ")[0] != F.split("p_name", " ")[1]))
    tokens = F.split(F.concat(F.lit("de "), F.col("p_name"), F.lit(" x")), " ")
    return part.select(F.col("p_partkey").alias("id"), F.array_join(M.labelled(tokens, F.array("p_name")), " ").alias("labels"))


@query("SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<b>([^<]*)', 1)) AS part FROM pages")
def bold_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(M.bold(F.col("html"))).alias("part"))
