"""Queries over pairs of date and entity, and over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.functions import association as A
from cyclora.functions import text as T
from cyclora.functions.numbers import rounded
from cyclora.operators import corpus, ranking
from cyclora.plans.registry import query
from cyclora.plans.standins import document_tokens, event_pairs, keyed_events, table
from cyclora.sources.shared import spread

_G2 = """
CASE WHEN o > 0 AND dc * ec > 0 THEN o * log2(o / (dc * ec / n)) ELSE 0 END
+ CASE WHEN dc - o > 0 AND dc * (n - ec) > 0 THEN (dc - o) * log2((dc - o) / (dc * (n - ec) / n)) ELSE 0 END
+ CASE WHEN ec - o > 0 AND (n - dc) * ec > 0 THEN (ec - o) * log2((ec - o) / ((n - dc) * ec / n)) ELSE 0 END
+ CASE WHEN n - dc - ec + o > 0 AND (n - dc) * (n - ec) > 0 THEN (n - dc - ec + o) * log2((n - dc - ec + o) / ((n - dc) * (n - ec) / n)) ELSE 0 END
"""
_PAIRS = """
WITH p AS (SELECT ts::DATE AS d, {entity} AS e, {text} AS t FROM events),
c AS (SELECT d, e, count(*)::DOUBLE AS o, count(DISTINCT t) AS u FROM p GROUP BY d, e),
m AS (SELECT d, e, o, u, sum(o) OVER (PARTITION BY d) AS dc, sum(o) OVER (PARTITION BY e) AS ec, (SELECT count(*) FROM p)::DOUBLE AS n FROM c)
"""


def _total(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n_total"))


@query(_PAIRS.format(entity="event_type", text="value") + f"SELECT d AS date, e AS entity, o::BIGINT AS n_both, u AS n_texts, round({_G2}, 6) AS g2 FROM m WHERE u >= 5")
def g2_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = event_pairs(spark, sf_dir)
    return ranking.rank_events(pairs, _total(pairs), top=2500).select("date", "entity", "n_both", "n_texts", "g2")


@query(
    _PAIRS.format(entity="json_extract_string(props, '$.k')", text="round(value, 1)")
    + f"SELECT date, entity, g2 FROM (SELECT d AS date, e AS entity, round({_G2}, 6) AS g2 FROM m WHERE u >= 5) ORDER BY g2 DESC, date, entity LIMIT 2500"
)
def g2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = keyed_events(spark, sf_dir)
    pairs = e.select("date", F.col("k").cast("string").alias("entity"), rounded("value", 1).cast("string").alias("text"))
    return ranking.rank_events(pairs, _total(pairs), top=2500).select("date", "entity", "g2")


@query(
    _PAIRS.format(entity="event_type", text="value")
    + f"SELECT d AS date, e AS entity, round({_G2}, 6) AS g2 FROM m WHERE u >= 5 AND o * n > dc * ec"
)
def g2_expected_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = event_pairs(spark, sf_dir)
    return ranking.rank_events(pairs, _total(pairs), top=None, expected_only=True).select("date", "entity", "g2")


@query(_PAIRS.format(entity="event_type", text="value") + "SELECT d AS date, e AS entity, o::BIGINT AS n_both, u AS n_texts, dc::BIGINT AS n_date, ec::BIGINT AS n_entity FROM m")
def pair_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pair_counts(event_pairs(spark, sf_dir))


_BASKETS = """
WITH x AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT item, count(*)::DOUBLE AS n FROM x GROUP BY item),
b AS (SELECT p.item AS a, q.item AS b, count(*)::DOUBLE AS n FROM x p JOIN x q ON p.basket = q.basket AND p.item < q.item GROUP BY ALL)
SELECT b.a, b.b, round({expr}, 6) AS {name} FROM b JOIN s sa ON sa.item = b.a JOIN s sb ON sb.item = b.b
"""


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    return ranking.co_occurrence(lines.join(parts, "l_partkey").select(F.col("l_orderkey").alias("basket"), "item"))


@query(_BASKETS.format(name="pmi", expr="log10((b.n / (SELECT count(DISTINCT basket) FROM x)) / (sa.n * sb.n / pow((SELECT count(DISTINCT basket) FROM x), 2)))"))
def pmi_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = A.pointwise_information(F.col("n_baskets"), F.col("n_a"), F.col("n_b"), F.col("n_both"))
    return _brands(spark, sf_dir).select("a", "b", rounded(score, 6).alias("pmi"))


@query(_BASKETS.format(name="ratio", expr="b.n / (sa.n + sb.n)"))
def overlap_ratio_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brands(spark, sf_dir).select("a", "b", rounded(A.overlap_ratio(F.col("n_a"), F.col("n_b"), F.col("n_both")), 6).alias("ratio"))


@query(
    """WITH d AS (SELECT DISTINCT ts::DATE AS d FROM events ORDER BY d DESC LIMIT 7)
SELECT ts::DATE AS date, event_type, count(*) AS n FROM events WHERE ts::DATE IN (SELECT d FROM d) GROUP BY ALL"""
)
def sliding_day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.recent_days(keyed_events(spark, sf_dir), 7).groupBy("date", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_type, count(*) AS n FROM events WHERE (SELECT count(DISTINCT ts::DATE) FROM events) >= 6 GROUP BY ALL"""
)
def min_days_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.enough_days(keyed_events(spark, sf_dir), 6).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH d AS (SELECT DISTINCT ts::DATE AS d FROM events ORDER BY d LIMIT 20)
SELECT ts::DATE AS date, count(*) AS n FROM events WHERE ts::DATE NOT IN (SELECT d FROM d) GROUP BY ALL"""
)
def warm_up_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.warmed_up(keyed_events(spark, sf_dir), 20).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


# texts


@query(r"SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE NOT regexp_matches(coalesce(text, ''), '\bRT\b')")
def rt_style_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(~T.is_retweet(F.col("text"))).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


_TERMS = "SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]{2,}')) AS term FROM documents"


@query(f"SELECT term, count(*) AS n, count(DISTINCT id) AS n_docs FROM ({_TERMS}) GROUP BY term")
def tokens_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = document_tokens(spark, sf_dir).select("id", F.explode("tokens").alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_docs"))


_NGRAMS = """
WITH d AS ({source}),
t AS (SELECT id, generate_subscripts(tokens, 1) AS i, tokens FROM d),
g AS (SELECT id, n, array_to_string(tokens[i:i + n - 1], ' ') AS ngram FROM t, range(1, 6) AS r(n) WHERE i + n - 1 <= len(tokens))
"""
_CHUNKS = "SELECT row_number() OVER () AS id, regexp_extract_all(lower(text), '[a-zA-Z0-9_]{{2,}}') AS tokens FROM {table}"


@query(_NGRAMS.format(source=_CHUNKS.format(table="conversations")) + "SELECT ngram, n::INTEGER AS n, count(*) AS n_total FROM g GROUP BY ALL HAVING count(*) >= 3")
def ngram_1_5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations").select("text")).select(T.terms(F.col("text")).alias("tokens"))
    return corpus.ngram_counts(turns, 5, 3).select("ngram", "n", "n_total")


_COMMON = (
    _NGRAMS.format(source=_CHUNKS.format(table="conversations"))
    + """, a AS (SELECT array_to_string(regexp_extract_all(lower(text), '[a-zA-Z0-9_]{2,}')[1:n], ' ') AS ngram FROM benchmark, range(1, 6) AS r(n)
      WHERE len(regexp_extract_all(lower(text), '[a-zA-Z0-9_]{2,}')) >= n),
na AS (SELECT ngram, count(*) AS n_anchor FROM a GROUP BY ngram),
nt AS (SELECT ngram, count(*) AS n_total FROM g GROUP BY ngram),
k AS (SELECT ngram, n_anchor, n_total, n_anchor / n_total AS commonness FROM na JOIN nt USING (ngram))
"""
)


def _commonness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of benchmark items stand for anchors, conversations for the corpus."""
    items = table(spark, sf_dir, "benchmark").select(T.terms(F.col("text")).alias("t"))
    heads = F.transform(F.sequence(F.lit(1), F.least(F.lit(5), F.size("t"))), lambda n: F.array_join(F.slice("t", 1, n), " "))
    anchors = items.where(F.size("t") > 0).select(F.explode(heads).alias("ngram"))
    turns = spread(table(spark, sf_dir, "conversations").select("text")).select(T.terms(F.col("text")).alias("tokens"))
    return corpus.commonness(anchors, turns)


@query(_COMMON + "SELECT ngram, n_anchor, n_total, round(commonness, 6) AS commonness FROM k")
def ngram_commonness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commonness(spark, sf_dir).withColumn("commonness", rounded("commonness", 6))


@query(
    _COMMON
    + """SELECT ngram, round(any_value(commonness), 6) AS commonness, count(*) AS n
FROM g JOIN k USING (ngram) WHERE commonness > 0.05 AND NOT (n = 1 AND regexp_matches(ngram, '^(~|[0-9]|ga$)')) GROUP BY ngram"""
)
def ngram_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select(F.struct("conv_id", "turn").alias("id"), T.terms(F.col("text")).alias("tokens"))
    linked = corpus.link(turns, _commonness(spark, sf_dir))
    return linked.groupBy("ngram").agg(rounded(F.first("commonness"), 6).alias("commonness"), F.count(F.lit(1)).alias("n"))


def _document_commonness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All n-grams of benchmark items stand for anchors, whole documents for the corpus."""
    items = table(spark, sf_dir, "benchmark").select(F.explode(T.ngrams(T.terms(F.col("text")), 5)).alias("ngram"))
    return corpus.commonness(items, document_tokens(spark, sf_dir).select("tokens"))


@query()
def document_ngram_1_5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ngram_counts(document_tokens(spark, sf_dir).select("tokens"), 5, 3).select("ngram", "n", "n_total")


@query()
def document_ngram_commonness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_commonness(spark, sf_dir).withColumn("commonness", rounded("commonness", 6))


@query()
def document_ngram_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = corpus.link(document_tokens(spark, sf_dir), _document_commonness(spark, sf_dir))
    return linked.groupBy("ngram").agg(rounded(F.first("commonness"), 6).alias("commonness"), F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH c AS (
  SELECT conv_id, turn, generate_subscripts(parts, 1) AS i, trim(unnest(parts)) AS chunk FROM (
    SELECT conv_id, turn, regexp_split_to_array(
      regexp_replace(regexp_replace(trim(lower(coalesce(text, ''))), ' {2,}', ' ', 'g'), '[.,!?:;]+( |$)', '\1', 'g'),
      '#?[0-9]+ ?(?:januari|februari|maart|april|mei|juni|juli|augustus|september|oktober|november|december)') AS parts FROM conversations))
SELECT conv_id, turn, chunk FROM c WHERE chunk <> '' AND NOT contains(chunk, '@') AND NOT contains(chunk, 'http')"""
)
def chunk_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of turns; SQL says the same where no turn has '@' or 'http', as it leaves such chunks out."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.clean_chunks(F.col("text"))).alias("chunk"))


@query(
    r"""SELECT page_id, array_to_string([CASE WHEN starts_with(w, 'http') THEN 'URL' ELSE w END
  FOR w IN regexp_split_to_array(coalesce(html, ''), '[ \t\r\n]+') IF w <> ''], ' ') AS text FROM pages"""
)
def url_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.mask_urls(F.col("html")).alias("text"))


@query(
    r"""SELECT doc_id, round(len(list_distinct(w)) / len(w), 6) AS ratio FROM (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[ \t\r\n]+') IF x <> ''] AS w FROM documents)
WHERE len(w) > 0 AND len(list_distinct(w)) / len(w) > 0.30"""
)
def type_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.type_token_ratio(F.col("text")).alias("ratio"))
    return rows.where("ratio > 0.30").select("doc_id", rounded("ratio", 6).alias("ratio"))


@query(f"SELECT term, array_to_string(list_sort(list(DISTINCT id)), ',') AS postings FROM ({_TERMS}) GROUP BY term")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus.inverted_index(document_tokens(spark, sf_dir))
    return index.select("term", F.array_join(F.transform("postings", lambda x: x.cast("string")), ",").alias("postings"))


@query("SELECT event_id AS id, unnest(['#' || event_type, '#k' || json_extract_string(props, '$.k')]) AS tag FROM events")
def hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags in texts that are written from events, as the tables have hardly any."""
    text = F.format_string("User %s: #%s (#K%s) # end", F.col("user_id").cast("string"), "event_type", F.col("k").cast("string"))
    return keyed_events(spark, sf_dir).select("id", F.explode(T.hashtags(T.tokens(text))).alias("tag"))


@query(
    r"""SELECT item_id, regexp_replace(translate(lower(text), '()"', ''), '([,.:])', ' \1', 'g') AS plain, translate(lower(trim(text)), '.,:)("', '') AS anchor FROM benchmark"""
)
def wiki_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.wiki_text(F.col("text")).alias("plain"), T.wiki_anchor(F.col("text")).alias("anchor"))


_TFIDF = f"""
WITH x AS ({_TERMS}),
tf AS (SELECT id, term, count(*) AS tf FROM x GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
r AS (SELECT id, term, tf, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0) AS raw FROM tf JOIN df USING (term)),
w AS (SELECT id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM r)
"""


@query(_TFIDF + "SELECT id, term, tf, round(weight, 6) AS weight FROM w")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tfidf(document_tokens(spark, sf_dir)).withColumn("weight", rounded("weight", 6))


@query(
    _TFIDF
    + """SELECT id, term, weight, rank::INTEGER AS rank FROM (
  SELECT id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY id ORDER BY round(weight, 6) DESC, term) AS rank FROM w) WHERE rank <= 4"""
)
def tfidf_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.top_terms(corpus.tfidf(document_tokens(spark, sf_dir)), 4).select("id", "term", "weight", "rank")


@query(
    """WITH x AS (SELECT user_id::VARCHAR || '-' || event_type AS a, json_extract_string(props, '$.k') AS k FROM events),
c AS (SELECT a, k, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT a, sum(n) AS m, max(n) AS top, count(*) AS kinds FROM c GROUP BY a)
SELECT a AS id, min(k) AS place, round(top / m, 6) AS share FROM (
  SELECT s.a, max(c.k) AS k, any_value(top) AS top, any_value(m) AS m FROM s JOIN c ON s.a = c.a AND c.n = s.top GROUP BY s.a)
WHERE top / m > 0.2 GROUP BY a, top, m"""
)
def place_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent property of each user and type, where it has over a fifth."""
    from cyclora.operators.events import place_vote as vote

    e = keyed_events(spark, sf_dir).select(F.concat_ws("-", "user_id", "event_type").alias("id"), F.col("k").cast("string").alias("place"))
    return vote(e, 0.2).withColumn("share", rounded("share", 6))
