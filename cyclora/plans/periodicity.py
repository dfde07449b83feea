"""Queries over the dates of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.functions import dates as D
from cyclora.functions.numbers import rounded
from cyclora.operators import periodic as P
from cyclora.plans.registry import query
from cyclora.plans.standins import dense_terms, sparse_terms, table
from cyclora.sources.shared import spread

_SPARSE = "WITH t AS (SELECT DISTINCT o_custkey AS term, o_orderdate::DATE AS date FROM orders)"
_DENSE = "WITH t AS (SELECT DISTINCT l_suppkey AS term, l_shipdate::DATE AS date FROM lineitem)"
_GAPS = """, g AS (SELECT * FROM (SELECT term, date, row_number() OVER w - 1 AS pos, date - lag(date) OVER w AS interval FROM t
  WINDOW w AS (PARTITION BY term ORDER BY date)) WHERE interval IS NOT NULL)"""


@query(_SPARSE + _GAPS + " SELECT term, date, pos::INTEGER AS pos, interval::INTEGER AS interval FROM g")
def term_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.intervals(P.term_dates(sparse_terms(spark, sf_dir)))


@query(_DENSE + _GAPS + " SELECT term, date, interval::INTEGER AS interval FROM g WHERE interval >= 2")
def intervals_ge2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.intervals(P.term_dates(dense_terms(spark, sf_dir))).where("interval >= 2").select("term", "date", "interval")


_DEVIATION = ", s AS (SELECT term, count(*) AS n, 100 * stddev_pop(interval) / avg(interval) AS score FROM g GROUP BY term HAVING count(*) >= 2 AND min(interval) > 5)"


@query(_SPARSE + _GAPS + _DEVIATION + " SELECT term, n, round(score, 6) AS score FROM s")
def relative_stdev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.relative_deviation(P.intervals(P.term_dates(sparse_terms(spark, sf_dir)))).withColumn("score", rounded("score", 6))


@query(_DENSE + _GAPS + " SELECT term, count(*) AS n, count(*) FILTER (interval = 1) AS n_ones FROM g GROUP BY term HAVING NOT (count(*) > 15 AND count(*) FILTER (interval = 1) > 0.3 * count(*))")
def noise_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.calm(P.intervals(P.term_dates(dense_terms(spark, sf_dir))))


_MODE = """, c AS (SELECT term, interval AS step, count(*) AS n, min(pos) AS first FROM g GROUP BY ALL),
m AS (SELECT term, step, n FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, first) AS k FROM c) WHERE k = 1)"""


@query(_SPARSE + _GAPS + _MODE + " SELECT term, step::INTEGER AS step, n FROM m")
def mode_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.modal_step(P.intervals(P.term_dates(sparse_terms(spark, sf_dir))))


@query(
    _SPARSE
    + _GAPS
    + """, a AS (SELECT g.term, g.pos AS start, h.pos - g.pos + 1 AS n FROM g JOIN g h ON g.term = h.term AND h.pos > g.pos),
n AS (SELECT term, count(*) AS total FROM g GROUP BY term)
SELECT a.term, a.start::INTEGER AS start, a.n::INTEGER AS n,
       round(100 * sqrt(greatest(sum(interval::DOUBLE * interval) / a.n - pow(sum(interval) / a.n, 2), 0)) / (sum(interval) / a.n) + 100 - a.n / any_value(total) * 100, 5) AS score
FROM a JOIN g ON g.term = a.term AND g.pos BETWEEN a.start AND a.start + a.n - 1 JOIN n ON n.term = a.term GROUP BY a.term, a.start, a.n"""
)
def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.segments(P.intervals(P.term_dates(sparse_terms(spark, sf_dir)))).withColumn("score", rounded("score", 5))


_FEATURES = """SELECT DISTINCT term, date, year(date) AS year, month(date) AS month, weekofyear(date) AS week, day(date) AS day,
  isodow(date) - 1 AS weekday, (day(date) - 1) // 7 + 1 AS nth FROM t"""


@query(_SPARSE + f" SELECT term, date, year::INTEGER AS year, month::INTEGER AS month, week::INTEGER AS week, day::INTEGER AS day, weekday::INTEGER AS weekday, nth::INTEGER AS nth FROM ({_FEATURES})")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.term_dates(sparse_terms(spark, sf_dir)).withColumns(D.features(F.col("date")))


@query(_DENSE + f" SELECT month::INTEGER AS month, weekday::INTEGER AS weekday, nth::INTEGER AS nth, count(*) AS n FROM ({_FEATURES}) GROUP BY ALL")
def nth_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.term_dates(dense_terms(spark, sf_dir)).withColumns(D.features(F.col("date")))
    return got.groupBy("month", "weekday", "nth").agg(F.count(F.lit(1)).alias("n"))


def _shown(found: DataFrame) -> DataFrame:
    dates = F.array_join(F.transform("dates", lambda d: d.cast("string")), " > ")
    return found.select("term", P.pattern_text().alias("pattern"), F.size("dates").alias("n"), dates.alias("dates"))


def _yearly_sql(pattern: str, slots: str) -> str:
    return f"""{_DENSE}, f AS ({_FEATURES})
SELECT term, {pattern} AS pattern, count(*)::INTEGER AS n, string_agg(date::VARCHAR, ' > ' ORDER BY date) AS dates FROM f GROUP BY term, {slots} HAVING count(*) > 2"""


@query(_yearly_sql("'<e,' || month || ',v,' || day || ',v,v>'", "month, day"))
def yearly_date_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(P.yearly(P.term_dates(dense_terms(spark, sf_dir)), "date"))


@query(_yearly_sql("'<e,v,' || week || ',v,' || weekday || ',v>'", "week, weekday"))
def yearly_week_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(P.yearly(P.term_dates(dense_terms(spark, sf_dir)), "week"))


@query(_yearly_sql("'<e,' || month || ',v,v,' || weekday || ',' || nth || '>'", "month, weekday, nth"))
def yearly_nth_weekday_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(P.yearly(P.term_dates(dense_terms(spark, sf_dir)), "nth weekday"))


def _sequence_sql(terms: str, pattern: str, slots: str) -> str:
    return f"""{terms}, f AS ({_FEATURES}),
l AS (SELECT term, {pattern} AS pattern, list(date ORDER BY date) AS x FROM f GROUP BY term, {slots} HAVING count(*) > 2),
r AS (SELECT term, pattern, x, s, e FROM l, range(1, len(x) + 1) AS a(s), range(1, len(x) + 1) AS b(e) WHERE e - s >= 2)
SELECT term, pattern, (e - s + 1)::INTEGER AS n, array_to_string([d::VARCHAR FOR d IN x[s:e]], ' > ') AS dates FROM r"""


@query(_sequence_sql(_SPARSE, "'<v,e,v,' || day || ',v,v>'", "day"))
def monthly_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(P.sequences(P.term_dates(sparse_terms(spark, sf_dir)), "date"))


@query(_sequence_sql(_SPARSE, "'<v,e,v,v,' || weekday || ',' || nth || '>'", "weekday, nth"))
def monthly_nth_weekday_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(P.sequences(P.term_dates(sparse_terms(spark, sf_dir)), "nth weekday"))


@query(_sequence_sql(_DENSE, "'<v,v,e,v,' || weekday || ',v>'", "weekday, year"))
def weekly_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(P.sequences(P.term_dates(dense_terms(spark, sf_dir)), "week"))


def _totals(dates: DataFrame) -> DataFrame:
    return dates.groupBy("term").agg(F.count(F.lit(1)).alias("n_dates"))


_SCORED = """
SELECT term, pattern, n::INTEGER AS n, step::INTEGER AS step, n_gaps::INTEGER AS n_gaps, round(n / total, 6) AS coverage,
       round(CASE WHEN step BETWEEN 1 AND 6 THEN n / (n + n_gaps) ELSE 0 END, 6) AS consistency
FROM ({inner})"""


@query(
    _DENSE
    + f""", f AS ({_FEATURES}),
l AS (SELECT term, '<e,' || month || ',v,' || day || ',v,v>' AS pattern, list(year ORDER BY date) AS y, count(*) AS n FROM f GROUP BY term, month, day HAVING count(*) > 2),
i AS (SELECT term, pattern, n, [y[k + 1] - y[k] FOR k IN range(1, len(y))] AS d FROM l),
s AS (SELECT *, list_min(d) AS step FROM i),
c AS (SELECT *, CASE WHEN step BETWEEN 1 AND 6 THEN coalesce(list_sum([ceil(x / step) FOR x IN d IF x <> step]), 0) ELSE 0 END AS n_gaps FROM s)"""
    + _SCORED.format(inner="SELECT c.*, (SELECT count(*) FROM t WHERE t.term = c.term) AS total FROM c")
)
def calendar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of yearly dates, where the number of gaps has a closed form."""
    dates = P.term_dates(dense_terms(spark, sf_dir))
    got = P.score(P.yearly(dates, "date"), _totals(dates))
    return got.select(
        "term", "pattern", F.size("dates").alias("n"), "step", F.size("gaps").alias("n_gaps"), rounded("coverage", 6).alias("coverage"), rounded("consistency", 6).alias("consistency")
    )


_MONTHLY = (
    _SPARSE
    + f""", f AS ({_FEATURES}),
l AS (SELECT term, day, '<v,e,v,' || day || ',v,v>' AS pattern, list(date ORDER BY date) AS x FROM f GROUP BY term, day HAVING count(*) > 2),
r AS (SELECT term, day, pattern, x[s:e] AS x FROM l, range(1, len(x) + 1) AS a(s), range(1, len(x) + 1) AS b(e) WHERE e - s >= 2),
i AS (SELECT *, len(x) AS n, [round_even((x[k + 1] - x[k]) / 30.42, 0) FOR k IN range(1, len(x))] AS d FROM r),
s AS (SELECT *, list_min(d) AS step FROM i),
u AS (SELECT *, CASE WHEN step BETWEEN 1 AND 6 THEN [
    list_filter(range(1, (ceil(((year(x[k + 1]) - year(x[k])) * 12 + month(x[k + 1]) - month(x[k])) / step) + 1)::BIGINT),
      lambda j: day <= day(last_day((date_trunc('month', x[k]) + to_months((j * step)::INTEGER))::DATE)))
    FOR k IN range(1, len(x)) IF d[k] <> step] ELSE [] END AS ok FROM s),
c AS (SELECT *, coalesce(list_sum([len([j FOR j, p IN o IF j = p]) FOR o IN ok]), 0) AS n_gaps FROM u)"""
)


@query(_MONTHLY + _SCORED.format(inner="SELECT c.*, (SELECT count(*) FROM t WHERE t.term = c.term) AS total FROM c").replace("SELECT term, pattern", "SELECT term, pattern, x[1] AS first"))
def monthly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of monthly dates; gaps end at a month that lacks the day."""
    dates = P.term_dates(sparse_terms(spark, sf_dir))
    got = P.score(P.sequences(dates, "date"), _totals(dates))
    return got.select(
        "term", "pattern", F.element_at("dates", 1).alias("first"), F.size("dates").alias("n"), "step", F.size("gaps").alias("n_gaps"),
        rounded("coverage", 6).alias("coverage"), rounded("consistency", 6).alias("consistency"),
    )


#: Candidates are taken one by one, best first, unless they share a date with one that was taken.
_CHOSEN = (
    _MONTHLY.replace("WITH", "WITH RECURSIVE", 1)
    + """, v AS (SELECT c.*, n / total AS coverage, CASE WHEN step BETWEEN 1 AND 6 THEN n / (n + n_gaps) ELSE 0 END AS consistency
  FROM c JOIN (SELECT term, count(*) AS total FROM t GROUP BY term) USING (term)),
o AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY -round((coverage + consistency) / 2, 9), pattern, x[1], -n) AS pos FROM v),
g(term, pos, taken, dates) AS (
  SELECT DISTINCT term, 0::BIGINT, []::BIGINT[], []::DATE[] FROM o
  UNION ALL
  SELECT g.term, o.pos, CASE WHEN list_has_any(g.dates, o.x) THEN g.taken ELSE list_append(g.taken, o.pos) END,
         CASE WHEN list_has_any(g.dates, o.x) THEN g.dates ELSE list_concat(g.dates, o.x) END
  FROM g JOIN o ON o.term = g.term AND o.pos = g.pos + 1),
z AS (SELECT term, arg_max(taken, pos) AS taken FROM g GROUP BY term),
q AS (SELECT o.*, (coverage + consistency) / 2 AS score FROM o JOIN z USING (term) WHERE list_contains(z.taken, o.pos))"""
)


def _monthly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    dates = P.term_dates(sparse_terms(spark, sf_dir))
    return P.select(P.score(P.sequences(dates, "date"), _totals(dates))), dates


@query(
    _CHOSEN
    + """ SELECT term, pattern, x[1] AS first, n::INTEGER AS n, array_to_string([d::VARCHAR FOR d IN x], ' > ') AS dates, step::INTEGER AS step, n_gaps::INTEGER AS n_gaps,
round(score, 6) AS score FROM q"""
)
def monthly_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly patterns of customers' orders that share no date with a better one."""
    chosen, _ = _monthly(spark, sf_dir)
    dates = F.array_join(F.transform("dates", lambda d: d.cast("string")), " > ").alias("dates")
    return chosen.select("term", "pattern", F.element_at("dates", 1).alias("first"), F.size("dates").alias("n"), dates, "step", "n_gaps", rounded("score", 6).alias("score"))


@query(
    _CHOSEN
    + """, e AS (SELECT term, max(date) AS last_date FROM t GROUP BY term),
p AS (SELECT q.term, pattern, last_date, day, step, score, list_filter(range(1, 400), lambda j:
      day <= day(last_day((date_trunc('month', last_date) + to_months((j * step)::INTEGER))::DATE))) AS ok
  FROM q JOIN e USING (term) WHERE score > 0.25 AND step BETWEEN 1 AND 6),
w AS (SELECT * EXCLUDE (ok), unnest([j FOR j, p IN ok IF j = p]) AS j FROM p),
d AS (SELECT *, (date_trunc('month', last_date) + to_months((j * step)::INTEGER))::DATE + (day - 1)::INTEGER AS date FROM w)
SELECT term, pattern, last_date, date, step::INTEGER AS step, round(score, 6) AS score FROM d WHERE date < DATE '2003-12-31'"""
)
def predict_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coming dates of the monthly patterns until the end of 2003; a pattern ends at a month that lacks its day."""
    chosen, dates = _monthly(spark, sf_dir)
    last = dates.groupBy("term").agg(F.max("date").alias("last_date"))
    got = P.predict_calendar(chosen, last, F.lit("2003-12-31").cast("date"), 0.25)
    return got.select("term", "pattern", "last_date", "date", "step", rounded("score", 6).alias("score"))


def _selected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    dates = P.term_dates(sparse_terms(spark, sf_dir))
    return P.select(P.score(P.candidates(dates), _totals(dates))), dates


@query()
def calendar_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of customers' orders, of all kinds; ``monthly_selected`` is the same choice among one kind, with SQL."""
    chosen, _ = _selected(spark, sf_dir)
    return _shown(chosen).join(chosen.select("term", "pattern", F.element_at("dates", 1).alias("first"), rounded("score", 6).alias("score")), ["term", "pattern"])


@query()
def predict_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coming dates of the chosen patterns until the end of 2003."""
    chosen, dates = _selected(spark, sf_dir)
    last = dates.groupBy("term").agg(F.max("date").alias("last_date"))
    return P.predict_calendar(chosen, last, F.lit("2003-12-31").cast("date"), 0.25)


@query(
    _SPARSE
    + _GAPS
    + _DEVIATION
    + _MODE
    + """, e AS (SELECT term, max(date) AS last_date FROM t GROUP BY term),
p AS (SELECT s.term, last_date, step, round(score, 6) AS score, unnest(generate_series(1, (((DATE '2003-12-31' - last_date) - 1) // step)::BIGINT)) AS k
  FROM s JOIN m USING (term) JOIN e USING (term) WHERE score < 80)
SELECT term, last_date, last_date + (k * step)::INTEGER AS date, step::INTEGER AS step, score FROM p"""
)
def predict_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = P.term_dates(sparse_terms(spark, sf_dir))
    gaps = P.intervals(dates)
    last = dates.groupBy("term").agg(F.max("date").alias("last_date"))
    got = P.predict_timeline(P.relative_deviation(gaps), P.modal_step(gaps), last, F.lit("2003-12-31").cast("date"), most=80.0)
    return got.withColumn("score", rounded("score", 6))


# dates in texts


@query(
    """SELECT o_orderkey AS id, o_orderdate::DATE AS posted, o_orderdate::DATE + (n * u)::INTEGER AS refdate
FROM (SELECT *, 1 + o_orderkey % 20 AS n, [1, 7, 30][(1 + o_orderkey % 3)::INTEGER] AS u FROM orders)"""
)
def dutch_relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases written from orders' keys, such as 'nog 3 weken', resolved."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("posted"))
    unit = F.element_at(F.array(F.lit("dagen"), F.lit("weken"), F.lit("maanden")), (F.col("id") % 3 + 1).cast("int"))
    cue = F.element_at(F.array(F.lit("Nog ongeveer"), F.lit("over")), (F.col("id") % 2 + 1).cast("int"))
    text = F.concat_ws(" ", cue, (F.col("id") % 20 + 1).cast("string"), unit, F.lit("is het zover"))
    orders = spread(orders)
    found = D.date_references(text, F.col("posted"))
    return orders.select("id", "posted", F.explode(found["refdates"]).alias("refdate"))


@query(
    """SELECT o_orderkey AS id, (o_orderdate + INTERVAL 15 YEAR)::DATE AS refdate FROM orders
WHERE year(o_orderdate) + 15 BETWEEN 2010 AND 2019"""
)
def dutch_absolute_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written out or in figures from orders' dates, 15 years on, resolved; posted 40 days before."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.add_months(F.to_date("o_orderdate"), 180).alias("d"))
    month = F.element_at(F.array(*map(F.lit, T_MONTHS)), F.month("d"))
    day, m, y = (f("d").cast("string") for f in (F.dayofmonth, F.month, F.year))
    dashed, slashed, iso = F.date_format("d", "dd-MM-yyyy"), F.date_format("d", "dd/MM/yyyy"), F.date_format("d", "yyyy-MM-dd")
    kind = F.col("id") % 4
    text = F.when(kind == 0, F.concat_ws(" ", F.lit("op"), day, month, y)).when(kind == 1, dashed).when(kind == 2, slashed).otherwise(iso)
    rows = spread(orders.where(F.year("d").between(2010, 2019)))
    found = D.date_references(F.concat(F.lit("Feest "), text, F.lit(" hier")), F.date_sub("d", 40))
    return rows.select("id", F.explode(found["refdates"]).alias("refdate"))


T_MONTHS = "januari februari maart april mei juni juli augustus september oktober november december".split()


@query(
    """WITH x AS (SELECT o_orderkey AS id, o_orderdate::DATE AS posted, (1 + o_orderkey % 12)::INTEGER AS m, (1 + o_orderkey % 28)::INTEGER AS d FROM orders),
g AS (SELECT *, abs(make_date(year(posted) - 1, m, d) - posted) AS a, abs(make_date(year(posted), m, d) - posted) AS b, abs(make_date(year(posted) + 1, m, d) - posted) AS c FROM x)
SELECT id, (year(posted) + CASE WHEN b < a AND b < c THEN 0 WHEN c < a THEN 1 ELSE -1 END)::INTEGER AS year FROM g"""
)
def nearest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("posted"))
    return orders.select("id", D.nearest_year(F.col("posted"), F.col("id") % 12 + 1, F.col("id") % 28 + 1).alias("year"))
