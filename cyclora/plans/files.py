"""Exports: tables written to files of each layout in the shared folder and read back; SQL says what should come.

Texts come from the test tables with their white space made single spaces,
since a line holds one row. Lists come back joined by ``;``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.plans.registry import query
from cyclora.plans.standins import table
from cyclora.sources import readers as R
from cyclora.sources import writers as W
from cyclora.sources.shared import shared_folder


def _folder(spark: SparkSession, name: str = "export") -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


def _flat(text: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x20]+", " "))


#: The same in SQL.
_FLAT = r"trim(regexp_replace(coalesce(text, ''), '[\x00-\x20]+', ' ', 'g'))"


def _tabbed(*cells: Column | str) -> Column:
    return F.concat_ws("\t", *[F.lit(c) if isinstance(c, str) else c.cast("string") for c in cells])


def _lines(rows: DataFrame, line: Column, path: str) -> str:
    """Write lines of text; returns the path."""
    rows.select(line.alias("value")).write.text(path)
    return path


def _named(spark: SparkSession, folder: str, names: dict[str, str]) -> None:
    """Give the one file of each folder under ``folder`` its name, as exports have it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for own, name in names.items():
        for file in store.globStatus(path(f"{folder}/{own}/part-*")):
            store.rename(file.getPath(), path(f"{folder}/{name}"))


def _told(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ";").alias(column)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as posts: id, user, date, text; every fifth is a repetition of another's."""
    text = F.concat(F.when(F.col("turn") % 5 == 1, F.lit("RT ")).otherwise(F.lit("")), _flat("text"))
    number = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    day = F.date_add(F.lit("2014-01-01").cast("date"), (F.col("conv_id") % 300).cast("int"))
    return table(spark, sf_dir, "conversations").select(number.alias("id"), F.col("role").alias("user"), day.alias("date"), text.alias("text"))


_TURNS = f"""SELECT conv_id || '-' || turn AS id, role AS "user", DATE '2014-01-01' + (conv_id % 300)::INTEGER AS date,
CASE WHEN turn % 5 = 1 THEN 'RT ' ELSE '' END || {_FLAT} AS text FROM conversations"""


def _raw(spark: SparkSession, sf_dir: str) -> str:
    rows = _turns(spark, sf_dir)
    head = spark.createDataFrame([("-\tid\tdate\t-\t-\t-\tuser\ttext",)], "value string")
    line = _tabbed("-", F.col("id"), F.col("date"), "-", "-", "-", F.col("user"), F.col("text"))
    return _lines(head.unionByName(rows.select(line.alias("value"))), F.col("value"), _folder(spark))


@query(_TURNS)
def file_raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.raw_texts(spark, _raw(spark, sf_dir))


@query(f"SELECT * FROM ({_TURNS}) WHERE NOT regexp_matches(text, '(^|[^A-Za-z0-9_])RT($|[^A-Za-z0-9_])')")
def file_raw_texts_without_retweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.raw_texts(spark, _raw(spark, sf_dir), retweets=False)


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with all columns of the model layout: words of a turn stand for entities, chunks and tags."""
    words = F.transform(F.split("text", " "), lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    words = F.filter(words, lambda w: w != "")
    pairs = F.transform(F.slice(words, 1, 3), lambda w: F.struct(w.alias("word"), F.length(w).cast("string").alias("tag")))
    return _turns(spark, sf_dir).withColumn("words", words).select(
        "id",
        "user",
        "date",
        "text",
        F.array(F.date_add("date", 2), F.date_add("date", 5)).alias("refdates"),
        F.slice("words", 1, 2).alias("chunks"),
        F.slice("words", 3, 2).alias("entities"),
        pairs.alias("postags"),
        F.lit("over twee dagen").alias("phrase"),
        F.when(F.size("words") > 8, F.array(F.lower(F.get("words", F.lit(0))))).otherwise(F.array().cast("array<string>")).alias("cities"),
    )


_POSTS = f"""WITH t AS ({_TURNS}),
w AS (SELECT *, [y FOR y IN [regexp_replace(x, '[^A-Za-z]', '', 'g') FOR x IN string_split(text, ' ')] IF y <> ''] AS words FROM t)
SELECT id, "user", date, text, (date + 2)::DATE || ';' || (date + 5)::DATE AS refdates, array_to_string(words[1:2], ';') AS chunks,
array_to_string(words[3:4], ';') AS entities, array_to_string([x || ',' || strlen(x) FOR x IN words[1:3]], ';') AS postags,
'over twee dagen' AS phrase, CASE WHEN len(words) > 8 THEN lower(words[1]) ELSE '' END AS cities FROM w"""


def _flat_posts(rows: DataFrame) -> DataFrame:
    tags = F.transform("postags", lambda t: F.concat_ws(",", t["word"], t["tag"]))
    return rows.withColumn("postags", tags).withColumns({c: _told(c) for c in ("refdates", "chunks", "entities", "postags", "cities")})


@query(_POSTS)
def file_model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten columns of posts, written and read."""
    path = _folder(spark)
    W.model_texts(_posts(spark, sf_dir), path)
    return _flat_posts(R.model_texts(spark, path))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS u, o_orderdate::DATE AS d, lower(o_orderpriority) AS t FROM orders)
SELECT k::VARCHAR AS id, 'u' || u AS "user", d AS date, t AS text, (d + 3)::DATE::VARCHAR AS refdates, 'c' || u || ';x' AS chunks,
CASE WHEN k % 4 = 0 THEN '' ELSE 'e;f g' END AS entities, 'morgen' AS phrase FROM o WHERE k % 4 <> 3"""
)
def file_model_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the three layouts, and wide ones that a date in column 13 rules out."""
    orders = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    k, day, later = F.col("o_orderkey"), F.col("d"), F.date_add("d", 3)
    user, text = F.concat(F.lit("u"), F.col("o_custkey")), F.lower("o_orderpriority")
    chunks = F.concat(F.lit("c"), F.col("o_custkey"), F.lit("|x"))
    wide = lambda phrase: _tabbed("0", k, "2", "3", user, "5", "6", day, "8", "9", text, later, chunks, phrase)
    dated = _tabbed(k, user, day, text, later, chunks, "e | f g", "de,LID", "morgen", "--")
    phrased = _tabbed(k, user, day, text, "morgen", later, chunks, "e | f g", "de,LID")
    line = F.when(k % 4 == 0, wide("morgen")).when(k % 4 == 1, dated).when(k % 4 == 2, phrased).otherwise(wide("12/5"))
    rows = R.model_texts(spark, _lines(orders, line, _folder(spark)))
    return rows.select("id", "user", "date", "text", *map(_told, ("refdates", "chunks", "entities")), "phrase")


@query(f"""WITH p AS ({_POSTS}) SELECT id, "user", date, text, refdates, chunks, phrase, 2 AS n FROM p""")
def file_date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with references, appended twice."""
    path = _folder(spark)
    for _ in range(2):
        W.date_texts(_posts(spark, sf_dir), path)
    lines = spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("c", F.split("value", "\t", -1))
    at = lambda i: F.get("c", F.lit(i))
    return lines.select(
        at(0).alias("id"), at(1).alias("user"), F.to_date(at(2)).alias("date"), at(3).alias("text"),
        F.replace(at(4), F.lit(" "), F.lit(";")).alias("refdates"), F.replace(at(5), F.lit("|"), F.lit(";")).alias("chunks"), at(6).alias("phrase"), "n",
    )


@query(f"""WITH p AS ({_POSTS}) SELECT date, count(*) AS n, min(id) AS first FROM p GROUP BY date""")
def file_posts_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts in a folder for each date."""
    path = _folder(spark)
    W.posts_by_day(_posts(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of orders: terms from segment and priority, lines as texts."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"),
        (k % 97 / 4).alias("score"),
        F.array(F.lower("o_orderpriority"), F.concat(F.lit("t "), F.col("o_custkey"))).alias("terms"),
        F.array(k.cast("string"), (k + 1).cast("string")).alias("text_ids"),
        F.array(F.col("o_orderpriority"), F.concat(F.lit("x\t"), k)).alias("texts"),
        F.when(k % 3 == 0, F.array(F.lit("l"), k.cast("string"))).otherwise(F.array().cast("array<string>")).alias("lemmas"),
        F.when(k % 5 == 0, 0.3).otherwise(0.5).alias("ratio"),
    )


_EVENTS = """SELECT o_orderdate::DATE AS date, (o_orderkey % 97) / 4 AS score, lower(o_orderpriority) || ';t ' || o_custkey AS terms,
o_orderkey || ';' || (o_orderkey + 1) AS text_ids, o_orderpriority || ';x ' || o_orderkey AS texts"""


@query(_EVENTS + " FROM orders")
def file_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    W.event_lines(_events(spark, sf_dir), path)
    return R.event_lines(spark, path).select("date", "score", *map(_told, ("terms", "text_ids", "texts")))


@query(_EVENTS + ", CASE WHEN o_orderkey % 3 = 0 THEN 'l;' || o_orderkey ELSE '' END AS lemmas FROM orders, range(0, 2)")
def file_lemma_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines with lemmas, appended twice."""
    path = _folder(spark)
    for _ in range(2):
        W.lemma_lines(_events(spark, sf_dir), path)
    return R.event_lines(spark, path).select("date", "score", *map(_told, ("terms", "text_ids", "texts", "lemmas")))


@query("SELECT lower(o_orderpriority) AS term, (o_orderkey % 97) / 4 AS score FROM orders")
def file_term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    W.term_scores(_events(spark, sf_dir), path)
    return spark.read.schema("term string, score double").option("sep", "\t").csv(path)


@query(
    """SELECT block, count(*) AS n FROM (SELECT o_orderdate::DATE || chr(9) || (o_orderkey % 97) / 4 || chr(9) || lower(o_orderpriority) || ', t ' || o_custkey
|| chr(10) || o_orderpriority || chr(10) || 'x' || chr(9) || o_orderkey AS block FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY block"""
)
def file_event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of events whose words vary enough, parted by empty lines."""
    path = _folder(spark)
    W.event_blocks(_events(spark, sf_dir), path)
    blocks = spark.read.text(path, lineSep="\n\n").select(F.regexp_replace("value", r"^\n|\n$", "").alias("block"))
    return blocks.where("block <> ''").groupBy("block").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH w AS (SELECT lower(n_name) AS a, n_regionkey AS r, n_nationkey AS k FROM nation)
SELECT a AS ngram, r::BIGINT AS n_anchor, (k + 4)::BIGINT AS n_total, r / (k + 4) AS commonness FROM w
UNION ALL SELECT a || ' ' || r, r, k + 4, r / (k + 4) FROM w"""
)
def file_ngram_commonness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link probabilities in a folder for each length of n-gram."""
    path = _folder(spark)
    nations = table(spark, sf_dir, "nation")
    one, r, k = F.lower("n_name"), F.col("n_regionkey"), F.col("n_nationkey")
    grams = F.explode(F.array(F.struct(one.alias("g"), F.lit(1).alias("n")), F.struct(F.concat_ws(" ", one, r.cast("string")).alias("g"), F.lit(2).alias("n"))))
    rows = nations.select(grams.alias("x"), r.alias("n_anchor"), (k + 4).alias("n_total"), (r / (k + 4)).alias("commonness"))
    W.ngrams(rows.select(F.col("x.g").alias("ngram"), "n_anchor", "n_total", "commonness", F.col("x.n").alias("n")), path)
    return R.ngram_commonness(spark, [f"{path}/n=1", f"{path}/n=2"]).select("ngram", "n_anchor", "n_total", "commonness")


@query("SELECT text, CASE WHEN item_id % 3 = 0 THEN '' ELSE string_split(text, ' ')[1] || ';' || item_id END AS anchors FROM benchmark")
def file_wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JSON lines; a third of them has no anchors."""
    path = _folder(spark)
    anchors = F.array(*[F.struct(a.alias("surface_form"), F.lit("http://x").alias("uri")) for a in (F.split("text", " ")[0], F.col("item_id").cast("string"))])
    table(spark, sf_dir, "benchmark").select("text", F.when(F.col("item_id") % 3 != 0, anchors).alias("annotations")).write.json(path)
    return R.wiki_pages(spark, path).select("text", _told("anchors"))


@query("SELECT DISTINCT lower(x) AS name FROM (SELECT n_name || 'é' AS x FROM nation UNION ALL SELECT c_mktsegment FROM customer)")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in an encoding of one byte a character, with repetitions, blanks and empty lines."""
    path = _folder(spark)
    names = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("é ")).alias("x"))
    names = names.unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("x"))).unionByName(spark.createDataFrame([("",)], "x string"))
    names.write.option("encoding", "ISO-8859-1").option("emptyValue", "").option("ignoreTrailingWhiteSpace", False).csv(path)
    return R.names(spark, path, "iso-8859-1")


@query(
    f"""SELECT DATE '2014-03-10' AS written, item_id::VARCHAR AS id,
CASE WHEN item_id % 2 = 0 THEN '<TIMEX3 type="DATE" value="2014-03-12">' || left({_FLAT}, 9) || '</TIMEX3>' ELSE {_FLAT} END AS text FROM benchmark WHERE item_id % 5 <> 4"""
)
def file_tagged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of tagged posts: what stands before the head, after the end, or in one column is left out."""
    folder = _folder(spark, "tagged")
    text, k = _flat("text"), F.col("item_id")
    tagged = F.concat(F.lit('<TIMEX3 type="DATE" value="2014-03-12">'), F.left(text, F.lit(9)), F.lit("</TIMEX3>"))
    number = F.when(k % 3 == 0, F.concat(F.lit('<TIMEX3 tid="t1">'), k, F.lit("</TIMEX3>"))).otherwise(k.cast("string"))
    line = F.when(k % 5 == 4, text).otherwise(_tabbed(number, F.when(k % 2 == 0, tagged).otherwise(text)))
    body = table(spark, sf_dir, "benchmark").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))  # a file is one row
    whole = F.concat(F.lit("-1\ttoo early\n#tweet_id\ttext\n"), F.col("body"), F.lit("\n</TimeML>\n-2\ttoo late"))
    _lines(body.coalesce(1), whole, f"{folder}/day")
    _named(spark, folder, {"day": "tagged_20140310.txt"})
    return R.tagged_posts(spark, f"{folder}/tagged_20140310.txt")


_JUDGED = """SELECT lower(o_orderpriority) || ';' || o_custkey AS terms, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS correct,
CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 64) / 8 END AS score FROM orders"""


@query(_JUDGED)
def file_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged events in a report with a header; scores that are no numbers come back as null."""
    path, k = _folder(spark), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.lit("-").alias("note"),
        F.when(k % 3 == 0, "1.0").otherwise("0.0").alias("judgement"),
        F.concat_ws(", ", F.lower("o_orderpriority"), F.col("o_custkey").cast("string")).alias("words"),
        F.when(k % 7 == 0, "none").otherwise((k % 64 / 8).cast("string")).alias("value"),
    )
    W.report(rows, path)
    got = R.assessments(spark, path, {"assessment": 1, "terms": 2, "score": 3})
    return got.select(_told("terms"), "correct", "score")


def _periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of customers: their first order and the two years after it."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("d"), F.count(F.lit(1)).cast("int").alias("n"))
    days = F.array("d", F.add_months("d", 12), F.add_months("d", 24))
    return first.select(
        F.concat(F.lit("t "), F.col("o_custkey")).alias("term"),
        F.concat(F.lit("<e,"), F.month("d"), F.lit(",v,"), F.dayofmonth("d"), F.lit(",v,v>")).alias("pattern"),
        (F.col("n") / 4).alias("score"), F.lit(0.5).alias("coverage"), F.lit(1.0).alias("consistency"), F.lit(1).alias("step"),
        days.alias("dates"), F.array(F.lit(365), F.col("n")).alias("intervals"),
    )


_PERIODIC = """WITH f AS (SELECT o_custkey, min(o_orderdate)::DATE AS d, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT {} AS pattern, n / 4 AS score, 't ' || o_custkey AS terms, d || ';' || (d + INTERVAL 12 MONTH)::DATE || ';' || (d + INTERVAL 24 MONTH)::DATE AS dates FROM f"""


@query(_PERIODIC.format("'<e,' || month(d) || ',v,' || day(d) || ',v,v>'"))
def file_periodic_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    W.periodics(_periodic(spark, sf_dir), path)
    return R.periodic_report(spark, path).select("pattern", "score", _told("terms"), _told("dates"))


@query(_PERIODIC.format("NULL::VARCHAR"))
def file_periodic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    W.periodics(_periodic(spark, sf_dir), path, calendar=False)
    return R.periodic_report(spark, path).select("pattern", "score", _told("terms"), _told("dates"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _periodic(spark, sf_dir)
    return rows.select(F.array(F.lit("z"), F.col("term")).alias("terms"), "pattern", F.col("dates")[0].alias("first"), F.col("dates")[2].alias("date"), "step", "score", "coverage", "consistency")


_PREDICTED = """WITH f AS (SELECT o_custkey, min(o_orderdate)::DATE AS d, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT 't ' || o_custkey || ';z' AS terms, '<e,' || month(d) || ',v,' || day(d) || ',v,v>' AS pattern, (d + INTERVAL 24 MONTH)::DATE AS date,
n / 4 AS score, 0.5::DOUBLE AS coverage, 1::DOUBLE AS consistency FROM f"""


@query(_PREDICTED)
def file_prediction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    W.prediction_lines(_predicted(spark, sf_dir), path)
    return R.predictions(spark, path).withColumn("terms", _told("terms"))


@query(_PREDICTED)
def file_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as a table."""
    path = _folder(spark)
    W.predictions(_predicted(spark, sf_dir), path)
    rows = spark.read.parquet(path).withColumn("terms", F.array_sort("terms"))
    return rows.select(_told("terms"), "pattern", "date", "score", "coverage", "consistency")


@query(
    """WITH v AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 = 5 THEN '' ELSE (n_nationkey % 6)::VARCHAR END AS v FROM nation),
s AS (SELECT v, row_number() OVER (ORDER BY k) AS i, count(*) OVER () AS n FROM v WHERE v <> '4')
SELECT (i - 3)::INTEGER AS pos, v AS vote FROM s WHERE i > 2 AND i < n"""
)
def file_survey_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third line of an export; what isn't an answer, the first two and the last are left out."""
    k = F.col("n_nationkey")
    cell = F.struct(k.alias("k"), F.when(k % 6 == 5, "").otherwise((k % 6).cast("string")).alias("v"))
    rows = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(cell)).alias("x"))  # the line of one survey
    line = F.concat(F.lit("h\nh\n" + "m," * 10), F.array_join(F.transform("x", lambda c: c["v"]), ","))
    # the eleventh column is the first that counts; the tenth is a remark
    return R.survey_export(spark, _lines(rows.coalesce(1), line, _folder(spark)))


@query("SELECT (row_number() OVER (ORDER BY r_regionkey))::INTEGER AS pos, r_name || ';' || r_regionkey AS parts FROM region")
def file_survey_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bold parts of each question of a survey's page."""
    part = F.concat(F.lit("[[Question:MC:SingleAnswer]]\n<b>"), F.col("r_name"), F.lit("</b><br /><B>"), F.col("r_regionkey"), F.lit("</B>\n"))
    page = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", part.alias("p")))).alias("x"))  # one page
    text = F.concat(F.lit("intro\n"), F.array_join(F.transform("x", lambda c: c["p"]), ""))
    return R.survey_questions(spark, _lines(page.coalesce(1), text, _folder(spark))).withColumn("parts", _told("parts"))


@query("SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE lower(o_orderpriority) || ';c' || o_custkey END AS entities FROM orders")
def file_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of texts; hashtags and the sign for none are left out."""
    k = F.col("o_orderkey")
    told = F.concat_ws(", ", F.lower("o_orderpriority"), F.lit("#tag"), F.concat(F.lit("c"), F.col("o_custkey")))
    line = _tabbed(k, "text", F.when(k % 4 == 0, "x").otherwise(told))
    return R.entity_file(spark, _lines(table(spark, sf_dir, "orders"), line, _folder(spark)), 0, 2, ",", "x").select("id", _told("entities"))


@query("SELECT o_orderkey::VARCHAR AS id, lower(o_orderstatus) || ' dag' AS phrase FROM orders WHERE o_orderkey % 5 <> 0")
def file_time_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged phrases of texts; lines without one are left out."""
    k = F.col("o_orderkey")
    line = F.when(k % 5 == 0, k.cast("string")).otherwise(_tabbed(k, F.concat(F.lower("o_orderstatus"), F.lit(" dag,2014-03-11"))))
    return R.time_tags(spark, _lines(table(spark, sf_dir, "orders"), line, _folder(spark)))


@query("SELECT x AS chunk, count(*) AS n FROM (SELECT unnest([lower(c_mktsegment), 'k ' || c_nationkey]) AS x FROM customer WHERE c_custkey % 3 <> 0) GROUP BY x")
def file_wide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of wide lines, written one a line and read again; short lines have none."""
    k, path = F.col("c_custkey"), _folder(spark)
    line = F.when(k % 3 == 0, _tabbed(k, "short")).otherwise(_tabbed(*["x"] * 12, F.concat_ws("|", F.lower("c_mktsegment"), F.concat(F.lit("k "), F.col("c_nationkey")))))
    W.chunks(R.wide_chunks(spark, _lines(table(spark, sf_dir, "customer"), line, _folder(spark))), path)
    return spark.read.text(path).groupBy(F.col("value").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 't ' || o_custkey AS term, array_to_string(list(k ORDER BY k), ';') AS intervals FROM (SELECT o_custkey, o_orderkey % 100 AS k FROM orders)
GROUP BY o_custkey HAVING count(*) >= 2"""
)
def file_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of at least two intervals."""
    gaps = F.array_join(F.transform(F.array_sort(F.collect_list(F.col("o_orderkey") % 100)), lambda x: x.cast("string")), ", ")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(gaps.alias("gaps"))
    line = _tabbed(F.concat(F.lit("t "), F.col("o_custkey")), "-", F.col("gaps"))
    return R.interval_file(spark, _lines(rows, line, _folder(spark))).select("term", _told("intervals"))


@query(
    """WITH e AS (SELECT event_id AS k, user_id AS u, ts::DATE AS d, event_type AS t FROM events)
SELECT d::VARCHAR || '-' AS day, k::VARCHAR AS id, 'u' || u AS "user", d AS date, t AS text, (d + 3)::DATE::VARCHAR AS refdates FROM e"""
)
def file_day_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts in one file for each day, whose name tells the day."""
    folder = _folder(spark, "days")
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    line = _tabbed(F.col("event_id"), F.concat(F.lit("u"), F.col("user_id")), F.col("d"), F.col("event_type"), F.date_add("d", 3))
    e.select(F.col("d").cast("string").alias("d"), line.alias("value")).repartition("d").write.partitionBy("d").text(folder)
    days = [r["d"] for r in e.select(F.col("d").cast("string").alias("d")).distinct().collect()]  # one for each day
    _named(spark, folder, {f"d={d}": f"{d}-00.txt" for d in days})
    return R.day_posts(spark, f"{folder}/*.txt", hourly=True).select("day", "id", "user", "date", "text", _told("refdates"))


@query(
    """SELECT string_agg(id || '|' || d || '|' || e, chr(9) ORDER BY d, id) AS line
FROM (SELECT o_custkey AS g, o_orderkey AS id, o_orderdate::DATE AS d, lower(o_orderpriority) || ', ' || o_orderstatus AS e FROM orders) GROUP BY g"""
)
def file_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each customer with all orders."""
    path = _folder(spark)
    members = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), F.array(F.lower("o_orderpriority"), F.col("o_orderstatus")).alias("entities")
    )
    W.clusters(members, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    """SELECT term, string_agg(d || ',' || id, '|' ORDER BY d, id) AS postings
FROM (SELECT DISTINCT 't' || o_custkey AS term, o_orderdate::DATE AS d, o_orderkey AS id FROM orders) GROUP BY term"""
)
def file_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("t"), F.col("o_custkey")).alias("term"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("id"))
    W.inverted_index(rows.groupBy("term").agg(F.array_sort(F.collect_set(F.struct("date", "id"))).alias("postings")), path)
    return spark.read.schema("term string, postings string").option("sep", "\t").csv(path)


@query(
    f"""WITH w AS (SELECT unnest([x FOR x IN string_split({_FLAT}, ' ') IF x <> '']) AS w FROM benchmark)
SELECT w || CASE WHEN left(w, 1) BETWEEN 'A' AND 'Z' THEN ' B-ORG' ELSE ' O' END AS line, count(*) AS n FROM w GROUP BY ALL
UNION ALL SELECT '', count(*) FROM benchmark"""
)
def file_token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token and its label a line: words with a capital are labelled."""
    path = _folder(spark)
    tokens = F.filter(F.split(_flat("text"), " "), lambda w: w != "")
    label = F.transform("tokens", lambda w: F.when(F.left(w, F.lit(1)).between("A", "Z"), "B-ORG").otherwise("O"))
    W.token_labels(table(spark, sf_dir, "benchmark").select(tokens.alias("tokens")).withColumn("labels", label), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey % 6 AS \"set\", o_orderkey AS item, o_orderpriority AS text FROM orders")
def file_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a folder for each annotator."""
    path = _folder(spark)
    W.allocation(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") % 6).alias("set")), path)
    return spark.read.schema("item long, text string, set long").csv(path).select("set", "item", "text")


@query("SELECT n_name AS name, n_regionkey AS region FROM nation")
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a header."""
    path = _folder(spark)
    W.report(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), path)
    return spark.read.option("header", True).option("sep", "\t").schema("name string, region int").csv(path)
