"""Readers of delimited exports, as typed tables. Malformed lines are left out, delimited lists become arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.functions import text as T


def _columns(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines split at tabs (c). A header has no date or number where rows have one, so it goes with the malformed lines."""
    return spark.read.text(path).select(F.split("value", "\t", -1).alias("c"))


def _at(k: int) -> Column:
    return F.get("c", F.lit(k))


def _list(column: Column, separator: str, none: str | None = None) -> Column:
    """An array from a delimited string; empty for null, empty and the sign for none."""
    parts = F.filter(F.transform(F.split(column, separator, -1), lambda x: F.trim(x)), lambda x: (x != "") & (x != (none or "")))
    return F.coalesce(parts, F.array().cast("array<string>"))


def _dates(column: Column, separator: str) -> Column:
    return F.filter(F.transform(_list(column, separator), lambda x: F.try_to_date(x, "yyyy-MM-dd")), lambda d: d.isNotNull())


def raw_texts(spark: SparkSession, path: str, retweets: bool = True) -> DataFrame:
    """id, date, user, text of raw posts (columns 1, 2, 6 and the last); without retweets if asked. Rows without a date go."""
    rows = _columns(spark, path).where(F.size("c") > 6).select(
        _at(1).alias("id"), F.try_to_date(_at(2), "yyyy-MM-dd").alias("date"), _at(6).alias("user"), F.element_at("c", -1).alias("text")
    )
    rows = rows.where("date is not null")
    return rows if retweets else rows.where(~T.is_retweet(F.col("text")))


def model_texts(spark: SparkSession, path: str) -> DataFrame:
    """Posts with references, in any of three layouts that the number of columns and the place of a date tell apart.

    Wide lines (over 12 columns) have no entities yet. A wide line whose
    column 13 holds a date is left out.
    """
    return _posts(_columns(spark, path))


def _posts(rows: DataFrame) -> DataFrame:
    """The columns of posts, after those that ``rows`` has beside the split line."""
    kept = [x for x in rows.columns if x != "c"]
    wide, dated = F.size("c") > 12, F.coalesce(_at(4), F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}")
    pick = lambda w, d, p: F.when(wide, _at(w) if w is not None else None).when(dated, _at(d)).otherwise(_at(p) if p is not None else None)
    rows = rows.where(~(wide & F.coalesce(_at(13), F.lit("")).rlike(r"\d[/-]\d")))
    tags = F.transform(_list(pick(None, 7, 8), r" \| "), lambda x: F.struct(F.substring_index(x, ",", 1).alias("word"), F.substring_index(x, ",", -1).alias("tag")))
    out = rows.select(
        *kept,
        pick(1, 0, 0).alias("id"),
        pick(4, 1, 1).alias("user"),
        F.try_to_date(F.substring(pick(7, 2, 2), 1, 10), "yyyy-MM-dd").alias("date"),
        pick(10, 3, 3).alias("text"),
        _dates(pick(11, 4, 5), " ").alias("refdates"),
        _list(pick(12, 5, 6), r"\|").alias("chunks"),
        _list(pick(None, 6, 7), r" \| ", "--").alias("entities"),
        tags.alias("postags"),
        pick(13, 8, 4).alias("phrase"),
        _list(_at(9), ", ", "--").alias("cities"),
    )
    return out.where("id is not null and date is not null")


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """date, score, terms, text_ids, texts and, where there is a sixth column, lemmas. The score is a number."""
    return (
        _columns(spark, path)
        .where(F.size("c") >= 5)
        .select(
            F.try_to_date(_at(0), "yyyy-MM-dd").alias("date"),
            F.expr("try_cast(get(c, 1) as double)").alias("score"),
            _list(_at(2), ", ").alias("terms"),
            _list(_at(3), ", ").alias("text_ids"),
            F.split(_at(4), "-----", -1).alias("texts"),
            _list(_at(5), ", ").alias("lemmas"),
        )
        .where("date is not null")
    )


def ngram_commonness(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """ngram, n_anchor, n_total, commonness from files of one length of n-gram each."""
    return spark.read.schema("ngram string, n_anchor long, n_total long, commonness double").option("sep", "\t").option("quote", "").csv(paths)


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """text and anchors from JSON lines."""
    rows = spark.read.schema("text string, annotations array<struct<surface_form:string>>").json(path)
    return rows.select("text", F.coalesce(F.transform("annotations", lambda a: a["surface_form"]), F.array().cast("array<string>")).alias("anchors"))


def names(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Distinct lower-case names, one a line."""
    value = F.decode(F.col("value").cast("binary"), encoding)  # lines come as the bytes they are
    return spark.read.text(path).select(F.lower(F.trim(value)).alias("name")).where("name <> ''").distinct()


def tagged_posts(spark: SparkSession, path: str) -> DataFrame:
    """written, id and text of the posts in files of tagged text.

    The day of writing is that of the file's or its folder's name,
    tagged_YYYYMMDD. Posts stand after the line that starts with #tweet_id and
    before </TimeML>, id and text parted by a tab; lines of one column go, and
    a tag around an id is cut off. A file is one row, so it must fit in memory.
    """
    files = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n", -1).alias("lines"), F.col("_metadata.file_path").alias("file"))
    head = F.array_position(F.transform("lines", lambda x: x.startswith("#tweet_id")), F.lit(True))
    below = files.where(head > 0).select("file", F.slice("lines", head.cast("int") + 1, F.size("lines")).alias("lines"))
    end = F.array_position(F.transform("lines", lambda x: x.startswith("</TimeML>")), F.lit(True)).cast("int")
    lines = below.select("file", F.explode(F.when(end > 0, F.slice("lines", 1, end - 1)).otherwise(F.col("lines"))).alias("line"))
    rows = lines.select("file", F.split(F.trim("line"), "\t", -1).alias("c")).where(F.size("c") > 1)
    number = F.when(_at(0).contains("TIMEX3"), F.regexp_extract(_at(0), ">([^<>]*)", 1)).otherwise(_at(0))
    written = F.try_to_date(F.regexp_extract("file", r"tagged_(\d{8})", 1), "yyyyMMdd")
    return rows.select(written.alias("written"), number.alias("id"), _at(1).alias("text"))


def assessments(spark: SparkSession, path: str, columns: dict[str, int]) -> DataFrame:
    """Columns of a headered table by number; ``correct`` is 1 where ``assessment`` is 1.0."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    out = rows.select(*[F.col(f"`{rows.columns[k]}`").alias(name) for name, k in columns.items()])
    if "score" in columns:
        out = out.withColumn("score", F.expr("try_cast(score as double)"))
    if "terms" in columns:
        out = out.withColumn("terms", _list(F.col("terms"), ", "))
    return out.withColumn("correct", (F.trim("assessment") == "1.0").cast("int")) if "assessment" in columns else out


def periodic_report(spark: SparkSession, path: str) -> DataFrame:
    """pattern, terms, dates of calendar lines, and score, terms, dates of interval lines; others are skipped."""
    rows = _columns(spark, path).where(F.size("c") >= 3)
    calendar = _at(0).startswith("<")
    rows = rows.where(calendar | _at(0).rlike(r"^\d+\.\d+"))
    return rows.select(
        F.when(calendar, _at(0)).alias("pattern"),
        F.expr("case when startswith(get(c, 0), '<') then try_cast(split(get(c, 2), ',')[0] as double) else try_cast(get(c, 0) as double) end").alias("score"),
        _list(_at(1), ", ").alias("terms"),
        _dates(F.when(calendar, _at(3)).otherwise(_at(2)), " > ").alias("dates"),
    )


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """terms (sorted), pattern, date, score, and coverage and consistency of calendar lines, from exports of predictions.

    The third column is a printed list: the sixth to eighth items are the
    day that is predicted, the twelfth to fourteenth the three numbers.
    """
    rows = _columns(spark, path).where(F.size("c") >= 3).select("c", F.split(F.regexp_replace(_at(2), r"^\[|\]$", ""), ", ", -1).alias("f"))
    item = lambda k: F.get("f", F.lit(k))
    number = lambda k: F.regexp_replace(item(k), "[()]", "").try_cast("double")
    day = F.concat_ws("-", F.right(item(5), F.lit(4)), *[F.lpad(F.regexp_extract(item(k), r"\d+", 0), 2, "0") for k in (6, 7)])
    return rows.select(
        F.array_sort(_list(_at(0), ", ")).alias("terms"),
        _at(1).alias("pattern"),
        F.try_to_date(day, "yyyy-MM-dd").alias("date"),
        number(11).alias("score"),
        number(12).alias("coverage"),
        number(13).alias("consistency"),
    ).where("date is not null")


def survey_export(spark: SparkSession, path: str) -> DataFrame:
    """Answers (pos, vote) of a survey's third line: columns from the tenth on that are empty or 0 to 3, without the first two and the last."""
    lines = spark.read.text(path, wholetext=True).select(F.get(F.split("value", "\r?\n", -1), F.lit(2)).alias("line"))
    cells = F.split("line", ",", -1)
    kept = F.filter(F.slice(cells, 11, F.greatest(F.size(cells), F.lit(0))), lambda v: v.isin("", "0", "1", "2", "3"))
    return lines.select(F.posexplode(F.slice(kept, 3, F.greatest(F.size(kept) - 3, F.lit(0)))).alias("pos", "vote"))


def survey_questions(spark: SparkSession, path: str) -> DataFrame:
    """pos and the bold parts of each multiple-choice question of a survey's text."""
    from cyclora.functions.markup import bold

    pages = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\[\[Question:MC[^\]]*\]\]", -1)).alias("pos", "part"))
    return pages.where("pos > 0").select("pos", bold(F.col("part")).alias("parts"))


def entity_file(spark: SparkSession, path: str, id_column: int, entity_column: int, separator: str, none: str) -> DataFrame:
    """id and entities of a gold or system file; hashtags and the sign for none are left out."""
    rows = _columns(spark, path)
    return rows.select(_at(id_column).alias("id"), F.filter(_list(_at(entity_column), separator, none), lambda e: ~e.startswith("#")).alias("entities")).where("id is not null")


def time_tags(spark: SparkSession, path: str) -> DataFrame:
    """id and phrase of a list of time tags."""
    return _columns(spark, path).where(F.size("c") >= 2).select(_at(0).alias("id"), F.substring_index(_at(1), ",", 1).alias("phrase"))


def wide_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk: the parts of column 12 of lines that have it."""
    return _columns(spark, path).where(F.size("c") > 12).select(F.explode(_list(_at(12), r"\|")).alias("chunk"))


def interval_file(spark: SparkSession, path: str) -> DataFrame:
    """term and intervals (at least two) of column 2."""
    rows = _columns(spark, path).select(_at(0).alias("term"), F.transform(_list(_at(2), ","), lambda x: x.try_cast("int")).alias("intervals"))
    return rows.where(F.size("intervals") >= 2)


def _day(file: Column, hourly: bool) -> Column:
    """The day in a file's name: all but the last 4 characters, or the last 6 if there is a file an hour."""
    return F.substring(file, F.lit(1), F.length(file) - (6 if hourly else 4))


def day_files(spark: SparkSession, path: str, hourly: bool = False) -> DataFrame:
    """Lines (value) with the day that their file's name gives."""
    rows = spark.read.text(path)
    return rows.select(_day(rows.metadataColumn("_metadata")["file_name"], hourly).alias("day"), "value")


def day_posts(spark: SparkSession, path: str, hourly: bool = False) -> DataFrame:
    """Posts with references, as ``model_texts`` reads them, and the day that their file's name gives."""
    return _posts(day_files(spark, path, hourly).select("day", F.split("value", "\t", -1).alias("c")))
