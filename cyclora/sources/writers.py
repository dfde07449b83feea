"""Writers: tables as Parquet, and the delimited exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(column: str, separator: str, none: str = "") -> Column:
    return F.when(F.size(column) > 0, F.array_join(F.transform(column, lambda x: x.cast("string")), separator)).otherwise(F.lit(none))


def _lines(rows: DataFrame, columns: list[Column], path: str, mode: str) -> None:
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    clean = [F.regexp_replace(t, "[\t\r\n]+", " ") for t in texts]
    rows.select(F.concat_ws("\t", *clean)).write.mode(mode).text(path)


def posts_by_day(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with a folder for each date."""
    rows.repartition("date").write.mode(mode).partitionBy("date").parquet(path)


def date_texts(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Posts with references: id, user, date, text, dates, chunks, phrase."""
    _lines(rows, [F.col("id"), F.col("user"), F.col("date"), F.col("text"), _joined("refdates", " "), _joined("chunks", "|"), F.col("phrase")], path, mode)


def model_texts(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Posts with references and entities, in ten columns."""
    tags = F.transform("postags", lambda t: F.concat_ws(",", t["word"], t["tag"]))
    rows = rows.withColumn("__tags", tags)
    columns = [F.col("id"), F.col("user"), F.col("date"), F.col("text"), _joined("refdates", " "), _joined("chunks", "|"), _joined("entities", " | ", "--")]
    _lines(rows, [*columns, _joined("__tags", " | ", "--,--"), F.col("phrase"), _joined("cities", ", ", "--")], path, mode)


def term_scores(events: DataFrame, path: str) -> None:
    """First term and score of each event."""
    _lines(events, [F.get("terms", F.lit(0)), F.col("score")], path, "overwrite")


def event_blocks(events: DataFrame, path: str, least_ratio: float = 0.30) -> None:
    """A block of text for each event above a type-token ratio, best first: an empty line, date, score and terms, then the texts."""
    rows = events.where(F.col("ratio") > least_ratio).orderBy(F.desc("score"), "date")
    head = F.concat_ws("\t", F.col("date").cast("string"), F.col("score").cast("string"), _joined("terms", ", "))
    rows.select(F.concat_ws("\n", F.concat(F.lit("\n"), head), F.array_join("texts", "\n"))).write.mode("overwrite").text(path)


def event_lines(events: DataFrame, path: str) -> None:
    """date, score, terms, ids, texts of each event, best first."""
    rows = events.orderBy(F.desc("score"), "date")
    _lines(rows, [F.col("date"), F.col("score"), _joined("terms", ", "), _joined("text_ids", ", "), _joined("texts", "-----")], path, "overwrite")


def lemma_lines(events: DataFrame, path: str) -> None:
    """Event lines with a sixth column of lemmas, appended."""
    columns = [F.col("date"), F.col("score"), _joined("terms", ", "), _joined("text_ids", ", "), _joined("texts", "-----"), _joined("lemmas", ", ")]
    _lines(events, columns, path, "append")


def periodics(found: DataFrame, path: str, calendar: bool = True) -> None:
    """Report of periodic terms: calendar patterns by falling score, or intervals by rising deviation."""
    if calendar:
        numbers = F.concat_ws(",", *[F.col(c).cast("string") for c in ("score", "coverage", "consistency", "step")], F.size("dates").cast("string"))
        _lines(found.orderBy(F.desc("score"), "pattern"), [F.col("pattern"), F.col("term"), numbers, _joined("dates", " > ")], path, "overwrite")
    else:
        _lines(found.orderBy("score", "term"), [F.col("score"), F.col("term"), _joined("dates", " > "), _joined("intervals", "-")], path, "overwrite")


def predictions(rows: DataFrame, path: str) -> None:
    """Predictions as a table."""
    rows.write.mode("overwrite").parquet(path)


def prediction_lines(rows: DataFrame, path: str) -> None:
    """Predictions (terms, pattern, first, date, step, score, coverage, consistency) as terms, pattern and a printed list."""
    day = lambda c: F.concat_ws(", ", F.concat(F.lit("datetime.datetime("), F.year(c)), F.month(c), F.dayofmonth(c), F.lit("0"), F.lit("0)"))
    numbers = [F.col(c).cast("string") for c in ("step", "score", "coverage", "consistency")]
    told = F.concat(F.lit("["), F.concat_ws(", ", day("first"), day("date"), *numbers), F.lit("]"))
    _lines(rows, [_joined("terms", ", "), F.col("pattern"), told], path, "overwrite")


def clusters(members: DataFrame, path: str) -> None:
    """One line for each group of (grp, id, date, entities): id|date|entities, joined by tabs."""
    item = F.concat_ws("|", F.col("id").cast("string"), F.col("date").cast("string"), F.array_join("entities", ", "))
    rows = members.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("date", "id", item.alias("item")))).alias("x"))
    rows.select(F.array_join(F.transform("x", lambda i: i["item"]), "\t")).write.mode("overwrite").text(path)


def inverted_index(index: DataFrame, path: str) -> None:
    """term and postings date,id joined by bars, by term."""
    told = F.transform("postings", lambda p: F.concat_ws(",", p["date"].cast("string"), p["id"].cast("string")))
    _lines(index.orderBy("term"), [F.col("term"), F.array_join(told, "|")], path, "overwrite")


def ngrams(counts: DataFrame, path: str) -> None:
    """Link probabilities with a folder for each length of n-gram."""
    counts.write.mode("overwrite").partitionBy("n").option("sep", "\t").option("quote", "").csv(path)


def chunks(rows: DataFrame, path: str) -> None:
    """One chunk a line."""
    rows.select("chunk").write.mode("overwrite").text(path)


def token_labels(rows: DataFrame, path: str) -> None:
    """Token and label a line, an empty line after each text (tokens, labels)."""
    pairs = F.transform(F.arrays_zip("tokens", "labels"), lambda x: F.concat_ws(" ", x["tokens"], x["labels"]))
    rows.select(F.concat(F.array_join(pairs, "\n"), F.lit("\n"))).write.mode("overwrite").text(path)


def allocation(rows: DataFrame, path: str) -> None:
    """Items of annotators, a folder for each set."""
    rows.write.mode("overwrite").partitionBy("set").csv(path)


def report(rows: DataFrame, path: str) -> None:
    """A table with a header, tab-separated."""
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
