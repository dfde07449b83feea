"""Streams of posts: counts in sliding windows, windows of days that are present, running state of terms, merging of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cyclora.operators import ranking


def sliding_counts(stream: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """window start and end, entity, n of a stream (ts, entity) in sliding windows; rows later than ``late`` are dropped.

    Windows are of calendar days: without missing days they are those of
    ``day_windows``.
    """
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "entity").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "entity", "n")


def day_windows(stream: DataFrame, store: str, emit: Callable[[DataFrame, int], None], days: int = 7, least: int = 6) -> StreamingQuery:
    """Keep the posts (date, entity, text) of the last ``days`` distinct dates in ``store`` and hand them over after each batch.

    ``emit`` gets the posts of the window and the batch's number, once there
    are ``least`` dates. Each batch writes its own snapshot from that of the
    batch before, so that a batch that is run again gives the same; older
    snapshots may be removed.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("date", "entity", "text")
        if number:
            rows = spark.read.parquet(f"{store}/batch={number - 1}").unionByName(rows)
        window = ranking.recent_days(rows, days)
        window.write.mode("overwrite").parquet(f"{store}/batch={number}")
        kept = spark.read.parquet(f"{store}/batch={number}")
        if kept.select("date").distinct().count() >= least:
            emit(kept, number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start()


def rank_window(window: DataFrame, support: int = 5, top: int = 2500) -> DataFrame:
    """Events of a window of posts."""
    return ranking.rank_events(window, window.agg(F.count(F.lit(1)).alias("n_total")), support, top)


STATE = "last date, n long, n_ones long"
OUT = "term string, date date, interval int, n long, n_ones long"


def running_intervals(stream: DataFrame) -> DataFrame:
    """term, date, interval, n (intervals so far), n_ones (those of one day) for each new date of a term (term, date).

    Dates of one batch are taken in order. A date that is not after the
    term's last one is late and dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        last, n, ones = state.get if state.exists else (None, 0, 0)
        rows = []
        for day in sorted({d for batch in batches for d in batch["date"]}):
            if last is not None and day <= last:
                continue
            gap = (day - last).days if last is not None else None
            if gap is not None:
                n += 1
                ones += gap == 1
                rows.append((key[0], day, gap, n, ones))
            last = day
        state.update((last, n, ones))
        yield pd.DataFrame(rows, columns=["term", "date", "interval", "n", "n_ones"])

    keyed = stream.select(F.col("term").cast("string").alias("term"), "date")
    return keyed.groupBy("term").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")


def merged_stream(stream: DataFrame, store: str, share: float = 0.10) -> StreamingQuery:
    """Merge each batch's events (event_id, date, score, terms, text_ids) into those so far; the state is ``store``/batch=N."""
    from cyclora.operators.events import merge_windows

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        current = spark.read.parquet(f"{store}/batch={number - 1}") if number else batch.limit(0)
        merge_windows(current, batch, share).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start()
