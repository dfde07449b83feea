"""Streams against what the same rows give at rest."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cyclora.operators import events, ranking
from cyclora.streaming import windows as W

DAY = dt.date(2024, 1, 1)


def files(spark, tmp_path, batches, schema):
    """A stream that takes one file a batch, in order."""
    import os

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name in os.listdir(tmp_path / "in"):
            if name.endswith(".parquet") and not name.startswith("b"):
                os.rename(tmp_path / "in" / name, tmp_path / "in" / f"b{k}.parquet")
                os.utime(tmp_path / "in" / f"b{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_windows_of_days_follow_the_stream(spark, tmp_path):
    days = [0, 1, 2, 4, 5, 9, 10, 11, 15]
    batches = [[(DAY + dt.timedelta(days=d), f"e{k % 2}", f"t{d}-{k}") for k in range(3)] for d in days]
    schema = "date date, entity string, text string"
    seen = {}
    query = W.day_windows(files(spark, tmp_path, batches, schema), str(tmp_path / "store"), lambda rows, n: seen.__setitem__(n, (sorted({r["date"] for r in rows.collect()}), W.rank_window(rows, 1).count())), days=4, least=3)
    query.awaitTermination()
    assert min(seen) == 2
    for n, (dates, ranked) in seen.items():
        assert dates == [DAY + dt.timedelta(days=d) for d in days[: n + 1][-4:]]
        rows = spark.createDataFrame([r for b in batches[: n + 1] for r in b], schema)
        assert ranked == W.rank_window(ranking.recent_days(rows, 4), 1).count()


def test_running_intervals_keep_state_and_drop_late_rows(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(f"t{rng.randrange(4)}", DAY + dt.timedelta(days=10 * k + rng.randrange(9))) for _ in range(8)] for k in range(3)]
    batches.append([("t0", DAY - dt.timedelta(days=5))])
    out = W.running_intervals(files(spark, tmp_path, batches, "term string, date date"))
    query = out.writeStream.format("memory").queryName("running").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["term"], r["date"]): (r["interval"], r["n"], r["n_ones"]) for r in spark.table("running").collect()}
    want = {}
    for t in {t for b in batches for t, _ in b}:
        dates = sorted({d for b in batches[:3] for x, d in b if x == t})
        ones = 0
        for k, (a, b) in enumerate(zip(dates, dates[1:])):
            ones += (b - a).days == 1
            want[t, b] = ((b - a).days, k + 1, ones)
    assert got == want


def test_sliding_counts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + k, 12), f"e{k % 2}") for k in range(12)]
    stream = files(spark, tmp_path, [rows[:6], rows[6:]], "ts timestamp, entity string")
    counted = W.sliding_counts(stream, "3 days", "1 day", "1 day")
    query = counted.writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["start"], r["entity"]): r["n"] for r in spark.table("counted").collect()}
    at_rest = spark.createDataFrame(rows, "ts timestamp, entity string").groupBy(F.window("ts", "3 days", "1 day").alias("w"), "entity").count()
    want = {(r["w"]["start"], r["entity"]): r["count"] for r in at_rest.collect() if r["w"]["end"] <= rows[-1][0] - dt.timedelta(days=1)}
    assert got == want and got


def test_merged_stream(spark, tmp_path):
    schema = "event_id long, date date, score double, terms array<string>, text_ids array<long>"
    batches = [[(1, DAY, 1.0, ["a"], [1, 2])], [(2, DAY, 3.0, ["b"], [2, 3]), (3, DAY, 1.0, ["c"], [9])], [(4, DAY, 2.0, ["d"], [3])]]
    W.merged_stream(files(spark, tmp_path, batches, schema), str(tmp_path / "store")).awaitTermination()
    last = {r["event_id"]: (r["score"], list(r["text_ids"])) for r in spark.read.parquet(str(tmp_path / "store" / "batch=2")).collect()}
    at = spark.createDataFrame(batches[0], schema)
    for b in batches[1:]:
        at = events.merge_windows(at, spark.createDataFrame(b, schema))
    assert last == {r["event_id"]: (r["score"], list(r["text_ids"])) for r in at.collect()}
    assert last == {1: (3.0, [3, 2, 1]), 3: (1.0, [9])}
