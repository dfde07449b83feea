"""Mixing sources to target weights by Poisson replication.

Each source has a rate: the mean number of times one of its documents is to
appear, so that the sources' expected shares of the output are the target
weights. A document's own count is the inverse of the Poisson distribution
with that mean at a number in [0, 1) hashed from seed and doc_id. Documents
are repeated by their counts and dealt out in an order hashed from seed,
doc_id and copy. Rows whose doc_id is null or repeated have the row's place in
its file beside it, so that each of them has a number of its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ROW, checkpoint, numbered, settled, table

#: A larger mean is reached as the sum of independent counts with means of at most this.
MEAN = 16
#: Counts looked up for one such mean; its distribution has less than 1e-14 beyond.
MOST = 80


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None, alpha: float, rows_out: int | None) -> DataFrame:
    """source, n_docs and rate: the mean number of copies of each of its documents."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        counts = counts.withColumn("__w", F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha))))
    else:
        pairs = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "__s string, __w double")
        counts = counts.join(F.broadcast(pairs), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        counts = counts.fillna(0.0, ["__w"])
    totals = counts.agg(F.sum("__w").alias("__all"), F.sum("n_docs").alias("__n"))
    wanted = F.col("__n") if rows_out is None else F.lit(rows_out)
    return counts.crossJoin(F.broadcast(totals)).select(
        "source", "n_docs", F.coalesce(F.try_divide(F.col("__w") * wanted, F.col("__all") * F.col("n_docs")), F.lit(0.0)).alias("rate")
    )


def _cdf(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ..., for the mean of one part."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST)),
        start,
        lambda s, k: F.struct(
            (s["p"] * rate / k).alias("p"),
            (s["c"] + s["p"] * rate / k).alias("c"),
            F.array_append(s["all"], s["c"] + s["p"] * rate / k).alias("all"),
        ),
        lambda s: s["all"],
    )


def _identified(docs: DataFrame) -> DataFrame:
    """Add what tells a row apart: its doc_id, and also its place where that is null or repeated."""
    rows = numbered(settled(docs))
    repeated = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    repeated = checkpoint(repeated)
    name = F.col("doc_id").cast("string")
    placed = F.concat_ws(" ", F.coalesce(name, F.lit("null")), F.col(f"{ROW}.file").cast("string"), F.col(f"{ROW}.at").cast("string"))
    if repeated.isEmpty():
        return rows.withColumn(ROW, F.coalesce(name, placed))
    # hashes of the ids that are repeated mark rows; two ids that share a hash are no harm
    hashes = repeated.select(F.xxhash64("doc_id").alias("__h"), "__n").groupBy("__h").agg(F.sum("__n").alias("__n"))
    rows = rows.withColumn("__h", F.coalesce(F.xxhash64("doc_id"), F.lit(0)))
    told = hashes.agg(F.count(F.lit(1)).alias("keys")).first()["keys"]
    if told <= BROADCAST_ROWS:
        marked = rows.join(F.broadcast(hashes.select("__h", F.lit(True).alias("__again"))), "__h", "left")
    else:  # many: each id's mark is given to 64 salts, so that a hot one is split
        salts = hashes.select("__h", F.lit(True).alias("__again"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("__salt"))
        marked = rows.withColumn("__salt", F.pmod(F.hash(ROW), F.lit(64))).join(salts, ["__h", "__salt"], "left").drop("__salt")
    return marked.withColumn(ROW, F.when(F.col("__again"), placed).otherwise(F.coalesce(name, placed))).drop("__h", "__again")


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    *,
    alpha: float = 0.5,
    rows_out: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Repeat the rows of ``docs`` (doc_id, source, ...) so that sources have their target weights, in a hashed order.

    ``weights`` are shares by source (any positive scale; a source without one
    goes; null may be a key). Without ``weights`` the shares are the sources'
    counts to the power ``alpha``. ``rows_out`` is the expected number of rows
    (default: as many as come in). All columns are kept; rate, n_copies, copy
    (from 0) and shuffle_key (the order within and between partitions is a
    hashed one) are added and replace columns of those names.

    Rows with a null source form a source. A row's count hangs on seed and
    doc_id alone where that is the row's own; rows with a null or repeated
    doc_id, even if they are equal, have counts independent of each other.
    Texts, of any length, are not looked at; an empty table gives an empty
    table.
    """
    names = [c for c in docs.columns if c not in ("rate", "n_copies", "copy", "shuffle_key")]
    docs = _identified(docs.select(*[F.col(f"`{c}`") for c in names]))
    known = checkpoint(rates(docs, weights, alpha, rows_out))
    parts = F.greatest(F.ceil(F.col("rate") / MEAN), F.lit(1)).cast("int")
    known = known.select("source", "rate", parts.alias("__m")).withColumn("__cdf", _cdf(F.col("rate") / F.col("__m")))
    doc, left = F.col(ROW), docs
    if known.count() <= BROADCAST_ROWS:
        joined = left.join(F.broadcast(known.withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s")))
    else:  # many sources: a shuffle, with each source's row given to 64 salts so that a hot one is split
        salted = known.withColumnRenamed("source", "__s").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = left.withColumn("__x", F.pmod(F.hash(doc), F.lit(64))).join(
            salted, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__x") == F.col("__salt"))
        )
    draws = F.transform(F.sequence(F.lit(0), F.col("__m") - 1), lambda j: _unit(F.lit(seed), doc, j))
    one = lambda u: F.size(F.filter(F.col("__cdf"), lambda c: c <= u))
    n = F.aggregate(draws, F.lit(0), lambda total, u: total + one(u))
    out = joined.withColumn("n_copies", n).where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order {seed}"), doc, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return (
        out.select(*[F.col(f"`{c}`") for c in names], "rate", "n_copies", "copy", key.alias("shuffle_key"))
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated so that a source's share is the square root of its size, as many rows as before."""
    return mix(table(spark, sf_dir, "documents"), alpha=0.5, seed=20240601).withColumn("rate", F.round("rate", 9))


OP1_SQL = r"""
WITH n AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(n_docs::DOUBLE) * (SELECT sum(n_docs) FROM n) / ((SELECT sum(sqrt(n_docs::DOUBLE)) FROM n) * n_docs) AS rate
  FROM n
),
parts AS (SELECT source, rate, greatest(ceil(rate / 16), 1)::BIGINT AS m FROM rates),
cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, k, exp(-rate / m + k * ln(rate / m) - lgamma(k + 1)) AS p FROM parts, range(0, 81) AS r(k))
),
draws AS (
  SELECT d.doc_id, d.source, p.rate, j,
         ('0x' || substr(md5('20240601:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT / pow(2, 52) AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(0, p.m) AS r(j)
),
counts AS (
  SELECT doc_id, rate, sum(n) AS n_copies
  FROM (SELECT w.doc_id, w.rate, w.j, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM w.source AND c <= w.u) AS n FROM draws w)
  GROUP BY doc_id, rate
)
SELECT d.*, round(c.rate, 9) AS rate, c.n_copies::INTEGER AS n_copies, copy::INTEGER AS copy,
       ('0x' || substr(md5('order 20240601:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM documents d JOIN counts c USING (doc_id), range(0, c.n_copies::BIGINT) AS r(copy)
"""
