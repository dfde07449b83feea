"""Contiguous shards of nearly equal bytes, from global prefix sums of sizes.

Rows are range-partitioned, each partition's total is taken, the totals of the
partitions before it (one row per partition) are added to its own running sum,
and the global sum is cut at equal targets. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.operators.order import running_sums

from .common import ROW, table

#: Bytes that a row counts beside its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, n_shards: int) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into one of ``n_shards`` contiguous shards of nearly equal bytes.

    A row counts the UTF-8 bytes of its text plus 16; a null text has none and
    CRC 0. Rows are in the order of the first 60 bits of the text's MD5, then
    doc_id, then input order: equal texts stand together, and only a group that meets a cut
    is in more than one shard. A row goes where its middle byte falls, so a
    shard is off its target by at most the largest row at each end; a row
    larger than the target leaves neighbouring shards short or empty. Null doc_ids
    come first within a text, repeated rows are placed one by one, an empty
    table gives no rows, and further columns are ignored.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (from 0
    within the shard), grown_shard (null: it belongs to another law).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias(ROW),  # used within one job, whose result is kept
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("__text"),
        F.lit(1).cast("long").alias("__one"),
    )
    placed = running_sums(rows, ["__text", "doc_id", ROW], {"__bytes": "size", "__rank": "__one"})
    total = placed.agg(F.sum("size").alias("__total"))
    middle = (2 * F.col("__bytes") + F.col("size")).cast("decimal(38,0)") * n_shards
    sharded = placed.crossJoin(F.broadcast(total)).withColumn(
        "shard",
        F.least(F.floor(middle / (2 * F.col("__total")).cast("decimal(20,0)")), F.lit(n_shards - 1)).cast("int"),
    )
    firsts = sharded.groupBy("shard").agg(F.min("__rank").alias("__first"))
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__rank") - F.col("__first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 40)


#: DuckDB has no CRC: it is computed from half bytes, the lower one of each byte first.
OP7_SQL = r"""
WITH tab AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(range(0, 4), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(0, 16) AS r(n))),
b AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents),
v AS (SELECT *, list_transform(string_split(hex(encode(text)), ''), lambda x: strpos('0123456789ABCDEF', x) - 1) AS v FROM b),
r AS (
  SELECT doc_id, n + 16 AS size, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h,
         xor(coalesce(list_reduce(list_transform(range(1, 2 * n + 1), lambda i: v[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]),
           lambda c, x: xor(tab.t[(xor(c, x) & 15) + 1], c >> 4), 4294967295), 4294967295), 4294967295) AS text_crc32
  FROM v, tab),
p AS (
  SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total
  FROM r WINDOW w AS (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least((2 * before + size) * 40 // (2 * total), 39)::INTEGER AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM s
"""
