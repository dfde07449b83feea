"""Exact deduplication by deterministic naming of blocks.

Normalised texts are cut into blocks of a fixed size. The distinct blocks are
sorted and named by integers; then the names of adjacent pairs of blocks are
themselves named, again and again, until one name is left of each document.
Two documents of equally many blocks have the same last name if and only if
their texts are equal. DataFrame functions only.

Blocks move once, to be named. A block's row finds its name by a digest of 128
bits; the table of names shows whether any two blocks share a digest, and rows
of such blocks find their names by the whole block instead, so that names
never collide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.sources.shared import spread

from .common import ROW, SPACE, checkpoint, looked_up, numbered, settled, table

#: Code points in a block.
BLOCK = 4096


def normalised() -> Column:
    """The text with each run of white space made one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")


def _digest(block: Column) -> tuple[Column, Column]:
    return F.xxhash64(block), F.xxhash64(F.lit(1), block)


def _named(keys: DataFrame) -> DataFrame:
    """Give each distinct row an integer name, in sorted order within each partition, and count its appearances (n)."""
    counts = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n"))
    return checkpoint(counts.sortWithinPartitions(*keys.columns).withColumn("name", F.monotonically_increasing_id()))


def name_texts(
    docs: DataFrame, block: int = BLOCK, digest: Callable[[Column], tuple[Column, Column]] = _digest
) -> DataFrame:
    """One row (row identity, doc_id, sha (binary SHA-256 of the normalised text), n_blocks, name) for each row of ``docs``.

    Two rows have the same ``n_blocks`` and ``name`` if and only if their
    normalised texts are equal, whatever ``digest`` is.
    """
    blocks = (
        spread(numbered(settled(docs)).select(ROW, "doc_id", "text"))
        .select(ROW, "doc_id", normalised().alias("text"))
        .withColumn("n_blocks", F.greatest(F.ceil(F.length("text") / block), F.lit(1)).cast("int"))
        .withColumn("sha", F.unhex(F.sha2("text", 256)))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("block", F.expr(f"substring(text, i * {block} + 1, {block})"))
        .withColumn("sha", F.when(F.col("i") == 0, F.col("sha")))  # once for each document
        .drop("text")
    )
    h1, h2 = digest(F.col("block"))
    blocks = blocks.withColumns({"h1": h1, "h2": h2})  # made twice, for the names and to take them: kept, they would need as much disk as the texts
    hashed = ["h1", "h2"]

    counts = blocks.groupBy(*hashed, "block").agg(F.count(F.lit(1)).alias("n"))
    named = counts.sortWithinPartitions(*hashed, "block").select(*hashed, "n", F.monotonically_increasing_id().alias("name"))
    dictionary = checkpoint(named)  # without the blocks themselves
    ambiguous = checkpoint(dictionary.groupBy(*hashed).count().where("count > 1").select(*hashed))
    clear, state = dictionary, checkpoint(blocks.drop("block"))
    doubtful = not ambiguous.isEmpty()
    if doubtful:
        clear, state = (x.join(ambiguous, hashed, "left_anti") for x in (clear, state))
    state = looked_up(state, clear, hashed, "n")
    if doubtful:
        unclear = blocks.join(ambiguous, hashed, "left_semi")
        by_block = _named(unclear.select("block")).withColumn("name", -1 - F.col("name"))
        state = state.unionByName(looked_up(unclear, by_block, ["block"], "n").drop("block"))
    state = checkpoint(state.select(ROW, "doc_id", "sha", "n_blocks", F.col("n_blocks").alias("width"), "i", "name"))

    widest = state.agg(F.max("width")).first()[0] or 1
    done = [state.where("width = 1")]
    nothing = F.lit(-(2**63)).cast("long")
    while widest > 1:
        even = F.col("i") % 2 == 0
        pairs = checkpoint(
            state.where("width > 1")
            .groupBy(ROW, "n_blocks", "width", F.expr("i div 2").cast("int").alias("half"))
            .agg(
                F.max("doc_id").alias("doc_id"),
                F.max("sha").alias("sha"),
                F.max(F.when(even, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), nothing).alias("right"),
            )
        )
        names = _named(pairs.select("left", "right"))
        state = checkpoint(
            looked_up(pairs, names, ["left", "right"], "n").select(
                ROW, "doc_id", "sha", "n_blocks", F.expr("cast((width + 1) div 2 as int)").alias("width"), F.col("half").alias("i"), "name"
            )
        )
        widest = (widest + 1) // 2
        done.append(state.where("width = 1"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(ROW, "doc_id", "sha", "n_blocks", "name")


def find_copies(docs: DataFrame, block: int = BLOCK, digest: Callable[[Column], tuple[Column, Column]] = _digest) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): row identity, doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and empty texts are copies of each other. Of
    equal texts the row with the smallest doc_id stays (``kept``), and
    ``keep_id`` is its doc_id; null is larger than any doc_id. Where that
    doc_id is repeated, one of its rows stays, the same one each time. A text
    of any length is cut into as many blocks as it takes. An empty table gives
    no rows; further columns are ignored.
    """
    named = name_texts(docs, block, digest)
    key = ["n_blocks", "name"]
    groups = checkpoint(
        named.groupBy(*key).agg(
            F.count(F.lit(1)).alias("group_size"),
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))).alias("first"),
        )
    )
    return looked_up(named, groups, key, "n").select(
        ROW,
        "doc_id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col(ROW) == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = settled(docs)
    kept = checkpoint(find_copies(docs).where("kept").select(ROW))
    return numbered(docs).join(kept, ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, the row that stays of those with an equal normalised text."""
    return find_copies(table(spark, sf_dir, "documents")).drop(ROW)


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""
