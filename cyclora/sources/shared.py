"""What operators share: the folder of driver and executors, and the state of scans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for checkpoints.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a
    temporary one is made on a single machine, as in tests; on a cluster,
    whose executors don't see it, that is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="cyclora-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def is_scan(df: DataFrame) -> bool:
    """Whether a table is read as it is, with nothing but filters and columns computed from a row."""
    return _reads(df, ("Scan ", "LocalTableScan"))


def is_parquet_scan(df: DataFrame) -> bool:
    """Whether a table is read from Parquet files, with nothing but filters and columns computed from a row."""
    return _reads(df, ("Scan parquet",))


def _reads(df: DataFrame, sources: tuple[str, ...]) -> bool:
    nodes = [df._jdf.queryExecution().sparkPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if not (name in ("Project", "Filter", "ColumnarToRow") or name.startswith(sources)):
            return False
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return True


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan of fewer partitions than there are cores to all cores, before costly work on each row.

    A large table has more partitions than that and is left as it is, so it
    isn't shuffled; one small file of one row group isn't left to one core.
    """
    if not is_scan(df):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
