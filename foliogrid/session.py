"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliogrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, unless their path has it already.

    A changed path means new workers beside the old ones, so it is set before any are started.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; only Spark's reader touches the path."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a checkpoint in the folder that executors share.

    The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset and the session runs on one machine, as in
    tests, a temporary folder takes its place; on a cluster executors would not see it, so there it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "foliogrid-checkpoints"))
    return df.checkpoint(eager=True)


#: Bytes of a method up to which HotSpot compiles it; a larger one is interpreted, however often it runs.
HUGE_METHOD = "8000"


def compilable(df: DataFrame) -> DataFrame:
    """Let steps whose generated code is too long for the JVM's compiler run as smaller methods; it is set in the caller's session."""
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD)
    return df


#: Rows and bytes a side may have to be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a count proves the (narrow) frame to have no more than ``rows`` rows.

    The count stops at ``rows`` + 1; past the bound the frame comes back unhinted and Spark shuffles.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
