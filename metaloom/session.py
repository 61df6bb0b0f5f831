"""Session helpers: defaults for local runs and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "metaloom") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor can reach.

    The cluster names the shared root in ``spark.checkpoint.dir``. Only a local
    master, whose tasks run on this machine, may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="metaloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows from a table in the shared folder: computed once, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that one task works on where a row is costly.
SHARE_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Share out the rows of a scan that has fewer splits than the session has cores, or too large ones.

    A file of one row group is one task; heavy work per row is better spread first.
    Shares are bounded in rows, so a task takes no longer on a larger table. ``df`` should be a plain
    scan, whose rows are counted from the footers of its files.
    """
    width = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SHARE_ROWS))
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df
