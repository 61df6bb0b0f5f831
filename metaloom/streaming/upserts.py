"""A keyed table that a stream keeps up to date: an update log folded into generations.

Every micro-batch writes its updates under its number. Each ``every`` batches the newest update of
every key goes into a new generation, which counts once a manifest names it. A reader takes
the newest manifest, its generation and the batches behind it: about a row per key, however
many batches there were. All of it is plain tables in a folder that executors share.

A repeated batch overwrites its own folder; a generation that a manifest names is not written
again; one that was written but not published is overwritten by the next attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

from ..sources.files import located
from .profile import newest

EVERY = 50


def _folders(path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``prefix=n`` that hold a written table."""
    from pyarrow import fs

    system, inner = located(path)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    names = [f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(prefix + "=")]
    whole = [n for n in names if system.get_file_info(f"{inner}/{n}/_SUCCESS").type == fs.FileType.File]
    return sorted(int(n.split("=")[1]) for n in whole)


def _forget(path: str, prefix: str, numbers: list[int]) -> None:
    system, inner = located(path)
    for n in numbers:
        system.delete_dir(f"{inner}/{prefix}={n}")


def published(root: str) -> list[int]:
    """Generations that count, oldest first; each is named after its last batch."""
    return _folders(f"{root}/manifest", "upto")


def _merged(spark: SparkSession, root: str, keys: list[str], schema: StructType, upto: int | None) -> DataFrame:
    """The newest update of every key with its batch, from the last generation (not behind ``upto``) and the batches since."""
    counted = [g for g in published(root) if upto is None or g < upto]
    last = counted[-1] if counted else None
    shape = StructType([*schema.fields]).add("batch", LongType())
    rows = spark.createDataFrame([], shape) if last is None else spark.read.schema(shape).parquet(f"{root}/generations/upto={last}")
    for n in _folders(f"{root}/log", "batch"):
        if (last is None or n > last) and (upto is None or n <= upto):
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{root}/log/batch={n}").withColumn("batch", F.lit(n).cast("long")))
    kept = rows.withColumn("_batch", F.col("batch"))
    return newest(kept, keys).withColumnRenamed("_batch", "batch")


def compact(spark: SparkSession, root: str, keys: list[str], schema: StructType, upto: int) -> None:
    """Fold all batches up to one into a generation and publish it; nothing happens if that is done."""
    before = published(root)
    if before and before[-1] >= upto:
        return
    _merged(spark, root, keys, schema, upto + 1).write.mode("overwrite").parquet(f"{root}/generations/upto={upto}")
    spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/upto={upto}")
    # readers may still be on the generation before this one
    if before:
        _forget(f"{root}/generations", "upto", [g for g in _folders(f"{root}/generations", "upto") if g < before[-1]])
        _forget(f"{root}/log", "batch", [n for n in _folders(f"{root}/log", "batch") if n <= before[-1]])


def keep_upserts(root: str, keys: list[str], every: int = EVERY):
    """``foreachBatch`` function that keeps the table of the newest update of every key below ``root``."""

    def run(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/log/batch={n}")
        if n % every == every - 1:
            compact(batch.sparkSession, root, keys, batch.schema, n)

    return run


def upserted(spark: SparkSession, root: str, keys: list[str], schema: StructType) -> DataFrame:
    """The newest update of every key."""
    return _merged(spark, root, keys, schema, None).drop("batch")
