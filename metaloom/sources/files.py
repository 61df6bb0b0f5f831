"""File listing, format dispatch, file facts and the heads used for sniffing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import file_extension, mime_type

# Supported suffixes and the reader that serves them.
FORMATS = {
    "csv": "csv",
    "json": "json",
    "xml": "xml",
    "xlsx": "grid",
    "xls": "grid",
    "parquet": "parquet",
}
HEAD_BYTES = 10_000
HEAD_LINES = 5
#: Bytes in which the first lines are looked for; what has none there is no table of lines.
HEAD_LIMIT = 8 << 20
CHUNK_BYTES = 1 << 20

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(kind: str):
    """Register a reader ``(spark, path, **options) -> DataFrame`` for a format."""

    def add(fn):
        READERS[kind] = fn
        return fn

    return add


def format_of(path: str) -> str:
    """Reader kind of a path; unknown suffixes are an error."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file format: .{suffix}")
    return FORMATS[suffix]


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of one dataset through the reader of its format."""
    kind = format_of(path)
    if kind not in READERS:
        raise ValueError(f"no reader registered for {kind}")
    return READERS[kind](spark, path, **options)


@reader("parquet")
def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    """File or partitioned directory with its own types."""
    return spark.read.parquet(path)


def format_column(path: Column) -> Column:
    """Reader kind per path of a listing, NULL when unsupported."""
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.try_element_at(table, F.coalesce(file_extension(path), F.lit("")))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` without reading them."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", "modificationTime", "length")
    )


def discover(files: DataFrame, root: str) -> DataFrame:
    """Datasets of a lake: one row per supported file or ``.parquet`` directory.

    Hidden names are skipped; the first folder below the root names the dataset.
    """
    prefix = "^(?:file:/*|[a-z0-9]+://[^/]*)?/*" + root.split(":", 1)[-1].strip("/").replace(".", r"\.") + "/"
    relative = F.regexp_replace("path", prefix, "")
    parts = F.split(relative, "/")
    inner = F.regexp_extract(relative, r"^((?:[^/]+/)*?[^/]+\.parquet)/", 1)
    member = F.when(inner != "", inner).otherwise(relative)
    name = F.element_at(F.split(member, "/"), -1)
    kept = (
        files.withColumns({"dataset_id": parts[0], "file": member, "_name": name, "_parts": F.size(parts)})
        .where((F.col("_parts") > 1) & ~F.col("_name").startswith("."))
        .withColumn("format", format_column(F.col("file")))
        .where("format is not null")
    )
    return kept.groupBy("dataset_id", "file", "format").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified")
    )


def file_facts(spark: SparkSession, root: str) -> DataFrame:
    """Type, format, size and SHA-256 of each file, whatever its size."""
    files = list_files(spark, root)
    facts = files.select(
        "path",
        mime_type(F.col("path")).alias("mimetype"),
        file_extension(F.col("path")).alias("format"),
        F.col("length").alias("size"),
        F.lit("SHA-256").alias("hash_algorithm"),
    )
    return facts.join(file_hashes(files), "path").select("path", "mimetype", "format", "size", "hash", "hash_algorithm")


def file_hashes(files: DataFrame) -> DataFrame:
    """``(path, hash)``: SHA-256 over the stream of each file, a chunk in memory at a time."""

    def digest(path: str) -> str:
        import hashlib

        found = hashlib.sha256()
        with open_stream(path) as stream:
            while chunk := stream.read(CHUNK_BYTES):
                found.update(chunk)
        return found.hexdigest()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "hash": [digest(p) for p in batch["path"]]}, dtype=object)

    return over_paths(files).mapInPandas(read, "path string, hash string")


def over_paths(files: DataFrame) -> DataFrame:
    """The paths, spread over the tasks."""
    width = max(1, files.sparkSession.sparkContext.defaultParallelism)
    return files.select("path").repartition(width, "path")


def located(path: str):
    """File system and inner path of any place Arrow knows."""
    import re

    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", path)
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri if ":" in uri else "file://" + uri)


def open_stream(path: str):
    """Binary stream of a path."""
    system, inner = located(path)
    return system.open_input_stream(inner)


def open_at(path: str):
    """Binary file of a path that can be read from any place."""
    system, inner = located(path)
    return system.open_input_file(inner)


def file_heads(files: DataFrame) -> DataFrame:
    """``(path, head, lines)``: the first bytes and the first complete lines.

    Only the beginning of a file is read, whatever its size; the paths are spread
    over the tasks.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                with open_stream(path) as stream:
                    head = stream.read(HEAD_BYTES)
                    parts, breaks, size = [head], head.count(b"\n"), len(head)
                    while breaks < HEAD_LINES and size < HEAD_LIMIT and (more := stream.read(65536)):
                        parts.append(more)
                        breaks += more.count(b"\n")
                        size += len(more)
                rows.append((path, head, b"\n".join(b"".join(parts).split(b"\n")[:HEAD_LINES])))
            yield pd.DataFrame(rows, columns=["path", "head", "lines"])

    return over_paths(files).mapInPandas(read, "path string, head binary, lines binary")
