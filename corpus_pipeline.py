"""From raw documents to packed training sequences: five stages, each a written table for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm import benchmark, near, packing, quality_model, templates
from metaloom.session import written
from metaloom.llm.tables import quoted


def _with_text(found: DataFrame, columns: list[str]) -> DataFrame:
    """The carried rows with what is left of their text."""
    new = {"text": F.col("left_over"), "n_chars": F.length("left_over").cast("long")}
    return found.select(*[(new[c] if c in new else F.col("row." + quoted(c))).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    machine = quality_model.train(spark, docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    return quality_model.score(docs, machine).where("score >= 0.5").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; a text of nothing else becomes empty."""
    return _with_text(templates.drop_recurring_lines(spark, docs), docs.columns)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    found = near.near_duplicates(spark, docs.select("doc_id", "text"))
    return docs.join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*map(quoted, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark go."""
    found = benchmark.scan_items(spark, docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
    return _with_text(found.where("n_hit = 0 or length(left_over) > 0"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    return packing.pack(spark, docs.select("doc_id", "text", "source"))


STAGES = [
    ("quality classifier", quality), ("line dedup", lines), ("near duplicates", duplicates),
    ("benchmark decontamination", decontamination), ("packing", packed),
]

#: The model, the templates and the tokenizer have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each from the table that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
