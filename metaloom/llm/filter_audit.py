"""How filters interact: a stream of documents, retracted counts and all orders of five filters.

The files of the table are read as available-now micro-batches. Four filters follow from a
text alone. The fifth, a repeat of a smaller id's text, depends on all rows: the state of a
text is its smallest id so far and the documents that carry it. When a smaller id arrives, the
counts of the earlier ones are retracted and given again with the fifth filter's bit.

A task first settles among its own rows which of them some smaller id already repeats,
so a text that fills a third of the table reaches its state as one row a task. State is kept
for groups of texts (their digests dealt to buckets), merged as arrays. A batch's changes
are summed and written under its number, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import bind
from ..session import shared_dir
from .quality_rules import text_words

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
TEXTS_PER_BUCKET = 4000
#: Least bytes of a micro-batch.
LEAST_BATCH = 32 << 20
ROW = "bucket long, digest binary, doc_id long, part string, mask int, flags int, n long"
CHANGE = "part string, mask int, flags int, n long"
STATE = "digests binary, ids binary, codes binary, parts array<string>"
_CODES = ["part", "mask", "flags", "n"]


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text fails on its own: few words, few different words, capitals, symbols."""

    def of_words(w):
        n = F.size(w)
        return F.when(n < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 50 * n, 2).otherwise(0)

    def without(chars):
        return F.length(F.translate(text, chars, ""))

    capitals = F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    symbols = F.when(without("#$%&*|") < F.length(text), 8).otherwise(0)
    return (bind(text_words(text), of_words) + F.when(100 * capitals > 3 * F.length(text), 4).otherwise(0) + symbols).cast("int")


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.groupby(["part", "mask", "flags"], as_index=False, sort=False)["n"].sum()


def _settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text the rows of the task's smallest id; all others as counts that no later row can change."""
    held = [f for f in frames if len(f)]
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    known = rows["doc_id"].notna().to_numpy()
    least = rows.groupby("digest", sort=False)["doc_id"].transform("min")
    first = known & (rows["doc_id"] == least).to_numpy()
    # a null id is smaller than nothing and nothing is smaller than it
    later = known & ~first
    done = rows[~first].copy()
    done.loc[later[~first], "mask"] |= REPEAT
    done = _summed(done).assign(bucket=rows["bucket"].iloc[0], digest=None, doc_id=0)
    open_ = rows[first].groupby(["bucket", "digest", "doc_id", "part", "mask", "flags"], as_index=False, sort=False)["n"].sum()
    out = pd.concat([x for x in (open_, done) if len(x)], ignore_index=True)[["bucket", "digest", "doc_id", "part", "mask", "flags", "n"]]
    yield out.astype({"doc_id": "int64", "mask": "int32", "flags": "int32", "n": "int64"})


def _merge(key, frames, state):
    """The changes of the counters that a batch's rows of one bucket make."""
    new = pd.concat(list(frames), ignore_index=True)
    settled = new["digest"].isna().to_numpy()
    out = [new.loc[settled, _CODES]]
    new = new[~settled].assign(old=False)
    if state.exists:
        digests, ids, codes, parts = state.get
        codes = np.frombuffer(codes, "<i8").reshape(-1, 4)
        old = pd.DataFrame({
            "digest": [bytes(digests[i : i + 32]) for i in range(0, len(digests), 32)], "doc_id": np.frombuffer(ids, "<i8"),
            "part": np.array(parts, object)[codes[:, 0]], "mask": codes[:, 1], "flags": codes[:, 2], "n": codes[:, 3], "old": True,
        })
        new = pd.concat([old, new], ignore_index=True)
    if len(new):
        first = (new["doc_id"] == new.groupby("digest", sort=False)["doc_id"].transform("min")).to_numpy()
        old = new["old"].to_numpy()
        beaten = new.loc[~first, _CODES]
        out += [
            beaten.assign(mask=beaten["mask"] | REPEAT),
            beaten[old[~first]].assign(n=-new.loc[~first & old, "n"]),
            new.loc[first & ~old, _CODES],
        ]
        kept = new[first].groupby(["digest", "doc_id", "part", "mask", "flags"], as_index=False, sort=False)["n"].sum()
        code, parts = pd.factorize(kept["part"])
        codes = np.column_stack([code, kept["mask"], kept["flags"], kept["n"]]).astype("<i8")
        state.update((b"".join(kept["digest"]), kept["doc_id"].to_numpy("<i8").tobytes(), codes.tobytes(), list(parts)))
    yield _summed(pd.concat(out, ignore_index=True)).astype({"mask": "int32", "flags": "int32", "n": "int64"})


def _write_changes(path: str, batch: DataFrame, number: int) -> None:
    batch.groupBy("part", "mask", "flags").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")


def label_flags(labels: DataFrame) -> DataFrame:
    """(doc_id, flags): 1 for a document some label calls good, 2 for a toxic one."""
    good, toxic = (F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))) for c in ("quality", "toxic"))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((good + 2 * toxic).alias("flags"))


def failure_counts(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4) -> DataFrame:
    """(part, mask, flags, n): documents of the parquet table at ``path`` by the filters they fail.

    The table's files are streamed in about ``batches`` micro-batches (fewer for small tables).
    Bit i of mask is the filter FILTERS[i]; part is the language, null as empty; bit 0 of
    flags is a quality label of 1, bit 1 a toxic one. Null texts count as empty. A null
    doc_id repeats nothing and is repeated by nothing. Of rows with one doc_id and one text
    none repeats the other. Other columns are not read. An empty table gives no rows.
    """
    table = spark.read.parquet(path)
    docs = table.count()
    total = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0] or 0
    work = shared_dir(spark, "filter-audit")
    changes = f"{work}/changes"
    spark.createDataFrame([], CHANGE).write.parquet(f"{changes}/batch=-1")
    stream = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", str(max(LEAST_BATCH, -(-total // batches))))
    path = path.rstrip("/")
    stream = stream.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a single file can be a stream too
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stream.select(
        F.unhex(F.sha2(text, 256)).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"),
    ).join(label_flags(labels), "doc_id", "left")
    buckets = max(1, -(-docs // TEXTS_PER_BUCKET))
    open_ = rows.select(
        F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"), "digest", "doc_id", "part", "mask",
        F.coalesce("flags", F.lit(0)).alias("flags"), F.lit(1).cast("long").alias("n"),
    ).mapInPandas(_settle, ROW)
    changed = open_.groupBy("bucket").applyInPandasWithState(_merge, CHANGE, STATE, "update", GroupStateTimeout.NoTimeout)
    query = (
        changed.writeStream.outputMode("update").option("checkpointLocation", f"{work}/state")
        .foreachBatch(partial(_write_changes, changes)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    counted = spark.read.schema(CHANGE).parquet(changes)
    return counted.groupBy("part", "mask", "flags").agg(F.sum("n").alias("n")).where("n <> 0")


def audit(counts: DataFrame) -> DataFrame:
    """What every filter removes at every step of every order, per part.

    One row per (part, filter_order, step). ``kept`` and ``removed`` are what the step
    leaves and takes, ``redundant`` what its filter would have taken but an earlier one
    did, ``unique_fails`` what fails this filter only, ``good_lost`` and ``toxic_lost`` the
    removed with these labels, ``shapley`` what the filter removes summed over all orders: of
    documents that fail k filters, each takes 1 / k of the orders.
    """
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for i, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            steps.append((("".join(order)), i + 1, bit, before))
            before |= bit
    literal = F.array(*[
        F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("before")) for o, s, b, e in steps
    ])
    per = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.expr("if(flags % 2 = 1, n, 0L)")).alias("good"), F.sum(F.expr("if(flags >= 2, n, 0L)")).alias("toxic")
    )
    fails, passed = F.expr("(mask & bit) <> 0"), F.expr("(mask & before) = 0")

    def total(name, condition, value="n"):
        return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0)).cast("long").alias(name)

    return per.select("*", F.inline(literal)).groupBy("part", "filter_order", "step").agg(
        total("kept", ~fails & passed), total("removed", fails & passed), total("redundant", fails & ~passed),
        total("unique_fails", F.expr("mask = bit")), total("good_lost", fails & passed, "good"), total("toxic_lost", fails & passed, "toxic"),
        F.coalesce(F.sum(F.when(fails, F.expr("n * (120 div bit_count(mask))"))), F.lit(0)).cast("long").alias("shapley"),
    )


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4) -> DataFrame:
    """The audit of the documents at ``path``; see :func:`failure_counts` for how rows are taken."""
    return audit(failure_counts(spark, path, labels, batches))
