"""Nearest vocabulary entries by vector distance, exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import bind
from .pivots import pivot_nearest

RELATIVE_CUT = 1.2

# A vocabulary up to this many vectors travels to the executors as one matrix;
# a larger one is searched by cells around pivots.
BROADCAST_VECTORS = 16_384
BLOCK_VECTORS = 8_192
QUERY_CHUNK = 50_000

HITS = "array<struct<rank:int,code:string,uri:string,distance:double>>"


def unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


class Matrix:
    """Entries of one vocabulary block, ordered by code for a stable tie order."""

    def __init__(self, codes, uris, vectors, metric: str):
        order = np.argsort(np.asarray(codes, dtype=object), kind="stable")
        self.codes = [codes[i] for i in order]
        self.uris = [uris[i] for i in order]
        m = np.asarray([vectors[i] for i in order], dtype=np.float64)
        self.metric = metric
        self.m = unit_rows(m) if metric == "cosine" else m
        self.squares = (self.m**2).sum(axis=1)

    def best(self, queries: np.ndarray, n: int) -> list[list[tuple]]:
        """The ``n`` nearest entries per query row.

        One matrix product gives distances good enough to discard almost all
        entries; those within rounding of the n-th are measured again exactly.
        """
        q = unit_rows(queries) if self.metric == "cosine" else queries
        n = min(n, len(self.codes))
        norms = (q**2).sum(axis=1)
        rough = norms[:, None] + self.squares[None, :] - 2.0 * (q @ self.m.T)
        limit = np.partition(rough, n - 1, axis=1)[:, n - 1] + 1e-9 * (1.0 + norms + self.squares.max())
        out = []
        for row, far, x in zip(rough, limit, q):
            near = np.flatnonzero(row <= far)
            exact = ((self.m[near] - x) ** 2).sum(axis=1)
            if self.metric == "cosine":
                exact = exact / 2.0
            pick = np.lexsort((near, exact))[:n]
            out.append([(float(exact[i]), self.codes[near[i]], self.uris[near[i]]) for i in pick])
        return out


def ranked(hits: list[tuple]) -> list[dict]:
    return [{"rank": r + 1, "code": c, "uri": u, "distance": d} for r, (d, c, u) in enumerate(hits)]


def matrices(rows: pd.DataFrame, by: list[str], metric: str) -> dict[tuple, Matrix]:
    groups = rows.groupby(by, sort=False) if by else [((), rows)]
    return {
        (k if isinstance(k, tuple) else (k,)): Matrix(g["code"].tolist(), g["uri"].tolist(), g["vector"].tolist(), metric)
        for k, g in groups
    }


def scan_matrix(queries: DataFrame, vocab: DataFrame, key: str, n: int, by: list[str], metric: str) -> DataFrame:
    """Small vocabulary: no shuffle, one matrix product per Arrow batch and feature."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(matrices(vocab.select(*by, "code", "uri", "vector").toPandas(), by, metric))

    @F.pandas_udf(HITS)
    def search(vectors: pd.Series, features: pd.DataFrame) -> pd.Series:
        tables = shared.value
        result: list = [[] for _ in range(len(vectors))]
        names = [tuple(r) for r in features[by].itertuples(index=False)] if by else [()] * len(vectors)
        for name in set(names):
            table = tables.get(name)
            at = [i for i, x in enumerate(names) if x == name and vectors.iloc[i] is not None]
            if table is None or not at:
                continue
            q = np.asarray([vectors.iloc[i] for i in at], dtype=np.float64)
            for i, hits in zip(at, table.best(q, n)):
                result[i] = ranked(hits)
        return pd.Series(result)

    features = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("none"))
    return queries.select(key, *by, search("vector", features).alias("best"))


def scan_blocks(
    queries: DataFrame, vocab: DataFrame, key: str, n: int, by: list[str], metric: str, rows: int
) -> DataFrame:
    """Large vocabulary: every query chunk meets every block in a task of bounded size.

    Chunks and blocks are cut by hash, so neither a hot feature nor a large
    vocabulary fills a task. A block returns ``n`` rows per query; the lists of a
    query are merged by one aggregation.
    """
    blocks = -(-rows // BLOCK_VECTORS)
    chunks = max(1, -(-queries.count() // QUERY_CHUNK))
    left = queries.select(key, *by, "vector").withColumns({
        "_chunk": F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int"),
        "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
    })
    right = vocab.select(*by, "code", "uri", "vector").withColumns({
        "_block": F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int"),
        "_chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))),
    })
    key_type = queries.schema[key].dataType.simpleString()
    fields = "".join(f"`{c}` {queries.schema[c].dataType.simpleString()}, " for c in by)

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        tables = matrices(v, by, metric) if len(v) else {}
        out = []
        for name, part in q.groupby(by, sort=False) if by else [((), q)]:
            table = tables.get(name if isinstance(name, tuple) else (name,))
            if table is None:
                continue
            found = table.best(np.asarray(part["vector"].tolist(), dtype=np.float64), n)
            out.append(part[[key, *by]].assign(best=[ranked(h) for h in found]))
        return pd.concat(out) if out else pd.DataFrame(columns=[key, *by, "best"])

    parts = (
        left.groupBy("_chunk", "_block").cogroup(right.groupBy("_chunk", "_block"))
        .applyInPandas(search, f"`{key}` {key_type}, {fields}best {HITS}")
    )
    hits = parts.select(key, *by, F.inline("best"))
    merged = hits.groupBy(key, *by).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("distance", "code", "uri"))), 1, n).alias("m")
    )
    reranked = F.transform(
        "m",
        lambda e, i: F.struct((i + 1).alias("rank"), e["code"].alias("code"), e["uri"].alias("uri"), e["distance"].alias("distance")),
    )
    return merged.select(key, *by, reranked.alias("best"))


def nearest(
    queries: DataFrame, vocab: DataFrame, key: str, n: int, by: list[str] = (), metric: str = "l2"
) -> DataFrame:
    """The ``n`` nearest entries of each query vector, exact, rank 1 first.

    ``queries(key, by.., vector)`` search the part of ``vocab(by.., code, uri, vector)``
    that shares their feature. One count of the vocabulary picks the plan.
    """
    by = list(by)
    # a query or an entry without a vector has no neighbours, whatever the plan
    queries, vocab = queries.where(F.col("vector").isNotNull()), vocab.where(F.col("vector").isNotNull())
    rows = vocab.count()
    if rows <= BROADCAST_VECTORS:
        found = scan_matrix(queries, vocab, key, n, by, metric)
    else:
        found = pivot_nearest(queries, vocab, key, n, by, metric, rows)[0]
    # Outer, so that no size test is inferred that would run the search a second time.
    return found.select(key, *by, F.inline_outer("best")).where("code is not null")


def relative_cut(hits: DataFrame, key: list[str], factor: float = RELATIVE_CUT) -> DataFrame:
    """Hits within ``factor`` times the best distance of their query.

    Works on the ``n`` rows of a query; sorted distances make the cut a prefix.
    Entries without a uri count for the best distance but are not returned.
    """
    best = F.min("distance").over(Window.partitionBy(*key))
    return (
        hits.withColumn("_best", best)
        .where((F.col("distance") <= F.col("_best") * factor) & (F.coalesce("uri", F.lit("")) != ""))
        .drop("_best")
    )


def similarity_match(
    queries: DataFrame, vocab: DataFrame, key: str, n: int, multiple: bool, by: list[str] = (),
    factor: float = RELATIVE_CUT, metric: str = "l2",
) -> DataFrame:
    """Matched uris per query: all within the cut, or the first."""
    kept = relative_cut(nearest(queries, vocab, key, n, by, metric), [key, *by], factor)
    lists = kept.groupBy(key, *by).agg(
        F.array_sort(F.collect_list(F.struct("rank", "uri"))).alias("_r")
    ).withColumn("uris", F.transform("_r", lambda r: r["uri"])).drop("_r")
    return lists if multiple else lists.withColumn("uris", F.slice("uris", 1, 1))


# ── text to vector ───────────────────────────────────────────────────────────

def hashed_text(c: Column, dim: int = 384) -> Column:
    """Default encoder: signed feature hashing of lower-cased words, L2-normalised.

    A stand-in with the contract of a sentence model, in built-in expressions; null
    and blank texts are the zero vector.
    """
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    codes = F.transform(words, lambda w: F.crc32(F.encode(w, "UTF-8")))
    cells = F.transform(codes, lambda h: F.struct((h % dim).cast("int").alias("at"), F.when(h >= 1 << 31, 1.0).otherwise(-1.0).alias("sign")))

    def vector(s: Column) -> Column:
        """The sorted cells in one pass: zeros up to each cell that occurs, then the sum of its run."""
        n, zeros = F.size(s), lambda k: F.array_repeat(F.lit(0.0), k)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i)["at"] != F.get(s, i - 1)["at"]))

        def dense(p: Column) -> Column:
            def run(i: Column, r: Column) -> Column:
                end, before = F.coalesce(F.get(p, r + 1), n), F.coalesce(F.get(s, F.get(p, r - 1))["at"], F.lit(-1))
                total = F.aggregate(F.slice(s, i + 1, end - i), F.lit(0.0), lambda a, e: a + e["sign"])
                return F.concat(zeros(F.get(s, i)["at"] - before - 1), F.array(total))

            return F.concat(F.flatten(F.transform(p, run)), zeros(dim - 1 - F.get(s, n - 1)["at"]))

        return F.when(n == 0, zeros(dim)).otherwise(bind(starts, dense))

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return bind(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float")))

    return bind(bind(F.array_sort(cells), vector), unit)


def embed_text(c: Column, encode=None) -> Column:
    """Vector column of a text column: built in, or by a function over Arrow batches."""
    if encode is None:
        return hashed_text(c)

    @F.pandas_udf("array<float>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from encode(batches)

    return encoded(c)


def vector_table(entries: DataFrame, encode=None) -> DataFrame:
    """(feature, code, uri, text, vector) of the vocabulary entries that have text."""
    return entries.where(F.length("text") > 0).select(
        "feature", "code", "uri", "text", embed_text(F.col("text"), encode).alias("vector")
    )


def index_totals(index: DataFrame) -> DataFrame:
    return index.agg(F.count_distinct("feature").alias("features"), F.count(F.lit(1)).alias("entries"))
