"""Exact nearest neighbours in a large vocabulary: cells around pivots and the triangle inequality.

Every feature's vectors are dealt to the nearest of its pivots, which are vectors drawn by a hash
of their code. A cell keeps how far its members lie from its pivot at least and at most. A
query first searches the cells nearest to it until they hold ``n`` entries; its n-th best
distance then rules out every cell whose nearest possible member lies farther, and only what
is left is searched. Queries never meet the cells of another feature.

Pivots are bounded in number (``PIVOTS``); cells above ``BLOCK`` vectors are cut into
blocks, and the queries of a cell into chunks, so no task holds a whole cell or a hot feature.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

CELL = 1_024
PIVOTS = 4_096
BLOCK = 8_192
CHUNK = 50_000
#: Slack of a bound, relative and absolute: distances are floating point.
SLACK = 1e-7

CELLS = "array<int>"


def scaled(m: np.ndarray, metric: str) -> np.ndarray:
    """Rows in which the metric is the Euclidean distance."""
    if metric != "cosine":
        return m
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distance of every row to every pivot, exact to rounding."""
    rough = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(rough, 0.0))


class Cell:
    """Pivots of one feature and what is known of their cells."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.count = np.zeros(len(pivots), np.int64)
        self.low, self.high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    def first(self, x: np.ndarray, n: int) -> list[list[int]]:
        """For every query the nearest cells that together hold n entries."""
        order = np.argsort(distances(x, self.pivots), axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1)
        need = np.minimum((held < n).sum(axis=1) + 1, len(self.pivots))
        return [[int(c) for c in row[:k] if self.count[c]] for row, k in zip(order, need)]

    def rest(self, x: np.ndarray, limit: np.ndarray, seen: list[list[int]]) -> list[list[int]]:
        """The other cells that can hold an entry within the limit."""
        far = distances(x, self.pivots)
        # members of a cell lie between low and high from its pivot
        least = np.maximum(np.maximum(far - self.high[None, :], self.low[None, :] - far), 0.0)
        slack = SLACK * (1.0 + far + np.where(np.isfinite(self.high), self.high, 0.0)[None, :])
        open_ = (least <= limit[:, None] + slack) & (self.count > 0)[None, :]
        return [[int(c) for c in np.flatnonzero(row) if c not in set(s)] for row, s in zip(open_, seen)]


def per_feature(names: list[tuple], vectors: pd.Series, cells: dict[tuple, Cell], metric: str, work, otherwise) -> list:
    """``work(cell, rows, matrix)`` for the rows of each feature that has pivots."""
    out: list = [otherwise(i) for i in range(len(vectors))]
    places: dict[tuple, list[int]] = {}
    for i, name in enumerate(names):
        if name in cells:
            places.setdefault(name, []).append(i)
    for name, at in places.items():
        m = scaled(np.asarray([vectors.iloc[i] for i in at], dtype=np.float64), metric)
        for i, found in zip(at, work(cells[name], at, m)):
            out[i] = found
    return out


def tuples(features: pd.DataFrame, by: list[str]) -> list[tuple]:
    return [tuple(r) for r in features[by].itertuples(index=False)] if by else [()] * len(features)


def by_struct(by: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("none"))


def drawn_pivots(vocab: DataFrame, by: list[str], metric: str, rows: int, cell: int) -> dict[tuple, Cell]:
    """Pivots of every feature above the size of a cell, one in so many of its vectors by a hash."""
    every = max(cell, -(-rows // PIVOTS))
    drawn = vocab.where(F.pmod(F.xxhash64("code", "uri"), F.lit(every)) == 0).select(*by, "vector")
    if by:
        large = vocab.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cell).drop("_n")
        drawn = drawn.join(large, by, "left_semi")
    table = drawn.limit(2 * PIVOTS).toPandas()  # the hash gives about rows / every; pivots steer the work only
    groups: dict[tuple, list] = {}
    for name, vector in zip(tuples(table, by), table["vector"]):
        groups.setdefault(name, []).append(vector)
    return {k: Cell(scaled(np.unique(np.asarray(v, dtype=np.float64), axis=0), metric)) for k, v in groups.items()}


def with_cells(vocab: DataFrame, by: list[str], metric: str, shared) -> DataFrame:
    """The vocabulary with the cell of every vector and the distance to its pivot."""

    @F.pandas_udf("struct<cell:int,far:double>")
    def place(vectors: pd.Series, features: pd.DataFrame) -> pd.DataFrame:
        def nearest(cell, at, m):
            best = distances(m, cell.pivots).argmin(axis=1)
            return zip(best.tolist(), np.sqrt(((m - cell.pivots[best]) ** 2).sum(axis=1)).tolist())

        found = per_feature(tuples(features, by), vectors, shared.value, metric, nearest, lambda i: (0, 0.0))
        return pd.DataFrame(found, columns=["cell", "far"])

    return vocab.withColumn("_p", place("vector", by_struct(by))).select("*", "_p.cell", "_p.far").drop("_p")


def searched(asked: DataFrame, placed: DataFrame, key: str, n: int, by: list[str], metric: str, sizes: DataFrame) -> DataFrame:
    """``(key, by.., distance, code, uri)``: up to n hits of each query in each block of its cells.

    ``asked(key, by.., vector, cells)``; ``sizes(by.., cell, blocks)``.
    """
    from .nearest import matrices

    at = asked.select(key, *by, "vector", F.explode("cells").alias("cell"))
    crowd = at.groupBy(*by, "cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks"))
    plan = written(sizes.join(crowd, [*by, "cell"]), "cell-plan")
    left = at.join(plan, [*by, "cell"]).withColumns({
        "_chunk": F.pmod(F.xxhash64(key), F.col("_chunks")).cast("int"), "_block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)),
    }).select(key, *by, "vector", "cell", "_chunk", "_block")
    right = placed.join(plan, [*by, "cell"]).withColumns({
        "_block": F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"), "_chunk": F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)),
    }).select(*by, "code", "uri", "vector", "cell", "_chunk", "_block")
    fields = "".join(f"`{c}` {asked.schema[c].dataType.simpleString()}, " for c in (key, *by))

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame(columns=[key, *by, "distance", "code", "uri"])
        table = next(iter(matrices(v, [], metric).values()))
        found = table.best(np.asarray(q["vector"].tolist(), dtype=np.float64), n)
        rows = q[[key, *by]].assign(hit=found).explode("hit", ignore_index=True)
        hits = pd.DataFrame(rows["hit"].tolist(), columns=["distance", "code", "uri"])
        return pd.concat([rows[[key, *by]], hits], axis=1)

    groups = [*by, "cell", "_chunk", "_block"]
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(search, fields + "distance double, code string, uri string")


def pivot_nearest(
    queries: DataFrame, vocab: DataFrame, key: str, n: int, by: list[str], metric: str, rows: int, cell: int = CELL
) -> tuple[DataFrame, DataFrame]:
    """The ``n`` nearest entries of each query as ``(key, by.., best)``, and its visits.

    The visits ``(key, by.., visited, cells)`` tell how many cells of its feature a query
    was compared with. Queries are told apart by (key, by). Features without entries give no row.
    """
    spark = queries.sparkSession
    cells = drawn_pivots(vocab, by, metric, rows, cell)
    shared = spark.sparkContext.broadcast(cells)
    placed = written(with_cells(vocab.select(*by, "code", "uri", "vector"), by, metric, shared), "cells")
    stats = placed.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    stats = written(stats, "cell-sizes")
    sizes = stats.select(*by, "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    totals = stats.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("cells"))
    # only features with pivots, so no more rows than pivots
    known = stats
    if by:
        several = totals.where("cells > 1").select(*by)
        known = stats.join(several, by, "left_semi")
    for r in known.collect():
        name = tuple(r[c] for c in by)
        if name in cells:
            one = cells[name]
            one.count[r["cell"]], one.low[r["cell"]], one.high[r["cell"]] = r["n"], r["low"], r["high"]
    for one in cells.values():
        if not one.count.any():  # a feature whose vectors all lie in one cell
            one.count[:], one.low[:], one.high[:] = 1, 0.0, np.inf
    shared = spark.sparkContext.broadcast(cells)

    @F.pandas_udf(CELLS)
    def first(vectors: pd.Series, features: pd.DataFrame) -> pd.Series:
        return pd.Series(per_feature(tuples(features, by), vectors, shared.value, metric, lambda c, at, m: c.first(m, n), lambda i: [0]))

    @F.pandas_udf(CELLS)
    def rest(vectors: pd.Series, features: pd.DataFrame, limits: pd.Series, seen: pd.Series) -> pd.Series:
        def work(c, at, m):
            limit = np.array([np.inf if limits.iloc[i] is None else limits.iloc[i] for i in at], dtype=float)
            return c.rest(m, np.where(np.isnan(limit), np.inf, limit), [list(seen.iloc[i]) for i in at])

        return pd.Series(per_feature(tuples(features, by), vectors, shared.value, metric, work, lambda i: []))

    asked = written(queries.select(key, *by, "vector").withColumn("cells", first("vector", by_struct(by))), "asked")
    search = partial(searched, placed=placed, key=key, n=n, by=by, metric=metric, sizes=sizes)
    hits = written(search(asked), "first-hits")
    order = F.slice(F.array_sort(F.collect_list(F.struct("distance", "code", "uri"))), 1, n)
    # the n-th distance as a length; of fewer hits nothing follows
    twice = 2.0 if metric == "cosine" else 1.0
    limit = F.sqrt(twice * F.try_element_at("m", F.lit(n))["distance"])
    best = hits.groupBy(key, *by).agg(order.alias("m")).select(key, *by, limit.alias("_limit"))
    again = asked.join(best, [key, *by], "left").withColumn("more", rest("vector", by_struct(by), "_limit", "cells"))
    again = written(again.select(key, *by, "vector", "cells", "more"), "asked-again")
    more = search(again.select(key, *by, "vector", F.col("more").alias("cells")))
    merged = hits.unionByName(more).groupBy(key, *by).agg(order.alias("m"))
    ranked = F.transform(
        "m", lambda e, i: F.struct((i + 1).alias("rank"), e["code"].alias("code"), e["uri"].alias("uri"), e["distance"].alias("distance"))
    )
    visited = again.select(key, *by, (F.size("cells") + F.size("more")).alias("visited"))
    visits = visited.join(totals, by) if by else visited.withColumn("cells", F.coalesce(totals.select("cells").scalar(), F.lit(0)))
    return merged.select(key, *by, ranked.alias("best")), visits
