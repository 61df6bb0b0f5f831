"""Geographic coverage: which levels of place names describe a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import COUNTRY_BASE

# Level order, share above which a level is too broad, world size.
LEVELS = ["provinces", "autonomies", "countries", "continents"]
LEVEL_SHARE = 0.10
COUNTRY_COUNT = 50
DEFAULT_PLACE = COUNTRY_BASE + "ESP"


def level_sizes(gazetteer: DataFrame, levels: list[str] = LEVELS, country_level: str = "countries") -> DataFrame:
    """Number of entries per level; countries count against a fixed world size."""
    sized = gazetteer.groupBy("level").agg(F.count(F.lit(1)).alias("size"))
    fixed = F.when(F.col("level") == country_level, F.lit(COUNTRY_COUNT)).otherwise(F.col("size"))
    return sized.select("level", fixed.cast("bigint").alias("size"))


def coverage_uris(
    hits: DataFrame,
    sizes: DataFrame,
    datasets: DataFrame,
    key: str,
    levels: list[str] = LEVELS,
    share: float = LEVEL_SHARE,
    default: str = DEFAULT_PLACE,
) -> DataFrame:
    """Uris per dataset: a level is kept when its hits are at most ``share`` of its
    size, the last level always; nothing kept gives the default place.

    ``hits(key, level, ord, uri)`` may repeat. They are first folded to one row per
    (dataset, level, uri), which no dataset can dominate; after that a dataset has
    at most as many rows as the gazetteer, so its list fits into one row.
    """
    folded = hits.groupBy(key, "level", "uri").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    rank = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col("level"))
    sized = folded.join(sizes, "level").withColumn("level_rank", rank)
    totals = [F.sum(F.when(F.col("level_rank") == i + 1, F.col("n"))) for i in range(len(levels))]
    lists = sized.groupBy(key).agg(
        F.collect_list(F.struct("level_rank", "first", "uri", "size")).alias("h"), F.array(*totals).alias("totals")
    )

    def kept(e: Column) -> Column:
        total = F.get("totals", e["level_rank"].cast("int") - 1)
        return (e["level_rank"] == len(levels)) | (total / e["size"] <= share)

    chosen = F.array_sort(F.filter("h", kept))
    uris = F.array_distinct(F.transform(chosen, lambda e: e["uri"]))
    resolved = lists.select(key, uris.alias("uris"))
    filled = datasets.select(key).join(resolved, key, "left")
    empty = F.coalesce(F.size("uris"), F.lit(0)) <= 0
    return filled.withColumn("uris", F.when(empty, F.array(F.lit(default))).otherwise(F.col("uris")))
