"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source.

A sketch is a table of counts by bucket. Buckets hold integers that agree in their leading
``BITS`` bits, so a quantile is right to 1 part in 64, sketches merge by adding counts, and
the result does not depend on the order of tasks. Groups too small for a sketch of their
own take the one merged over their language, then the one over everything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from ..session import written

BITS = 7
BLANKS = " \t\n\x0b\x0c\r"
#: Metrics in millionths (mean word length in thousandths): rule name, upper slack, lower slack (None: no lower fence).
RULES = [("symbol_ppm", 30_000, None), ("repeat_ppm", 150_000, None), ("upper_ppm", 100_000, None), ("dup_line_ppm", 300_000, None), ("word_milli", 1_500, 1_500)]


def text_words(text: Column) -> Column:
    """Runs without blanks and the controls 9 to 13."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+"))


def repeat_words(w: Column) -> Column:
    """Words that lie in 5-word windows found twice or more."""
    windows = F.greatest(F.size(w) - 4, F.lit(0))
    starts = F.slice(w, F.lit(1), windows)

    def hashed(_, i):
        return F.xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])

    def exact(_, i):
        return F.struct(F.array_join(F.slice(w, i + 1, F.lit(5)), " ").alias("k"), i.alias("i"))

    def of_sorted(s):
        def twice(x, j):
            before = (j > 0) & (s[F.greatest(j - 1, F.lit(0))]["k"] == x["k"])
            after = (j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["k"] == x["k"])
            return before | after

        return bind(F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"])), covered)

    def covered(at):
        def own(p, j):
            return F.when(j == F.size(at) - 1, 5).otherwise(F.least(F.lit(5), at[F.least(j + 1, F.size(at) - 1)] - p))

        return F.aggregate(F.transform(at, own), F.lit(0).cast("long"), lambda a, x: a + x)

    # equal hashes are only a hint; the few texts that have them are counted on the words themselves
    distinct = bind(F.transform(starts, hashed), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    slow = bind(F.sort_array(F.transform(starts, exact)), of_sorted)
    return F.when(distinct, F.lit(0).cast("long")).otherwise(slow)


def ratio(part: Column, whole: Column, scale: int) -> Column:
    return F.when(whole > 0, F.floor(part * scale / whole)).otherwise(0).cast("long")


def text_statistics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of every whole text with the grouping columns; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(k) for k in keys], text.alias("text")).withColumn("w", text_words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counted = rows.select(
        *keys, F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("dup"), F.size(x).alias("n"))).alias("lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
    )
    counted = counted.select(
        *keys, "n_words", "word_chars", "n_symbols", F.col("lines.dup").cast("long").alias("n_dup_lines"),
        F.col("lines.n").cast("long").alias("n_lines"), "n_repeat_words", "n_upper",
    )
    return counted.select(
        *counted.columns, ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        ratio(F.col("n_symbols"), F.col("word_chars"), 1_000_000).alias("symbol_ppm"),
        ratio(F.col("n_repeat_words"), F.col("n_words"), 1_000_000).alias("repeat_ppm"),
        ratio(F.col("n_upper"), F.col("word_chars"), 1_000_000).alias("upper_ppm"),
        ratio(F.col("n_dup_lines"), F.col("n_lines"), 1_000_000).alias("dup_line_ppm"),
        ratio(F.col("word_chars"), F.col("n_words"), 1_000).alias("word_milli"),
    )


def bucket(value: Column) -> Column:
    """The value with all but its leading bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    step = F.pow(F.lit(2.0), drop).cast("long")
    return value - F.pmod(value, step)


def sketches(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rule, bucket, n): one mergeable sketch per group and rule."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), bucket(F.col(r)).alias("bucket")) for r, _, _ in RULES])
    return stats.select(*by, F.inline(pairs)).groupBy(*by, "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of finer groups added up."""
    return sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by..., rule, total, one column per share): the least bucket that covers the share of the group."""
    whole = Window.partitionBy(*by, "rule")
    ranked = sketch.withColumn("total", F.sum("n").over(whole)).withColumn(
        "upto", F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    )
    return ranked.groupBy(*by, "rule").agg(
        F.max("total").alias("total"), *[F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col("bucket"))).alias(c) for c, q in shares.items()]
    )


def thresholds(sketch: DataFrame, by: list[str], least: int) -> DataFrame:
    """(by..., low_<rule>, high_<rule>): fences of each group from its own sketch, or from a merged one."""
    shares = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    levels = [by[:k] for k in range(len(by), -1, -1)]
    groups = sketch.select(*by, "rule").distinct()
    found = groups
    for depth, level in enumerate(levels):
        q = quartiles(merge(sketch, level), level, shares)
        q = q.select(*[F.col(c).alias(f"__{c}") for c in level], F.col("rule").alias("__rule"), F.struct("total", *shares).alias(f"s{depth}"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in level] + [F.col("rule") == F.col("__rule")])
        found = found.join(q, same, "left").drop("__rule", *[f"__{c}" for c in level])
    last = len(levels) - 1
    pick = F.coalesce(*[F.when(F.col(f"s{d}.total") >= least, F.col(f"s{d}")) for d in range(last)], F.col(f"s{last}"))
    found = found.select(*by, "rule", pick.alias("s"))
    spread = F.col("s.q3") - F.col("s.q1")
    fences = []
    for rule, up, down in RULES:
        mine = F.col("rule") == rule
        fences.append(F.max(F.when(mine, F.col("s.q3") + 4 * spread + up)).alias(f"high_{rule}"))
        fences.append(F.max(F.when(mine, F.lit(-1) if down is None else F.col("s.q1") - 4 * spread - down)).alias(f"low_{rule}"))
    return found.groupBy(*by).agg(*fences)


def quality_rules(spark: SparkSession, docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), least: int = 200) -> DataFrame:
    """``docs`` (doc_id, text, by...) to their statistics, the group's fences and (base_failed, kept).

    The fences of a rule are quartiles widened by four interquartile ranges and a slack; they
    come from the documents that pass the base rules, sketched per group of ``by`` (at
    least ``least`` documents, else merged over the leading columns). A document outside
    a fence is not kept; nor is one that fails the base. Null texts are empty and fail; null
    group values are groups of their own; repeated rows count each; a group without any
    passing document has no fences and keeps none; other columns are ignored.
    """
    keys = ["doc_id", *by]
    stats = written(text_statistics(docs, keys), "statistics")
    sketch = written(sketches(stats.where(~F.col("base_failed")), list(by)), "sketch")
    fences = thresholds(sketch, list(by), least).select(*[F.col(c).alias(f"__{c}") for c in by], "*").drop(*by)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    joined = stats.join(fences, same, "left").drop(*[f"__{c}" for c in by])
    inside = reduce(lambda a, b: a & b, [F.col(r).between(F.col(f"low_{r}"), F.col(f"high_{r}")) for r, _, _ in RULES])
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
