"""Which of very many patterns occur in which texts: an inverted index of character grams.

A pattern that occurs in a text has each of its words inside some word of the text. So
the search goes over the vocabulary of the texts, which is far smaller than they are: a word of
a pattern of up to ``GRAM`` characters is met as it is among the substrings of the vocabulary; a
longer one is looked up by the one of its grams that the fewest vocabulary words have, and
confirmed there. Texts come in only through their words; a pattern of several words asks for the
word that fewest texts have and is confirmed on the text itself.

Nothing is paired by blocks: a row stands for a word that has a pattern's word inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

#: Characters of a gram. Patterns of up to that length meet no word in vain: with short grams the
#: words to be confirmed would grow with the vocabulary times the dictionary.
GRAM = 16
#: Copies of a row that are made at once, and rows that a task makes about.
COPIES, TASK_ROWS = 1_000, 20_000_000


def words_in(text: Column) -> Column:
    """Distinct words between blanks."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def grams(word: Column, sizes: list[int]) -> Column:
    """Distinct substrings of the given sizes."""

    n = F.length(word)

    def of_size(size: int) -> Column:
        at = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(word, i, F.lit(size)))

    return F.array_distinct(F.concat(*[of_size(size) for size in sizes]))


def words_met(vocabulary: DataFrame, parts: DataFrame) -> DataFrame:
    """``(part, token)``: the words of ``vocabulary(token)`` that have the rarest gram of a word of ``parts(part)``."""
    size = F.least(F.length("part"), F.lit(GRAM))
    sizes = sorted(r["s"] for r in parts.select(size.alias("s")).distinct().collect())
    if not sizes:
        return vocabulary.sparkSession.createDataFrame([], "part string, token string")
    own = F.array_distinct(F.when(F.length("part") >= GRAM, grams(F.col("part"), [GRAM])).otherwise(F.array("part")))
    wanted = written(parts.select("part", F.explode(own).alias("gram")), "part-grams")
    offered = vocabulary.select("token", F.explode(grams(F.col("token"), sizes)).alias("gram"))
    offered = written(offered.join(wanted.select("gram").distinct(), "gram", "left_semi"), "word-grams")
    counted = offered.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    keys = wanted.join(counted, "gram").groupBy("part").agg(F.min(F.struct("n", "gram")).alias("k")).select("part", F.col("k.gram").alias("gram"))
    return offered.join(keys, "gram").select("part", "token")


def words_holding(vocabulary: DataFrame, parts: DataFrame) -> DataFrame:
    """``(part, token)``: the words of ``vocabulary(token)`` that hold a word of ``parts(part)``."""
    return words_met(vocabulary, parts).where(F.contains("token", "part"))


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(id, pattern)`` once for each pattern that ``texts(id, body)`` contain anywhere.

    Patterns and bodies are compared as they are. Null patterns and bodies match nothing. Blank
    patterns are found by a plain test, one row per text and different blank. A
    repeated id counts as one text.
    """
    known = patterns.where("pattern is not null").select("pattern").distinct()
    split = written(known.select("pattern", words_in(F.col("pattern")).alias("parts")), "patterns")
    tokens = texts.select("id", F.explode(words_in(F.col("body"))).alias("token"))
    vocabulary = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "vocabulary")
    parts = split.select(F.explode("parts").alias("part")).distinct()
    held = written(words_holding(vocabulary.select("token"), parts), "words-holding")
    common = held.join(vocabulary, "token").groupBy("part").agg(F.sum("n").alias("n"))
    # a pattern with a word that no text holds is nowhere; else the rarest word asks for it
    asked = split.select("pattern", F.size("parts").alias("size"), F.explode("parts").alias("part")).join(common, "part")
    asked = asked.groupBy("pattern", "size").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "part")).alias("k"))
    keyed = written(asked.where("found = size").select("pattern", F.col("k.part").alias("part")), "pattern-keys")
    per_word = held.join(keyed.select("part").distinct(), "part", "left_semi").groupBy("token").agg(F.collect_set("part").alias("parts"))
    # the parts of one word are substrings of it, so the list is bounded by the word
    met = tokens.join(per_word, "token").select("id", F.explode("parts").alias("part")).distinct()
    pairs = met.join(keyed, "part").select("id", "pattern", (F.col("part") == F.col("pattern")).alias("sure"))
    sure = pairs.where("sure").select("id", "pattern")
    open_ = pairs.where("not sure").select("id", "pattern").join(texts, "id").where(F.contains("body", "pattern")).select("id", "pattern").distinct()
    found = sure.unionByName(open_)
    blank = split.where("size(parts) = 0").select("pattern")
    if not blank.isEmpty():
        lists = blank.agg(F.collect_list("pattern")).scalar()
        tested = texts.withColumn("_blank", lists).select("id", F.explode(F.filter("_blank", lambda p: F.contains(F.col("body"), p))).alias("pattern"))
        found = found.unionByName(tested.distinct())
    return found


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Every row as often as its column ``times`` says, without that column.

    The copies are dealt to tasks in shares of ``COPIES``: few rows, or one, can make most of the result.
    """
    kept = written(rows.where(F.col(times) > 0), "to-repeat")
    total = kept.agg(F.sum(times)).first()[0] or 0
    width = max(kept.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    last = F.floor((F.col(times) - 1) / COPIES).cast("long")
    shares = kept.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(width)
    share = F.least(F.col(times) - F.col("_share") * COPIES, F.lit(COPIES)).cast("int")
    return shares.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), share))).drop(times, "_share", "_copy")
