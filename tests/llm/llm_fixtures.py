"""Small tables with the awkward rows every operator has to take."""

import random
import re

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, kept string, spans string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" if rng.random() < 0.7 else rng.choice(["the", "of", "and", "é", "Ünd"]) for _ in range(n))


def awkward():
    """Nulls, empty, blank, long and repeated texts, ties, a hot source, repeated rows, clashing columns."""
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(6)]
    texts = [None, "", " \n\t ", "one", "two words", base[0], base[0], base[0].replace("the", "The"), base[1], base[1] + " tail",
             "\n".join(base[2:5]), prose(rng, 4000), "x" * 60_000, "a\x00b \x0b c\x1fd \x7f", "​ zero   width", base[5].upper(),
             "line one of a text\n" * 40, "😀 " * 80, "It's the cat's <|endoftext|> token ×÷", "y " * 3000]
    rows = [(i, t, "en", "hot", len(t or "")) for i, t in enumerate(texts)]
    rows += [(100, base[3], None, None, None), (101, base[3], "", "s2", 1), (101, base[3], "", "s2", 1), (None, base[4], "de", "hot", 5), (None, None, None, None, None)]
    return [(*r, "row", "score", "kept", None, "n") for r in rows]


def awkward_docs(spark):
    return spark.createDataFrame(awkward(), SHAPE)


def empty_docs(spark):
    return spark.createDataFrame([], SHAPE)
