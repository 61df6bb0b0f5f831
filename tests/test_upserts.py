"""The upsert table: what a reader sees through compactions, repeats and crashes."""

import random

import pytest

from metaloom.streaming import upserts as U

KEYS = ["k"]


def batches(rng, n):
    return [[(rng.randrange(12), f"b{i}v{rng.randrange(9)}") for _ in range(1)] + [(50 + i % 3, f"b{i}")] for i in range(n)]


def expected(some):
    out = {}
    for rows in some:
        out.update(dict(rows))
    return sorted(out.items())


def frame(spark, rows):
    return spark.createDataFrame(list(dict(rows).items()), "k long, v string")


def seen(spark, root):
    return sorted(map(tuple, U.upserted(spark, root, KEYS, frame(spark, [(1, "")]).schema).collect()))


def test_readers_see_the_newest_rows_at_any_time(spark, tmp_path):
    root, some = str(tmp_path / "t"), batches(random.Random(1), 9)
    write = U.keep_upserts(root, KEYS, every=3)
    assert seen(spark, root) == []
    for i, rows in enumerate(some):
        write(frame(spark, rows), i)
        assert seen(spark, root) == expected(some[: i + 1])
    assert U.published(root) == [2, 5, 8]
    # old batches are gone, the generation holds a row per key
    assert min(U._folders(f"{root}/log", "batch")) > 5 and U._folders(f"{root}/generations", "upto") == [5, 8]
    assert spark.read.parquet(f"{root}/generations/upto=8").count() == len(expected(some))


def test_repeats_and_crashes_change_nothing(spark, tmp_path, monkeypatch):
    root, some = str(tmp_path / "t"), batches(random.Random(2), 6)
    write = U.keep_upserts(root, KEYS, every=3)
    for i, rows in enumerate(some[:5]):
        write(frame(spark, rows), i)
        write(frame(spark, rows), i)
        assert seen(spark, root) == expected(some[: i + 1])
    # the generation is written, but the driver dies before its manifest is
    create = type(spark).createDataFrame
    def dies(self, data, schema=None, *a, **k):
        if schema == "upto long":
            raise RuntimeError("lost")
        return create(self, data, schema, *a, **k)
    monkeypatch.setattr(type(spark), "createDataFrame", dies)
    with pytest.raises(RuntimeError):
        write(frame(spark, some[5]), 5)
    assert U.published(root) == [2]
    assert seen(spark, root) == expected(some)
    monkeypatch.undo()
    write(frame(spark, some[5]), 5)
    assert U.published(root) == [2, 5] and seen(spark, root) == expected(some)
