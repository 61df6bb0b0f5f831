"""Every window holds the target shares, whatever the length of the documents."""

import numpy as np
import pandas as pd

from metaloom.llm import packing


def served(n, weights, documents, before=None):
    """Windows by sources (tokens) of documents of ``n`` tokens."""
    sums = np.zeros(-(-n // packing.STEP), np.int32)
    own, ahead = before or (dict.fromkeys(weights, 0), 0)
    rows = [
        {"doc_id": i, "source": s, "n": n, "sums": sums, "turn": i, "part": 0, "no_id": False, "share": weights[s], "own_before": own[s], "all_before": ahead}
        for s in weights for i in range(round(documents * weights[s]))
    ]
    pieces = packing._serve(pd.DataFrame(rows), 512)
    assert pieces.length.sum() == n * len(rows)
    ends = (pieces.start + pieces.length)[pieces.start + pieces.length < n]
    assert (ends % packing.STEP == 0).all()
    return pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)


def off(windows, weights):
    middle = windows.iloc[2 : int(len(windows) * 0.9)]  # at the end the sources run dry
    return max((middle[s] - 512 * weights[s]).abs().max() for s in weights)


def test_long_documents_share_every_window():
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    for n in (100, 700, 5000, 5003):
        assert off(served(n, weights, 40 if n > 1000 else 400), weights) <= 4 * packing.STEP, n


def test_a_large_inherited_deficit_fills_no_windows():
    weights = {"a": 0.5, "b": 0.5}
    windows = served(5000, weights, 40, ({"a": 500_000, "b": 300_000}, 800_000))
    assert windows["b"].iloc[0] > windows["a"].iloc[0] and off(windows, weights) <= 4 * packing.STEP
