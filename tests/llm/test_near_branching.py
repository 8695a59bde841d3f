"""Chosen-path join where nodes branch: pairs are left to later levels one by one, and recall right above the threshold."""

import random

import numpy as np
import pandas as pd

from tallymark.llm import near_dedup as N
from test_ngram_join import grams


def tile(first_later):
    """x and y are equal and their node of tree 0 goes on; z is a class of its own that stands first."""
    rng = np.random.default_rng(0)
    one, other = (rng.integers(0, 1 << 16, N.HASHES).astype(np.uint16) for _ in range(2))
    rows = [(b"a", other, first_later, b"a"), (b"x", one, 1, b"x"), (b"y", one, 1, b"y")]
    return pd.DataFrame([{"node": 1, "tile": 0, "tree": 1, "later": later, "cls": cls, "outside": True, "role": 3, "n_shingles": 50, "tokens": t[: N.SHORT].astype("<u2").tobytes(), "more": t[N.SHORT :].astype(np.uint8).tobytes(), "component": component, "chunk": 0} for cls, t, later, component in rows])


def test_a_pair_is_left_out_only_by_its_own_nodes():
    for first in (0, 1):
        found = pd.concat(N._across(80, 16)(iter([tile(first)])))
        assert list(zip(found["a"], found["b"])) == [(b"x", b"y")]
    held = tile(1)
    held["later"] = 0  # tree 0 compares the pair itself
    assert sum(map(len, N._across(80, 16)(iter([held])))) == 0


def test_recall_right_above_the_threshold_where_nodes_branch(spark, monkeypatch):
    """160 texts with six tenths in common, two and two of similarity 0.80 to 0.82; every node above 8 classes branches."""
    monkeypatch.setattr(N, "WORK", 1)
    rng = random.Random(9)
    core = [f"c{i}" for i in range(240)]
    texts, pairs = {}, []
    while len(pairs) < 80:
        own = [f"p{len(pairs)}x{i}" for i in range(130)]
        a = core + own
        b = core + own[: -rng.randint(36, 40)] + [f"q{len(pairs)}x{i}" for i in range(rng.randint(34, 40))]
        x, y = grams(" ".join(a), 2), grams(" ".join(b), 2)
        if not 0.80 <= len(x & y) / len(x | y) <= 0.82:
            continue
        i = len(texts)
        texts |= {i: " ".join(a), i + 1: " ".join(b)}
        pairs.append((i, i + 1))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in N.near_duplicates(d, k=2, small=8).collect()}
    met = sum(found[a] == found[b] for a, b in pairs)
    assert set(found.values()) <= set(found) and all(found[i] in (i, i - 1) for i in found)  # nothing else is linked
    print("recall", met, "of", len(pairs))
    assert met >= 0.97 * len(pairs)
