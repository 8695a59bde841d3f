"""Exact n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from tallymark.llm import ngram_join as J
from tallymark.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def grams(text, k=3):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(texts, percent=90, k=3):
    own = {i: grams(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(i for i in own if own[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = own[a], own[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (len(own[i]), find(i)) for i in texts}


def result(found):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}


def test_query_equals_all_pairs(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert result(QUERIES["op13_ngram_join"](spark, sf)) == brute(texts)


def near(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("percent,small", [(90, 4), (80, 256), (90, 256)])
def test_groups_around_the_threshold(spark, percent, small):
    """Near copies on both sides of the threshold, chains, short texts and sizes at the edges of bands."""
    rng = random.Random(percent + small)
    texts = []
    for length in (3, 5, 11, 12, 13, 20, 40, 120, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for n in range(14):
            texts.append(near(rng, base, n % 7 * length // 100 + n % 3))
        chain = base
        for _ in range(6):
            chain = near(rng, chain, max(1, length // 90))
            texts.append(chain)
        texts += [base[: length - n] for n in range(3)] + [base + base[:1]]
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert result(J.ngram_components(d, percent=percent, small=small)) == brute(texts, percent)


def test_odd_rows_and_empty_tables(spark):
    long = " ".join(f"x{i % 977} y{i}" for i in range(20_000))
    rows = [(1, "a b c d"), (2, None), (3, ""), (4, " \n\t"), (None, "A b c d"), (5, "a B c\nd"), (5, "a b c d"), (6, "one"), (7, "ONE"), (8, long), (9, long + " end")]
    d = spark.createDataFrame([(*r, None, None, None) for r in rows], "doc_id long, text string, key string, num int, first string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in J.ngram_components(d).collect())
    n = len(grams(long))
    assert got == [(-1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 2, 1), (5, 2, 1), (6, 1, 6), (7, 1, 6), (8, n, 8), (9, n + 1, 8)]
    assert J.ngram_components(d.limit(0)).collect() == []


def test_every_link_shares_a_key_and_bitmaps_never_refuse_it():
    rng = np.random.default_rng(5)
    edges = J.band_edges(90)
    for n in (9, 10, 19, 57, 200, 1_000):
        for _ in range(40):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            most = J.widest_difference(2 * n, 90) // 2
            b = np.concatenate([a[most:], rng.integers(0, 2**64, most, dtype=np.uint64)])
            k = int(np.searchsorted(edges, n))
            parts = int(J.widest_difference(2 * int(edges[k]), 90)) + 1
            assert set(J.part_keys(a, k, parts).tolist()) & set(J.part_keys(b, k, parts).tolist())
            x, y = (np.frombuffer(J.parities(s, 256), "<u8") for s in (a, b))
            differ = np.array([int(np.bitwise_count(x ^ y).sum())])
            assert J._may_link(differ, np.array([n]), np.array([n]), 90).all()
