"""Token alignment against the libraries over whole texts, all pairs of tokens compared by their byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tallymark.llm import alignment as A
from tallymark.llm.queries import QUERIES
from tallymark.llm.vocabulary import default_path

ODD = ["a", " a", "a ", "  a  b ", "\n\n a\n  b", "tab\t x", "a  b", "x  \n y", "<|endoftext|> and </s> <0x0A>", "日本語 и русский ü", "don't stop, 'll 12ab", " ", "   ", "a▁b", "é" * 40 + " fin", "x" * 3000, "  z", "a\x1c b", "🙂 🙂🙂", "é fi ﬁ"]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(default_path()), sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    return a, b


def spans(own, text, libraries):
    """Ids and byte ranges of both sides, or None where bytes differ. ``own`` gives the bytes of an id."""
    a, b = libraries
    whole = (" " + text).encode()
    sides = []
    for ids, size in ((a.encode(" " + text, add_special_tokens=False).ids, own.a_bytes), (b.encode(text), own.b_bytes)):
        if b"".join(size[i] for i in ids) != whole:
            return None
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(size[i])))
            at += len(size[i])
        sides.append(out)
    return sides


def brute(texts, libraries):
    own = A.aligner(default_path(), default_path("piece_bpe_32k.model"))
    links, counts, told = {}, Counter(), {}
    for key, text in texts.items():
        found = spans(own, text, libraries) if text else None
        if not found:
            told[key] = (0, 0, 0, "")
            links[key] = []
            continue
        x, y = found
        links[key], j = [], 0
        for i, p, q in x:
            while y[j][2] <= p:
                j += 1
            n = j
            while n < len(y) and y[n][1] < q:
                links[key].append((i, y[n][0]))
                n += 1
        counts.update(links[key])
        ends = sorted({t[2] for t in x} & {t[2] for t in y})
        shown, low = [], 0
        groups = [(e, [], []) for e in ends]
        for side, at in ((x, 1), (y, 2)):
            n = 0
            for i, _, q in side:
                while q > groups[n][0]:
                    n += 1
                groups[n][at].append(str(i))
        text_of = ";".join(",".join(g[1]) + "|" + ",".join(g[2]) for g in groups)
        told[key] = (len(x), len(y), len(groups), hashlib.sha256(text_of.encode()).hexdigest())
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return {k: (*told[k][:3], len(v), sum(counts[p] == top[p[1]] for p in v), sum(counts[p] for p in v), told[k][3]) for k, v in links.items()}


def test_query_equals_whole_texts(spark, sf, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_token_alignment"](spark, sf).collect()}
    assert got == brute(texts, libraries)


@pytest.mark.parametrize("few", [0, A.FEW])
def test_odd_texts_and_rows(spark, libraries, few, monkeypatch):
    rng = random.Random(3)
    more = ["".join(rng.choice(" \n\tab,é.'1<▁") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    texts = dict(enumerate([*ODD, *more, None, ""]))
    rows = [(i, t, None, None) for i, t in texts.items()]
    d = spark.createDataFrame(rows, "doc_id long, text string, num string, pair int")
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in A.align(d, few=few).collect()} == brute(texts, libraries)
    told = {r.doc_id: r.groups for r in A.token_groups(d).collect()}
    assert all(bool(told[i]) == bool(hashlib_of) for i, hashlib_of in ((i, v[6]) for i, v in brute(texts, libraries).items()))
    again = A.align(spark.createDataFrame([(None, "one two", None, None), (None, "one two", None, None)], d.schema), few=few).collect()
    assert len(again) == 2 and again[0] == again[1] and again[0].count_sum == 2 * again[0].n_links
    assert A.align(d.limit(0), few=few).collect() == []


def test_words_are_kept_for_two_generations(libraries, monkeypatch):
    monkeypatch.setattr(A, "STORE", 3)
    own = A.Aligner(default_path(), default_path("piece_bpe_32k.model"))
    texts = ["one two three four", "five two", "one six seven eight nine", "two two"]
    found = [f[:4] for text in texts for f in own.align([text])]
    fresh = A.Aligner(default_path(), default_path("piece_bpe_32k.model"))
    assert found == [f[:4] for f in fresh.align(texts)]
    assert len(own.now) + len(own.before) < 12
