"""9. Token counts: long texts are encoded in overlapping chunks that are spliced where both sides provably agree.

A chunk's first ids may be wrong for lack of what stands before it, its last ones for lack of what follows. Two chunks
that overlap are spliced at a place p where a run of white space begins after other text, both encodings have a token
start at p, and ``AGREE`` ids on either side of p are the same in both. No pattern or merge of the supported
vocabularies reaches across such a place, so what each side has beyond p is what the whole text has. If no place in the
overlap will do, the overlap doubles; if it reaches the whole rest of the text, that rest is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import pick
from tallymark.llm.vocabulary import default_path, vocabulary

CHUNK, OVERLAP, AGREE = 32_768, 512, 4


def splice(text: str, left: tuple, right: tuple, low: int, after: int) -> tuple[int, int] | None:
    """Token numbers (in left, in right) at the last proven common place beyond code point ``low`` and token ``after`` of left."""
    (ls, li), (rs, ri) = left, right
    common, li_at, ri_at = np.intersect1d(ls, rs, return_indices=True)
    for p, i, j in zip(common[::-1].tolist(), li_at[::-1].tolist(), ri_at[::-1].tolist(), strict=True):
        b = p
        while b > low and text[b - 1].isspace():  # offsets may leave out the space that a token begins with
            b -= 1
        if b <= low or not text[b].isspace() or i <= max(after, AGREE) or j < AGREE or i + AGREE > len(li) or j + AGREE > len(ri):
            continue
        if np.array_equal(li[i - AGREE : i + AGREE], ri[j - AGREE : j + AGREE]):
            return i, j
    return None


def count_long(text: str, vocab, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` from chunks of ``chunk`` code points and more; exact for any chunk and overlap."""

    def encode(a: int, b: int) -> tuple:
        starts, ids = vocab.spans(text[a:b])
        return starts + a, ids

    start, end = 0, min(len(text), chunk)
    total, skip, left = 0, 0, encode(start, end)  # left counts from token ``skip`` on; ``total`` stand before that
    while end < len(text):
        over, found = overlap, None
        while not found and over < end - start:
            to = min(len(text), end - over + max(chunk, 2 * over))
            right = encode(end - over, to)
            if not (found := splice(text, left, right, end - over, skip)):
                over *= 2
        if found:
            total += found[0] - skip
            start, end, skip, left = end - over, to, found[1], right
        else:
            end = min(len(text), start + 2 * (end - start))
            left = encode(start, end)
    return total + len(left[1]) - skip


def token_counts(docs: DataFrame, doc_id="doc_id", text="text", path: str | None = None, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids and rows each get their row; an empty table gives
    an empty result; further columns are not read. No rows move between tasks; a task holds one batch of texts and,
    of a long text, one chunk's offsets.
    """
    path = path or default_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for b in batches:
            texts = b["text"].tolist()
            long = [len(t) > chunk for t in texts]
            few = iter(vocab.counts([t for t, far in zip(texts, long, strict=True) if not far]))
            n = [count_long(t, vocab, chunk, overlap) if far else next(few) for t, far in zip(texts, long, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": pd.array(n, "int64")})

    rows = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInPandas(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
