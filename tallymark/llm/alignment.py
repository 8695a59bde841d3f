"""12. Cross-tokenizer alignment: hash-set intersection of cumulative token ends, by dictionaries from end to index.

The ends of A's and B's tokens are keys of two dictionaries. The keys that both have, sorted, slice both id lists into
groups; links, the pairs of tokens whose bytes overlap, are expanded slice by slice.

Where it is proven that both tokenizers cut before a space after other text, this is done once for a word and its
leading space and kept: A's pattern begins no piece but at its first character with a space after other text, and B has
no piece with a word mark after another character, so neither has a token, nor a merge, across such a place. Texts are
put together from words. Where a vocabulary gives no such proof a text is one word.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import pick
from tallymark.llm.vocabulary import default_path
from tallymark.session import cut, free

#: Words kept of a generation; words of the generation before are taken over when they are met again.
STORE, PART, JOINED, BITS = 200_000, 1 << 20, 128, 40
#: Id pairs whose counts are sent to every task at most, about 60 MB; beyond that they are joined by shuffle.
FEW = 1_000_000
_SPLIT = re.compile(r"(?<=\S)(?= +[^ ])").split
_RUN = re.compile(r"\s ").search


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def slices(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in A and in B of the ends that both have, in order. The dictionary from end to A's index is a table over the bytes."""
    index = np.full(int(a_ends[-1]) + 1, -1)
    index[a_ends] = np.arange(len(a_ends))
    met = index[b_ends]
    in_b = np.flatnonzero(met >= 0)
    return met[in_b], in_b


class Aligner:
    """Both vocabularies and the words aligned so far: numbers of ids and groups in one integer, the groups as text, links as packed pairs."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = _byte_letters()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.width = len(pieces)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        # An id as text with what follows it: inside its side of a group, and at the side's end.
        self.a_shown, self.b_shown = (np.array([[f"{i},", f"{i}{end}"] for i in range(len(own))], object) for own, end in ((self.a_bytes, "|"), (self.b_bytes, ";")))
        with open(path_a, encoding="utf-8") as f:
            raw = json.load(f)
        pre = raw.get("pre_tokenizer") or {}
        plain = raw.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.by_word = plain and not any("▁" in p.lstrip("▁") for p in pieces)
        self.now: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def words(self, text: str) -> list[str]:
        """What stands after the leading space of each word of space and ``text``."""
        if not self.by_word:
            return [text]
        whole = " " + text
        if _RUN(whole) or whole[-1] == " ":
            return [w[1:] for w in _SPLIT(whole)]
        return text.split(" ")

    def learn(self, words: set[str]) -> None:
        """Keeps all of ``words`` at hand; None stands for a word whose bytes a vocabulary doesn't give back."""
        if len(self.now) > STORE:
            self.now, self.before = {}, self.now
        new, alone = [], []
        for w in words - self.now.keys():
            if w in self.before:
                self.now[w] = self.before[w]
            elif self.by_word and w and not w[-1].isspace():
                new.append(w)
            else:
                alone.append(w)
        # Many new words are one text: it is cut between them as any other.
        groups = [new[i : i + JOINED] for i in range(0, len(new), JOINED)] + [[w] for w in alone]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            texts = [" ".join(g) for g in part]
            a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
            b = self.b.encode(texts, num_threads=1)
            if not self._keep([w for g in part for w in g], list(chain.from_iterable(a)), list(chain.from_iterable(b))):
                for g, x, y in zip(part, a, b, strict=True):
                    if not self._keep(g, x, y):
                        for w in g:
                            if len(g) == 1 or not self._keep([w], self.a.encode(" " + w, add_special_tokens=False).ids, self.b.encode(w)):
                                self.now[w] = None

    def _keep(self, words: list[str], a: list[int], b: list[int]) -> bool:
        """Keeps words, each after a space, that are these ids together; false where the ids' bytes aren't theirs."""
        whole = [(" " + w).encode() for w in words]
        data = b"".join(whole)
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return False
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        in_a, in_b = slices(a_ends, b_ends)
        ends = np.cumsum([len(w) for w in whole])
        last = np.searchsorted(a_ends[in_a], ends)  # the slice that ends with each word
        # Links: an A token meets the B tokens from the one that ends after its start to the one that reaches its end.
        low, high = np.searchsorted(b_ends, a_ends - self.a_sizes[a], "right"), np.searchsorted(b_ends, a_ends)
        n = high - low + 1
        links = np.cumsum(n)
        j = np.arange(links[-1]) - np.repeat(links - n, n) + np.repeat(low, n)
        packed = (np.repeat(a, n) * self.width + b[j]).astype("<i8").tobytes()
        # Groups as text: A's and B's ids of a slice one after the other.
        shown = np.empty(len(a) + len(b), object)
        for ids, own, mine, other, names in ((a, in_a, 0, in_b, self.a_shown), (b, in_b, 1, in_a, self.b_shown)):
            closes = np.zeros(len(ids), np.int64)
            closes[own] = 1
            group = np.cumsum(closes) - closes
            before = np.concatenate([[0], other + 1])[group + mine]
            shown[np.arange(len(ids)) + before] = names[ids, closes]
        shown = shown.tolist()
        a_to, b_to = in_a[last] + 1, in_b[last] + 1
        text_to, link_to = (a_to + b_to).tolist(), (8 * links[a_to - 1]).tolist()
        counts = [np.diff(x, prepend=0).tolist() for x in (a_to, b_to, last + 1)]
        p = q = 0
        for w, to, link, x, y, z in zip(words, text_to, link_to, *counts, strict=True):
            self.now[w] = (x << 2 * BITS | y << BITS | z, "".join(shown[p:to]), packed[q:link])
            p, q = to, link
        return True

    def align(self, texts: list[str | None]) -> Iterator[tuple | None]:
        """(n_a, n_b, n_groups, groups as text, distinct pairs, how often) of each text, None for one without tokens."""
        part: list[list[str]] = []
        held = 0
        for text in texts:
            part.append(self.words(text) if text else [])
            held += len(text or "")
            if held >= PART:
                yield from self._part(part)
                part, held = [], 0
        yield from self._part(part)

    def _part(self, part: list[list[str]]) -> Iterator[tuple | None]:
        self.learn(set().union(*part))
        get = self.now.__getitem__
        for own in part:
            found = list(map(get, own))
            if not own or None in found:
                yield None
                continue
            n = sum([f[0] for f in found])
            pairs, times = np.unique(np.frombuffer(b"".join([f[2] for f in found]), "<i8"), return_counts=True)
            yield n >> 2 * BITS, n >> BITS & (1 << BITS) - 1, n & (1 << BITS) - 1, "".join([f[1] for f in found])[:-1], pairs, times


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's own copy, loaded once."""
    return Aligner(path_a, path_b)


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model")


def token_groups(docs: DataFrame, doc_id="doc_id", text="text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, groups): the slices of both id lists as text, ``a1,a2|b1;a3|b2,b3``, '' for a text without tokens. See ``align``."""
    paths = _paths(path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[3] if f else "" for f in own.align(b.column("text").to_pylist())], pa.string())], ["doc_id", "groups"])

    rows = pick(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, groups string")


def align(docs: DataFrame, doc_id="doc_id", text="text", path_a: str | None = None, path_b: str | None = None, few: int = FEW) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level vocabulary that encodes space and text, B a sentencepiece model that adds the space itself. Both take
    the strings of special tokens as text. A link is a pair of an A and a B token whose bytes overlap; the count of an id pair is the
    number of its links in all rows, ``count_sum`` adds it up over a row's links, and ``n_best`` counts those links whose pair is
    its B id's most frequent, ties included.

    Null and empty texts, and those whose bytes either vocabulary doesn't give back, have no tokens: zeros and ''. Repeated
    rows and ids each count and get their row; an empty table gives an empty result; further columns are not read. A task
    holds the words and links of about a million characters, or of one longer text; what goes from there is a row per text
    with its distinct pairs, and a row per pair and task for the counts.
    """
    paths = _paths(path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        num = TaskContext.get().partitionId() << 36
        for b in batches:
            texts = b.column("text").to_pylist()
            for start in range(0, len(texts), 512):  # rows of pairs are put out in small batches
                found = list(own.align(texts[start : start + 512]))
                columns = [[f[i] if f else 0 for f in found] for i in range(3)]
                shown = [hashlib.sha256(f[3].encode()).hexdigest() if f else "" for f in found]
                pairs = pa.array([f[4] if f else [] for f in found], pa.list_(pa.int64()))
                times = pa.array([f[5] if f else [] for f in found], pa.list_(pa.int64()))
                links = [int(f[5].sum()) if f else 0 for f in found]
                arrays = [pa.array(range(num, num + len(found)), pa.int64()), b.column("doc_id").slice(start, len(found)), *[pa.array(c, pa.int64()) for c in (*columns, links)], pa.array(shown, pa.string()), pairs, times]
                yield pa.RecordBatch.from_arrays(arrays, ["num", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times"])
                num += len(found)

    rows = pick(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = cut(rows.mapInArrow(run, f"num long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, times array<long>"))
    width = _piece_count(paths[1])
    each = found.select("num", F.inline(F.arrays_zip("pair", "times")))
    counts = cut(each.groupBy("pair").agg(F.sum("times").alias("count")))
    own = counts.withColumn("b", F.col("pair") % width)
    best = own.groupBy("b").agg(F.max("count").alias("top"))  # a row for each id of B's vocabulary at most
    ranked = cut(own.join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best")))
    free(counts)
    known = F.broadcast(ranked) if ranked.count() <= few else ranked
    sums = each.join(known, "pair").groupBy("num").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    thin = found.select("num", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    none = F.lit(0).cast("long")
    return thin.join(sums, "num", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def _piece_count(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
