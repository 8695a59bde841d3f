"""Public tokenizers inside tasks: exact ids and counts, with a bounded store of pieces already encoded."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np

#: In texts of these characters alone the byte-level pattern splits exactly as ``_PIECES`` does (tests hold both together).
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\n -~{_LETTERS}]*").fullmatch
_PIECES = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'(?:[sdmt]|ll|ve|re)| ?[!-/:-@\[-`{{-~]+|[ \n]+(?![^ \n])|[ \n]+").findall
STORE, JOINED, PART = 1_000_000, 200, 1 << 20


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class JsonVocabulary:
    """A tokenizers file. ``ids``: little-endian 32-bit ids of each text, as the library gives them without added tokens.

    Where the file is plain byte-level, pieces between its pattern's boundaries are encoded once and kept: words of a
    corpus repeat, so most texts are put together from the store. Texts outside the plain alphabet, or with the string
    of an added token, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.size = self.lib.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        pre = raw.get("pre_tokenizer") or {}
        self.plain = raw.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.special = [t["content"] for t in raw.get("added_tokens", [])]
        self.store: dict[str, bytes] = {}
        if self.plain:
            self.width = np.zeros(self.size, np.int64)
            for token, i in self.lib.get_vocab().items():
                self.width[i] = len(token)  # byte-level tokens have a character a byte

    def _learn(self, new: set[str]) -> None:
        spaced = [p for p in new if p[0] == " " and p[1:].isalpha()]
        other = list(new.difference(spaced))
        groups = [spaced[i : i + JOINED] for i in range(0, len(spaced), JOINED)]
        if groups:
            found = [np.array(e.ids, "<u4") for e in self.lib.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)]
            ids = np.concatenate(found)
            ends = np.cumsum(np.fromiter((len(p.encode()) for p in spaced), np.int64, len(spaced)))
            cuts = (4 * (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1)).tolist()
            data = ids.tobytes()
            self.store.update(zip(spaced, map(data.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        for p, e in zip(other, self.lib.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.store[p] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """In parts of about ``PART`` code points: the pieces of a whole batch would need much memory."""
        out: list[bytes] = []
        part: list[str] = []
        held = 0
        for t in texts:
            part.append(t)
            held += len(t)
            if held >= PART:
                out += self._ids(part)
                part, held = [], 0
        return out + self._ids(part)

    def _ids(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        easy = [i for i, t in enumerate(texts) if self.plain and _PLAIN(t) and not any(s in t for s in self.special)]
        hard = sorted(set(range(len(texts))).difference(easy))
        for i, e in zip(hard, self.lib.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        pieces = {i: _PIECES(texts[i]) for i in easy}
        if len(self.store) > STORE:
            self.store = {}
        self._learn(set(filterfalse(self.store.__contains__, chain.from_iterable(pieces.values()))))
        get = self.store.get
        for i, own in pieces.items():
            out[i] = b"".join(map(get, own))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.ids(texts)]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start of each token in code points, and its id."""
        e = self.lib.encode(text, add_special_tokens=False)
        return np.array([a for a, _ in e.offsets], np.int64), np.array(e.ids, np.int64)


class PieceVocabulary:
    """A sentencepiece model, without begin or end ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.lib.get_piece_size()

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self.lib.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.ids(texts)]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.lib.encode(text, return_type="proto").pieces
        ends = np.cumsum([len(p.surface) for p in pieces], dtype=np.int64)  # the library's own offsets are in bytes
        return np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(pieces)], np.array([p.id for p in pieces], np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> JsonVocabulary | PieceVocabulary:
    """The worker's own copy, loaded once."""
    return PieceVocabulary(path) if path.endswith(".model") else JsonVocabulary(path)
