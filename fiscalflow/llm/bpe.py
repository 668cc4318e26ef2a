"""Byte-level BPE, encoding and decoding, with batched numpy merge rounds.

The distinct words of a batch of documents lie in one flat array of symbols. Each
round finds the rank of every adjacent pair by binary search over the sorted pair
keys, takes each word's lowest rank by a segmented minimum, merges all its places
from left to right and drops words that have no pair left. Ids of words are
remembered per worker, and documents are gathered from them.

The vocabulary file is one of the tokenizers library's (byte-level BPE without a
normaliser): its merges, ids and special tokens are read, not the library's code.
Special tokens in a text get their own ids, as the library does by default; decoding
keeps them. Invalid UTF-8 in decoded bytes becomes U+FFFD, as there.

Defined cases: null text is empty and has no ids; rows without or with repeated
doc_id are encoded row by row; an empty table gives an empty result; other columns
are ignored. A very long text is one row's work; its distinct words are merged in
blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fiscalflow.llm.common import batches, id_text, ragged, texts_of

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
REMEMBERED_WORDS = 600_000
REMEMBERED_CHARS = 128
ROUND_BYTES = 4_000_000  # symbols merged together
NO_RANK = np.int64(1 << 60)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in vocabulary files: printable Latin-1
    characters for themselves, the others in order from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Bpe:
    def __init__(self, path: str = BYTE_BPE, remembered: int = REMEMBERED_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        of_symbol = {s: b for b, s in enumerate(symbols)}
        self.byte_id = np.array([vocab[s] for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        keys = left * self.size + right
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.merged = merged  # by rank
        spelled: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            spelled[i] = bytes(of_symbol[c] for c in token) if all(c in of_symbol for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            spelled[i] = content.encode()
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_length = np.array([len(x) for x in spelled], np.int64)
        self.spelled_start = np.cumsum(self.spelled_length) - self.spelled_length
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.known: list[np.ndarray] = []
        self.known_words = 0
        self.flat = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and each word's number of ids."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_symbol, done_word = [], []
        while len(symbol):
            ranks = np.full(len(symbol), NO_RANK)
            inner = np.flatnonzero(word[:-1] == word[1:])
            key = symbol[inner] * self.size + symbol[inner + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            ranks[inner[hit]] = self.rank[at[hit]]
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.concatenate([begins, [len(word)]]))
            lowest = np.repeat(np.minimum.reduceat(ranks, begins), lengths)
            idle = lowest == NO_RANK
            if idle.any():
                done_symbol.append(symbol[idle])
                done_word.append(word[idle])
                symbol, word, ranks, lowest = symbol[~idle], word[~idle], ranks[~idle], lowest[~idle]
                if not len(symbol):
                    break
            chosen = np.flatnonzero(ranks == lowest)
            # neighbours in a row ("aaa") overlap: every other one, from the left
            run = np.concatenate([[True], np.diff(chosen) > 1])
            first = chosen[run][np.cumsum(run) - 1]
            chosen = chosen[(chosen - first) % 2 == 0]
            symbol[chosen] = self.merged[ranks[chosen]]
            keep = np.ones(len(symbol), bool)
            keep[chosen + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done_symbol:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words)).astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        flats, lengths, block, held = [self.flat], [self.lengths], [], 0
        for w in raw:
            block.append(w)
            held += len(w)
            if held >= ROUND_BYTES:
                f, n = self.merge(block)
                flats.append(f)
                lengths.append(n)
                block, held = [], 0
        if block:
            f, n = self.merge(block)
            flats.append(f)
            lengths.append(n)
        self.flat, self.lengths = np.concatenate(flats), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        for k, w in enumerate(words):
            self.index[w] = self.known_words + k
        self.known_words += len(words)

    def split(self, text: str) -> list[str]:
        """Words of a text; special tokens stand as words of their own, marked."""
        if self.cuts is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out = []
        for k, part in enumerate(self.cuts.split(text)):
            out += ["\x00special:" + part] if k % 2 else self.words.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's number of ids."""
        words = [self.split(t) for t in texts]
        if self.known_words > self.remembered or len(self.flat) > 16 * self.remembered:
            self._forget()
        index = self.index
        fresh = set(chain.from_iterable(words)).difference(index)
        special = [w for w in fresh if w.startswith("\x00special:")]
        self._learn([w for w in fresh if not w.startswith("\x00special:")])
        for w in special:
            self.flat = np.concatenate([self.flat, [self.special[w[9:]]]])
            self.lengths = np.concatenate([self.lengths, [1]])
            self.starts = np.cumsum(self.lengths) - self.lengths
            index[w] = self.known_words
            self.known_words += 1
        of_text = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64, int(of_text.sum()))
        lengths = self.lengths[at]
        ids = self.flat[ragged(self.starts[at], lengths)]
        totals, ends = np.concatenate([[0], np.cumsum(lengths)]), np.cumsum(of_text)
        for w in fresh:
            if len(w) > REMEMBERED_CHARS:
                del index[w]
        return ids, totals[ends] - totals[ends - of_text]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included."""
        ids = np.asarray(ids, np.int64)
        raw = self.spelled[ragged(self.spelled_start[ids], self.spelled_length[ids])].tobytes()
        return raw.decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def bpe(path: str = BYTE_BPE) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 512):
            ids, lengths = bpe(path).encode(texts_of(batch.column(1)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids are none."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 512):
            out = [bpe(path).decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """Per row the number of ids and digests of ids and decoded text: encoding and
    decoding in one pass, so that the ids of the corpus are never written."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 512):
            model = bpe(path)
            ids, lengths = model.encode(texts_of(batch.column(1)))
            ends = np.cumsum(lengths)
            raw = ids.astype("<u4")
            spans = list(zip((ends - lengths).tolist(), ends.tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths),
                    pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in spans], pa.string()),
                    pa.array([hashlib.sha256(model.decode(ids[a:b]).encode()).hexdigest() for a, b in spans], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
