"""Encoding with the tokenizers library, words remembered between texts.

A tokenizer that cuts texts into words before its merges gives a text the ids of its
words in a row, so the library need encode each distinct word only once per worker
instead of once per occurrence. ``Encoder`` does so for the rule it knows (below);
with any other tokenizer file it hands whole texts to the library.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers

from fiscalflow.llm.common import ragged

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
REMEMBERED_WORDS = 600_000
# Longer words are encoded each time, so that the memory of a worker is bounded.
REMEMBERED_CHARS = 128
# Fixed value: how the known tokenizer cuts words, after NFC and lower case.
KNOWN_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Printable ASCII, its white space and the letters of Latin-1: here NFC changes
# nothing, lower case is one letter for one, and \p{L}, \p{N}, \s are plain sets.
PLAIN = re.compile(r"[\t-\r\x20-~À-ÖØ-öø-ÿ]*")
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r\x20a-zß-öø-ÿ0-9]+")
GAP = re.compile(r"[\t-\r\x20]+")
AS_IS = "\x00"  # marks a stretch that the library cuts itself


class Encoder:
    """Ids of texts as the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str = WORD_BPE, remembered: int = REMEMBERED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per Spark task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.remembered = remembered
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._known(spec)
        if self.by_word:
            self.special = [t["content"] for t in spec["added_tokens"]]
            suffix = spec["model"]["end_of_word_suffix"]
            vocab = self.library.get_vocab(with_added_tokens=True)
            self.ends_word = np.zeros(1 + max(vocab.values()), bool)
            self.ends_word[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self._forget()

    def _known(self, spec: dict) -> bool:
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            normal == ["NFC", "Replace", "Lowercase"]
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"].get("Regex") == KNOWN_CUT
            and cuts[0]["behavior"] == "Removed"
            and cuts[0]["invert"]
            and not cuts[1]["use_regex"]
            and not cuts[1]["add_prefix_space"]
            and bool(spec["model"].get("end_of_word_suffix"))
            and spec.get("post_processor") is None
        )

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.used = 0  # ids in ``flat``
        self.known = 0  # words in ``starts`` and ``lengths``

    def _plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _words(self, text: str) -> list[str]:
        if self._plain(text):
            return PLAIN_WORD.findall(text.lower())
        out = []  # white space ends every word, so stretches between it stand alone
        for stretch in GAP.split(text):
            if stretch:
                out += PLAIN_WORD.findall(stretch.lower()) if self._plain(stretch) else [AS_IS + stretch]
        return out

    def _keep(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            larger = np.zeros(max(at + len(values), 2 * len(held)), held.dtype)
            larger[:at] = held[:at]
            setattr(self, name, larger)
            held = larger
        held[at : at + len(values)] = values

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter((i for ids in encoded for i in ids), np.uint32, int(lengths.sum())), lengths

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words encoded as one text; the library marks where each one ends."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            return self._one_by_one(words)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, words: list[str], encode) -> None:
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            ids, lengths = encode([w.removeprefix(AS_IS) for w in part])
            self._keep("flat", self.used, ids)
            self._keep("starts", self.known, self.used + np.cumsum(lengths) - lengths)
            self._keep("lengths", self.known, lengths)
            for k, word in enumerate(part, self.known):
                self.index[word] = k
            self.used += len(ids)
            self.known += len(part)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and each text's number of ids."""
        if not self.by_word:
            return self._one_by_one(texts)
        words = [self._words(t) for t in texts]
        if self.known > self.remembered or self.used > 16 * self.remembered:
            self._forget()
        index = self.index
        fresh = set(chain.from_iterable(words)).difference(index)
        self._learn([w for w in fresh if w[0] != AS_IS], self._together)
        self._learn([w for w in fresh if w[0] == AS_IS], self._one_by_one)
        of_text = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64, int(of_text.sum()))
        lengths = self.lengths[at]
        ids = self.flat[ragged(self.starts[at], lengths)]
        totals, ends = np.concatenate([[0], np.cumsum(lengths)]), np.cumsum(of_text)
        for word in fresh:
            if len(word) > REMEMBERED_CHARS:
                del index[word]
        return ids, totals[ends] - totals[ends - of_text]


@lru_cache(maxsize=4)
def encoder(path: str = WORD_BPE) -> Encoder:
    """One encoder per worker and tokenizer file."""
    return Encoder(path)


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` put after the ids of each text."""
    if end_id is None:
        return ids, lengths
    return np.insert(ids, np.cumsum(lengths), end_id).astype(np.uint32), lengths + 1
