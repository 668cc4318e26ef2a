"""Quality rules as a short-circuit cascade.

A document is kept when no rule rejects it. The rules are tried one after another and
a document leaves at its first rejection, so the order sets the cost: each rule's
seconds and rejections are measured on a sample of the documents (at most
``SAMPLE_ROWS`` expected, chosen by hash of the id) and the rules are sorted by
rejections per second. The order never changes which documents are kept.

A rule sees a ``Text``, whose parts (words, lines, repeated windows) are worked out on
first use and shared by the rules that follow.

Defined cases: null text has no words (and fails the length rule); a text is judged
whole; rows without or with repeated doc_id are judged row by row; an empty table
keeps the given order and gives an empty result; other columns pass through
``keep`` untouched and are ignored elsewhere.
"""

from __future__ import annotations

import operator
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalflow.llm.common import batches, id_sample, id_text, raw_texts, sample_rate

WINDOW = 8
SAMPLE_ROWS = 2000
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
LETTERS = bytes([*range(65, 91), *range(97, 123)])
NO_LETTERS = bytes(b for b in range(128) if b not in LETTERS and b not in b" ")
CONTINUATION = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point


class Text:
    """One UTF-8 text and what the rules ask of it."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes: the six ASCII white-space characters

    @cached_property
    def line(self) -> bytes:
        return b" ".join(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, SPACES + CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in ``WINDOW``-word windows that the text holds twice or more."""
        n = len(self.words) - WINDOW + 1
        if n < 2:
            return 0
        one = np.fromiter(map(hash, self.words), np.int64, len(self.words)).view(np.uint64)
        mixed = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n]
        order = np.argsort(mixed, kind="stable")
        same = mixed[order][1:] == mixed[order][:-1]
        if not same.any():  # equal windows have equal hashes
            return 0
        at = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)
        begin = np.concatenate([[0], ends[:-1]])
        windows = [self.line[begin[i] : ends[i + WINDOW - 1] - 1] for i in at]
        times = Counter(windows)
        covered = np.zeros(len(self.words) + 1, np.int64)
        for i, w in zip(at, windows):
            if times[w] > 1:
                covered[i] += 1
                covered[i + WINDOW] -= 1
        return int((np.cumsum(covered[:-1]) > 0).sum())

    @cached_property
    def letters(self) -> tuple[int, int]:
        """ASCII letters, and how many of them are capitals."""
        no_small = len(self.raw.translate(None, LETTERS[26:]))
        no_capitals = len(self.raw.translate(None, LETTERS[:26]))
        return 2 * len(self.raw) - no_small - no_capitals, len(self.raw) - no_capitals

    @cached_property
    def n_letter_words(self) -> int:
        """Words with an ASCII letter or a character beyond ASCII."""
        return len(self.line.translate(None, NO_LETTERS).split())

    @cached_property
    def n_echoes(self) -> int:
        """Words equal to the word before."""
        return sum(map(operator.eq, self.words, self.words[1:]))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


# The two rules that any verdict starts from.
BASE = (
    Rule("few_words", lambda t: len(t.words) < 20),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * len(t.words)),
)
# Shares that prose of the languages at hand does not reach.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > len(t.words)),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 40 * len(t.lines)),
    Rule("word_length", lambda t: not 2 * len(t.words) <= t.word_chars <= 15 * len(t.words)),
    Rule("capitals", lambda t: 100 * t.letters[1] > 40 * t.letters[0]),
    Rule("letter_words", lambda t: 2 * t.n_letter_words < len(t.words)),
    Rule("echoes", lambda t: 5 * t.n_echoes > len(t.words)),
    Rule("exclamations", lambda t: 2 * t.raw.count(b"!") > len(t.words)),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Per rule its seconds and its rejections per document, each rule tried alone on
    every document of the sample. One row per rule comes to the driver."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 512):
            raw = raw_texts(batch.column(1))
            spent, rejected = [], []
            for rule in rules:
                began = time.perf_counter()
                rejected.append(sum(rule.rejects(Text(x)) for x in raw))
                spent.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.name for r in rules]), pa.array([len(raw)] * len(rules)), pa.array(spent), pa.array(rejected)],
                ["rule", "n", "seconds", "rejected"],
            )

    sample = id_sample(id_text(docs), "doc_id", sample_rate(docs.count(), sample_rows), "quality-rules")
    found = (
        sample.mapInArrow(run, "rule string, n long, seconds double, rejected long")
        .groupBy("rule").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
    )
    return {r["rule"]: (r["seconds"] / r["n"], r["rejected"] / r["n"]) for r in found.collect() if r["n"]}


def in_order(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Rules by rejections per second, most first; unmeasured ones stay last as given."""
    worth = {name: share / max(seconds, 1e-9) for name, (seconds, share) in measured.items()}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, -1.0)))


def plan(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    return in_order(rules, measure(docs, rules, sample_rows))


def first_rejection(text: Text, rules: tuple[Rule, ...]) -> str | None:
    """The cascade on one text."""
    for rule in rules:
        if rule.rejects(text):
            return rule.name
    return None


def keep(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they were."""
    ordered = plan(docs, rules, sample_rows)
    column = docs.columns.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 512):
            kept = [first_rejection(Text(x), ordered) is None for x in raw_texts(batch.column(column))]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row the base measures, ``base_failed``, the cascade's first rejection among
    ``rules`` (not tried where the base failed) and ``kept``."""
    ordered = plan(docs, rules, sample_rows)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 512):
            out: list[list] = [[] for _ in range(8)]
            for raw in raw_texts(batch.column(1)):
                t = Text(raw)
                failed = first_rejection(t, BASE) is not None
                rejected = None if failed else first_rejection(t, ordered)
                row = (
                    len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words,
                    failed, rejected, not failed and rejected is None,
                )
                for values, value in zip(out, row):
                    values.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept"],
            )

    return id_text(docs).mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, rejected_by string, kept boolean",
    )
