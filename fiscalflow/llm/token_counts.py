"""Token counts per section: whole documents are encoded once, and each token goes to
the section that its characters lie in.

Every token covers a span of characters (byte-level tokens cover the text without
gaps). The spans are joined with the sections' intervals by binary search, and a token
that crosses a border is allocated by a rule:

- ``start``: the section of its first character;
- ``most``: the section with most of its characters, ties to the earlier one;
- ``share``: every section by its share of the characters.

Sections tile the text: the characters between two sections (a line's end) belong to
the section before. So the counts of a document's sections add up to its tokens.

Defined cases: a text without characters has one empty section; null text is empty;
rows without or with repeated doc_id are counted row by row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalflow.llm.bpe import BYTE_BPE, bpe
from fiscalflow.llm.common import batches, id_text, texts_of

RULES = ("start", "most", "share")


def line_starts(text: str) -> list[int]:
    """Sections are lines: the first character of each, from 0."""
    out, at = [0], text.find("\n")
    while at >= 0:
        if at + 1 < len(text):
            out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def token_spans(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the character after its last, from its bytes;
    a token with part of a character covers that character."""
    ends = np.cumsum(sizes)
    heads = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
    character = np.cumsum(heads)  # of each byte, from 1
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return character[ends - sizes] - 1, character[ends - 1]


def allocate(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, given where tokens begin and end and sections start."""
    n = len(starts)
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(starts, end - 1, side="right") - 1
    out = np.bincount(first if rule == "start" else first[first == last], minlength=n).astype(float)
    if rule == "start":
        return out
    borders = np.append(starts, np.iinfo(np.int64).max)
    for t in np.flatnonzero(first != last).tolist():  # the few that cross a border
        sections = np.arange(first[t], last[t] + 1)
        inside = np.minimum(borders[sections + 1], end[t]) - np.maximum(borders[sections], begin[t])
        if rule == "share":
            out[sections] += inside / inside.sum()
        else:
            out[sections[np.argmax(inside)]] += 1
    return out


def count_sections(
    docs: DataFrame, starts_of: Callable[[str], list[int]] = line_starts, rule: str = "most", path: str = BYTE_BPE
) -> DataFrame:
    """``(doc_id, section, begin, length, n_tokens double, doc_tokens)``: one row per
    section of each row of ``docs``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 256):
            model, texts = bpe(path), texts_of(batch.column(1))
            ids, lengths = model.encode(texts)
            sizes, ends = model.spelled_length[ids], np.cumsum(lengths)
            out: list[list] = [[] for _ in range(6)]
            for k, (text, a, b) in enumerate(zip(texts, (ends - lengths).tolist(), ends.tolist())):
                starts = np.array(starts_of(text), np.int64)
                tokens = allocate(*token_spans(text.encode(), sizes[a:b]), starts, rule)
                n = len(starts)
                size = np.diff(np.append(starts, len(text)))
                for values, some in zip(out, ([k] * n, range(n), starts.tolist(), size.tolist(), tokens.tolist(), [b - a] * n)):
                    values.extend(some)
            kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64()]
            row, *columns = (pa.array(v, kind) for v, kind in zip(out, kinds))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), *columns], ["doc_id", "section", "begin", "length", "n_tokens", "doc_tokens"]
            )

    return id_text(docs).mapInArrow(
        run, "doc_id long, section long, begin long, length long, n_tokens double, doc_tokens long"
    )


def count_fields(rows: DataFrame, key: str, fields: list[str], joiner: str = "\n", rule: str = "most", path: str = BYTE_BPE) -> DataFrame:
    """``(doc_id, field, n_tokens)``: the fields of a row are joined to one text, encoded
    once, and its tokens are attributed to the fields (null fields are empty; the
    joiner belongs to the field before it)."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_in, 256):
            model, columns = bpe(path), [texts_of(c) for c in batch.columns[1:]]
            cells = list(zip(*columns))
            texts = [joiner.join(c) for c in cells]
            ids, lengths = model.encode(texts)
            sizes, ends = model.spelled_length[ids], np.cumsum(lengths)
            counts: list[float] = []
            for c, text, a, b in zip(cells, texts, (ends - lengths).tolist(), ends.tolist()):
                edges = np.cumsum([0, *[len(x) + len(joiner) for x in c[:-1]]])
                # without a joiner, empty fields start where the next one does: they get none
                begin, end = token_spans(text.encode(), sizes[a:b])
                keep = np.append(np.diff(edges) > 0, True)
                some = np.zeros(len(c))
                some[np.flatnonzero(keep)] = allocate(begin, end, edges[keep], rule)
                counts += some.tolist()
            n = len(fields)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), n))),
                    pa.array(fields * batch.num_rows, pa.string()), pa.array(counts, pa.float64()),
                ],
                ["doc_id", "field", "n_tokens"],
            )

    chosen = rows.select(F.col(key).cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return chosen.mapInArrow(run, "doc_id long, field string, n_tokens double")
