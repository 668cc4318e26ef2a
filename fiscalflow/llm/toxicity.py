"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Folding: compatibility forms, look-alike letters of other scripts, invisible
characters, and digits or signs that stand for letters inside words; what is no
letter or digit becomes one space. Accents stay, as they tell words apart.

Lexicon: beginnings of words (and whole words where no beginning is clean) whose
share among the words of toxic documents is far above that among the others, learned
from labelled rows: at most ``TRAINING_ROWS`` expected, toxic and clean ones up to half of
them each, chosen by hash of the id, and from the stated words below. Its weight is a smoothed log ratio. Words and phrases that
hold an entry but belong to clean text are exceptions: matches inside them do not
count.

Score: the weights found, in all and per word of the text, go through a logistic
curve fitted to the same rows. labels, lang, source and doc_id are no inputs.

Defined cases: null text is empty, and an empty text has the score of no match;
rows without or with repeated doc_id are scored row by row; labels that repeat a
doc_id count once, toxic if any is, and of rows that repeat a labelled doc_id one is
learned from; without toxic labels the stated words and the
default curve serve; an empty table gives an empty result; other columns pass through
``keep`` untouched.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalflow.llm.common import batches, id_sample, id_text, materialize, sample_rate, texts_of

TRAINING_ROWS = 40_000
THRESHOLD = 0.3
SHORTEST, LONGEST = 4, 14
MIN_TOXIC = 8
MIN_PURITY = 0.97
STRICT_PURITY = 0.995
MIN_TEXTS = 5
LEAST_PURITY = 0.75  # counted by documents, near copies once; several weak matches add up

# Stated words and phrases (fixed values of this operator).
STATED_WEIGHT = 4.0
STATED = ("idiot", "moron", "imbecile", "scumbag", "dumbass", "asshole", "bastard", "retard", "cretin", "dipshit")
STATED_EXCEPTIONS = ("bastard file", "bastard sword", "flame retard", "fire retard", "retardant")
DEFAULT_CURVE = (-3.0, 1.0, 1.0)

# Look-alike letters of other scripts (fixed values), after lower case.
LOOK_ALIKES = str.maketrans({
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "l", "օ": "o", "ս": "u", "ᴢ": "z",
})
INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF])
STAND_INS = dict(zip("013457@$!|", "oieastasii"))
AS_L = dict.fromkeys("1!|", "l")
RARER = ({"2": "z", "6": "g", "8": "b", "9": "g"}, {"2": "z", "6": "b", "8": "b", "9": "g"})
ANY_STAND_IN = re.compile(r"[0-9@$!|]")
MIXED = re.compile(r"(?<![^\W_])[^\W\d_]*+[0-9@$!|](?:[^\W_]|[@$!|])*")
LETTER = re.compile(r"[^\W\d_]")
HEX = re.compile(r"(?:0x[0-9a-f]+|(?=(?:[a-f]*[0-9]){3})[0-9a-f]{8,})")
LATIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
WORDS = re.compile(r"[^\W_]+")


def unmask(text: str) -> list[str]:
    """Readings of ``text``: in words with a letter, but no hex strings, all stand-ins are
    letters; 1, ! and | may be i or l, and 2, 6, 8 and 9 themselves or letters."""
    met: set[str] = set()

    def core(m: re.Match) -> str:
        word = m[0].strip("!|")  # at the ends these are punctuation
        return word if LETTER.search(word) and not HEX.fullmatch(word) else ""

    for m in MIXED.finditer(text):
        met.update(core(m))
    if met.isdisjoint("0123456789@$!|"):
        return [text]
    maps = [STAND_INS] + ([STAND_INS | AS_L] if met & AS_L.keys() else [])
    rarer = RARER[: 2 if "6" in met else 1] if met & RARER[0].keys() else ()
    readings = []
    for table in [*maps, *(m | r for r in rarer for m in maps)]:
        table = str.maketrans(table)
        readings.append(MIXED.sub(lambda m: m[0].replace(core(m), core(m).translate(table), 1) if core(m) else m[0], text))
    return list(dict.fromkeys(readings))


def fold(text: str) -> list[str]:
    """The folded text, ``" word word "``, and further readings where a digit or sign may
    be another letter."""
    if not LATIN.fullmatch(text):
        text = unicodedata.normalize("NFKC", text.translate(INVISIBLE)).lower().translate(LOOK_ALIKES)
        marks = {c for c in set(text) if unicodedata.combining(c)}
        text = text.translate(dict.fromkeys(map(ord, marks))) if marks else text
    else:  # its forms are composed already and nothing in it looks like another letter
        text = text.lower()
    return [f" {' '.join(WORDS.findall(r))} " for r in (unmask(text) if ANY_STAND_IN.search(text) else [text])]


@dataclass(frozen=True)
class Model:
    entries: tuple[tuple[str, float], ...]  # " beginning" or " word " and weight
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]


@lru_cache(maxsize=4)
def automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    found = ahocorasick.Automaton()
    for pattern in exceptions:
        found.add_word(pattern, (len(pattern), None))
    for pattern, weight in entries:
        if pattern not in exceptions:
            found.add_word(pattern, (len(pattern), weight))
    if len(found):
        found.make_automaton()
    return found


def matched(text: str, entries, exceptions) -> tuple[float, int, int]:
    """Weight and number of the matches outside exceptions, and the words of ``text``."""
    machine, best = automaton(entries, exceptions), (0.0, 0)
    readings = fold(text)
    words = max(0, readings[0].count(" ") - 1) if readings[0].strip() else 0
    if not len(machine):
        return 0.0, 0, words
    for reading in readings:
        at: dict[int, float] = {}  # a word counts once, by its heaviest entry
        spared = []
        for end, (size, weight) in machine.iter(reading):
            begin = end - size + 1
            if weight is None:
                spared.append((begin, end))
            else:
                at[begin] = max(weight, at.get(begin, 0.0))
        hits = outside(at, spared)
        best = max(best, (sum(hits), len(hits)))
    return *best, words


def outside(at: dict[int, float], spans: list[tuple[int, int]]) -> list[float]:
    """Weights of the matches that begin in no span: one walk over both, by beginning."""
    hits, reach, next_span = [], 0, 0
    spans = sorted(spans)
    for begin in sorted(at):
        while next_span < len(spans) and spans[next_span][0] <= begin:
            reach = max(reach, spans[next_span][1])
            next_span += 1
        if begin >= reach:
            hits.append(at[begin])
    return hits


def features(weight, words) -> tuple:
    return np.log1p(weight), np.log1p(100 * weight / (np.asarray(words, float) + 20))


def score(weight, words, curve) -> np.ndarray:
    a, b, c = curve
    x, y = features(np.asarray(weight, float), words)
    return 1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30)))


# --- learning -----------------------------------------------------------------------

def class_rates(known: DataFrame, bound: int) -> tuple[float, float]:
    """Shares of the clean and the toxic labels to sample: up to half of ``bound`` each,
    so that few toxic rows among many clean ones are not thinned with them."""
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    return sample_rate(counts.get(0, 0), bound // 2), sample_rate(counts.get(1, 0), bound // 2)


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> tuple[DataFrame, float]:
    """``(toxic, text)`` of a bounded sample of labelled rows, one row per sampled id, and
    by how much its classes shift a score's logit. The sampled ids, at most about ``bound``
    longs, are broadcast: no text is shuffled, but where ids repeat. Of rows that repeat an
    id the text with the smallest XXH64 is taken."""
    known = labels.select(labels["doc_id"].cast("long").alias("label_id"), (labels["toxic"].cast("int") > 0).cast("int").alias("toxic")).dropna()
    known = known.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    clean, toxic = class_rates(known, bound)
    known = id_sample(known.filter("toxic = 0"), "label_id", clean, "toxicity").unionByName(
        id_sample(known.filter("toxic = 1"), "label_id", toxic, "toxicity")
    )
    shift = math.log(toxic / clean)
    texts = id_text(docs)
    rows = texts.join(F.broadcast(known), texts["doc_id"] == known["label_id"]).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    repeated = rows.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("first")).filter("n > 1")
    repeated = materialize(repeated.select(F.col("label_id").alias("repeated_id"), "first"), "toxicity-repeated")  # at most ``bound`` ids
    if repeated.isEmpty():
        return rows.select("toxic", "text"), shift
    marked = rows.join(F.broadcast(repeated), F.col("label_id") == F.col("repeated_id"), "left")
    once = marked.filter(F.col("digest") == F.col("first")).dropDuplicates(["label_id"])
    return marked.filter("repeated_id is null").select("toxic", "text").unionByName(once.select("toxic", "text")), shift


def word_counts(rows: DataFrame) -> DataFrame:
    """``(word, toxic, clean)``: in how many documents of each kind a folded word is."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def told() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *(pa.array([seen[k][w] for w in words], pa.int64()) for k in (1, 0))],
                ["word", "toxic", "clean"],
            )
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in batches(batches_in, 256):
            for kind, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                seen[int(kind > 0)].update(set(fold(text)[0].split()))
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield told()
        yield told()

    counted = rows.select("toxic", "text").mapInArrow(run, "word string, toxic long, clean long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def candidates(words: DataFrame) -> DataFrame:
    """``(pattern, toxic, clean)`` of word beginnings and of whole words of any length."""
    size = F.length("word")
    cuts = F.transform(
        F.sequence(F.lit(SHORTEST), F.least(size, F.lit(LONGEST))), lambda n: F.concat(F.lit(" "), F.substring(F.col("word"), F.lit(1), n))
    )
    whole = F.array(F.concat(F.lit(" "), F.col("word"), F.lit(" ")))
    return (
        words.select(F.explode(F.when(size >= SHORTEST, F.concat(cuts, whole)).otherwise(whole)).alias("pattern"), "toxic", "clean")
        .groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def purity(toxic: int, clean: int, toxic_docs: int, clean_docs: int) -> float:
    """Share of toxic documents among those with an entry, were both kinds as many."""
    t, c = toxic / max(1, toxic_docs), clean / max(1, clean_docs)
    return t / (t + c) if t else 0.0


def log_ratio(toxic: int, clean: int, toxic_docs: int, clean_docs: int) -> float:
    return math.log((toxic + 0.5) / max(1, toxic_docs)) - math.log((clean + 0.5) / max(1, clean_docs))


def choose(found: dict[str, tuple[int, int]], toxic_docs: int, clean_docs: int) -> dict[str, float]:
    """Entries and weights: from the shortest clean beginnings on to the longest ones
    that hold (nearly) the same documents, or whole words below impure beginnings. An
    entry that clean documents hold too gives way to its purer continuations if these
    hold nearly all its toxic ones."""
    children: dict[str, list[str]] = {}
    for p in found:
        children.setdefault(p[:-1], []).append(p)

    def pure(p: str, least: float = MIN_PURITY) -> bool:
        return found[p][0] >= MIN_TOXIC and purity(*found[p], toxic_docs, clean_docs) >= least

    def longest(p: str) -> str:
        while True:
            heir = [q for q in children.get(p, []) if not q.endswith(" ") and found[q][0] >= 0.95 * found[p][0]]
            if not heir:
                return p
            p = heir[0]

    taken = [p for p in found if p.endswith(" ") and len(p) < SHORTEST + 2 and pure(p)]  # words too short for a beginning
    todo = [p for p in found if len(p) == SHORTEST + 1 and not p.endswith(" ")]
    while todo:
        p = todo.pop()
        if not pure(p):
            todo += children.get(p, [])
            continue
        p = longest(p)
        purer = [q for q in children.get(p, []) if not q.endswith(" ") and pure(q, STRICT_PURITY)]
        if found[p][1] and sum(found[q][0] for q in purer) >= 0.85 * found[p][0]:
            taken += map(longest, purer)
        else:
            taken.append(p)
    return {p: log_ratio(*found[p], toxic_docs, clean_docs) for p in taken}


def signature(words: set[str]) -> int:
    """The least hash of a text's long words: the same for most near copies."""
    raw = [w.encode() for w in words if len(w) >= 8] or [" ".join(sorted(words)).encode()]
    return min(map(zlib.crc32, raw))


def recount(chosen: dict[str, float], held: list[list[str]], toxic: list[int], signatures: list[int]) -> dict[str, float]:
    """Entries again, near copies counted once: words that only the copies of one toxic
    text repeat are no entries."""
    kinds: list[set[int]] = [set(), set()]
    seen: dict[str, list[set[int]]] = {p: [set(), set()] for p in chosen}
    for patterns, kind, mark in zip(held, toxic, signatures):
        kinds[kind].add(mark)
        for p in patterns:
            seen[p][kind].add(mark)
    docs = len(kinds[1]), len(kinds[0])
    counts = {p: (len(some[1]), len(some[0])) for p, some in seen.items()}
    return {p: log_ratio(*n, *docs) for p, n in counts.items() if n[0] >= MIN_TEXTS and purity(*n, *docs) >= LEAST_PURITY}


def fit_curve(weight: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; slopes never negative."""
    if not 0 < toxic.sum() < len(toxic):
        return DEFAULT_CURVE
    x = np.column_stack([np.ones(len(weight)), *features(weight, words)])
    ridge = np.diag([1e-6, 0.1, 0.1])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Model:
    """Lexicon, exceptions and curve. What comes to the driver: beginnings that at
    least ``MIN_TOXIC`` toxic documents of the bounded sample hold, the words below
    the chosen ones that clean documents hold, and per sampled row the entries it holds
    and two numbers."""
    rows, shift = training_rows(docs, labels, bound)
    kinds = {r["toxic"]: r["count"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    stated = {f" {w}": STATED_WEIGHT for w in STATED}
    spared = {f" {w}" for w in STATED_EXCEPTIONS}
    if not kinds.get(1) or not kinds.get(0):
        return Model(tuple(sorted(stated.items())), tuple(sorted(spared)), DEFAULT_CURVE)
    words = word_counts(rows).persist()
    usual = candidates(words).filter(F.col("toxic") >= MIN_TOXIC)
    chosen = choose({r["pattern"]: (r["toxic"], r["clean"]) for r in usual.collect()}, kinds[1], kinds[0])
    tried = tuple(sorted(chosen.items()))

    def list_entries(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, place = automaton(tried, ()), {p: i for i, (p, _) in enumerate(tried)}
        for batch in batches(batches_in, 256):
            readings = [fold(t) for t in texts_of(batch.column(1))]
            held = [
                sorted({place[r[end - size + 1 : end + 1]] for r in some for end, (size, _) in machine.iter(r)}) if place else []
                for some in readings
            ]
            marks = [signature(set(some[0].split())) for some in readings]
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.list_(pa.int32())), pa.array(marks, pa.int64()), batch.column(0)], ["held", "mark", "toxic"]
            )

    lists = rows.mapInArrow(list_entries, "held array<int>, mark long, toxic int").collect()
    chosen = recount(
        chosen, [[tried[i][0] for i in r["held"]] for r in lists], [int(r["toxic"] > 0) for r in lists], [r["mark"] for r in lists]
    )
    heads = sorted({p[1:] for p in chosen if not p.endswith(" ")})
    if heads:
        clean = words.filter((F.col("clean") >= 3) & (F.col("toxic") * kinds[0] < F.col("clean") * kinds[1]))
        below = F.exists(F.lit(heads).cast("array<string>"), lambda h: F.startswith(F.col("word"), h))
        spared |= {f" {r['word']} " for r in clean.filter(below).collect()}
    words.unpersist()
    entries = tuple(sorted((stated | chosen).items()))
    exceptions = tuple(sorted(spared))

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_in, 256):
            found = [matched(t, entries, exceptions) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()), batch.column(0)],
                ["weight", "words", "toxic"],
            )

    seen = rows.mapInArrow(run, "weight double, words long, toxic int").toPandas()
    order = seen.sort_values(["weight", "words", "toxic"])
    curve = fit_curve(order["weight"].to_numpy(), order["words"].to_numpy(), (order["toxic"].to_numpy() > 0).astype(float))
    if curve is not DEFAULT_CURVE:  # back to the classes' shares among all labels
        curve = (curve[0] - shift, *curve[1:])
    return Model(entries, exceptions, curve)


# --- scoring ------------------------------------------------------------------------

def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, weight, n_matches, n_words)`` of every row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 512):
            found = [matched(t, model.entries, model.exceptions) for t in texts_of(batch.column(1))]
            weight, hits, words = ([f[i] for f in found] for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(score(weight, words, model.curve), pa.float64()),
                    pa.array(weight, pa.float64()), pa.array(hits, pa.int64()), pa.array(words, pa.int64()),
                ],
                ["doc_id", "score", "weight", "n_matches", "n_words"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, score double, weight double, n_matches long, n_words long")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, all columns as they were."""
    column = docs.columns.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 512):
            found = [matched(t, model.entries, model.exceptions) for t in texts_of(batch.column(column))]
            low = score([f[0] for f in found], [f[2] for f in found], model.curve) < threshold
            yield batch.filter(pa.array(low, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
