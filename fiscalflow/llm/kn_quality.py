"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

The model is over characters (n-grams of ``ORDER``), one per language, trained on all
text that the labels trust. White space is one space; start marks precede a text and
an end mark closes it. Below its single characters a language's model goes on with the
model of all languages' trusted text, so that a language with little trusted text leans
on that one, and a language without any uses it alone; no number of texts switches it.

A trusted document is scored under the same models without its own fold (one of
``FOLDS``, by a hash of the text, so that copies leave together). A document's ``place``
says which counts it is scored with: those without fold 0, 1, .. or, at ``FOLDS``, all.

Counts are tables: n-grams are counted per task first, then summed to one row per
(language, n-gram) with a count per fold. The lower orders are continuation counts made
from the order above, discounts come from the counts of counts, and a probability is a
chain of joins of the n-grams asked for with the counts, the sums of their contexts and
the order below; every step carries all places.

Scoring never shuffles one row per character. Each stretch of documents (``part``) asks
for its distinct n-grams, with the places that need them; the distinct n-grams of the
corpus are joined with the model shards once, and each part gets its answers back next to
its documents, where the logarithms are summed per document. A part holds about
``PART_CHARS`` characters, so that neither a language nor a source nor a repeated text
makes a large group.

A document is kept if its perplexity is at most its language's limit. The limit is the
``QUANTILE`` of the perplexities of the language's n trusted documents, shrunk towards
what all languages share, with the weights n and ``SHRINKAGE`` on the logarithms: shared
is the median of the language (itself shrunk towards the median of all) times the
``QUANTILE`` of all trusted documents' ratios to their language's median.

Both passes over the documents must see the same partitions: ``docs`` has to be a stored
table, and the number that Spark sizes its splits by is held fixed for the two passes, so
that executors that come or go between them change nothing. A part that asks for an n-gram
it has no answer for raises an error.

Defined cases: null text is empty (its end mark alone is scored); null language is a
language of its own; without any trusted text (outside a trusted document's own fold)
there is no perplexity and the document is kept; rows without or with repeated doc_id are
scored row by row; labels that repeat a doc_id trust it if all do; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalflow.llm.common import BROADCAST_IDS, batches, materialize, raw_texts, task_number, texts_of

ORDER = 4
PART_CHARS = 64_000_000
SLICE_CHARS = 2_000_000
QUANTILE = 0.99
FOLDS = 5
PLACES = range(FOLDS + 1)
SHRINKAGE = 200
ROUNDING = 1e-9  # relative
POOLED = ""  # stands for all languages where a table has one row per language
START, END = "\x02", "\x03"
MARKS = str.maketrans({START: " ", END: " "})
DENSE_CELLS = 1 << 26


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of the texts in a row, each after ``ORDER - 1`` start marks and with
    its end mark, and each text's number of n-grams."""
    lead = START * (ORDER - 1)
    clean = [" ".join(t.translate(MARKS).split()) for t in texts]
    flat = np.frombuffer("".join(lead + t + END for t in clean).encode("utf-16-le", "surrogatepass"), "<u2")
    sizes = np.fromiter((len(t.encode("utf-16-le", "surrogatepass")) // 2 + 1 if not t.isascii() else len(t) + 1 for t in clean), np.int64, len(clean))
    return flat, sizes


def grams(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (four 16-bit units in a signed long, first unit on top) and for
    each position that ends no start mark the number of its n-gram."""
    def dense(values: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        if cells > DENSE_CELLS:
            return np.unique(values, return_inverse=True)
        there = np.zeros(cells, bool)
        there[values] = True
        found = np.flatnonzero(there)
        number = np.zeros(cells, np.int32)
        number[found] = np.arange(len(found), dtype=np.int32)
        return found, number[values]

    symbols, one = dense(flat, 1 << 16)
    n = len(symbols)
    pairs, two = dense(one[:-1].astype(np.int64) * n + one[1:], n * n)
    m = len(pairs)
    ends = np.flatnonzero(flat[ORDER - 1 :] != ord(START))
    both, number = dense(two[ends].astype(np.int64) * m + two[ends + 2], m * m)
    spelled = (symbols[pairs // n].astype(np.uint64) << np.uint64(16)) | symbols[pairs % n].astype(np.uint64)
    keys = (spelled[both // m] << np.uint64(32)) | spelled[both % m]
    return keys.view(np.int64), number


def documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"),
        docs["text"].cast("string").alias("text"),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    known = labels.select(labels["doc_id"].cast("long").alias("trusted_id"), labels["quality"].cast("int").alias("quality")).dropna()
    return known.groupBy("trusted_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("trusted_id")


def placed(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """``documents(...)`` with their ``place``: the fold of a trusted row, else ``FOLDS``."""
    few = trusted.count() <= BROADCAST_IDS  # a checked size; beyond it the planner shuffles
    ids = F.broadcast(trusted) if few else trusted
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int")
    place = F.when(F.col("trusted_id").isNotNull(), fold).otherwise(FOLDS).alias("place")
    joined = rows.join(ids, rows["doc_id"] == ids["trusted_id"], "left").select("doc_id", "lang", "text", place)
    return joined if few else materialize(joined, "kn-placed")


def _summed(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their lines."""
    keys, back = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
    lines = np.concatenate([n for _, n in some])
    return keys, np.stack([np.bincount(back, weights=column, minlength=len(keys)) for column in lines.T], axis=1).astype(np.int64)


def count_grams(rows: DataFrame) -> DataFrame:
    """``(lang, gram, n0, n1, ..)`` of the trusted rows of ``placed(...)``: per n-gram its
    count without fold 0, without fold 1, .. and, last, with all folds."""
    folds = [f"n{k}" for k in range(FOLDS)]

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, some in held.items():
                keys, n = _summed(some)
                columns = [pa.array([lang] * len(keys), pa.string()), pa.array(keys), *map(pa.array, n.T.copy())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", *folds])
            held.clear()

        for langs, places, texts in _slices(batches_in, 0, 1, 2):
            for lang in set(langs):
                mine = [i for i, x in enumerate(langs) if x == lang]
                flat, sizes = units([texts[i] for i in mine])
                keys, number = grams(flat)
                fold = np.repeat(np.array([places[i] for i in mine]), sizes)
                counts = np.bincount(number.astype(np.int64) * FOLDS + fold, minlength=len(keys) * FOLDS)
                held.setdefault(lang, []).append((keys, counts.reshape(-1, FOLDS)))
            if sum(len(k) for some in held.values() for k, _ in some) > 1_000_000:
                for lang, some in held.items():
                    held[lang] = [_summed(some)]
                if sum(len(k) for some in held.values() for k, _ in some) > 1_000_000:
                    yield from told()
        yield from told()

    schema = "lang string, gram long, " + ", ".join(f"{n} long" for n in folds)
    per_task = rows.filter(F.col("place") < FOLDS).select("lang", "place", "text").mapInArrow(run, schema)
    summed = per_task.groupBy("lang", "gram").agg(*[F.sum(n).alias(n) for n in folds])
    total = sum((F.col(n) for n in folds[1:]), F.col(folds[0]))
    return summed.select("lang", "gram", *[(total - F.col(n)).alias(n) for n in folds], total.alias(f"n{FOLDS}"))


def _slices(rows: Iterator[pa.RecordBatch], lang: int, place: int, text: int) -> Iterator[tuple[list[str], list[int], list[str]]]:
    """Languages, places and texts of consecutive rows, up to about ``SLICE_CHARS``."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for batch in rows:
        for row in zip(batch.column(lang).to_pylist(), batch.column(place).to_pylist(), texts_of(batch.column(text))):
            for column, value in zip(held, row):
                column.append(value)
            size += len(row[2])
            if size >= SLICE_CHARS:
                yield held
                held, size = ([], [], []), 0
    if held[0]:
        yield held


def _runs(rows: list[int], texts: list[str]) -> Iterator[list[int]]:
    """``rows`` in runs of about ``SLICE_CHARS``."""
    some, size = [], 0
    for i in rows:
        some.append(i)
        size += len(texts[i])
        if size >= SLICE_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


# --- the model ------------------------------------------------------------------------

def suffix(gram: Column, order: int) -> Column:
    """The last ``order`` units."""
    return gram.bitwiseAND(F.lit((1 << 16 * order) - 1))


def _seen(column: str, times: int) -> Column:
    return F.sum(F.when(F.col(column) == times, 1).otherwise(0))


def _discount(k: int, f: int) -> Column:
    """Of n-grams seen ``k`` times, from the counts of counts; where they are too few for
    an estimate a half, and always between 0 and ``k``."""
    y = F.try_divide(F.col(f"t1_{f}"), F.col(f"t1_{f}") + 2 * F.col(f"t2_{f}"))
    estimate = k - F.try_divide((k + 1) * y * F.col(f"t{k + 1}_{f}"), F.col(f"t{k}_{f}"))
    return F.least(F.greatest(F.coalesce(estimate, F.lit(0.5)), F.lit(0.05)), F.lit(k - 0.05))


def order_tables(top: DataFrame) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """Per order from 1 to ``ORDER``: counts ``(lang, gram, n0, ..)`` (continuation counts
    below the highest order), context sums and discounts, each for every place."""
    counts = [top]
    for order in range(ORDER - 1, 0, -1):
        kinds = [F.sum(F.when(F.col(f"n{f}") > 0, 1).otherwise(0)).alias(f"n{f}") for f in PLACES]
        counts.insert(0, materialize(counts[0].groupBy("lang", suffix(F.col("gram"), order).alias("gram")).agg(*kinds), "kn-order"))
    out = []
    for table in counts:
        sums = []
        for f in PLACES:
            sums += [F.sum(f"n{f}").alias(f"total_{f}"), _seen(f"n{f}", 1).alias(f"one_{f}"), _seen(f"n{f}", 2).alias(f"two_{f}")]
            sums.append(F.sum(F.when(F.col(f"n{f}") >= 3, 1).otherwise(0)).alias(f"more_{f}"))
        contexts = table.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("context")).agg(*sums)
        times = table.groupBy("lang").agg(
            *[_seen(f"n{f}", k).alias(f"t{k}_{f}") for f in PLACES for k in (1, 2, 3, 4)],
            *[F.sum(F.when(F.col(f"n{f}") > 0, 1).otherwise(0)).alias(f"types_{f}") for f in PLACES],
        )
        discounts = times.select(
            "lang", *[f"types_{f}" for f in PLACES], *[_discount(k, f).alias(f"d{k}_{f}") for f in PLACES for k in (1, 2, 3)]
        )
        out.append((table, contexts, discounts))
    return out


def chain(asked: DataFrame, top: DataFrame) -> DataFrame:
    """``(lang, gram, a0, b0, ..)`` for distinct ``asked(lang, gram)``: under the counts
    ``top`` of the n-gram's language, its probability is ``a + b * base``, ``base`` being
    its probability below the single characters. Also ``types0, ..``, the number of single
    characters, null for a language that ``top`` does not know."""
    tables = order_tables(top)
    wanted = [asked]
    for order in range(ORDER - 1, 0, -1):
        wanted.insert(0, materialize(wanted[0].select("lang", suffix(F.col("gram"), order).alias("gram")).distinct(), "kn-wanted"))
    below: DataFrame | None = None
    types = [f"types_{f}" for f in PLACES]
    for order, ((counts, contexts, discounts), some) in enumerate(zip(tables, wanted), 1):
        rows = some.join(discounts, "lang", "left").join(counts, ["lang", "gram"], "left")
        rows = rows.withColumn("context", F.shiftrightunsigned("gram", 16)).join(contexts, ["lang", "context"], "left")
        if below is not None:
            rows = rows.drop(*types).withColumn("tail", suffix(F.col("gram"), order - 1)).join(
                below.select("lang", F.col("gram").alias("tail"), *types, *[F.col(f"{x}{f}").alias(f"lower_{x}{f}") for f in PLACES for x in "ab"]),
                ["lang", "tail"],
            )
        steps = []
        for f in PLACES:
            n, total = F.coalesce(f"n{f}", F.lit(0)), F.col(f"total_{f}")
            discount = F.when(n == 0, 0.0).when(n == 1, F.col(f"d1_{f}")).when(n == 2, F.col(f"d2_{f}")).otherwise(F.col(f"d3_{f}"))
            freed = F.col(f"d1_{f}") * F.col(f"one_{f}") + F.col(f"d2_{f}") * F.col(f"two_{f}") + F.col(f"d3_{f}") * F.col(f"more_{f}")
            known = total > 0
            kept, left = F.when(known, (n - discount) / total).otherwise(0.0), F.when(known, freed / total).otherwise(1.0)
            lower_a, lower_b = (F.lit(0.0), F.lit(1.0)) if below is None else (F.col(f"lower_a{f}"), F.col(f"lower_b{f}"))
            steps += [(kept + left * lower_a).alias(f"a{f}"), (left * lower_b).alias(f"b{f}")]
        below = rows.select("lang", "gram", *types, *steps)
        if order < ORDER:  # each order is a query of its own, small enough for the driver's plans
            below = materialize(below, "kn-below")
    return below


def log_probabilities(asked: DataFrame, top: DataFrame) -> DataFrame:
    """``(lang, gram, p0, ..)``: the logarithm of the probability for each place, of
    distinct ``asked(lang, gram)``; null where no text was trusted."""
    shared = top.groupBy("gram").agg(*[F.sum(f"n{f}").alias(f"n{f}") for f in PLACES]).withColumn("lang", F.lit(POOLED))
    grams_asked = asked.select(F.lit(POOLED).alias("lang"), "gram").distinct()
    # one place for symbols never seen
    base = [
        F.when(F.col(f"types_{f}") > 0, F.col(f"a{f}") + F.col(f"b{f}") / (F.col(f"types_{f}") + 1)).alias(f"base{f}") for f in PLACES
    ]
    pooled = materialize(chain(materialize(grams_asked, "kn-wanted"), materialize(shared, "kn-counts")).select("gram", *base), "kn-pooled")
    logs = [F.log(F.col(f"a{f}") + F.col(f"b{f}") * F.col(f"base{f}")).alias(f"p{f}") for f in PLACES]
    return chain(asked, top).join(pooled, "gram").select("lang", "gram", *logs)


# --- scoring ---------------------------------------------------------------------------

def asked_grams(rows: DataFrame) -> DataFrame:
    """``(part, code, lang, gram, places)``: the distinct n-grams of each part by language;
    ``code`` is the language's number among those of the part, in order, ``places`` has a
    bit for each place that asks."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        part = None

        def told() -> Iterator[pa.RecordBatch]:
            for code, lang in enumerate(sorted(held)):
                keys, places = held[lang]
                columns = [
                    pa.array([part] * len(keys), pa.int64()), pa.array([code] * len(keys), pa.int32()),
                    pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(places.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "code", "lang", "gram", "places"])
            held.clear()

        for at, batch in _parts(batches_in):
            if at != part:
                yield from told()
                part = at
            for langs, places, texts in _slices(iter([batch]), 1, 3, 2):
                for lang in set(langs):
                    mine = [i for i, x in enumerate(langs) if x == lang]
                    keys, needed = _needed([texts[i] for i in mine], [places[i] for i in mine])
                    if lang in held:
                        keys, needed = np.concatenate([held[lang][0], keys]), np.concatenate([held[lang][1], needed])
                        order = np.argsort(keys, kind="stable")
                        keys, needed = keys[order], needed[order]
                        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                        keys, needed = keys[first], np.bitwise_or.reduceat(needed, first)
                    held[lang] = keys, needed
        yield from told()

    return rows.mapInArrow(run, "part long, code int, lang string, gram long, places int")


def _needed(texts: list[str], places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts, ascending, and the bits of the places that hold them."""
    flat, sizes = units(texts)
    keys, number = grams(flat)
    needed, at = np.zeros(len(keys), np.uint8), np.repeat(np.array(places), sizes)
    for place in set(places):
        there = np.zeros(len(keys), bool)
        there[number[at == place]] = True
        needed |= there.astype(np.uint8) << np.uint8(place)
    order = np.argsort(keys)
    return keys[order], needed[order]


def _parts(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows with the number of their part: a task's rows in stretches of characters."""
    first, size = task_number() << 32, 0
    for batch in batches(rows, 512):
        yield first + size // PART_CHARS, batch
        size += int(np.sum([len(t) for t in texts_of(batch.column(2))]))


BLOCKS = "part long, doc_ids array<long>, langs array<string>, places binary, sizes array<int>, body binary"


def in_parts(rows: DataFrame) -> DataFrame:
    """The documents of each part in compressed blocks of rows: what the shuffle carries
    is about a third of the text."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in _parts(batches_in):
            raw = raw_texts(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch.column(1).to_pylist()], pa.list_(pa.string())),
                    pa.array([bytes(batch.column(3).to_pylist())], pa.binary()),
                    pa.array([list(map(len, raw))], pa.list_(pa.int32())),
                    pa.array([zstandard.compress(b"".join(raw), 6)], pa.binary()),
                ],
                ["part", "doc_ids", "langs", "places", "sizes", "body"],
            )

    return rows.mapInArrow(run, BLOCKS)


def _block(row: dict) -> tuple[list[int | None], list[str], list[int], list[str]]:
    raw, ends = zstandard.decompress(row["body"]), np.cumsum(row["sizes"]).tolist()
    return row["doc_ids"], row["langs"], list(row["places"]), [raw[a:b].decode() for a, b in zip([0, *ends], ends)]


def whole_parts(rows: DataFrame) -> DataFrame:
    """``rows`` in partitions of about ``PART_CHARS`` characters, but two per core at least:
    many small files would make as many small parts, each asking for the common n-grams.
    Partitions are put together without a shuffle."""
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    return rows.coalesce(max(-(-chars // PART_CHARS), 2 * rows.sparkSession.sparkContext.defaultParallelism))


@contextmanager
def same_splits(spark: SparkSession):
    """While it lasts, scans of the same files are cut into the same splits: Spark sizes
    them by the number of cores unless this setting names a number."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


SCORED = "doc_id long, lang string, perplexity double, n_grams long, trusted boolean"


def perplexities(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``(doc_id, lang, perplexity, n_grams, trusted)`` of every row of ``placed(...)``
    under the counts ``model`` of ``count_grams``, stored."""
    with same_splits(rows.sparkSession):
        rows = whole_parts(rows)
        asked = materialize(asked_grams(rows), "kn-asked")
        distinct = materialize(asked.select("lang", "gram").distinct(), "kn-wanted")
        logs = [F.when(F.col("places").bitwiseAND(F.lit(1 << f)) != 0, F.col(f"p{f}")).alias(f"p{f}") for f in PLACES]
        answers = asked.join(log_probabilities(distinct, model), ["lang", "gram"]).select("part", "code", "gram", "places", *logs)
        scored = in_parts(rows).groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_score, SCORED)
        return materialize(scored, "kn-scores")


def _score(documents_in: pa.Table, answers_in: pa.Table) -> pa.Table:
    """The documents of one part with the answers to its n-grams."""
    ids, langs, places, texts = [], [], [], []
    for at in range(documents_in.num_rows):
        for held, new in zip((ids, langs, places, texts), _block(documents_in.slice(at, 1).to_pylist()[0])):
            held += new
    codes, keys = (answers_in.column(c).to_numpy() for c in ("code", "gram"))
    order = np.lexsort((keys, codes))
    codes, keys, asked = codes[order], keys[order], answers_in.column("places").to_numpy()[order]
    logs = [answers_in.column(f"p{f}").to_numpy()[order] for f in PLACES]
    values, sizes = np.full(len(ids), np.nan), np.zeros(len(ids), np.int64)
    rows: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(langs, places)):
        rows.setdefault(key, []).append(i)
    code_of = {lang: code for code, lang in enumerate(sorted(set(langs)))}
    for (lang, place), mine in rows.items():
        first, end = np.searchsorted(codes, [code_of[lang], code_of[lang] + 1])
        known, needed, log_p = keys[first:end], asked[first:end], logs[place][first:end]
        for some in _runs(mine, texts):
            flat, n = units([texts[i] for i in some])
            sizes[some] = n
            grams_here, number = grams(flat)
            found = np.minimum(np.searchsorted(known, grams_here), max(len(known) - 1, 0))
            if not len(known) or (known[found] != grams_here).any() or not (needed[found] >> place & 1).all():
                raise RuntimeError("documents changed between the two passes: store them first")
            values[some] = np.exp(-np.add.reduceat(log_p[found][number], np.cumsum(n) - n) / n)
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "perplexity": pa.array(values, from_pandas=True),
            "n_grams": pa.array(sizes), "trusted": pa.array([p < FOLDS for p in places], pa.bool_()),
        }
    )


def limits(scored: DataFrame, quantile: float) -> tuple[DataFrame, DataFrame]:
    """``(lang, threshold)`` from the trusted rows of ``(lang, perplexity, trusted)``, and
    ``(threshold)``, one row, for languages without trusted rows."""
    logs = scored.filter("trusted and perplexity is not null").select("lang", F.log("perplexity").alias("x"))
    at = lambda q: F.percentile_approx("x", q, 10_000)
    of_lang = logs.groupBy("lang").agg(at(quantile).alias("own"), at(0.5).alias("median"), F.count(F.lit(1)).cast("double").alias("n"))
    spread = logs.join(of_lang.select("lang", "median"), "lang").agg(
        F.percentile_approx(F.col("x") - F.col("median"), quantile, 10_000).alias("spread")
    )
    shared = logs.agg(at(0.5).alias("all")).crossJoin(F.broadcast(spread))  # one row each
    shrunk = lambda own, common: (F.col("n") * own + SHRINKAGE * common) / (F.col("n") + SHRINKAGE)
    median = shrunk(F.col("median"), F.col("all"))
    threshold = F.exp(shrunk(F.col("own"), median + F.col("spread")))
    return (
        of_lang.crossJoin(F.broadcast(shared)).select("lang", threshold.alias("threshold")),
        shared.select(F.exp(F.col("all") + F.col("spread")).alias("shared")),
    )


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(doc_id, lang, perplexity, threshold, n_grams, kept)`` of every row of ``docs``."""
    rows = placed(documents(docs), trusted_ids(labels))
    model = materialize(count_grams(rows), "kn-counts")
    scored = perplexities(rows, model)
    of_lang, shared = limits(scored, quantile)
    judged = scored.join(of_lang, "lang", "left").crossJoin(F.broadcast(shared))
    threshold = F.coalesce("threshold", "shared")
    kept = F.coalesce(F.col("perplexity") <= threshold * (1 + ROUNDING), F.lit(True))
    return judged.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), "n_grams", kept.alias("kept"))
