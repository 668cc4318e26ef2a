from __future__ import annotations

import random
import re
from collections import Counter

from fiscalflow.llm import quality_rules as qr
from llm_fixtures import make_docs, no_docs, odd_docs, odd_rows  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeats, len(covered), failed


def plain_verdict(text):
    """The rules in plain Python, each on its own."""
    text = text or ""
    words = WORD.findall(text)
    n, chars, symbols, repeats, _, failed = plain_measures(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = re.findall("[A-Za-z]", text)
    lettered = [w for w in words if re.search(r"[A-Za-z]|[^\x00-\x7f]", w)]
    echoes = sum(a == b for a, b in zip(words, words[1:]))
    return not (
        failed or symbols > 0.1 * n or repeats > 0.4 * len(lines) or chars < 2 * n or chars > 15 * n
        or sum(c.isupper() for c in letters) > 0.4 * len(letters) or len(lettered) < 0.5 * n or echoes > 0.2 * n or text.count("!") > 0.5 * n
    )


def random_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(["the", "Été", "of", "BIG", "x!", "a|b", "12", "longerword", "straße", "%%%"]) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.4 and len(words) > 10:
            words += words[: rng.randint(4, 12)] * rng.randint(1, 4)
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\n\n", "\x1c", "\xa0"]) for w in words))
    return out


def test_measures_and_verdict_match_plain_python(make_docs, odd_rows):
    rows = [(i, t) for i, t in enumerate(random_texts(300, 1))] + [(1000 + i, r[1]) for i, r in enumerate(odd_rows)]
    got = {r["doc_id"]: r for r in qr.judge(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_measures(text)
        assert r["kept"] == plain_verdict(text) and (r["rejected_by"] is None) == (r["kept"] or r["base_failed"])


def test_keep_passes_rows_through(odd_docs, odd_rows, no_docs):
    kept = qr.keep(odd_docs)
    assert kept.schema == odd_docs.schema
    want = [r[0] for r in odd_rows if plain_verdict(r[1])]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, want))
    assert qr.keep(no_docs).count() == 0 and qr.judge(no_docs).count() == 0


def test_order_is_by_rejections_per_second_and_does_not_change_the_verdict(make_docs):
    rules = (qr.Rule("never", lambda t: False), qr.Rule("short", lambda t: len(t.words) < 30), qr.Rule("all", lambda t: True))
    measured = {"never": (1e-6, 0.0), "short": (1e-5, 0.5), "all": (1e-3, 1.0)}
    assert [r.name for r in qr.in_order(rules, measured)] == ["short", "all", "never"]
    assert [r.name for r in qr.in_order(rules, {})] == ["never", "short", "all"]
    texts = random_texts(120, 2)
    verdicts = [[qr.first_rejection(qr.Text(t.encode()), order) is None for t in texts] for order in (qr.RULES, qr.RULES[::-1])]
    assert verdicts[0] == verdicts[1]
    found = qr.measure(make_docs(list(enumerate(texts))), rules)
    assert found["all"][1] == 1.0 and found["never"][1] == 0.0 and all(s >= 0 for s, _ in found.values())


def test_short_circuit_asks_no_further_rule():
    asked = []
    rules = tuple(qr.Rule(n, lambda t, n=n, out=out: asked.append(n) or out) for n, out in (("a", False), ("b", True), ("c", True)))
    assert qr.first_rejection(qr.Text(b"x"), rules) == "b" and asked == ["a", "b"]
