from __future__ import annotations

import random

import pytest

from fiscalflow.llm import html_extract as he

SCHEMA = "page_id long, url string, html string, text string, host string, part int, main string, keys string"


@pytest.fixture(scope="module")
def make_pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "t", "h", 1, "m", "k") for r in rows], SCHEMA)


def texts(pages):
    return {r["page_id"]: r["text"] for r in he.extract(pages).collect()}


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p><b>First&nbsp;&nbsp;line<br>goes
on.<p>Second <i>one</i>&hellip;<div class="share-bar">Share</div><aside>Aside</aside>
<form><input value="x">Mail</form><section class="comments"><p>First!</p></section><p>Last &lt;p&gt;</article>
<footer>&copy; site</footer></body></html>"""


def test_declared_article(make_pages):
    got = texts(make_pages([(1, "http://a.example/x", ARTICLE)]))
    assert got == {1: "A & B\n\nFirst line goes on.\n\nSecond one…\n\nLast <p>"}


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("a < b and <c", "a < b and <c"),
        ("<article>x</article><p>out</p>", "x"), ("<nav>menu<article>body</article>", "body"), ("<main><p>m</p></main>tail", "m"),
        ('<div role="main">r</div><p>o</p>', "r"), ("<!-- a <p>b</p> -->c", "c"), ("<script>if (a<b) x='</p>'", ""),
        ('<p title="a>b">c</p>', "c"), ("<article><nav>n</nav></article>", ""), ("<article><header><h1>H</h1></header>b</article>", "H\n\nb"),
        ('<article><div class="post-header">h</div><div class="x has-sidebar">b</div><div id="left-sidebar">s</div></article>', "h\n\nb"),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "a\n\nb"), ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
    ],
)
def test_markup(page, text):
    lines = he.lines_of(page or "")
    main = [x for x, kind in lines if kind == he.MAIN]
    kept = main if "article" in (page or "") else main or [x for x, kind in lines if kind == he.OPEN]
    assert "\n\n".join(kept) == text


@pytest.mark.parametrize(
    "inner, text",
    [
        ('<p>a <a href="/hidden/valley">b</a></p>', "a b"), ('<p title="The hidden cost">c</p>', "c"), ('<p data-hidden="false">d</p>', "d"),
        ('<p data-id="comments">e</p>', "e"), ('<p>f <a href="/x?id=reply">g</a></p>', "f g"), ("<p title=x hidden>h</p>i", "i"),
        ('<h2 id="related-work">j</h2>', "j"), ('<h2 id="social-history">k</h2>', "k"), ('<div class="market-share">l</div>', "l"),
        ('<section id="notice-period">m</section>', "m"), ('<section id="modal-logic">n</section>', "n"), ('<h2 id="comments">o</h2>', "o"),
        ('<div class="related-posts">no</div><ul class="main-menu-x nav">no</ul><div id="comments">no</div><p class="cookie-notice">no</p>p', "p"),
    ],
)
def test_attributes_and_names_of_ordinary_text(inner, text):
    assert "\n\n".join(x for x, kind in he.lines_of(f"<article>{inner}</article>") if kind == he.MAIN) == text


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 14))] for _ in range(2))
        in_a, in_b = he.shared_lines(a, b)
        assert [a[i] for i in in_a] == [b[j] for j in in_b] and len(in_a) == longest_common(a, b)
        assert in_a == sorted(set(in_a)) and in_b == sorted(set(in_b))


def page(host, n, body, notice="We use biscuits", foot="All about us"):
    return f"<body><p>{notice}</p><div>Top stories</div>{''.join(f'<p>{x}</p>' for x in body)}<div>{foot}</div></body>"


def test_differencing_deletes_shared_lines_of_neighbours(make_pages):
    rows = [(i, f"http://h{i % 2}.example/a/{i:03d}?q={i}", page("h", i, [f"story {i} one", f"story {i} two", "a common saying"])) for i in range(24)]
    got = texts(make_pages(rows).repartition(3))
    assert got == {i: f"story {i} one\n\nstory {i} two" for i in range(24)}


def test_copies_and_single_pages_keep_their_lines(make_pages):
    same = page("c", 1, ["x one", "x two"])
    rows = [(1, "http://c.example/1", same), (2, "http://c.example/2", same), (3, "http://solo.example/", page("s", 3, ["only"]))]
    whole = "We use biscuits\n\nTop stories\n\nx one\n\nx two\n\nAll about us"
    assert texts(make_pages(rows)) == {1: whole, 2: whole, 3: "We use biscuits\n\nTop stories\n\nonly\n\nAll about us"}


def test_runs_of_copies_are_cleaned_by_the_next_other_page(make_pages):
    rows = [(i, f"http://c.example/{i:03d}", page("c", i, [f"story {i // 40} one", f"story {i // 40} two"])) for i in range(120)]
    assert texts(make_pages(rows).repartition(3)) == {i: f"story {i // 40} one\n\nstory {i // 40} two" for i in range(120)}


def test_near_copies_keep_their_article_and_lose_the_template(make_pages):
    rows, want = [], {}
    for i in range(30):
        story = i // 3
        body = [f"paragraph {k} of story {story} " + "goes on and on " * 6 for k in range(5)] + [f"revision {i}"]
        rows.append((i, f"http://n.example/{i:03d}", page("n", i, body)))
        want[i] = "\n\n".join(x.strip() for x in body)
    assert texts(make_pages(rows).repartition(3)) == want


def test_long_runs_over_block_borders(make_pages):
    long = "a paragraph that is long enough to count as one of the long lines "
    rows = [(i, f"http://b.example/{i:04d}", page("b", i, [f"{long}{i // 10}", f"{long}{i // 10} too", f"line {i}"])) for i in range(400)]
    assert texts(make_pages(rows).repartition(4)) == {
        i: f"{long}{i // 10}\n\n{long}{i // 10} too\n\nline {i}" for i in range(400)
    }


@pytest.mark.parametrize("reach, others", [(he.REACH, 3), (4, 1), (4, 0)])
def test_runs_longer_than_any_reach(make_pages, reach, others):
    """300 near copies in a row: the pages in their middle ask ever further, down to the
    ends of the host; where there are no other pages, nothing tells."""
    long = "a paragraph that is long enough to count as one of the long lines "
    rows, want = [(900, "http://z.example/", page("z", 0, ["alone"]))], {900: "We use biscuits\n\nTop stories\n\nalone\n\nAll about us"}
    for i in range(300):
        other = i < others or i >= 300 - others
        body = [f"{long}{i if other else 'same'}", f"{long}{i if other else 'same'} too", f"line {i}"]
        rows.append((i, f"http://b.example/{i:04d}", page("b", i, body)))
        text = "\n\n".join(body)
        want[i] = text if others else f"We use biscuits\n\nTop stories\n\n{text}\n\nAll about us"
    got = {r["page_id"]: r["text"] for r in he.extract(make_pages(rows).repartition(4), reach).collect()}
    assert got == want


def test_articles_that_share_lines_stay_whole(make_pages):
    rows = [(i, f"http://a.example/{i}", f"<nav>m</nav><article><p>shared passage</p><p>own {i % 2}</p></article><footer>f</footer>") for i in range(8)]
    assert texts(make_pages(rows)) == {i: f"shared passage\n\nown {i % 2}" for i in range(8)}


def test_url_parts():
    assert he.url_parts("HTTPS://WWW.Example.com/a/B?x=1#y") == ("www.example.com", "/a/B")
    assert he.url_parts(None) == he.url_parts("") == ("", "")


def test_odd_rows(make_pages):
    rows = [
        (1, None, None), (2, "", ""), (None, "http://a.example/", "<p>x</p>"), (3, "http://a.example/z", "<p>y</p>"), (3, "http://a.example/z", "<p>y</p>"),
        (4, "not a url", "<article>" + "<p>w</p>" * 20_000 + "</article>"), (5, "http://b.example/", "<p>" + "v " * 200_000 + "</p>"),
    ]
    pages = make_pages(rows)
    got = he.extract(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert by[1, None] == by[2, ""] == "" and by[None, "http://a.example/"] == "x" and by[4, "not a url"].count("w") == 20_000
    assert len(by[5, "http://b.example/"]) == 399_999
    assert he.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("inner, blocks", [
    ("<p>Press <button>Go</button> now</p>", ["Press now"]),
    ('<p>A <span class="alert">B</span> C</p>', ["A C"]),
    ("<p>A <label>x <b>y</b></label><i>C</i></p><p>D</p>", ["A C", "D"]),
    ("<p>A <span hidden>B<div>C</div>D</span> E</p>", ["A E"]),
    ("<p>open <button>never closed</p><p>next</p>", ["open", "next"]),
    ("text <select><option>1</option></select> goes on <svg><text>t</text></svg>here", ["text goes on here"]),
    ("<p>A <b>bold</b> and <a class='link'>link</a>.</p>", ["A bold and link."]),
])
def test_inline_boilerplate_goes_and_cuts_no_sentence(inner, blocks):
    page = f"<html><body><nav>menu</nav><article>{inner}</article><footer>end</footer></body></html>"
    assert [line for line, kind in he.lines_of(page) if kind == he.MAIN] == blocks


def test_lines_of_declared_pages_go_through_the_alignment(make_pages):
    """Menus and footers that neighbours share are deleted by differencing, what only one
    page has by markup, and shared lines of an article are put back."""
    rows = [
        (i, f"http://d.example/{i}", f"<nav>menu</nav><div class='ad'>buy {i}</div><article><p>a saying</p><p>own {i}</p></article><p>more</p><footer>f</footer>")
        for i in range(6)
    ]
    got = he.extract(make_pages(rows).repartition(2)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"a saying\n\nown {i}" for i in range(6)}
    assert {(r["lines_shared"], r["lines_by_markup"], r["lines_put_back"]) for r in got} == {(3, 1, 1)}
    alone = he.extract(make_pages(rows[:1])).first()
    assert alone["text"] == "a saying\n\nown 0" and (alone["lines_shared"], alone["lines_by_markup"], alone["lines_put_back"]) == (0, 4, 0)


def test_pages_without_an_article_by_the_template_of_one_that_has(make_pages):
    rows = [
        (1, "http://m.example/1", "<p>menu</p><article><p>the story</p><p>x</p></article><p>foot</p>"),
        (2, "http://m.example/2", "<p>menu</p><p>the story</p><p>y</p><p>foot</p>"),
    ]
    assert texts(make_pages(rows)) == {1: "the story\n\nx", 2: "the story\n\ny"}


def test_large_alignments_are_cut_and_stay_longest():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        in_a, in_b = he.shared_lines(a, b, cells=6)
        assert [a[i] for i in in_a] == [b[j] for j in in_b] and len(in_a) == longest_common(a, b)


LONG = "a paragraph that is long enough to count as one of the long lines "


def run_of(kind, i):
    """A page of a long run: near copies of one story, pages that contain each other with
    another notice each, or near copies of their neighbours that drift."""
    if kind == "copies":
        return page("r", i, [f"{LONG}same", f"{LONG}same too", f"line {i}"])
    if kind == "contained":
        return f"<div class='ad'>buy {i}</div><p>sign in</p><div>about us</div>"
    return page("r", i, [*(f"{LONG}{k}" for k in range(i // 8, i // 8 + 12)), f"line {i}"])


def one_by_one(pages):
    """Shared lines of every page, by asking one page after the other to the ends."""
    out = {}
    for i, p in enumerate(pages):
        found = set()
        for others in (pages[:i][::-1], pages[i + 1 :]):
            found.update(he._ask(p, others, lambda other: he._aligned(p, other))[0])
        if found:
            out[p.content] = sorted(found)
    return out


@pytest.mark.parametrize("kind, lone", [("copies", [45, 150]), ("copies", [201]), ("contained", [77]), ("drifting", [100])])
def test_a_page_that_stands_alone_within_a_run_is_asked(make_pages, monkeypatch, kind, lone):
    """The nearest page that tells something is found wherever it stands, also in a tree of
    many levels; all pages are as if they had asked one page after the other."""
    monkeypatch.setattr(he, "BITS", 2, raising=False)
    rows = [(i, f"http://r.example/{i:04d}", run_of(kind, i)) for i in range(230)]
    for i in lone:
        rows[i] = (i, rows[i][1], page("r", i, [f"{LONG}other {i}", f"own {i}"], notice="A line of 1999", foot="about us"))
    rows += [(900 + i, f"http://q.example/{i}", run_of("copies", i)) for i in range(3)]
    ranks = he.materialize(he.ranked(he.parse(make_pages(rows).repartition(3))), "test-ranks")
    got = {r["content"]: sorted(r["shared"]) for r in he.shared_with_neighbours(ranks, 4).collect()}
    want, hosts = {}, {}
    for r in sorted(ranks.collect(), key=lambda r: r["rank"]):
        hosts.setdefault(r["host"], []).append(he._Page(*(r[c] for c in he.PAGE)))
    for held in hosts.values():
        want |= one_by_one(held)
    assert got == want and len(got) > 100


def test_nodes_pass_over_no_page_that_tells_something():
    rng, proved = random.Random(3), 0
    for _ in range(3000):
        base, pages = [rng.randrange(9) for _ in range(rng.randint(0, 7))], []
        kinds = {k: rng.choice([he.OPEN, he.OPEN, he.OUT]) for k in range(30)}
        for n in range(4):
            keys = [k for k in base if rng.random() < 0.9] + [rng.choice([20 + n, 3])] * (rng.random() < 0.5)
            main = rng.random() < 0.3
            shown = [he.MAIN if main and k in (0, 1, 2) else kinds[k] for k in keys]
            keys = [k + 100 if x == he.MAIN else k for k, x in zip(keys, shown)]
            long = [k for k, x in zip(keys, shown) if x != he.OUT and k % 100 % 3]
            pages.append(he._Page(n, "h", n, keys, shown, long))
        p, *others = pages
        common = he._Common.of(others[0])
        for other in others[1:]:
            common.add(he._Common(*he._Common.of(other).row()))
        lone = {k for k in p.keys if not any(k in o.keys for o in others)}
        if common.tells_nothing(p, lone):
            proved += 1
            for other in others:
                assert he._ask(p, [other], lambda o: he._aligned(p, o)) == ([], True)
    assert proved > 300
