"""Main text of web pages: markup where it names the article, differencing elsewhere.

A page is cut into lines (its text blocks), and all of them go through differencing: the
pages of a host stand in order of URL path, each is aligned with its neighbour on either
side by the longest common subsequence of lines, and the shared lines are deleted. Two
checks follow. If the page declares its article (``article``, ``main``, or an equal role),
its lines are put back and are the text: pages with the same article share all of it, and
copies are no boilerplate. Among the lines that no neighbour shares, those of menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by
their elements, and those outside a declared article by their place. Each page comes with
the numbers of lines that differencing deleted, that markup deleted and that were put back.

Article lines match article lines only, so that a declared article decides nothing about
a page without one. Pages of a host with the same lines are
one page here, and what is decided for it holds for all. A near copy (a print version, a
revised one) shares most of its long lines that markup leaves (of the article or undecided;
undecided ones if one of the two pages declares no article); it tells nothing, nor does a page
that shares all of those lines, and the next page beyond it is asked instead, one after
the other to the ends of the host. A page that none of these tells anything keeps its lines.

Neighbours without groups: pages get their rank in the order (host, path, id) from a
range sort and one total per partition; ``BLOCK`` ranks and ``REACH`` more on either
side are held together, so a host with a third of all pages is spread like any other.
The pages that found nothing within reach search on in a tree over the ranks of their
hosts: a node knows which lines all its pages have in common and how many they have at most.
Where that proves that none of its pages tells anything, all are passed over at once, else
the node is opened; so the nearest page that tells something is found, wherever it stands,
in rounds that grow with the tree's height. Pages that no node proves anything about are
compared one by one, ever more of them in a round.
Only line hashes are sorted and compared, never the pages.

Defined cases: null or empty html has empty text; rows without or with repeated
page_id are extracted row by row; null urls are a host of their own; malformed markup
is read leniently; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalflow.llm.common import batches, materialize, partition_bases, range_partitions, task_number, texts_of

# Element names and name parts (fixed values of this operator).
DROPPED = frozenset(
    "head title script style noscript template svg math iframe object embed canvas audio video map "
    "nav menu header footer aside form button select option textarea input label fieldset dialog".split()
)
ARTICLE = frozenset(["article", "main"])
ARTICLE_ROLES = frozenset(["article", "main"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe"])
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar "
    "share sharing social related recommended newsletter subscribe subscription signup login footer header masthead "
    "comment comments commentlist disqus reply replies respond hidden skip copyright".split()
)
# Words that are no ordinary ones: on a container they drop it as first or last part of a name.
CLEAR_PARTS = frozenset(
    "adsense advert adverts advertisement advertising sponsored navbar nav navigation menu breadcrumb breadcrumbs pagination pager "
    "toolbar sidebar popup modal newsletter masthead header footer commentlist disqus gdpr cookies".split()
)
# Words that say where or how; beside them a word of DROPPED_PARTS still names the whole element.
PLACES = frozenset(
    "bar box block link links list item items wrap wrapper container widget widgets area section panel group row col column inner outer "
    "top bottom left right main site page global web primary secondary sticky fixed mobile desktop icon icons button buttons btn form "
    "post posts article articles story stories entry content body text title count author user meta thread unit slot info message law "
    "policy settings line to the id x js".split()
)
CONTAINERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption summary td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_ITSELF = frozenset("no has with without not is".split())  # "has-sidebar" is no sidebar
OWN_HEADER = frozenset("article entry post story content section".split())  # "post-header" is the article's
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
PARTS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
BLOCK, REACH = 128, 32  # ranks held together, and how many pages a page asks on either side before it searches on
BITS = 5  # a node of the search has 2**BITS children
SEEKERS = 4096  # ranks whose searches meet a node in one task
MOST_WIDE = 2**15  # nodes whose pages a search asks in one round
CELLS = 16_000_000  # of an alignment's table in memory
LONG = 60  # characters of a line that pages seldom share by chance
MAIN, OPEN, OUT = 0, 1, 2  # kinds of lines: of a declared article, undecided, dropped by markup


def url_parts(url: str | None) -> tuple[str, str]:
    """Lower-case host and path of a URL, without scheme, query and fragment."""
    if not url:
        return "", ""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url.strip())
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    return host.lower(), "/" + path


def attributes(rest: str) -> dict[str, str]:
    """Lower-case names and values of a tag in order; of equal names the first counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), value.strip("\"'").lower())
    return out


def _drops_by_name(token: str, name: str, generated: bool) -> bool:
    """A name of boilerplate words and places, or on a container a clear word at either
    end; ``generated``: it may be made from a heading's words, so that only its last counts."""
    parts = PARTS.findall(token)
    if not parts or parts[0] in NOT_ITSELF or parts[0] in OWN_HEADER and parts[-1] == "header":
        return False
    if not DROPPED_PARTS.isdisjoint(parts) and all(x in DROPPED_PARTS or x in PLACES for x in parts):
        return True
    if name not in CONTAINERS or generated and name == "section":
        return False
    return parts[-1] in CLEAR_PARTS or not generated and parts[0] in CLEAR_PARTS


def _drops(name: str, rest: str, inside: bool) -> bool:
    if name in DROPPED:
        return True
    if not rest or name in ("html", "body") or name in ARTICLE:
        return False
    held = attributes(rest)
    if "hidden" in held or held.get("aria-hidden") == "true" or held.get("role") in DROPPED_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", held.get("style", "")):
        return True
    if inside and name in HEADINGS:
        return False
    return any(
        _drops_by_name(token, name, inside and key == "id") for key in ("class", "id") for token in held.get(key, "").split()
    )


def _is_article(name: str, rest: str) -> bool:
    if name in ARTICLE:
        return True
    if not rest:
        return False
    held = attributes(rest)
    return held.get("role") in ARTICLE_ROLES or held.get("itemprop") == "articlebody"


def lines_of(page: str) -> list[tuple[str, int]]:
    """Text blocks in page order with their kinds."""
    out: list[tuple[str, int]] = []
    # name, inside an article, in a dropped block, in a dropped inline element of a kept one
    stack: list[tuple[str, bool, bool, bool]] = []
    held: list[str] = []
    inside = dropped = muted = False

    def end_block() -> None:
        line = SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if line:
            out.append((line, OUT if dropped else MAIN if inside else OPEN))

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            held.append(" " if muted else text)
            continue
        name = m["name"]
        if name is None:  # comments, declarations and raw-text elements leave no text
            continue
        name = name.lower()
        if m["close"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            around = (inside, dropped, muted) if at is None else stack[at - 1][1:] if at else (False, False, False)
            if (name in BLOCKS or around[:2] != (inside, dropped)) and not (muted and around[2]):
                end_block()
            if at is not None:
                del stack[at:]
                inside, dropped, muted = around
            continue
        if name == "br":
            held.append(" ")
            continue
        article = _is_article(name, m["rest"])
        out_now = not article and _drops(name, m["rest"], inside)
        # the heading of an article may stand in a header of its own
        if out_now and name == "header" and inside and not dropped:
            out_now = False
        block = article or name in BLOCKS and not muted  # what is muted is gone, its blocks too
        if block:
            end_block()
        if name in VOID or m["rest"].endswith("/") and name not in BLOCKS:
            continue
        if name in ("p", "li", "dt", "dd", "option") and stack and stack[-1][0] == name:
            stack.pop()
            inside, dropped, muted = stack[-1][1:] if stack else (False, False, False)
        if article and not inside:
            dropped = muted = False  # an unclosed menu does not swallow the article
        if block:
            inside, dropped = inside or article, dropped or out_now
        else:
            muted = muted or out_now and not dropped
        stack.append((name, inside, dropped, muted))
    end_block()
    return out


def line_key(line: str) -> int:
    """A 63-bit hash of a line, the same in every process."""
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "big") >> 1


def _lengths(u: list[int], v: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``u`` and every beginning of ``v``."""
    row = np.zeros(len(v) + 1, np.int32)
    for x in u:
        row[1:] = np.maximum.accumulate(np.where(v == x, row[:-1] + 1, row[1:]))
    return row


def _common(u: list[int], v: list[int], cells: int) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by tables of at most ``cells`` cells: a
    larger one is cut where the halves' lengths add up to the most."""
    if not u or not v:
        return []
    if len(u) > 1 and len(u) * len(v) > cells:
        half, right = len(u) // 2, np.array(v)
        cut = int(np.argmax(_lengths(u[:half], right) + _lengths(u[half:][::-1], right[::-1])[::-1]))
        return _common(u[:half], v[:cut], cells) + [(half + i, cut + j) for i, j in _common(u[half:], v[cut:], cells)]
    table = np.zeros((len(u) + 1, len(v) + 1), np.int32)
    right = np.array(v)
    for i in range(len(u) - 1, -1, -1):
        row = np.where(right == u[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    found, i, j = [], 0, 0
    while i < len(u) and j < len(v):
        if u[i] == v[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return found


def shared_lines(a: list[int], b: list[int], cells: int = CELLS) -> tuple[list[int], list[int]]:
    """Positions in ``a`` and in ``b`` of a longest common subsequence. Common heads and
    tails, and lines that the other page lacks, are set aside before the table."""
    in_a, in_b = set(a), set(b)
    pa_, pb = [i for i, x in enumerate(a) if x in in_b], [i for i, x in enumerate(b) if x in in_a]
    x, y = [a[i] for i in pa_], [b[i] for i in pb]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    found = [(i, i) for i in range(head)] + [(len(x) - 1 - i, len(y) - 1 - i) for i in range(tail)]
    found += [(head + i, head + j) for i, j in _common(x[head : len(x) - tail], y[head : len(y) - tail], cells)]
    return sorted(pa_[i] for i, _ in found), sorted(pb[j] for _, j in found)


PARSED = (
    "part int, at long, page_id long, url string, host string, path string, "
    "declared boolean, lines array<string>, keys array<long>, kinds array<int>, long_lines array<long>, content long"
)


def parse(pages: DataFrame) -> DataFrame:
    """Lines of every page, written once. ``lines`` has the text of those that may stay (of
    the declared article, else the undecided ones), the others empty; ``keys`` and ``kinds``
    the hashes and kinds of all, article lines hashed apart; ``long_lines`` the hashes of
    the long ones that markup does not drop; ``content`` a hash of all lines."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = task_number(), 0
        for batch in batches(rows, 256):
            out: list[list] = [[] for _ in range(8)]
            for url, page in zip(batch.column(1).to_pylist(), texts_of(batch.column(2))):
                lines = lines_of(page)
                declared = any(kind == MAIN for _, kind in lines)
                keys = [line_key(f"\0{x}" if kind == MAIN else x) for x, kind in lines]
                row = (
                    *url_parts(url), declared,
                    [x if kind == (MAIN if declared else OPEN) else "" for x, kind in lines],
                    keys, [kind for _, kind in lines],
                    [key for key, (x, kind) in zip(keys, lines) if kind != OUT and len(x) >= LONG],
                    line_key("\n".join(f"{kind}{x}" for x, kind in lines)),
                )
                for values, value in zip(out, row):
                    values.append(value)
            n = batch.num_rows
            texts, longs = pa.list_(pa.string()), pa.list_(pa.int64())
            kinds = [pa.string(), pa.string(), pa.bool_(), texts, longs, pa.list_(pa.int32()), longs, pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)), pa.array(at + np.arange(n)), batch.column(0), batch.column(1),
                    *(pa.array(v, k) for v, k in zip(out, kinds)),
                ],
                ["part", "at", "page_id", "url", "host", "path", "declared", "lines", "keys", "kinds", "long_lines", "content"],
            )
            at += n

    ids = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")
    )
    return materialize(ids.mapInArrow(run, PARSED), "html-lines")


def ranked(parsed: DataFrame) -> DataFrame:
    """``(rank, host, content, keys, kinds, long_lines)``: places in the order (host, path,
    id) of the pages with other lines than any before them on their host."""
    n = range_partitions(parsed)
    order = ["host", "path", "page_id", "part", "at"]
    held = ["content", "keys", "kinds", "long_lines"]
    firsts = (
        parsed.groupBy("host", "content").agg(F.min(F.struct(*order[1:], *held[1:])).alias("first"))
        .select("host", *[f"first.{c}" for c in order[1:]], "content", *[f"first.{c}" for c in held[1:]])
    )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, before = task_number(), 0
        for batch in rows:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, slot, np.int32)), pa.array(before + np.arange(k)), *(batch.column(i) for i in (0, 5, 6, 7, 8))],
                ["slot", "place", "host", *held],
            )
            before += k

    placed = materialize(
        firsts.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
            run, "slot int, place long, host string, content long, keys array<long>, kinds array<int>, long_lines array<long>"
        ),
        "html-order",
    )
    bases = partition_bases(placed.groupBy("slot").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("slot", "part"))
    base = F.lit([bases.get(p, 0) for p in range(max(bases, default=0) + 1)]).cast("array<long>")
    return placed.select((F.get(base, F.col("slot")) + F.col("place")).alias("rank"), "host", *held)


class _Page:
    def __init__(self, rank: int, host: str, content: int, keys: list[int], kinds: list[int], long_lines: list[int]):
        self.rank, self.host, self.content, self.keys = rank, host, content, keys
        self.own = {i for i, k in enumerate(kinds) if k != OUT}  # lines that markup does not drop
        article = {key for key, k in zip(keys, kinds) if k == MAIN}
        self.declared = bool(article)
        self.all, self.all_long = {keys[i] for i in self.own}, set(long_lines)
        self.open, self.long = self.all - article, self.all_long - article


def near_copies(a: _Page, b: _Page) -> bool:
    """Whether the pages share most of their long lines that markup leaves and of all of them."""
    if a.declared and b.declared:
        a_long, b_long, a_all, b_all = a.all_long, b.all_long, a.all, b.all
    else:
        a_long, b_long, a_all, b_all = a.long, b.long, a.open, b.open
    fewer = min(len(a_long), len(b_long))
    return fewer > 0 and 2 * len(a_long & b_long) > fewer and 2 * len(a_all & b_all) > min(len(a_all), len(b_all))


def _ask(page: _Page, others: Iterable[_Page], shared: Callable[[_Page], list[int]]) -> tuple[list[int], bool]:
    """The lines shared with the first of ``others``, nearest first, that tells anything,
    and whether pages beyond them may still tell."""
    for other in others:
        if other.host != page.host:
            return [], False
        if near_copies(page, other):
            continue
        lines = shared(other)
        if not page.own or len(page.own.intersection(lines)) < len(page.own):  # else it is contained: the other tells nothing
            return lines, False
    return [], True


def _aligned(page: _Page, other: _Page) -> list[int]:
    """Lines of ``page`` in its alignment with ``other``."""
    return shared_lines(page.keys, other.keys)[0]


def _decide(pages: list[_Page], block: int, reach: int) -> Iterator[tuple]:
    """Shared lines of the pages of ``block`` among ``pages``, its surroundings,
    and whether the search goes on before and after them."""
    known: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    place = {page.rank: i for i, page in enumerate(pages)}

    def shared(i: int, other: _Page) -> list[int]:
        j = place[other.rank]
        pair = min(i, j), max(i, j)
        if pair not in known:
            known[pair] = shared_lines(pages[pair[0]].keys, pages[pair[1]].keys)
        return known[pair][i > j]

    for i, page in enumerate(pages):
        if page.rank // BLOCK != block or not page.keys:
            continue
        found: set[int] = set()
        on = []
        for others in (pages[max(0, i - reach) : i][::-1], pages[i + 1 : i + 1 + reach]):
            lines, more = _ask(page, others, lambda other: shared(i, other))
            found.update(lines)
            on.append(more and len(others) == reach)
        if found or any(on):
            yield page.rank, page.host, page.content, sorted(found), *on


def _told(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 6
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["rank", "host", "content", "shared", "before", "after"])


TOLD = "rank long, host string, content long, shared array<int>, before boolean, after boolean"
PAGE = ["rank", "host", "content", "keys", "kinds", "long_lines"]


def asked_nearby(ranks: DataFrame, reach: int) -> DataFrame:
    """The first round: every page within ``reach``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pages = None, []
        for batch in rows:
            for at, *page in zip(*(c.to_pylist() for c in batch.columns)):
                if at != block and pages:
                    yield _told(list(_decide(pages, block, reach)))
                    pages.clear()
                block = at
                pages.append(_Page(*page))
        if pages:
            yield _told(list(_decide(pages, block, reach)))

    near = F.array_distinct(F.array(*[F.floor((F.col("rank") + d) / BLOCK).cast("long") for d in (-reach, 0, reach)]))
    both = ranks.select(F.explode(near).alias("block"), *PAGE).repartition("block")
    return both.sortWithinPartitions("block", "rank").mapInArrow(run, TOLD)


class _Common:
    """What all pages of a node have in common and how much they have at most."""

    def __init__(self, keys: list[int], sets: Iterable[Iterable[int]], most: list[int], declared: list[bool]):
        self.keys, self.sets, self.most = keys, [set(x) for x in sets], most
        self.declared = set(declared)

    @classmethod
    def of(cls, page: _Page) -> _Common:
        sets = page.all_long, page.all, page.long, page.open
        return cls(page.keys, sets, [len(x) for x in sets], [page.declared])

    def add(self, other: _Common) -> None:
        if self.keys != other.keys:
            self.keys = [self.keys[i] for i in shared_lines(self.keys, other.keys)[0]]
        for mine, its in zip(self.sets, other.sets):
            mine &= its
        self.most = [max(x) for x in zip(self.most, other.most)]
        self.declared |= other.declared

    def row(self) -> tuple:
        return self.keys, [sorted(x) for x in self.sets], self.most, sorted(self.declared)

    def _near(self, page: _Page, long: int, every: int) -> bool:
        own = page.all_long, page.all, page.long, page.open
        return all(2 * len(own[i] & self.sets[i]) > min(len(own[i]), self.most[i]) for i in (long, every))

    def tells_nothing(self, page: _Page, lone: set[int]) -> bool:
        """Whether it is sure that every page of the node is a near copy of ``page``, or that
        every one contains it. ``lone``: keys that no other page of the host has."""
        if (True not in self.declared or not page.declared or self._near(page, 0, 1)) and (
            page.declared and False not in self.declared or self._near(page, 2, 3)
        ):
            return True
        if not page.own or any(page.keys[i] in lone for i in page.own):
            return False
        rest = iter(self.keys)  # a page that has all lines in order aligns with all that it can share
        return all(key in rest for key in page.keys if key not in lone)


SUMMARY = "level int, at long, host string, keys array<long>, sets array<array<long>>, most array<int>, declared array<boolean>"


def _nodes(children: DataFrame, level: int) -> DataFrame:
    """The nodes over ``children``: pages, or the nodes of the level below."""
    columns = PAGE if level == 1 else [c for c in children.columns if c != "level"]
    at = F.col("rank" if level == 1 else "at")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, common = None, None

        def made(done: list[tuple]) -> pa.RecordBatch:
            values = list(zip(*done)) or [[]] * 6
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.string(), longs, pa.list_(longs), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            arrays = [pa.array([level] * len(done), pa.int32()), *(pa.array(v, k) for v, k in zip(values, kinds))]
            return pa.RecordBatch.from_arrays(arrays, ["level", "at", "host", "keys", "sets", "most", "declared"])

        for batch in batches(rows, 1024):
            done = []
            for node, *child in zip(*(c.to_pylist() for c in batch.columns)):
                host = child[1]
                one = _Common.of(_Page(*child)) if level == 1 else _Common(*child[2:])
                if (node, host) == key:
                    common.add(one)
                    continue
                if key is not None:
                    done.append((*key, *common.row()))
                key, common = (node, host), one
            yield made(done)
        if key is not None:
            yield made([(*key, *common.row())])

    held = children.select(F.shiftright(at, BITS).alias("node"), at.alias("child"), *[c for c in columns if c not in ("rank", "at")])
    held = held.select("node", "child", *[c for c in held.columns if c not in ("node", "child")])
    return held.repartition("node", "host").sortWithinPartitions("node", "host", "child").mapInArrow(run, SUMMARY)


STATE = "rank long, host string, content long, first long, last long, side int, cursor long, level int, wide int"
ASKED = f"{STATE}, hit long, shared array<int>"


def _visited(pages: DataFrame, nodes: DataFrame, seekers: DataFrame, states: DataFrame) -> DataFrame:
    """A round: what each search finds among the children of the nodes it looks at, from its
    ``cursor`` on. ``hit`` is the nearest child that may tell something, a page that does."""
    names = [c.split()[0] for c in STATE.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, others = None, []
        for batch in batches(rows, 256):
            out = []
            for row in batch.to_pylist():
                at, level, lines = (row["level"], row["node"], row["host"], row["salt"]), row["level"], (row["keys"], row["kinds"], row["long_lines"])
                if at != key:
                    key, others = at, []
                if not row["seeks"]:
                    common = (row["keys"], row["sets"], row["most"], row["declared"])
                    others.append((row["at"], _Common(*common) if level else _Page(row["at"], row["host"], row["content"], *lines)))
                    continue
                page, lone, side = _Page(row["rank"], row["host"], row["content"], *lines), set(row["lone"] or ()), row["side"]
                hit, shared = None, []
                for child, other in others[::side]:
                    if (child - (row["cursor"] >> BITS * level)) * side < 0:
                        continue
                    if level:
                        silent = other.tells_nothing(page, lone)
                    else:
                        shared, silent = _ask(page, [other], lambda other: _aligned(page, other))
                    if not silent:
                        hit = child
                        break
                out.append((*(row[c] for c in names), hit, shared))
            columns = list(zip(*out)) or [[]] * 11
            long, small = pa.int64(), pa.int32()
            kinds = [long, pa.string(), long, long, long, small, long, small, small, long, pa.list_(small)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*names, "hit", "shared"])

    here = f"shiftright(cursor, {BITS} * (level + 1))"
    more = "if(level = 0, wide, 1) - 1"
    up = f"sequence({here}, least({here} + {more}, shiftright(last, {BITS} * (level + 1))))"
    down = f"sequence(greatest({here} - {more}, shiftright(first, {BITS} * (level + 1))), {here})"
    visits = states.withColumn("node", F.explode(F.expr(f"if(side > 0, {up}, {down})"))).withColumn("salt", F.floor(F.col("rank") / SEEKERS))
    met = visits.select("level", "node", "host", "salt").distinct()
    children = pages.select(
        F.lit(0).alias("level"), F.col("rank").alias("at"), "host", "content", "keys", "kinds", "long_lines",
        *[F.lit(None).cast(kind).alias(c) for c, kind in (("sets", "array<array<long>>"), ("most", "array<int>"), ("declared", "array<boolean>"))],
    ).unionByName(nodes, allowMissingColumns=True).withColumn("node", F.shiftright("at", BITS))
    held = children.join(met, ["level", "node", "host"]).withColumn("seeks", F.lit(False))
    asking = visits.join(seekers.select("rank", "keys", "kinds", "long_lines", "lone"), "rank").withColumn("seeks", F.lit(True))
    both = held.unionByName(asking, allowMissingColumns=True).repartition("level", "node", "host", "salt")
    asked = both.sortWithinPartitions("level", "node", "host", "salt", "seeks", "at").mapInArrow(run, ASKED)
    nearest = F.when(F.col("hit").isNotNull(), F.struct((F.col("hit") * F.col("side")).alias("far"), "hit", "shared"))
    return asked.groupBy(*names).agg(F.min(nearest).alias("found")).select(*names, "found.hit", "found.shared")


def _next(asked: DataFrame, top: int) -> DataFrame:
    """The searches that go on: into the node that was hit, else beyond and a level up."""
    size, n = f"shiftleft(1L, {BITS} * (level + 1))", "if(level = 0, wide, 1)"
    child = f"shiftleft(1L, {BITS} * level)"
    here = f"shiftright(cursor, {BITS} * (level + 1))"
    going = asked.filter("level > 0 or hit is null")
    into = f"if(side > 0, hit * {child}, (hit + 1) * {child} - 1)"
    beyond = f"if(side > 0, ({here} + {n}) * {size}, ({here} - {n} + 1) * {size} - 1)"
    return going.select(
        "rank", "host", "content", "first", "last", "side",
        F.expr(f"if(hit is null, {beyond}, if(side > 0, greatest(cursor, {into}), least(cursor, {into})))").alias("cursor"),
        F.expr(f"if(hit is null, least(level + 1, {top}), level - 1)").alias("level"),
        F.expr(f"if(hit is null and level = 0, least(2 * wide, {MOST_WIDE}), wide)").alias("wide"),
    ).filter("cursor between first and last")


def searched(ranks: DataFrame, told: DataFrame, reach: int) -> Iterator[DataFrame]:
    """``(host, content, shared)`` of the pages whose search goes on beyond ``reach``."""
    seeking = told.filter("before or after").select("rank", "host", "content", "before", "after")
    pages = materialize(ranks.join(seeking.select("host").distinct(), "host", "left_semi"), "html-run").select(*PAGE)
    ends = materialize(pages.groupBy("host").agg(F.min("rank").alias("first"), F.max("rank").alias("last")), "html-ends")
    span = ends.agg(F.max(F.col("last") - F.col("first"))).first()[0] + 1
    top, nodes = 1, [materialize(_nodes(pages, 1), "html-nodes")]
    while 2 ** (BITS * (top + 1)) < span:
        top += 1
        nodes.append(materialize(_nodes(nodes[-1], top), "html-nodes"))
    tree = nodes[0]
    for level in nodes[1:]:
        tree = tree.unionByName(level)

    lines = pages.select("host", "rank", F.explode(F.array_distinct("keys")).alias("key"))
    lone = lines.groupBy("host", "key").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    lone = lone.groupBy("rank").agg(F.collect_list("key").alias("lone"))
    seekers = materialize(pages.join(seeking.select("rank"), "rank", "left_semi").join(lone, "rank", "left"), "html-seekers")

    sides = F.explode(F.filter(F.array(
        F.when(F.col("before"), F.struct(F.lit(-1).alias("side"), (F.col("rank") - reach - 1).alias("cursor"))),
        F.when(F.col("after"), F.struct(F.lit(1).alias("side"), (F.col("rank") + reach + 1).alias("cursor"))),
    ), lambda x: x.isNotNull())).alias("go")
    states = seeking.select("rank", "host", "content", sides).join(ends, "host").select(
        "rank", "host", "content", "first", "last", "go.side", "go.cursor", F.lit(0).alias("level"), F.lit(1).alias("wide")
    ).filter("cursor between first and last")
    while not states.isEmpty():
        asked = materialize(_visited(pages, tree, seekers, states), "html-asked")
        yield asked.filter("level = 0 and size(shared) > 0").select("host", "content", "shared")
        states = _next(asked, top)


def shared_with_neighbours(ranks: DataFrame, reach: int = REACH) -> DataFrame:
    """``(host, content, shared)``: the lines, by position, that a page shares
    with the nearest page before or after it that tells anything."""
    first = materialize(asked_nearby(ranks, reach), "html-told")
    told = first.filter("size(shared) > 0").select("host", "content", "shared")
    if first.filter("before or after").isEmpty():
        return told
    for more in searched(ranks, first, reach):
        told = told.unionByName(more)
    return told.groupBy("host", "content").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared"))


def extract(pages: DataFrame, reach: int = REACH) -> DataFrame:
    """``(page_id, url, text, n_chars, lines_shared, lines_by_markup, lines_put_back)`` of
    every row of ``pages``: text, its code points, lines deleted by differencing, lines
    deleted by markup among those that no neighbour shares, shared lines of the article."""
    parsed = parse(pages)
    told = shared_with_neighbours(ranked(parsed), reach)
    held = parsed.select("host", "content", "page_id", "url", "declared", "lines", "kinds").join(told, ["host", "content"], "left")
    held = held.withColumn("shared", F.coalesce("shared", F.array().cast("array<int>")))
    kind = lambda i: F.get(F.col("kinds"), i)
    stays = lambda _, i: F.when(F.col("declared"), kind(i) == MAIN).otherwise(
        (kind(i) == OPEN) & ~F.array_contains("shared", i)
    )
    marked = lambda k: (k == OUT) | (F.col("declared") & (k == OPEN))
    shared_kinds = F.transform("shared", lambda p: kind(p))
    number = lambda kinds, chosen: F.size(F.filter(kinds, chosen)).cast("long")
    return held.select(
        "page_id", "url", F.array_join(F.filter("lines", stays), "\n\n").alias("text"),
        number(shared_kinds, lambda k: k != MAIN).alias("lines_shared"),
        (number(F.col("kinds"), marked) - number(shared_kinds, marked)).alias("lines_by_markup"),
        number(shared_kinds, lambda k: k == MAIN).alias("lines_put_back"),
    ).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "lines_shared", "lines_by_markup", "lines_put_back")
