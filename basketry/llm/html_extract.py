"""Main text of web pages: markup cut into blocks, boilerplate found by suffix arrays over each host.

Every page becomes its text blocks with their place in the markup: inside an article (or
main) element, inside an element that by name or class is a menu, header, footer,
sidebar, notice, advert, form or comments (dropped), or neither (open). A page's text is
its article's blocks, or its open ones where it has no article, without the boilerplate
runs. A run is `least` consecutive tokens. It is boilerplate in open blocks if it stands in
the open blocks of two different pages of its host; in articles, where copies must stay
whole, if it stands in the articles of 8 or more pages and 9 of 10 pages of the host.

A host's pages are dealt to units of about `unit_pages` pages; a unit's token streams are
concatenated and sorted as suffixes by doubling ranks up to `least` tokens. Where a host has
several units, each sends its runs with the pages they stand on to an exchange by host and
run, and what counts as boilerplate over the whole host comes back to the units that hold
it, so the size of a unit changes no result. Of the runs in articles a unit sends those on
half of its pages (all, where it has fewer than 64): units are drawn by hash, so a run on 9
of 10 pages of a host stays below half of a unit's 64 with a chance below 10^-13, and then
counts for less, never for more. Runs are told by 128 bits.

Defined cases: null html is empty and gives the empty text; null urls are one host;
pages with equal streams count as one page, so repeated rows give repeated results; end
tags that may be left out are implied, a tag that no > ends is text, an unclosed quote
counts for nothing, and an element that a page never closes ends with the page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import buckets, grams, slabs, slices, stored, windows, words_of
from basketry.llm.url_filter import host_of

LEAST = 8
UNIT_PAGES = 200
OPEN_PAGES = 2
ARTICLE_PAGES = 8
ARTICLE_SHARE = 0.9
#: A unit of a larger host sends the runs in articles that stand on this share of its pages, or all where it has fewer pages than SURE_PAGES.
SENT_SHARE = 0.5
SURE_PAGES = 64
#: Compression of parsed pages.
LEVEL = 9
#: Hosts above UNIT_PAGES that may be broadcast; more of them meet the pages by a join.
MOST_BROADCAST = 100_000

# Element names of HTML by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select option button head object math".split())
DROPPED = frozenset("nav aside footer form header dialog menu".split())
# Words in names of classes and ids. The first stand for boilerplate in any compound, the others alone or with a word of place or form.
SURE = "advert|advertisement|advertising|ads|sidebar|footer|navbar|navigation|nav|breadcrumb|breadcrumbs|comments|disqus|newsletter|cookie|cookies|consent|pagination|popup|masthead|signup|subscribe".split("|")
LIKELY = "ad|adv|sponsor|sponsored|promo|promotion|banner|notice|notices|alert|modal|comment|related|recommended|recommendations|share|sharing|social|menu|menus|menubar|header|pager|toolbar|widget|login|subscription".split("|")
PLACES = "site|page|article|post|posts|entry|main|top|bottom|left|right|inline|sticky|global|content|block|box|bar|list|area|section|unit|slot|container|wrapper|wrap|inner|outer|link|links|item|items|articles|stories|story|form|button|buttons|icon|icons|group|panel|col|column|widget|text|title".split("|")
# Items whose end tag may be left out, by group, and the elements in which such a group starts afresh.
ITEMS = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "thead": "tbody", "tbody": "tbody", "tfoot": "tbody"}
SCOPES = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt",), "table": ("tbody", "tr", "td"), "tr": ("td",)}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_SURE, _LIKELY, _PLACES = frozenset(SURE), frozenset(LIKELY), frozenset(PLACES)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_EDGE = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_ENDS = {name: re.compile(rf"</{name}[\s>/]", re.I) for name in RAW}
ARTICLE, OPEN = 1, 0


def _is_hint(token: str) -> bool:
    """Whether a class or id names boilerplate: related-posts does, related-work and header-image don't."""
    parts = [x for x in re.split(r"[-_]+|\d+", token) if x]
    if any(x in _SURE for x in parts):
        return True
    return any(x in _LIKELY for x in parts) and all(x in _LIKELY or x in _PLACES for x in parts)


def _unwanted(name: str, attrs: str, in_article: bool) -> bool:
    """Whether the element is boilerplate by its name or attributes."""
    if name in DROPPED and not (name == "header" and in_article):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES or key == "style" and _HIDDEN.search(value):
            return True
        if key in ("class", "id") and any(map(_is_hint, value.split())):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, lower-case name, attributes) of each tag; comments and declarations without a name.

    A quote opens a value only after =; one that is never closed counts for nothing, and is
    looked for once, so malformed pages take time in proportion to their length.
    """
    at, n, unclosed = 0, len(page), set()
    while (start := page.find("<", at)) >= 0:
        m = _NAME.match(page, start + 1)
        if m is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = n if end < 0 else end + 3
            elif page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                if end < 0:
                    return
                at = end + 1
            else:
                at = start + 1
                continue
            yield start, at, False, "", ""
            continue
        place = m.end()
        while True:
            edge = _EDGE.search(page, place)
            if edge is None:
                return
            place, mark = edge.end(), edge[0]
            if mark == ">":
                break
            k = edge.start() - 1
            while page[k].isspace():
                k -= 1
            if page[k] == "=" and mark not in unclosed:
                close = page.find(mark, place)
                if close < 0:
                    unclosed.add(mark)
                else:
                    place = close + 1
        at = place
        jump = yield start, at, bool(m[1]), m[2].lower(), page[m.end() : at - 1]
        at = jump or at


class _Open:
    """The open elements of a page, with counts that make every question about them one look-up."""

    def __init__(self) -> None:
        self.out: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.items: dict[str, list[int]] = {g: [] for g in ITEMS.values()}
        self.dropped = self.articles = 0

    def flush(self) -> None:
        """The text so far is a block: nothing of a dropped element is in it."""
        text = " ".join(html.unescape("".join(self.parts)).split())
        self.parts.clear()
        if text:
            self.out.append((ARTICLE if self.articles else OPEN, text))

    def push(self, name: str, bad: bool) -> None:
        at = len(self.stack)
        self.stack.append((name, bad))
        self.places.setdefault(name, []).append(at)
        self.dropped += bad
        self.articles += name in ("article", "main")
        if name in BLOCKS:
            self.blocks.append(at)
        if name in ITEMS:
            self.items[ITEMS[name]].append(at)
        for group in SCOPES.get(name, ()):
            self.items[group].append(-1)

    def close_to(self, at: int) -> None:
        while len(self.stack) > at:
            name, bad = self.stack[-1]
            if name in BLOCKS and not self.dropped:
                self.flush()
            self.stack.pop()
            self.dropped -= bad
            if not name:
                continue
            self.places[name].pop()
            self.articles -= name in ("article", "main")
            if name in BLOCKS:
                self.blocks.pop()
            for group in SCOPES.get(name, ()):
                self.items[group].pop()
            if name in ITEMS:
                self.items[ITEMS[name]].pop()

    def start(self, name: str, attrs: str) -> None:
        if name in ITEMS:
            held = self.items[ITEMS[name]]
            if held and held[-1] >= 0:
                self.close_to(held[-1])
        if name in BLOCKS:
            if self.blocks and self.stack[self.blocks[-1]][0] == "p":
                self.close_to(self.blocks[-1])
            if not self.dropped:
                self.flush()
        elif name == "br" and not self.dropped:
            self.parts.append(" ")
        if name not in VOID and not attrs.endswith("/"):
            self.push(name, _unwanted(name, attrs, self.articles > 0))

    def end(self, name: str) -> None:
        held = self.places.get(name)
        if not held:
            if name in BLOCKS and not self.dropped:
                self.flush()
        elif name in BLOCKS or not self.blocks or self.blocks[-1] < held[-1]:
            self.close_to(held[-1])
        else:  # an inline element ends across blocks, which stay open
            at = held.pop()
            self.dropped -= self.stack[at][1]
            self.stack[at] = ("", False)


def blocks(page: str) -> list[tuple[int, str]]:
    """(ARTICLE or OPEN, text) of each wanted block in page order: references decoded, white space single, trimmed.

    Items of lists, definitions and tables and paragraphs may lack their end tags. A
    dropped element inside a line leaves the rest of its block in one piece.
    """
    seen, at, endless = _Open(), 0, set()
    found = tags(page)
    tag = next(found, None)
    while tag is not None:
        start, end, closes, name, attrs = tag
        if start > at and not seen.dropped:
            seen.parts.append(page[at:start])
        at, jump = end, None
        if closes:
            seen.end(name)
        elif name in RAW:
            # What no end tag was found for from an earlier place has none from here either.
            m = None if name in endless else _ENDS[name].search(page, at)
            if m:
                at = jump = m.start()
            else:
                endless.add(name)
                if name not in ("head", "object", "button", "noscript", "template"):
                    at = len(page)
                    break
        elif name:
            seen.start(name, attrs)
        try:
            tag = found.send(jump)
        except StopIteration:
            break
    if not seen.dropped:
        seen.parts.append(page[at:])
    seen.close_to(0)
    seen.flush()
    return seen.out


def shared_runs(streams: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, run id, page) of each run of `least` tokens in the concatenated streams, sorted by run id.

    Ranks of suffixes cut at 1, 2, 4, ... tokens come from sorting pairs of ranks half as
    long; the last pair overlaps where `least` is no power of two.
    """
    pages = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    _, rank = np.unique(np.concatenate(streams) if streams else np.zeros(0, np.int64), return_inverse=True)
    width = 1
    while width < least and len(rank):
        step = min(width, least - width)
        pair = rank[:-step] * (rank.max() + 1) + rank[step:] if len(rank) > step else rank[:0]
        _, rank = np.unique(pair, return_inverse=True)
        width += step
    n = len(rank)
    inside = np.flatnonzero(pages[:n] == pages[len(pages) - n :]) if n else np.zeros(0, np.int64)
    order = inside[np.argsort(rank[inside], kind="stable")]
    return order, rank[order], pages[order]


class Unit:
    """Pages that are judged together: their token streams, the suffix array over the different ones and its runs by kind."""

    def __init__(self, pages: list[list[tuple[int, str]]], least: int) -> None:
        self.pages, self.least = pages, least
        whole = [" ".join(text for _, text in page).encode("utf-8", "surrogatepass") for page in pages]
        self.streams = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True) for w in whole], dtype=np.int64)
        _, first, self.owner = np.unique(self.streams, return_index=True, return_inverse=True)
        different = [whole[k] for k in first]
        cut = [words_of(different[lo:hi]) for lo, hi in slabs(different)]
        token = np.concatenate([np.zeros(0, np.uint64), *(c[0] for c in cut)])
        self.start = at = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(np.diff(c[3]) for c in cut)]))
        place, run, page = shared_runs([token[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], least)
        kinds = [np.repeat([kind for kind, _ in pages[k]], [text.count(" ") + 1 for _, text in pages[k]]) for k in first]
        kind = np.concatenate([np.zeros(0, np.int64), *kinds]).astype(np.int64)[place]
        order = np.lexsort((page, run, kind))
        self.place, self.page, self.kind, run = place[order], page[order], kind[order], run[order]
        self.head = np.ones(len(run), dtype=bool)
        self.head[1:] = (run[1:] != run[:-1]) | (self.kind[1:] != self.kind[:-1])
        fresh = self.head.copy()
        fresh[1:] |= self.page[1:] != self.page[:-1]
        self.fresh, self.group, heads = fresh, np.cumsum(self.head) - 1, np.flatnonzero(self.head)
        self.spread = np.add.reduceat(fresh.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
        self.kinds, at = self.kind[heads], self.place[heads]
        self.runs, self.twins = grams(token, least)[at].view(np.int64), windows(token, least)[at].view(np.int64)
        self.size = len(first)
        self.ids = self.streams[first]

    def sent(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(kind, run, twin, streams) of each run that may be boilerplate of the host; of runs in open blocks two streams suffice."""
        sure = np.full(len(self.spread), self.size < SURE_PAGES) | (self.spread >= SENT_SHARE * self.size)
        wanted = np.flatnonzero((self.kinds == OPEN) | sure)
        pages = self.ids[self.page[self.fresh]]
        ends = np.cumsum(self.spread)
        for g in wanted.tolist():
            most = self.spread[g] if self.kinds[g] == ARTICLE else min(OPEN_PAGES, self.spread[g])
            start = ends[g] - self.spread[g]
            yield int(self.kinds[g]), int(self.runs[g]), int(self.twins[g]), pages[start : start + most]

    def alone(self) -> np.ndarray:
        """Which runs are boilerplate where these are all pages of the host."""
        strong = (self.spread >= ARTICLE_PAGES) & (self.spread >= ARTICLE_SHARE * self.size)
        return np.where(self.kinds == ARTICLE, strong, self.spread >= OPEN_PAGES)

    def among(self, told: set[tuple[int, int, int]]) -> np.ndarray:
        """Which runs the host's verdict names."""
        return np.fromiter(((k, r, t) in told for k, r, t in zip(self.kinds.tolist(), self.runs.tolist(), self.twins.tolist(), strict=True)), dtype=bool, count=len(self.runs))

    def texts(self, bad: np.ndarray) -> list[str]:
        """The text of each page without the tokens that a bad run covers."""
        hit = np.zeros(self.start[-1] + 1, dtype=np.int64)
        place = self.place[bad[self.group]]
        np.add.at(hit, place, 1)
        np.add.at(hit, place + self.least, -1)
        covered = np.cumsum(hit[:-1]) > 0
        out = []
        for page, owner in zip(self.pages, self.owner.tolist(), strict=True):
            wanted = ARTICLE if any(kind == ARTICLE for kind, _ in page) else OPEN
            at, lines = int(self.start[owner]), []
            for kind, text in page:
                mask = covered[at : at + text.count(" ") + 1]
                at += len(mask)
                if kind == wanted:
                    lines.append(" ".join(w for w, x in zip(text.split(" "), mask, strict=True) if not x) if mask.any() else text)
            out.append("\n".join(line for line in lines if line))
        return out


def _units(table: pa.Table) -> Iterator[tuple[str, int, list[int]]]:
    """(host, units of the host, rows) of each unit in a table."""
    held: dict[tuple, list[int]] = {}
    hosts, units, unit = (table.column(c).to_pylist() for c in ("host", "units", "unit"))
    for k, key in enumerate(zip(hosts, units, unit, strict=True)):
        held.setdefault(key, []).append(k)
    for (host, units, _), rows in held.items():
        yield host, units, rows


def packed(page: list[tuple[int, str]]) -> bytes:
    """Blocks compressed for their way to the units; no block holds a line feed."""
    return zstandard.ZstdCompressor(level=LEVEL).compress("\n".join(f"{kind}{text}" for kind, text in page).encode("utf-8", "surrogatepass"))


def unpacked(body: bytes) -> list[tuple[int, str]]:
    whole = zstandard.ZstdDecompressor().decompress(body).decode("utf-8", "surrogatepass")
    return [(int(line[0]), line[1:]) for line in whole.split("\n")] if whole else []


def _unit(table: pa.Table, rows: list[int], least: int) -> Unit:
    return Unit([unpacked(body) for body in table.column("body").take(pa.array(rows, pa.int64())).to_pylist()], least)


RUNS = "seat bigint, host string, kind int, run bigint, twin bigint, streams array<bigint>"
_RUNS = pa.schema([("seat", pa.int64()), ("host", pa.string()), ("kind", pa.int32()), ("run", pa.int64()), ("twin", pa.int64()), ("streams", pa.list_(pa.int64()))])
_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def extract(pages: DataFrame, least: int = LEAST, unit_pages: int = UNIT_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    spark = pages.sparkSession

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bodies = [packed(blocks(h or "")) for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bodies, pa.binary())], names=["page_id", "url", "host", "body"])

    def runs(table: pa.Table) -> pa.Table:
        seat, out = table.column("seat")[0].as_py(), []
        for host, units, rows in _units(table):
            if units > 1:
                unit = _unit(table, rows, least)
                out += [(host, *x) for x in unit.sent()]
                out.append((host, -1, 0, 0, unit.ids))
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.Table.from_arrays([pa.array([seat] * len(out), pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(_RUNS)[1:], strict=True))], schema=_RUNS)

    def settle(table: pa.Table, judged: pa.Table) -> pa.Table:
        told: dict[str, set] = {}
        for host, *key in zip(*(judged.column(c).to_pylist() for c in ("host", "kind", "run", "twin")), strict=True):
            told.setdefault(host, set()).add(tuple(key))
        order, texts = [], []
        for host, units, rows in _units(table):
            unit = _unit(table, rows, least)
            order += rows
            texts += unit.texts(unit.among(told.get(host, set())) if units > 1 else unit.alone())
        where = pa.array(order, pa.int64())
        return pa.Table.from_arrays([table.column("page_id").take(where), table.column("url").take(where), pa.array(texts, pa.string())], schema=_TEXTS)

    hosted = pages.select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "html")
    hosts = hosted.groupBy("host").agg(F.count("*").alias("n"))
    large = hosts.where(F.col("n") > unit_pages).select("host", F.ceil(F.col("n") / unit_pages).cast("int").alias("units"))
    if large.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        large = F.broadcast(large)
    # A seat is what a task holds at a time: a unit, or several small hosts.
    seats = hosts.agg(F.ceil(F.sum("n") / unit_pages)).first()[0] or 1
    parsed = hosted.mapInArrow(parse, "page_id bigint, url string, host string, body binary").join(large, "host", "left").withColumn("units", F.coalesce("units", F.lit(1)))
    parsed = parsed.withColumn("unit", F.pmod(F.xxhash64("page_id", "url", "body"), F.col("units")).cast("int"))
    parsed = parsed.withColumn("seat", F.pmod(F.xxhash64("host", "unit"), F.lit(seats)))

    # The runs are written before anything reads them; pages of hosts of one unit need none.
    shared = parsed.where("units > 1").select("seat", "host", "units", "unit", "body").repartition(buckets(spark), "seat")
    held = stored(shared.groupBy("seat").applyInArrow(runs, RUNS), "runs")
    counted = held.select("host", "kind", "run", "twin", F.explode("streams").alias("stream")).groupBy("host", "kind", "run", "twin").agg(F.count_distinct("stream").alias("n"))
    total = counted.where(F.col("kind") == -1).select("host", F.col("n").alias("total"))
    least_n = F.when(F.col("kind") == ARTICLE, ARTICLE_PAGES).otherwise(OPEN_PAGES)
    share = F.when(F.col("kind") == ARTICLE, ARTICLE_SHARE).otherwise(0.0)
    boiler = counted.where((F.col("kind") >= 0) & (F.col("n") >= least_n)).join(total, "host").where(F.col("n") >= share * F.col("total"))
    judged = held.where(F.col("kind") >= 0).select("seat", "host", "kind", "run", "twin").join(boiler.select("host", "kind", "run", "twin"), ["host", "kind", "run", "twin"]).select("seat", "host", "kind", "run", "twin")
    dealt = parsed.select("seat", "page_id", "url", "host", "units", "unit", "body").repartition(buckets(spark), "seat")
    done = dealt.groupBy("seat").cogroup(judged.groupBy("seat")).applyInArrow(settle, "page_id bigint, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("bigint"))
