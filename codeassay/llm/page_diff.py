"""HTML extraction by nearest-URL page differencing.

Pages are cut into blocks of text. Pages of a host are ordered by URL path, and each is aligned with
its neighbours by the longest common subsequence of their lines; a line that a page shares with a
neighbour is template and goes. Only blocks that markup names as menus, footers, forms and the like go
even where no neighbour has them. Differencing decides on all others, also beside an article; in an
article it takes what both neighbours hold, unless that is a small share (a shared paragraph stays).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from math import isqrt
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeassay.llm.common import BATCH_BYTES, discard, in_batches, order_id, stable, struct_of, table

# Element names of HTML and usual names of page parts.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody tfoot thead tr ul".split()
)
_NEVER = frozenset(
    "nav footer aside form script style noscript template head title button select option textarea iframe svg canvas "
    "object audio video dialog menu map datalist legend".split()
)
#: What a page has and a form of it has not.
_LANDMARKS = frozenset("article main nav header footer h1".split())
_IN_TABLE = frozenset("html body tr tbody thead tfoot caption".split())
_IMPLIED = {
    "li": (("li", frozenset({"ul", "ol", "menu"})),),
    "dt": (("dt", frozenset({"dl"})), ("dd", frozenset({"dl"}))),
    "dd": (("dt", frozenset({"dl"})), ("dd", frozenset({"dl"}))),
    "tr": (("tr", frozenset({"table"})),),
    "body": (("head", frozenset()),),
}
_SPACED = frozenset("br td th img".split())
_SILENT = frozenset("script style head title template svg".split())
#: Whole tokens of a class or id that name a page part.
_CHROME = frozenset(
    "nav navbar navigation nav-menu main-nav site-nav menu menus main-menu site-menu header site-header masthead footer "
    "site-footer sidebar side-bar sidebars ad ads advert adverts advertisement advertisements advertising ad-slot "
    "sponsor sponsored sponsors promo promos banner cookie cookies cookie-notice cookie-banner cookie-consent cookie-bar consent "
    "gdpr notice notices notification notifications alert alerts breadcrumb breadcrumbs comment comments commentlist comment-list "
    "respond disqus disqus_thread replies share sharing share-buttons social social-links social-share related related-posts "
    "recommended newsletter subscribe subscription signup sign-up login search search-form searchform pager pagination "
    "widget widgets popup modal overlay toolbar copyright skip skiplink skip-link hidden".split()
)
#: Names that an article's own parts have too.
_PARTS_OF_ARTICLES = frozenset("header footer notice notices alert alerts".split())
#: Parts of tokens that only make a block doubtful.
_DOUBTFUL = re.compile(
    r"(?:^|[-_\s])(?:nav(?:bar|igation)?|menus?|header|footer|masthead|side-?bar|ads?|adverts?|advert[a-z]*|sponsor(?:ed|s)?|"
    r"promos?|banner|cookies?|consent|gdpr|notices?|notifications?|alerts?|breadcrumbs?|comments?|commentlist|respond|"
    r"disqus|replies|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|"
    r"pag(?:er|ination)|widgets?|popup|modal|overlay|toolbar|copyright|skip(?:link)?|hidden)(?=$|[-_\s])",
    re.I,
)
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: From KEEP on: number of the article a block is in (main elements count as such). OPEN: on a page without
#: one, or doubtful in one. BESIDE: outside the articles of a page. DROP: named as a page part.
KEEP, OPEN, DROP, BESIDE = 1, 0, -1, -2
#: Neighbours that hold at most this share of an article's characters leave it whole.
SMALL_PERCENT = 20
#: What must be left of a page or an article, in characters, that it is no copy, and of a page in percent.
LEFT_CHARS, LEFT_PERCENT = 20, 1
#: A neighbour that has more than this share of a page's characters may be a near copy of it: where there is
#: another neighbour, lines need that one's word too.
COPY_PERCENT = 80


class _Blocks(HTMLParser):
    """Collects the blocks of a page in order.

    Text of dropped inline elements (a button, an advert in a sentence) is left out of its block. Whether a
    class or id drops an element is known at the end only: a named element that turns out to hold an
    article or main element is none, unless it is itself part of an article (as comments are). A form beside
    articles counts as named; one that holds a landmark of the page or its title wraps the page and is none.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Kind, named element and (text, named element) pieces of each block.
        self.found: list[tuple[int, int, list[tuple[str, int]]]] = []
        self._text: list[tuple[str, int]] = []
        #: Named elements: the one around, and whether its name counts. The first stands for none.
        self._around, self._counts, self._of_article, self._form = [0], [False], [False], [False]
        self._articles = 0
        #: Open elements: name, kind, kind of the block they are in, named element, that of the block, in an article.
        self._open: list[tuple[str, int, int, int, int, bool]] = [("", BESIDE, BESIDE, 0, 0, False)]

    def _break(self) -> None:
        if self._text:
            self.found.append((self._open[-1][2], self._open[-1][4], self._text))
            self._text = []

    def blocks(self) -> list[tuple[int, str]]:
        gone = [False]
        for k in range(1, len(self._around)):
            gone.append(self._counts[k] or gone[self._around[k]])
        out = []
        for kind, named, pieces in self.found:
            kind = DROP if gone[named] else kind
            text = " ".join("".join(t for t, n in pieces if kind == DROP or not gone[n]).split())
            if text:
                out.append((kind, text))
        return out

    def _inside(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, int, bool]:
        """Kind, named element and whether in an article, for what is in a new element."""
        _, kind, _, named, _, of_article = self._open[-1]
        if tag in _LANDMARKS:
            k = named
            while k:
                self._counts[k] = self._counts[k] and not self._form[k]
                k = self._around[k]
        if kind == BESIDE and (tag == "form" or ("role", "form") in attrs):
            return kind, self._named(named, of_article, form=True), of_article
        if kind == DROP or tag in _NEVER or (tag == "header" and kind == BESIDE):
            return DROP, named, of_article
        if not attrs and tag not in ("article", "main"):
            return kind, named, of_article
        a = dict(attrs)
        role = (a.get("role") or "").lower()
        if role in _CHROME_ROLES or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true":
            return DROP, named, of_article
        if _HIDDEN.search(a.get("style") or ""):
            return DROP, named, of_article
        if tag in ("article", "main") or role in ("article", "main"):
            k = named
            while self._counts[k] and not self._of_article[k]:
                self._counts[k] = False
                k = self._around[k]
            self._articles += 1
            return self._articles, named, of_article or tag == "article" or role == "article"
        if tag in ("html", "body", "h1", "h2", "h3", "h4", "h5", "h6"):
            return kind, named, of_article
        names = [a.get(k) or "" for k in ("class", "id")]
        for name in names:
            for token in name.lower().split():
                if token in _CHROME and (kind == BESIDE or token not in _PARTS_OF_ARTICLES):
                    return kind, self._named(named, of_article), of_article
        return OPEN if kind >= KEEP and any(map(_DOUBTFUL.search, names)) else kind, named, of_article

    def _named(self, around: int, of_article: bool, form: bool = False) -> int:
        """A new named element inside another one."""
        self._around.append(around)
        self._counts.append(True)
        self._of_article.append(of_article)
        self._form.append(form)
        return len(self._around) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SPACED:
            self._text.append((" ", 0))
        block = tag in _BLOCKS
        if block:
            self._break()
            if tag not in _IN_TABLE:
                self._end("p", _BLOCKS)
            if tag in _IMPLIED:
                for name, until in _IMPLIED[tag]:
                    self._end(name, until)
        if tag not in _VOID:
            kind, named, of_article = self._inside(tag, attrs)
            of_block = (kind, named) if block else (self._open[-1][2], self._open[-1][4])
            self._open.append((tag, kind, of_block[0], named, of_block[1], of_article))

    handle_startendtag = handle_starttag

    def _end(self, tag: str, until: frozenset[str]) -> None:
        """Close ``tag`` and what is open in it, unless an element of ``until`` lies between."""
        for k in range(len(self._open) - 1, 0, -1):
            name = self._open[k][0]
            if name == tag:
                del self._open[k:]
                return
            if name in until:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._break()
            self._end(tag, frozenset())
        else:
            self._end(tag, _BLOCKS)

    def handle_data(self, data: str) -> None:
        name, kind, block, named, *_ = self._open[-1]
        if (kind != DROP or block == DROP) and name not in _SILENT:
            self._text.append((data, named))

    def close(self) -> None:
        super().close()
        self._break()


def blocks_of(html: bytes | None) -> list[tuple[int, str]]:
    """The text blocks of a whole page; a null page has none."""
    parser = _Blocks()
    parser.feed((html or b"").decode())
    parser.close()
    blocks = parser.blocks()
    if any(kind >= KEEP for kind, _ in blocks):
        return blocks
    return [(OPEN if kind == BESIDE else kind, text) for kind, text in blocks]


def place_of(url: bytes | None) -> tuple[str, str]:
    """(host, path) of a URL; query and fragment don't count, and a broken URL is its own path."""
    text = (url or b"").decode()
    try:
        parts = urlsplit(text)
        return (parts.hostname or ""), parts.path.rstrip("/").removesuffix(".html")
    except ValueError:
        return "", text


def common_lines(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Positions of a longest common subsequence of two lists of lines, in either.

    A row of the table of lengths is kept as the bits of an integer: bit j is 0 where the length
    grows at column j, so a row costs one addition. Rows are kept at every k-th line, and those
    between are computed again on the way back, so memory grows with the square root of the lines.
    """
    both = set(a) & set(b)
    rows = [k for k, line in enumerate(a) if line in both]
    cols = [k for k, line in enumerate(b) if line in both]
    masks = dict.fromkeys(both, 0)
    for j, k in enumerate(cols):
        masks[b[k]] |= 1 << j
    full = (1 << len(cols)) - 1
    every = max(16, isqrt(len(rows)))

    def after(state: int, row: int) -> int:
        met = state & masks[a[rows[row]]]
        return (state + met | state - met) & full

    saved, state = [full], full
    for row in range(len(rows)):
        state = after(state, row)
        if (row + 1) % every == 0:
            saved.append(state)
    in_a, in_b, j = set(), set(), len(cols)
    for block in range(len(rows) // every, -1, -1):
        first = block * every
        states = [saved[block]]
        for row in range(first, min(first + every, len(rows))):
            states.append(after(states[-1], row))
        i = len(states) - 1
        while i and j:
            if states[i] >> (j - 1) & 1:
                j -= 1
            elif not states[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                in_a.add(rows[first + i])
                in_b.add(cols[j])
    return in_a, in_b


def main_text(
    blocks: list[tuple[int, str]], shared: set[int], met: bool | None = None, both: set[int] | None = None
) -> str:
    """The text without template, given the blocks that a neighbour shares and those that ``both`` do.

    ``met`` tells whether there was a neighbour to compare with. Without one, text beside articles stays
    if it is longer than theirs. An article of which both neighbours leave nothing is a teaser if more
    than its text is left of the page, or else one that has copies, and stays.
    """
    met = bool(shared) if met is None else met
    both = shared if both is None else both
    size, held, beside, left = {}, {}, 0, 0
    for k, (kind, text) in enumerate(blocks):
        if kind >= KEEP:
            size[kind] = size.get(kind, 0) + len(text)
            held[kind] = held.get(kind, 0) + (len(text) if k in both else 0)
            left += len(text) if k not in both else 0
        elif kind != DROP:
            beside += len(text) if kind == BESIDE else 0
            left += len(text) if k not in shared and (met or kind == OPEN) else 0
    alone = met or beside > sum(size.values())
    decided = {
        n: 100 * held[n] > SMALL_PERCENT * size[n] and (size[n] - held[n] >= LEFT_CHARS or left > size[n]) for n in size
    }

    def stays(k: int, kind: int) -> bool:
        if kind >= KEEP:
            return k not in both or not decided[kind]
        return kind == OPEN and k not in shared or kind == BESIDE and alone and k not in shared

    return "\n".join(t for k, (kind, t) in enumerate(blocks) if stays(k, kind))


@dataclass
class Verdict:
    """What a neighbour says of a page: the blocks both have, and whether it may be a near copy."""

    shared: set[int]
    near: bool


def compare(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> tuple[Verdict | None, Verdict | None]:
    """The verdicts of two neighbours on each other; none on a page of which the other leaves almost nothing."""
    found = common_lines([t for _, t in a], [t for _, t in b])

    def verdict(blocks: list[tuple[int, str]], shared: set[int]) -> Verdict | None:
        size = sum(len(t) for kind, t in blocks if kind != DROP)
        left = sum(len(t) for k, (kind, t) in enumerate(blocks) if kind != DROP and k not in shared)
        if left < LEFT_CHARS or 100 * left < LEFT_PERCENT * size:
            return None
        return Verdict(shared, 100 * left < (100 - COPY_PERCENT) * size)

    return verdict(a, found[0]), verdict(b, found[1])


def shared_blocks(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> tuple[set[int], set[int]]:
    """Blocks that two neighbours share; none on a page of which the other is a copy."""
    left, right = compare(a, b)
    return (left.shared if left else set()), (right.shared if right else set())


def judged(blocks: list[tuple[int, str]], left: Verdict | None, right: Verdict | None) -> tuple[str, int]:
    """Text of a page after the verdicts of its neighbours, and how many blocks they share."""
    none = Verdict(set(), False)
    one, two = left or none, right or none
    both, either = one.shared & two.shared, one.shared | two.shared
    shared = either
    if left and right:
        shared = both | (set() if left.near else left.shared) | (set() if right.near else right.shared)
    return main_text(blocks, shared, bool(left or right), both), len(either)


def core_of(blocks: list[tuple[int, str]]) -> bytes:
    """Digest of the blocks that aren't named page parts; empty if there are none."""
    core = [f"{kind} {text}" for kind, text in blocks if kind != DROP]
    return xxhash.xxh3_128_digest("\n".join(core)) if core else b""


def _placed(pages: DataFrame) -> DataFrame:
    """page (null ids last), url and html with host and path, by which pages are ordered."""

    def run(urls: pa.Array) -> pa.Array:
        found = [place_of(u) for u in urls.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["host", "path"])

    place = F.arrow_udf(run, struct_of(T.StringType(), "host", "path"))
    return pages.select(
        place("url").alias("place"), order_id("page_id").alias("page"), F.col("page_id").cast("long").alias("page_id"), "url", "html"
    ).select("place.host", "place.path", F.coalesce("url", F.lit("")).alias("link"), "page", "page_id", "url", "html")


_ORDER = ("host", "path", "link", "page", "core")
_KEY = "host string, path string, link string, page long, core binary"


def _key(host: bytes, path: bytes, link: bytes, page: int, core: bytes) -> tuple:
    return host.decode(), path.decode(), link.decode(), page, core


def _page(key: tuple | None) -> tuple | None:
    """Host and core: equal pages of a host, next to each other, have the same neighbours."""
    return key and (key[0], key[4])


def _bounds(placed: DataFrame) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """First keys of ranges of the order, and the ranges to which pages outside of them are neighbours.

    The neighbours of a range are the nearest pages before and after it that are not equal to its first
    and last one, however many ranges the equal ones fill. Six keys for each range come to the driver.
    """
    spark = placed.sparkSession

    def keys(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            core = [core_of(blocks_of(html)) for html in b.pop("html")]
            yield {k: [v.decode() for v in b[k]] if k != "page" else b[k] for k in _ORDER[:4]} | {"core": core}

    found = stable(in_batches(placed.select(*_ORDER[:4], "html"), keys, _KEY))

    def ends(batches: Iterator[dict]) -> Iterator[dict]:
        low = first = second = last = other = None
        for b in batches:
            for row in zip(*(b[k] for k in _ORDER), strict=True):
                key = _key(*row)
                low = low or key
                if not key[4]:
                    continue
                first = first or key
                if second is None and _page(key) != _page(first):
                    second = key
                if last is not None and _page(key) != _page(last):
                    other = last
                last = key
        if low:
            yield {"low": [low], "first": [first], "second": [second], "last": [last], "other": [other]}

    names = _ORDER
    pack = lambda out: {k: [v and dict(zip(names, v, strict=True)) for v in vs] for k, vs in out.items()}
    fields = _KEY.replace(" ", ": ").replace(",: ", ", ")
    parts = found.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *_ORDER).sortWithinPartitions(*_ORDER)
    rows = in_batches(
        parts, lambda batches: map(pack, ends(batches)), ", ".join(f"{k} struct<{fields}>" for k in ("low", "first", "second", "last", "other"))
    ).collect()
    unpack = lambda r: r and (*tuple(r)[:4], bytes(r.core))
    found_ends = sorted((tuple(map(unpack, r)) for r in rows), key=lambda r: r[0])
    discard(found)
    belongs: dict[tuple, list[int]] = {}
    for step in (1, -1):
        near = far = None  # the nearest page so far, and the nearest that is not equal to it
        for k in range(len(found_ends))[::step]:
            _, first, second, last, other = found_ends[k]
            if first is None:
                continue
            if step < 0:
                first, second, last, other = last, other, first, second
            wanted = near if _page(near) != _page(first) else far
            if wanted and wanted[0] == first[0]:
                belongs.setdefault(wanted, []).append(k)
            far = other or (near if _page(near) != _page(last) else far)
            near = last
    return [r[0] for r in found_ends], belongs


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html; others are ignored): page_id, url, text, n_blocks, n_shared.

    ``n_shared`` counts the blocks that a neighbour (the previous or next page of the host by path,
    then URL, then id, that isn't equal but for named page parts) has in common with the page. A page of
    nothing but such parts is no neighbour and has none. A null page has no blocks and an empty text.
    Ranges of that order are dealt to tasks together with the neighbours of their first and last
    pages: results don't depend on where ranges end, and a host or a group of copies may fill many of them.
    """
    placed = _placed(pages)
    bounds = _bounds(placed)
    shared = pages.sparkSession.sparkContext.broadcast(bounds)

    def deal(batches: Iterator[dict]) -> Iterator[dict]:
        lows, belongs = shared.value
        for b in batches:
            for start in range(0, len(b["page"]), 200):
                out: dict[str, list] = {k: [] for k in ("part", "own", *_ORDER, "page_id", "url", "kinds", "texts")}
                part = {k: v[start : start + 200] for k, v in b.items()}
                for host, path, link, page, page_id, url, html in zip(*part.values(), strict=True):
                    blocks = blocks_of(html)
                    place = _key(host, path, link, page, core_of(blocks))
                    own = max(0, bisect_right(lows, place) - 1)
                    for to in (own, *belongs.get(place, ())):
                        row = (to, to == own, *place, page_id, url and url.decode(), [k for k, _ in blocks], [t for _, t in blocks])
                        for name, value in zip(out, row, strict=True):
                            out[name].append(value)
                yield out

    def difference(batches: Iterator[dict]) -> Iterator[dict]:
        def result(rows: list[tuple], blocks: list[tuple[int, str]], left: Verdict | None, right: Verdict | None) -> dict:
            text, n_shared = judged(blocks, left, right)
            at_once = 1 + BATCH_BYTES // (200 + len(text))
            for start in range(0, len(rows), at_once):
                some = rows[start : start + at_once]
                yield {
                    "page_id": [r[0] for r in some],
                    "url": [r[1] for r in some],
                    "text": [text] * len(some),
                    "n_blocks": [len(blocks)] * len(some),
                    "n_shared": [n_shared] * len(some),
                }

        def closed(run: dict, after: list[tuple[int, str]] | None) -> Iterator[dict]:
            for blocks, left, rows in run.values():
                if rows:
                    right = compare(blocks, after)[0] if after else None
                    yield from result(rows, blocks, left, right)

        # Equal pages in a row: by their blocks, named parts too, what they are, the verdict from before, and rows.
        run: dict[bytes, tuple[list, Verdict | None, list]] = {}
        place = before = latest = None
        for b in batches:
            for row in zip(*b.values(), strict=True):
                page = dict(zip(b, row, strict=True))
                blocks = [(k, t.decode() if isinstance(t, bytes) else t) for k, t in zip(page["kinds"], page["texts"], strict=True)]
                mine = [(page["page_id"], page["url"])] if page["own"] else []
                if not page["core"]:
                    yield from result(mine, blocks, None, None)
                    continue
                here = (page["part"], page["host"], page["core"])
                if here != place:
                    near = place is not None and here[:2] == place[:2]
                    yield from closed(run, blocks if near else None)
                    before, run, place = (latest if near else None), {}, here
                latest = blocks
                key = xxhash.xxh3_128_digest("\n".join(f"{k} {t}" for k, t in blocks))
                if key not in run:
                    run[key] = (blocks, compare(before, blocks)[1] if before else None, [])
                run[key][2].extend(mine)
        yield from closed(run, None)

    kinds = f"{_KEY}, page_id long, url string, kinds array<int>, texts array<string>"
    dealt = in_batches(placed, deal, f"part int, own boolean, {kinds}")
    sorted_parts = dealt.repartitionById(max(1, len(bounds[0])), F.col("part")).sortWithinPartitions("part", *_ORDER)
    found = in_batches(
        sorted_parts, difference, "page_id long, url string, text string, n_blocks int, n_shared int"
    )
    return found


def op1_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_shared")
