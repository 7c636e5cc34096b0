"""HTML extraction: nearest-URL page differencing over the text lines of pages.

Each page is cut into text lines (one per block element) by a tolerant scanner, linear in the
page. Scripts, forms, menus, headers, footers, adverts, reader comments and the like are left
out by element, role, class or id; an article in a form or in an element with such a class
or id is not, and inside an article a single word that topics have too marks nothing.

Every page is then paired with the pages whose URL paths are nearest on the same host, one
before and one after it, the pages' lines are aligned by longest common subsequence, and the
lines that they share are template text: they are deleted. Articles quote each other and pages
are copied, so a shared line is spared where the alignment itself says that it is no template:

* a neighbour that shares nearly all of the page's text is a copy and tells nothing; pages
  in a row with nearly the same text look on to the nearest page before and after the row;
* inside an article element a line goes only with its whole block (what one path of sections,
  divisions and lists holds): if both neighbours share every line of the block, and the blocks
  that go are not most of the article. A shared line among lines of the page's own is a
  quotation and stays, as do headings and quoted blocks, which belong to the block around them;
* on a page that marks no article every shared line goes, unless the neighbour shares more
  than half of the page's text: then of the two the one that shares less decides.

Pages travel as hashes of their lines, sorted by (host, path with padded numbers) in buckets
cut at bounds from the keys with the smallest hashes; a busy host spans many buckets, and a
task holds one row of copies at a time (equal ones once). The pages at the edges of a bucket
are sent along to the buckets beside it, so that no page lacks a neighbour for a bound.
Which lines to delete comes back for the pages that lose any; the pages are read a second
time for their text, so that html is not shuffled (unless most pages lose lines).

Null html counts as empty and gives an empty text. A null url, or one without a host, has no
neighbours. Repeated rows stay (and are copies of each other, so delete nothing). An empty
table gives an empty result. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import bounded_batches, lean, materialize, range_bucket, shuffle_width, text_array

# ------------------------------------------------------------------ lines of a page

_OPEN = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
_ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: The same where quotes are not closed.
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLASS = re.compile(r"""(?<![^\s"'])class\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math object canvas audio video select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Of these, the ones that end with the page if nothing closes them; the start tags of others are passed over then.
ENDLESS = frozenset("script style textarea title xmp".split())
#: Elements whose path names the block that a line belongs to.
CONTAINERS = frozenset("article aside details div dl fieldset footer form header main menu nav ol section ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form head menu button dialog fieldset label search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tablist".split())
#: Words of a class or id that mark boilerplate.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav footer cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations comment comments reply replies disqus discussion login signin signup search pagination pager widget widgets toolbar masthead topbar paywall copyright".split()
)
#: Of these, the ones that headings and topics of an article have too: inside an article one alone marks nothing.
AMBIGUOUS = frozenset(
    "banner menu navigation notice notification alert consent copyright promotion share sharing social related recommended recommendations comment reply replies discussion search subscription overlay modal login".split()
)
#: Words that make one of those plain.
HELPERS = frozenset("bar box button buttons container form icons links list panel posts articles stories".split())
CONTENT = frozenset(["article", "main"])
#: What hides an element's lines: a form and a class or id give way to an article inside, the rest does not.
FORM, MARKED, HARD = 1, 2, 3
#: Elements that a new one of the same list ends.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _boilerplate(tag: str, attributes: str, in_article: bool) -> int:
    """0, or what makes the element boilerplate."""
    level = HARD if (tag in BOILERPLATE and tag != "form") or (tag == "header" and not in_article) else FORM if tag == "form" else 0
    if level == HARD or not attributes or tag in ("html", "body", "main"):
        return level
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return HARD
    role = found.get("role", "").lower()
    if role in ROLES and role != "form":
        return HARD
    if level or role == "form":
        return FORM
    words = {w.lower() for key in ("class", "id") for w in _NAME_PARTS.findall(found.get(key, ""))}
    marks = words & (WORDS if tag != "article" else {"comment", "comments", "reply", "ad", "advert", "sponsored", "promo", "related"})
    if in_article and tag != "article" and marks <= AMBIGUOUS and len(marks) + len(words & HELPERS) < 2:
        return 0
    return MARKED if marks else 0


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """(line, kind, block) in page order; kind 0 boilerplate, 1 elsewhere, 2 inside an article.

    Lines of one block have the same path of containers (elements and their classes). An
    article inside a form is one. An article inside an element that its class or id marks
    is one unless the page has its text elsewhere: then it is a teaser or a comment.
    """
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    stack: list[tuple] = []  # open elements: name; what makes each boilerplate; the state that an article inside such interrupts; path
    opened: Counter = Counter()  # open elements by name
    inner: list[Counter] = [Counter()]  # the same, outside content elements and inside each
    hidden = [0, 0, 0, 0]  # open elements by what makes them boilerplate
    inside = articles = 0
    wrapped = whole = False
    blocks: dict[int, int] = {}

    def flush() -> None:
        nonlocal whole
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                kind = 0 if any(hidden) else 1 if not inside else 3 if wrapped else 2
                whole |= kind == 2 and articles > 0
                lines.append((text, kind, blocks.setdefault(stack[-1][3] if stack else 0, len(blocks))))
            parts.clear()

    def close(k: int) -> None:
        nonlocal inside, articles, wrapped
        while len(stack) > k:
            name, level, before, _ = stack.pop()
            if name in CONTENT:
                inner.pop()
            inner[-1][name] -= 1
            opened[name] -= 1
            if level:
                hidden[level] -= 1
            inside -= name in CONTENT
            articles -= name == "article"
            if before is not None:
                hidden[FORM], hidden[MARKED], wrapped = before

    def innermost(tag: str) -> int:
        """Place of the open element that an end tag closes, -1 if none; a p, li or b outside an article is not closed inside it."""
        if (inner[-1] if tag in ("p", "li", "b") else opened)[tag] <= 0:
            return -1
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)

    at, n = 0, len(page)
    quoted = True
    unclosed: set[str] = set()
    while at < n:
        found = _OPEN.search(page, at)
        if found is None:
            parts.append(page[at:])
            break
        if found.start() > at:
            parts.append(page[at : found.start()])
        at = found.start()
        if page[at + 1] in "!?":
            at = _ASIDE.match(page, at).end()
            continue
        m = _TAG.match(page, at) if quoted else None
        if m is None:
            quoted = False  # a quote that nothing closes: from here on tags end at their first >
            m = _LOOSE_TAG.match(page, at)
            if m is None:  # a tag that the page's end cuts off
                break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            k = innermost(tag)
            if k >= 0:
                flush()
                close(k)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            if end:
                at = end.end()
            elif tag in ENDLESS:
                break
            else:
                unclosed.add(tag)
            continue
        if tag in BLOCK:
            flush()
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in _SIBLINGS and stack and stack[-1][0] in _SIBLINGS[tag]:
                close(len(stack) - 1)
        if tag in VOID:
            continue
        level = _boilerplate(tag, m[3] or "", inside > 0)
        if tag in BLOCK or level:
            if level:
                flush()
            before = None
            if tag in CONTENT and not level and not hidden[HARD] and any(hidden):
                before = (hidden[FORM], hidden[MARKED], wrapped)
                wrapped = wrapped or hidden[MARKED] > 0
                hidden[FORM] = hidden[MARKED] = 0
            path = stack[-1][3] if stack else 0
            if tag in CONTAINERS:
                of = _CLASS.search(m[3]) if "lass" in m[3] or "LASS" in m[3] else None
                path = zlib.crc32(f"{tag} {of[0] if of else ''}".encode("utf-8", "surrogatepass"), path + 1)
            stack.append((tag, level, before, path))
            inner[-1][tag] += 1
            opened[tag] += 1
            if tag in CONTENT:
                inner.append(Counter())
            if level:
                hidden[level] += 1
            inside += tag in CONTENT
            articles += tag == "article"
    flush()
    sizes = [sum(len(text) for text, kind, _ in lines if kind == k) for k in (2, 3)]
    teaser = 0 if whole or sizes[0] >= sizes[1] else 2
    return [(text, teaser if kind == 3 else kind, block) for text, kind, block in lines]


# ------------------------------------------------------------------ alignment


#: Bits of an alignment's table that are held at once.
TABLE_BITS = 1 << 28


def _rows(own: list[int], places: dict[int, int], width: int) -> Iterator[int]:
    """For each line of ``own`` the row of the length table as bits: bit j is 0 where the length grows from column j to j + 1 (Hyyro 2004)."""
    full = (1 << width) - 1
    row = full
    for x in own:
        both = row & places.get(x, 0)
        row = ((row + both) | (row - both)) & full
        yield row


def _places(other: list[int]) -> dict[int, int]:
    at: dict[int, list[int]] = {}
    for j, x in enumerate(other):
        at.setdefault(x, []).append(j)
    width = len(other) + 7 >> 3
    found = {}
    for x, js in at.items():
        bits = bytearray(width)
        for j in js:
            bits[j >> 3] |= 1 << (j & 7)
        found[x] = int.from_bytes(bits, "little")
    return found


def _lengths(own: list[int], other: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``own`` with each beginning of ``other``."""
    row = (1 << len(other)) - 1
    for row in _rows(own, _places(other), len(other)):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(other) + 7 >> 3, "little"), dtype=np.uint8), bitorder="little")[: len(other)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _align(own: list[int], other: list[int], base: int, found: set[int]) -> None:
    if not own or not other:
        return
    if len(own) * len(other) > TABLE_BITS and len(own) > 1:  # Hirschberg's halves
        half = len(own) // 2
        ahead, back = _lengths(own[:half], other), _lengths(own[half:][::-1], other[::-1])
        cut = int(np.argmax(ahead + back[::-1]))
        _align(own[:half], other[:cut], base, found)
        _align(own[half:], other[cut:], base + half, found)
        return
    rows = list(_rows(own, _places(other), len(other)))
    i, j = len(own), len(other)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.add(base + i)


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Positions in ``own`` of a longest common subsequence with ``other``: equal ends first, then only lines that both have, 64 pairs a machine word."""
    low, high = 0, 0
    least = min(len(own), len(other))
    while low < least and own[low] == other[low]:
        low += 1
    while high < least - low and own[-1 - high] == other[-1 - high]:
        high += 1
    found = {*range(low), *range(len(own) - high, len(own))}
    both = set(own[low : len(own) - high]) & set(other[low : len(other) - high])
    at = [i for i in range(low, len(own) - high) if own[i] in both]
    inner: set[int] = set()
    _align([own[i] for i in at], [x for x in other[low : len(other) - high] if x in both], 0, inner)
    return found | {at[i] for i in inner}


#: Two pages are copies if this share of the characters of each is in lines of the other.
COPY_SHARE = 0.95


def copies(one: list[int], one_sizes: list[int], other: list[int], other_sizes: list[int]) -> bool:
    """Whether two pages' lines (boilerplate left out) are nearly the same text."""
    if one == other:
        return True
    least, most = sorted((sum(one_sizes), sum(other_sizes)))
    if least <= COPY_SHARE * most:
        return False
    shared = shared_lines(one, other)
    return sum(one_sizes[k] for k in shared) > COPY_SHARE * most


def template_lines(lines: list[int], kinds: bytes, sizes: list[int], blocks: list[int], neighbours: list[list[int]], copy_share: float = COPY_SHARE) -> list[int]:
    """Positions of the lines to delete; ``neighbours`` are the lines of near pages, the nearest first."""
    marked = 2 in kinds
    kept = [k for k, kind in enumerate(kinds) if kind == (2 if marked else 1)]
    total = sum(sizes[k] for k in kept)
    found = []
    for other in neighbours:
        shared = shared_lines(lines, other)
        gone = [k for k in kept if k in shared]
        size = sum(sizes[k] for k in gone)
        if size <= copy_share * total:
            found.append((size, len(found), gone))
            if not marked and 2 * size <= total:
                return gone
    if not found:
        return []
    if not marked:
        return min(found)[2]
    common = set(found[0][2]).intersection(*(gone for _, _, gone in found[1:]))
    own = {blocks[k] for k in kept if k not in common}
    gone = [k for k in kept if blocks[k] not in own]
    return gone if 2 * sum(sizes[k] for k in gone) <= total else []


def main_text(lines: list[tuple[str, int, int]], deleted: set[int] = frozenset()) -> str:
    """The article's lines joined; without a marked article, the lines that are not boilerplate; without deleted ones."""
    best = max((kind for _, kind, _ in lines), default=0)
    return "\n".join(text for k, (text, kind, _) in enumerate(lines) if kind == best and kind and k not in deleted)


# ------------------------------------------------------------------ operator


def url_key(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and the path with numbers padded so that near numbers sort together."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    padded = F.regexp_replace(F.regexp_replace(path, r"(\d+)", "000000000000$1"), r"\d*(\d{12})", "$1")
    return F.coalesce(host, F.lit("")), F.coalesce(padded, F.lit(""))


_LINES = "page_id {}, version long, host string, path string, bucket int, side int, lines binary, kinds binary, sizes binary, blocks binary"
_NAMES = ("page_id", "version", "host", "path", "bucket", "side", "lines", "kinds", "sizes", "blocks")
#: Order of a bucket's rows: pages of buckets before (side 0), its own (1), pages of buckets after (2).
_ORDER = ("bucket", "side", "host", "path", "page_id", "version")


@lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, kinds, sizes, blocks = [], [], [], []
        for page in text_array(batch.column("html")).to_pylist():
            lines = page_lines(page)
            hashes.append(b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t, _, _ in lines))
            kinds.append(bytes(k for _, k, _ in lines))
            sizes.append(np.array([len(t) for t, _, _ in lines], dtype=np.int32).tobytes())
            blocks.append(np.array([b for _, _, b in lines], dtype=np.int32).tobytes())
        columns = [batch.column(c) for c in _NAMES[:6]]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.binary()) for c in (hashes, kinds, sizes, blocks))], names=list(_NAMES))


class _Page:
    """A row of _NAMES; its lines are decoded while its run is compared."""

    def __init__(self, row: tuple):
        self.row = row
        self.page_id, self.version, self.host, self.path, self.bucket, self.side = row[:6]

    def lines(self) -> list[int]:
        return np.frombuffer(self.row[6], dtype=np.int64).tolist()

    def sizes(self) -> list[int]:
        return np.frombuffer(self.row[8], dtype=np.int32).tolist()

    def blocks(self) -> list[int]:
        return np.frombuffer(self.row[9], dtype=np.int32).tolist()

    def content(self) -> tuple[list[int], list[int]]:
        kinds = self.row[7]
        return [h for h, k in zip(self.lines(), kinds, strict=True) if k], [n for n, k in zip(self.sizes(), kinds, strict=True) if k]


def _near(one: _Page, other: _Page | None) -> bool:
    return other is not None and one.host != "" and other.host == one.host and other.bucket == one.bucket


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[_Page] | pa.DataType]:
    """The type of page_id once a batch, and rows of pages of one bucket and host that are copies of their first."""
    run: list[_Page] = []
    first: tuple[list[int], list[int]] = ([], [])
    for batch in batches:
        yield batch.column("page_id").type
        for row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
            page = _Page(row)
            if run and _near(run[0], page):
                if row[6:] == run[0].row[6:]:
                    page.row = (*row[:6], *run[0].row[6:])  # held once
                    run.append(page)
                    continue
                own = page.content()
                if copies(*first, *own):
                    run.append(page)
                    continue
            if run:
                yield run
            run, first = [page], page.content()
    if run:
        yield run


@lean
def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket the first pages of the first two runs of its first host (side 2: they go to buckets before), and the last pages of the last two runs of its last host (side 0)."""
    kept: list[tuple[_Page, _Page]] = []  # first and last page of runs of one bucket: two of the first host, two of the last
    hosts = 0
    ids: pa.DataType | None = None

    def rows() -> Iterator[tuple]:
        heads = [r for r in kept[:2] if r[0].host == kept[0][0].host]
        tails = [r for r in kept[::-1][:2] if r[0].host == kept[-1][0].host]
        whole = len(kept) == 1 and hosts == 1
        for side, pages in ((2, [r[0] for r in heads]), (0, [r[1] for r in tails])):
            for page in pages:
                yield (*page.row[:5], side, *page.row[6:], whole)

    def drain(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 11
        types = (ids, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[*_NAMES, "whole"])

    for run in _runs(batches):
        if isinstance(run, pa.DataType):
            ids = run
            continue
        pair = (run[0], run[-1])
        if kept and kept[0][0].bucket != pair[0].bucket:
            yield drain(list(rows()))
            kept, hosts = [], 0
        hosts += not kept or kept[-1][0].host != pair[0].host
        kept.append(pair)
        if len(kept) > 4:
            del kept[2]
    if kept:
        yield drain(list(rows()))


def _deal_edges(edges: list) -> list[tuple[int, int, int, int]]:
    """(bucket, side, version, bucket that it is sent to) for rows of _edges without lines: on to the first bucket that is more than one run of the host."""
    sent = set()
    for side in (0, 2):
        by: dict[int, list] = {}
        for e in edges:
            if e.host != "":
                by.setdefault(e.bucket, [[], []])[e.side != side].append(e)
        order = sorted(by, reverse=side == 0)
        for k, bucket in enumerate(order):
            hosts = {e.host for e in by[bucket][1]}  # of this bucket's end that meets the others
            if not hosts:
                continue
            seen = set()
            for other in order[k + 1 :]:
                given = [e for e in by[other][0] if e.host in hosts]
                sent.update((e.bucket, e.side, e.version, bucket) for e in given if e.content not in seen)
                seen.update(e.content for e in given)
                if not given or not given[0].whole:
                    break
    return sorted(sent)


@lean
def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages arrive in order; a run of copies is decided once the page after it is known. Pages that lose no line have no row."""
    before: _Page | None = None  # the last page of the run before
    held: list[_Page] = []
    ids: pa.DataType | None = None
    out: list[tuple] = []

    def decide(run: list[_Page], after: _Page | None) -> None:
        known: dict[tuple, list[int]] = {}
        beside = [p for p in (before, after) if _near(run[0], p)]
        others = [p.lines() for p in beside]
        for page in run:
            if page.side != 1 or not beside:
                continue
            nearest = sorted(range(len(beside)), key=lambda k: (-len(os.path.commonprefix([page.path, beside[k].path])), k))
            key = (id(page.row[6]), *nearest)
            if key not in known:
                known[key] = template_lines(page.lines(), page.row[7], page.sizes(), page.blocks(), [others[k] for k in nearest])
            if known[key]:
                out.append((page.page_id, page.version, np.array(known[key], dtype=np.int32).tobytes()))

    def drain() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (ids, pa.int64(), pa.binary()), strict=True)], names=["page_id", "version", "deleted"])

    for run in _runs(batches):
        if isinstance(run, pa.DataType):
            ids = run
            if out:
                yield drain()
            continue
        if held:
            decide(held, run[0])
            before = held[-1]
        held = run
    if held:
        decide(held, None)
        yield drain()


@lean
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, deleted in zip(text_array(batch.column("html")).to_pylist(), batch.column("deleted").to_pylist(), strict=True):
            gone = set(np.frombuffer(deleted, dtype=np.int32).tolist()) if deleted else set()
            texts.append(main_text(page_lines(page), gone))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    host, path = url_key(F.col("url"))
    key = F.concat_ws("\u0001", "host", "path")
    width = shuffle_width(spark)
    n = 4 * width
    some = pages.select("url").withColumns({"host": host, "path": path}).select(key.alias("key"))
    keys = sorted(r.key for r in some.orderBy(F.xxhash64("key"), "key").limit(16 * n).collect())  # a bounded number of URLs
    n = min(n, len(keys) // 16)  # a small table has few buckets, so that pages have neighbours
    bounds = sorted({keys[len(keys) * k // n] for k in range(1, n)})
    rows = pages.select("page_id", "url", "html", F.xxhash64("html").alias("version"))
    kind = rows.schema["page_id"].dataType.simpleString()
    located = rows.withColumns({"host": host, "path": path}).withColumn("bucket", range_bucket(key, bounds))
    schema = _LINES.format(kind)
    cut = materialize(located.withColumn("side", F.lit(1)).mapInArrow(_cut, schema), "page-hashes")
    if bounds:
        ordered = cut.repartition(width, "bucket").sortWithinPartitions(*_ORDER)
        edges = materialize(ordered.mapInArrow(_edges, f"{schema}, whole boolean"), "page-edges")  # at most four pages a bucket
        facts = edges.select("bucket", "side", "version", "host", "whole", F.xxhash64("lines", "kinds").alias("content")).collect()
        dealt = _deal_edges(facts)
        if dealt:
            seats = spark.createDataFrame(dealt, "bucket int, side int, version long, target int")
            sent = edges.join(F.broadcast(seats), ["bucket", "side", "version"])
            cut = cut.unionByName(sent.withColumn("bucket", F.col("target")).select(*_NAMES))
    cut = cut.repartition(width, "bucket").sortWithinPartitions(*_ORDER)
    decided = materialize(cut.mapInArrow(_differ, f"page_id {kind}, version long, deleted binary").dropDuplicates(["page_id", "version"]), "page-lines")
    if decided.limit(1).count():
        rows = rows.join(decided, ["page_id", "version"], "left")
    else:
        rows = rows.withColumn("deleted", F.lit(None).cast("binary"))
    return rows.mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")
