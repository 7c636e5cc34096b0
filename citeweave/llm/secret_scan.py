"""Secret scans: patterns, and sliding-window Shannon entropy per character class.

Base spans come from three patterns (``assign``, ``access``, ``hex``). The entropy scan adds
spans of kind ``entropy``: candidate strings are runs of token characters; a window slides
over each, its counts of characters kept up to date by one addition and one removal per
step, and the window's entropy is compared with the threshold of the narrowest character
class that holds the window (hexadecimal, upper case and digits, base64). Windows above it
are joined. An allow list takes back joined spans that are known not to be secrets: UUIDs,
numbers, words, paths of words, and placeholders if nothing but such stands beside them. Words
are told from random letters by their pairs of letters, not by lacking digits; and what a base span covers is not said twice: of an entropy span, only the pieces outside
the base spans are kept, however short, as they are part of the same secret.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Each document
is scanned whole, on its own: no shuffle, and a task holds one Arrow batch. Rows that repeat
stay; an empty table gives an empty result; input columns with the names of result columns
are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from citeweave.llm.common import bounded_batches, lean, text_array

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: In ASCII mode no letter outside A-Z matches one of the keywords; this finds texts without any in one pass each.
KEYWORDS = ("pass", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

WINDOW = 20
#: (class, its characters, bits per character from which a window is taken for random)
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF-"), 2.9),
    ("upper", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"), 3.4),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.7),
)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NUMBERS = re.compile(r"[0-9_/=+-]*")
#: Strings without digits, a word with a number, paths and names of words; their letters must look like words.
NAMES = (
    re.compile(r"[^0-9]*"),
    re.compile(r"[A-Za-z]*[a-z][A-Za-z]*[0-9]{0,4}"),
    re.compile(r"[A-Za-z]+([/_-][A-Za-z]+)*([/_-][0-9]{1,8})?/?"),
)
PLACEHOLDER = re.compile(r"example|sample|placeholder|your[_-]?|x{6,}|0{8,}|1234567(?:89?0?)?", re.IGNORECASE)
#: Pairs of consonants that words of European languages have; other pairs of consonants are rare.
_PAIRS = frozenset(
    "bb bj bl br bs bt cc ch ck cl cr cs ct dd dg dl dm dn dr ds dt dv dw ff fl fr fs ft gg gh gl gm gn gr gs gt hl hm hn hr hs ht hw kk kl kn kr ks kt lb lc ld lf lg lh lk ll lm ln lp lr ls lt lv lw mb mf ml mm mn mp mr ms mt nb nc nd nf ng nh nj nk nl nm nn np nq nr ns nt nv nw nz pf ph pl pn pp pr ps pt rb rc rd rf rg rh rj rk rl rm rn rp rq rr rs rt rv rw rz sb sc sd sf sg sh sk sl sm sn sp sq sr ss st sv sw tb tc tf th tl tm tn tp tr ts tt tw tz wh wl wn wr ws xc xp xt zt zw zz".split()
)
#: Most rare pairs, and rare pairs and capitals after a small letter together, in a window of letters like words (random letters: about 7 and 10).
RARE, BREAKS = 2, 5
#: c log2(c) in fixed point, so that sums over a text of any length stay exact.
_ONE = 1 << 40
_TERM = [0] + [round(c * math.log2(c) * _ONE) for c in range(1, WINDOW + 1)]


def _entropy_windows(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined spans of windows whose entropy exceeds the threshold of their class."""
    upper = CLASSES[1][1]
    not_hex = [c not in CLASSES[0][1] for c in text]
    not_upper = [c not in upper for c in text]
    counts: dict[str, int] = {}
    total, outside_hex, outside_upper = 0, 0, 0
    spans: list[tuple[int, int]] = []
    most, scale = math.log2(window), window * _ONE
    for i, c in enumerate(text):
        if i >= window:
            old = text[i - window]
            n = counts[old]
            total -= _TERM[n] - _TERM[n - 1]
            counts[old] = n - 1
            outside_hex -= not_hex[i - window]
            outside_upper -= not_upper[i - window]
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        outside_hex += not_hex[i]
        outside_upper += not_upper[i]
        if i >= window - 1:
            bits = most - total / scale
            level = CLASSES[0][2] if not outside_hex else CLASSES[1][2] if not outside_upper else CLASSES[2][2]
            if bits >= level:
                low = i - window + 1
                if spans and low <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((low, i + 1))
    return spans


def word_like(text: str, window: int = WINDOW) -> bool:
    """Whether in each window few neighbouring letters are pairs that words lack."""
    rare, breaks = [0], [0]  # sums up to each pair
    for a, b in zip(text, text[1:], strict=False):
        letters = a.isalpha() and b.isalpha()
        camel = letters and a.islower() and b.isupper()
        pair = (a + b).lower()
        odd = letters and not camel and pair not in _PAIRS and not set(pair) & set("aeiouy")
        rare.append(rare[-1] + odd)
        breaks.append(breaks[-1] + (odd or camel))
    last = len(rare) - 1
    width = min(window - 1, last)
    return all(rare[k + width] - rare[k] <= RARE and breaks[k + width] - breaks[k] <= BREAKS for k in range(last - width + 1))


def _plain(text: str) -> bool:
    return bool(NUMBERS.fullmatch(text)) or (any(rule.fullmatch(text) for rule in NAMES) and word_like(text))


def allowed(span: str) -> bool:
    """Known not to be a secret: a UUID, numbers, words; or a placeholder with nothing else beside it."""
    return bool(UUID.fullmatch(span)) or _plain(span) or (PLACEHOLDER.search(span) is not None and _plain(PLACEHOLDER.sub("-", span)))


def _has_keyword(text: str) -> bool:
    low = text.lower()
    return any(k in low for k in KEYWORDS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), in order."""
    found = []
    if _has_keyword(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _uncovered(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The pieces of ``spans`` that no base span covers; both in order, merged in one pass."""
    k, upto = 0, 0  # base spans passed, and where the last of them ends
    for start, end in spans:
        while k < len(base) and base[k][0] <= start:
            upto = max(upto, base[k][2])
            k += 1
        start = max(start, min(end, upto))
        while k < len(base) and base[k][0] < end:
            if base[k][0] > start:
                yield start, base[k][0]
            upto = max(upto, base[k][2])
            start = max(start, min(end, upto))
            k += 1
        if start < end:
            yield start, end


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those of the entropy scan."""
    base = base_spans(text)
    random = []
    for m in CANDIDATE.finditer(text):
        if not UUID.fullmatch(m.group()):
            random += [(m.start() + low, m.start() + high) for low, high in _entropy_windows(m.group()) if not allowed(m.group()[low:high])]
    return base, sorted(base + [(s, 3, e) for s, e in _uncovered(random, base)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each union of overlapping spans replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


_RESULT = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
_DDL = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_documents(documents: DataFrame, redacted: bool = False) -> DataFrame:
    """The columns of ``documents`` with n_assign, n_access, n_hex, base_sha256, spans; ``redacted`` masks the text's spans."""
    bounded_batches(documents.sparkSession)
    names = [c for c in documents.columns if c not in dict(_RESULT)]
    source = documents.select(*names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields] + [_DDL])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column("text")).to_pylist()
            rows, masked = [], []
            for text in texts:
                base, every = scan(text)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
                if redacted:
                    masked.append(redact(text, every) if every else text)
            columns = [batch.column(c) for c in names]
            if redacted:
                at = names.index("text")
                kept = batch.column("text").is_valid().to_pylist()
                columns[at] = pa.array([m if k else None for m, k in zip(masked, kept, strict=True)], type=batch.column("text").type)
            more = list(zip(*rows, strict=True)) or [()] * len(_RESULT)
            columns += [pa.array(list(v), type=t) for v, (_, t) in zip(more, _RESULT, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *dict(_RESULT)])

    return source.mapInArrow(run, schema)
