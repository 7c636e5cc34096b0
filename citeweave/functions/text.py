"""Text normalisation as Column expressions.

Null and empty text give the empty string everywhere, as the rules downstream treat a missing
value and an empty one alike.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave import constants as K


@lru_cache
def fold_table() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition is one ASCII letter with marks, and those letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1 and plain.isalpha() and chr(code) not in K.FOLD_LETTERS_QUERY:
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pair(left: Column, right: Column) -> Column:
    return F.struct(left.alias("a"), right.alias("b"))


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def ascii_fold(c: Column, letters: dict[str, str]) -> Column:
    """Latin letters without their marks; what has no ASCII form goes."""
    single = {a: b for a, b in letters.items() if len(b) == 1}
    source, target = fold_table()
    out = F.translate(text(c), source + "".join(single), target + "".join(single.values()))
    for a, b in letters.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")


def norm_query(c: Column) -> Column:
    """Query side: fold, lower case, drop possessive 's, other than letters and digits to one space."""
    straight = F.translate(text(c), "’‘", "''")
    out = F.lower(ascii_fold(F.btrim(straight), K.FOLD_LETTERS_QUERY))
    out = F.regexp_replace(out, r"\b([a-z0-9]+)'s\b", "$1")
    return F.btrim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def norm_catalog(c: Column) -> Column:
    """Catalog side: as ``norm_query``, but possessives stay (as a separate s)."""
    out = F.lower(ascii_fold(c, K.FOLD_LETTERS))
    return F.btrim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def norm_loose(c: Column) -> Column:
    """Letters and digits of any script in lower case, accents kept."""
    return F.btrim(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column) -> Column:
    """Words of normalised text; none for the empty string."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def normalize_doi(c: Column) -> Column:
    bare = F.regexp_replace(F.btrim(text(c)), "(?i)" + K.DOI_PREFIX, "")
    return F.lower(F.btrim(F.btrim(bare), F.lit(".;,")))


def doi_key(c: Column) -> Column:
    return F.rtrim(normalize_doi(c), F.lit("/"))


def doi_prefix_equivalent(left: Column, right: Column) -> Column:
    """One DOI is a credible truncation of the other (both normalised)."""
    boundary = "[" + "".join("\\" + c for c in K.DOI_BOUNDARIES) + "]"

    def check(p: Column) -> Column:
        shorter, longer = p["a"], p["b"]
        follows = F.substring(longer, F.length(shorter) + 1, F.lit(1))
        stem = (F.length(shorter) >= K.DOI_STEM_LENGTH) & shorter.startswith("10.") & shorter.contains("/") & (shorter != longer)
        return stem & longer.startswith(shorter) & (F.right(shorter, F.lit(1)).rlike(boundary) | follows.rlike(boundary))

    ordered = lambda p: F.when(F.length(p["a"]) <= F.length(p["b"]), p).otherwise(pair(p["b"], p["a"]))
    return let(let(pair(left, right), ordered), check)


def _not_in(words: list[str]):
    listed = F.array(*[F.lit(w) for w in words])
    return lambda t: ~F.array_contains(listed, t)


def _or_else(first: Column, second: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(second)


def terms_of(normal: Column, distinctive: bool = False) -> Column:
    """Title terms of text that is normalised already."""
    long = F.filter(tokens(normal), lambda t: F.length(t) >= 3)
    terms = let(long, lambda x: let(F.filter(x, _not_in(K.COMMON_TITLE_WORDS)), lambda own: _or_else(own, x)))
    if not distinctive:
        return terms
    return let(terms, lambda x: let(F.filter(x, _not_in(K.BROAD_TITLE_WORDS)), lambda rare: _or_else(rare, x)))


def title_terms(c: Column, distinctive: bool = False) -> Column:
    """Words of three letters and more that are not common; with ``distinctive`` also without broad words, if any are left."""
    return terms_of(norm_query(c), distinctive)


def main_title(c: Column) -> Column:
    """The title before its first colon, semicolon, or full stop that a capital or digit follows."""
    return F.btrim(F.element_at(F.split(F.btrim(text(c)), r"[:;]|(?:\.\s+(?=[A-Z0-9]))", 2), 1))


_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&ndash;": "–", "&mdash;": "—", "&rsquo;": "’", "&lsquo;": "‘", "&amp;": "&"}


def unescape(c: Column) -> Column:
    """The character references that bibliographic dumps use."""
    for name, char in _ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def clean_markup(c: Column) -> Column:
    """Text of a catalog field: references decoded, tags dropped, no space before punctuation."""
    out = F.btrim(unescape(text(c)))
    out = F.replace(F.replace(out, F.lit("<![CDATA["), F.lit("")), F.lit("]]>"), F.lit(""))
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.regexp_replace(squeeze(out), r"\s+([,.;:!?])", "$1")


def text_list(c: Column) -> Column:
    """Values of a JSON list or of text split at | and ;, trimmed, without empty ones."""

    def listed(x: Column) -> Column:
        parsed = F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))
        return F.when(x.startswith("["), parsed).otherwise(F.split(x, r"[|;]"))

    return F.filter(F.transform(let(F.btrim(text(c)), listed), lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != ""))


def cleanup_reference(c: Column) -> Column:
    """One line; a URL or DOI that was torn from its prefix is joined again; no semicolon at the ends."""
    out = squeeze(c)
    out = F.regexp_replace(out, r"(?i)(https?://)\s+", "$1")
    out = F.regexp_replace(out, r"(?i)(doi:)\s+(?=10\.)", "$1")
    return F.btrim(out, F.lit(" \t\r\n;"))


def cleanup_for_style(c: Column, style: Column) -> Column:
    plain = cleanup_reference(c)
    dutch = F.btrim(F.regexp_replace(plain, r"(?i)\b(?:geopend|opgehaald|bekeken|bezocht)\s+op\b", "Geraadpleegd op"))
    numbered = F.btrim(F.regexp_replace(plain, r"^\s*(?:\[\d+\]|\d{1,3}[\.)])\s+", ""))
    english = F.regexp_replace(plain, r"(?i)\bRetrieved\s+from\s+", "Retrieved from ")
    english = F.btrim(F.regexp_replace(english, r"(?i)\(\s*n\.?\s*d\.?\s*\)", "(n.d.)"))
    return F.when(style == "apa7_nl", dutch).when(style == "vancouver", numbered).when(style == "apa7_en", english).otherwise(plain)


def reference_id(c: Column) -> Column:
    return F.concat(F.lit("ref_"), F.substring(F.sha1(c.cast("binary")), 1, 12))


def issued_year(c: Column) -> Column:
    """First year of the years 1000 to 2999 in a date; null without one."""
    return F.nullif(F.regexp_extract(text(c), r"\b(1[0-9]{3}|2[0-9]{3})\b", 1), F.lit(""))


def raw_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text(c), r"\b(19[0-9]{2}|20[0-9]{2})\b", 1), F.lit(""))


def display(c: Column, limit: int = 1200) -> Column:
    """One line of at most ``limit`` characters, cut with an ellipsis; null when empty."""
    line = squeeze(F.replace(text(c), F.lit("\x00"), F.lit("")))
    cut = lambda x: F.when(F.length(x) > limit, F.concat(F.rtrim(F.substring(x, 1, limit - 1)), F.lit("..."))).otherwise(F.nullif(x, F.lit("")))
    return let(line, cut)


def paste_error(c: Column, limit: int = K.MAX_PASTED_CHARS) -> Column:
    """Why pasted text cannot be taken, or null."""
    return (
        F.when(F.length(text(c)) > limit, "reference_text_too_large")
        .when(text(c).rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "reference_text_invalid_characters")
        .when(prepare_pasted(c) == "", "empty_reference_text")
    )


def prepare_pasted(c: Column) -> Column:
    """Pasted text with markup and references gone, single spaces, at most one blank line in a row."""
    out = F.regexp_replace(text(c), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div)>", "\n")
    out = unescape(F.regexp_replace(out, r"<[^>]+>", ""))
    out = F.replace(F.translate(out, " ", " "), F.lit("­"), F.lit(""))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"[ \t]+\n", "\n")
    return F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit(" \n\t"))
