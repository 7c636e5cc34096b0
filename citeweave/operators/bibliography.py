"""Bibliography detection: heading, extent and lines of the reference list of each document.

Documents come as text units (doc_id, unit_index, kind, label, text, layout); every step is
a window or an aggregate over the lines of all documents at once. Lines that stand on many
pages of one document are taken for running headers and footers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave import constants as K
from citeweave.functions.text import squeeze, text

_URL = r"(?i)\b(?:https?://|www\.)\S+\b"
_DOI = r"(?i)\b10\.\d{4,9}/\S+\b"
_YEAR = r"\b(?:19|20)\d{2}\b"
_AUTHORISH = r"\b[A-Z][A-Za-z'`-]+,\s*(?:[A-Z]\.\s*){1,4}"
_CAPITALIZED = r"[A-Z][\w&'`./-]*(?:\s+[A-Z][\w&'`./-]*)"


def normal_heading(c: Column) -> Column:
    """Heading text without chapter and list numbers and closing punctuation, in lower case."""
    out = F.regexp_replace(squeeze(c), r"[\s:;,\-–—.]+$", "")
    out = F.regexp_replace(out, r"(?i)^\s*(?:chapter|hoofdstuk)\s+(?:\d+|[ivxlcdm]+)\s*[:.\-)]\s*", "")
    out = F.regexp_replace(out, r"(?i)^\s*(?:\d+|[ivxlcdm]+)\s*[\.\)]\s*", "")
    return F.lower(squeeze(F.regexp_replace(out, r"[\s:;,\-–—.]+$", "")))


def has_signals(c: Column) -> Column:
    return c.rlike(_YEAR) | c.rlike(_DOI) | c.rlike(_URL) | c.rlike(_AUTHORISH)


def reference_start(c: Column) -> Column:
    bare = F.regexp_replace(F.btrim(c), r"^\s*[*•]+\s*", "")
    numbered = bare.rlike(rf"^\s*(?:\[\d+\]|\d+\.)\s+{_CAPITALIZED}{{0,8}}")
    dated = bare.rlike(_AUTHORISH) & F.substring(bare, 1, 120).rlike(_YEAR)
    return numbered | dated | bare.rlike(rf"^\s*{_CAPITALIZED}{{0,6}}\s*\(\d{{4}}[a-z]?\)")


def boilerplate(c: Column) -> Column:
    bare = F.btrim(c)
    compact = F.regexp_replace(bare, r"[^0-9A-Za-z]+", "")
    et_al = F.lower(bare).contains("et al.") & ~bare.rlike(_YEAR) & ~bare.rlike(_DOI) & ~bare.rlike(_URL)
    return (bare == "") | bare.rlike(r"^\(?\d+\)?$") | et_al | ~bare.rlike(r"[\p{L}\p{N}]") | (bare.contains("|") & ~bare.rlike(_AUTHORISH)) | ((F.length(compact) <= 2) & ~has_signals(bare))


def uppercase_heading(c: Column) -> Column:
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    upper = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    return (F.length(F.btrim(c)) > 10) & (F.length(letters) >= 4) & (upper / F.greatest(F.length(letters), F.lit(1)) >= 0.8)


def query_syntax(c: Column) -> Column:
    """Database search strings of an appendix: many Boolean operators."""
    n = F.size(F.regexp_extract_all(c, F.lit(r" (?:OR|AND|ED|AB)(?= )"), F.lit(0)))
    return (F.length(c) > 100) & (n > 10)


def unit_lines(units: DataFrame, pages_for_header: int = 3) -> DataFrame:
    """Lines of all units with their flags; ``repeated`` lines stand on three or more pages of the document."""
    rows = units.select("doc_id", "unit_index", "kind", "label", "layout", F.posexplode(F.split(F.regexp_replace(text(F.col("text")), r"\r\n?", "\n"), "\n")).alias("line_no", "line"))
    pages = F.size(F.collect_set("unit_index").over(Window.partitionBy("doc_id", F.regexp_replace(F.btrim("line"), r"\d+", "#"))))
    line = F.col("line")
    return rows.withColumns(
        {
            "blank": F.btrim(line) == "",
            "heading_key": normal_heading(line),
            "is_start": reference_start(line),
            "signals": has_signals(line),
            "is_boilerplate": boilerplate(line),
            "repeated": (F.col("kind") == "page") & (pages >= pages_for_header) & (F.btrim(line) != ""),
        }
    )


def detect(units: DataFrame) -> DataFrame:
    """doc_id, heading, heading_unit, start_unit, end_unit, text, error_code; documents without a heading get an error code."""
    lines = unit_lines(units)
    order = ["unit_index", "line_no"]
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    solid = lines.where(~F.col("blank")).withColumn("n", number)
    # Headings are scored by the 24 lines of their and the next two units that follow.
    ahead = Window.partitionBy("doc_id").orderBy("n")
    window = F.collect_list(F.struct("unit_index", "is_start", "signals", (F.col("is_boilerplate") | F.col("repeated")).alias("noise"))).over(ahead.rowsBetween(1, 72))
    heads = solid.withColumn("probe", window).where(F.col("heading_key").isin(K.BIBLIOGRAPHY_HEADINGS) & (F.length(F.btrim("line")) <= 80))
    near = F.slice(F.filter("probe", lambda p: ~p["noise"] & (p["unit_index"] < F.col("unit_index") + 3)), 1, 24)
    heads = heads.withColumn("probe", near)
    early = F.slice("probe", 1, 8)
    styled = F.lower(F.btrim(text(F.col("label")))).isin(K.HEADING_STYLES)
    page = F.struct(
        F.size(F.filter(early, lambda p: p["is_start"])).alias("early"),
        F.size(F.filter("probe", lambda p: p["is_start"])).alias("starts"),
        (-F.size(F.filter(early, lambda p: ~p["is_start"] & ~p["signals"]))).alias("prose"),
        F.col("unit_index").cast("int").alias("late"),
    )
    other = F.struct(styled.cast("int").alias("early"), F.lit(0).alias("starts"), F.lit(0).alias("prose"), (-F.col("unit_index")).cast("int").alias("late"))
    heads = heads.withColumn("score", F.when(F.col("kind") == "page", page).otherwise(other))
    best = heads.groupBy("doc_id").agg(F.max(F.struct("score", F.struct("unit_index", "line_no", "line", "kind").alias("at"))).alias("b")).select("doc_id", "b.at.*")
    best = best.select("doc_id", F.col("unit_index").alias("heading_unit"), F.col("line_no").alias("heading_line"), F.btrim("line").alias("heading"))

    # The section ends before the first later unit that opens with another heading or holds no references.
    firsts = solid.groupBy("doc_id", "unit_index", "kind").agg(F.min_by("line", "line_no").alias("first"), F.min_by("heading_key", "line_no").alias("key"), F.max("label").alias("label"), F.bool_or("signals").alias("any_signals"), F.array_join(F.collect_list("line"), " ").alias("all"))
    own_style = F.lower(F.btrim(text(F.col("label")))).isin(K.HEADING_STYLES)
    stops_page = F.col("key").isin(K.OTHER_HEADINGS) | (uppercase_heading(F.col("first")) & ~F.col("any_signals")) | query_syntax(F.col("all"))
    stops = F.when(F.col("kind") == "page", stops_page).otherwise(own_style & ~F.col("key").isin(K.BIBLIOGRAPHY_HEADINGS))
    ends = firsts.join(best, "doc_id").where((F.col("unit_index") > F.col("heading_unit")) & stops).groupBy("doc_id").agg((F.min("unit_index") - 1).alias("end_unit"))
    last = units.groupBy("doc_id").agg(F.max("unit_index").alias("last_unit"))
    section = last.join(best, "doc_id", "left").join(ends, "doc_id", "left").withColumn("end_unit", F.coalesce("end_unit", "last_unit"))

    # Lines of the section; on the heading's page they begin at the first reference.
    inside = solid.join(section.where("heading_unit is not null"), "doc_id").where("unit_index between heading_unit and end_unit").where("unit_index > heading_unit or line_no > heading_line")
    two = F.concat_ws(" ", "line", F.lead("line").over(Window.partitionBy("doc_id", "unit_index").orderBy("line_no")))
    inside = inside.withColumn("opens", F.col("is_start") | reference_start(two))
    begin = inside.where("kind = 'page' and unit_index = heading_unit and opens").groupBy("doc_id").agg(F.min("line_no").alias("begin"))
    kept = inside.join(begin, "doc_id", "left").where("kind <> 'page' or unit_index > heading_unit or line_no >= coalesce(begin, 0)")
    kept = kept.where((F.col("kind") != "page") | ~(F.col("is_boilerplate") | F.col("repeated")))
    per_unit = kept.groupBy("doc_id", "unit_index", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("chunk"))
    joined = per_unit.groupBy("doc_id").agg(F.max("kind").alias("kind"), F.transform(F.sort_array(F.collect_list(F.struct("unit_index", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
    body = joined.select("doc_id", F.when(F.col("kind") == "page", F.array_join("chunks", "\n\n")).otherwise(F.array_join("chunks", "\n")).alias("text"))
    out = section.join(body, "doc_id", "left")
    error = F.when(F.col("heading_unit").isNull(), "bibliography_heading_not_found").when(F.length(text(F.col("text"))) < 300, "bibliography_too_short").when(F.length("text") > K.MAX_PASTED_CHARS, "bibliography_too_long")
    return out.select("doc_id", "heading", "heading_unit", "end_unit", "text", error.alias("error_code"))
