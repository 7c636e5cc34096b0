"""Citation style of a reference list, from counts of shapes in its first references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave import constants as K

SHAPES = {
    "numbered": K.STYLE_NUMBERED,
    "apa": K.STYLE_APA,
    "author_year": K.STYLE_AUTHOR_YEAR,
    "harvard_quoted": K.STYLE_HARVARD_QUOTED,
    "harvard_year": K.STYLE_HARVARD_YEAR,
    "mla": K.STYLE_MLA,
    "chicago": K.STYLE_CHICAGO,
    "dutch_cues": K.CUE_DUTCH,
    "english_cues": K.CUE_ENGLISH,
}


def style_counts(references: DataFrame, sample: int = 40) -> DataFrame:
    """doc_id, n_sample and the count of each shape among a list's first references."""
    first = Window.partitionBy("doc_id").orderBy("ref_pos")
    rows = references.where(F.btrim("raw_reference") != "").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample)
    shaped = [F.count_if(F.btrim("raw_reference").rlike(p)).alias(name) for name, p in SHAPES.items()]
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sample"), *shaped)


def decide(profile: Column, heading: Column, requested: Column) -> Column:
    """struct<style, decision> from the counts of ``style_counts``; what the user asked for wins."""
    least = F.greatest(F.lit(1), F.least(F.lit(3), F.floor((F.coalesce(F.col("n_sample"), F.lit(0)) + 1) / 2)))
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    title = F.coalesce(heading, F.lit(""))
    rules = [
        (requested != "unknown", requested, "explicit_user_style"),
        (profile == "numeric_profile", "vancouver", "numeric_profile"),
        (n("n_sample") == 0, "apa7_en", "fallback_apa7_en"),
        (n("numbered") >= least, "vancouver", "numbered_references"),
        (n("harvard_quoted") > 0, "harvard", "harvard_single_quoted_title"),
        (n("mla") > 0, "mla", "mla_double_quoted_title"),
        ((n("chicago") >= least) | (profile == "notes_bibliography_profile"), "chicago", "chicago_notes_bibliography"),
        (title.rlike(K.HEADING_DUTCH) & ~title.rlike(K.HEADING_ENGLISH), "apa7_nl", "dutch_heading_apa_nl"),
        (n("dutch_cues") > n("english_cues"), "apa7_nl", "dutch_apa_cues"),
        (n("english_cues") > 0, "apa7_en", "english_apa_cues"),
        (n("apa") >= least, "apa7_en", "apa_author_year"),
        (n("harvard_year") >= least, "harvard", "harvard_unparenthesized_year"),
        (n("author_year") >= least, "apa7_en", "author_year_fallback_apa"),
    ]
    struct = lambda s, d: F.struct((s if isinstance(s, Column) else F.lit(s)).alias("style"), F.lit(d).alias("decision"))
    chain = None
    for test, style, decision in rules:
        chain = F.when(test, struct(style, decision)) if chain is None else chain.when(test, struct(style, decision))
    return chain.otherwise(struct("apa7_en", "fallback_apa7_en"))


def detect_styles(references: DataFrame, lists: DataFrame) -> DataFrame:
    """doc_id, style, decision for lists with columns doc_id, profile, heading, style_hint."""
    rows = lists.join(style_counts(references), "doc_id", "left")
    d = decide(F.coalesce("profile", F.lit("")), F.col("heading"), F.coalesce("style_hint", F.lit("unknown")))
    return rows.withColumn("_d", d).select("doc_id", "_d.style", "_d.decision")
