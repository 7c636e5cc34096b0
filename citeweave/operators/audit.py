"""Checks and summaries over the rows of a run: outliers, timings, triage, positional joins, slices, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outliers(rows: DataFrame, per: str, value: str, least: float, factor: float, min_rows: int = 3) -> DataFrame:
    """Rows whose ``value`` exceeds both ``least`` and ``factor`` times their group's 95th percentile, with ``p95``; groups of fewer rows have none."""
    cut = rows.groupBy(per).agg(F.expr(f"percentile_disc(0.95) within group (order by `{value}`)").alias("p95"), F.count(F.lit(1)).alias("_n"))
    known = rows.join(cut.where(F.col("_n") >= min_rows).drop("_n"), per)
    return known.where(F.col(value) > F.greatest(F.lit(float(least)), F.col("p95") * factor))


def timing_summary(rows: DataFrame, timings: list[str], per: list[str] | None = None) -> DataFrame:
    """``per``, timing, n, total, mean, p95, slowest: one row for each timing column (milliseconds; nulls were not measured)."""
    entries = F.explode(F.array(*[F.struct(F.lit(t).alias("timing"), F.col(t).cast("double").alias("ms")) for t in timings]))
    flat = rows.select(*(per or []), entries.alias("_t")).select(*(per or []), "_t.*").where("ms is not null")
    return flat.groupBy(*(per or []), "timing").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("ms").alias("total"),
        F.avg("ms").alias("mean"),
        F.expr("percentile_disc(0.95) within group (order by ms)").alias("p95"),
        F.max("ms").alias("slowest"),
    )


def triage_bucket(status: Column, doi: Column, title: Column) -> Column:
    """Why a reference was not verified: its DOI, its title, or something else."""
    return F.when(status == "verified", "ok").when(doi == "mismatch", "doi").when(title.isin("weak", "none", "partial"), "title").otherwise("other")


def triage(judged: DataFrame) -> DataFrame:
    """bucket, n over judged references (final_status, signals)."""
    return judged.groupBy(triage_bucket(F.col("final_status"), F.col("signals.doi"), F.col("signals.title")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def zip_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides by position; reading a row fails if a position has no partner or more than one.

    ``keys`` are what says a row's place (document, position). Both sides must hold the same.
    """
    of = lambda df, side: df.withColumn(f"_{side}", F.lit(1))
    joined = of(left, "l").join(of(right, "r"), keys, "full")
    counts = left.groupBy(*keys).count().where("count > 1").unionByName(right.groupBy(*keys).count().where("count > 1")).select(*keys).distinct()
    joined = joined.join(counts.withColumn("_twice", F.lit(1)), keys, "left")
    fits = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_twice").isNull()
    checked = F.when(fits, F.col(keys[0])).otherwise(F.raise_error(F.lit("both sides of a positional join must have the same rows")))
    return joined.withColumn(keys[0], checked).drop("_l", "_r", "_twice")


def reference_slice(references: DataFrame, most: int | None = None, index: int | None = None) -> DataFrame:
    """References of each document at position ``index`` (from 0), or its first ``most``."""
    if index is not None:
        return references.where(F.col("ref_pos") == index)
    return references if most is None else references.where(F.col("ref_pos") < most)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA-256 of a text; the key is padded here, so only its two masks reach the plan."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256)


def owner_key(key: bytes, session: Column) -> Column:
    """The name under which a session's jobs are kept; the session cannot be read from it."""
    return hmac_sha256(key, session)


def random_ids(df: DataFrame, name: str = "report_id") -> DataFrame:
    """Adds an id of 32 hex digits that cannot be guessed; write the table before it is read twice."""
    return df.withColumn(name, F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))


def max_id(rows: DataFrame, column: str = "id") -> int:
    """The largest id, 0 for an empty table."""
    return rows.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
