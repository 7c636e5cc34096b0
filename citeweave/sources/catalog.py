"""The catalog: one table of records partitioned by ``source_table``, and an inverted index of its words."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave import constants as K
from citeweave.functions.text import norm_catalog, normalize_doi, text

FIELDS = ("title_norm", "author_text", "container_text", "editor_text")
COLUMNS = [
    "source_table", "work_type", "doi", "isbn", "ol_key", "title", "journal", "book_title", "publisher", "volume", "issue", "pages", "year", "title_norm", "container_text", "author_text", "editor_text",
    "author_surnames", "author_initials", "editor_surnames", "source", "source_id",
]


def insert_or_ignore(new: DataFrame, existing: DataFrame | None, keys: list[list[str]], order: list[str]) -> DataFrame:
    """Rows of ``new`` that violate none of the unique ``keys``, neither among themselves (the first by ``order`` wins) nor against ``existing``.

    A key with a null part constrains nothing. Rows that are equal by ``order`` are told apart by no rule, so it should end with a unique column.
    """
    for key in keys:
        filled = F.lit(True)
        for c in key:
            filled = filled & F.col(c).isNotNull()
        if existing is not None:
            new = new.where(~filled).unionByName(new.where(filled).join(existing.select(*key).distinct(), key, "left_anti"))
        first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        kept = new.where(filled).withColumn("_n", first).where("_n = 1").drop("_n")
        new = new.where(~filled).unionByName(kept)
    return new


def upsert_latest(rows: DataFrame, key: str, order: list[Column], place: Sequence[str] = ()) -> DataFrame:
    """One row for each key: the last by ``order`` (insert or replace), and of equal ones the first by ``place``."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[c.desc() for c in order], *place))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def load_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_table").agg(F.count(F.lit(1)).alias("n_rows"))


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c not in df.columns]


def with_record_ids(rows: DataFrame) -> DataFrame:
    """Adds record_id (unique, and ordered as text), granularity and the names that candidates show."""
    table = F.col("source_table")
    granularity = F.coalesce(*[F.when(table == t, g) for t, g in K.GRANULARITY.items()], F.lit("unknown"))
    return rows.withColumns(
        {
            "record_id": F.concat(table, F.lit(":"), F.col("source_id")),
            "granularity": granularity,
            "container_title": F.coalesce("journal", "book_title"),
            "doi_norm": normalize_doi(F.col("doi")),
        }
    )


def write_catalog(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).partitionBy("source_table").parquet(path)


# ------------------------------------------------------------------ index


def postings(catalog: DataFrame) -> DataFrame:
    """source_table, field, term, record_id, tf: an inverted index (to be bucketed by term when it is stored)."""
    parts = [catalog.select("source_table", "record_id", F.lit(f).alias("field"), F.explode(F.split(F.col(f), " ")).alias("term")) for f in FIELDS]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where("term <> ''").groupBy("source_table", "field", "term", "record_id").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("source_table", "field", "term").agg(F.count(F.lit(1)).alias("df"))


def record_length() -> Column:
    """Words of a record over the indexed fields of its table (editors are indexed for chapters only)."""
    words = lambda c: F.size(F.filter(F.split(text(F.col(c)), " "), lambda t: t != ""))
    total = words("title_norm") + words("author_text") + words("container_text")
    return total + F.when(F.col("source_table") == "search_book_chapter", words("editor_text")).otherwise(0)


def table_stats(catalog: DataFrame) -> DataFrame:
    """source_table, n_records, average_length."""
    return catalog.groupBy("source_table").agg(F.count(F.lit(1)).alias("n_records"), F.avg(record_length()).alias("average_length"))


def write_index(index: DataFrame, table: str, buckets: int = 256) -> None:
    """Store postings bucketed and sorted by term, so that term joins need no shuffle of the index."""
    index.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


def without_records(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The postings of all records but those of ``gone`` (record_id): upkeep after a delete."""
    return index.join(gone.select("record_id").distinct(), "record_id", "left_anti").select(*index.columns)


def with_changed_records(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The postings after records were inserted or updated: those of ``changed`` (catalog rows) are made anew, all others stay as they are."""
    return without_records(index, changed).unionByName(postings(changed).select(*index.columns))


def analyze(spark: SparkSession, table: str) -> None:
    """Statistics of a stored table and its columns for the planner."""
    spark.sql(f"analyze table {table} compute statistics for all columns")


def warm_up(tables: dict[str, DataFrame], seconds: float = 10.0) -> dict[str, bool | None]:
    """Touch one row of each table until the time is over: whether it has one, None where no time was left."""
    end = time.monotonic() + seconds
    return {name: (df.limit(1).count() > 0 if time.monotonic() < end else None) for name, df in tables.items()}


# ------------------------------------------------------------------ synthetic catalog


def mock_catalog(spark: SparkSession, n: int = 25) -> DataFrame:
    """n records for each table by modular arithmetic, for tests and demonstrations."""
    pick = lambda words, k: F.get(F.array(*[F.lit(w) for w in words]), (k % len(words)).cast("int"))
    surnames = ["Jansen", "Smith", "Garcia", "Nguyen", "Brown", "Keller", "Okafor", "Silva"]
    topics = ["machine learning", "climate policy", "urban planning", "public trust", "reading skills", "soil ecology", "data ethics", "health literacy"]
    places = ["Journal of Applied Examples", "Review of Mock Studies", "Annals of Test Data", "Letters on Fixtures"]
    i = F.col("id")
    base = spark.range(1, n + 1).crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in K.TABLES], "source_table string")))
    kind = F.regexp_replace("source_table", "^search_", "")
    title = F.concat(F.lit("Advances in "), pick(topics, i), F.lit(" volume "), i.cast("string"))
    author = pick(surnames, i)
    place = pick(places, i)
    article = F.col("source_table").isin("search_journal", "search_conference")
    chapter = F.col("source_table") == "search_book_chapter"
    none = F.lit(None).cast("string")
    rows = base.select(
        "source_table",
        kind.alias("work_type"),
        F.concat(F.lit("10.5555/mock."), kind, F.lit("."), F.lpad(i.cast("string"), 4, "0")).alias("doi"),
        F.when(F.col("source_table") == "search_book", F.concat(F.lit("978"), F.lpad(i.cast("string"), 10, "0"))).alias("isbn"),
        none.alias("ol_key"),
        title.alias("title"),
        F.when(article, place).alias("journal"),
        F.when(chapter, F.concat(F.lit("Handbook of "), pick(topics, i + 3))).alias("book_title"),
        F.when(~article, F.lit("Example University Press")).alias("publisher"),
        F.when(article, (i % 40 + 1).cast("string")).alias("volume"),
        F.when(F.col("source_table") == "search_journal", (i % 4 + 1).cast("string")).alias("issue"),
        F.when(article, F.concat((i * 3).cast("string"), F.lit("-"), (i * 3 + 9).cast("string"))).alias("pages"),
        (F.lit(1995) + i % 25).cast("int").alias("year"),
        norm_catalog(title).alias("title_norm"),
        norm_catalog(F.when(article, place).when(chapter, F.concat(F.lit("Handbook of "), pick(topics, i + 3), F.lit(" Example University Press"))).otherwise(F.lit("Example University Press"))).alias("container_text"),
        norm_catalog(author).alias("author_text"),
        F.when(chapter, norm_catalog(pick(surnames, i + 5))).otherwise("").alias("editor_text"),
        F.array(author).alias("author_surnames"),
        F.array(F.concat(F.substring(pick(surnames, i + 2), 1, 1), F.lit("."))).alias("author_initials"),
        F.when(chapter, F.array(pick(surnames, i + 5))).otherwise(F.array().cast("array<string>")).alias("editor_surnames"),
        F.lit("mock").alias("source"),
        F.concat(F.lit("mock."), kind, F.lit("."), F.lpad(i.cast("string"), 4, "0")).alias("source_id"),
    )
    return with_record_ids(rows)


def journal_catalog(citations: DataFrame) -> DataFrame:
    """The true records of generated citations as catalog rows of the journal table."""
    none = F.lit(None).cast("string")
    rows = citations.select(
        F.lit("search_journal").alias("source_table"),
        F.lit("journal-article").alias("work_type"),
        "doi",
        none.alias("isbn"),
        none.alias("ol_key"),
        "title",
        F.col("container").alias("journal"),
        none.alias("book_title"),
        none.alias("publisher"),
        "volume",
        "issue",
        "pages",
        "year",
        norm_catalog(F.col("title")).alias("title_norm"),
        norm_catalog(F.col("container")).alias("container_text"),
        norm_catalog(F.col("surname")).alias("author_text"),
        F.lit("").alias("editor_text"),
        F.array("surname").alias("author_surnames"),
        F.array(F.concat("initial", F.lit("."))).alias("author_initials"),
        F.array().cast("array<string>").alias("editor_surnames"),
        F.lit("generated").alias("source"),
        F.lpad(F.col("k").cast("string"), 12, "0").alias("source_id"),
    )
    return with_record_ids(rows)
