"""The corpus pipeline: quality, near duplicates, secrets, mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of ``documents``.

Every stage ignores columns beyond those five, whatever their names, gives an empty table for
an empty one, reads whole texts of any length, and says itself what it does with null and
empty texts, null ids and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import best_fit, quality_fm, secret_scan, source_mix, trie_join
from citeweave.llm.common import forget, materialize
from citeweave.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled documents of the corpus.

    Null and empty texts are scored as texts without words, rows with null ids by their text
    alone (they have no labels), and repeated rows alike: all stay or all go.
    """
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents.

    Null and empty texts, and rows with null ids, are linked with nothing and stay.
    Rows that repeat an id with another text are documents of their own, and are numbered in
    the order of (id, text's digest); of rows that repeat id and text, one stays.
    """
    docs = docs.select(*COLUMNS)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        found = trie_join.near_duplicates(docs)
        later = materialize(found.where("component_id <> doc_id").select("doc_id"), "pipeline-duplicates")
        return docs.join(later, "doc_id", "left_anti").select(*COLUMNS)
    rows = docs.where("doc_id is not null").withColumn("digest", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    once = rows.groupBy("doc_id", "digest").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "digest", "row.*")
    numbered = materialize(once.orderBy("doc_id", "digest").withColumn("number", F.monotonically_increasing_id()), "pipeline-numbered")
    found = trie_join.near_duplicates(numbered.select(F.col("number").alias("doc_id"), "text"))
    later = materialize(found.where("component_id <> doc_id").select(F.col("doc_id").alias("number")), "pipeline-duplicates")
    kept = numbered.join(later, "number", "left_anti").select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked; n_chars is the masked text's.

    Null texts stay null and empty ones empty (n_chars null and 0). No row is dropped or joined.
    """
    masked = secret_scan.scan_documents(docs.select(*COLUMNS), redacted=True)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times, shard by shard.

    Null sources are a source of their own. Texts without words (null, empty) weigh nothing
    and come along with their block; equal rows are drawn each for itself. Reruns agree.
    """
    return source_mix.emit(source_mix.mix_sources(docs.select(*COLUMNS), carry=True)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    Null and empty texts are the end id alone. Rows that repeat, as the mix makes them, are
    documents of their own, with pieces of the same ids and places that differ.
    """
    return best_fit.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: No stage but the scan of base patterns can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, before = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"), docs
        forget(before)
    return docs
