"""Incremental catalog load: a stream of dump shards into the catalog, each shard once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.session import forget, stage
from citeweave.sources.catalog import insert_or_ignore, postings, upsert_latest, with_record_ids
from citeweave.sources.dumps import crossref_rows


def read_shards(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Lines of the shards in a folder as a stream; the checkpoint remembers which were read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("shard"), F.col("_metadata.file_block_start").alias("block"), "value").where(F.btrim("value") != "")


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(path)


def load_batch(lines: DataFrame, catalog: str, index: str, works: str, batch: str) -> None:
    """Insert a batch's records that are new by DOI, index them, and note each work's last load.

    Each of the three tables gets the folder ``batch=<batch>``, which a replay of the batch
    overwrites; records of the batch itself do not count as present. So a run that dies
    between two writes leaves nothing behind that its replay does not write anew.
    """
    spark = lines.sparkSession
    rows = stage(crossref_rows(lines), "ingest-rows")
    old = _existing(spark, catalog)
    if old is not None:
        old = old.where(F.col("batch").cast("string") != batch).select("source_table", "doi", "isbn", "source", "source_id")
    new = insert_or_ignore(rows, old, [["source_table", "doi"], ["source_table", "source", "source_id"]], ["shard", "source_id"])
    new = stage(with_record_ids(new), "ingest-new")
    new.write.mode("overwrite").partitionBy("source_table").parquet(f"{catalog}/batch={batch}")
    postings(new).write.mode("overwrite").parquet(f"{index}/batch={batch}")
    seen = rows.where("doi is not null").select("doi", "work_type", F.current_timestamp().alias("updated_at"))
    upsert_latest(seen, "doi", [F.col("updated_at"), F.col("work_type")]).write.mode("overwrite").parquet(f"{works}/batch={batch}")
    forget(rows, new)


def start(lines: DataFrame, catalog: str, index: str, works: str, checkpoint: str):
    """A query that loads what has arrived and ends; run it again, with the same checkpoint, for what comes later or to go on after a failure."""
    stream = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]  # batches of another checkpoint have other names
    return lines.writeStream.foreachBatch(lambda df, n: load_batch(df, catalog, index, works, f"{stream}-{n:09d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_works(works: DataFrame) -> DataFrame:
    """One row for each DOI of the appended load notes: the last."""
    return upsert_latest(works, "doi", [F.col("updated_at")])
