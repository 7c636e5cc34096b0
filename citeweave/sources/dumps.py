"""Bulk metadata dumps: line files of JSON, read as text and parsed with SQL functions.

A compressed file is one task's work; dumps come as many shards, which gives the parallelism.
Lines that are blank or do not parse are dropped, as are records without a title or of a type
that the catalog has no table for.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave import constants as K
from citeweave.functions.names import initials, split_full_name, surname_candidates
from citeweave.functions.text import let, norm_catalog, text

PERSON = "array<struct<family:string,given:string>>"


def read_lines(spark: SparkSession, paths: str | list[str], suffix: str | None = None) -> DataFrame:
    """shard, value of each line; a missing path is an error, an empty file is not. ``.gz`` is decoded by its name."""
    reader = spark.read
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true")
    rows = reader.text(paths)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("shard"), F.col("_metadata.file_block_start").alias("block"), "value").where(F.btrim("value") != "")


def existing_paths(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """(paths that exist, paths that do not); patterns exist if they match anything."""
    conf = spark._jsc.hadoopConfiguration()
    found: tuple[list[str], list[str]] = ([], [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        here = place.getFileSystem(conf).globStatus(place)
        found[0 if here is not None and len(here) else 1].append(path)
    return found


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``read_lines`` over the shards of a resume list that exist; each missing one is reported, not read."""
    here, gone = existing_paths(spark, paths)
    for path in gone:
        warnings.warn(f"shard {path} is missing and was skipped", stacklevel=2)
    if not here:
        return spark.createDataFrame([], "shard string, block long, value string")
    return read_lines(spark, here)


def append_progress(rows: DataFrame, path: str) -> None:
    """Note finished shards: a JSON line {shard, counts by table} for each, appended to the progress folder."""
    counts = rows.groupBy("shard", "source_table").agg(F.count(F.lit(1)).alias("n")).groupBy("shard")
    lines = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_table", "n")))).alias("counts"))
    lines.select(F.to_json(F.struct("shard", "counts")).alias("value")).coalesce(1).write.mode("append").text(path)


def remaining_shards(shards: DataFrame, completed: DataFrame) -> DataFrame:
    """Shards that the progress table does not name (a resumed load)."""
    return shards.join(completed.select("shard").distinct(), "shard", "left_anti")


def progress_shards(lines: DataFrame) -> DataFrame:
    """Shard names of a progress file: JSON objects with ``shard``, or bare names."""
    named = F.get_json_object("value", "$.shard")
    return lines.select(F.coalesce(named, F.btrim("value")).alias("shard")).where("shard <> ''").distinct()


def route_type(work_type: Column) -> Column:
    """The catalog table of a work type; null if there is none."""
    low = F.lower(text(work_type))
    chain = None
    for name, types in K.TABLE_OF_TYPE.items():
        chain = F.when(low.isin(types), name) if chain is None else chain.when(low.isin(types), name)
    return chain


def _string(v: Column, path: str) -> Column:
    return F.nullif(F.btrim(F.try_variant_get(v, path, "string")), F.lit(""))


def _first(v: Column, key: str) -> Column:
    """The first of a list, or the string itself."""
    listed = F.try_variant_get(v, f"$['{key}']", "array<string>")
    return F.when(listed.isNotNull(), F.nullif(F.btrim(F.get(listed, F.lit(0))), F.lit(""))).otherwise(_string(v, f"$['{key}']"))


def year_of_item(v: Column) -> Column:
    """First year among the date fields that can be read as a number."""
    return F.coalesce(*[F.try_variant_get(v, f"$['{k}']['date-parts'][0][0]", "int") for k in K.YEAR_KEYS])


def _people(v: Column, key: str) -> Column:
    listed = F.coalesce(F.try_variant_get(v, f"$.{key}", PERSON), F.array().cast(PERSON))
    return F.filter(F.transform(listed, lambda p: F.struct(F.btrim(text(p["family"])).alias("family"), initials(p["given"]).alias("initials"))), lambda p: p["family"] != "")


def crossref_rows(lines: DataFrame) -> DataFrame:
    """Catalog rows of work records; ``value`` is a JSON object, ``shard`` and ``block`` tell where it stood."""
    v = F.col("v")
    parsed = lines.select("*", F.try_parse_json("value").alias("v")).where("v is not null")
    rows = parsed.select(
        "shard",
        route_type(_string(v, "$.type")).alias("source_table"),
        F.lower(_string(v, "$.type")).alias("work_type"),
        _string(v, "$.DOI").alias("doi"),
        _first(v, "ISBN").alias("isbn"),
        _first(v, "title").alias("title"),
        _first(v, "container-title").alias("container"),
        _string(v, "$.publisher").alias("publisher"),
        _string(v, "$.volume").alias("volume"),
        _string(v, "$.issue").alias("issue"),
        _string(v, "$.page").alias("pages"),
        year_of_item(v).alias("year"),
        _people(v, "author").alias("authors"),
        _people(v, "editor").alias("editors"),
        F.sha1(F.col("value").cast("binary")).alias("digest"),
    ).where("source_table is not null and title is not null")
    rows = rows.withColumn("authors", F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.col("editors")))
    is_chapter, is_book = F.col("source_table") == "search_book_chapter", F.col("source_table") == "search_book"
    container_text = (
        F.when(is_book, norm_catalog(F.col("publisher")))
        .when(is_chapter, F.btrim(F.concat_ws(" ", norm_catalog(F.col("container")), norm_catalog(F.col("publisher")))))
        .otherwise(norm_catalog(F.col("container")))
    )
    names = lambda c: F.transform(c, lambda p: p["family"])
    joined = lambda c: F.array_join(F.transform(c, lambda p: norm_catalog(p["family"])), " ")
    return rows.select(
        "shard",
        "source_table",
        "work_type",
        "doi",
        F.when(is_book, F.col("isbn")).alias("isbn"),
        F.lit(None).cast("string").alias("ol_key"),
        "title",
        F.when(~is_book & ~is_chapter, F.col("container")).alias("journal"),
        F.when(is_chapter, F.col("container")).alias("book_title"),
        F.when(is_book | is_chapter, F.col("publisher")).alias("publisher"),
        F.when(~is_book & ~is_chapter, F.col("volume")).alias("volume"),
        F.when(F.col("source_table") == "search_journal", F.col("issue")).alias("issue"),
        F.when(~is_book & ~is_chapter, F.col("pages")).alias("pages"),
        "year",
        norm_catalog(F.col("title")).alias("title_norm"),
        container_text.alias("container_text"),
        joined("authors").alias("author_text"),
        F.when(is_chapter, joined("editors")).otherwise("").alias("editor_text"),
        names("authors").alias("author_surnames"),
        F.transform("authors", lambda p: p["initials"]).alias("author_initials"),
        F.when(is_chapter, names("editors")).otherwise(F.array().cast("array<string>")).alias("editor_surnames"),
        F.lit("crossref").alias("source"),
        F.coalesce("doi", F.concat(F.lit("crossref:"), "digest")).alias("source_id"),
    )


def openlibrary_lines(lines: DataFrame) -> DataFrame:
    """key, timestamp, v of tab-separated dump lines with five columns, the fifth JSON."""
    parts = F.split("value", "\t", 5)
    rows = lines.where(F.size(parts) == 5).select(F.get(parts, F.lit(1)).alias("key"), F.get(parts, F.lit(3)).alias("timestamp"), F.try_parse_json(F.get(parts, F.lit(4))).alias("v"))
    return rows.where("v is not null")


def openlibrary_authors(lines: DataFrame) -> DataFrame:
    """ol_key, name; one row for each key."""
    rows = openlibrary_lines(lines).select(F.col("key").alias("ol_key"), _string(F.col("v"), "$.name").alias("name")).where("name is not null")
    return rows.groupBy("ol_key").agg(F.min("name").alias("name"))


def publish_year(date: Column) -> Column:
    """First word of a date (split at spaces and slashes) that is a year of four digits."""
    words = F.split(F.replace(text(date), F.lit("/"), F.lit(" ")), r"\s+")
    return F.get(F.filter(words, lambda w: w.rlike(r"^\d{4}$")), F.lit(0)).cast("int")


def author_keys(v: Column) -> Column:
    """Keys of an edition's authors in order: objects with ``key``, nested ``author.key``, or strings."""
    entries = F.coalesce(F.try_variant_get(v, "$.authors", "array<variant>"), F.array().cast("array<variant>"))
    key = lambda e: F.coalesce(F.try_variant_get(e, "$.key", "string"), F.try_variant_get(e, "$.author.key", "string"), F.try_variant_get(e, "$", "string"))
    return F.filter(F.transform(entries, lambda e: F.btrim(key(e))), lambda k: k.isNotNull() & (k != "") & ~k.startswith("{"))


def openlibrary_books(lines: DataFrame, authors: DataFrame) -> DataFrame:
    """Catalog rows of editions; authors are looked up by key, missing ones left out, their order kept."""
    v = F.col("v")
    editions = openlibrary_lines(lines).select(
        F.col("key").alias("ol_key"),
        _string(v, "$.title").alias("title"),
        publish_year(_string(v, "$.publish_date")).alias("year"),
        _first(v, "publishers").alias("publisher"),
        F.coalesce(_first(v, "isbn_13"), _first(v, "isbn_10")).alias("isbn"),
        author_keys(v).alias("keys"),
    ).where("title is not null")
    editions = editions.dropDuplicates(["ol_key"])
    each = editions.select("ol_key", F.posexplode("keys").alias("pos", "author_key"))
    named = each.join(authors.withColumnsRenamed({"ol_key": "author_key"}), "author_key")
    lists = named.groupBy("ol_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda p: p["name"]).alias("names"))
    rows = editions.drop("keys").join(lists, "ol_key", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    # The family name of each author, once by its normal form; the search forms stand in where there is none.
    people = F.transform("names", lambda n: let(split_full_name(n), lambda p: F.struct(F.when(p["family"] != "", p["family"]).otherwise(F.coalesce(F.get(surname_candidates(n), F.lit(0)), F.lit(""))).alias("family"), initials(p["given"]).alias("initials"))))
    keyed = F.transform(people, lambda p: F.struct(norm_catalog(p["family"]).alias("key"), p["family"].alias("family"), p["initials"].alias("initials")))
    rows = rows.withColumn("_people", keyed)
    rows = rows.withColumn("_people", F.filter("_people", lambda p, i: (p["key"] != "") & ~F.exists(F.slice("_people", 1, i), lambda q: q["key"] == p["key"])))
    publisher = norm_catalog(F.col("publisher"))
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit("openlibrary").alias("shard"),
        F.lit("search_book").alias("source_table"),
        F.lit("book").alias("work_type"),
        none.alias("doi"),
        "isbn",
        "ol_key",
        "title",
        none.alias("journal"),
        none.alias("book_title"),
        "publisher",
        none.alias("volume"),
        none.alias("issue"),
        none.alias("pages"),
        "year",
        norm_catalog(F.col("title")).alias("title_norm"),
        publisher.alias("container_text"),
        F.array_join(F.transform("_people", lambda p: p["key"]), " ").alias("author_text"),
        F.lit("").alias("editor_text"),
        F.transform("_people", lambda p: p["family"]).alias("author_surnames"),
        F.transform("_people", lambda p: p["initials"]).alias("author_initials"),
        F.array().cast("array<string>").alias("editor_surnames"),
        F.lit("openlibrary").alias("source"),
        F.col("ol_key").alias("source_id"),
    )
