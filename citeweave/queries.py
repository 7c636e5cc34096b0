"""Named queries over the star-schema tables, one or more for each group of operators.

Each takes (spark, sf_dir) and runs over whole tables. ``citeweave.oracles`` has their SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions import names as N
from citeweave.functions import similarity as S
from citeweave.functions import text as T
from citeweave.operators import audit, bibliography, cascade, classify, evaluate, matching, parse, prepare, recover, render, report, search, segment, style
from citeweave.plans import resolve
from citeweave.session import spread, stage, stage_path
from citeweave.sources import catalog as C
from citeweave.sources import dumps, generated
from citeweave.streaming import limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` of files with the columns that order them as they are stored: by file name, then by place in the file."""
    place = {"_file": F.col("_metadata.file_path")} if len(rows.inputFiles()) > 1 else {}
    place["_row"] = F.col("_metadata.row_index")
    return rows.withColumns(place), list(place)


def _joined(c: Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


# ------------------------------------------------------------------ text


@query
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_query(t).alias("query_form"), T.norm_catalog(t).alias("catalog_form"))


@query
def title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(": ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", _joined(T.title_terms(name)).alias("terms"), T.main_title(name).alias("main_title"), _joined(T.title_terms(F.lit("A Review of Social Media Use"), True)).alias("distinctive"))


def _raw_dois(citations: DataFrame) -> DataFrame:
    forms = F.array(F.concat(F.lit("https://doi.org/"), "doi"), F.concat(F.lit("DOI: "), F.upper("doi"), F.lit(".")), F.concat(F.lit(" http://dx.doi.org/"), "doi", F.lit("/ ")), F.col("doi"))
    return citations.select("k", "doi", F.element_at(forms, (F.col("k") % 4 + 1).cast("int")).alias("raw"))


@query
def doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_dois(generated.citations(spark, sf_dir)).select("k", T.normalize_doi(F.col("raw")).alias("doi_norm"), T.doi_key(F.col("raw")).alias("doi_key"))


@query
def doi_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.when(F.col("variant") == 5, "10.5555/bib.").when(F.col("variant") == 4, F.concat(F.lit("10.5555/bib."), (F.col("k") + 1).cast("string"))).otherwise(F.concat(F.col("doi"), F.lit(".suppl")))
    return generated.citations(spark, sf_dir).select("k", T.doi_prefix_equivalent(cited, F.col("doi")).alias("equivalent"))


@query
def reference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.lit("  "), F.replace("raw_reference", F.lit(". "), F.lit(".  ")), F.lit(" ; "))
    return generated.citations(spark, sf_dir).select("k", T.cleanup_reference(messy).alias("cleaned"), T.reference_id(T.cleanup_reference(messy)).alias("reference_id"))


@query
def markup_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.clean_markup(F.col("html")).alias("clean"))


@query
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.concat("initial", F.lit(". "), "surname")
    return generated.citations(spark, sf_dir).select(
        "k",
        N.split_full_name(full)["family"].alias("family"),
        N.initials(F.concat("initial", F.lit("anne-marie"))).alias("initials"),
        N.surname_key(F.col("surname")).alias("surname_key"),
        _joined(N.surname_candidates(F.concat("surname", F.lit(", "), "initial"))).alias("search_forms"),
        N.title_case(F.upper("surname")).alias("display"),
    )


# ------------------------------------------------------------------ similarity


def _part_pairs(spark: SparkSession, sf_dir: str, value: Column, features: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """a_key, b_key and ``measures`` of all pairs of parts of one brand and size, the smaller key first.

    Measures depend on ``value`` alone: ``features`` are found once for each value of a group, measures
    once for each pair of values, and only then are the keys of both written out.
    """
    group = ["p_brand", "p_size"]
    values = table(spark, sf_dir, "part").groupBy(*group, value.alias("value")).agg(F.collect_list("p_partkey").alias("keys"))
    values = spread(values, *group).withColumns(features)
    side = lambda x: values.select(*group, *[F.col(c).alias(f"{x}_{c}") for c in ("keys", *features)])
    pairs = side("a").hint("merge").join(side("b"), group).where(F.array_min("a_keys") < F.array_max("b_keys"))
    pairs = pairs.select("a_keys", "b_keys", *[c.alias(name) for name, c in measures.items()])
    pairs = pairs.select(F.explode("a_keys").alias("a_key"), "b_keys", *measures).select("a_key", F.explode("b_keys").alias("b_key"), *measures)
    return pairs.where("a_key < b_key")


@query
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    similarity = F.round(S.jaccard(F.col("a_terms"), F.col("b_terms")), 4)
    pairs = _part_pairs(spark, sf_dir, F.concat_ws(" ", "p_name", "p_type"), {"terms": T.title_terms(F.col("value"))}, {"similarity": similarity, "strength": S.title_strength(similarity)})
    return pairs.select("a_key", "b_key", "similarity", "strength")


@query
def one_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.col("value")
    features = {"word": F.lower(word), "plural": S.within_one_edit(F.concat(word, F.lit("s")), word)}
    return _part_pairs(spark, sf_dir, F.substring_index("p_name", " ", 1), features, {"close": S.within_one_edit(F.col("a_word"), F.col("b_word")), "plural": F.col("a_plural")})


@query
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("k") % 400 + 1000
    short = F.concat(F.lit("pp. "), first.cast("string"), F.lit("–"), (first % 10).cast("string"))
    return generated.citations(spark, sf_dir).select("k", S.page_range(short).alias("page_range"), S.page_range(F.col("pages")).alias("plain"))


@query
def metadata_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = {"volume": F.col("volume"), "issue": F.when(F.col("variant") != 1, F.col("issue")), "pages": F.when(F.col("variant") == 2, F.lit("9999")).otherwise(F.col("pages"))}
    found = {"volume": F.when(F.col("variant") == 3, F.concat("volume", F.lit("a"))).otherwise(F.col("volume")), "issue": F.col("issue"), "pages": F.concat("pages", F.when(F.col("variant") == 4, F.lit(".e1")).otherwise(F.lit("")))}
    credits = S.metadata_credits(cited, found)
    return generated.citations(spark, sf_dir).select("k", F.round(S.metadata_score(credits), 4).alias("score"), S.metadata_match(credits).alias("match"))


@query
def journal_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("container", " ")
    short = F.concat_ws(" ", F.lit("J"), F.substring(words[2], 1, 5), F.lit("Res."))
    letters = F.concat(F.lit("J"), F.substring(words[2], 1, 1), F.lit("R"))
    rows = generated.citations(spark, sf_dir)
    return rows.select("k", S.journal_abbreviation(short, F.col("container")).alias("by_words"), S.journal_abbreviation(F.col("container"), letters).alias("by_initials"), S.journal_abbreviation(F.col("container"), F.col("title")).alias("other"))


# ------------------------------------------------------------------ catalog load

_TYPES = ["journal-article", "book-chapter", "Proceedings-Article", "monograph", "dataset", "component", "report", "reference-entry"]


def _work_type(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (k % 8 + 1).cast("int"))


@query
def type_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(dumps.route_type(_work_type(F.col("o_orderkey"))).alias("source_table"))
    return C.load_counts(rows.where("source_table is not null"))


def _lines(rows: DataFrame, value: Column) -> DataFrame:
    return rows.select(F.lit("shard").alias("shard"), F.lit(0).cast("long").alias("block"), value.alias("value"))


@query
def crossref_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generated.citations(spark, sf_dir)
    item = F.struct(
        F.col("doi").alias("DOI"),
        _work_type(F.col("k")).alias("type"),
        F.array("title").alias("title"),
        F.array("container").alias("container-title"),
        F.concat(F.lit("Example "), "initial").alias("publisher"),
        F.array(F.struct(F.col("surname").alias("family"), F.concat("initial", F.lit("an-Paul")).alias("given"))).alias("author"),
        "volume",
        "issue",
        F.col("pages").alias("page"),
        F.struct(F.array(F.array("year")).alias("date-parts")).alias("published-online"),
    )
    lines = _lines(rows, F.to_json(item)).unionByName(spark.createDataFrame([("shard", 0, "{broken"), ("shard", 0, " ")], "shard string, block long, value string"))
    found = dumps.crossref_rows(lines)
    return found.select("doi", "source_table", "title_norm", "container_text", "author_text", "year", "journal", "book_title", "publisher", "volume", "issue", "pages", _joined(F.col("author_initials")).alias("initials"), "source_id")


@query
def openlibrary_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    authors = customers.select(F.lit("s").alias("shard"), F.lit(0).cast("long").alias("block"), F.concat_ws("\t", F.lit("/type/author"), F.concat(F.lit("/authors/"), "c_custkey"), F.lit("1"), F.lit("ts"), F.to_json(F.struct(F.concat_ws(" ", F.lit("Jan"), F.regexp_replace("c_name", "[^A-Za-z]", "")).alias("name")))).alias("value"))
    orders = table(spark, sf_dir, "orders")
    key = lambda c: F.struct(F.concat(F.lit("/authors/"), c.cast("string")).alias("key"))
    item = F.struct(F.concat(F.lit("Book of "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey")).alias("title"), F.concat(F.lit("May "), (F.lit(1990) + F.col("o_orderkey") % 30).cast("string")).alias("publish_date"), F.array(F.lit("Ex & Co")).alias("publishers"), F.array(F.col("o_orderkey").cast("string")).alias("isbn_10"), F.array(key(F.col("o_custkey")), key(F.lit(-1))).alias("authors"))
    editions = orders.select(F.lit("s").alias("shard"), F.lit(0).cast("long").alias("block"), F.concat_ws("\t", F.lit("/type/edition"), F.concat(F.lit("/books/"), "o_orderkey"), F.lit("1"), F.lit("ts"), F.to_json(item)).alias("value"))
    rows = dumps.openlibrary_books(editions, dumps.openlibrary_authors(authors))
    return rows.select("ol_key", "title_norm", "container_text", "author_text", "year", "isbn")


@query
def catalog_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, place = placed(table(spark, sf_dir, "lineitem"))
    new = lines.select(F.concat(F.lit("10.5555/"), "l_orderkey").alias("doi"), F.when(F.col("l_linenumber") != 2, F.col("l_partkey")).alias("isbn"), F.lit("x").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), *place)
    existing = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("10.5555/"), "o_orderkey").alias("doi"), F.lit(None).cast("long").alias("isbn"), F.lit("x").alias("source"))
    return C.insert_or_ignore(new, existing, [["doi"], ["isbn", "source"]], ["seq", *place]).select("doi", "isbn", "seq")


@query
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, place = placed(table(spark, sf_dir, "lineitem"))
    rows = lines.select(F.col("l_orderkey").alias("doi"), "l_linenumber", "l_returnflag", *place)
    return C.upsert_latest(rows, "doi", [F.col("l_linenumber")], place).select("doi", F.col("l_linenumber").alias("seq"), "l_returnflag")


@query
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"))


# ------------------------------------------------------------------ index and search


@query
def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.postings(C.journal_catalog(generated.citations(spark, sf_dir))).select("field", "term", "record_id", "tf")


@query
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.document_frequencies(C.postings(C.journal_catalog(generated.citations(spark, sf_dir)))).select("field", "term", "df")


@query
def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table_stats(C.journal_catalog(generated.citations(spark, sf_dir))).select("source_table", "n_records", F.round("average_length", 4).alias("average_length"))


def _provider(spark: SparkSession, sf_dir: str) -> resolve.Catalog:
    return resolve.Catalog.build(C.journal_catalog(generated.citations(spark, sf_dir)))


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _provider(spark, sf_dir)
    rows = generated.citations(spark, sf_dir)
    none = F.array().cast("array<string>")
    strategy = F.struct(F.lit("title").alias("name"), F.slice(T.title_terms(F.col("title")), 3, 2).alias("title"), none.alias("author"), none.alias("container"), F.array(F.lit("search_journal")).alias("tables"), F.col("year").cast("string").alias("year"), F.lit("near").alias("mode"), F.lit(2).alias("window"), F.lit(5).alias("limit"))
    strategies = rows.select(F.lit(0).alias("doc_id"), F.col("k").alias("ref_pos"), F.lit(1).alias("strategy_ord"), strategy.alias("strategy"))
    found = search.search_terms(strategies, p.catalog, p.index, p.frequencies, p.stats)
    return found.select("ref_pos", "record_id", F.round("rank_value", 4).alias("rank_value"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generated.citations(spark, sf_dir)
    refs = rows.select(F.col("c_custkey").alias("doc_id"), F.col("k").alias("ref_pos"), "raw_reference", "variant")
    return stage(prepare.prepare(resolve.read_references(refs)), "query-references")


@query
def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = generated.citations(spark, sf_dir).select("k", "raw_reference")
    p = F.col("parsed")
    return parse.parse_references(refs).select("k", p["author"][0]["family"].alias("family"), p["author"][0]["given"].alias("given"), p["issued_year"].alias("year"), p["title"][0].alias("title"), p["container_title"][0].alias("container"), p["volume"][0].alias("volume"), p["issue"][0].alias("issue"), p["pages"][0].alias("pages"), T.normalize_doi(F.get(p["doi"], F.lit(0))).alias("doi"), _joined(F.col("parser_warnings")).alias("warnings"))


@query
def reference_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generated.citations(spark, sf_dir)
    shapes = [
        F.col("raw_reference"),
        F.concat("surname", F.lit(", "), "initial", F.lit(". ("), "year", F.lit("). "), "title", F.lit(". Master thesis, Example.")),
        F.concat("surname", F.lit(", "), "initial", F.lit(". ("), "year", F.lit("). "), "title", F.lit(". Example Press.")),
        F.concat("surname", F.lit(", "), "initial", F.lit(". ("), "year", F.lit("). "), "title", F.lit(" [Dataset]. https://zenodo.org/x")),
        F.concat(F.lit("Proceedings of the workshop on "), "title"),
        F.concat("surname", F.lit(", "), "initial", F.lit(". ("), "year", F.lit("). "), "title", F.lit(". In A. Smith (Ed.), Handbook (pp. 1-9). Press.")),
        F.concat(F.lit("Example ("), "year", F.lit("). "), "title", F.lit(". https://www.example.org/")),
    ]
    raw = F.element_at(F.array(*shapes), (F.col("k") % 7 + 1).cast("int"))
    refs = rows.select(F.lit(0).alias("doc_id"), F.col("k").alias("ref_pos"), raw.alias("raw_reference"))
    typed = stage(classify.classify(parse.parse_references(refs)), "query-types")
    return report.type_counts(typed.select("ctype"))


@query
def match_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _references(spark, sf_dir)
    return refs.select("ref_pos", "eligible", "match_target", _joined(F.array_sort(F.map_keys("lookup_keys"))).alias("keys"), _joined(F.col("confidence_basis")).alias("basis"), _joined(F.col("missing_fields")).alias("missing"))


@query
def search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A stage, as the planner would write the whole plan into the filter that it puts before an explode.
    plan = stage(search.build_plan(_references(spark, sf_dir)).select("ref_pos", "ctype", "plan"), "query-plan")
    each = plan.select("ref_pos", "ctype", F.posexplode("plan").alias("pos", "s"))
    skip = search.skip_reason(F.col("s"), F.col("ctype"), F.lit(False))
    return each.select("ref_pos", F.col("s.name").alias("strategy"), _joined(F.col("s.title")).alias("title"), _joined(F.col("s.author")).alias("author"), _joined(F.col("s.container")).alias("container"), F.col("s.year").alias("year"), skip.alias("skip_reason"))


@query
def doi_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = C.journal_catalog(generated.citations(spark, sf_dir))
    return search.doi_candidates(_references(spark, sf_dir), catalog).select("ref_pos", "record_id")


@query
def doi_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generated.citations(spark, sf_dir)
    cited = rows.select("k", F.when(F.col("variant") == 4, F.concat(F.lit("10.5555/bib."), (F.col("k") + 1).cast("string"))).when(~F.col("variant").isin(1, 5, 7), F.col("doi")).alias("doi"))
    return cited.where("doi is not null").join(rows.select("doi"), "doi", "left_anti").select("k", "doi")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References scored against the record that their DOI names, or their own if it names none."""
    catalog = stage(C.journal_catalog(generated.citations(spark, sf_dir)), "query-catalog")
    refs = _references(spark, sf_dir)
    hits = search.doi_candidates(refs, catalog)
    own = refs.join(hits, search.KEY, "left_anti").select("doc_id", "ref_pos", F.concat(F.lit("search_journal:"), F.lpad(F.col("ref_pos").cast("string"), 12, "0")).alias("record_id"))
    pairs = hits.unionByName(own).join(matching.with_candidate(catalog), "record_id").join(matching.with_source(refs), search.KEY)
    return matching.score(pairs.drop("cleaned"))


@query
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("signals")
    return _scored(spark, sf_dir).select("ref_pos", g["doi"].alias("doi"), g["title"].alias("title"), g["author"].alias("author"), g["year"].alias("year"), g["container"].alias("container"), g["metadata"].alias("metadata"), F.round("ordering_score", 3).alias("score"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    g, ctype = F.col("signals"), F.col("ctype")
    has_doi = F.size("parsed.doi") > 0
    rows = rows.withColumn("s", evaluate.components(g, has_doi))
    rows = rows.withColumns({"structure": evaluate.structure_penalty(ctype, g, F.col("s.author"), F.lit(True)), "type_": evaluate.type_penalty(ctype, g, F.col("granularity"))})
    rows = rows.withColumn("confidence", evaluate.clamp(evaluate.raw_confidence(F.col("s")) - F.col("structure") - F.col("type_")))
    major = evaluate.major_contradiction(ctype, g, F.col("structure"), F.col("type_"))
    gap = F.lit(None).cast("double")
    status = evaluate.final_status(F.lit("matched_provisional"), ctype, g, F.col("granularity"), F.col("confidence"), gap, major, F.lit(False))
    checks = evaluate.evidence(ctype, g, F.col("granularity"), has_doi, F.when(g["doi"] == "exact", 1).otherwise(0), gap, F.col("s.author"), F.col("structure"), F.col("type_"), F.lit(False))
    return rows.withColumns({"final_status": status, "checks": checks})


@query
def confidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("ref_pos", F.round("confidence", 4).alias("confidence"), evaluate.confidence_name(F.col("confidence")).alias("name"), "final_status", matching.suspicious(F.col("signals")).alias("suspicious"))


@query
def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("checks")
    return _judged(spark, sf_dir).select("ref_pos", F.size(c).alias("n_checks"), _joined(evaluate.strengths(c)).alias("strengths"), _joined(evaluate.concerns(c)).alias("concerns"), _joined(evaluate.review_flags(c)).alias("flags"))


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.status_counts(_judged(spark, sf_dir))


@query
def cascade_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("ref_pos"), F.col("l_linenumber").alias("exec_no"), F.concat(F.lit("r"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("record_id"), F.round(F.col("l_quantity") / 60, 4).alias("ordering_score"))
    weak = F.struct(F.lit("none").alias("doi"), F.lit("weak").alias("title"), F.lit("none").alias("author"), F.lit("missing").alias("year"), F.lit("unknown").alias("container"), F.lit("unknown").alias("metadata"))
    scored = lines.groupBy("doc_id", "ref_pos", "record_id").agg(F.max("ordering_score").alias("ordering_score")).withColumn("signals", weak)
    strategies = lines.select("doc_id", "ref_pos", "exec_no", F.concat(F.lit("s"), "exec_no").alias("name")).distinct()
    cut = cascade.run_cascade(lines.select("doc_id", "ref_pos", "exec_no", "record_id"), scored, strategies)
    return cut.select("ref_pos", "stop_at", "stop_reason", _joined(F.col("strategies_attempted")).alias("attempted"))


@query
def top_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    one = F.struct(F.round(F.col("l_quantity") / 50, 4).alias("ordering_score"), F.concat_ws(":", "l_partkey", "l_linenumber").alias("record_id"), F.concat(F.lit("10.1/"), "l_suppkey").alias("doi"))
    lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one), asc=False).alias("c"))
    top = lists.withColumn("top", cascade.top_two(F.col("c")))
    gap = F.when(F.size("top") > 1, F.abs(F.col("top")[0]["ordering_score"] - F.get("top", F.lit(1))["ordering_score"]))
    return top.select("l_orderkey", F.size("top").alias("n_top"), F.col("top")[0]["record_id"].alias("best"), F.round(gap, 4).alias("gap"), evaluate.ambiguity_penalty(F.round(gap, 4)).alias("penalty"))


# ------------------------------------------------------------------ lists, styles, reports


def _citation_lists(spark: SparkSession, sf_dir: str, numbered: bool) -> DataFrame:
    rows = generated.citations(spark, sf_dir)
    lists = rows.groupBy("c_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "raw_reference"))), lambda x: x["raw_reference"]).alias("refs"))
    marked = F.transform("refs", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)) if numbered else F.col("refs")
    return lists.select(F.col("c_custkey").alias("doc_id"), F.array_join(marked, "\n").alias("text"), F.lit("text").alias("source_kind"), F.lit("unknown").alias("style_hint"))


@query
def segment_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(_citation_lists(spark, sf_dir, True)).select("doc_id", "ref_pos", "raw_reference", "error_code")


@query
def segment_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(_citation_lists(spark, sf_dir, False)).select("doc_id", "ref_pos", "raw_reference", "profile", "error_code")


@query
def marker_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _citation_lists(spark, sf_dir, True).unionByName(_citation_lists(spark, sf_dir, False).withColumn("doc_id", -F.col("doc_id") - 1))
    return segment.marker_modes(lines.select("doc_id", F.explode(F.split("text", "\n")).alias("line")))


@query
def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    flags = segment.line_features(lines)
    return flags.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), *[F.count_if(c).alias(c) for c in ("has_year", "has_strong_marker", "is_numbered", "is_bullet")])


@query
def style_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = generated.citations(spark, sf_dir).select(F.col("c_custkey").alias("doc_id"), F.col("k").alias("ref_pos"), "raw_reference")
    lists = refs.select("doc_id").distinct().withColumns({"profile": F.lit("author_year_profile"), "heading": F.when(F.col("doc_id") % 3 == 0, "Literatuurlijst"), "style_hint": F.when(F.col("doc_id") % 7 == 0, "mla").otherwise("unknown")})
    counts = style.style_counts(refs).select("doc_id", "n_sample", "numbered", "apa", "english_cues")
    return counts.join(style.detect_styles(refs, lists), "doc_id")


@query
def adjacent_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 3 != 0).alias("tail"))
    return recover.non_overlapping(turns, "tail", ["conv_id"], "turn").select("conv_id", "turn", "takes_next")


@query
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _citation_lists(spark, sf_dir, False)
    page = lambda n, text: F.struct(F.lit(n).alias("unit_index"), F.lit("page").alias("kind"), F.lit(None).cast("string").alias("label"), text.alias("text"), F.lit("normal").alias("layout"))
    pages = F.array(page(0, F.lit("Introduction\nSome words about the subject.")), page(1, F.concat(F.lit("Closing words of the text.\n5. References:\n"), F.col("text"), F.lit("\n17"))), page(2, F.lit("Appendix A\nTables")))
    units = lists.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(pages).alias("u")).select("doc_id", "u.*")
    return bibliography.detect(units).select(F.col("doc_id").cast("long").alias("doc_id"), "heading", "heading_unit", "end_unit", "text")


@query
def rendered_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = C.journal_catalog(generated.citations(spark, sf_dir))
    rows = records.withColumn("r", render.csl(F.struct(*records.columns), F.lit("journal_article")))
    styles = {s: render.render(F.col("r"), F.lit(s)).alias(s) for s in ("apa", "vancouver", "mla", "chicago", "harvard")}
    return rows.select("record_id", *styles.values(), _joined(render.render_warnings(F.col("r"))).alias("warnings"))


@query
def opaque_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.opaque_ids(generated.citations(spark, sf_dir), ["k"], ["c_custkey"]).select("k", "opaque_reference_id")


@query
def phase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = report.opaque_ids(generated.citations(spark, sf_dir), ["k"], ["c_custkey"]).withColumn("opaque_reference_id", F.concat_ws("/", "c_custkey", "opaque_reference_id"))
    parsed = ids.select("opaque_reference_id", F.lit("journal_article").alias("ctype"), (F.col("variant") != 1).alias("eligible"))
    matched = ids.where("variant <> 2").select("opaque_reference_id", F.when(F.col("variant") == 3, "skipped").otherwise("candidate_only").alias("match_status"))
    evaluated = ids.where("variant in (4, 5)").select("opaque_reference_id", F.when(F.col("variant") == 4, "verified").otherwise("suspicious").alias("final_status"))
    rows = report.phase_rows(parsed, None, matched, evaluated)
    return rows.select("opaque_reference_id", "match_status", "final_status", report.folded_status(F.col("final_status")).alias("bucket"))


@query
def review_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generated.citations(spark, sf_dir)
    ctype = F.when(F.col("k") % 2 == 0, "journal_article").otherwise("book")
    links = report.search_links({"title": F.col("title"), "author": F.col("surname"), "ctype": ctype, "url": F.lit(None).cast("string"), "doi": F.col("doi"), "doi_missing": F.col("variant") == 5, "status": F.when(F.col("variant") == 0, "verified").otherwise("needs_review")})
    return rows.select("k", _joined(F.transform(links, lambda x: x["href"]), " ").alias("links"))


# ------------------------------------------------------------------ limits and profiles


@query
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return limits.allow(events, "user_id", "ts", "event_id", 86_400, 2).select("event_id", limits.window_id(F.col("ts"), 86_400).alias("window_id"), "allowed")


@query
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    decided = limits.allow_stream(stream.select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 86_400, 2)
    path = stage_path(spark, "limits")
    decided.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(decided.schema).parquet(path).select("event_id", "window_id", "allowed")


@query
def soft_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = limits.window_counts(table(spark, sf_dir, "events"), "user_id", "ts", 7 * 86_400)
    return limits.soft_limit(counts, 4, 0.75).select("user_id", "window_id", "n", "challenge")


#: Seconds until a token may be taken again; short, so that tokens do expire in the generated events.
TOKEN_LIFE = 3 * 86_400


@query
def consumed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.consume_once(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", TOKEN_LIFE).select("event_id", "consumed")


@query
def slow_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose price is above twice the 95th percentile of their supplier's quantity class (at least 1000)."""
    rows = audit.outliers(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 1000.0, 1.02)
    return rows.select("l_orderkey", "l_linenumber", F.round("p95", 2).alias("p95"))


@query
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.triage(_judged(spark, sf_dir))


@query
def timing_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts as timings: quantity and tax of each return flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.when(F.col("l_tax") > 0, F.col("l_tax") * 100).alias("l_tax"))
    found = audit.timing_summary(lines, ["l_quantity", "l_tax"], ["l_returnflag"])
    return found.select("l_returnflag", "timing", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), F.round("p95", 2).alias("p95"), F.round("slowest", 2).alias("slowest"))


@query
def zipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and their prices, put together again by position."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = table(spark, sf_dir, "lineitem").withColumn("place", place)
    both = audit.zip_join(lines.select("l_orderkey", "place", "l_linenumber", "l_partkey"), lines.select("l_orderkey", "place", "l_suppkey"), ["l_orderkey", "place"])
    return both.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("check"))


@query
def first_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = generated.citations(spark, sf_dir).select(F.col("c_custkey").alias("doc_id"), "k", "raw_reference")
    placed = refs.withColumn("ref_pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1)
    return audit.reference_slice(placed, most=2).select("doc_id", "ref_pos", "raw_reference").unionByName(audit.reference_slice(placed, index=3).select("doc_id", "ref_pos", "raw_reference"))


@query
def maintained_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after every fifth record was deleted and every third got another title: terms of titles and their records."""
    records = C.journal_catalog(generated.citations(spark, sf_dir))
    number = F.col("source_id").cast("int")
    index = C.postings(records)
    left = C.without_records(index, records.where(number % 5 == 0))
    changed = records.where((number % 3 == 0) & (number % 5 != 0)).withColumn("title_norm", F.concat(F.lit("revised "), F.col("title_norm")))
    kept = C.with_changed_records(left, changed).where("field = 'title_norm'")
    return kept.groupBy("term").agg(F.count(F.lit(1)).alias("n_records"), F.sum("tf").alias("n_uses"))


@query
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: parse, classify, recover, search, score, evaluate, report."""
    refs = generated.citations(spark, sf_dir).select(F.col("c_custkey").alias("doc_id"), F.col("k").cast("int").alias("ref_pos"), "raw_reference")
    rows = resolve.resolve(refs, _provider(spark, sf_dir))
    return rows.select("doc_id", "ref_pos", "opaque_reference_id", "ctype", "match_status", "final_status", "final_confidence", "confidence_score", "accepted_record_id", "accepted_match", "review_flags")
