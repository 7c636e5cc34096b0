"""Catalog load, index, search, cascade, evaluation, report and limits."""

import gzip
import json
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from citeweave.operators import cascade, classify, evaluate, matching, parse, prepare, render, report, search
from citeweave.plans import resolve
from citeweave.session import stage
from citeweave.sources import catalog as C
from citeweave.sources import dumps
from citeweave.streaming import ingest, limits


@pytest.fixture(scope="module")
def mock(spark):
    return resolve.Catalog.build(C.mock_catalog(spark, 25))


def refs(spark, *raws):
    df = spark.createDataFrame([(1, k, r) for k, r in enumerate(raws)], "doc_id long, ref_pos int, raw_reference string")
    return stage(prepare.prepare(classify.classify(parse.parse_references(df))), "test-references")


def test_bm25_equals_sqlite(spark, mock):
    """Same rows and ranks as FTS5's own bm25 over the same catalog."""
    rows = mock.catalog.where("source_table = 'search_journal'").select("record_id", "title_norm", "author_text", "container_text").orderBy("record_id").collect()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title_norm, author_text, container_text)")
    con.executemany("insert into f(rowid, title_norm, author_text, container_text) values (?,?,?,?)", [(k + 1, r.title_norm, r.author_text, r.container_text) for k, r in enumerate(rows)])
    cases = [(["learning"], [], []), (["machine", "learning"], ["smith"], []), (["advances"], [], ["mock"]), (["machine learning"], [], ["applied examples"]), (["nothing"], [], [])]
    data = [(1, k, 1, ("s", t, a, c, ["search_journal"], "2000", "near", 100, 25, "strict", True, False)) for k, (t, a, c) in enumerate(cases)]
    strategies = spark.createDataFrame(data, f"doc_id long, ref_pos int, strategy_ord int, strategy {search._STRATEGY}")
    found = search.search_terms(strategies, mock.catalog, mock.index, mock.frequencies, mock.stats).collect()
    for k, (t, a, c) in enumerate(cases):
        quote = lambda x: f'"{x}"'
        match = " AND ".join([f"title_norm:{quote(x)}" for x in t] + [f"author_text:{quote(x)}" for x in a] + [f"container_text:{quote(x)}" for x in c])
        expected = {rows[i - 1].record_id: v for i, v in con.execute("select rowid, bm25(f) from f where f match ?", (match,))}
        got = {r.record_id: r.rank_value for r in found if r.ref_pos == k}
        assert got.keys() == expected.keys()
        assert all(math.isclose(got[x], expected[x], rel_tol=1e-9, abs_tol=1e-12) for x in got)


def test_year_filter_comes_after_the_limit(spark):
    """Many editions of one title: those that fill the limit hide a later row of the right year."""
    base = C.mock_catalog(spark, 1).where("source_table = 'search_journal'")
    many = base.drop("year", "source_id", "record_id").crossJoin(spark.range(30)).withColumns({"year": (F.lit(1990) + F.col("id")).cast("int"), "source_id": F.format_string("e%03d", F.col("id"))})
    p = resolve.Catalog.build(C.with_record_ids(many.drop("id", "granularity", "container_title", "doi_norm")))
    data = [(1, 0, 1, ("s", ["advances"], [], [], ["search_journal"], "2015", "exact", 0, 5, "strict", True, False)), (1, 1, 1, ("s", ["advances"], [], [], ["search_journal"], "1995", "exact", 0, 5, "strict", True, False))]
    found = search.search_terms(spark.createDataFrame(data, f"doc_id long, ref_pos int, strategy_ord int, strategy {search._STRATEGY}"), p.catalog, p.index, p.frequencies, p.stats).collect()
    assert [(r.ref_pos, r.record_id) for r in found] == [(1, "search_journal:e005")]


def test_whole_chain(spark, mock):
    raws = [
        "Smith, A. (1996). Advances in climate policy volume 1. Review of Mock Studies, 2(2), 3-12. https://doi.org/10.5555/mock.journal.0001",
        "Smith, A. (1996). Advances in climate policy volume 1. Review of Mock Studies, 2(2), 3-12.",
        "Smith, A. (1996). Advances in climate policy volume 1. Example University Press.",
        "Nobody, X. (2001). Entirely unknown matters of zebra. Journal of Nothing, 1(1), 1-2.",
        "Brown, T. (1999). Deep things. Master thesis, Example.",
    ]
    out = {r.ref_pos: r for r in resolve.resolve(refs(spark, *raws).select("doc_id", "ref_pos", "raw_reference"), mock).collect()}
    assert (out[0].final_status, out[0].accepted_record_id) == ("verified", "search_journal:mock.journal.0001")
    assert (out[1].match_status, out[1].accepted_record_id) == ("matched_provisional", "search_journal:mock.journal.0001")
    assert out[2].ctype == "book" and out[2].accepted_record_id == "search_book:mock.book.0001"
    assert (out[3].match_status, out[3].final_status) == ("no_match", "needs_review")
    assert (out[4].match_status, out[4].final_status) == ("skipped", "skipped")
    assert report.forbidden_columns(resolve.resolve(refs(spark, raws[0]).select("doc_id", "ref_pos", "raw_reference"), mock).schema) == []


def test_scan_fallback(spark, mock):
    data = [(1, 0, 1, ("s", ["climate"], ["smith"], [], ["search_journal"], "1996", "exact", 0, 5, "strict", True, False))]
    found = search.scan_candidates(spark.createDataFrame(data, f"doc_id long, ref_pos int, strategy_ord int, strategy {search._STRATEGY}"), mock.catalog).collect()
    assert [r.record_id for r in found] == ["search_journal:mock.journal.0001"]


def test_plan(spark):
    plan = {r.ref_pos: r.plan for r in search.build_plan(refs(spark, "Smith, A. (1996). Owl and fox in the deep old forest of night. Journal of Owls, 2(2), 3-12.", "Smith, A. (n.d.). Owl.", "Keller, M. (2010). A chapter on things. In A. Smith & B. Jones (Eds.), Handbook of stuff (pp. 12-34). Sage.")).collect()}
    assert [s.name for s in plan[0]][:3] == ["journal_title_year_exact", "journal_title_author_year_exact", "journal_title3_year_exact"]
    assert plan[1] == []
    assert [s.name for s in plan[2]] == ["chapter_main_title_author_year_near", "chapter_main_title_year_near", "chapter_book_title_editor_year_near", "chapter_book_title_editor_year_exact", "chapter_book_title_year_near", "chapter_book_title_year_exact"]


def test_evaluation_rules(spark):
    g = "named_struct('doi', '{}', 'title', '{}', 'author', '{}', 'year', '{}', 'container', '{}', 'metadata', '{}')"
    cases = [
        ("journal_article", ("exact", "exact_or_near_exact", "strong", "exact", "yes", "exact"), "verified", 1.0),
        ("journal_article", ("mismatch", "exact_or_near_exact", "strong", "exact", "yes", "exact"), "needs_review", 0.64),
        ("journal_article", ("exact", "weak", "none", "mismatch", "no", "mismatch"), "suspicious", 0.1348),
        ("book", ("none", "exact_or_near_exact", "strong", "exact", "no", "unknown"), "verified", 0.757),
        ("journal_article", ("none", "strong", "weak", "exact", "yes", "unknown"), "suspicious", 0.3422),
    ]
    for ctype, values, status, confidence in cases:
        s = evaluate.components(F.col("g"), F.lit(True))
        row = spark.sql(f"select {g.format(*values)} as g, '{ctype}' as ctype").withColumn("s", s)
        row = row.withColumn("p", evaluate.structure_penalty(F.col("ctype"), F.col("g"), F.col("s.author"), F.lit(True)))
        row = row.withColumn("c", evaluate.clamp(evaluate.raw_confidence(F.col("s")) - F.col("p")))
        major = evaluate.major_contradiction(F.col("ctype"), F.col("g"), F.col("p"), F.lit(0.0))
        final = evaluate.final_status(F.lit("matched_provisional"), F.col("ctype"), F.col("g"), F.lit("article"), F.col("c"), F.lit(None).cast("double"), major, F.lit(False))
        r = row.select("c", final.alias("f")).first()
        assert r.f == status and r.c == pytest.approx(confidence, abs=1e-9)


def test_author_comparison(spark):
    df = spark.createDataFrame([(["Smith", "Jones"], ["smith", "jonas"], 1.0, False), (["Smith"], ["Smith", "Extra"], 1.0, False), (["Smith"], ["Brown"], 0.2, True), ([], ["x"], 0.65, False)], "a array<string>, b array<string>, f double, e boolean")
    got = [r.x for r in df.select(evaluate.author_comparison(F.col("a"), F.col("b"), F.col("f"), F.col("e")).alias("x")).collect()]
    assert got == [0.95, 0.7, 0.2, 0.65]


def test_render(spark):
    c = C.mock_catalog(spark, 1).withColumn("r", render.csl(F.struct("source_table", "record_id", "title", "author_surnames", "author_initials", "editor_surnames", "year", "doi", "container_title", "publisher", "volume", "issue", "pages"), F.lit("x")))
    texts = {r.source_table: r.t for r in c.select("source_table", render.render(F.col("r"), F.lit("apa")).alias("t")).collect()}
    assert texts["search_book"] == "Smith, N. (1996). Advances in climate policy volume 1. Example University Press. https://doi.org/10.5555/mock.book.0001"
    assert texts["search_book_chapter"].startswith("Smith, N. (1996). Advances in climate policy volume 1. In Okafor (Eds.), Handbook of reading skills. Example University Press.")


CROSSREF = [
    {"DOI": "10.1/a", "type": "journal-article", "title": ["First"], "container-title": ["J of X"], "author": [{"family": "van Dijk", "given": "Jan-Piet"}], "issued": {"date-parts": [[2001]]}},
    {"DOI": "10.1/a", "type": "journal-article", "title": ["Second of the same DOI"], "published-print": {"date-parts": [["x"]]}, "created": {"date-parts": [[1999]]}},
    {"type": "book", "title": "No DOI", "editor": [{"family": "Ed"}], "publisher": "P & Q"},
    {"type": "unknown", "title": ["dropped"]},
    {"DOI": "10.1/b", "type": "book-chapter", "title": []},
]


def test_crossref_rows(spark):
    lines = spark.createDataFrame([("s", 0, json.dumps(x)) for x in CROSSREF] + [("s", 0, "{broken"), ("s", 0, "")], "shard string, block long, value string")
    rows = {r.title: r for r in dumps.crossref_rows(lines).collect()}
    assert set(rows) == {"First", "Second of the same DOI", "No DOI"}
    assert (rows["First"].author_text, rows["First"].author_initials, rows["First"].year) == ("van dijk", ["J. P."], 2001)
    assert rows["Second of the same DOI"].year == 1999 and rows["No DOI"].source_table == "search_book" and rows["No DOI"].author_text == "ed"


def test_incremental_load_is_idempotent(spark, tmp_path):
    folder, cat, index, works = (str(tmp_path / n) for n in ("in", "catalog", "index", "works"))
    (tmp_path / "in").mkdir()
    for n, items in enumerate((CROSSREF[:3], CROSSREF[1:2] + [{"DOI": "10.1/c", "type": "book", "title": ["Third"]}])):
        (tmp_path / "in" / f"shard{n}.jsonl").write_text("\n".join(map(json.dumps, items)))
        ingest.start(ingest.read_shards(spark, folder), cat, index, works, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(cat)
    assert sorted(r.title for r in rows.collect() if r.doi != "10.1/a") == ["No DOI", "Third"] and rows.where("doi = '10.1/a'").count() == 1
    assert ingest.latest_works(spark.read.parquet(works)).count() == 2
    assert spark.read.parquet(index).where("term = 'third'").count() == 1


@pytest.mark.parametrize("fails_at", ["postings", "upsert_latest"])
def test_a_load_that_dies_between_writes_is_replayed(spark, tmp_path, monkeypatch, fails_at):
    folder, cat, index, works = (str(tmp_path / n) for n in ("in", "catalog", "index", "works"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "shard0.jsonl").write_text("\n".join(map(json.dumps, CROSSREF)))

    def load():
        ingest.start(ingest.read_shards(spark, folder), cat, index, works, str(tmp_path / "cp")).awaitTermination()

    def dies(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(ingest, fails_at, dies)
        with pytest.raises(Exception, match="the driver is gone"):
            load()
    assert spark.read.parquet(cat).count() > 0  # the first write had happened
    load()
    load()
    records = [r.record_id for r in spark.read.parquet(cat).collect()]
    assert len(records) == len(set(records)) and {r.record_id for r in spark.read.parquet(index).select("record_id").distinct().collect()} == set(records)
    assert spark.read.parquet(index).groupBy("source_table", "field", "term", "record_id").count().where("count > 1").count() == 0
    assert spark.read.parquet(works).count() == ingest.latest_works(spark.read.parquet(works)).count() == 1


def test_shards(spark):
    lines = spark.createDataFrame([('{"shard": "a"}',), ("b",), (" ",)], "value string")
    assert sorted(r.shard for r in dumps.progress_shards(lines).collect()) == ["a", "b"]
    left = dumps.remaining_shards(spark.createDataFrame([("a",), ("c",)], "shard string"), dumps.progress_shards(lines))
    assert [r.shard for r in left.collect()] == ["c"]


def test_opaque_ids_and_status(spark):
    df = spark.createDataFrame([(1, 5), (1, 2), (2, 1)], "d int, k int")
    assert sorted((r.d, r.k, r.opaque_reference_id) for r in report.opaque_ids(df, ["k"], ["d"]).collect()) == [(1, 2, "ref_0001"), (1, 5, "ref_0002"), (2, 1, "ref_0001")]
    s = spark.createDataFrame([("Verified",), ("needs-review",), (None,), ("skipped",)], "s string").select(report.folded_status(F.col("s")).alias("b")).collect()
    assert [r.b for r in s] == ["verified", "needs_review", "needs_review", "needs_review"]


def test_limits_streams_equal_batch(spark, tmp_path):
    rows = [(k, f"u{k % 2}", f"n{k % 3}", 1000 + 7 * k) for k in range(30)]
    df = spark.createDataFrame(rows, "event_id long, user string, net string, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.repartition(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))

    def run(out, name):
        out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    got = {(r.event_id, r.allowed) for r in run(limits.allow_stream(stream, "user", "ts", "event_id", 60, 3), "t_allow").collect()}
    assert got == {(r.event_id, r.allowed) for r in limits.allow(df, "user", "ts", "event_id", 60, 3).collect()}
    both = limits.allow_all(stream.withColumn("g", F.lit(1)), {"user": (60, 3), "net": (3600, 5)}, "g", "ts", "event_id")
    passed, used = set(), {}
    for k, u, n, s in rows:
        keys = [("u", u, s // 60), ("n", n, s // 3600)]
        if used.get(keys[0], 0) < 3 and used.get(keys[1], 0) < 5:
            passed.add(k)
            for x in keys:
                used[x] = used.get(x, 0) + 1
    assert {r.event_id for r in run(both, "t_all").collect() if r.allowed} == passed
    once = run(limits.consume_stream(stream.select("user", "ts"), "user", "ts", 3600), "t_once")
    assert once.count() == 2
    batch = limits.consume_once(df, "user", "ts", "event_id", 60).where("consumed").collect()
    assert len(batch) > 2 and min(r.event_id for r in batch) == 0


def test_leases_and_jobs(spark, tmp_path):
    events = [("p", "a", "acquire", 0), ("p", "b", "acquire", 1), ("p", "c", "acquire", 2), ("p", "a", "release", 3), ("p", "c", "acquire", 4), ("p", "d", "acquire", 200)]
    df = spark.createDataFrame(events, "pool string, job_id string, action string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000)).drop("s")  # a watermark begins at 0
    df.repartition(1).write.parquet(str(tmp_path / "l"))
    out = limits.leases(spark.readStream.schema(df.schema).parquet(str(tmp_path / "l")), "pool", 2, 100)
    out.writeStream.format("memory").queryName("t_lease").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [(r.job_id, r.granted) for r in spark.table("t_lease").orderBy("ts").collect()] == [("a", True), ("b", True), ("c", False), ("c", True), ("d", True)]
    jobs = spark.createDataFrame([("j", "o", "queued", 1), ("j", "o", "completed", 2), ("j", "o", "running", 3), ("j", "o", "completed", 4), ("k", "o", "queued", 5)], "job_id string, owner string, status string, s long").withColumn("ts", F.timestamp_seconds("s"))
    states = {r.job_id: r.status for r in limits.job_states(jobs, F.timestamp_seconds(F.lit(100)), 50).collect()}
    assert states == {"j": "gone", "k": "queued"}


def test_top_two(spark):
    def top(*rows):
        df = spark.createDataFrame([(list(rows),)], "c array<struct<ordering_score:double,record_id:string,doi:string>>")
        return [r.record_id for r in df.select(cascade.top_two(F.col("c")).alias("t")).first().t]

    assert top((0.9, "a", "10.1/a"), (0.5, "b", "10.1/b")) == ["a", "b"]
    assert top((0.9, "a", "10.1/a"), (0.5, "b", "https://doi.org/10.1/A")) == ["a"]
    assert top((0.9, "a", None), (0.3, "b", None)) == ["a"]


def test_suspicious(spark):
    values = [("exact", "strong", "strong", "near", "unknown", "exact", True), ("exact", "strong", "strong", "near", "yes", "exact", False), ("exact", "partial", "strong", "exact", "yes", "exact", True)]
    df = spark.createDataFrame(values, "doi string, title string, author string, year string, container string, metadata string, x boolean")
    assert all(r.s == r.x for r in df.select(matching.suspicious(F.struct(*df.columns[:6])).alias("s"), "x").collect())


def test_documents_to_report(spark, mock, tmp_path):
    from citeweave.sources import documents
    from tests.test_references import _docx

    lines = [
        "Smith, A. (1996). Advances in climate policy volume 1. Review of Mock Studies, 2(2), 3-12. https://doi.org/10.5555/mock.journal.0001",
        "Garcia, S. (1997). Advances in urban planning volume 2. Annals of Test Data, 3(3), 6-15.",
        "Nobody, X. (2001). Entirely unknown matters of zebra stripes and their uses. Journal of Nothing, 1(1), 1-2.",
    ]
    (tmp_path / "a.docx").write_bytes(_docx([("Intro", "H1"), ("Words.", None), ("References", "H1"), *((x, None) for x in lines)]))
    units = documents.extract(documents.validate(documents.read_files(spark, str(tmp_path))))
    found = resolve.references_of_lists(resolve.lists_of_documents(stage(units, "test-units")))
    rows = {r.ref_pos: r for r in resolve.resolve(found.select("doc_id", "ref_pos", "raw_reference", "style"), mock).collect()}
    assert [rows[k].accepted_record_id for k in (0, 1)] == ["search_journal:mock.journal.0001", "search_journal:mock.journal.0002"]
    assert rows[2].final_status == "needs_review" and {r.style for r in found.collect()} == {"apa7_en"}


def test_stored_tables(spark, mock, tmp_path):
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as out:
        out.write("\n".join(map(json.dumps, CROSSREF)) + "\n\n")
    lines = dumps.read_lines(spark, str(tmp_path), ".jsonl.gz")
    assert lines.count() == len(CROSSREF) and lines.first().shard == "x.jsonl.gz"
    C.write_catalog(mock.catalog, str(tmp_path / "cat"))
    again = spark.read.parquet(str(tmp_path / "cat"))
    assert C.missing_columns(again) == [] and again.where("source_table = 'search_book'").count() == 25
    C.write_index(mock.index, "stored_terms", 4)
    assert spark.table("stored_terms").count() == mock.index.count()
    state = spark.createDataFrame([(1, 100), (2, 900)], "k int, s long").withColumn("updated_at", F.timestamp_seconds("s"))
    assert [r.k for r in limits.prune(state, F.timestamp_seconds(F.lit(1000)), 200).collect()] == [2]


def test_positional_join_keys_and_slices(spark):
    from citeweave.operators import audit

    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "doc_id long, ref_pos int, a string")
    b = spark.createDataFrame([(1, 0, "p"), (1, 1, "q")], "doc_id long, ref_pos int, b string")
    assert {(r.a, r.b) for r in audit.zip_join(a, b, ["doc_id", "ref_pos"]).collect()} == {("x", "p"), ("y", "q")}
    for wrong in (b.limit(1), b.unionByName(b.limit(1))):
        with pytest.raises(Exception, match="positional join"):
            audit.zip_join(a, wrong, ["doc_id", "ref_pos"]).collect()
    assert [r.ref_pos for r in audit.reference_slice(a, index=1).collect()] == [1] and audit.reference_slice(a, most=1).count() == 1
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        got = a.select(audit.owner_key(key, F.col("a")).alias("h")).collect()
        assert {r.h for r in got} == {hmac.new(key, m, hashlib.sha256).hexdigest() for m in (b"x", b"y")}
    assert audit.max_id(a, "ref_pos") == 1 and audit.max_id(a.limit(0), "ref_pos") == 0
    assert all(len(r.report_id) == 32 for r in audit.random_ids(a).collect())


def test_missing_shards_and_progress(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(CROSSREF[0]) + "\n")
    with pytest.warns(UserWarning, match="gone.jsonl is missing"):
        lines = dumps.read_shards(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "gone.jsonl")])
    rows = dumps.crossref_rows(lines)
    dumps.append_progress(rows, str(tmp_path / "progress"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "progress")).collect()] == [{"shard": "a.jsonl", "counts": {"search_journal": 1}}]
    done = dumps.progress_shards(spark.read.text(str(tmp_path / "progress")))
    assert dumps.remaining_shards(spark.createDataFrame([("a.jsonl",), ("b.jsonl",)], "shard string"), done).collect()[0].shard == "b.jsonl"
    with pytest.warns(UserWarning):
        assert dumps.read_shards(spark, [str(tmp_path / "none")]).count() == 0


def test_artifacts(spark, tmp_path):
    import os

    from citeweave.sources import artifacts

    schema = "doc_id string, ref_pos int, opaque_reference_id string, display_reference string, status_bucket string, final_confidence string, accepted_match string, strengths array<string>, concerns array<string>, review_flags array<string>, parsed_fields map<string,string>, search_links array<struct<label:string,href:string>>"
    rows = [("d/1", 1, "ref_0002", "B <x>", "needs_review", None, None, [], ["c"], ["f"], {}, [("doi", "https://doi.org/10.1/a?b&c")]), ("d/1", 0, "ref_0001", "A & *b*", "verified", "high", "<i>T</i><script>x()</script> <b onclick='y'>2</b><img src=z>", ["s"], [], [], {"Title": "T<"}, [])]
    df = spark.createDataFrame(rows, schema)
    assert artifacts.write_reports(df, str(tmp_path / "r")) == {"json": 1, "md": 1, "html": 1, "glance.txt": 1}
    at = lambda suffix: tmp_path / "r" / f"d%2F1.{suffix}"
    body = json.loads(at("json").read_text())
    assert body["counts"] == {"n": 2, "verified": 1, "needs_review": 1, "suspicious": 0} and [r["opaque_reference_id"] for r in body["references"]] == ["ref_0001", "ref_0002"]
    html = at("html").read_text()
    assert "<i>T</i> <b>2</b>" in html and "script" not in html.split("</head>")[1] and "onclick" not in html and "<img" not in html and "B &lt;x&gt;" in html and "T&lt;" in html
    assert "A & \\*b\\*" in at("md").read_text() and at("glance.txt").read_text().startswith("ref_0001\tverified\thigh\tA & *b*")
    assert all(os.stat(at(s)).st_mode & 0o777 == 0o600 for s in ("json", "html"))
    assert artifacts.delete_documents(["d/1"], str(tmp_path / "r")) == 4 and not [f for f in (tmp_path / "r").iterdir() if not f.name.endswith(".crc")]


def test_searches_share_the_records_of_their_rarest_words(spark):
    """400 records, each word in a quarter of them or more: a path has only the records that hold all its words."""
    words = [f"{'abcd'[k % 4] * 3} {'efgh'[k // 4 % 4] * 3} {'ijkl'[k // 16 % 4] * 3} common" for k in range(400)]
    base = C.mock_catalog(spark, 1).where("source_table = 'search_journal'").drop("title_norm", "source_id", "record_id", "granularity", "container_title", "doi_norm")
    rows = spark.createDataFrame([(f"r{k:03d}", w) for k, w in enumerate(words)], "source_id string, title_norm string")
    p = resolve.Catalog.build(C.with_record_ids(base.crossJoin(rows)))
    asked = ["aaa eee iii common", "aaa eee jjj", "aaa eee", "bbb", "aaa eeee"]
    data = [(k, ["search_journal"], [(0, "title_norm", w) for w in a.split()]) for k, a in enumerate(asked)]
    paths = spark.createDataFrame(data, "k int, t array<string>, rare array<struct<df:long,field:string,word:string>>").withColumn("source_table", F.get("t", F.lit(0)))
    paths = paths.withColumn("path", search._path(F.size("rare")))
    fields = p.catalog.select("source_table", "record_id", "title_norm", "author_text", "container_text")
    found = search.records_of_paths(paths, fields, p.index).join(paths.select("k", "path"), "path").groupBy("k").agg(F.sort_array(F.collect_list("record_id")).alias("ids")).collect()
    expected = {k: [f"search_journal:r{n:03d}" for n, w in enumerate(words) if set(a.split()) <= set(w.split())] for k, a in enumerate(asked)}
    assert {r.k: r.ids for r in found} == {k: v for k, v in expected.items() if v}
