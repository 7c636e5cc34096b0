"""Segmentation, parsing, classification, recovery, bibliography and style: cases of reference lists."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from citeweave.operators import bibliography, classify, parse, prepare, recover, segment, style
from citeweave.sources import documents

APA = "Smith, J. A., & de Vries, B. (2001). A great title: with subtitle. Journal of Things, 12(3), 45–67. https://doi.org/10.1000/xyz123"


def parsed(spark, *raws, style_hint=None):
    df = spark.createDataFrame([(1, k, r, style_hint) for k, r in enumerate(raws)], "doc_id long, ref_pos int, raw_reference string, style string")
    return prepare.prepare(classify.classify(parse.parse_references(df, style="style"))).orderBy("ref_pos").collect()


def test_apa_article(spark):
    (r,) = parsed(spark, APA)
    p = r.parsed
    assert [(a.family, a.given) for a in p.author] == [("Smith", "J. A."), ("de Vries", "B.")]
    assert (p.title, p.container_title, p.volume, p.issue, p.pages, p.doi, p.issued_year) == (["A great title: with subtitle"], ["Journal of Things"], ["12"], ["3"], ["45–67"], ["10.1000/xyz123"], "2001")
    assert (r.ctype, r.match_target, r.eligible, r.parser_warnings) == ("journal_article", "crossref", True, [])


@pytest.mark.parametrize(
    "raw, ctype",
    [
        ("Brown, T. (1999). The book title. Oxford: Example University Press.", "book"),
        ("Keller, M. (2010). A chapter. In A. Smith (Ed.), Handbook (pp. 12-34). Sage.", "book_chapter"),
        ("Brown, T. (1999). Deep things. Master thesis, Example.", "thesis"),
        ("Gemeente Amsterdam (2019). Jaarverslag. Geraadpleegd op 3 maart 2020, van https://www.amsterdam.nl/x", "webpage"),
        ("Brown, T. (2020). Numbers [Dataset]. https://zenodo.org/1", "dataset"),
        ("Proceedings of the workshop on things", "conference_paper"),
        ("", "unknown"),
        (None, "unknown"),
    ],
)
def test_types(spark, raw, ctype):
    assert parsed(spark, raw)[0].ctype == ctype


def test_vancouver_and_book_repair(spark):
    v, b = parsed(spark, "1. Smith JA, Brown B. Title of paper. N Engl J Med. 2003;348(12):1123-30.", "Brown, T. (1999). The book title. Oxford: Example University Press.", style_hint="vancouver")
    assert (v.parsed.volume, v.parsed.issue, v.parsed.pages, v.parsed.container_title) == (["348"], ["12"], ["1123-30"], ["N Engl J Med"])
    assert (b.parsed.publisher, b.parsed.location) == (["Example University Press"], ["Oxford"])


def test_recovery_joins_odd_positions_only(spark):
    rows = [(1, 0, "Keller, M. (2010). A chapter on things."), (1, 1, "In A. Smith & B. Jones (Eds.), Handbook of stuff (pp. 12-34). Sage Publications."), (1, 2, APA)]
    df = spark.createDataFrame(rows, "doc_id long, ref_pos int, raw_reference string")
    out = recover.recover(classify.classify(parse.parse_references(df))).orderBy("ref_pos").collect()
    assert [(r.ref_pos, r.recovery_status, r.ctype) for r in out] == [(0, "attached_backward", "book_chapter"), (2, "none", "journal_article")]
    flags = spark.createDataFrame([(1, k, f) for k, f in enumerate([True, True, True, False, True, False])], "d int, k int, f boolean")
    assert [r.takes_next for r in recover.non_overlapping(flags, "f", ["d"], "k").orderBy("k").collect()] == [True, False, True, False, True, False]


@pytest.mark.parametrize(
    "text, kind, expected",
    [
        ("1. Aaa bbb\n2. Ccc ddd\nmore of it\n3. Eee", "text", ["Aaa bbb", "Ccc ddd more of it", "Eee"]),
        ("* Aaa bbb\n* Ccc ddd", "text", ["Aaa bbb", "Ccc ddd"]),
        ("Smith, J. (2001). First.\n\nBrown, T. (2002). Second.", "text", ["Smith, J. (2001). First.", "Brown, T. (2002). Second."]),
        ("Brown, T., &\nKeller, M. (2002). A title. Journal, 1(2), 3-4.", "text", ["Brown, T., & Keller, M. (2002). A title. Journal, 1(2), 3-4."]),
    ],
)
def test_segmentation(text, kind, expected):
    assert segment.split_references(text, kind)[0] == expected


def test_segmentation_errors_and_pages(spark):
    assert segment.split_references("  \n ")[3] == "empty_reference_list_text"
    assert segment.split_references("\n".join(f"{k}. Ref {k} x" for k in range(1, 1003)))[3] == "segmentation_excessive_item_count"
    first = "Smith, J. (2001). A title that goes on for long enough to be finished with. Journal of X, 1(2), 3-4."
    second = "Brown, T. (2002). Another title that goes on for long enough. Journal of Y, 2(2), 5-6."
    hints = [{"text": t, "is_new_block": True, "gap_before": "small", "indentation_change": "outdented"} for t in (first, second)]
    assert segment.split_references(f"{first}\n{second}", "pdf", "apa7_en", hints)[0] == [first, second]
    rows = segment.segment(spark.createDataFrame([(1, "x\x00", "text", "unknown"), (2, None, "text", "unknown")], "doc_id long, text string, source_kind string, style_hint string")).collect()
    assert {(r.doc_id, r.error_code) for r in rows} == {(1, None), (2, "empty_reference_list_text")}


def test_table_function(spark):
    segment.register(spark)
    assert spark.sql("select count(*) as n from split_references('1. Aaa bbb\n2. Ccc ddd', 'text', 'unknown')").first().n == 2


@pytest.mark.parametrize(
    "raws, profile, heading, hint, expected",
    [
        (["1. Smith J. T. J. 2001;1:2.", "2. Brown J. T. J. 2001;1:2."], "", None, "unknown", "vancouver"),
        ([APA], "", "Literatuurlijst", "unknown", "apa7_nl"),
        ([APA, APA], "", "References", "unknown", "apa7_en"),
        (["Smith, J., 2001, 'A title', Journal"], "", None, "unknown", "harvard"),
        (['Smith, John. "A title of it." Journal'], "", None, "unknown", "mla"),
        ([APA], "numeric_profile", None, "unknown", "vancouver"),
        ([APA], "", None, "chicago", "chicago"),
        ([], "", None, "unknown", "apa7_en"),
    ],
)
def test_styles(spark, raws, profile, heading, hint, expected):
    refs = spark.createDataFrame([(1, k, r) for k, r in enumerate(raws)], "doc_id long, ref_pos int, raw_reference string")
    lists = spark.createDataFrame([(1, profile, heading, hint)], "doc_id long, profile string, heading string, style_hint string")
    assert style.detect_styles(refs, lists).first().style == expected


def test_bibliography(spark):
    line = "Smith, J. (2001). A title of things that is rather long indeed so that it counts. Journal of X, 1(2), 3-4."
    pages = ["Intro\nReferences\nare below", f"Prose\nReferences:\n{line}\n{line}\n17", f"{line}\n18", "Appendix A\nx"]
    units = spark.createDataFrame([("d", k, "page", None, t, "normal") for k, t in enumerate(pages)] + [("e", 0, "page", None, "nothing here", "normal")], "doc_id string, unit_index int, kind string, label string, text string, layout string")
    found = {r.doc_id: r for r in bibliography.detect(units).collect()}
    assert (found["d"].heading_unit, found["d"].end_unit, found["d"].text) == (1, 2, f"{line}\n{line}\n\n{line}")
    assert found["e"].error_code == "bibliography_heading_not_found"


def _docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' if s else f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t, s in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_word_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx([("References", "H1"), (APA.replace("&", "&amp;"), None), ("", None)]))
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 1 0 obj /Type /Page endobj %%EOF")
    (tmp_path / "d.txt").write_text("x")
    units = documents.extract(documents.validate(documents.read_files(spark, str(tmp_path)))).collect()
    by = {}
    for u in units:
        by.setdefault(u.doc_id.rpartition("/")[2], []).append(u)
    assert [(u.label, u.text, u.layout) for u in sorted(by["a.docx"], key=lambda u: u.unit_index)] == [("heading 1", "References", "normal"), (None, APA, "normal"), (None, "", "blank"), ("table-cell", "cell", "normal")]
    assert (by["b.docx"][0].error_code, by["c.pdf"][0].error_code) == ("docx_damaged", "no_extractable_text")
    assert "d.txt" not in by


@pytest.mark.parametrize("name, content, code", [("a.txt", b"x", "unsupported_extension"), ("a.pdf", b"", "empty_file"), ("a.pdf", b"hello", "invalid_signature"), ("a.pdf", b"%PDF-1.4 /Type /Page", "pdf_missing_trailer"), ("a.docx", b"zip", "invalid_signature")])
def test_upload_errors(name, content, code):
    assert documents.upload_error(name, content) == code


def test_two_columns():
    words = [{"text": f"L{k}", "x0": 50, "x1": 250, "top": 20 * k, "bottom": 20 * k + 10} for k in range(12)] + [{"text": f"R{k}", "x0": 300, "x1": 500, "top": 20 * k, "bottom": 20 * k + 10} for k in range(12)]
    lines = documents.page_lines(words, 550)
    assert [x["text"] for x in lines] == [f"L{k}" for k in range(12)] + [f"R{k}" for k in range(12)]
    assert documents.layout_hints(lines)[12]["is_new_block"]


def test_line_features(spark):
    lines = spark.createDataFrame([(1, "[1] Smith (2001)"), (1, "• x https://a.b"), (1, "2) y")], "doc_id int, line string")
    r = segment.marker_modes(lines).first()
    assert (r.numbered, r.bulleted, r.marker_mode) == (2, 1, "numbered")
    assert segment.line_features(lines).where(F.col("has_strong_marker")).count() == 1


def test_line_shapes_agree_in_both_engines(spark):
    lines = ["Smith, J. (2001). First.", "van der Berg, A. B. (1999).", "WHO Europe (2010, 3 May). Page.", "1. Aaa  bbb", "[iv] Ccc", "• item", "Retrieved from www.x.org", "doi: 10.1000/x", "x­yz  é ", "", "In K. Editor, Book, 12(2), 3-4.", "Brown, T., &", "(2003).", "Final report http://x.org/r"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, line string").select("k", segment.normal_line(F.col("line")).alias("line"))
    got = {r.k: (r.line, r.bits) for r in rows.withColumn("bits", segment.shape_bits(F.col("line"))).collect()}
    assert got == {k: (segment.normal(t), segment.bits_of(segment.normal(t))) for k, t in enumerate(lines)}


def test_long_lists_without_boundaries_are_linear():
    import time

    began = time.process_time()
    for line in ("and more words of a list without any end", "Smith, J. (2001). and", "Smith, J.,"):
        segment.split_references("\n".join([line] * 5000))
    assert time.process_time() - began < 5


def test_word_rows():
    at = lambda text, x, top: {"text": text, "x0": x, "x1": x + 5, "top": top, "bottom": top + 8}
    rows = documents.word_rows([at("b", 20, 100.5), at("a", 10, 101), at("c", 5, 112), at("d", 9, 113.9), at("e", 1, 130)])
    assert [[w["text"] for w in r] for r in rows] == [["a", "b"], ["c", "d"], ["e"]]
    assert documents.word_rows([]) == []


def pdf_of(pages, compress=True, wide=False):
    """A PDF of lines (x, y, text) with widths, packed streams and, if wide, two-byte codes with a ToUnicode map."""
    import zlib

    def stream(data, more=""):
        packed = zlib.compress(data) if compress else data
        return f"<< /Length {len(packed)} {'/Filter /FlateDecode' if compress else ''} {more}>>\nstream\n".encode() + packed + b"\nendstream"

    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {len(pages)} /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> >> /Kids [{' '.join(f'{10 + 2 * k} 0 R' for k in range(len(pages)))}] >>".encode()}
    chars = sorted({c for lines in pages for _, _, t in lines for c in t})
    if wide:
        rows = "".join(f"<{k + 1:04x}> <{ord(c):04x}>\n" for k, c in enumerate(chars))
        objects[3] = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R /DescendantFonts [4 0 R] >>"
        objects[4] = b"<< /Type /Font /Subtype /CIDFontType2 /DW 500 >>"
        objects[5] = stream(f"1 beginbfrange <0000> <0000> <0020> endbfrange {len(chars)} beginbfchar\n{rows}endbfchar".encode())
        shown = lambda t: "<" + "".join(f"{chars.index(c) + 1:04x}" for c in t) + "> Tj"
    else:
        objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [" + b"500 " * 224 + b"] >>"
        shown = lambda t: "[(" + t[:3].replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ") -20 (" + t[3:].replace("(", "\\(").replace(")", "\\)") + ")] TJ"
    for k, lines in enumerate(pages):
        body = "q 1 0 0 1 0 0 cm BT /F1 10 Tf " + " ".join(f"1 0 0 1 {x} {y} Tm {shown(t)}" for x, y, t in lines) + " ET Q"
        objects[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>".encode()
        objects[11 + 2 * k] = stream(body.encode("cp1252"))
    return b"%PDF-1.5\n" + b"".join(f"{n} 0 obj\n".encode() + o + b"\nendobj\n" for n, o in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF\n"


@pytest.mark.parametrize("compress, wide", [(True, False), (False, False), (True, True)])
def test_pdf_text_layer(spark, tmp_path, compress, wide):
    lines = ["References", "Smith, J. (2001). A title é. Journal, 1(2), 3-4.", "Brown, T. (2002). Another. Press."]
    pages = [[(50, 750 - 15 * k, t) for k, t in enumerate(lines)], [(50, 750, "Second page")], []]
    (tmp_path / "a.pdf").write_bytes(pdf_of(pages, compress, wide))
    (tmp_path / "b.pdf").write_bytes(pdf_of([[]], compress, wide))
    (tmp_path / "c.pdf").write_bytes(pdf_of(pages).replace(b"/Root", b"/Encrypt 9 0 R /Root"))
    units = documents.extract(documents.validate(documents.read_files(spark, str(tmp_path)))).collect()
    by = {}
    for u in units:
        by.setdefault(u.doc_id.rpartition("/")[2], []).append(u)
    assert [(u.label, u.text) for u in sorted(by["a.pdf"], key=lambda u: u.unit_index)] == [("page 1", "\n".join(lines)), ("page 2", "Second page")]
    assert [h.gap_before for h in by["a.pdf"][0].hints][1:] == ["small", "small"]
    assert by["b.pdf"][0].error_code == "no_extractable_text" and by["c.pdf"][0].error_code in ("pdf_encrypted", "encrypted_pdf")


def test_hostile_pdfs_are_errors():
    from citeweave.sources import pdf_words

    whole = pdf_of([[(50, 700, "Some (text) here")]])
    for cut in range(0, len(whole), 37):
        try:
            pdf_words.read_words(whole[:cut] + whole[cut + 5 :])
        except (ValueError, TypeError, IndexError, AttributeError):
            pass
    words = pdf_words.read_words(whole)[0]
    assert [w["text"] for w in words] == ["Some", "(text)", "here"] and words[0]["x0"] == 50 and words[0]["top"] == pytest.approx(92)


def test_registered_extractor(spark, tmp_path):
    documents.register_extractor("docx", lambda content: [(0, "paragraph", None, f"{len(content)} bytes", "normal", None)])
    try:
        rows = spark.createDataFrame([("d", "x.docx", bytearray(b"abc"), None)], "doc_id string, name string, content binary, error_code string")
        assert [u.text for u in documents.extract(rows).collect()] == ["3 bytes"]
    finally:
        documents._extractors.clear()


def test_dutch_rules(spark):
    raws = [
        ("Jansen, A. B., de Vries, C. en van Dijk, D. (2010). Een titel over onder-wijs en e-mail. Uitgever.", "apa7_nl"),
        ("Ministerie van Onderwijs. (z.d.). Jaarverslag van de sector. Geraadpleegd op 3 mei 2020, van www.rijk.nl/x", "apa7_nl"),
        ("Jansen, A. (2011). Hoofdstuk. In P. Bakker en Q. van Leeuwen (red.), Boek over dingen (pp. 1-9). Boom.", "apa7_nl"),
        ("Jansen AB en Smit, C. (2012). Titel. Tijdschrift, 3(1), 2-4.", "apa7_nl"),
        ("Jansen, A. B., de Vries, C. en van Dijk, D. (2010). Een titel over onder-wijs. Uitgever.", "apa7_en"),
    ]
    df = spark.createDataFrame([(k, r, s) for k, (r, s) in enumerate(raws)], "k int, raw_reference string, style string")
    out = [r.parsed for r in parse.parse_references(df, style="style").orderBy("k").collect()]
    names = lambda values: [(n.family, n.given) for n in values]
    assert names(out[0].author) == [("Jansen", "A. B"), ("de Vries", "C"), ("van Dijk", "D")] or names(out[0].author)[:1] == [("Jansen", "A. B.")]
    assert len(out[0].author) == 3 and out[0].title == ["Een titel over onderwijs en e-mail"]
    assert "z.d." in out[1].date and out[1].issued_year is None and out[1].genre == ["informele_publicatie"] and "https://www.rijk.nl/x" in out[1].url and out[1].organization == ["Ministerie van Onderwijs"]
    assert len(out[2].editor) == 2 and out[2].editor[1].family == "van Leeuwen"
    assert names(out[3].author)[0] == ("Jansen", "A.B.") and names(out[3].author)[1][0] == "Smit" and out[4].title == ["Een titel over onder-wijs"]


def test_registered_parser(spark):
    parse.register_parser("empty", lambda df, raw, style: parse.parse_fields(df, raw, style).withColumn("parsed", F.col("parsed").withField("title", F.array(F.lit("fixed")))))
    df = spark.createDataFrame([("Smith, J. (2001). T. J, 1(2), 3-4.",)], "raw_reference string")
    assert parse.parse_references(df, parser="empty").first().parsed.title == ["fixed"]
