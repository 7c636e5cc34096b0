"""Text, names and similarity: cases as rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeweave.functions import names as N
from citeweave.functions import similarity as S
from citeweave.functions import text as T


def one(spark, column, **values):
    """The value of an expression over one row of strings (or arrays)."""
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], kinds).select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "value, query, catalog",
    [
        ("Müller’s Æther: a Study", "muller aether a study", "mullers aether a study"),
        ("Łódź  ß ﬀ", "lodz ss", "lodz ss"),
        ("reference's", "reference", "reference s"),
        (None, "", ""),
        ("", "", ""),
    ],
)
def test_normal_forms(spark, value, query, catalog):
    assert one(spark, T.norm_query(F.col("v")), v=value) == query
    assert one(spark, T.norm_catalog(F.col("v")), v=value) == catalog


@pytest.mark.parametrize("value, expected", [("https://doi.org/10.1/Ab.", "10.1/ab"), ("doi: 10.1/x;", "10.1/x"), (" http://dx.doi.org/10.2/y ", "10.2/y"), (None, "")])
def test_doi(spark, value, expected):
    assert one(spark, T.normalize_doi(F.col("v")), v=value) == expected


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("10.1111/1467-9566.", "10.1111/1467-9566.13038", True),
        ("10.1111/1467-9566", "10.1111/1467-9566.13038", True),
        ("10.1111/1467-956", "10.1111/1467-9566.13038", False),
        ("10.1/a", "10.1/a.b", False),
        ("10.1111/abcdef", "10.1111/abcdef", False),
    ],
)
def test_doi_prefix(spark, a, b, expected):
    assert one(spark, T.doi_prefix_equivalent(F.col("a"), F.col("b")), a=a, b=b) is expected
    assert one(spark, T.doi_prefix_equivalent(F.col("b"), F.col("a")), a=a, b=b) is expected


def test_terms(spark):
    assert one(spark, T.title_terms(F.col("v")), v="The Study of Social Media and an Owl") == ["study", "social", "media", "owl"]
    assert one(spark, T.title_terms(F.col("v"), True), v="The Study of Social Media and an Owl") == ["owl"]
    assert one(spark, T.title_terms(F.col("v")), v="The and") == ["the", "and"]
    assert one(spark, T.main_title(F.col("v")), v="Main title. Second part") == "Main title"
    assert one(spark, T.main_title(F.col("v")), v="Main (e.g. this): more") == "Main (e.g. this)"


def test_lists_and_display(spark):
    assert one(spark, T.text_list(F.col("v")), v='["a", " b "]') == ["a", "b"]
    assert one(spark, T.text_list(F.col("v")), v="a| b;c|") == ["a", "b", "c"]
    assert one(spark, T.display(F.col("v"), 10), v="a  b\nc d e f g h i") == "a b c d e..."
    assert one(spark, T.paste_error(F.col("v")), v="a\x07b") == "reference_text_invalid_characters"
    assert one(spark, T.paste_error(F.col("v")), v=" <p></p> ") == "empty_reference_text"


@pytest.mark.parametrize("name, forms", [("Jan van der Berg", ["van der berg", "vanderberg", "berg"]), ("de Vries", ["de vries", "devries", "vries"]), ("O'Neil-Smith, M", ["oneilsmith"]), ("A B", []), ("", [])])
def test_surname_candidates(spark, name, forms):
    assert one(spark, N.surname_candidates(F.col("v")), v=name) == forms


def test_names(spark):
    assert one(spark, N.initials(F.col("v")), v="Mary-Kate 2 anne") == "M. K. A."
    literal = F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), F.col("v").alias("literal"))
    fixed = one(spark, N.repair_name(literal), v="Smith JA")
    assert (fixed.family, fixed.given) == ("Smith", "J.A.")
    assert one(spark, N.without_aggregates(F.col("v")), v=["smith jones brown", "smith", "jones"]) == ["smith", "jones"]
    pairs = one(spark, N.people(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a="", b='["Å", "a"]', c="z", d="x|y")
    assert [(p.name, p.initials) for p in pairs] == [("Å", "x")]


@pytest.mark.parametrize("value, expected", [("1023-9", "1023-1029"), ("199–3", "199-203"), ("pp. 12-15", "12-15"), ("930-938.e1", "930-938.e1"), ("99-1", "99-101"), ("e12", "e12"), (None, "")])
def test_page_range(spark, value, expected):
    assert one(spark, S.page_range(F.col("v")), v=value) == expected


@pytest.mark.parametrize(
    "a, b, score, match",
    [
        (("12", "3", "930-938"), ("12", "3", "930-938.e1"), 0.97, "partial"),
        (("12", None, None), ("12", "3", "1-2"), 1.0, "exact"),
        (("1", "3", "930"), ("12", "3", "930-938"), 0.3, "partial"),
        (("1", None, None), ("2", None, None), 0.0, "mismatch"),
        ((None, None, None), ("2", "1", "3"), 0.0, "unknown"),
    ],
)
def test_metadata(spark, a, b, score, match):
    values = dict(zip("abcdef", (*a, *b), strict=True))
    names = ("volume", "issue", "pages")
    credits = S.metadata_credits({n: F.col(c) for n, c in zip(names, "abc", strict=True)}, {n: F.col(c) for n, c in zip(names, "def", strict=True)})
    assert one(spark, S.metadata_score(credits), **values) == pytest.approx(score)
    assert one(spark, S.metadata_match(credits), **values) == match


@pytest.mark.parametrize("a, b, expected", [("Ann Intern Med", "Annals of Internal Medicine", True), ("AEM", "Annals of Emergency Medicine", True), ("Nature", "Nature", False), ("J X", "K Y", False), ("Annals", "Annals of Surgery", False)])
def test_journal_abbreviation(spark, a, b, expected):
    assert one(spark, S.journal_abbreviation(F.col("a"), F.col("b")), a=a, b=b) is expected
    assert one(spark, S.journal_abbreviation(F.col("b"), F.col("a")), a=a, b=b) is expected


def test_authors_and_publishers(spark):
    assert one(spark, S.author_overlap(F.col("a"), F.col("b")), a=["Smithe", "de Vries"], b=["Smith", "Vries", "X"]) == 1.0
    assert one(spark, S.author_overlap(F.col("a"), F.col("b")), a=["Smith", "Smith"], b=["Smith"]) == 1.0
    assert one(spark, S.author_overlap(F.col("a"), F.col("b")), a=[], b=["Smith"]) == 0.0
    assert one(spark, S.container_similarity(F.col("a"), F.col("b"), True), a="Sage", b="Sage Publications") == 1.0
    assert one(spark, S.container_similarity(F.col("a"), F.col("b"), True), a="University Press", b="Academic Press") < 1.0
    assert one(spark, S.book_title_for_query(F.col("a")), a="In A. Smith & B. Jones (Eds.) Handbook of things") == "Handbook of things"
    assert one(spark, S.editors_in_book_title(F.col("a")), a="In A. Smith & B. Jones (Eds.) Handbook") == ["smith", "jones"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=4), st.text("abc", max_size=4)), min_size=1, max_size=20))
def test_one_edit_is_symmetric_and_right(spark, pairs):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i, *[0] * len(b)]
            for j, y in enumerate(b, 1):
                row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
        return row[-1]

    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.within_one_edit(F.col("a"), F.col("b")).alias("x"), S.within_one_edit(F.col("b"), F.col("a")).alias("y")).collect()
    for r in rows:
        assert r.x == r.y == (bool(r.a) and bool(r.b) and distance(r.a, r.b) <= 1)
