"""SQL (DuckDB dialect) that says what each query returns.

Statements are put together from the pieces below; RE2 has no look-around, so patterns
differ from those of the expressions where they need it.
"""

from __future__ import annotations

from citeweave import constants as K
from citeweave.functions.text import fold_table
from citeweave.sources.generated import CITATIONS_SQL

BIB = f"bib as ({CITATIONS_SQL})"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def fold(x: str, letters: dict[str, str]) -> str:
    source, target = fold_table()
    single = {a: b for a, b in letters.items() if len(b) == 1}
    out = f"translate(coalesce({x}, ''), {_q(source + ''.join(single))}, {_q(target + ''.join(single.values()))})"
    for a, b in letters.items():
        if len(b) > 1:
            out = f"replace({out}, {_q(a)}, {_q(b)})"
    return rf"regexp_replace({out}, '[^\x00-\x7F]', '', 'g')"


def norm_query(x: str) -> str:
    straight = f"trim(translate(coalesce({x}, ''), '’‘', ''''''))"
    bare = rf"regexp_replace(lower({fold(straight, K.FOLD_LETTERS_QUERY)}), '\b([a-z0-9]+)''s\b', '\1', 'g')"
    return f"trim(regexp_replace({bare}, '[^a-z0-9]+', ' ', 'g'))"


def norm_catalog(x: str) -> str:
    return f"trim(regexp_replace(lower({fold(x, K.FOLD_LETTERS)}), '[^a-z0-9]+', ' ', 'g'))"


def terms(x: str) -> str:
    """List of title terms of ASCII text ``x``."""
    long = f"list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) >= 3)"
    own = f"list_filter({long}, lambda t: not list_contains({_list(K.COMMON_TITLE_WORDS)}, t))"
    return f"(case when len({own}) > 0 then {own} else {long} end)"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    return f"(case when len({a}) = 0 or len({b}) = 0 then 0.0 else {both} / len(list_distinct(list_concat({a}, {b}))) end)"


def cut(value: str, cuts: list[tuple[float, str]]) -> str:
    return "case " + " ".join(f"when {value} >= {c} then {_q(n)}" for c, n in cuts) + f" when {value} > 0 then 'weak' else 'none' end"


def pick(key: str, table: dict[str, float]) -> str:
    return f"(case {key} " + " ".join(f"when {_q(k)} then {v}" for k, v in table.items()) + " else 0.0 end)"


ORACLES: dict[str, str] = {}

# ------------------------------------------------------------------ text

ORACLES["norm_text"] = f"select doc_id, {norm_query('text')} as query_form, {norm_catalog('text')} as catalog_form from documents"

ORACLES["title_terms"] = f"""
select p_partkey, array_to_string({terms("p_name || ': ' || p_type")}, '|') as terms, trim(p_name) as main_title, 'review|social|media|use' as distinctive from part"""

_RAW_DOI = "case k % 4 when 0 then 'https://doi.org/' || doi when 1 then 'DOI: ' || upper(doi) || '.' when 2 then ' http://dx.doi.org/' || doi || '/ ' else doi end"
ORACLES["doi_normalize"] = rf"""
with {BIB}, n as (select k, lower(trim(trim(regexp_replace(trim({_RAW_DOI}), '(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', '')), '.;,')) as d from bib)
select k, d as doi_norm, rtrim(d, '/') as doi_key from n"""

ORACLES["doi_equivalence"] = f"""
with {BIB}, c as (select k, doi, case variant when 5 then '10.5555/bib.' when 4 then '10.5555/bib.' || (k + 1) else doi || '.suppl' end as cited from bib),
o as (select k, case when length(cited) <= length(doi) then cited else doi end as s, case when length(cited) <= length(doi) then doi else cited end as l from c)
select k, s <> l and length(s) >= 10 and starts_with(l, s) and (right(s, 1) in ('.', '-', '_', '/', ';', ':', '(', ')') or substr(l, length(s) + 1, 1) in ('.', '-', '_', '/', ';', ':', '(', ')')) as equivalent from o"""

ORACLES["reference_ids"] = f"with {BIB} select k, raw_reference as cleaned, 'ref_' || substr(sha1(raw_reference), 1, 12) as reference_id from bib"


def _unescaped(x: str) -> str:
    from citeweave.functions.text import _ENTITIES

    for name, char in _ENTITIES.items():
        x = f"replace({x}, {_q(name)}, {_q(char)})"
    return x


ORACLES["markup_clean"] = rf"""
with u as (select page_id, replace(replace(trim({_unescaped("coalesce(html, '')")}), '<![CDATA[', ''), ']]>', '') as h from pages),
s as (select page_id, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as h from u)
select page_id, regexp_replace(h, '\s+([,.;:!?])', '\1', 'g') as clean from s"""

_KEY = "regexp_replace(lower(surname), '^((de|van|der) )+', '')"
ORACLES["name_forms"] = rf"""
with {BIB}
select k, regexp_extract(surname, '(\S+)$', 1) as family, initial || '. M.' as initials, {_KEY} as surname_key,
 array_to_string(list_filter(case when contains(surname, ' ') then [lower(surname), replace(lower(surname), ' ', ''), regexp_extract(lower(surname), '(\S+)$', 1)] else [lower(surname)] end, lambda f: length(f) >= 3), '|') as search_forms,
 case surname when 'de Vries' then 'De Vries' when 'van der Berg' then 'Van der Berg' else surname end as display
from bib"""

# ------------------------------------------------------------------ similarity

_PAIRS = "pairs as (select a.p_partkey as a_key, b.p_partkey as b_key, a.p_name as a_name, b.p_name as b_name, a.p_type as a_type, b.p_type as b_type from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey)"
ORACLES["title_similarity"] = f"""
with {_PAIRS}, s as (select a_key, b_key, round({jaccard(terms("a_name || ' ' || a_type"), terms("b_name || ' ' || b_type"))}, 4) as similarity from pairs)
select a_key, b_key, similarity, {cut("similarity", K.TITLE_CUTS)} as strength from s"""

ORACLES["one_edit"] = f"""
with {_PAIRS} select a_key, b_key, levenshtein(lower(split_part(a_name, ' ', 1)), lower(split_part(b_name, ' ', 1))) <= 1 as close, true as plural from pairs"""

ORACLES["page_ranges"] = f"""
with {BIB}, f as (select k, pages, k % 400 + 1000 as f from bib)
select k, cast(f as varchar) || '-' || cast(case when (f // 10) * 10 + f % 10 < f then f + 10 else f end as varchar) as page_range, pages as plain from f"""

# Credits: pages 0.8 for a suffix; a page range of one side is never a bare page. The issue is missing for variant 1.
ORACLES["metadata_scores"] = f"""
with {BIB}, c as (select k,
  case when variant = 3 then case when length(volume) >= 2 then 0.8 else 0.0 end else 1.0 end as v,
  case when variant = 1 then null else 1.0 end as i,
  case when variant = 2 then 0.0 when variant = 4 then 0.8 else 1.0 end as p from bib)
select k, round((0.55 * v + coalesce(0.30 * i, 0) + 0.15 * p) / (0.55 + case when i is null then 0 else 0.30 end + 0.15), 4) as score,
 case when least(v, coalesce(i, 1), p) >= 1 then 'exact' when greatest(v, coalesce(i, 0), p) > 0 then 'partial' else 'mismatch' end as match from c"""

ORACLES["journal_abbreviations"] = f"with {BIB} select k, true as by_words, true as by_initials, false as other from bib"

# ------------------------------------------------------------------ catalog load

_TYPE = "case k % 8 when 0 then 'search_journal' when 1 then 'search_book_chapter' when 2 then 'search_conference' when 3 then 'search_book' when 4 then 'search_journal' when 6 then 'search_book' when 7 then 'search_book_chapter' end"
ORACLES["type_routing"] = f"select source_table, count(*) as n_rows from (select {_TYPE.replace('k %', 'o_orderkey %')} as source_table from orders) where source_table is not null group by source_table"

ORACLES["crossref_ingest"] = f"""
with {BIB}, t as (select *, {_TYPE} as source_table, 'Example ' || initial as pub from bib)
select doi, source_table, {norm_catalog('title')} as title_norm,
 case source_table when 'search_book' then lower(pub) when 'search_book_chapter' then lower(container) || ' ' || lower(pub) else lower(container) end as container_text,
 lower(surname) as author_text, year,
 case when source_table in ('search_journal', 'search_conference') then container end as journal,
 case when source_table = 'search_book_chapter' then container end as book_title,
 case when source_table in ('search_book', 'search_book_chapter') then pub end as publisher,
 case when source_table in ('search_journal', 'search_conference') then volume end as volume,
 case when source_table = 'search_journal' then issue end as issue,
 case when source_table in ('search_journal', 'search_conference') then pages end as pages,
 initial || '. P.' as initials, doi as source_id
from t where source_table is not null"""

ORACLES["openlibrary_ingest"] = """
select '/books/' || o_orderkey as ol_key, 'book of ' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) || ' ' || o_orderkey as title_norm, 'ex co' as container_text,
 coalesce(lower(regexp_replace(c_name, '[^A-Za-z]', '', 'g')), '') as author_text, cast(1990 + o_orderkey % 30 as int) as year, cast(o_orderkey as varchar) as isbn
from orders left join customer on o_custkey = c_custkey"""

ORACLES["catalog_insert_or_ignore"] = """
with n as (select '10.5555/' || l_orderkey as doi, case when l_linenumber <> 2 then l_partkey end as isbn, l_orderkey * 10 + l_linenumber as seq from lineitem
 where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')),
a as (select * from n qualify row_number() over (partition by doi order by seq) = 1)
select doi, isbn, seq from a qualify isbn is null or row_number() over (partition by isbn order by seq) = 1"""

ORACLES["catalog_upsert"] = "select l_orderkey as doi, l_linenumber as seq, l_returnflag from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber desc) = 1"

ORACLES["json_props"] = "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events"

# ------------------------------------------------------------------ index and search

_CATALOG = f"""cat as (select k, 'search_journal:' || lpad(cast(k as varchar), 12, '0') as record_id, year, {norm_catalog('title')} as title_norm, lower(surname) as author_text, lower(container) as container_text from bib)"""
_POSTINGS = """post as (select field, term, record_id, count(*) as tf from (
 select 'title_norm' as field, unnest(string_split(title_norm, ' ')) as term, record_id from cat
 union all select 'author_text', unnest(string_split(author_text, ' ')), record_id from cat
 union all select 'container_text', unnest(string_split(container_text, ' ')), record_id from cat) where term <> '' group by all)"""
_LENGTH = "len(string_split(title_norm, ' ')) + len(string_split(author_text, ' ')) + len(string_split(container_text, ' '))"

ORACLES["term_index"] = f"with {BIB}, {_CATALOG}, {_POSTINGS} select field, term, record_id, tf from post"
ORACLES["term_frequencies"] = f"with {BIB}, {_CATALOG}, {_POSTINGS} select field, term, count(*) as df from post group by field, term"
ORACLES["table_statistics"] = f"with {BIB}, {_CATALOG} select 'search_journal' as source_table, count(*) as n_records, round(avg({_LENGTH}), 4) as average_length from cat"

ORACLES["bm25_topk"] = f"""
with {BIB}, {_CATALOG}, {_POSTINGS},
st as (select count(*) as n, avg({_LENGTH}) as avgdl from cat),
df as (select term, count(*) as df from post where field = 'title_norm' group by term),
q as (select k as ref_pos, year, unnest(array_slice({terms('title')}, 3, 4)) as term, len(array_slice({terms('title')}, 3, 4)) as n_terms from bib),
h as (select q.ref_pos, q.year, q.n_terms, p.record_id, p.tf, case when ln((st.n - df.df + 0.5) / (df.df + 0.5)) <= 0 then 1e-6 else ln((st.n - df.df + 0.5) / (df.df + 0.5)) end as idf, st.avgdl
 from q join post p on p.field = 'title_norm' and p.term = q.term join df on df.term = q.term cross join st),
r as (select ref_pos, h.year, record_id, c.year as row_year, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ({_LENGTH}) / avgdl))) as rank_value, count(*) as n, max(n_terms) as n_terms
 from h join cat c using (record_id) group by ref_pos, h.year, record_id, c.year),
a as (select * from r where n = n_terms qualify row_number() over (partition by ref_pos order by rank_value, record_id) <= 20),
b as (select * from a where abs(row_year - year) <= 2 qualify row_number() over (partition by ref_pos order by rank_value, record_id) <= 5)
select ref_pos, record_id, round(rank_value, 4) as rank_value from b"""

_CITED_DOI = "case when variant in (1, 7) then '' when variant = 4 then '10.5555/bib.' || (k + 1) when variant = 5 then '10.5555/bib' else doi end"
_SHOWN_TITLE = "title || case when variant = 7 then ': A second look' else '' end"
_CITED_NAME = "case when variant = 3 then surname || 'e' else surname end"
_CITED_YEAR = "case when variant = 2 then year + 1 else year end"
ORACLES["parsed_fields"] = f"""
with {BIB}
select k, {_CITED_NAME} as family, initial || '.' as given, cast({_CITED_YEAR} as varchar) as year, {_SHOWN_TITLE} as title, container, volume, issue, pages, {_CITED_DOI} as doi,
 case when variant in (1, 7) then 'parser_missing_identifier' else '' end as warnings from bib"""

ORACLES["reference_types"] = f"""
with {BIB} select ctype, count(*) as n from (select case k % 7 when 0 then 'journal_article' when 1 then 'thesis' when 2 then 'book' when 3 then 'dataset' when 4 then 'conference_paper' when 5 then 'book_chapter' else 'webpage' end as ctype from bib) group by ctype"""

ORACLES["match_preparation"] = f"""
with {BIB}
select k as ref_pos, true as eligible, 'crossref' as match_target, 'author|container_title|' || case when variant in (1, 7) then '' else 'doi|' end || 'issue|issued_year|pages|title|volume' as keys,
 case when variant in (1, 7) then '' else 'signal_group_1_present|' end || 'signal_group_2_present|signal_group_3_present|signal_group_4_present|signal_group_5_present' as basis, '' as missing from bib"""

_TERMS = f"list_filter({terms('shown')}, lambda t: not list_contains({_list(K.BROAD_TITLE_WORDS)}, t))"
_CTERMS = f"list_filter({terms('container')}, lambda t: not list_contains({_list(K.BROAD_TITLE_WORDS)}, t))"
ORACLES["search_plan"] = f"""
with {BIB}, t as (select k, cast({_CITED_YEAR} as varchar) as y, lower({_CITED_NAME}) as a, {_SHOWN_TITLE} as shown, container from bib),
w as (select k, y, a, {_TERMS} as t, {_CTERMS} as c from t),
s as (
 select k, y, 'journal_title_year_exact' as strategy, t[1:4] as t, '' as a, [] as c, null as why from w
 union all select k, y, 'journal_title_author_year_exact', t[1:4], a, [], null from w
 union all select k, y, 'journal_title3_year_exact', t[1:3], '', [], null from w
 union all select k, y, 'journal_title_container_year_exact', t[1:4], '', c[1:2], null from w
 union all select k, y, 'journal_title6_year_exact_doi_miss', t[1:6], '', [], 'phase4_doi_miss_recall_band_skipped' from w
 union all select k, y, 'journal_title6_author_year_exact_doi_miss', t[1:6], a, [], 'phase4_doi_miss_recall_band_skipped' from w
 union all select k, y, 'journal_title6_container_year_exact_doi_miss', t[1:6], '', c[1:3], 'phase4_doi_miss_recall_band_skipped' from w
 union all select k, y, 'journal_title3_year_near', t[1:3], '', [], 'phase4_skipped_relaxed_query_default_off' from w
 union all select k, y, 'journal_title6_year_near_doi_miss', t[1:6], '', [], 'phase4_doi_miss_recall_band_skipped' from w)
select k as ref_pos, strategy, array_to_string(t, '|') as title, a as author, array_to_string(c, '|') as container, y as year, why as skip_reason from s"""

_HITS = f"""hits as (select b.k as ref_pos, c.k as hit from (select k, {_CITED_DOI} as cited from bib) b join bib c on c.doi = b.cited)"""
ORACLES["doi_matches"] = f"with {BIB}, {_HITS} select ref_pos, 'search_journal:' || lpad(cast(hit as varchar), 12, '0') as record_id from hits"
ORACLES["doi_unmatched"] = f"""
with {BIB} select k, cited as doi from (select k, variant, {_CITED_DOI} as cited from bib where variant not in (1, 5, 7)) where cited not in (select doi from bib)"""

# Signals of each citation against the record that its DOI names, or its own.
_SIM = jaccard("xt", "ct")
_SIM_MAIN = jaccard("xm", "ct")
_CONT = jaccard("list_filter(string_split(lower(x_cont), ' '), lambda t: t not in ('journal', 'of'))", "list_filter(string_split(lower(c_cont), ' '), lambda t: t not in ('journal', 'of'))")
_SCORED = f"""{_HITS},
pr as (select b.k as ref_pos, b.c_custkey, b.variant, {_CITED_DOI.replace('variant', 'b.variant').replace('(k + 1)', '(b.k + 1)').replace('else doi', 'else b.doi')} as x_doi, c.doi as c_doi,
 {terms("b.title || case when b.variant = 7 then ': A second look' else '' end")} as xt, {terms("b.title")} as xm, {terms("c.title")} as ct,
 case when b.variant = 3 then b.surname || 'e' else b.surname end as x_name, c.surname as c_name,
 case when b.variant = 2 then b.year + 1 else b.year end as x_year, c.year as c_year, b.container as x_cont, c.container as c_cont,
 b.volume as xv, c.volume as cv, b.issue as xi, c.issue as ci, b.pages as xp, c.pages as cp
 from bib b left join hits h on h.ref_pos = b.k join bib c on c.k = coalesce(h.hit, b.k)),
f as (select *, greatest({_SIM}, {_SIM_MAIN}) as sim,
 case when levenshtein({_KEY.replace('surname', 'x_name')}, {_KEY.replace('surname', 'c_name')}) <= 1 then 1.0 else 0.0 end as au,
 case when x_year = c_year then 1.0 when abs(x_year - c_year) = 1 then 0.33 else 0.0 end as yr,
 case when x_cont = c_cont then 1.0 else {_CONT} end as co,
 case when xv = cv then 1.0 when length(least(xv, cv)) >= 2 and (starts_with(xv, cv) or starts_with(cv, xv)) and least(length(xv), length(cv)) >= 2 then 0.8 else 0.0 end as v,
 case when xi = ci then 1.0 else 0.0 end as i,
 case when xp = cp then 1.0 when (starts_with(xp, cp) or starts_with(cp, xp)) then 0.8 else 0.0 end as p from pr),
g as (select *, case when x_doi = '' then 'none' when x_doi = c_doi then 'exact' when starts_with(c_doi, x_doi || '.') and length(x_doi) >= 10 then 'equivalent' else 'mismatch' end as doi,
 {cut("sim", K.TITLE_CUTS)} as title, {cut("au", K.AUTHOR_CUTS)} as author,
 case when x_year = c_year then 'exact' when abs(x_year - c_year) = 1 then 'near' else 'mismatch' end as year,
 case when co > 0 then 'yes' else 'no' end as container, (0.55 * v + 0.30 * i + 0.15 * p) / 1.0 as meta,
 case when least(v, i, p) >= 1 then 'exact' when greatest(v, i, p) > 0 then 'partial' else 'mismatch' end as metadata from f)"""
ORACLES["candidate_scores"] = f"""
with {BIB}, {_SCORED}
select ref_pos, doi, title, author, year, container, metadata,
 round(round(least(1.0, case doi when 'exact' then 1.0 when 'equivalent' then 0.85 else 0.0 end + sim * 0.45 + au * 0.2 + yr * 0.15 + co * 0.1 + meta * 0.1), 4), 3) as score from g"""

_JUDGED = f"""{_SCORED},
s as (select *, case when doi = 'none' then 1.0 else {pick('doi', K.DOI_SCORES)} end as s_doi, {pick('title', K.TITLE_SCORES)} as s_title, {pick('author', K.AUTHOR_SCORES)} as s_author,
 {pick('year', K.YEAR_SCORES)} as s_year, {pick('container', K.CONTAINER_SCORES)} as s_container, {pick('metadata', K.METADATA_SCORES)} as s_metadata from g),
j as (select *, case when title in ('exact_or_near_exact', 'strong') and doi = 'mismatch' then 0.24 else 0.0 end
  + case when title = 'strong' and author in ('none', 'weak') then 0.24 else 0.0 end
  + case when title in ('exact_or_near_exact', 'strong') and author = 'none' then 0.12 else 0.0 end
  + case when title in ('exact_or_near_exact', 'strong') and year = 'mismatch' then 0.12 else 0.0 end
  + case when container = 'no' then 0.05 else 0.0 end as structure from s),
c as (select *, greatest(0.0, least(1.0, s_title * 0.36 + s_author * 0.25 + s_year * 0.12 + s_container * 0.09 + s_doi * 0.12 + s_metadata * 0.06 - structure)) as confidence,
 doi = 'mismatch' or year = 'mismatch' or container = 'no' or structure >= 0.12 as major from j),
d as (select *, case when confidence < 0.55 then 'suspicious' when confidence >= 0.82 and not major then 'verified' else 'needs_review' end as final_status,
 doi in ('exact', 'equivalent') and cast(title in ('none', 'weak') as int) + cast(author in ('none', 'weak') as int) + cast(container = 'no' as int) + cast(year = 'mismatch' as int) >= 2 as conflict,
 title in ('none', 'weak', 'partial') or year = 'mismatch' or author in ('none', 'weak') or container = 'no' or metadata = 'mismatch' or
  cast(year = 'near' as int) + cast(author = 'partial' as int) + cast(metadata = 'partial' as int) >= 2 as suspicious from c)"""
ORACLES["confidence_status"] = f"""
with {BIB}, {_JUDGED}
select ref_pos, cast(round(confidence, 4) as double) as confidence, case when confidence >= 0.82 then 'high' when confidence >= 0.65 then 'medium' when confidence >= 0.55 then 'low' else 'none' end as name, final_status, suspicious from d"""

_CHECKS = """list_filter([
 case when doi <> 'none' or x_doi <> '' then 'DOI_EXTRACTED_FROM_REFERENCE:pass' else 'DOI_NOT_EXTRACTED_FROM_REFERENCE:not_applicable' end,
 case when x_doi = '' then 'EXTRACTED_DOI_LOOKUP_SKIPPED:not_applicable' when doi in ('exact', 'equivalent') then 'EXTRACTED_DOI_FOUND_IN_DB:pass' else 'EXTRACTED_DOI_NOT_FOUND_IN_DB:warning' end,
 case when x_doi = '' then 'EXTRACTED_DOI_MATCH_SKIPPED:not_applicable' when doi = 'exact' then 'EXTRACTED_DOI_MATCHES_CANDIDATE:pass' when doi = 'equivalent' then 'EXTRACTED_DOI_EQUIVALENT_TO_CANDIDATE:pass' when doi = 'mismatch' then 'EXTRACTED_DOI_CONTRADICTS_CANDIDATE:fail' else 'EXTRACTED_DOI_NOT_CONFIRMED_AGAINST_CANDIDATE:not_applicable' end,
 case when conflict then 'DOI_RECORD_METADATA_CONFLICT:fail' end,
 case title when 'exact_or_near_exact' then 'TITLE_EXACT_OR_NEAR:pass' when 'strong' then 'TITLE_STRONG_MATCH:pass' when 'partial' then 'TITLE_PARTIAL_MATCH:warning' when 'weak' then 'TITLE_WEAK_MATCH:fail' else 'TITLE_NO_MATCH:fail' end,
 case author when 'strong' then 'AUTHOR_STRONG_MATCH:pass' else 'AUTHOR_NO_MATCH:fail' end,
 case when title = 'strong' and author = 'none' then 'JOURNAL_TITLE_AUTHOR_TENSION:fail' end,
 case year when 'exact' then 'YEAR_EXACT_MATCH:pass' when 'near' then 'YEAR_NEAR_MATCH:warning' else 'YEAR_MISMATCH:fail' end,
 case container when 'yes' then 'CONTAINER_CONFIRMED:pass' else 'CONTAINER_MISMATCH:fail' end,
 case metadata when 'exact' then 'METADATA_EXACT_MATCH:pass' when 'partial' then 'METADATA_PARTIAL_MATCH:warning' else 'METADATA_MISMATCH:fail' end,
 case when structure >= 0.12 then 'STRUCTURAL_CONTRADICTION:fail' end], lambda x: x is not null)"""


def _codes(pattern: str, words: str, n: int) -> str:
    return f"array_to_string(array_slice(list_transform(list_filter(checks, lambda x: {pattern} and list_contains({words}, split_part(x, ':', 1))), lambda x: split_part(x, ':', 1)), 1, {n}), '|')"


def _evidence() -> str:
    from citeweave.operators.evaluate import CONCERNS, FLAGS, STRENGTHS

    good = "ends_with(x, ':pass') and not (conflict and starts_with(x, 'EXTRACTED_DOI'))"
    bad = "(ends_with(x, ':warning') or ends_with(x, ':fail'))"
    flags = _codes("not ends_with(x, ':pass')", _list(list(FLAGS)), 20)
    for k, v in FLAGS.items():
        if k != v:
            flags = f"replace({flags}, {_q(k)}, {_q(v)})"
    return f"""
with {BIB}, {_JUDGED}, e as (select ref_pos, conflict, {_CHECKS} as checks from d)
select ref_pos, len(checks) as n_checks, {_codes(good, _list(STRENGTHS), 4)} as strengths, {_codes(bad, _list(CONCERNS), 5)} as concerns, {flags} as flags from e"""


ORACLES["evidence_flags"] = _evidence()
ORACLES["status_counts"] = f"""
with {BIB}, {_JUDGED} select c_custkey as doc_id, count(*) filter (where final_status = 'verified') as verified, count(*) filter (where final_status = 'needs_review') as needs_review, count(*) filter (where final_status = 'suspicious') as suspicious from d group by c_custkey"""
ORACLES["triage"] = f"""
with {BIB}, {_JUDGED} select case when final_status = 'verified' then 'ok' when doi = 'mismatch' then 'doi' when title in ('weak', 'none', 'partial') then 'title' else 'other' end as bucket, count(*) as n from d group by 1"""

ORACLES["cascade_stop"] = """
with l as (select l_orderkey as o, l_linenumber as n, l_partkey as r, round(l_quantity / 60, 4) as s from lineitem),
sc as (select o, r, max(s) as s, min(n) as n from l group by o, r),
steps as (select distinct o, n from l),
st as (select steps.o, steps.n, max(sc.s) as best, (list_sort(list(sc.s), 'DESC'))[2] as second from steps join sc on sc.o = steps.o and sc.n <= steps.n group by steps.o, steps.n),
w as (select o, n, case when second >= 0.35 then 'phase4_stop_top2_filled' when best >= 0.75 then 'phase4_stop_strong_candidate_found' end as why from st),
c as (select o, coalesce(min(n) filter (where why is not null), max(n)) as stop_at, arg_min(why, n) filter (where why is not null) as stop_reason from w group by o)
select c.o as ref_pos, stop_at, stop_reason, string_agg('s' || steps.n, '|' order by steps.n) as attempted from c join steps on steps.o = c.o and steps.n <= c.stop_at group by c.o, stop_at, stop_reason"""

ORACLES["top_two"] = """
with r as (select l_orderkey, round(l_quantity / 50, 4) as s, l_partkey || ':' || l_linenumber as id, l_suppkey as doi, row_number() over (partition by l_orderkey order by round(l_quantity / 50, 4) desc, l_partkey || ':' || l_linenumber desc) as n from lineitem),
p as (select a.l_orderkey, a.id as best, a.s as s1, b.s as s2, b.s is not null and b.s >= 0.35 and a.doi <> b.doi and a.id <> b.id as ok from r a left join r b on b.l_orderkey = a.l_orderkey and b.n = 2 where a.n = 1),
g as (select *, case when ok then round(abs(s1 - s2), 4) end as gap from p)
select l_orderkey, case when ok then 2 else 1 end as n_top, best, gap, cast(case when gap is null or gap >= 0.12 then 0.0 when gap >= 0.08 then 0.04 when gap >= 0.04 then 0.10 else 0.18 end as double) as penalty from g"""

# ------------------------------------------------------------------ lists, styles, reports

ORACLES["segment_numbered"] = f"with {BIB} select c_custkey as doc_id, cast(row_number() over (partition by c_custkey order by k) - 1 as int) as ref_pos, case when count(*) over (partition by c_custkey) >= 2 then raw_reference else '1. ' || raw_reference end as raw_reference, cast(null as varchar) as error_code from bib"
ORACLES["segment_plain"] = f"with {BIB} select c_custkey as doc_id, cast(row_number() over (partition by c_custkey order by k) - 1 as int) as ref_pos, raw_reference, case when count(*) over (partition by c_custkey) >= 2 then 'author_year_profile' else 'unknown_profile' end as profile, cast(null as varchar) as error_code from bib"
ORACLES["marker_modes"] = f"""
with {BIB}, n as (select c_custkey, count(*) as n from bib group by 1)
select c_custkey as doc_id, n as numbered, 0 as bulleted, case when n >= 2 then 'numbered' end as marker_mode from n union all select -c_custkey - 1, 0, 0, null from n"""
_RE_YEAR = r"\(\s*(?:19|20)\d{2}[a-z]?\s*\)|\b(?:19|20)\d{2}[a-z]?\b"
_RE_STRONG = r"(?i)(doi:\s*\S+|https?://\S+|www\.\S+|\bissn\b|\bisbn\b|\b10\.\d{4,9}/\S+)"
_RE_NUMBERED = r"(?i)^(?:(?:\d+|[ivxlcdm]+)[\.\)]\s+|\[(?:\d+|[ivxlcdm]+)\]\s+)"
ORACLES["line_flags"] = f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, count(*) as n_lines, count(*) filter (where regexp_matches(line, '{_RE_YEAR}')) as has_year, count(*) filter (where regexp_matches(line, '{_RE_STRONG}')) as has_strong_marker,
 count(*) filter (where regexp_matches(ltrim(line), '{_RE_NUMBERED}')) as is_numbered, count(*) filter (where regexp_matches(ltrim(line), '^[*•·]\\s+')) as is_bullet from l group by doc_id"""
ORACLES["style_counts"] = f"""
with {BIB}, f as (select * from bib qualify row_number() over (partition by c_custkey order by k) <= 40),
c as (select c_custkey as doc_id, count(*) as n_sample, 0 as numbered, count(*) filter (where not starts_with(surname, 'de ') and not starts_with(surname, 'van ')) as apa, 0 as english_cues from f group by 1)
select doc_id, n_sample, numbered, apa, english_cues, case when doc_id % 7 = 0 then 'mla' when doc_id % 3 = 0 then 'apa7_nl' else 'apa7_en' end as style,
 case when doc_id % 7 = 0 then 'explicit_user_style' when doc_id % 3 = 0 then 'dutch_heading_apa_nl' when apa >= greatest(1, least(3, (n_sample + 1) // 2)) then 'apa_author_year' else 'fallback_apa7_en' end as decision from c"""
ORACLES["adjacent_attach"] = """
with t as (select conv_id, turn, length(coalesce(text, '')) % 3 <> 0 as tail from conversations),
r as (select *, sum(case when tail then 0 else 1 end) over (partition by conv_id order by turn) as run from t)
select conv_id, turn, tail and sum(case when tail then 1 else 0 end) over (partition by conv_id, run order by turn) % 2 = 1 as takes_next from r"""
ORACLES["heading_sections"] = f"""
with {BIB} select c_custkey as doc_id, '5. References:' as heading, 1 as heading_unit, 1 as end_unit, string_agg(raw_reference, chr(10) order by k) as text from bib group by c_custkey"""

_NAME = "case surname when 'de Vries' then 'De Vries' when 'van der Berg' then 'Van der Berg' else surname end || ', ' || initial || '.'"
_BARE = "rtrim(" + _NAME + ", '.')"
ORACLES["rendered_citations"] = f"""
with {BIB}
select 'search_journal:' || lpad(cast(k as varchar), 12, '0') as record_id,
 {_NAME} || ' (' || year || '). ' || title || '. ' || container || ', ' || volume || '(' || issue || '), ' || pages || '. https://doi.org/' || doi as apa,
 {_BARE} || '. ' || title || '. ' || container || '. ' || year || ';' || volume || '(' || issue || '):' || pages || '. https://doi.org/' || doi as vancouver,
 {_BARE} || '. "' || title || '." ' || container || ', ' || year || ', pp. ' || pages || '..' as mla,
 {_BARE} || '. ' || year || '. "' || title || '." ' || container || '.' as chicago,
 {_BARE} || ' (' || year || ') ' || title || '. ' || container || '.' as harvard, '' as warnings from bib"""
ORACLES["opaque_ids"] = f"with {BIB} select k, 'ref_' || lpad(cast(row_number() over (partition by c_custkey order by k) as varchar), 4, '0') as opaque_reference_id from bib"
ORACLES["phase_rows"] = f"""
with {BIB}, i as (select variant, c_custkey || '/ref_' || lpad(cast(row_number() over (partition by c_custkey order by k) as varchar), 4, '0') as id from bib),
m as (select id, variant, case when variant = 2 then null when variant = 3 then 'skipped' else 'candidate_only' end as ms from i),
f as (select id, ms, case variant when 4 then 'verified' when 5 then 'suspicious' else case when ms = 'skipped' then 'skipped' when ms is not null then 'needs_review' when variant = 1 then 'skipped' else 'unmatched' end end as fs from m)
select id as opaque_reference_id, ms as match_status, fs as final_status, case when fs in ('verified', 'suspicious') then fs else 'needs_review' end as bucket from f"""
ORACLES["review_links"] = f"""
with {BIB}, t as (select k, variant, doi, replace(title, ' ', '+') as t, replace(surname, ' ', '+') as a from bib)
select k, case when variant = 0 then '' else case when k % 2 = 0 then 'https://scholar.google.com/scholar?hl=nl&as_sdt=0%2C5&q=' || t || '&btnG=' else 'https://openlibrary.org/search?title=' || t || '&author=' || a end
 || case when variant = 5 then ' https://doi.org/' || doi else '' end end as links from t"""

# ------------------------------------------------------------------ limits and profiles

_EPOCH = "cast(floor(epoch(ts) / {}) as bigint)"
ORACLES["rate_limit"] = f"""
with w as (select event_id, user_id, ts, {_EPOCH.format(86400)} as window_id from events)
select event_id, window_id, row_number() over (partition by user_id, window_id order by ts, event_id) <= 2 as allowed from w"""
ORACLES["rate_limit_stream"] = ORACLES["rate_limit"]
ORACLES["soft_limit"] = f"select user_id, {_EPOCH.format(7 * 86400)} as window_id, count(*) as n, count(*) >= 3 as challenge from events group by 1, 2"
ORACLES["consumed_tokens"] = """
with recursive e as (select event_id, user_id, cast(floor(epoch(ts)) as bigint) as t from events),
u as (select user_id, t, min(event_id) as event_id from e group by user_id, t),
d as (select a.user_id, a.t, min(b.t) as next_t from u a join u b on a.user_id = b.user_id and b.t > a.t + 259200 group by a.user_id, a.t),
n as (select d.*, u.event_id as next_id from d join u on u.user_id = d.user_id and u.t = d.next_t),
p as (select user_id, min(t) as t, arg_min(event_id, t) as event_id from u group by user_id union all select n.user_id, n.next_t, n.next_id from p join n on n.user_id = p.user_id and n.t = p.t)
select event_id, event_id in (select event_id from p) as consumed from events"""
ORACLES["slow_outliers"] = """
with c as (select l_quantity, quantile_disc(l_extendedprice, 0.95) as p95, count(*) as n from lineitem group by l_quantity)
select l_orderkey, l_linenumber, round(p95, 2) as p95 from lineitem join c using (l_quantity) where n >= 3 and l_extendedprice > greatest(1000.0, p95 * 1.02)"""

ORACLES["timing_summaries"] = """
with t as (select l_returnflag, 'l_quantity' as timing, l_quantity as ms from lineitem union all select l_returnflag, 'l_tax', l_tax * 100 from lineitem where l_tax > 0)
select l_returnflag, timing, count(*) as n, round(sum(ms), 2) as total, round(avg(ms), 4) as mean, round(quantile_disc(ms, 0.95), 2) as p95, round(max(ms), 2) as slowest from t group by 1, 2"""
ORACLES["zipped_lines"] = "select l_linenumber, count(*) as n, cast(sum(l_partkey * 7 + l_suppkey) as bigint) as \"check\" from lineitem group by l_linenumber"
ORACLES["first_references"] = f"with {BIB}, r as (select c_custkey as doc_id, cast(row_number() over (partition by c_custkey order by k) - 1 as int) as ref_pos, raw_reference from bib) select * from r where ref_pos in (0, 1, 3)"
ORACLES["maintained_index"] = f"""
with {BIB}, {_CATALOG}, {_POSTINGS}, t as (select *, cast(split_part(record_id, ':', 2) as int) as number from post where field = 'title_norm'),
kept as (select term, record_id, tf from t where number % 5 <> 0 union all select distinct 'revised', record_id, 1 from t where number % 3 = 0 and number % 5 <> 0)
select term, count(*) as n_records, cast(sum(tf) as bigint) as n_uses from kept group by term"""
