"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import best_fit, chat_format, locally_consistent, media_archive, page_differ, quality_fm, secret_scan, source_mix, trie_join, warc_store
from citeweave.llm.common import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_fm.train(documents, table(spark, sf_dir, "labels"))
    scored = quality_fm.score(documents.select("doc_id", "text", quality_fm.held_out(F.col("doc_id")).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digests(chat_format.read_back(chat_format.format_conversations(rows)))


def op4_page_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_differ.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc_store.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    found = warc_store.records(spark, folder)
    return found.withColumn("refers_to", F.col("refers_to").cast(found.schema["page_id"].dataType))


def op7_locally_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locally_consistent.with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op9_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "media")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    media_archive.write_archives(documents, folder)
    return media_archive.media_features(media_archive.read_archives(spark, folder), documents.schema["doc_id"].dataType.simpleString())


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("placements")).alias("taken"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5's result: all but the spans of the entropy scan."""
    return op5_secret_scan(spark, sf_dir).drop("spans")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10's result: all but which documents the mix takes."""
    return op10_source_mix(spark, sf_dir).drop("taken")


QUERIES = {
    "op1_quality_fm": op1_quality_fm,
    "op2_trie_join": op2_trie_join,
    "op3_chat_format": op3_chat_format,
    "op4_page_differ": op4_page_differ,
    "op5_secret_scan": op5_secret_scan,
    "op6_warc_store": op6_warc_store,
    "op7_locally_consistent": op7_locally_consistent,
    "op8_best_fit": op8_best_fit,
    "op9_media_archive": op9_media_archive,
    "op10_source_mix": op10_source_mix,
    "base_secrets": base_secrets,
    "mix_targets": mix_targets,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op3_chat_format"] = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n as (select *, row_number() over w as pos, lag(role) over w as before, count(*) over (partition by conv_id) as total from t window w as (partition by conv_id order by turn nulls first, role, text)),
m as (select *, case when before is null then role in ('system', 'user') when before = 'system' then role = 'user' when before = 'user' then role = 'assistant' when before = 'assistant' then role = 'user' else false end as fits,
 length(url_encode(role)) + 14 + length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) as chars from n),
c as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by pos) as said, coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '') as loss, sum(chars) as chars,
 coalesce(min(pos) filter (where not fits), max(case when pos = total and role not in ('user', 'assistant') then total + 1 end), 0) as error_at from m group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars, error_at = 0 as valid, cast(error_at as int) as error_at from c"""

_BASE = "(?:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_PLACES = "list_transform(range(1, len({m}) + 1), lambda i: struct_pack(s := coalesce(list_sum(list_transform({p}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0), k := {k}, e := length({m}[i]), n := {n}))"
ORACLE_SQL["base_secrets"] = f"""
with d as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
f as (select *, regexp_extract_all(t, '(?i){_BASE}') as am, regexp_extract_all(t, '(?i){_BASE}', 1) as av, string_split_regex(t, '(?i){_BASE.replace("([", "(?:[")}') as ap,
 regexp_extract_all(t, 'AKIA[A-Z0-9]+') as xm, string_split_regex(t, 'AKIA[A-Z0-9]+') as xp, regexp_extract_all(t, '[0-9a-f]+') as hm, string_split_regex(t, '[0-9a-f]+') as hp from d
 where regexp_matches(t, '(?i)(?:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{{14}}|[0-9a-f]{{16}}')),
p as (select r, unnest(list_concat({_PLACES.format(m="am", p="ap", k=0, n="length(av[i])")}, {_PLACES.format(m="xm", p="xp", k=1, n="length(xm[i])")}, list_filter({_PLACES.format(m="hm", p="hp", k=2, n="length(hm[i])")}, lambda x: x.n >= 16))) as x from f),
g as (select r, x.s as s, x.k as k, x.s + x.e as e from p where x.n >= case x.k when 0 then 12 when 1 then 18 else 16 end),
a as (select r, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
 string_agg(['assign', 'access', 'hex'][k + 1] || ':' || s || ':' || e, ',' order by s, k) as spans from g group by r)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from d left join a using (r)"""

ORACLE_SQL["op6_warc_store"] = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, upper(sha1(coalesce(html, ''))) as h from pages),
g as (select h, min(page_id) as first_id from p group by h),
b as (select h, first_id, list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(1, 6), lambda j: strpos('0123456789ABCDEF', substr(h, 5 * i + j, 1)) - 1), lambda x, y: x * 16 + y)) as v from g),
z as (select h, first_id, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([32768, 1024, 32, 1], lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((x // q) % 32 as int) + 1, 1)), '')), '') as payload_digest from b)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to from p join z using (h)"""

ORACLE_SQL["mix_targets"] = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size) as source_size from d group by source),
w as (select *, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as weight, 3.0 * source_size as cap from s),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level from w window b as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
c as (select *, level * weight > cap as capped from l),
t as (select source, source_size, case when capped then cap else weight * (select arg_min(level, cap / weight) from c where not capped) end as target from c)
select doc_id, size, cast(source_size as bigint) as source_size, cast(target as double) as target from d join t on d.source is not distinct from t.source"""
