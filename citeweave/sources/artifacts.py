"""Report artifacts: a JSON, Markdown, HTML and quick-glance file for each document.

Rows of ``report.report_rows`` become one text per document in the JVM (a document has at most
``K.MAX_REFERENCES`` rows); tasks write the files, each under a temporary name and private to
its owner until one rename gives it its name, so a task that is lost or runs twice leaves
whole files only.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that a rendered citation may keep, without attributes.
ALLOWED_TAGS = ("b", "em", "i", "span", "strong", "sub", "sup")


def escape_html(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def sanitize_html(c: Column) -> Column:
    """Scripts and styles go with their text; allowed elements stay without attributes; all else is text."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", "")
    out = escape_html(F.regexp_replace(out, r"(?s)<(?!/?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>)", "\u0001"))
    out = F.replace(out, F.lit("\u0001"), F.lit("&lt;"))
    kept = "|".join(ALLOWED_TAGS)
    out = F.regexp_replace(out, rf"(?i)&lt;(/?)({kept})(?:\s(?:(?!&lt;|&gt;).)*)?/?&gt;", "<$1$2>")
    out = F.regexp_replace(out, r"(?i)&lt;/?[a-z][a-z0-9]*(?:\s(?:(?!&lt;|&gt;).)*)?/?&gt;", "")
    return F.regexp_replace(out, r"&amp;(#?[A-Za-z0-9]+;)", "&$1")


def _lists(rows: DataFrame, entry: Column, alias: str) -> DataFrame:
    by_place = lambda a, b: F.coalesce(a["ref_pos"], F.lit(-1)) - F.coalesce(b["ref_pos"], F.lit(-1))
    ordered = F.array_sort(F.collect_list(F.struct("ref_pos", entry.alias("entry"))), by_place)
    return rows.groupBy("doc_id").agg(F.transform(ordered, lambda e: e["entry"]).alias(alias), *_counts())


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n")] + [F.count_if(F.col("status_bucket") == b).alias(b) for b in ("verified", "needs_review", "suspicious")]


def json_documents(rows: DataFrame) -> DataFrame:
    """doc_id, body: all report rows of a document and its counts."""
    listed = _lists(rows, F.struct(*[c for c in rows.columns if c != "doc_id"]), "references")
    return listed.select("doc_id", F.to_json(F.struct("doc_id", F.struct("n", "verified", "needs_review", "suspicious").alias("counts"), "references"), {"ignoreNullFields": "false"}).alias("body"))


def glance_documents(rows: DataFrame) -> DataFrame:
    """doc_id, body: one line for each reference: id, status, confidence, the start of its text."""
    line = F.concat_ws("\t", "opaque_reference_id", "status_bucket", F.coalesce("final_confidence", F.lit("-")), F.substring(F.coalesce("display_reference", F.lit("")), 1, 100))
    return _lists(rows, line, "lines").select("doc_id", F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("body"))


def markdown_documents(rows: DataFrame) -> DataFrame:
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\`*_\[\]<>|#])", r"\\$1")
    listed = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n- {title}: "), F.array_join(F.transform(c, plain), "; "))).otherwise("")
    entry = F.concat(
        F.lit("## "), F.col("opaque_reference_id"), F.lit(" ("), F.col("status_bucket"), F.lit(")\n\n"), plain(F.col("display_reference")),
        F.coalesce(F.concat(F.lit("\n\nMatch: "), plain(F.col("accepted_match"))), F.lit("")), F.lit("\n"),
        listed("strengths", F.col("strengths")), listed("concerns", F.col("concerns")), listed("flags", F.col("review_flags")),
    )
    head = F.concat(F.lit("# Report "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("verified").cast("string"), F.lit(" verified, "), F.col("needs_review").cast("string"), F.lit(" to review, "), F.col("suspicious").cast("string"), F.lit(" suspicious\n\n"))
    return _lists(rows, entry, "entries").select("doc_id", F.concat(head, F.array_join("entries", "\n\n"), F.lit("\n")).alias("body"))


def html_documents(rows: DataFrame, title: str = "Report") -> DataFrame:
    """A page with a header of counts, a filter by status, and a card for each reference."""
    item = lambda c: F.concat(F.lit("<li>"), escape_html(c), F.lit("</li>"))
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"<h3>{name}</h3><ul>"), F.array_join(F.transform(c, item), ""), F.lit("</ul>"))).otherwise("")
    links = F.array_join(F.transform("search_links", lambda x: F.concat(F.lit('<a rel="noopener noreferrer" href="'), escape_html(x["href"]), F.lit('">'), escape_html(x["label"]), F.lit("</a>"))), " ")
    fields = F.array_join(F.transform(F.map_entries("parsed_fields"), lambda e: F.concat(F.lit("<tr><th>"), escape_html(e["key"]), F.lit("</th><td>"), escape_html(e["value"]), F.lit("</td></tr>"))), "")
    card = F.concat(
        F.lit('<section class="card" data-status="'), F.col("status_bucket"), F.lit('"><h2>'), F.col("opaque_reference_id"), F.lit("</h2><p>"), escape_html(F.coalesce("display_reference", F.lit(""))), F.lit("</p>"),
        F.coalesce(F.concat(F.lit("<p>"), sanitize_html(F.col("accepted_match")), F.lit("</p>")), F.lit("")),
        F.coalesce(F.concat(F.lit("<table>"), fields, F.lit("</table>")), F.lit("")),
        listed("Strengths", F.col("strengths")), listed("Concerns", F.col("concerns")), listed("Flags", F.col("review_flags")),
        F.coalesce(F.concat(F.lit("<p>"), links, F.lit("</p>")), F.lit("")), F.lit("</section>"),
    )
    number = lambda name: F.concat(F.lit(f'<li><a href="#{name}">{name.replace("_", " ")}</a>: '), F.col(name).cast("string"), F.lit("</li>"))
    style = ".card{border:1px solid #bbb;margin:1em 0;padding:1em}" + "".join(f"#{b}:target~.card:not([data-status={b}]){{display:none}}" for b in ("verified", "needs_review", "suspicious"))
    anchors = "".join(f'<span id="{b}"></span>' for b in ("verified", "needs_review", "suspicious"))
    head = F.concat(F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>{style}</style></head><body>{anchors}<h1>{title}</h1><ul><li><a href="#">all</a>: '), F.col("n").cast("string"), F.lit("</li>"), *[number(b) for b in ("verified", "needs_review", "suspicious")], F.lit("</ul>"))
    return _lists(rows, card, "cards").select("doc_id", F.concat(head, F.array_join("cards", ""), F.lit("</body></html>\n")).alias("body"))


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_private(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    """Write a file whole or not at all; on a local disk only its owner may read it."""
    folder, _, name = path.rpartition("/")
    made = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if isinstance(fs, pafs.LocalFileSystem):
        with open(os.open(made, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as out:
            out.write(content)
            out.flush()
            os.fsync(out.fileno())
    else:
        with fs.open_output_stream(made) as out:
            out.write(content)
    fs.move(made, path)


def _write(folder: str, suffix: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, root = _filesystem(folder)
    for batch in batches:
        sizes = []
        for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist(), strict=True):
            content = (body or "").encode()
            write_private(fs, f"{root}/{name}{suffix}", content)
            sizes.append(len(content))
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], names=["name", "bytes"])


def write_documents(documents: DataFrame, folder: str, suffix: str) -> int:
    """Write each body (doc_id, body) to ``folder``, named by the URL-encoded doc_id; the number of files."""
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    named = documents.select(F.url_encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("name"), "body")
    return named.mapInArrow(partial(_write, folder, suffix), "name string, bytes long").count()


def write_reports(rows: DataFrame, folder: str) -> dict[str, int]:
    """All four artifacts of each document; the number of files of each kind."""
    kinds = {"json": json_documents, "md": markdown_documents, "html": html_documents, "glance.txt": glance_documents}
    return {suffix: write_documents(make(rows), folder, f".{suffix}") for suffix, make in kinds.items()}


def delete_documents(doc_ids: list, folder: str) -> int:
    """Delete all artifacts of expired documents (a bounded list, as a job store's cleanup gives it)."""
    from urllib.parse import quote_plus

    fs, root = _filesystem(folder)
    names = {quote_plus(str(i), safe="*") for i in doc_ids}
    gone = [f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.split(".json")[0].split(".md")[0].split(".html")[0].split(".glance.txt")[0] in names]
    for path in gone:
        fs.delete_file(path)
    return len(gone)
