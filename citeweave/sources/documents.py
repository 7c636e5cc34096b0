"""Documents: binary files to text units, with a check of each file before it is opened.

``read_files`` lists a folder through the ``binaryFile`` source; ``validate`` and ``extract``
work on its rows in batches. Word files and the text layer of PDF files are read with the
standard library; another reader of positioned words, or of another kind of file, can be
registered (``register_pdf_backend``, ``register_extractor``). Errors are rows, never exceptions.
"""

from __future__ import annotations

import io
import re
import statistics
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave import constants as K
from citeweave.sources import pdf_words

UNITS = "doc_id string, unit_index int, kind string, label string, text string, layout string, hints array<struct<text:string,is_new_block:boolean,gap_before:string,indentation_change:string>>, error_code string"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_backends: dict[str, Callable[[bytes], list[list[dict]]]] = {"pdf": pdf_words.read_words}
#: File suffix to a function from bytes to rows (unit_index, kind, label, text, layout, hints).
_extractors: dict[str, Callable[[bytes], list[tuple]]] = {}


def read_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """doc_id (the path), name, content of the PDF and Word files of a folder, in path order."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(folder).where(F.lower("path").rlike(r"\.(pdf|docx)$"))
    return rows.select(F.col("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "content")


# ------------------------------------------------------------------ validation


def upload_error(name: str, content: bytes, limits: dict | None = None) -> str | None:
    """Why a file is refused, or None."""
    most = {"bytes": K.UPLOAD_BYTES, "pages": K.MAX_PAGES, "objects": 10_000, "streams": 5_000, "objects_per_mb": 2_000, "unpacked": 100 << 20, "ratio": 100} | (limits or {})
    suffix = name.lower().rpartition(".")[2]
    if not content:
        return "empty_file"
    if len(content) > most["bytes"]:
        return "file_too_large"
    if suffix not in ("pdf", "docx"):
        return "unsupported_extension"
    if suffix == "pdf":
        if not content[:1024].lstrip().startswith(b"%PDF-"):
            return "invalid_signature"
        if b"%%EOF" not in content[-2048:]:
            return "pdf_missing_trailer"
        if not re.search(rb"/Type\s*/Pages?\b", content) and b"/ObjStm" not in content:
            return "pdf_missing_page_tree"
        objects, streams = len(re.findall(rb"\b\d+\s+\d+\s+obj\b", content)), content.count(b"endstream")
        if len(re.findall(rb"/Type\s*/Page\b", content)) > most["pages"]:
            return "pdf_too_many_pages"
        if objects > most["objects"] or streams > most["streams"] or objects / max(1.0, len(content) / 1e6) > most["objects_per_mb"]:
            return "pdf_too_complex"
        return None
    if not content.startswith(b"PK\x03\x04"):
        return "invalid_signature"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            entries = archive.infolist()
            names = {e.filename for e in entries}
            if "word/document.xml" not in names or "[Content_Types].xml" not in names:
                return "docx_missing_parts"
            if any(e.filename.startswith("/") or ".." in e.filename.split("/") for e in entries):
                return "docx_unsafe_path"
            if any(e.flag_bits & 1 for e in entries):
                return "docx_encrypted"
            size = sum(e.file_size for e in entries)
            if size > most["unpacked"] or size > most["ratio"] * max(1, sum(e.compress_size for e in entries)):
                return "docx_suspicious_compression"
            if "word/vbaProject.bin" in names:
                return "docx_macros"
    except (zipfile.BadZipFile, OSError):
        return "docx_damaged"
    return None


def validate(files: DataFrame) -> DataFrame:
    """Adds error_code (null if the file may be read)."""

    @F.pandas_udf("string")
    def check(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([upload_error(n or "", c or b"") for n, c in zip(names, contents, strict=True)])

    return files.withColumn("error_code", check("name", "content"))


# ------------------------------------------------------------------ Word files


def _clean(text: str) -> str:
    return " ".join(text.replace("\xa0", " ").split())


def docx_units(content: bytes) -> list[tuple]:
    """(unit_index, kind, label, text, layout) of paragraphs in order; table cells follow where their table stands."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else None
    units: list[tuple] = []

    def text_of(p) -> str:
        parts = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n", "cr": lambda e: "\n"}
        return "".join(parts[e.tag[len(_W) :]](e) for e in p.iter() if e.tag.startswith(_W) and e.tag[len(_W) :] in parts)

    def add(p, label: str | None) -> None:
        text = "\n".join(_clean(x) for x in text_of(p).split("\n")).strip()
        units.append((len(units), "paragraph", label, text, "normal" if text else "blank"))

    def style_of(p) -> str | None:
        ref = p.find(f"{_W}pPr/{_W}pStyle")
        return None if ref is None else names.get(ref.get(f"{_W}val")) or ref.get(f"{_W}val")

    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            add(block, style_of(block))
        elif block.tag == f"{_W}tbl":
            for cell in block.iter(f"{_W}tc"):
                for p in cell.iter(f"{_W}p"):
                    if text_of(p).strip():
                        add(p, "table-cell")
    return units


# ------------------------------------------------------------------ pages of positioned words


def register_pdf_backend(read_words: Callable[[bytes], list[list[dict]]]) -> None:
    """``read_words`` gives for each page its words: dicts with text, x0, x1, top, bottom."""
    _backends["pdf"] = read_words


def register_extractor(suffix: str, units: Callable[[bytes], list[tuple]]) -> None:
    """Read files with another suffix, or one of the known ones in another way."""
    _extractors[suffix.lower().lstrip(".")] = units


def word_rows(words: list[dict], tolerance: float = 3.0) -> list[list[dict]]:
    """Words in rows, each from left to right: a row ends where the next top is more than ``tolerance`` lower, or the row would be twice as high."""
    if not words:
        return []
    tops = np.array([w["top"] for w in words], dtype=float)
    order = np.argsort(tops, kind="stable")
    heights = tops[order]
    row = np.concatenate([[0], np.cumsum(np.diff(heights) > tolerance)])
    first = heights[np.searchsorted(row, row)]
    place = list(zip(row.tolist(), np.floor((heights - first) / (2 * tolerance)).tolist(), strict=True))
    rows: dict[tuple, list[dict]] = {}
    for k, at in zip(order.tolist(), place, strict=True):
        rows.setdefault(at, []).append(words[k])
    return [sorted(r, key=lambda w: w["x0"]) for r in rows.values()]


def column_split(rows: list[list[dict]], width: float, least_rows: int = 8, bucket: float = 12.0) -> float | None:
    """Where a page's two columns part: the commonest wide gap near the middle, if enough rows have it."""
    gaps: list[float] = []
    for row in rows:
        for a, b in zip(row, row[1:]):
            middle = (a["x1"] + b["x0"]) / 2
            if b["x0"] - a["x1"] >= 14 and 0.3 * width <= middle <= 0.7 * width:
                gaps.append(middle)
    if len(gaps) < max(least_rows, len(rows) // 4):
        return None
    best, n = Counter(int(g // bucket) for g in gaps).most_common(1)[0]
    return statistics.median(g for g in gaps if int(g // bucket) == best) if n >= least_rows else None


def page_lines(words: list[dict], width: float) -> list[dict]:
    """Lines of a page in reading order (left column, then right): text, x0, top, bottom, column."""
    rows = word_rows(words)
    split = column_split(rows, width)
    columns = [words] if split is None else [[w for w in words if (w["x0"] + w["x1"]) / 2 < split], [w for w in words if (w["x0"] + w["x1"]) / 2 >= split]]
    out = []
    for k, part in enumerate(columns):
        for row in word_rows(part):
            out.append({"text": _clean(" ".join(w["text"] for w in row)), "x0": row[0]["x0"], "top": min(w["top"] for w in row), "bottom": max(w["bottom"] for w in row), "column": k})
    return [x for x in out if x["text"]]


def layout_hints(lines: list[dict]) -> list[dict]:
    """Gap and indentation of each line against the line before it."""
    steps = [b["top"] - a["top"] for a, b in zip(lines, lines[1:]) if b["column"] == a["column"] and b["top"] > a["top"]]
    usual = statistics.median(steps) if steps else 0.0
    hints = []
    for k, line in enumerate(lines):
        before = lines[k - 1] if k else None
        same = before is not None and before["column"] == line["column"]
        step = line["top"] - before["top"] if same else 0.0
        ratio = step / usual if usual and same else 1.0
        gap = "none" if not same else "small" if ratio < 1.3 else "medium" if ratio < 1.8 else "large"
        shift = line["x0"] - before["x0"] if same else 0.0
        indent = "indented" if shift > 6 else "outdented" if shift < -6 else "same"
        hints.append({"text": line["text"], "is_new_block": before is None or not same or gap == "large" or indent == "outdented", "gap_before": gap, "indentation_change": indent})
    return hints


def pdf_units(content: bytes, most_pages: int = K.MAX_PAGES, most_chars: int = K.MAX_EXTRACTED_CHARS) -> list[tuple]:
    """(unit_index, kind, label, text, layout, hints) of pages with text."""
    pages = _backends["pdf"](content)
    if len(pages) > most_pages:
        raise ValueError("pdf_too_many_pages")
    units, chars = [], 0
    for n, words in enumerate(pages):
        width = max((w["x1"] for w in words), default=0.0) + min((w["x0"] for w in words), default=0.0)
        lines = page_lines(words, width)
        text = "\n".join(x["text"] for x in lines)
        chars += len(text)
        if chars > most_chars:
            raise ValueError("extracted_text_too_large")
        if text:
            units.append((len(units), "page", f"page {n + 1}", text, "normal", layout_hints(lines)))
    return units


# ------------------------------------------------------------------ operator


def extract(files: DataFrame) -> DataFrame:
    """Text units of validated files (doc_id, name, content, error_code); a file that fails gives one row with its error."""
    backends, extractors = dict(_backends), dict(_extractors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _backends.update(backends)
        readers = {"docx": lambda content: [(*u, None) for u in docx_units(content)], "pdf": pdf_units, **extractors}
        columns = [c.split()[0] for c in re.split(r",\s*(?=[a-z_]+ (?:string|int|array))", UNITS)]
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                error, units = r.error_code, []
                if not error:
                    try:
                        reader = readers.get(r.name.lower().rpartition(".")[2])
                        if reader is None:
                            error = "unsupported_extension"
                        else:
                            units = reader(r.content)
                        if not error and not any(u[3] for u in units):
                            error = "no_extractable_text"
                    except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, KeyError, TypeError, IndexError, AttributeError, RecursionError, OverflowError, StopIteration) as trouble:
                        error = str(trouble) if str(trouble).startswith(("pdf_", "extracted_")) else "extraction_failed"
                rows += [(r.doc_id, *u, None) for u in units] if not error else [(r.doc_id, None, None, None, None, None, None, error)]
            yield pd.DataFrame(rows, columns=columns).astype({"unit_index": "Int32"})

    return files.select("doc_id", "name", "content", "error_code").mapInPandas(run, UNITS)
