"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are cut into phrases by deterministic coin tossing: runs of one symbol
are taken together, each symbol gets the index and value of the lowest bit in which it
differs from the symbol before it, twice to four times, until there are fewer than six
labels; phrases begin at local maxima of the labels. A phrase's name is a hash of the names
in it. The same is done with the names, level after level. Where a phrase begins depends on
a few symbols around it, so equal substrings have equal phrases inside, at any offset.

A fingerprint holds the smallest ``KEEP`` hashes of the phrase names of the levels
``LEVELS``; the likeness of two fingerprints is the bottom-k estimate of the Jaccard
similarity of their name sets. Everything is array code over many texts at once.

``with_edits`` pairs each document with the next by descending id. Ids are cut into ranges at
exact ids, a range goes to one task in order, and the first document of the range below is
sent along, so no task sees more than its range and one more row. Texts travel compressed.

Null text counts as empty; an empty text has the empty fingerprint, and two empty ones are
alike to 1. Rows that repeat an id follow each other in the order of their texts' digests; null ids
come last. A single document is its own next. An empty table gives an empty result. Columns
other than doc_id and text are ignored; ids must be numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import bounded_batches, _BYTE, lean, mix, range_bucket, shuffle_width, span_hashes, text_array, text_chunks

KEEP = 64
LEVELS = (2, 3)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _coin_table(n: int) -> np.ndarray:
    """label of (symbol, symbol before): twice the lowest differing bit's index, plus that bit of the symbol."""
    a, b = np.arange(n)[:, None], np.arange(n)[None, :]
    differ = a ^ b
    low = np.zeros((n, n), dtype=np.int64)
    nonzero = differ > 0
    low[nonzero] = np.log2((differ & -differ)[nonzero]).astype(np.int64)
    return (2 * low + ((a >> low) & 1)).astype(np.uint8)


_COIN_BYTE = _coin_table(256).ravel()
_COIN_SMALL = _coin_table(128).ravel()


def _toss(labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One round on labels below 128; the first of a row is compared with its own lowest bit flipped."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[rows] = labels[rows] ^ 1
    return _COIN_SMALL[(labels.astype(np.uint16) << 7) | before]


def _phrases(names: np.ndarray, labels: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases, and each row's first phrase."""
    n = len(names)
    rows = first[:-1][np.diff(first) > 0]
    rise = np.zeros(n + 1, dtype=bool)
    rise[1:n] = labels[1:] > labels[:-1]
    rise[rows] = False
    fall = np.zeros(n, dtype=bool)
    fall[: n - 1] = labels[:-1] > labels[1:]
    fall[rows[1:] - 1] = False
    cut = rise[:n] & fall
    cut[rows] = True
    starts = np.flatnonzero(cut)
    return span_hashes(names, starts, np.append(starts[1:], n)), np.searchsorted(starts, first)


def _runs(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of one symbol begin, their lengths, and each row's first run."""
    new = np.ones(len(symbols), dtype=bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(symbols))).astype(np.uint64), np.searchsorted(at, first)


def phrase_levels(buf: np.ndarray, offsets: np.ndarray, top: int = max(LEVELS)) -> list[tuple[np.ndarray, np.ndarray]]:
    """(phrase names, each row's first phrase) of levels 1 to ``top``."""
    if not len(buf):
        return [(np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64))] * top
    at, length, first = _runs(buf, offsets)
    symbols = buf[at]
    names = mix(_BYTE[symbols] + length * _STEP)
    rows = first[:-1][np.diff(first) > 0]
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[rows] = symbols[rows] ^ 1
    labels = _COIN_BYTE[(symbols.astype(np.uint16) << 8) | before]
    out = []
    for level in range(top):
        for _ in range(2 if level == 0 else 3):
            labels = _toss(labels, rows)
        names, first = _phrases(names, labels, first)
        out.append((names, first))
        if level + 1 < top:
            at, length, first = _runs(names, first)
            symbols = names[at]
            names = mix(symbols + length * _STEP)
            rows = first[:-1][np.diff(first) > 0]
            before = np.empty_like(symbols)
            before[1:] = symbols[:-1]
            before[rows] = symbols[rows] ^ np.uint64(1)
            differ = symbols ^ before
            low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
            labels = ((low << 1) | ((symbols >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    return out


def fingerprints(texts: pa.Array) -> list[np.ndarray]:
    """The sorted hashes of each text's fingerprint."""
    out: list[np.ndarray] = []
    for i, j, buf, offsets in text_chunks(texts):
        levels = phrase_levels(buf, offsets)
        keys = []
        for level in LEVELS:
            names, first = levels[level - 1]
            row = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(first))
            keys.append((row << np.uint64(32)) | (mix(names + np.uint64(level)) >> np.uint64(32)))
        keys = np.unique(np.concatenate(keys))
        cuts = np.searchsorted(keys, np.arange(j - i + 1, dtype=np.uint64) << np.uint64(32))
        values = keys.astype(np.uint32)
        out += [values[a : min(b, a + KEEP)] for a, b in zip(cuts, cuts[1:])]
    return out


def encoded(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    left, right = set(a.tolist()), set(b.tolist())
    least = sorted(left | right)[:KEEP]
    return sum(x in left and x in right for x in least) / len(least)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _emit(keys: list, texts: list[str], shown: list[bool], id_type: pa.DataType) -> pa.RecordBatch:
    """Rows for all texts but the last, each followed by the next; rows with ``shown`` false are left out."""
    at = [i for i in range(len(texts) - 1) if shown[i]]
    changed = [edited(texts[i], texts[i + 1]) for i in at]
    own = fingerprints(pa.array(texts, pa.large_string()))
    other = fingerprints(pa.array(changed, pa.large_string()))
    columns = [
        pa.array([keys[i] for i in at], id_type),
        pa.array([len(texts[i]) for i in at], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
        pa.array([encoded(own[i]) for i in at], pa.string()),
        pa.array([encoded(x) for x in other], pa.string()),
        pa.array([likeness(own[i], x) for i, x in zip(at, other, strict=True)], pa.float64()),
        pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", *dict(_FIELDS)])


@lean
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as Zstandard frames (half of what the shuffle's own compression leaves), and their digests as tie-breakers."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in text_array(batch.column("text")).to_pylist()]
        columns = [batch.column(c) for c in ("doc_id", "bucket", "above", "head")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([pack(t) for t in texts], pa.binary()), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())], names=["doc_id", "bucket", "above", "head", "packed", "digest"])


def _pairs(alone: bool):
    """Tasks see buckets in order; in each the documents in order, then the first of the next bucket (marked ``tail``)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: tuple | None = None  # the last document, which waits for its next
        head: str | None = None
        id_type = None
        for batch in batches:
            id_type = batch.column("doc_id").type
            keys = batch.column("doc_id").to_pylist()
            buckets = batch.column("bucket").to_pylist()
            tails = batch.column("tail").to_pylist()
            texts = [unpack(x).decode("utf-8", "surrogatepass") for x in batch.column("packed").to_pylist()]
            head = texts[0] if head is None and texts else head
            if held is not None:
                keys, buckets, tails, texts = [held[0], *keys], [held[1], *buckets], [held[2], *tails], [held[3], *texts]
            # The row before a change of bucket is a tail, so a document's next is the row after it.
            step, size, start = [], 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size > 4 << 20 or i == len(texts) - 1:
                    step.append((start, i))
                    start, size = i, 0
            for a, b in step:
                if b > a:
                    yield _emit(keys[a : b + 1], texts[a : b + 1], [not t for t in tails[a : b + 1]], id_type)
            held = (keys[-1], buckets[-1], tails[-1], texts[-1]) if texts else held
        if alone and held is not None:  # one bucket: the last document's next is the first
            yield _emit([held[0], None], [held[3], head], [True, False], id_type)

    return run


def with_edits(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    width = shuffle_width(spark)
    n = 4 * width
    cuts = [(k + 1) / n for k in range(n)]
    found = rows.agg(F.percentile_approx("doc_id", cuts, max(10000, 20 * n)).alias("b")).first().b
    bounds = sorted(set(found or []))
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    packed = f"doc_id {kind}, bucket int, above int, head boolean, packed binary, digest binary"
    order = ["bucket", "tail", F.col("doc_id").desc_nulls_last(), "digest"]
    if len(bounds) < 2:
        one = rows.withColumns({"bucket": F.lit(0), "above": F.lit(0), "head": F.lit(False)}).mapInArrow(_pack, packed)
        return one.withColumn("tail", F.lit(0)).repartition(1).sortWithinPartitions(*order).mapInArrow(_pairs(True), schema)
    rows = rows.withColumn("bucket", range_bucket(F.col("doc_id"), bounds))
    # A bound is the first document of its bucket: it also closes the bucket above, the largest the lowest bucket.
    is_head = F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1) == F.col("doc_id")
    rows = rows.withColumns({"above": (F.col("bucket") + 1) % len(bounds), "head": F.coalesce(is_head, F.lit(False))}).mapInArrow(_pack, packed)
    seat = lambda bucket, tail: F.struct(F.col(bucket).alias("bucket"), F.lit(tail).alias("tail"))
    seats = F.when(F.col("head"), F.array(seat("bucket", 0), seat("above", 1))).otherwise(F.array(seat("bucket", 0)))
    rows = rows.select("doc_id", "packed", "digest", F.explode(seats).alias("seat")).select("doc_id", "packed", "digest", "seat.bucket", "seat.tail")
    return rows.repartition(width, "bucket").sortWithinPartitions(*order).mapInArrow(_pairs(False), schema)
