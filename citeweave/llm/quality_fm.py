"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),
the sum-of-squares identity, so that all pairwise interactions cost one pass over the
features. Features of a document: its distinct lower-cased words hashed into ``WORDS``
buckets, weighted by log counts of unit length; shares of character classes, repetition and
line statistics of the whole text; and its length (metadata). Labels, language, source and
the document's id are never features.

Training: at most ``TRAIN_LIMIT`` labelled documents (those with the smallest hash of their
id, so the choice does not depend on the layout), none of the held-out fold, fitted by
AdaGrad on the driver; the model's size is fixed. Where ids repeat with different texts, the
limit holds for the texts, and repeated rows count once. Scoring reads every text whole, in a task
of its own, without a shuffle.

Null and empty texts are scored as texts without words. Without any usable label the model
keeps every document (score 0.5). Labels that are null, or contradict each other for one
document, count as none and as each of them. Repeated rows get equal scores; an empty table
gives an empty result; columns named score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import bounded_batches, lean, text_chunks, word_hashes

WORDS = 1 << 13
RANK = 6
#: Labelled documents that the model is fitted on, at most.
TRAIN_LIMIT = 8000
EPOCHS = 12
SEED = 5

_CLASS = np.full(256, 7, dtype=np.uint8)  # other punctuation
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"-()", b"|")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8
N_CLASSES = 9
STATS = N_CLASSES + 9


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the words, rows ascending, and the statistics, of the rows that ``offsets`` cut from ``buf``."""
    n_rows = len(offsets) - 1
    words, first = word_hashes(buf, offsets)
    n_words = np.diff(first)
    row_of = np.repeat(np.arange(n_rows, dtype=np.uint64), n_words)
    keys = np.sort((row_of << np.uint64(40)) | (words >> np.uint64(24)))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    row = (keys >> np.uint64(40)).astype(np.int64)
    bucket = (keys & np.uint64(WORDS - 1)).astype(np.int64)
    weight = np.log1p(counts)
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=n_rows))
    weight = weight / np.maximum(norm, 1e-9)[row]

    sizes = np.diff(offsets)
    classes = _CLASS[buf]
    stats = np.zeros((n_rows, STATS))
    nonempty = np.flatnonzero(sizes)
    for k in range(N_CLASSES if len(nonempty) else 0):
        hits = (classes == k).astype(np.uint8)
        stats[nonempty, k] = np.add.reduceat(hits, offsets[:-1][nonempty], dtype=np.int64)
    lines = stats[:, 4] + 1
    distinct = np.bincount(row, minlength=n_rows)
    repeats = np.bincount(row, (counts > 2) * counts, minlength=n_rows)
    top = np.zeros(n_rows)
    np.maximum.at(top, row, counts)
    inside = row_of[:-1] == row_of[1:]
    pairs = (words[:-1] * np.uint64(3) + words[1:])[inside]
    pair_keys = np.unique((row_of[:-1][inside] << np.uint64(40)) | (pairs >> np.uint64(24)))
    n_pairs = np.bincount((pair_keys >> np.uint64(40)).astype(np.int64), minlength=n_rows)
    least = np.maximum(n_words, 1)
    shares = stats[:, :N_CLASSES] / np.maximum(sizes, 1)[:, None]
    own = np.stack(
        [np.log1p(sizes), np.log1p(n_words), sizes / least, distinct / least, repeats / least, top / least, n_pairs / least, np.log1p(n_words / lines), (shares[:, 5] + shares[:, 6] + shares[:, 7]) * sizes / least],
        axis=1,
    )
    return row, bucket, weight, np.concatenate([shares, own], axis=1)


def _margin(model: Model, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, stats: np.ndarray) -> np.ndarray:
    x = np.clip((stats - model.mean) / model.scale, -4, 4)
    n = len(stats)
    out = model.w0 + np.bincount(row, model.w[bucket] * weight, minlength=n) + x @ model.w[WORDS:]
    for f in range(model.v.shape[1]):
        v = model.v[:, f]
        each = v[bucket] * weight
        total = np.bincount(row, each, minlength=n) + x @ v[WORDS:]
        squares = np.bincount(row, each * each, minlength=n) + (x * x) @ (v[WORDS:] ** 2)
        out += 0.5 * (total * total - squares)
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """rows: (buckets, weights, statistics) of each document."""
    stats = np.array([s for _, _, s in rows]).reshape(len(rows), STATS)
    rng = np.random.Generator(np.random.PCG64(SEED))
    model = Model(0.0, np.zeros(WORDS + STATS), rng.normal(0, 0.02, (WORDS + STATS, RANK)), np.zeros(STATS), np.ones(STATS))
    if not len(rows) or labels.min() == labels.max():
        if len(rows):
            model.w0 = 2.0 if labels.max() else -2.0
        model.v[:] = 0
        return model
    model.mean, model.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    x = np.clip((stats - model.mean) / model.scale, -4, 4)
    prior = labels.mean()
    model.w0 = float(np.log(prior / (1 - prior)))
    g0, gw, gv = 1e-6, np.full(WORDS + STATS, 1e-6), np.full((WORDS + STATS, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 64):
            pick = order[start : start + 64]
            sizes = [len(rows[i][0]) for i in pick]
            row = np.repeat(np.arange(len(pick)), sizes)
            bucket = np.concatenate([rows[i][0] for i in pick])
            weight = np.concatenate([rows[i][1] for i in pick])
            xs = x[pick]
            idx = np.concatenate([bucket, np.tile(np.arange(WORDS, WORDS + STATS), len(pick))])
            val = np.concatenate([weight, xs.ravel()])
            of = np.concatenate([row, np.repeat(np.arange(len(pick)), STATS)])
            vx = model.v[idx] * val[:, None]
            total = np.zeros((len(pick), RANK))
            np.add.at(total, of, vx)
            squares = np.zeros((len(pick), RANK))
            np.add.at(squares, of, vx * vx)
            z = model.w0 + np.bincount(of, model.w[idx] * val, minlength=len(pick)) + 0.5 * (total**2 - squares).sum(1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            gain = err[of] * val
            dw = np.bincount(idx, gain, minlength=WORDS + STATS) + 1e-5 * model.w
            dv = np.zeros_like(model.v)
            np.add.at(dv, idx, gain[:, None] * (total[of] - vx))
            dv += 1e-4 * model.v
            d0 = float(err.sum())
            g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
            model.w0 -= 0.1 * d0 / g0**0.5
            model.w -= 0.1 * dw / np.sqrt(gw)
            model.v -= 0.05 * dv / np.sqrt(gv)
    return model


def held_out(doc_id: Column) -> Column:
    """The fold that the model never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@lean
def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        idx, val, stat = [], [], []
        for _, _, buf, offsets in text_chunks(batch.column("text")):
            row, bucket, weight, stats = features(buf, offsets)
            cuts = np.searchsorted(row, np.arange(len(stats) + 1))
            for k in range(len(stats)):
                part = slice(cuts[k], cuts[k + 1])
                idx.append(bucket[part].astype(np.uint16).tobytes())
                val.append(weight[part].astype(np.float32).tobytes())
                stat.append(stats[k].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(idx, pa.binary()), pa.array(val, pa.binary()), pa.array(stat, pa.binary())], names=["doc_id", "quality", "idx", "val", "stat"])


def train(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_LIMIT) -> Model:
    """Fit on at most ``limit`` labelled documents outside the held-out fold."""
    bounded_batches(documents.sparkSession)
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.distinct().orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "quality").limit(limit)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``limit`` pairs of numbers
    kind = documents.schema["doc_id"].dataType.simpleString()
    made = rows.select("doc_id", "quality", "text").mapInArrow(_feature_rows, f"doc_id {kind}, quality int, idx binary, val binary, stat binary")
    # Rows that repeat count once; of ids with many texts, the first in an order of the rows themselves are taken.
    once = made.distinct().orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "quality", "stat", "idx", "val")
    found = once.limit(limit).collect()
    found.sort(key=lambda r: (str(r.doc_id), r.quality, bytes(r.stat)))
    parts = [(np.frombuffer(r.idx, np.uint16).astype(np.int64), np.frombuffer(r.val, np.float32).astype(np.float64), np.frombuffer(r.stat, np.float64)) for r in found]
    return fit(parts, np.array([r.quality for r in found], dtype=np.float64))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` with score (0 to 1) and predicted (0 or 1)."""
    bounded_batches(documents.sparkSession)
    names = [c for c in documents.columns if c not in ("score", "predicted")]
    source = documents.select(*names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields] + ["score double, predicted int"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for _, _, buf, offsets in text_chunks(batch.column("text")):
                z = _margin(model, *features(buf, offsets))
                parts.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            s = np.concatenate(parts)
            columns = [*(batch.column(c) for c in names), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted"])

    return source.mapInArrow(run, schema)
