"""Best-fit packing: Martello-Toth dominance reduction, then best-fit decreasing.

Documents become token ids; those longer than a sequence are cut so that all pieces but the
first are full. Packing depends on lengths alone, and there are at most ``capacity`` of them,
so the whole instance is a histogram, of bounded size at any number of documents. On it

1. the dominance criterion of Martello and Toth fixes sets of at most three pieces that
   provably dominate every other set with their first piece (a piece that fits with no
   other, two that fill a sequence exactly, ...), many equal sets at once, until nothing
   more can be fixed;
2. best-fit decreasing packs the rest, again many equal sequences at once.

The plan is a list of runs "pieces number a to b of this length go to sequences number c and
on, so many in each, from this offset", and each piece finds its run by its number among the
pieces of its length. Numbers come from counts per (bucket of documents, length) and a row
number inside a bucket, so no length, however common, meets in one task.

Ids are those of ``tokenizers`` with the tokenizer's own handling of special tokens: a text
that holds the string of one gets its id.

Null text counts as empty: its document is the end id alone. Rows that repeat a doc_id are
separate documents; columns of the input other than doc_id and text are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citeweave.llm.common import bounded_batches, lean, materialize, text_array

CAPACITY = 1024
END_ID = 2
DOCS_PER_BUCKET = 4096

# ------------------------------------------------------------------ ids

#: Letters that every version of Unicode calls letters.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: How byte-level tokenizers part a text, for texts of ASCII and these letters.
_PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \t\n\r\f\v0-9{_LETTERS}]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+")
_OTHER = rf"[^\t\n\r\f\v -~{_LETTERS}]"
#: A single space between two characters that are not white space always begins a part.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE_CHARS = str.maketrans({chr(b): chr(b if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else 256 + b if b < 33 else 162 + b if b < 161 else 323) for b in range(256)})
#: Parts whose ids a worker remembers, at most, and their longest length.
KNOWN, KNOWN_CHARS = 200_000, 64


class Encoder:
    """Ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, little-endian.

    A byte-level tokenizer without a normalizer merges inside parts of a text only, and parts
    repeat; so the tokenizer's model is asked once per part, and remembered. What is not
    plainly parted (other alphabets, special tokens) goes through the tokenizer whole, word by
    word. Tokenizers of other kinds are given each text whole.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        first = said.get("pre_tokenizer") or {}
        added = said.get("added_tokens") or []
        self.parted = (
            said.get("normalizer") is None
            and first.get("type") == "ByteLevel"
            and not first.get("add_prefix_space", True)
            and first.get("use_regex", True)
            and said["model"].get("type") == "BPE"
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        )
        self.odd = re.compile("|".join([_OTHER, *(re.escape(t["content"]) for t in added)]))

    def _part(self, part: str) -> bytes:
        if part in self.known:
            return self.known[part]
        if self.odd.search(part):
            ids = self.whole.encode(part, add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_BYTE_CHARS))]
        found = np.array(ids, dtype="<u4").tobytes()
        if len(part) <= KNOWN_CHARS:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[part] = found
        return found

    def parts(self, text: str) -> list[str]:
        if not self.odd.search(text):
            return _PARTS.findall(text)
        found: list[str] = []
        plain: list[str] = []
        for k, word in enumerate(_CUT.split(text)):
            word = f" {word}" if k else word
            if self.odd.search(word):
                found += [*_PARTS.findall("".join(plain)), word]
                plain.clear()
            else:
                plain.append(word)
        return found + _PARTS.findall("".join(plain))

    def __call__(self, text: str) -> np.ndarray:
        if not self.parted:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        parts = self.parts(text)
        try:
            ids = b"".join([self.known[p] for p in parts])
        except KeyError:
            ids = b"".join([self._part(p) for p in parts])
        return np.frombuffer(ids, dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """Kept for a worker's later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but, if need be, the first."""
    first = n % capacity or capacity
    edges = [0, *range(min(first, n), n + 1, capacity)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _pieces(path: str, capacity: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids_of = batch.column("doc_id")
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(text_array(batch.column("text")).to_pylist()):
                ids = np.append(encode(text), np.uint32(END_ID))
                for k, (a, n) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[a : a + n].tobytes()))
            columns = [ids_of.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


# ------------------------------------------------------------------ the plan over a histogram


def _take(left: np.ndarray, size: int, n: int, runs: list, taken: dict, first_bin: int, each: int, offset: int) -> None:
    """Pieces of ``size``: the next n go to sequences from first_bin, ``each`` per sequence, from ``offset`` on."""
    runs.append((size, taken[size], n, first_bin, each, offset))
    taken[size] += n
    left[size] -= n


def _dominant(left: np.ndarray, w: int, capacity: int) -> tuple[int, ...] | None:
    """Sizes of pieces which together with one of size w dominate every other set that holds it, or None."""
    room = capacity - w
    rest = left.copy()
    rest[w] -= 1
    sizes = np.flatnonzero(rest)
    if not len(sizes) or sizes[0] > room:
        return ()
    if rest[room] > 0:
        return (room,)
    fitting = sizes[sizes <= room]
    best = int(fitting[-1])
    smallest: list[int] = []
    for s in sizes[:3]:
        smallest += [int(s)] * min(3, int(rest[s]))
    smallest = smallest[:3]
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:  # one more piece at most
        return (best,)
    if len(smallest) > 2 and sum(smallest) <= room:  # three or more fit: no rule
        return None

    def partner(y: int) -> int:
        """Largest x >= y with x + y <= room, another piece; 0 if none."""
        x = fitting[(fitting <= room - y) & (fitting >= y)]
        if len(x) and x[-1] == y and rest[y] < 2:
            x = x[:-1]
        return int(x[-1]) if len(x) else 0

    pairs = [(x, int(y)) for y in fitting if (x := partner(int(y)))]
    if not pairs:
        return (best,)
    if max(x + y for x, y in pairs) <= best:  # the best single piece is worth any pair
        return (best,)
    partner_of_best = [y for x, y in pairs if x == best]
    if partner_of_best:
        second = max(partner_of_best)
        if all(y <= second or x + y <= best for x, y in pairs):
            return (best, second)
    return None


def reduce_instance(left: np.ndarray, capacity: int, runs: list, taken: dict, next_bin: int) -> int:
    """Fix dominating sets until none is found; returns the next free sequence number."""
    changed = True
    while changed:
        changed = False
        for w in range(capacity, 0, -1):
            while left[w] > 0 and (found := _dominant(left, w, capacity)) is not None:
                need: dict[int, int] = defaultdict(int)
                for s in (w, *found):
                    need[s] += 1
                alone = not found
                n = int(left[w]) if alone and w * 2 > capacity else min(int(left[s]) // k for s, k in need.items())
                offset = 0
                for s in (w, *found):
                    _take(left, s, n, runs, taken, next_bin, 1, offset)
                    offset += s
                next_bin += n
                changed = True
    return next_bin


def best_fit_decreasing(left: np.ndarray, capacity: int, runs: list, taken: dict, next_bin: int) -> int:
    """Pack what is left; open sequences are kept as ranges by the room they have."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for w in range(capacity, 0, -1):
        for r in range(w, capacity):
            each = r // w
            while left[w] > 0 and room[r]:
                first, n = room[r].pop()
                full = min(n, int(left[w]) // each)
                if full:
                    _take(left, w, full * each, runs, taken, first, each, capacity - r)
                    room[r - each * w].append((first, full))
                if full < n:
                    some = int(left[w])
                    if some and some < each:
                        _take(left, w, some, runs, taken, first + full, some, capacity - r)
                        room[r - some * w].append((first + full, 1))
                        full += 1
                    if full < n:
                        room[r].append((first + full, n - full))
                        if not left[w]:
                            break
        each = capacity // w
        full, some = divmod(int(left[w]), each)
        if full:
            _take(left, w, full * each, runs, taken, next_bin, each, 0)
            room[capacity - each * w].append((next_bin, full))
            next_bin += full
        if some:
            _take(left, w, some, runs, taken, next_bin, some, 0)
            room[capacity - some * w].append((next_bin, 1))
            next_bin += 1
    return next_bin


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int, int]:
    """(runs, sequences, sequences fixed by the reduction) for ``counts`` pieces of each length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] = n
    runs: list[tuple] = []
    taken: dict[int, int] = defaultdict(int)
    fixed = reduce_instance(left, capacity, runs, taken, 0)
    return runs, best_fit_decreasing(left, capacity, runs, taken, fixed), fixed


# ------------------------------------------------------------------ operator


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    spark = documents.sparkSession
    bounded_batches(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    cut_up = documents.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = materialize(cut_up, "pack-pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs, _, _ = plan(counts, capacity)
    n_buckets = max(1, -(-sum(counts.values()) // DOCS_PER_BUCKET))

    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)))
    per_bucket = pieces.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    # The buckets of one length, in hash ranges, so that a common length is not one task's.
    span = max(1, int(n_buckets**0.5))
    per_bucket = materialize(per_bucket.withColumn("range", F.floor(F.col("bucket") / span).cast("long")), "pack-counts")
    per_range = per_bucket.groupBy("length", "range").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.select("length", "range", F.coalesce(F.sum("n").over(before("length").orderBy("range")), F.lit(0)).alias("range_base"))
    inside = F.coalesce(F.sum("n").over(before("length", "range").orderBy("bucket")), F.lit(0))
    bases = per_bucket.select("length", "range", "bucket", inside.alias("inside")).join(per_range, ["length", "range"])
    bases = bases.select("bucket", "length", (F.col("inside") + F.col("range_base")).alias("base"))

    in_bucket = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("number", F.row_number().over(in_bucket).cast("long") - 1).join(bases, ["bucket", "length"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("base"))

    by_size: dict[int, list[tuple]] = defaultdict(list)
    for size, first, n, bin_, each, offset in runs:
        by_size[size].append((first, n, bin_, each, offset))
    table = [(size, [(int(a), int(a + n), int(b), int(e), int(o)) for a, n, b, e, o in sorted(v)]) for size, v in by_size.items()]
    run_type = "array<struct<first:bigint,stop:bigint,bin:bigint,each:bigint,at:bigint>>"
    plans = spark.createDataFrame(table, f"length long, runs {run_type}")  # at most ``capacity`` rows
    placed = numbered.join(F.broadcast(plans), "length")
    run = F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("number")) & (F.col("number") < r["stop"])), 1)
    placed = placed.withColumn("run", run).withColumn("step", F.col("number") - F.col("run.first"))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("run.bin") + F.floor(F.col("step") / F.col("run.each")).cast("long")).alias("sequence_id"),
        (F.col("run.at") + F.col("step") % F.col("run.each") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(documents: DataFrame, packed: DataFrame, tokenizer: str) -> DataFrame:
    """sequence_id, ids array<int>: the packed sequences themselves; doc_id must be unique for this."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            whole = [np.append(encode(t), np.uint32(END_ID)) for t in text_array(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    ids = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")
    cut_ids = F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    parts = packed.join(ids, "doc_id").select("sequence_id", F.struct("offset", cut_ids.alias("ids")).alias("part"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["ids"])).alias("ids"))
