"""N-gram Jaccard join: sets of word shingles in prefix trees, joined at a similarity of 0.8.

A document's set holds its distinct shingles of five lower-cased words (with fewer words,
the whole sequence as one). The join finds exactly the pairs of sets whose Jaccard
similarity reaches the threshold, and reports them as connected components. Shingles are
64-bit hashes, sets are compared by 128-bit hashes and their sizes.

1. ``signatures``: one pass computes each document's set hash and, per task, the shingles
   that many of its documents share. Their sums give the most frequent shingles (a bounded
   table), which come last in the global order of shingles; the rest come by hash.
2. ``candidates``: in the first 25% of either in that order, two sets that reach the threshold
   share a shingle, and if they are large, at least a twentieth of their sizes. Each shingle's
   sets of close sizes meet at a reducer; sets with fewer such shingles than any link needs
   are dropped, twice; the sets that are left are joined where they follow each other in
   (shingle, size) order. Only spanning edges leave a task, so a shingle or a group of
   copies, however large, adds rows in proportion to its sets and never pairs. Components
   of these edges are the candidate clusters: no pair that reaches the threshold crosses two
   of them.
3. ``refined``: inside large clusters the order is made anew, from the exact number of their
   sets that hold each shingle, which parts texts that merely share a passage.
4. ``links``: each cluster's sets come together once, and every link is found by a trie: sets,
   their shingles in the global order, share the nodes of equal beginnings; a query walks it
   level by level with its partial overlaps and leaves a subtree when the shingles that
   remain cannot reach the threshold, or when all sets below are connected with it already.
   A cluster that is too large for one task is dealt over blocks by hash. First each block is
   joined, together with a few sets of the whole cluster that all its blocks get; the sets
   that are then outside the cluster's largest component, usually few or none, are asked of
   the tries of all blocks. So a group of near copies costs in proportion to its sets; only
   sets that shared a candidate cluster without being linked meet block by block.

Texts are read from the input again where they are needed. Only those of clustered sets
move, found by a filter of fixed size, so the bulk of the corpus is never shuffled.

Null and empty texts have empty sets, linked with nothing. Rows that repeat a doc_id are
separate documents that share an id. Documents with a null id take part in no link and have
a null component. An empty table gives an empty result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import bounded_batches, lean, materialize, mix, text_chunks, word_hashes
from citeweave.llm.components import components

WORDS = 5
PERCENT = 80
#: Shingles at the end of the global order, at most (the bound of what is broadcast).
FREQUENT = 1 << 20
#: Documents of one task that must share a shingle before the task reports it.
LOCAL_LEAST = 2
#: Clusters with more shingles are refined.
REFINE_SHINGLES = 100_000
#: Bits of the filter of clustered sets, at most (the bound of what is broadcast).
FILTER_BITS = 1 << 27
#: What is joined in one trie: its shingles and SET_COST for each set, at most (but for one larger set).
UNIT_COST = 64_000
SET_COST = 600
#: Sets of a cluster that all its blocks get in the first round.
HUBS = 4
#: Shingles of a node that a search looks at between two looks at its bounds.
STEP = 64
TOKENS_PER_BUCKET = 800_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    if not len(words):
        return words
    if len(words) < n:
        total = np.array([len(words)], dtype=np.uint64)
        for w in words:
            total = mix(total * _MULTIPLIERS[0] + w)
        return total
    last = len(words) - n + 1
    total = words[:last] * _MULTIPLIERS[0]
    for k in range(1, n):
        total = total + words[k : last + k] * (_MULTIPLIERS[k % 5] + np.uint64(2 * (k // 5)))
    return np.unique(mix(total))


def sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for i, j, buf, offsets in text_chunks(column):
        words, first = word_hashes(buf, offsets)
        for k in range(j - i):
            yield i + k, shingles(words[first[k] : first[k + 1]])


def set_hash(items: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone, as two signed numbers."""
    both = (np.add.reduce(mix(items)), np.add.reduce(mix(items ^ np.uint64(0x5851F42D4C957F2D))))
    both = mix(np.array(both, dtype=np.uint64) + np.uint64(len(items)))
    return tuple(int(x) for x in both.view(np.int64))


def least_overlap(n, percent: int = PERCENT):
    """What a set of n shares at least with any set that reaches the threshold."""
    return -(-n * percent // 100)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - least_overlap(n, percent) + 1


# ------------------------------------------------------------------ 1. signatures


class _FrequentHere:
    """Shingles that many documents of a task share; bounded by dropping rare ones now and then."""

    def __init__(self, least: int):
        self.least = least
        self.held: list[np.ndarray] = []
        self.size = 0
        self.items, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, items: np.ndarray) -> None:
        self.held.append(items)
        self.size += len(items)
        if self.size > 1_500_000:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        items, counts = np.unique(np.concatenate(self.held), return_counts=True)
        enough = counts >= self.least
        items, at = np.unique(np.concatenate([self.items, items[enough]]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, counts[enough]]), minlength=len(items)).astype(np.int64)
        self.items, self.held, self.size = items, [], 0


def _signatures(least: int):
    names = ["doc_id", "n", "s1", "s2", "shingle", "count"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = _FrequentHere(least)
        seen: set[int] = set()
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column("doc_id").type
            rows = []
            for _, items in sets_of(batch.column("text")):
                rows.append((len(items), *set_hash(items)))
                if rows[-1][1] not in seen:  # copies of a set count once
                    seen.add(rows[-1][1])
                    here.add(items)
            if len(seen) > 1_000_000:
                seen.clear()
            n, s1, s2 = (pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ())))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, s1, s2, none, none], names=names)
        here.settle()
        k = len(here.items)
        blank = pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), blank, blank, blank, pa.array(here.items.view(np.int64)), pa.array(here.counts)], names=names)

    return run


# ------------------------------------------------------------------ 2. candidates


class Order:
    """The global order: shingles outside the table by hash, then those of the table by frequency."""

    def __init__(self, items: np.ndarray, counts: np.ndarray):
        items = items.view(np.uint64)
        by_rank = np.lexsort((items, counts))
        rank = np.empty(len(items), dtype=np.int32)
        rank[by_rank] = np.arange(len(items))
        at = np.argsort(items)
        self.items, self.rank = items[at], rank[at]

    def arranged(self, items: np.ndarray) -> np.ndarray:
        """The places of sorted ``items`` in the global order."""
        if not len(self.items):
            return np.arange(len(items))
        at = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1)
        frequent = self.items[at] == items
        late = np.flatnonzero(frequent)
        return np.concatenate([np.flatnonzero(~frequent), late[np.argsort(self.rank[at[late]])]])

    def prefix(self, items: np.ndarray, length: int) -> np.ndarray:
        if not len(self.items):
            return items[:length]
        at = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1)
        frequent = self.items[at] == items
        rare = items[~frequent]
        if len(rare) >= length:
            return rare[:length]
        late = items[frequent][np.argsort(self.rank[at[frequent]])]
        return np.concatenate([rare, late[: length - len(rare)]])


class Forest:
    """Union-find over signed 64-bit names."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (parent := up.get(root, root)) != root:
            root = parent
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in list(self.up) if self.find(x) != x]
        return nodes, [self.find(x) for x in nodes]


def _join_neighbours(tokens: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, forest: Forest) -> None:
    """Join nodes that follow each other in (token, size) order with one token and sizes within the threshold."""
    at = np.lexsort((sizes, tokens))
    t, v, s = tokens[at], nodes[at], sizes[at]
    near = (t[1:] == t[:-1]) & (v[1:] != v[:-1]) & (s[1:] * PERCENT <= s[:-1] * 100)
    pairs = np.unique(np.stack([v[:-1][near], v[1:][near]], axis=1), axis=0) if near.any() else ()
    for a, b in pairs:
        forest.join(int(a), int(b))


def shared_least(n):
    """Shingles that the extended prefixes of a set of n and of any set that it links with share at least."""
    return np.maximum(1, n // 20)


def _prefixes(order, n_buckets: int, percent: int = PERCENT):
    """The extended prefix of each set, dealt by shingle: 48 bits of each shingle, and the place of its set in a table."""

    def flush(held: list) -> pa.RecordBatch:
        tokens = np.concatenate([x for x, _, _ in held])
        lengths = [len(x) for x, _, _ in held]
        table = np.array([v for _, v, _ in held], dtype=np.int64).tobytes()
        sizes = np.array([s for _, _, s in held], dtype=np.int32).tobytes()
        place = np.repeat(np.arange(len(held), dtype=np.uint16 if len(held) < 65536 else np.uint32), lengths)
        short = (tokens >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        bucket = (tokens >> np.uint64(16)) % np.uint64(n_buckets)
        at = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[at], np.arange(n_buckets + 1, dtype=np.uint64))
        rows = [(k, short[at[cuts[k] : cuts[k + 1]]].tobytes(), table, sizes, place[at[cuts[k] : cuts[k + 1]]].tobytes()) for k in np.flatnonzero(np.diff(cuts)).tolist()]
        return _blobs(rows)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = order.value
        held, size, seen = [], 0, set()
        for batch in batches:
            for _, items in sets_of(batch.column("text")):
                if not len(items):
                    continue
                node, n = set_hash(items)[0], len(items)
                if node in seen:
                    continue
                seen.add(node)
                held.append((ranks.prefix(items, prefix_length(n, percent) + int(shared_least(n)) - 1).copy(), node, n))
                size += len(held[-1][0])
                if size > TOKENS_PER_BUCKET:
                    yield flush(held)
                    held, size, seen = [], 0, set()
        if held:
            yield flush(held)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs of ``_prefixes`` with a set and a size for each shingle."""
    for batch in batches:
        rows = []
        for bucket, tokens, table, sizes, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = len(tokens) // 6
            wide = np.zeros((n, 8), dtype=np.uint8)
            wide[:, :6] = np.frombuffer(tokens, dtype=np.uint8).reshape(n, 6)
            at = np.frombuffer(place, dtype=np.uint16 if len(place) == 2 * n else np.uint32)
            rows.append((bucket, wide.tobytes(), np.frombuffer(table, dtype=np.int64)[at].tobytes(), np.frombuffer(sizes, dtype=np.int32)[at].tobytes(), b""))
        yield _blobs(rows)


def _with_partner(n_buckets: int, unpack: bool, percent: int = PERCENT):
    """Shingles of a set that a set of a close size holds too, dealt by set."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, nodes, sizes, _ in _by_bucket(_unpacked(batches) if unpack else batches):
            order = np.argsort(tokens, kind="stable")
            same = tokens[order][1:] == tokens[order][:-1]
            some = order[np.append(False, same) | np.append(same, False)]
            some = some[np.lexsort((nodes[some], sizes[some], tokens[some]))]
            t, v, s = tokens[some], nodes[some], sizes[some]
            new = np.append(True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])) if len(t) else np.zeros(0, dtype=bool)
            t, v, s = t[new], v[new], s[new]
            near = (t[1:] == t[:-1]) & (s[1:].astype(np.int64) * percent <= s[:-1].astype(np.int64) * 100)
            keep = np.append(False, near) | np.append(near, False) if len(t) else new
            if keep.any():
                yield _blobs([(*row, b"") for row in _deal(v[keep], n_buckets, t[keep], v[keep], s[keep])])

    return run


def _with_enough(n_buckets: int, percent: int = PERCENT):
    """Sets that share as many shingles of their prefix as any link of theirs needs, dealt by shingle."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, nodes, sizes, _ in _by_bucket(batches):
            at = np.argsort(nodes, kind="stable")
            t, v, s = tokens[at], nodes[at], sizes[at]
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            many = np.diff(np.append(first, len(v)))
            keep = np.repeat(many >= shared_least(least_overlap(s[first].astype(np.int64), percent)), many)
            if keep.any():
                yield _blobs([(*row, b"") for row in _deal(t[keep], n_buckets, t[keep], v[keep], s[keep])])

    return run


@lean
def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges between sets that follow each other in (shingle, size) order with close sizes."""
    forest = Forest()
    for tokens, nodes, sizes, _ in _by_bucket(batches):
        _join_neighbours(tokens, nodes, sizes.astype(np.int64), forest)
    u, v = forest.edges()
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _edge_batch(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


_BLOBS = "bucket int, tokens binary, nodes binary, sizes binary, counts binary"


def _dealt(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "bucket").sortWithinPartitions("bucket")


def global_order(signatures: DataFrame):
    """A broadcast of the order of shingles (at most FREQUENT of them are in its table)."""
    spark = signatures.sparkSession
    counted = signatures.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()  # bounded by FREQUENT
    return spark.sparkContext.broadcast(Order(top.column("shingle").to_numpy().copy(), top.column("n").to_numpy().copy()))


def candidates(documents: DataFrame, signatures: DataFrame, order) -> DataFrame:
    """u, v: set hashes and the least set hash of their candidate cluster; sets alone in theirs have no row."""
    total = signatures.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    n = int(total // TOKENS_PER_BUCKET) + 12
    rows, unpack = documents.select("text").mapInArrow(_prefixes(order, n), _BLOBS), True
    for _ in range(2):  # sets that drop out may leave others without partners
        partners = _dealt(rows, n).mapInArrow(_with_partner(n, unpack), _BLOBS)
        rows, unpack = _dealt(partners, n).mapInArrow(_with_enough(n), _BLOBS), False
    return components(_dealt(rows, n).mapInArrow(_edges, "u long, v long"), "trie-candidates")


# ------------------------------------------------------------------ 3. links


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start as many as its length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Trie:
    """A path-compressed prefix tree over sorted arrays of ranks in the global order.

    Sets lie in the order of their arrays; a node is a range of them with a common beginning.
    Arrays hold the shingles that at least two sets have; ``sizes`` count all.
    """

    def __init__(self, arrays: list[np.ndarray], sizes: np.ndarray):
        keys = [a.astype(">u4").tobytes() for a in arrays]
        self.order = np.array(sorted(range(len(arrays)), key=keys.__getitem__), dtype=np.int64)
        arrays = [arrays[k] for k in self.order]
        self.sizes = sizes[self.order]
        lengths = np.array([len(a) for a in arrays], dtype=np.int64)
        self.flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
        self.starts = np.cumsum(lengths) - lengths
        nodes: list[tuple[int, int, int]] = []  # first and last set, depth
        below: list[list[int]] = []
        stack: list[tuple[int, int, list[int]]] = []  # depth, first, children
        for i, a in enumerate(arrays):  # nodes from common beginnings, bottom-up as for an LCP-interval tree
            nodes.append((i, i, len(a)))
            below.append([])
            child, first, after = len(nodes) - 1, i, -1
            if i + 1 < len(arrays):
                b = arrays[i + 1]
                n = min(len(a), len(b))
                differ = a[:n] != b[:n]
                after = int(np.argmax(differ)) if differ.any() else n
            while stack and stack[-1][0] > after:
                depth, first, children = stack.pop()
                children.append(child)
                nodes.append((first, i, depth))
                below.append(children)
                child = len(nodes) - 1
            if after >= 0:
                if stack and stack[-1][0] == after:
                    stack[-1][2].append(child)
                else:
                    stack.append((after, first, [child]))
        self.root = child if arrays else -1
        self.first, self.last, self.end = (np.array(c, dtype=np.int64) for c in (zip(*nodes, strict=True) if nodes else ((), (), ())))
        self.n_below = np.array([len(c) for c in below], dtype=np.int64)
        self.below_at = np.cumsum(self.n_below) - self.n_below
        self.below = np.array([c for children in below for c in children], dtype=np.int64)
        spans = np.stack([self.first, self.last + 1], axis=1).ravel() if nodes else np.zeros(0, dtype=np.int64)

        def over(f: np.ufunc, values: np.ndarray) -> np.ndarray:  # of each node's sets
            return f.reduceat(np.append(values, values[-1:]), spans)[::2] if len(spans) else spans

        self.small, self.large, self.longest = over(np.minimum, self.sizes), over(np.maximum, self.sizes), over(np.maximum, lengths)

    def search(self, items: np.ndarray, size: int, mark: np.ndarray, percent: int, settled: np.ndarray) -> np.ndarray:
        """Places of sets that reach the threshold with the query (``items`` sorted, marked in ``mark``).

        ``settled[k]`` counts the sets before place k that need no answer.
        """
        if self.root < 0:
            return np.zeros(0, dtype=np.int64)
        node, depth, overlap = np.array([self.root]), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        least = least_overlap(size, percent)
        found = []
        while len(node):
            first, last = self.first[node], self.last[node]
            open_ = (self.small[node] * percent <= 100 * size) & (self.large[node] * 100 >= percent * size) & (settled[last + 1] - settled[first] <= last - first)
            node, depth, overlap = node[open_], depth[open_], overlap[open_]
            if not len(node):
                break
            start = self.starts[self.first[node]]
            stop = np.minimum(self.end[node], depth + STEP)
            shared = np.concatenate([[0], np.cumsum(mark[self.flat[_ranges(start + depth, stop - depth)]])])
            ends = np.cumsum(stop - depth)
            overlap = overlap + shared[ends] - shared[ends - stop + depth]
            depth = stop
            rest = len(items) - np.where(depth > 0, np.searchsorted(items, self.flat[np.maximum(start + depth - 1, 0)] if len(self.flat) else 0, side="right"), 0)
            need = -(-percent * (size + np.maximum(self.small[node], least)) // (100 + percent))
            near = overlap + np.minimum(rest, self.longest[node] - depth) >= need
            node, depth, overlap = node[near], depth[near], overlap[near]
            whole = depth == self.end[node]
            leaf = whole & (self.n_below[node] == 0)
            place = self.first[node[leaf]]
            found.append(place[overlap[leaf] * (100 + percent) >= percent * (size + self.sizes[place])])
            parent = whole & ~leaf
            n = self.n_below[node[parent]]
            children = self.below[_ranges(self.below_at[node[parent]], n)]
            node, depth, overlap = (np.concatenate([x[~whole], y]) for x, y in ((node, children), (depth, np.repeat(depth[parent], n)), (overlap, np.repeat(overlap[parent], n))))
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def join_sets(sets: list[np.ndarray], order: Order, percent: int = PERCENT, queries: int = 0, labels: np.ndarray | None = None) -> np.ndarray:
    """For each set the first set of its component, under links between sets that reach the threshold.

    The last ``queries`` sets are asked of the others, but not of each other. Sets of equal
    ``labels`` are connected beforehand.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    items, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    arranged = order.arranged(items)
    arranged = arranged[counts[arranged] > 1]  # what one set holds matches nothing
    rank = np.full(len(items), -1, dtype=np.int64)
    rank[arranged] = np.arange(len(arranged))
    ranks = rank[at]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    arrays = []
    for k in range(m):
        own = ranks[starts[k] : starts[k + 1]]
        arrays.append(np.sort(own[own >= 0]))
    trie = Trie(arrays[: m - queries], sizes[: m - queries])
    mark = np.zeros(max(1, len(arranged)), dtype=bool)

    label = np.arange(m)
    if labels is not None:
        _, first_of, which = np.unique(labels, return_index=True, return_inverse=True)
        label = first_of[which]
    asked = np.zeros(m, dtype=bool)
    if queries:
        asked[: m - queries] = True
    by_size = np.argsort(sizes, kind="stable")
    turn = np.concatenate([by_size[m // 2 :], by_size[: m // 2]])  # a set of middle size is connected with most copies
    while True:
        # A pair of two components has one side outside the largest one, and that side is asked.
        largest = -1 if queries else int(np.argmax(np.bincount(label, minlength=m)))
        left = turn[(~asked & (label != largest))[turn]]
        if not len(left):
            return label
        _ask(trie, int(left[0]), arrays, sizes, mark, percent, label, asked)


def _ask(trie: Trie, k: int, arrays: list[np.ndarray], sizes: np.ndarray, mark: np.ndarray, percent: int, label: np.ndarray, asked: np.ndarray) -> None:
    """Ask the trie for the sets that link with set k, and connect them with it in ``label``."""
    settled = np.concatenate([[0], np.cumsum(label[trie.order] == label[k])])
    mark[arrays[k]] = True
    for p in trie.search(arrays[k], int(sizes[k]), mark, percent, settled):
        a, b = int(label[k]), int(label[trie.order[p]])
        if a != b:
            label[label == max(a, b)] = min(a, b)
    mark[arrays[k]] = False
    asked[k] = True


def _links(order, percent: int):
    """Edges between sets of a unit: those of role 0 among each other, and with those of role 1."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, tuple[int, int]], tuple[np.ndarray, int]] = {}
        now = None
        out: list[tuple[int, int]] = []

        def settle() -> None:
            keys = sorted(held)
            queries = sum(role for role, _ in keys)
            if len(keys) > max(1, queries):
                labels = np.array([held[x][1] for x in keys], dtype=np.int64)
                for k, r in enumerate(join_sets([held[x][0] for x in keys], order.value, percent, queries, labels).tolist()):
                    if r != k:
                        out.append((keys[k][1][0], keys[r][1][0]))
            held.clear()

        def drain() -> pa.RecordBatch:
            u, v = [a for a, _ in out], [b for _, b in out]
            out.clear()
            return _edge_batch(u, v)

        for batch in batches:
            units, roles, labels = (batch.column(c).to_pylist() for c in ("unit", "role", "label"))
            for k, items in sets_of(_unpack(batch)):
                if units[k] != now:
                    settle()
                    now = units[k]
                held[roles[k], set_hash(items)] = (items, labels[k])
            yield drain()
        settle()
        yield drain()

    return run


def _joined(units: DataFrame, order, percent: int) -> DataFrame:
    dealt = units.select("unit", "role", "label", "packed").repartition("unit").sortWithinPartitions("unit", "role")
    return dealt.mapInArrow(_links(order, percent), "u long, v long")


def links(texts: DataFrame, order, percent: int = PERCENT) -> DataFrame:
    """u, v: set hashes and the least set hash of their component, for sets (s1, n, cluster, packed) that are linked with another."""
    weights = texts.groupBy("cluster").agg(F.sum(F.col("n") + SET_COST).alias("cost"), *(F.min(F.struct(F.xxhash64(F.lit(h), "s1"), "s1"))["s1"].alias(f"hub{h}") for h in range(HUBS)))
    heavy = materialize(weights.where(F.col("cost") > UNIT_COST).withColumn("blocks", F.ceil(F.col("cost") / UNIT_COST).cast("long")), "trie-heavy")
    alone = texts.select("cluster", F.xxhash64("cluster").alias("unit"), F.lit(0).alias("role"), F.col("s1").alias("label"), "packed")
    if not heavy.limit(1).count():
        return materialize(_joined(alone, order, percent), "trie-links")

    large = texts.join(heavy, "cluster")
    block = F.pmod(F.xxhash64("s1"), "blocks")
    own = large.select("cluster", F.xxhash64("cluster", block).alias("unit"), F.lit(0).alias("role"), F.col("s1").alias("label"), "packed")
    is_hub = F.col("s1").isin(*(F.col(f"hub{h}") for h in range(HUBS)))
    hubs = large.where(is_hub).dropDuplicates(["cluster", "s1"])
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    sent = hubs.select("cluster", "s1", "packed", every.alias("block")).select("cluster", F.xxhash64("cluster", "block").alias("unit"), F.lit(0).alias("role"), F.col("s1").alias("label"), "packed")
    units = alone.join(heavy.select("cluster"), "cluster", "left_anti").unionByName(own).unionByName(sent)
    first = components(_joined(units, order, percent), "trie-links")

    # What the first round has left outside its cluster's largest component meets all blocks.
    root_of = first.select(F.col("u").alias("s1"), F.col("v").alias("label"))
    sets = large.select("cluster", "s1", "n", "blocks").dropDuplicates(["cluster", "s1"]).join(root_of, "s1", "left").withColumn("label", F.coalesce("label", "s1"))
    sets = materialize(sets, "trie-sets-left")
    main = sets.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max(F.struct("count", "label"))["label"].alias("main"))
    rest = sets.join(main, "cluster").where("label <> main").select("cluster", "s1", "n", "blocks", "label")
    rest = materialize(rest, "trie-rest")
    if not rest.limit(1).count():
        return first
    parts = materialize(rest.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") + SET_COST) / UNIT_COST).cast("long").alias("parts")), "trie-rest-parts")
    part = F.pmod(F.xxhash64("s1", F.lit(1)), "parts")
    bodies = texts.select("cluster", "s1", "packed").join(parts, "cluster").dropDuplicates(["cluster", "s1"]).join(sets.select("cluster", "s1", "label", "blocks"), ["cluster", "s1"])
    bodies = materialize(bodies.withColumns({"block": block, "part": part}), "trie-left")
    asked = bodies.join(rest.select("cluster", "s1"), ["cluster", "s1"], "left_semi").select("*", every.alias("_block"))
    asked = asked.select(F.xxhash64("cluster", "_block", "part").alias("unit"), F.lit(1).alias("role"), "label", "packed")
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    tries = bodies.select("*", every_part.alias("_part")).select(F.xxhash64("cluster", "block", "_part").alias("unit"), F.lit(0).alias("role"), "label", "packed")
    more = _joined(tries.unionByName(asked), order, percent)
    return components(first.unionByName(more), "trie-links")


# ------------------------------------------------------------------ texts of clustered sets


def _filter_bits(n_bits: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bits, dtype=bool)
        for batch in batches:
            bits[_places(batch.column("s1").to_numpy(zero_copy_only=False), n_bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    return run


def _places(nodes: np.ndarray, n_bits: int) -> np.ndarray:
    return (mix(nodes.astype(np.int64).view(np.uint64)) & np.uint64(n_bits - 1)).astype(np.int64)


def _clustered(filter_, n_bits: int):
    """Texts of sets that the filter holds, each set once per task, compressed."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_.value, dtype=np.uint8)
        pack = zstandard.ZstdCompressor(level=3).compress
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column("text")
            rows: list[tuple] = []
            for k, items in sets_of(texts):
                if len(items):
                    node = set_hash(items)[0]
                    place = int(_places(np.array([node]), n_bits)[0])
                    if bits[place >> 3] >> (7 - (place & 7)) & 1 and node not in seen:
                        seen.add(node)
                        rows.append((node, len(items), pack((texts[k].as_py() or "").encode("utf-8", "surrogatepass"))))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["s1", "n", "packed"])

    return run


def _unpack(batch: pa.RecordBatch) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x) for x in batch.column("packed").to_pylist()], pa.large_binary()).cast(pa.large_string())


def clustered_texts(documents: DataFrame, clusters: DataFrame) -> DataFrame:
    """s1, n, cluster, packed: the text of each set that shares its cluster with another (from each task that has it)."""
    spark = documents.sparkSession
    cluster_of = materialize(clusters.select(F.col("u").alias("s1"), F.col("v").alias("cluster")).unionByName(clusters.select(F.col("v").alias("s1"), F.col("v").alias("cluster")).distinct()), "trie-active")
    n_bits = min(FILTER_BITS, 1 << max(16, (16 * cluster_of.count()).bit_length()))
    parts = cluster_of.select("s1").coalesce(8).mapInArrow(_filter_bits(n_bits), "bits binary").collect()  # at most 8 of n_bits bits
    merged = np.zeros(n_bits // 8, dtype=np.uint8)
    for r in parts:
        merged |= np.frombuffer(r.bits, dtype=np.uint8)
    bits = spark.sparkContext.broadcast(merged.tobytes())
    found = documents.where("doc_id is not null").select("text").mapInArrow(_clustered(bits, n_bits), "s1 long, n long, packed binary")
    texts = materialize(found.join(cluster_of, "s1"), "trie-texts")
    bits.unpersist()
    return texts


# ------------------------------------------------------------------ 3. refined clusters


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "tokens", "nodes", "sizes", "counts"])


def _deal(key: np.ndarray, n_buckets: int, *arrays: np.ndarray) -> Iterator[tuple]:
    bucket = (key.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
    at = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[at], np.arange(n_buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        part = at[cuts[k] : cuts[k + 1]]
        yield (int(k), *(a[part].tobytes() for a in arrays))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (tokens, nodes, sizes, counts) of each bucket; buckets arrive in order."""
    held: list[tuple] = []
    now = None
    kinds = (np.uint64, np.int64, np.int32, np.int32)

    def whole() -> tuple[np.ndarray, ...]:
        return tuple(np.frombuffer(b"".join(parts), dtype=k) for parts, k in zip(zip(*held, strict=True), kinds, strict=True))

    for batch in batches:
        for bucket, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and held:
                yield whole()
                held = []
            now = bucket
            held.append(parts)
    if held:
        yield whole()


def _all_shingles(n_buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("s1").to_pylist()
            held = [(items, nodes[k]) for k, items in sets_of(_unpack(batch))]
            if held:
                lengths = np.array([len(x) for x, _ in held], dtype=np.int32)
                tokens = np.concatenate([x for x, _ in held])
                of = np.repeat(np.array([v for _, v in held], dtype=np.int64), lengths)
                yield _blobs([(*row, b"") for row in _deal(tokens, n_buckets, tokens, of, np.repeat(lengths, lengths))])

    return run


def _counted(n_buckets: int):
    """Shingles that two sets or more hold, with their number of sets, dealt by set."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, nodes, sizes, _ in _by_bucket(batches):
            at = np.lexsort((nodes, tokens))
            t, v, s = tokens[at], nodes[at], sizes[at]
            new = np.append(True, (t[1:] != t[:-1]) | (v[1:] != v[:-1]))
            t, v, s = t[new], v[new], s[new]
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            counts = np.repeat(n := np.diff(np.append(first, len(t))), n).astype(np.int32)
            some = counts > 1
            yield _blobs(list(_deal(v[some], n_buckets, t[some], v[some], s[some], counts[some])))

    return run


def _exact_prefixes(n_buckets: int):
    """Each set's prefix in the order of exact numbers of sets, dealt by shingle; shingles of one set come first and match nothing."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, nodes, sizes, counts in _by_bucket(batches):
            at = np.lexsort((tokens, counts, nodes))
            t, v, s = tokens[at], nodes[at], sizes[at].astype(np.int64)
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            many = np.diff(np.append(first, len(v)))
            place = np.arange(len(v)) - np.repeat(first, many)
            take = prefix_length(s) - (s - np.repeat(many, many))
            keep = place < take
            t, v, s = t[keep], v[keep], s[keep].astype(np.int32)
            yield _blobs([(*row, b"") for row in _deal(t, n_buckets, t, v, s)])

    return run


def refined(texts: DataFrame) -> DataFrame:
    """``texts`` with large clusters parted; sets that are left alone are dropped."""
    weights = texts.groupBy("cluster").agg(F.sum("n").alias("weight")).where(F.col("weight") > REFINE_SHINGLES)
    large = materialize(weights, "trie-large")
    total = large.agg(F.sum("weight")).first()[0]
    if not total:
        return texts
    n = int(total // TOKENS_PER_BUCKET) + 12
    rows = texts.join(large.select("cluster"), "cluster").select("s1", "packed")
    counted = _dealt(rows.mapInArrow(_all_shingles(n), _BLOBS), n).mapInArrow(_counted(n), _BLOBS)
    prefixes = _dealt(counted, n).mapInArrow(_exact_prefixes(n), _BLOBS)
    edges = _dealt(prefixes, n).mapInArrow(_edges, "u long, v long")
    parts = components(edges, "trie-refined")
    cluster_of = parts.select(F.col("u").alias("s1"), F.col("v").alias("part")).unionByName(parts.select(F.col("v").alias("s1"), F.col("v").alias("part")).distinct())
    again = texts.join(large.select("cluster"), "cluster").join(cluster_of, "s1").select("s1", "n", F.col("part").alias("cluster"), "packed")
    return materialize(texts.join(large.select("cluster"), "cluster", "left_anti").select("s1", "n", "cluster", "packed").unionByName(again), "trie-refined-texts")


# ------------------------------------------------------------------ operator


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) of every document."""
    bounded_batches(documents.sparkSession)
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.mapInArrow(_signatures(LOCAL_LEAST), f"doc_id {kind}, n long, s1 long, s2 long, shingle long, count long")
    signatures = materialize(signed, "trie-signatures")
    order = global_order(signatures)
    found = links(refined(clustered_texts(docs, candidates(docs, signatures, order))), order)
    order.unpersist()
    own = signatures.where("n is not null").select("doc_id", "n", "s1", "s2")

    # Sets that stand for more than one document: repeated, or linked with another set.
    per_set = own.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    root_of = found.select(F.col("u").alias("s1"), F.col("v").alias("root")).unionByName(found.select(F.col("v").alias("s1"), F.col("v").alias("root")).distinct())
    per_set = per_set.join(root_of, "s1", "left").where("copies > 1 or root is not null")
    per_set = materialize(per_set.withColumn("root", F.coalesce("root", "s1")), "trie-sets")
    per_root = materialize(per_set.groupBy("root").agg(F.min("least").alias("component_id")), "trie-roots")
    per_set = materialize(per_set.join(per_root, "root").select("s1", "s2", "n", "component_id"), "trie-members")
    joined = own.join(per_set, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
