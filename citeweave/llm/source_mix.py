"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Words of each document are counted; each source's target follows from its weight, with
   no target above ``max_repeat`` times the source's words (the excess goes to the others).
2. A source's documents fall by hash into blocks. A target of ``c`` whole passes and a rest
   draws every block ``c`` times, then whole blocks in permuted order until the rest is used;
   the one block that straddles the rest is cut between documents.
3. The number of draws of each source is its exact quota. A binary tree splits the vector
   of quotas among the output shards: at each node the left half's share is drawn from the
   multivariate hypergeometric law, so the leaves are what a full shuffle would give.
4. Each leaf takes the next draws of each source's permuted list, disjoint from all others,
   and orders its documents by a hash (the local shuffle).

Only DataFrame expressions run on the executors. All randomness is a hash of the seed, so
reruns agree. A block holds about ``docs_per_block`` documents at any size of a source; its
blocks and draws, one small row each, are numbered in ranges of hashes whose totals are summed
apart, so neither documents nor blocks of a source ever meet in one task. Tables with a row
per source (targets, quotas) are the only ones that one task orders as a whole.

Null text has 0 words; a null source is a source of its own, last in order; a source without
words has target 0 and takes nothing. Rows that repeat a doc_id are separate documents. An
empty table gives an empty result. Columns of the input whose names are needed for the
result (``size``, ``source_size``, ``target``, ``placements``) are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import materialize

#: Blocks or shards that one task puts in order.
RANGE = 4096
WORD_SPACE = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than space and the controls 9 to 13; null has 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sized: DataFrame, max_repeat: int = 3, weights: tuple = (1, 2, 3)) -> DataFrame:
    """source, source_size, n_docs, ordinal, target: water-filling under the caps, over one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("ordinal", F.row_number().over(by_name) - 1)
    pick = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(pick, (F.col("ordinal") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(max_repeat))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "ordinal")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    final = F.max(F.when(~F.col("capped"), F.struct(-F.col("cap") / F.col("weight"), -F.col("ordinal"), F.col("level").alias("level")))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(final["level"] * F.col("weight"))
    return per.select("source", "source_size", "n_docs", "ordinal", target.alias("target"))


def _uniform(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def hypergeometric(u: Column, good: Column, total: Column, draws: Column) -> Column:
    """The variate at ``u``: good ones among ``draws`` taken from ``total`` of which ``good`` are good.

    The support is walked from the mode upwards, then from the mode downwards, with weights
    relative to the mode's; any order of the support is a valid inversion.
    """
    bad = total - good
    low = F.greatest(F.lit(0).cast("long"), draws - bad)
    high = F.least(draws, good)
    mode = F.least(high, F.greatest(low, F.floor((draws + 1) * (good + 1) / (total + 2)).cast("long")))
    above = F.sequence(mode, high)
    below = F.when(mode > low, F.sequence(mode - 1, low, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def up(x: Column) -> Column:  # weight(x + 1) / weight(x); the divisor is positive below the top of the support
        return (good - x) * (draws - x) / ((x + 1) * F.greatest(F.lit(1).cast("long"), bad - draws + x + 1)).cast("double")

    def down(x: Column) -> Column:  # weight(x) / weight(x + 1)
        return (x + 1) * (bad - draws + x + 1) / ((good - x) * (draws - x)).cast("double")

    zero = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("s"))
    sum_up = F.aggregate(above, zero, lambda a, x: F.struct((a["p"] * up(x)).alias("p"), (a["s"] + a["p"]).alias("s")))["s"]
    sum_down = F.aggregate(below, zero, lambda a, x: F.struct((a["p"] * down(x)).alias("p"), (a["s"] + a["p"] * down(x)).alias("s")))["s"]

    def walk_up(a: Column, x: Column) -> Column:
        here = a["got"].isNull() & (a["rest"] < a["p"])
        return F.struct((a["p"] * up(x)).alias("p"), (a["rest"] - a["p"]).alias("rest"), F.when(here, x).otherwise(a["got"]).alias("got"))

    def walk_down(a: Column, x: Column) -> Column:
        p = a["p"] * down(x)
        here = a["got"].isNull() & (a["rest"] < p)
        return F.struct(p.alias("p"), (a["rest"] - p).alias("rest"), F.when(here, x).otherwise(a["got"]).alias("got"))

    none = F.lit(None).cast("long")
    first = F.aggregate(above, F.struct(F.lit(1.0).alias("p"), (u * (sum_up + sum_down)).alias("rest"), none.alias("got")), walk_up)
    last = F.aggregate(below, F.struct(F.lit(1.0).alias("p"), first["rest"].alias("rest"), first["got"].alias("got")), walk_down)
    return F.coalesce(last["got"], mode)


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, ordinal, n: exact quotas (columns ordinal, n) split among the shards; each shard gets nearly as many draws."""
    root = quotas.agg(F.sort_array(F.collect_list(F.struct("ordinal", F.col("n").cast("long").alias("n")))).alias("parts"))
    nodes = root.select(
        F.lit(0).cast("long").alias("shard"),
        F.lit(shards).cast("long").alias("width"),
        F.transform("parts", lambda p: p["n"]).alias("quota"),
        F.transform("parts", lambda p: p["ordinal"]).alias("ordinals"),
    )
    for depth in range(max(0, math.ceil(math.log2(shards))) if shards > 1 else 0):
        if depth == 6:
            nodes = nodes.repartition(64, "shard")
        nodes = nodes.withColumn("slots", F.aggregate("quota", F.lit(0).cast("long"), lambda a, x: a + x))
        half = F.floor((F.col("width") + 1) / 2).cast("long")
        nodes = nodes.withColumn("half", half)
        share = F.floor(F.col("slots") * F.col("half") / F.col("width")).cast("long")

        def draw(acc: Column, pair: Column) -> Column:
            n = pair["n"]
            x = hypergeometric(_uniform(F.lit(seed), F.lit(depth), F.col("shard"), pair["i"]), n, acc["total"], acc["slots"])
            return F.struct((acc["total"] - n).alias("total"), (acc["slots"] - x).alias("slots"), F.concat(acc["left"], F.array(x)).alias("left"))

        pairs = F.transform("quota", lambda n, i: F.struct(n.alias("n"), i.alias("i")))
        start = F.struct(F.col("slots").alias("total"), share.alias("slots"), F.array().cast("array<bigint>").alias("left"))
        left = F.aggregate(pairs, start, draw, lambda acc: acc["left"])

        def children(taken: Column) -> Column:
            rest = F.zip_with(F.col("quota"), taken, lambda q, x: q - x)
            both = F.array(
                F.struct(F.col("shard").alias("shard"), F.col("half").alias("width"), taken.alias("quota")),
                F.struct((F.col("shard") + F.col("half")).alias("shard"), (F.col("width") - F.col("half")).alias("width"), rest.alias("quota")),
            )
            return both

        alone = F.array(F.struct("shard", "width", "quota"))
        split = F.when(F.col("width") > 1, F.element_at(F.transform(F.array(left), children), 1)).otherwise(alone)
        nodes = nodes.select("ordinals", F.explode(split).alias("node")).select("node.shard", "node.width", "node.quota", "ordinals")
    pairs = F.arrays_zip(F.col("ordinals"), F.col("quota"))
    return nodes.select("shard", F.explode(pairs).alias("p")).select("shard", F.col("p.ordinals").alias("ordinal"), F.col("p.quota").alias("n"))


def _hashed(key: Column, n: Column) -> tuple[Column, Column]:
    """(range, place): a random place for each key, and the number of its range, of which there is one for each RANGE of ``n`` keys."""
    ranges = F.ceil(n / RANGE)
    return F.floor(F.shiftrightunsigned(key, 40) * ranges / F.lit(float(1 << 24))).cast("long"), F.shiftrightunsigned(key, 1)


def _running(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: of each row's source, the sum of ``value`` up to the row in the order of (range, *order)."""
    per = rows.groupBy("ordinal", "range").agg(F.sum(value).alias("_in"))
    before = Window.partitionBy("ordinal").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select("ordinal", "range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy("ordinal", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(bases, ["ordinal", "range"]).withColumn(name, F.col("_inside") + F.col("_base")).drop("_inside", "_base", "range")


def mix_sources(
    documents: DataFrame,
    carry: bool = False,
    seed: int = 11,
    max_repeat: int = 3,
    weights: tuple = (1, 2, 3),
    docs_per_block: int = 128,
    blocks_per_shard: int = 8,
) -> DataFrame:
    """doc_id, source, size, source_size, target, placements array<struct<copy, shard, position>>.

    With ``carry`` all columns of ``documents`` come along. A document is in the mix once for
    each placement; ``emit`` makes those rows.
    """
    own = ["size", "source_size", "target", "placements"]
    base = documents.drop(*[c for c in documents.columns if c in own])
    slim = base.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = materialize(slim, "mix-sizes")
    targets = source_targets(sized, max_repeat, weights)
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / docs_per_block)).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = materialize(targets.withColumn("n_blocks", blocks_of).withColumn("passes", passes).withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")), "mix-targets")

    def blocked(rows: DataFrame) -> DataFrame:
        t = targets.withColumnRenamed("source", "_source")
        joined = rows.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return joined.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), "n_blocks"))

    words = blocked(sized).groupBy("ordinal", "block", "passes", "rest", "n_blocks").agg(F.sum("size").alias("words"))
    span, place = _hashed(F.xxhash64(F.lit(seed + 1), "ordinal", "passes", "block"), F.col("n_blocks"))
    words = materialize(words.withColumns({"range": span, "place": place}), "mix-words")
    per_block = _running(words, ["place", "block"], F.col("words"), "upto")
    whole = (F.col("upto") <= F.col("rest")) & (F.col("words") > 0)
    cut = (F.col("upto") - F.col("words") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    per_block = materialize(
        per_block.select("ordinal", "block", "passes", "n_blocks", F.when(whole, 1).when(cut, 2).otherwise(0).alias("state"), (F.col("rest") - F.col("upto") + F.col("words")).alias("room")),
        "mix-blocks",
    )
    copies = F.when(F.col("state") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes"))).when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1))
    draws = per_block.select("ordinal", "block", "n_blocks", F.explode(copies).alias("copy"))
    quotas = materialize(draws.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n")), "mix-quotas")
    total = quotas.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total / blocks_per_shard))

    leaves = splitting_tree(quotas, shards, seed + 2).withColumn("range", F.floor(F.col("shard") / RANGE).cast("long"))
    leaves = _running(materialize(leaves, "mix-leaves"), ["shard"], F.col("n"), "upto")
    taken = leaves.where("n > 0").select("shard", "ordinal", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("rank"))
    span, place = _hashed(F.xxhash64(F.lit(seed + 3), "ordinal", "copy", "block"), F.col("n_blocks"))
    ranked = _running(draws.withColumns({"range": span, "place": place}), ["place", "copy", "block"], F.lit(1).cast("long"), "rank").withColumn("rank", F.col("rank") - 1)
    placed = ranked.join(taken, ["ordinal", "rank"]).groupBy("ordinal", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("places"))
    plan = materialize(per_block.drop("n_blocks").join(placed, ["ordinal", "block"], "left"), "mix-plan")

    rows = base.withColumn("size", word_count(F.col("text"))) if carry else sized
    rows = blocked(rows).drop("passes", "n_blocks").join(plan, ["ordinal", "block"])
    straddle = rows.where("state = 2")
    in_block = Window.partitionBy("ordinal", "block")
    key = F.xxhash64(F.lit(seed + 4), "doc_id", "size")
    straddle = straddle.withColumn("_in", F.lit(False)).withColumn("_gap", F.col("room"))
    for _ in range(3):  # each round takes, in permuted order, what still fits into the gap
        fits = ~F.col("_in") & (F.col("size") <= F.col("_gap"))
        so_far = F.sum(F.when(F.col("_fits"), F.col("size"))).over(in_block.orderBy(key, "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
        straddle = straddle.withColumn("_fits", fits).withColumn("_upto", so_far)
        straddle = straddle.withColumn("_fits", F.col("_fits") & (F.col("_upto") <= F.col("_gap")))
        straddle = straddle.withColumn("_gap", F.col("_gap") - F.coalesce(F.max(F.when(F.col("_fits"), F.col("_upto"))).over(in_block), F.lit(0)))
        straddle = straddle.withColumn("_in", F.col("_in") | F.col("_fits"))
    miss = F.when(~F.col("_in"), F.abs(F.col("size") - F.col("_gap"))).otherwise(F.col("_gap"))
    straddle = straddle.withColumn("_nearest", F.row_number().over(in_block.orderBy(miss, F.col("_in"), key, "doc_id", "size")))
    straddle = straddle.withColumn("_in", F.col("_in") | ((F.col("_nearest") == 1) & (F.abs(F.col("size") - F.col("_gap")) < F.col("_gap"))))
    all_rows = rows.where("state <> 2").withColumn("_in", F.lit(True)).unionByName(straddle.drop("_upto", "_gap", "_nearest", "_fits"))
    seat = F.transform(
        F.filter(F.coalesce(F.col("places"), F.array().cast("array<struct<copy:bigint,shard:bigint>>")), lambda p: (p["copy"] < F.col("passes")) | F.col("_in")),
        lambda p: F.struct(p["copy"].alias("copy"), p["shard"].alias("shard"), F.xxhash64(F.lit(seed + 5), F.col("doc_id"), p["copy"], F.col("size")).alias("position")),
    )
    kept = base.columns if carry else ["doc_id", "source"]
    return all_rows.select(*kept, "size", "source_size", "target", seat.alias("placements"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each placement, with shard and position; rows of a shard lie together in local random order."""
    rows = mixed.select("*", F.explode("placements").alias("_p")).select("*", F.col("_p.shard").alias("shard"), F.col("_p.position").alias("position"))
    return rows.drop("_p", "placements").repartition("shard").sortWithinPartitions("shard", "position")
