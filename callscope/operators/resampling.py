"""Bootstrap by n draws with replacement, each replicate exactly n, in tasks that work alone.

The keys of a group are dealt to leaves by the first bits of their hash, some BLOCK keys a leaf. How many of
a replicate's n draws fall to a leaf follows from binomials down a binary tree over the leaves: at each
node the draws part into left and right in proportion to the keys below. The binomials of a node come
from a generator that is seeded by group and node, so all leaves below it agree on them without
talking to each other, and the leaves' counts add up to n. A leaf then draws from its own keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPLICATES = 10_000
#: Keys of a leaf, about; draws made at once.
BLOCK, DRAWN = 4096, 1 << 20
#: Levels of a tree at most.
LEVELS = 40


def bootstrap(diffs: DataFrame, replicates: int = REPLICATES, seed: int = 7) -> DataFrame:
    """grp, lo, hi: the order statistics at int(.025 R) and int(.975 R) - 1, from zero, of the means of R
    replicates. diffs: grp, key (unique in its group), diff (null ones take no part)."""
    sums = replicate_sums(diffs, replicates, seed)
    w = Window.partitionBy("grp")  # a row a replicate
    ranked = sums.withColumn("m", F.col("total") / F.col("draws")).withColumn("k", F.row_number().over(w.orderBy("m", "r")) - 1)
    pick = lambda at: F.max(F.when(F.col("k") == at, F.col("m")))
    return ranked.groupBy("grp").agg(pick(int(replicates * 0.025)).alias("lo"), pick(int(replicates * 0.975) - 1).alias("hi"))


def replicate_sums(diffs: DataFrame, replicates: int = REPLICATES, seed: int = 7) -> DataFrame:
    """grp, r, draws, total: of every replicate. Draws are the group's n in all of them."""
    d = diffs.where(F.col("diff").isNotNull()).select("grp", F.col("key").cast("string").alias("key"), F.col("diff").cast("double").alias("diff"))
    # the upper bits order the leaves; the sign is shifted away
    d = d.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key"), 64 - LEVELS))
    levels = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK))).cast("int")
    sizes = d.groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.least(levels, F.lit(LEVELS)).alias("levels"))
    d = d.join(sizes, "grp").withColumn("leaf", F.call_function("shiftright", F.col("_h"), F.lit(LEVELS) - F.col("levels")))
    paths = _paths(d.groupBy("grp", "levels", "leaf").agg(F.count("*").alias("n")))
    rows = d.select("grp", "leaf", "key", "diff").join(paths, ["grp", "leaf"])
    kind = diffs.schema["grp"].dataType.simpleString()
    made = rows.groupBy("grp", "leaf").applyInArrow(_leaf(replicates, seed), f"grp {kind}, draws array<bigint>, sums array<double>")
    # a row a leaf and replicate, added up before it is shuffled
    each = made.select("grp", F.posexplode(F.arrays_zip("draws", "sums")).alias("r", "x"))
    return each.groupBy("grp", "r").agg(F.sum("x.draws").alias("draws"), F.sum("x.sums").alias("total"))


def _paths(leaves: DataFrame) -> DataFrame:
    """grp, leaf, path: (node, keys below it, keys below its left child) from the root down, and the group's n."""
    up = leaves.select("grp", "levels", "leaf", "n", F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("level"))
    node = F.call_function("shiftright", F.col("leaf"), F.col("levels") - F.col("level"))
    nodes = up.withColumn("node", node).groupBy("grp", "level", "node").agg(F.sum("n").alias("below"))
    left = nodes.where("node % 2 = 0 AND level > 0").select("grp", (F.col("level") - 1).alias("level"), F.call_function("shiftright", F.col("node"), F.lit(1)).alias("node"), F.col("below").alias("left"))
    nodes = nodes.join(left, ["grp", "level", "node"], "left")
    steps = up.withColumn("node", node).join(nodes, ["grp", "level", "node"])
    return steps.groupBy("grp", "leaf").agg(F.array_sort(F.collect_list(F.struct("level", "node", "below", F.coalesce("left", F.lit(0)).alias("left")))).alias("path"))


def leaf_draws(group: str, path: list[tuple[int, int, int, int]], replicates: int, seed: int) -> np.ndarray:
    """How many draws of each replicate fall to the leaf that the path (level, node, below, left) ends at."""
    draws = np.full(replicates, path[0][2], dtype=np.int64)
    for (level, node, below, left), (_, nxt, _, _) in zip(path, path[1:], strict=False):
        g = np.random.Generator(np.random.Philox(key=xxhash.xxh64_intdigest(f"{seed}:{group}:{level}:{node}")))
        to_left = g.binomial(draws, left / below)
        draws = draws - to_left if nxt % 2 else to_left
    return draws


def _leaf(replicates: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        grp, path = table["grp"][0], table["path"][0].as_py()
        draws = leaf_draws(str(grp.as_py()), [(p["level"], p["node"], p["below"], p["left"]) for p in path], replicates, seed)
        diff = table["diff"].to_numpy()
        g = np.random.Generator(np.random.Philox(key=xxhash.xxh64_intdigest(f"{seed}:{grp.as_py()}:leaf:{path[-1]['node']}")))
        sums = np.zeros(replicates)
        for lo, hi in _chunks(draws):
            drawn = diff[g.integers(0, len(diff), int(draws[lo:hi].sum()))]
            sums[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), draws[lo:hi]), drawn, hi - lo)
        return pa.table({"grp": pa.array([grp.as_py()], table.schema.field("grp").type), "draws": pa.array([draws], pa.list_(pa.int64())), "sums": pa.array([sums], pa.list_(pa.float64()))})

    return run


def _chunks(draws: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of replicates with about DRAWN draws each."""
    upto, lo = np.cumsum(draws), 0
    while lo < len(draws):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + DRAWN)))
        yield lo, min(hi, len(draws))
        lo = min(hi, len(draws))
