"""Running sums, ranks, percentiles and inversions of groups of any size, without a task for each group.

Distinct values and their counts are dealt into blocks of consecutive values, whose edges are approximate
percentiles; what comes before a value is the sum of the earlier blocks plus the earlier rows of its own. Edges
only balance the blocks: any edges give the same result. Few values are one block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block, about, and the most blocks that values are dealt into (a power of two).
BLOCK_ROWS, MAX_BLOCKS = 50_000, 256


def edges(rows: DataFrame, *columns: str) -> list[list[float]]:
    """For each column the rising edges that deal ``rows`` into blocks of about BLOCK_ROWS; none for few rows."""
    q = F.array(*[F.lit(k / MAX_BLOCKS) for k in range(1, MAX_BLOCKS)])
    cols = [F.percentile_approx(F.col(c).cast("double"), q, F.lit(2000)).alias(f"q{k}") for k, c in enumerate(columns)]
    got = rows.agg(F.count("*").alias("n"), *cols).first()
    blocks = min(MAX_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, got["n"] / BLOCK_ROWS)))))
    step = MAX_BLOCKS // blocks
    return [sorted(set((got[f"q{k}"] or [])[step - 1 :: step][: blocks - 1])) for k in range(len(columns))]


def block_of(value: Column, cuts: list[float]) -> Column:
    """How many of the rising ``cuts`` are not above the value, by binary search."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < cuts[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def running(rows: DataFrame, by: list[str], value: str, sums: list[str], cuts: list[float], follow: bool = False) -> DataFrame:
    """``rows``, one for each ``by`` and distinct ``value``, with for each of ``sums`` what smaller values of the group
    sum up to (``_before``) and what all do (``_all``); ``follow`` adds the group's next value (``_next``)."""
    at = block_of(F.col(value).cast("double"), cuts)
    own = Window.partitionBy(*by, "_block").orderBy(value)
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    inside = rows.withColumn("_block", at).select("*", *[zero(F.sum(c).over(earlier)).alias(f"_{c}_in") for c in sums], *([F.lead(value).over(own).alias("_lead")] if follow else []))
    # a table of at most as many rows for each group as there are blocks
    per = rows.withColumn("_block", at).groupBy(*by, "_block").agg(*[F.sum(c).alias(c) for c in sums], F.min(value).alias("_first"))
    keys = by or [F.lit(0)]
    group = Window.partitionBy(*keys)
    order = group.orderBy("_block")
    offsets = per.select(
        *by, "_block", *[zero(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1))).alias(f"_{c}_off") for c in sums],
        *[F.sum(c).over(group).alias(f"{c}_all") for c in sums], F.lead("_first").over(order).alias("_then"),
    )
    mates = [F.col(f"i.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by]
    joined = inside.alias("i").join(offsets.alias("o"), [F.col("i._block") == F.col("o._block"), *mates])
    return joined.select(
        *[F.col(f"i.{c}") for c in rows.columns], *[(F.col(f"_{c}_in") + F.col(f"_{c}_off")).alias(f"{c}_before") for c in sums], *[F.col(f"o.{c}_all") for c in sums],
        *([F.coalesce("_lead", "_then").alias("_next")] if follow else []),
    )


def percentiles(values: DataFrame, by: list[str], column: str, at: tuple[float, ...]) -> DataFrame:
    """The linear percentiles ``at`` of each group, as an array ``q``: exact, from ranks of distinct values."""
    counted = values.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("k"))
    ranked = running(counted, by, "v", ["k"], edges(counted, "v")[0])
    element = lambda i: F.min(F.when(F.col("k_before") + F.col("k") > i, F.col("v")))
    place = [F.lit(p) * (F.col("k_all") - 1) for p in at]
    parts = [c for k, p in enumerate(place) for c in (element(F.floor(p)).alias(f"_l{k}"), element(F.ceil(p)).alias(f"_h{k}"), F.max(p - F.floor(p)).alias(f"_f{k}"))]
    found = ranked.groupBy(*by).agg(*parts)
    each = [F.col(f"_l{k}") + F.col(f"_f{k}") * (F.col(f"_h{k}") - F.col(f"_l{k}")) for k in range(len(at))]
    return found.select(*by, F.array(*each).alias("q"))


def inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The sum over pairs of points of their weights times the sign of (x - x') (y - y'), in n log^2 n: halves of the
    order of x meet at each level, and running sums over y count what lies below and above."""
    rank = np.unique(x, return_inverse=True)[1].ravel()
    height = np.unique(y, return_inverse=True)[1].ravel()
    size, total = int(height.max(initial=0)) + 1, 0.0
    for level in range(int(rank.max(initial=0)).bit_length()):
        key = (rank >> (level + 1)) * size + height
        places, at = np.unique(key, return_inverse=True)
        right = (rank >> level) & 1 == 1
        low = np.bincount(at.ravel(), np.where(right, 0, w), len(places))
        high = np.bincount(at.ravel(), np.where(right, w, 0), len(places))
        node = places // size
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        sums = np.cumsum(low)
        base = np.repeat(np.r_[0, sums[starts[1:] - 1]], np.diff(np.r_[starts, len(node)]))
        whole = np.repeat(np.add.reduceat(low, starts), np.diff(np.r_[starts, len(node)]))
        below = sums - low - base
        total += float((high * (below - (whole - below - low))).sum())
    return total


def concordance(counted: DataFrame, by: list[str]) -> DataFrame:
    """(by, s): concordant less discordant pairs of the points (x, y) with counts ``w``.

    Points are dealt into blocks of consecutive x. Pairs inside a block are counted there; of blocks, the two halves
    of every node of a binary tree over them meet in one running sum over y. A point takes part once for each level,
    so the work is n log n, and no task holds more than a block.
    """
    cut_x, cut_y = edges(counted, "x", "y")
    levels = len(cut_x).bit_length()
    placed = counted.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")).withColumn("_xb", block_of(F.col("x").cast("double"), cut_x))
    schema = ", ".join([*[f"`{c}` {counted.schema[c].dataType.simpleString()}" for c in by], "s double"])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], inversions(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())]], columns=[*by, "s"])

    parts = placed.groupBy(*by, "_xb").applyInPandas(inside, schema)
    if levels:
        each = placed.select(*by, "y", "w", "_xb", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level"))
        right = F.getbit("_xb", F.col("_level")) == 1
        node = F.floor(F.col("_xb") / F.pow(F.lit(2.0), F.col("_level") + 1)).cast("int")
        met = each.groupBy(*by, "_level", node.alias("_node"), "y").agg(F.sum(F.when(right, 0.0).otherwise(F.col("w"))).alias("l"), F.sum(F.when(right, F.col("w")).otherwise(0.0)).alias("r"))
        summed = running(met, [*by, "_level", "_node"], "y", ["l"], cut_y)
        above = F.col("l_all") - F.col("l_before") - F.col("l")
        parts = parts.unionByName(summed.select(*by, (F.col("r") * (F.col("l_before") - above)).alias("s")))
    return parts.groupBy(*by).agg(F.sum("s").alias("s"))
