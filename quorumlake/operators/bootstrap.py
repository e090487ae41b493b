"""Bootstrap intervals by item resampling, with all replicates in one job.

Each item has in each replicate a Poisson(1) number of draws, which a hash of seed, item and replicate
gives: the limit of drawing as many items as there are with replacement, without an order of the items
that all draws would have to share. Draws are made where an item's row is and summed up there, as rows
of a matrix: what leaves a task is a sum for each replicate, not a row for each draw.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .agreement import measured

#: Draws that one MD5 gives.
_DRAWS = 4
#: A 32-bit hash of at least the k-th number means more than k draws.
CUTS = tuple(int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(9))
#: Items whose draws are made at once, and classes whose sums a task holds at once.
_ITEMS, _CLASSES = 256, 1024


def hash32(text: Column) -> Column:
    """The first 32 bits of MD5 as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def drawn(items: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """``items``, which have an item_idx, with replicate and times, once for each replicate that draws them."""
    block = items.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // _DRAWS) - 1))))
    text = F.md5(F.concat_ws(":", F.lit(seed), "item_idx", "_block").cast("binary"))
    hashed = block.withColumn("_md5", text)

    def one(k: int) -> Column:
        h = F.conv(F.substring("_md5", 8 * k + 1, 8), 16, 10).cast("long")
        times = sum(((h >= c).cast("int") for c in CUTS[1:]), (h >= CUTS[0]).cast("int"))
        return F.struct((F.col("_block") * _DRAWS + k).alias("replicate"), times.alias("times"))

    each = hashed.withColumn("_d", F.explode(F.array(*[one(k) for k in range(_DRAWS)])))
    return each.where(F.col("_d.times") > 0).where(F.col("_d.replicate") < replicates).select(*items.columns, "_d.replicate", "_d.times")


def _head(seed: int) -> Column:
    """What the text of a draw's MD5 begins with; the number of its block follows."""
    return F.concat_ws(":", F.lit(seed), "item_idx", F.lit("")).alias("head")


def _times(replicates: int) -> Callable[[list[str]], np.ndarray]:
    """How often each replicate draws each item: what ``drawn`` has in rows, as a row of bytes for each item."""
    tails = [str(b).encode() for b in range(-(-replicates // _DRAWS))]

    def times(heads: list[str]) -> np.ndarray:
        digests = []
        for head in heads:
            begun = md5(head.encode())
            for tail in tails:
                one = begun.copy()
                one.update(tail)
                digests.append(one.digest())
        h = np.frombuffer(b"".join(digests), ">u4").astype(np.uint32).reshape(len(heads), -1)[:, :replicates]
        return sum((h >= np.uint32(c)).view(np.uint8) for c in CUTS)

    return times  # made here, so that tasks get it by value


def _class_counts(items: DataFrame, replicates: int) -> DataFrame:
    """(cell, n): of items with their cells, as text, how many of each each replicate draws, as an array; in parts."""
    draw = _times(replicates)

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        told = lambda: pd.DataFrame({"cell": list(held), "n": list(held.values())})
        for pdf in pdfs:
            for i in range(0, len(pdf), _ITEMS):
                own = pdf.iloc[i : i + _ITEMS]
                times = draw(own["head"].tolist())
                rows: dict[str, list[int]] = {}
                for row, cells in enumerate(own["cells"]):
                    for cell in cells:
                        rows.setdefault(cell, []).append(row)
                for cell, at in rows.items():
                    n = times[at].sum(axis=0, dtype=np.int64)
                    held[cell] = held[cell] + n if cell in held else n
                if len(held) > _CLASSES:
                    yield told()
                    held.clear()
        if held:
            yield told()

    return items.mapInPandas(count, "cell string, n array<long>")


def replicate_metrics(classed: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, accuracy, mean_kappa): pooled accuracy and the mean of the criteria's defined kappas,
    weighted by squares on ordinal scales."""
    own = [f"{c} {classed.schema[c].dataType.simpleString()}" for c in ("criterion_idx", "scale", "t", "p")]
    items = classed.groupBy("item_idx").agg(F.collect_list(F.to_json(F.struct("criterion_idx", "scale", "t", "p"))).alias("cells")).select(_head(seed), "cells")
    each = _class_counts(items, replicates).select("cell", F.posexplode("n").alias("replicate", "n")).where("n > 0")
    tp = each.groupBy("replicate", "cell").agg(F.sum("n").alias("n")).select("replicate", F.from_json("cell", ", ".join(own)).alias("c"), "n").select("replicate", "c.*", "n")
    each = measured(tp, ["replicate", "criterion_idx", "scale"], F.col("scale") == "ordinal", rates=False)
    return each.groupBy("replicate").agg(F.try_divide(F.sum(F.col("n") * F.col("accuracy")), F.sum("n")).alias("accuracy"), F.avg("kappa").alias("mean_kappa"))


def replicate_errors(pairs: DataFrame, replicates: int, seed: int = 0, pred: str = "pred", true: str = "true") -> DataFrame:
    """(replicate, rmse) of the scores of item_idx."""
    d, draw = (F.col(pred) - F.col(true)).cast("double"), _times(replicates)

    def add(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, d2 = np.zeros(replicates, np.int64), np.zeros(replicates)
        for pdf in pdfs:
            for i in range(0, len(pdf), _ITEMS):
                own = pdf.iloc[i : i + _ITEMS]
                times = draw(own["head"].tolist())
                n += times.sum(axis=0, dtype=np.int64)
                # an item that is not drawn adds nothing, not even if its error is not finite
                d2 += np.multiply(times, own["d2"].to_numpy()[:, None], where=times > 0, out=np.zeros(times.shape)).sum(axis=0)
        yield pd.DataFrame({"n": [n], "d2": [d2]})

    sums = pairs.where(d.isNotNull()).select(_head(seed), (d * d).alias("d2")).mapInPandas(add, "n array<long>, d2 array<double>")
    each = sums.select(F.posexplode(F.arrays_zip("n", "d2")).alias("replicate", "x")).where("x.n > 0")
    d2 = F.coalesce("x.d2", F.lit(math.nan))  # Arrow makes a NaN null
    return each.groupBy("replicate").agg(F.sqrt(F.sum(d2) / F.sum("x.n")).alias("rmse"))


def interval(replicated: DataFrame, *columns: str, level: float = 0.95) -> DataFrame:
    """Percentile intervals of ``columns``, in one pass, over the replicates where the metric is defined."""
    tail = (1 - level) / 2

    def one(column: str) -> Column:
        q = F.percentile(column, F.array(F.lit(tail), F.lit(1 - tail)))
        return F.struct(F.lit(column).alias("metric"), F.count(column).alias("n"), F.avg(column).alias("mean"), q[0].alias("low"), q[1].alias("high"))

    return replicated.agg(F.array(*map(one, columns)).alias("_m")).select(F.inline("_m"))
