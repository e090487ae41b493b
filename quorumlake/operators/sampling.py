"""Splits and few-shot examples by hash order, and diagnostic rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import dimension
from .bootstrap import hash32
from .ordered import edges, running


def seeded(seed: int, *parts: str) -> Column:
    return hash32(F.concat_ws(":", F.lit(seed), *parts))


def train_test(items: DataFrame, n_train: int, seed: int = 0) -> DataFrame:
    """Items with ``split``: exactly ``n_train`` of them (or all) are train. The cut is a threshold on
    the hash, found from counts by its leading bits, so no task sorts all items."""
    keyed = items.withColumn("_h", seeded(seed, "item_idx"))
    run = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = keyed.groupBy((F.col("_h") / F.lit(1 << 20)).cast("int").alias("_b")).agg(F.count("*").alias("_n"))
    before = blocks.withColumn("_before", F.sum("_n").over(run) - F.col("_n")).drop("_n")
    placed = keyed.withColumn("_b", (F.col("_h") / F.lit(1 << 20)).cast("int")).join(F.broadcast(before), "_b")  # at most 4096 blocks
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", "item_idx"))
    return placed.withColumn("split", F.when(rank <= n_train, "train").otherwise("test")).drop("_h", "_b", "_before")


def signatures(labels: DataFrame) -> DataFrame:
    """(item_idx, signature): the labels of all criteria in order, as one string."""
    one = F.coalesce("verdict", F.col("option_idx").cast("string"), F.lit("-"))
    parts = F.array_sort(F.collect_list(F.struct("criterion_idx", one.alias("v"))))
    return labels.groupBy("item_idx").agg(F.array_join(F.transform(parts, lambda x: x["v"]), "|").alias("signature"))


#: Leading bits of the hash by which a stratum is cut.
_CUT_BITS = 10


def stratified_split(signed: DataFrame, n_train: int, seed: int = 0) -> DataFrame:
    """Items with ``split``, each signature giving its share of ``n_train``.

    Signatures in order take round(size * train left / items left), halves to even, so the shares add
    up to ``n_train``: a fold over the sizes of signatures, in one row of a table that has one for each. A
    signature's items before its cut in hash order are train; the cut is found from counts by leading bits of the hash, and
    only the items whose bits are the cut's are put in order, so a signature of any size is split over tasks.
    """
    keyed = signed.withColumn("_h", seeded(seed, "item_idx"))
    bits = F.shiftright("_h", 32 - _CUT_BITS).cast("int")
    blocks = keyed.groupBy("signature", bits.alias("_b")).agg(F.count("*").alias("_n"))
    sizes = blocks.groupBy("signature").agg(F.sum("_n").alias("n"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("signature", "n"))).alias("all"), F.sum("n").alias("total"))
    start = F.struct(F.col("total").alias("left"), F.lit(n_train).cast("long").alias("train"), F.array().cast("array<struct<signature:string,quota:bigint>>").alias("quota"))

    def share(s: Column, x: Column) -> Column:
        own = F.greatest(F.lit(0).cast("long"), F.least(x["n"], F.bround(x["n"] * s["train"] / s["left"]).cast("long")))
        return F.struct((s["left"] - x["n"]).alias("left"), (s["train"] - own).alias("train"), F.concat(s["quota"], F.array(F.struct(x["signature"].alias("signature"), own.alias("quota")))).alias("quota"))

    quotas = listed.select(F.inline(F.aggregate("all", start, share, lambda s: s["quota"])))
    before = F.sum("_n").over(Window.partitionBy("signature").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counted = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).join(quotas, "signature")
    # of each signature: blocks below the cut are train, and of the cut's own block the first ``_rest`` items
    cut = counted.where((F.col("_before") < F.col("quota")) & (F.col("_before") + F.col("_n") > F.col("quota"))).select("signature", F.col("_b").alias("_cut"), (F.col("quota") - F.col("_before")).alias("_rest"))
    whole = counted.where(F.col("_before") + F.col("_n") <= F.col("quota")).groupBy("signature").agg(F.max("_b").alias("_last"))
    known = sizes.select("signature").join(whole, "signature", "left").join(cut, "signature", "left").select("signature", F.coalesce("_last", F.lit(-1)).alias("_last"), "_cut", "_rest")
    placed = keyed.withColumn("_b", bits).join(dimension(known), "signature")
    at_cut = F.coalesce(F.col("_b") == F.col("_cut"), F.lit(False))
    plain = placed.where(~at_cut).withColumn("split", F.when(F.col("_b") <= F.col("_last"), "train").otherwise("test"))
    rank = F.row_number().over(Window.partitionBy("signature").orderBy("_h", "item_idx"))
    edge = placed.where(at_cut).withColumn("split", F.when(rank <= F.col("_rest"), "train").otherwise("test"))
    return plain.unionByName(edge).drop("_h", "_b", "_last", "_cut", "_rest")


def balanced_examples(labels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """For each criterion up to ``n`` labelled items, spread evenly over its classes: n // classes of
    each, one more of the first classes for the rest, then any others in hash order."""
    cls = F.coalesce("verdict", F.col("option_idx").cast("string"))
    h = seeded(seed, "criterion_idx", "item_idx")
    own = labels.where(cls.isNotNull()).withColumn("class", cls).withColumn("_h", h)
    by_class = own.withColumn("_r", F.row_number().over(Window.partitionBy("criterion_idx", "class").orderBy("_h", "item_idx")))
    groups = own.select("criterion_idx", "class").distinct().withColumn("_g", F.row_number().over(Window.partitionBy("criterion_idx").orderBy("class")))
    sized = groups.withColumn("_k", F.count("*").over(Window.partitionBy("criterion_idx")))
    quota = sized.withColumn("_quota", F.floor(F.lit(n) / F.col("_k")) + (F.col("_g") <= F.pmod(F.lit(n), F.col("_k"))).cast("int"))
    joined = by_class.where(F.col("_r") <= n).join(quota, ["criterion_idx", "class"])
    order = Window.partitionBy("criterion_idx").orderBy((F.col("_r") > F.col("_quota")).cast("int"), "_h", "item_idx")
    return joined.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n).select("criterion_idx", "item_idx", "class", "pick")


def covering_items(labels: DataFrame, n: int) -> list[int]:
    """Up to ``n`` labelled items that greedily cover most (criterion, class) pairs; ties to the lowest item.

    Each pick is one aggregation over the distinct sets of pairs, with the lowest item of each set: the
    driver sees the picked sets only. When no item adds a pair, the lowest of the others follow.
    """
    cls = F.coalesce("verdict", F.col("option_idx").cast("string"))
    own = labels.where(cls.isNotNull()).select("item_idx", F.concat_ws(":", "criterion_idx", cls).alias("pair"))
    sets = own.groupBy("item_idx").agg(F.array_sort(F.collect_set("pair")).alias("s")).groupBy("s").agg(F.min("item_idx").alias("item_idx")).persist()
    seen: set[str] = set()
    out: list[int] = []
    while len(out) < n:
        new = F.size(F.array_except("s", F.array(*map(F.lit, sorted(seen))).cast("array<string>")))
        best = sets.agg(F.min(F.struct((-new).alias("less"), "item_idx", "s")).alias("b")).first()["b"]
        if best is None or best["less"] == 0:
            break
        out.append(best["item_idx"])
        seen |= set(best["s"])
    sets.unpersist()
    if len(out) < n:
        lowest = [r["item_idx"] for r in own.select("item_idx").distinct().orderBy("item_idx").limit(n).collect()]
        out += [i for i in lowest if i not in out][: n - len(out)]
    return out


def diagnostic_items(gaps: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most over- and under-scored items of (item_idx, gap)."""
    side = F.when(F.col("gap") > 0, "over").when(F.col("gap") < 0, "under")
    ranked = gaps.withColumn("side", side).where(F.col("side").isNotNull()).withColumn(
        "rank", F.row_number().over(Window.partitionBy("side").orderBy(F.abs("gap").desc(), "item_idx"))
    )
    return ranked.where(F.col("rank") <= k)


def issues(reports: DataFrame) -> DataFrame:
    """Reports that are problems: a positive criterion unmet or a negative one met."""
    bad = ((F.col("weight") > 0) & (F.col("final_verdict") == "UNMET")) | ((F.col("weight") < 0) & (F.col("final_verdict") == "MET"))
    return reports.where(bad)


def issue_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Issues that are gone (fixed) and new ones (introduced)."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("change", F.lit("fixed")).unionByName(b.join(a, keys, "left_anti").withColumn("change", F.lit("introduced")))


def timing(durations: DataFrame, column: str) -> DataFrame:
    """n, mean, extremes, sum, and p50 and p95 as elements of the sorted durations.

    p50 is element n // 2, p95 element min(int(0.95 n), n - 1), counted from 0; both are read off the
    running count of the distinct durations.
    """
    x = durations.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("k"))
    run = running(x, [], "v", ["k"], edges(x, "v")[0]).select("v", "k", (F.col("k_before") + F.col("k")).alias("up"), F.col("k_all").alias("n"))
    at = lambda i: F.min(F.when(F.col("up") > i, F.col("v")))
    n = F.col("n")
    return run.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.try_divide(F.sum(F.col("v") * F.col("k")), F.sum("k")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
        at(F.floor(n / 2)).alias("p50"), at(F.least(F.floor(n * 0.95), n - 1)).alias("p95"),
    )


def covered(items: DataFrame, labelled: DataFrame) -> DataFrame:
    """Items that have labels, in order."""
    return items.join(labelled.select("item_idx").distinct(), "item_idx", "left_semi").orderBy("item_idx")


def repeated_judges(votes: DataFrame) -> DataFrame:
    """Judges with several votes on a cell, superseded ones apart, and how many cells."""
    own = votes.where(~F.coalesce(F.col("superseded"), F.lit(False))).groupBy("item_idx", "criterion_idx", "judge_id").agg(F.count("*").alias("n")).where("n > 1")
    return own.groupBy("judge_id").agg(F.count("*").alias("n_cells"))


def degenerate(classed: DataFrame) -> DataFrame:
    """Criteria whose judged labels are of one class: kappa is undefined there."""
    return classed.groupBy("criterion_idx").agg(F.count_distinct("t").alias("n_classes"), F.count("*").alias("n")).where("n_classes < 2")
