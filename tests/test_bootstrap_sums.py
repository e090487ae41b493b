"""Bootstrap sums made in tasks are those of the draws in rows, and what leaves a task does not grow with its items."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quorumlake.operators import agreement, bootstrap


def test_sums_are_those_of_the_draws(spark):
    items = spark.range(-3, 597).withColumnRenamed("id", "item_idx")
    cells = items.select("item_idx", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("criterion_idx")).where("item_idx % 5 <> criterion_idx")
    classed = cells.selectExpr("*", "IF(criterion_idx = 2, 'ordinal', 'binary') AS scale", "CAST(pmod(item_idx * 7, 3) AS INT) AS t", "CAST(pmod(item_idx * 7 + item_idx DIV 4, 3) AS INT) AS p")
    got = {r["replicate"]: r for r in bootstrap.replicate_metrics(classed, 10, seed=5).collect()}
    draws = bootstrap.drawn(items, 10, seed=5)
    tp = classed.join(draws, "item_idx").groupBy("replicate", "criterion_idx", "scale", "t", "p").agg(F.sum("times").alias("n"))
    each = agreement.measured(tp, ["replicate", "criterion_idx", "scale"], F.col("scale") == "ordinal", rates=False).collect()
    assert set(got) == set(range(10))
    for b, r in got.items():
        own = [x for x in each if x["replicate"] == b]
        assert math.isclose(r["accuracy"], sum(x["n"] * x["accuracy"] for x in own) / sum(x["n"] for x in own))
        assert math.isclose(r["mean_kappa"], sum(x["kappa"] for x in own) / len(own))
    pairs = items.selectExpr("item_idx", "CAST(item_idx AS DOUBLE) AS pred", "IF(item_idx = 4, double('NaN'), IF(item_idx = 5, NULL, 1.0D)) AS true")
    rmse = {r["replicate"]: r["rmse"] for r in bootstrap.replicate_errors(pairs, 10, seed=5).collect()}
    drawn = [r for r in draws.collect() if r["item_idx"] != 5]
    assert len({math.isnan(x) for x in rmse.values()}) == 2  # a replicate without the item whose error is not a number has one
    for b, x in rmse.items():
        own = [(r["times"], r["item_idx"]) for r in drawn if r["replicate"] == b]
        want = math.nan if any(i == 4 for _, i in own) else math.sqrt(sum(t * (i - 1) ** 2 for t, i in own) / sum(t for t, _ in own))
        assert math.isnan(x) and math.isnan(want) or math.isclose(x, want)


def test_tasks_hand_on_sums(spark):
    items = spark.range(0, 3000, 1, 2).selectExpr("CAST(id AS STRING) AS head", "array(CAST(id % 3 AS STRING)) AS cells")
    assert bootstrap._class_counts(items, 8).count() == 6  # three classes of two tasks


def test_classes_beyond_what_a_task_holds(spark):
    items = spark.range(0, 3000, 1, 1).selectExpr("CAST(id AS STRING) AS head", "array(CAST(id % 1500 AS STRING)) AS cells")
    parts = bootstrap._class_counts(items, 8).groupBy("cell").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    assert parts.count() == 1500 and parts.agg(F.sum("n")).first()[0] == int(bootstrap._times(8)([str(i) for i in range(3000)]).sum(dtype=int))


def test_intervals_of_several_columns_and_of_none(spark):
    frame = spark.createDataFrame([(1.0, None), (3.0, 2.0)], "a double, b double")
    got = {r["metric"]: (r["n"], r["mean"]) for r in bootstrap.interval(frame, "a", "b").collect()}
    assert got == {"a": (2, 2.0), "b": (1, 2.0)}
    assert [r["n"] for r in bootstrap.interval(frame.limit(0), "a", "b").collect()] == [0, 0]
