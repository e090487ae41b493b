"""Tokens and costs: sums that tell nothing known from zero, and what a cascade would have cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cascade import escalates

USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def usage_sums(calls: DataFrame, by: list[str]) -> DataFrame:
    """Tokens and completion_cost by ``by``: nulls are skipped, and a group of nulls only has null. A cost of
    zero is nothing known, as for a local model, and becomes null."""
    sums = calls.groupBy(*by).agg(*[F.sum(c).alias(c) for c in USAGE], F.sum("completion_cost").alias("completion_cost"))
    return sums.withColumn("completion_cost", F.when(F.col("completion_cost") != 0, F.col("completion_cost")))


def replayed_costs(cells: DataFrame, runs: DataFrame, threshold: Column, per_item: bool = False) -> DataFrame:
    """What a cascade of two recorded runs would have cost and taken for each item.

    ``cells`` has item_idx, criterion_idx and ``dm``, the cheap judge's report; ``runs`` has item_idx, dm_cost,
    dm_seconds, llm_cost and llm_seconds. Of the second run's cost and time the cascade has the share of
    its calls that it makes: one for each escalated criterion, or, ``per_item``, one where any is.
    """
    per = cells.groupBy("item_idx").agg(F.count("*").alias("n"), F.count_if(escalates("dm", threshold)).alias("n_escalated"))
    made, calls = (F.least("n_escalated", F.lit(1)), F.least("n", F.lit(1))) if per_item else (F.col("n_escalated"), F.col("n"))
    share = F.coalesce(F.try_divide(made.cast("double"), calls), F.lit(0.0))
    both = runs.join(per, "item_idx").withColumn("share", share)
    cost = F.coalesce("dm_cost", F.lit(0.0)) + F.coalesce(F.col("llm_cost") * F.col("share"), F.lit(0.0))
    return both.select("item_idx", "n_escalated", "share", F.when(cost > 0, cost).alias("cost"), (F.col("dm_seconds") + F.col("llm_seconds") * F.col("share")).alias("seconds"))
