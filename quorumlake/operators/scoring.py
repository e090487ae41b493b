"""Weighted scores of items from criterion reports, labels or a single judge's votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import ABSTAIN_STRATEGIES, with_criteria


def contribution(strategy: str = "skip", partial_credit: float = 0.5) -> Column:
    """What a report adds to the weighted sum; null where it is left out. Over weight, options,
    final_verdict, value and na."""
    if strategy not in ABSTAIN_STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(ABSTAIN_STRATEGIES)}, not {strategy!r}")
    w = F.col("weight")
    worst = X.option_value(F.col("options"), X.worst_scored(F.col("options"), w)) * w
    abstained = {
        "skip": F.lit(None).cast("double"),
        "zero": F.lit(0.0),
        "partial": F.when(w > 0, w * partial_credit).otherwise(0.0),
        "fail": F.when(F.col("options").isNotNull(), worst).otherwise(F.least(w, F.lit(0.0))),
    }[strategy]
    return F.when(F.col("na"), abstained).otherwise(X.score_value(F.col("final_verdict"), F.col("value")) * w)


def score_of(added: Column, weight: Column, normalize: bool = True) -> Column:
    """The score of a group of reports as an aggregate of ``added`` (null: left out) and ``weight``.

    Null if nothing is left; else over the positive weights, clamped to 0..1; with negative weights
    only, 1 plus the share of them that was incurred; with zero weights only, 0.
    """
    total, n = F.sum(added), F.count(added)
    pos = F.sum(F.when(added.isNotNull() & (weight > 0), weight).otherwise(0.0))
    neg = F.sum(F.when(added.isNotNull() & (weight <= 0), -weight).otherwise(0.0))
    if not normalize:
        return F.when(n > 0, total)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(n == 0, None).when(pos > 0, clamp(F.try_divide(total, pos))).when(neg > 0, clamp(1.0 + F.try_divide(total, neg))).otherwise(0.0)


def item_reports(reports: DataFrame, strategy: str = "skip", partial_credit: float = 0.5) -> DataFrame:
    """One row per item: score, raw_score, mean_agreement, cannot_assess_count and error, which says
    so if every criterion's judgment failed; such an item has no score."""
    failed = F.bool_and(F.col("error").isNotNull())
    part = reports.withColumn("_part", contribution(strategy, partial_credit))
    return part.groupBy("item_idx").agg(
        F.when(~failed, score_of(F.col("_part"), F.col("weight"))).alias("score"),
        F.when(~failed, score_of(F.col("_part"), F.col("weight"), False)).alias("raw_score"),
        F.avg("agreement").alias("mean_agreement"),
        F.count_if(F.col("na")).alias("cannot_assess_count"),
        F.when(failed, F.lit("Every criterion's judgment failed")).alias("error"),
    )


def as_reports(cells: DataFrame, criteria: DataFrame) -> DataFrame:
    """Labels or one judge's votes (verdict or option_idx by cell) in the form of criterion reports."""
    joined = with_criteria(cells, criteria, "weight", "options")
    opt = F.get(F.col("options"), F.col("option_idx"))
    mc = F.col("options").isNotNull()
    return joined.withColumn("final_verdict", F.when(~mc, F.col("verdict"))).withColumn("value", F.when(mc, F.coalesce(opt["value"], F.lit(0.0)))).withColumn(
        "na", F.when(mc, F.coalesce(opt["na"], F.lit(True))).otherwise(F.col("verdict") == "CANNOT_ASSESS")
    )


def judge_scores(votes: DataFrame, criteria: DataFrame, strategy: str = "skip", partial_credit: float = 0.5) -> DataFrame:
    """Score of each item by each judge's own votes; null if all of them failed."""
    part = as_reports(votes, criteria).withColumn("_part", contribution(strategy, partial_credit))
    failed = F.bool_and(F.col("error").isNotNull())
    return part.groupBy("item_idx", "judge_id").agg(F.when(~failed, score_of(F.col("_part"), F.col("weight"))).alias("score"))


def label_scores(labels: DataFrame, criteria: DataFrame, strategy: str = "skip", normalize: bool = True) -> DataFrame:
    """Expected score of each labelled item."""
    part = as_reports(labels, criteria).withColumn("_part", contribution(strategy))
    return part.groupBy("item_idx").agg(score_of(F.col("_part"), F.col("weight"), normalize).alias("score"))


def rubric_totals(criteria: DataFrame) -> DataFrame:
    return criteria.agg(F.count("*").alias("n_criteria"), F.sum(F.greatest("weight", F.lit(0.0))).alias("positive_weight"))


def penalised(reports: DataFrame, texts: DataFrame, penalty: X.LengthPenalty, normalize: bool = True) -> DataFrame:
    """Item reports with the length penalty of (item_idx, thinking, output) taken off the score only."""
    own = texts.select("item_idx", penalty.of(F.col("thinking"), F.col("output")).alias("penalty"))
    return reports.join(own, "item_idx", "left").withColumn("score", penalty.apply(F.col("score"), F.coalesce("penalty", F.lit(0.0)), normalize))
