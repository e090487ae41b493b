"""Metrics of data sets whose items have rubrics of their own: rubric points are pooled within a scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import CANNOT_ASSESS, MET, criterion_keys
from . import agreement as A
from . import correlation as R
from .cells import judged


def points(frame: DataFrame) -> DataFrame:
    """scale, true and pred value and whether they match exactly, of each judged cell; ``abstained`` where
    the prediction is no answer, which leaves the other columns unread.

    A binary label counts 1 for MET and else 0, CANNOT_ASSESS too, which no verdict then matches; a choice
    counts its option's value, and matches by label.
    """
    options = X.with_na_option(F.col("options"))
    binary = F.col("options").isNull()
    pred, true = F.get(options, F.col("pred_idx")), F.get(options, F.col("true_idx"))
    abstained = F.when(binary, F.col("pred").isNull() | (F.col("pred") == CANNOT_ASSESS)).otherwise(F.coalesce(pred["na"], F.lit(True)))
    value = lambda v, o: F.when(binary, (v == MET).cast("double")).otherwise(F.coalesce(o["value"], F.lit(0.0)))
    return judged(frame).select(
        "scale", abstained.alias("abstained"), value(F.col("true"), true).alias("x"), value(F.col("pred"), pred).alias("y"),
        F.when(binary, F.col("pred") == F.col("true")).otherwise(pred["label"] == true["label"]).alias("exact"),
    )


def pooled(frame: DataFrame) -> DataFrame:
    """One row per scale, and one of all points: n, abstentions, exact accuracy, RMSE, MAE and correlations of
    values, and, for binary points, kappa, phi, precision, recall and F1 (null at a zero denominator)."""
    own = points(frame)
    level = own.withColumn("of", F.explode(F.array("scale", F.lit("all"))))
    used, d = level.where("not abstained"), F.col("y") - F.col("x")
    n = level.groupBy("of").agg(
        F.count_if(~F.col("abstained")).alias("n"), F.count_if("abstained").alias("n_abstain"), F.avg(F.when(~F.col("abstained"), F.col("exact").cast("double"))).alias("accuracy"),
        F.sqrt(F.avg(F.when(~F.col("abstained"), d * d))).alias("rmse"), F.avg(F.when(~F.col("abstained"), F.abs(d))).alias("mae"),
    )
    rank = R.spearman(used, ["of"], "y", "x").drop("n").join(R.pearson(used, ["of"], "y", "x").drop("n"), "of")
    tp = A.counts(used.where("of = 'binary'").select("of", F.col("x").cast("int").alias("t"), F.col("y").cast("int").alias("p")), ["of"])
    two = A.matrices(tp, ["of"]).select("of", A.kappa_of().alias("kappa"), *[c for c in A.rates_of(undefined="null")]).drop("tp", "fp", "fn", "tn", "fpr", "fnr")
    f1 = F.when((F.col("precision") != 0) & (F.col("recall") != 0), F.col("f1"))
    return n.join(rank, "of", "left").join(two.withColumn("f1", f1), "of", "left")


def signatures(criteria: DataFrame) -> DataFrame:
    """(rubric_id or item_idx, signature): the structure of each rubric, which is the requirement, the scale and the
    options' labels of its criteria in order. Weights, values and names are not part of it."""
    key = criterion_keys(criteria)[0]
    labels = F.coalesce(F.transform("options", lambda o: o["label"]), F.array().cast("array<string>"))
    shape = F.array_sort(F.collect_list(F.struct("criterion_idx", "requirement", "scale", labels.alias("labels"))))
    return criteria.where(F.col(key).isNotNull()).groupBy(key).agg(F.sha2(F.to_json(shape), 256).alias("signature"))


def heterogeneous(criteria: DataFrame, items: DataFrame | None = None) -> bool:
    """Whether items have rubrics of different structure; ``items`` (rubric_id or item_idx) says which rubrics count."""
    key = criterion_keys(criteria)[0]
    if key == "criterion_idx":
        return False
    own = signatures(criteria) if items is None else signatures(criteria.join(items.select(key).distinct(), key, "left_semi"))
    return own.select("signature").distinct().limit(2).count() > 1


def common_rubric(criteria: DataFrame) -> DataFrame:
    """One rubric of several of the same structure, for tables by criterion: that of the least key."""
    key = criterion_keys(criteria)[0]
    if key == "criterion_idx":
        return criteria
    first = criteria.where(F.col(key).isNotNull()).agg(F.min(key).alias(key))
    return criteria.join(F.broadcast(first), key, "left_semi").drop("rubric_id", "item_idx")
