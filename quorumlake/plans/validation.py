"""How good a rubric is: against expected scores, among judges, against labels, and by a rubric of rubrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import agreement as A
from ..operators import cells as K
from ..operators import correlation as R
from ..rubric import Rubric


def ground_truth_validity(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """n and metric of (item_idx, score) against (item_idx, score): Spearman's rho from three items on, null
    where a side is constant; below that 1 - MAE. Items without a score on either side are left out."""
    pairs = scores.select("item_idx", F.col("score").alias("pred")).join(expected.select("item_idx", F.col("score").alias("true")), "item_idx").where("pred is not null and true is not null")
    s = pairs.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pred") - F.col("true"))).alias("mae"))
    rank = R.spearman(pairs.withColumn("_g", F.lit(0)), ["_g"], "pred", "true").select("spearman")
    return s.join(rank, F.lit(True), "left").select("n", F.when(F.col("n") >= 3, F.col("spearman")).when(F.col("n") > 0, 1 - F.col("mae")).alias("metric"))


def agreement_validity(reports: DataFrame, item_reports: DataFrame, criteria: DataFrame) -> DataFrame:
    """Mean agreement of judges overall (a null name) and by the criterion's name, or the start of its
    requirement, least first; items whose grade failed are left out."""
    fine = item_reports.where("error is null")
    name = F.coalesce("name", F.substring("requirement", 1, 30))
    named = reports.join(fine.select("item_idx"), "item_idx", "left_semi").join(F.broadcast(criteria.select("criterion_idx", name.alias("criterion"))), "criterion_idx")
    each = named.groupBy("criterion").agg(F.avg("agreement").alias("agreement"))
    overall = fine.agg(F.lit(None).cast("string").alias("criterion"), F.avg("mean_agreement").alias("agreement"))
    return overall.unionByName(each).orderBy(F.col("criterion").isNotNull(), "agreement", "criterion")


def held_out_validity(reports: DataFrame, labels: DataFrame, criteria: DataFrame, cannot_assess: str = "exclude", exemplars: int = 3) -> tuple[DataFrame, DataFrame]:
    """Per criterion: accuracy, false rates, kappa, coverage and abstention rate over all labelled cells; and
    the first ``exemplars`` disagreements of each, by item."""
    frame = K.cells(reports, labels, criteria)
    used = K.classes(frame, cannot_assess, cannot_assess)
    keys = ["criterion_idx", "scale"]
    rates = A.measured(A.counts(used, keys), keys, F.col("scale") == "ordinal").select(*keys, "n", "accuracy", "kappa", *[F.when(F.col("scale") == "binary", F.col(c)).alias(c) for c in ("fpr", "fnr")])
    t, p = K.abstains()
    failed = F.coalesce("failed", F.lit(False))
    raw = frame.groupBy(*keys).agg(F.count("*").alias("n_paired"), F.count_if(~failed & (t | p)).alias("n_abstained"), F.count_if(~failed & ~t & ~p).alias("n_usable"))
    share = lambda c: F.col(c) / F.col("n_paired").cast("double")
    out = raw.join(rates, keys, "left").withColumn("coverage", share("n_usable")).withColumn("abstention_rate", share("n_abstained"))
    wrong = used.where("t <> p").withColumn("pick", F.row_number().over(Window.partitionBy("criterion_idx").orderBy("item_idx")))
    return out, wrong.where(F.col("pick") <= exemplars).select("criterion_idx", "pick", "item_idx", "pred", "true", "pred_idx", "true_idx")


#: What a rubric of rubrics asks; a user may pass another.
META_RUBRIC = Rubric.from_dict([
    {"name": "clear", "weight": 3.0, "requirement": "Every criterion can be read in one way only."},
    {"name": "single", "weight": 2.0, "requirement": "No criterion asks for two things at once."},
    {"name": "observable", "weight": 2.0, "requirement": "Every criterion can be decided from the submission alone."},
    {"name": "overlapping", "weight": -2.0, "requirement": "Two criteria reward or punish the same thing."},
])


def rubric_submissions(spark: SparkSession, rubrics: list[Rubric], task: str | None = None) -> DataFrame:
    """Rubrics as items to grade: their JSON as the submission, and the task as prompt, if they are to be
    judged in its context."""
    import json

    rows = [(i, json.dumps(r.to_dict()), task) for i, r in enumerate(rubrics)]
    return spark.createDataFrame(rows, "item_idx long, submission string, prompt string")


def evaluate_rubrics(spark: SparkSession, rubrics: list[Rubric], grader, task: str | None = None, meta: Rubric = META_RUBRIC) -> tuple[DataFrame, DataFrame]:
    """(item reports, criterion reports) of rubrics under ``meta``: the pipeline of any other items."""
    return grader.grade(rubric_submissions(spark, rubrics, task), meta.table(spark))


def recent(steps: list, k: int) -> list:
    """The last ``k`` steps of a loop, for a reviser to look back on."""
    return steps[-k:] if k > 0 else []


