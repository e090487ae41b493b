"""Confidence cascade: a cheap judge decides, cells it is unsure of go to other judges.

Replay and calibration work on two recorded runs. Thresholds are a column, so a sweep is one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import dimension

CELL = ["item_idx", "criterion_idx"]
SWEEP = tuple(round(0.02 * k, 2) for k in range(51))




def undecided(report: str) -> Column:
    """Whether the cheap judge's report (a struct column) failed, abstained or has no confidence."""
    return F.col(f"{report}.error").isNotNull() | F.coalesce(F.col(f"{report}.na"), F.lit(False)) | F.col(f"{report}.confidence").isNull()


def escalates(report: str, threshold: Column) -> Column:
    return undecided(report) | (F.col(f"{report}.confidence") < threshold)


def threshold_of(criteria: DataFrame, default: float, per_name: dict[str, float] | None = None) -> DataFrame:
    """(criterion_idx, threshold): that of the criterion's name, else the default. Unknown names are an error."""
    per_name = per_name or {}
    for v in (default, *per_name.values()):
        if not 0 <= v <= 1:
            raise ValueError(f"threshold {v} is outside 0 to 1")
    names = {r[0] for r in criteria.select("name").distinct().collect()}
    if unknown := sorted(set(per_name) - names):
        raise ValueError(f"no criterion is named {', '.join(unknown)}")
    picked = F.lit(float(default))
    for name, v in per_name.items():
        picked = F.when(F.col("name") == name, float(v)).otherwise(picked)
    return criteria.select("criterion_idx", picked.alias("threshold"))


def paired(dm: DataFrame, llm: DataFrame) -> DataFrame:
    """Cells of both runs side by side; a cell that only one of them has is an error."""
    a = dm.select(*CELL, F.struct(*[c for c in dm.columns if c not in CELL]).alias("dm"))
    b = llm.select(*CELL, F.struct(*[c for c in llm.columns if c not in CELL]).alias("llm"))
    both = a.join(b, CELL, "full")
    fine = F.col("dm").isNotNull() & F.col("llm").isNotNull()
    return both.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("cell in one run only: "), F.concat_ws(":", *CELL)))))


def replay(dm: DataFrame, llm: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The cascade's reports: the other run's on escalated cells, the cheap judge's elsewhere.

    ``thresholds`` has criterion_idx and threshold, and may have more columns that name a setting:
    each setting is replayed. Both runs have confidence, error, na and the columns of a report.
    """
    both = paired(dm, llm).join(dimension(thresholds), "criterion_idx")
    fields = [f for f in dm.columns if f not in CELL and f in llm.columns]
    settings = [c for c in thresholds.columns if c != "criterion_idx"]
    pick = lambda f: F.when(F.col("escalated"), F.col(f"llm.{f}")).otherwise(F.col(f"dm.{f}")).alias(f)
    return both.withColumn("escalated", escalates("dm", F.col("threshold"))).select(*settings, *CELL, "escalated", *[pick(f) for f in fields])


def sweep(dm: DataFrame, llm: DataFrame, truth: DataFrame, steps: tuple[float, ...] = SWEEP, cost_dm: float = 1.0, cost_llm: float = 10.0) -> DataFrame:
    """One row per threshold: escalation rate, accuracies of kept and of escalated cells and of the
    cascade, and cost per cell. ``truth`` has the cell and its verdict ``true``; unlabelled cells
    count for rate and cost only.

    Whether a cell escalates depends on one number, so cells are first summed up by the index of the
    first threshold at which they do; thresholds then meet a table of at most ``len(steps) + 1`` rows.
    """
    cuts = sorted(steps)
    first = F.when(undecided("dm"), 0).otherwise(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("dm.confidence"))))
    both = paired(dm, llm).join(truth.select(*CELL, "true"), CELL, "left").withColumn("first", first)
    known = F.col("true").isNotNull()
    hit = lambda side: F.count_if(known & (F.col(f"{side}.final_verdict") == F.col("true")))
    summed = both.groupBy("first").agg(F.count("*").alias("n"), F.count_if(known).alias("known"), hit("dm").alias("dm_hit"), hit("llm").alias("llm_hit"))
    at = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("threshold"), F.lit(k).alias("k")) for k, c in enumerate(cuts)]))
    each = summed.withColumn("at", at).select("at.*", "first", "n", "known", "dm_hit", "llm_hit")
    up = F.col("first") <= F.col("k")
    s = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(0))
    t = each.groupBy("threshold").agg(
        F.sum("n").alias("n"), s("n", up).alias("n_escalated"), s("known", ~up).alias("kept_known"), s("dm_hit", ~up).alias("kept_hit"),
        s("known", up).alias("esc_known"), s("dm_hit", up).alias("esc_dm_hit"), s("llm_hit", up).alias("esc_llm_hit"),
    )
    share = lambda a, b: F.try_divide(a.cast("double"), b)
    c = F.col
    return t.select(
        "threshold", share(c("n_escalated"), c("n")).alias("escalation_rate"), share(c("kept_hit"), c("kept_known")).alias("kept_accuracy"),
        share(c("esc_dm_hit"), c("esc_known")).alias("escalated_dm_accuracy"), share(c("esc_llm_hit"), c("esc_known")).alias("escalated_llm_accuracy"),
        share(c("kept_hit") + c("esc_llm_hit"), c("kept_known") + c("esc_known")).alias("metric"),
        (F.lit(float(cost_dm)) + cost_llm * share(c("n_escalated"), c("n"))).alias("cost"),
    )


def best(curve: DataFrame, max_rate: float | None = None, tolerance: float = 0.0) -> DataFrame:
    """The point of least escalation among those within the budget whose metric is within
    ``tolerance`` of the best; ties to the higher metric, then the lower threshold."""
    own = curve.where(F.col("metric").isNotNull())
    if max_rate is not None:
        own = own.where(F.col("escalation_rate") <= max_rate)
    top = own.withColumn("_best", F.max("metric").over(Window.partitionBy(F.lit(0)))).where(F.col("metric") >= F.col("_best") - tolerance).drop("_best")
    return top.orderBy("escalation_rate", F.desc("metric"), "threshold").limit(1)


def fitted_thresholds(dm: DataFrame, llm: DataFrame, truth: DataFrame, criteria: DataFrame, min_pairs: int = 20, tolerance: float = 0.0,
                      steps: tuple[float, ...] = SWEEP, metric: str | Callable = "criterion_accuracy") -> dict[str, float]:
    """A threshold for each named criterion with at least ``min_pairs`` labelled pairs, by coordinate ascent on the
    cascade's ``metric``: see ``calibration.calibrate``, which measures the curve too."""
    from .calibration import calibrate

    return calibrate(dm, llm, truth, criteria, steps, metric, per_criterion=True, min_pairs=min_pairs, tolerance=tolerance).fitted
