"""Cells: predictions joined to ground truth, and the ways abstentions enter metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..schema import CANNOT_ASSESS, MET, UNMET, cell_keys, dimension, with_criteria

KEYS = ["item_idx", "criterion_idx"]
MODES = ("exclude", "as_unmet", "as_category")


def resolved_labels(labels: DataFrame, criteria: DataFrame) -> DataFrame:
    """Labels with an item dropped whole if one of its labels is no verdict or no option index."""
    fine = F.when(F.col("options").isNull(), F.col("verdict").isin(MET, UNMET, CANNOT_ASSESS)).otherwise(
        (F.col("option_idx") >= 0) & (F.col("option_idx") < F.size("options"))
    )
    checked = with_criteria(labels, criteria, "options").withColumn("_fine", F.coalesce(fine, F.lit(False)))
    whole = F.bool_and("_fine").over(Window.partitionBy("item_idx"))
    return checked.withColumn("_whole", whole).where("_whole").select(*labels.columns)


def cells(reports: DataFrame, labels: DataFrame, criteria: DataFrame, graded: DataFrame | None = None) -> DataFrame:
    """One row per labelled, reported cell: scale, pred and true (verdicts), pred_idx and true_idx
    (options), failed, and the values of both.

    ``graded`` (item_idx) are items of which a result is there: a labelled one without any report counts as UNMET
    on binary criteria, and as no option, which is an abstention, on choices.
    """
    left = reports.select(*KEYS, F.col("final_verdict").alias("pred"), F.col("option_idx").alias("pred_idx"), F.col("error").isNotNull().alias("failed"))
    right = labels.select(*cell_keys(labels), F.col("verdict").alias("true"), F.col("option_idx").alias("true_idx"))
    both = left.join(right, KEYS)
    if graded is not None:
        bare = graded.select("item_idx").distinct().join(reports.select("item_idx").distinct(), "item_idx", "left_anti")
        verdict = F.when(F.col("true").isNotNull(), UNMET)
        both = both.unionByName(right.join(bare, "item_idx").withColumns({"pred": verdict, "pred_idx": F.lit(None).cast("int"), "failed": F.lit(False)}))
    joined = with_criteria(both, criteria, "scale", "weight", "options")
    value = lambda i: X.option_value(F.col("options"), F.col(i))
    return joined.withColumn("pred_value", value("pred_idx")).withColumn("true_value", value("true_idx"))


def judge_cells(votes: DataFrame, labels: DataFrame, criteria: DataFrame, judges: DataFrame) -> DataFrame:
    """The same for every judge, on the full grid of labelled cells and judges: a cell without a vote
    is ``missing``. Superseded votes count for the judge that cast them."""
    grid = labels.select(*cell_keys(labels), F.col("verdict").alias("true"), F.col("option_idx").alias("true_idx")).withColumn(
        "judge_id", F.explode(F.array(*[F.lit(r["judge_id"]) for r in judges.select("judge_id").orderBy("judge_id").collect()]))
    )
    cast = votes.select(*KEYS, "judge_id", F.col("verdict").alias("pred"), F.col("option_idx").alias("pred_idx"), F.col("error").isNotNull().alias("failed"), F.lit(True).alias("_there"))
    joined = with_criteria(grid.join(cast, [*KEYS, "judge_id"], "left"), criteria, "scale", "weight", "options")
    value = lambda i: X.option_value(F.col("options"), F.col(i))
    return joined.withColumn("missing", F.col("_there").isNull()).drop("_there").withColumn("pred_value", value("pred_idx")).withColumn("true_value", value("true_idx"))


def judged(frame: DataFrame) -> DataFrame:
    """Cells whose judgment did not fail and is there: a failed judgment is no abstention."""
    out = frame.where(~F.coalesce(F.col("failed"), F.lit(False)))
    return out.where(~F.col("missing")) if "missing" in frame.columns else out


def item_sets(results: DataFrame, items: DataFrame) -> DataFrame:
    """(item_idx, where): items that only the results or only the data set has."""
    a, b = results.select("item_idx").distinct(), items.select("item_idx").distinct()
    return a.join(b, "item_idx", "left_anti").withColumn("where", F.lit("results only")).unionByName(b.join(a, "item_idx", "left_anti").withColumn("where", F.lit("items only")))


def errored_items(reports: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Items whose every judgment failed, and those of ``errors`` (item_idx, error)."""
    own = reports.groupBy("item_idx").agg(F.bool_and(F.col("error").isNotNull()).alias("_all")).where("_all").select("item_idx")
    return own if errors is None else own.unionByName(errors.where("error is not null").select("item_idx")).distinct()


def _na(index: str) -> Column:
    return F.col(index).isNull() | F.coalesce(F.get(F.col("options"), F.col(index))["na"], F.lit(True))


def classes(frame: DataFrame, cannot_assess: str = "exclude", na: str = "exclude") -> DataFrame:
    """Judged cells with t and p, the class numbers of truth and prediction.

    Binary: UNMET 0, MET 1, CANNOT_ASSESS 2; choices: the option index. ``exclude`` drops pairs with
    an abstention, ``as_unmet`` turns it into UNMET or the worst scored option, ``as_category`` keeps it.
    """
    for mode in (cannot_assess, na):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    if na == "as_category":  # an NA option has no place in an order
        ordinal_na = (F.col("scale") == "ordinal") & (_na("true_idx") | _na("pred_idx"))
        frame = frame.withColumn("scale", F.when(F.coalesce(ordinal_na, F.lit(False)) & ~F.coalesce(F.col("failed"), F.lit(False)), F.raise_error(F.lit("NA as a category of an ordinal criterion"))).otherwise(F.col("scale")))
    binary = F.col("options").isNull()
    code = lambda c: F.when(F.col(c) == MET, 1).when(F.col(c) == UNMET, 0).otherwise(2)
    worst = X.worst_scored(F.col("options"), F.col("weight"))
    noted = judged(frame).withColumn("_nt", F.when(binary, F.col("true") == CANNOT_ASSESS).otherwise(_na("true_idx"))).withColumn(
        "_np", F.when(binary, F.col("pred") == CANNOT_ASSESS).otherwise(_na("pred_idx"))
    )

    def number(verdict: str, index: str, is_na: str) -> Column:
        b = F.when(F.col(is_na) & F.lit(cannot_assess == "as_unmet"), 0).otherwise(code(verdict))
        na_option = F.coalesce(X.na_index(F.col("options")), F.size("options"))
        m = F.when(F.col(is_na), worst if na == "as_unmet" else na_option).otherwise(F.col(index))
        return F.when(binary, b).otherwise(m).cast("int")

    drop = (F.col("_nt") | F.col("_np")) & F.when(binary, F.lit(cannot_assess == "exclude")).otherwise(F.lit(na == "exclude"))
    return noted.where(~drop).withColumn("t", number("true", "true_idx", "_nt")).withColumn("p", number("pred", "pred_idx", "_np")).drop("_nt", "_np")


def abstains() -> tuple[Column, Column]:
    """Whether truth and prediction of a cell abstain."""
    binary = F.col("options").isNull()
    t = F.when(binary, F.col("true") == CANNOT_ASSESS).otherwise(_na("true_idx"))
    p = F.when(binary, F.col("pred") == CANNOT_ASSESS).otherwise(_na("pred_idx"))
    return F.coalesce(t, F.lit(False)), F.coalesce(p, F.lit(False))


def abstentions(frame: DataFrame, by: list[str]) -> DataFrame:
    """Counts of abstentions on both sides of judged cells, by ``by``."""
    t, p = abstains()
    return judged(frame).groupBy(*by).agg(
        F.count_if(t & p).alias("both"), F.count_if(~t & p).alias("only_predicted"), F.count_if(t & ~p).alias("only_true"), F.count_if(~t & ~p).alias("neither")
    )


def effective_criteria(criteria: DataFrame, *frames: DataFrame) -> DataFrame:
    """Choices get the added NA option where a judged cell of ``frames`` names it, or chose no option.

    A grader that may add an NA option puts it after the author's options, so an index past these, or none,
    is what tells that it was shown. Failed cells, which no metric reads, tell nothing.
    """
    needs = None
    for f in frames:
        past = lambda c: F.col(c).isNull() | (F.col(c) >= F.size("options"))
        true_past = F.coalesce(F.col("true_idx") >= F.size("options"), F.lit(False))
        own = judged(f).where("options is not null").groupBy("criterion_idx").agg(F.bool_or(past("pred_idx") | true_past).alias("needs"))
        needs = own if needs is None else needs.unionByName(own)
    per = needs.groupBy("criterion_idx").agg(F.bool_or("needs").alias("needs"))
    return criteria.join(per, "criterion_idx", "left").withColumn("options", F.when(F.coalesce("needs", F.lit(False)), X.with_na_option(F.col("options"))).otherwise(F.col("options"))).drop("needs")


def with_effective_options(frame: DataFrame, effective: DataFrame) -> DataFrame:
    """Cells under the effective criteria: no option chosen is the NA option, where there is one."""
    own = frame.drop("options").join(dimension(effective.select("criterion_idx", "options")), "criterion_idx")
    na = X.na_index(F.col("options"))
    fill = lambda c: F.when(F.col("options").isNotNull(), F.coalesce(c, na))
    value = lambda i: X.option_value(F.col("options"), F.col(i))
    return own.withColumn("pred_idx", fill("pred_idx")).withColumns({"pred_value": value("pred_idx"), "true_value": value("true_idx")})
