"""Agreement with ground truth. Everything here is computed from one table of counts by (t, p).

A group's counts are collected into one array of at most classes * classes entries, and every measure
is an expression over that array: no measure joins or shuffles the counts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

_M = "_m"


def counts(classed: DataFrame, by: list[str]) -> DataFrame:
    """The sufficient statistics: rows of each (t, p) within ``by``, and d, by how much the options' values
    differ, where the values are known."""
    valued = {"pred_value", "true_value"} <= set(classed.columns)
    d = F.max(F.col("pred_value") - F.col("true_value")) if valued else F.max(F.lit(None).cast("double"))
    return classed.groupBy(*by, "t", "p").agg(F.count("*").alias("n"), d.alias("d"))


def matrices(tp: DataFrame, by: list[str]) -> DataFrame:
    """One row per group with its counts as an array of (t, p, n, d)."""
    d = F.col("d") if "d" in tp.columns else F.lit(None).cast("double")
    return tp.groupBy(*by).agg(F.collect_list(F.struct("t", "p", F.col("n").cast("double").alias("n"), d.alias("d"))).alias(_M))


def _total(weight) -> Column:
    """The sum of ``weight`` of each entry of the array."""
    return F.aggregate(F.col(_M), F.lit(0.0), lambda s, x: s + weight(x))


def _share(part, whole: Column) -> Column:
    return F.try_divide(_total(lambda x: F.when(part(x), x["n"]).otherwise(0.0)), whole)


def n_of() -> Column:
    return _total(lambda x: x["n"])


def accuracy_of() -> Column:
    return _share(lambda x: x["t"] == x["p"], n_of())


def adjacent_of() -> Column:
    return _share(lambda x: F.abs(x["t"] - x["p"]) <= 1, n_of())


def kappa_of(weights: str | Column = "none") -> Column:
    """Cohen's kappa, null where fewer than two classes are present. ``quadratic`` weights by squared
    distance of the ranks of the classes present on either side; a boolean Column says where to do so."""
    square = F.lit(weights == "quadratic") if isinstance(weights, str) else weights
    present = F.array_sort(F.array_distinct(F.concat(F.transform(_M, lambda x: x["t"]), F.transform(_M, lambda x: x["p"]))))
    rank = lambda c: F.array_position(present, c).cast("double")
    n = n_of()
    moment = lambda side, k: _total(lambda x: x["n"] * (rank(x[side]) if k == 1 else rank(x[side]) * rank(x[side])))
    away = _total(lambda x: x["n"] * (rank(x["t"]) - rank(x["p"])) * (rank(x["t"]) - rank(x["p"])))
    chance = n * moment("t", 2) + n * moment("p", 2) - 2 * moment("t", 1) * moment("p", 1)
    unlike = _total(lambda x: F.when(x["t"] == x["p"], 0.0).otherwise(x["n"]))
    side = lambda name, c: F.aggregate(F.filter(_M, lambda x: x[name] == c), F.lit(0.0), lambda s, x: s + x["n"])
    by_class = n * n - F.aggregate(present, F.lit(0.0), lambda s, c: s + side("t", c) * side("p", c))
    return F.when(F.size(present) >= 2, 1 - F.when(square, F.try_divide(away * n, chance)).otherwise(F.try_divide(unlike * n, by_class)))


def rates_of(positive: int = 1, undefined: str = "zero") -> list[Column]:
    """2 x 2 counts of ``positive`` against the rest, precision, recall and F1, false rates and phi.

    Precision, recall and F1 are 0 at a zero denominator, or, with ``undefined`` null, as a 2 x 2 report
    has them, null; false rates are null at one, and phi where a side is constant.
    """
    cell = lambda t, p: _total(lambda x: F.when(((x["t"] == positive) == t) & ((x["p"] == positive) == p), x["n"]).otherwise(0.0))
    tp, fp, fn, tn = cell(True, True), cell(False, True), cell(True, False), cell(False, False)
    share = lambda a, b: F.try_divide(a, b) if undefined == "null" else F.coalesce(F.try_divide(a, b), F.lit(0.0))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return [
        *(c.cast("long").alias(n) for n, c in (("tp", tp), ("fp", fp), ("fn", fn), ("tn", tn))),
        share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(fp, fp + tn).alias("fpr"), F.try_divide(fn, fn + tp).alias("fnr"), F.try_divide(tp * tn - fp * fn, root).alias("phi"),
    ]


def errors_of() -> list[Column]:
    """RMSE and MAE of the options' values; null for criteria without options."""
    known = _total(lambda x: F.when(x["d"].isNotNull(), x["n"]).otherwise(0.0))
    mean = lambda f: F.try_divide(_total(lambda x: F.coalesce(x["n"] * f(x["d"]), F.lit(0.0))), known)
    return [F.sqrt(mean(lambda d: d * d)).alias("rmse"), mean(F.abs).alias("mae")]


def measured(tp: DataFrame, by: list[str], weights: str | Column = "none", rates: bool = True) -> DataFrame:
    """n, accuracy, adjacent, kappa, rmse and mae of option values and, with ``rates``, those of
    ``rates_of``: one row per group."""
    cols = [*errors_of(), n_of().cast("long").alias("n"), accuracy_of().alias("accuracy"), adjacent_of().alias("adjacent"), kappa_of(weights).alias("kappa")]
    return matrices(tp, by).select(*by, *cols, *(rates_of() if rates else []))


def accuracy(tp: DataFrame, by: list[str]) -> DataFrame:
    """n, exact and adjacent (classes at most one apart) agreement."""
    return matrices(tp, by).select(*by, n_of().cast("long").alias("n"), accuracy_of().alias("accuracy"), adjacent_of().alias("adjacent"))


def binary_rates(tp: DataFrame, by: list[str], positive: int = 1, undefined: str = "zero") -> DataFrame:
    return matrices(tp, by).select(*by, *rates_of(positive, undefined))


def kappa(tp: DataFrame, by: list[str], weights: str = "none") -> DataFrame:
    return matrices(tp, by).select(*by, kappa_of(weights).alias("kappa"))


def per_option(tp: DataFrame, by: list[str], n_classes: Column) -> DataFrame:
    """One row per option, whether it occurs or not: precision, recall, F1 (0 at a zero denominator) and
    the supports of truth and prediction. ``n_classes`` is a Column over ``by``."""
    each = matrices(tp, by).withColumn("class", F.explode(F.sequence(F.lit(0), n_classes - 1)))
    c = F.col("class")
    nt, np_ = (_total(lambda x, s=side: F.when(x[s] == c, x["n"]).otherwise(0.0)) for side in "tp")
    hit = _total(lambda x: F.when((x["t"] == c) & (x["p"] == c), x["n"]).otherwise(0.0))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return each.select(*by, "class", zero(hit, np_).alias("precision"), zero(hit, nt).alias("recall"), zero(2 * hit, nt + np_).alias("f1"),
                       nt.cast("long").alias("support"), np_.cast("long").alias("support_pred"))


def confusion(tp: DataFrame, by: list[str], n_classes: Column) -> DataFrame:
    """Every cell of the matrix, also those without rows; ``n_classes`` is a Column over ``by``."""
    every = F.sequence(F.lit(0), n_classes - 1)
    grid = matrices(tp, by).withColumn("t", F.explode(every)).withColumn("p", F.explode(every))
    n = _total(lambda x: F.when((x["t"] == F.col("t")) & (x["p"] == F.col("p")), x["n"]).otherwise(0.0))
    return grid.select(*by, "t", "p", n.cast("long").alias("n"))


def coverage(frame: DataFrame, by: list[str]) -> DataFrame:
    """Cells, failed cells, pairs without an abstention, and the share of these among the judged. An empty
    ``by`` pools all cells."""
    from .cells import abstains

    t, p = abstains()
    failed = F.coalesce(F.col("failed"), F.lit(False))
    if "missing" in frame.columns:
        failed = failed | F.col("missing")
    out = frame.groupBy(*by).agg(F.count("*").alias("n_cells"), F.count_if(failed).alias("n_failed"), F.count_if(~failed & ~t & ~p).alias("n_used"))
    return out.withColumn("coverage", F.try_divide(F.col("n_used").cast("double"), F.col("n_cells") - F.col("n_failed")))


def abstention_agreement(frame: DataFrame, by: list[str]) -> DataFrame:
    """Of judged cells: how many abstain on each side and on one only, and kappa of abstaining, with its band."""
    from .cells import abstains, judged

    t, p = abstains()
    own = judged(frame).withColumns({"t": t.cast("int"), "p": p.cast("int")})
    side = lambda on: _total(lambda x: F.when(on(x), x["n"]).otherwise(0.0)).cast("long")
    out = matrices(counts(own, by), by).select(
        *by, side(lambda x: x["t"] == 1).alias("count_true"), side(lambda x: x["p"] == 1).alias("count_pred"),
        side(lambda x: (x["p"] == 1) & (x["t"] == 0)).alias("false_positive"), side(lambda x: (x["p"] == 0) & (x["t"] == 1)).alias("false_negative"),
        kappa_of().alias("kappa"),
    )
    return out.withColumn("band", X.kappa_band(F.col("kappa")))


def macro(frame: DataFrame, column: str, name: str) -> DataFrame:
    """Unweighted mean of the defined values of a per-criterion table."""
    return frame.agg(F.avg(column).alias(name))
