"""Agreement among judges: Fleiss' kappa and Krippendorff's alpha."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import CANNOT_ASSESS, MET, UNMET, dimension


def rated(votes: DataFrame, criteria: DataFrame, cannot_assess: str = "exclude", superseded: bool = False) -> DataFrame:
    """Votes as categories ``c`` of (item_idx, criterion_idx, judge_id): MET 0, UNMET 1, CANNOT_ASSESS 2 or the
    option's index, an NA option like any other.

    Failed votes are no ratings, and CANNOT_ASSESS is one by the mode: none, UNMET, or a category. Alpha
    keeps superseded votes; Fleiss' kappa, which has no place for missing ones, does not, nor options
    that the author did not write.
    """
    small = dimension(criteria.select("criterion_idx", "scale", F.size("options").alias("_k")))
    own = votes.where("error is null").join(small, "criterion_idx")
    unsure = {"exclude": F.lit(None), "as_unmet": F.lit(1), "as_category": F.lit(2)}[cannot_assess].cast("int")
    binary = F.when(F.col("verdict") == MET, 0).when(F.col("verdict") == UNMET, 1).when(F.col("verdict") == CANNOT_ASSESS, unsure)
    option = F.col("option_idx") if superseded else F.when(F.col("option_idx") < F.col("_k"), F.col("option_idx"))
    out = own.withColumn("c", F.when(F.col("scale") == "binary", binary).otherwise(option)).where("c is not null")
    if not superseded:
        out = out.where(~F.coalesce(F.col("superseded"), F.lit(False)))
    return out.select("item_idx", "criterion_idx", "judge_id", "scale", "c")


def fleiss_kappa(ratings: DataFrame, by: list[str], unit: list[str], n_judges: int) -> DataFrame:
    """Over units that all ``n_judges`` (two at least) rated; null with fewer than two such units or
    when every rating is the same. ``ratings``: by, unit and category c."""
    per = ratings.groupBy(*by, *unit, "c").agg(F.count("*").alias("k"))
    whole = per.withColumn("_n", F.sum("k").over(Window.partitionBy(*by, *unit))).where(F.col("_n") == n_judges)
    r = float(n_judges)
    squares = whole.groupBy(*by, *unit).agg(((F.sum(F.col("k") * F.col("k")) - r) / (r * (r - 1))).alias("pi"))
    mean = squares.groupBy(*by).agg(F.avg("pi").alias("pbar"), F.count("*").alias("units"))
    share = whole.groupBy(*by, "c").agg(F.sum("k").cast("double").alias("kc"))
    chance = share.groupBy(*by).agg((F.sum(F.col("kc") * F.col("kc")) / F.pow(F.sum("kc"), F.lit(2))).alias("pe"))
    joined = mean.join(chance, by) if by else mean.join(chance, F.lit(True))
    return joined.select(*by, "units", F.when(F.col("units") >= 2, F.try_divide(F.col("pbar") - F.col("pe"), 1 - F.col("pe"))).alias("fleiss_kappa"))


def krippendorff_alpha(ratings: DataFrame, by: list[str], unit: list[str], level: str = "nominal") -> DataFrame:
    """Alpha by the coincidence matrix; missing ratings are rows that are not there. Null with fewer
    than two units of two ratings, or one category only. The matrix is built from counts by unit and
    category, so a unit's pairs of judges are never enumerated."""
    per = ratings.groupBy(*by, *unit, "c").agg(F.count("*").alias("k"))
    own = Window.partitionBy(*by, *unit)
    paired = per.withColumn("m", F.sum("k").over(own)).where("m > 1")
    other = paired.select(*by, *unit, F.col("c").alias("c2"), F.col("k").alias("k2"))
    o = paired.join(other, [*by, *unit]).groupBy(*by, "c", "c2").agg(
        F.sum(F.col("k") * (F.col("k2") - (F.col("c") == F.col("c2")).cast("int")) / (F.col("m") - 1).cast("double")).alias("o")
    )
    n_c = paired.groupBy(*by, "c").agg(F.sum("k").cast("double").alias("nc"))
    keys = [F.col(c) for c in by] or [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n_c = n_c.withColumn("up", F.sum("nc").over(order)).withColumn("n", F.sum("nc").over(Window.partitionBy(*keys)))
    a, b = n_c, n_c.select(*by, F.col("c").alias("c2"), F.col("nc").alias("nc2"), F.col("up").alias("up2"))
    grid = a.join(b, by) if by else a.join(b, F.col("c").isNotNull() | F.col("c2").isNotNull())
    if level == "ordinal":
        low, high = F.least("up", "up2"), F.greatest("up", "up2")
        first = F.when(F.col("up") <= F.col("up2"), F.col("nc")).otherwise(F.col("nc2"))
        inside = high - low + first
        delta = F.pow(inside - (F.col("nc") + F.col("nc2")) / 2, F.lit(2))
    elif level == "nominal":
        delta = F.lit(1.0)
    else:
        raise ValueError(f"level must be nominal or ordinal, not {level!r}")
    grid = grid.withColumn("d", F.when(F.col("c") == F.col("c2"), 0.0).otherwise(delta)).join(o, [*by, "c", "c2"], "left")
    sums = grid.groupBy(*by).agg(
        F.sum(F.coalesce("o", F.lit(0.0)) * F.col("d")).alias("num"), F.sum(F.col("nc") * F.col("nc2") * F.col("d")).alias("den"), F.max("n").alias("n")
    )
    units = paired.groupBy(*by).agg(F.countDistinct(*unit).alias("units"))
    joined = sums.join(units, by) if by else sums.join(units, F.lit(True))
    return joined.select(*by, "units", F.when(F.col("units") >= 2, 1 - (F.col("n") - 1) * F.try_divide(F.col("num"), F.col("den"))).alias("alpha"))
