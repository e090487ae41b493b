"""Score distributions: errors, bias, summary statistics, earth mover's and Kolmogorov-Smirnov distance."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import special
from .ordered import edges, percentiles, running


def score_errors(pairs: DataFrame, by: list[str], pred: str = "pred", true: str = "true") -> DataFrame:
    d = F.col(pred) - F.col(true)
    return pairs.groupBy(*by).agg(F.count(d).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def bias(pairs: DataFrame, by: list[str], pred: str = "pred", true: str = "true") -> DataFrame:
    """Mean difference, its standard deviation (n - 1), t statistic, effect size and direction."""
    d = F.col(pred) - F.col(true)
    s = pairs.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("std_diff"))
    m, sd = F.col("mean_diff"), F.col("std_diff")
    return s.withColumn("t", F.try_divide(m * F.sqrt(F.col("n").cast("double")), sd)).withColumn("effect", F.try_divide(m, sd)).withColumn(
        "direction", F.when(m > 0.001, "positive").when(m < -0.001, "negative").when(m.isNotNull(), "none")
    )


def with_test(biased: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds p-value, confidence interval of the mean difference and the effect's band to rows of ``bias``,
    of which there is one per group. No spread: p is 1 without a difference, else 0."""

    @F.pandas_udf("p_value double, low double, high double")
    def tested(n: pd.Series, m: pd.Series, sd: pd.Series, t: pd.Series) -> pd.DataFrame:
        out = []
        for k, mean, s, stat in zip(n, m, sd, t):
            if k < 2 or pd.isna(s):
                out.append((None, None, None))
                continue
            half = special.t_quantile(0.5 + level / 2, k - 1) * s / math.sqrt(k)
            out.append((special.t_two_sided(stat, k - 1) if s else float(mean == 0), mean - half, mean + half))
        return pd.DataFrame(out, columns=["p_value", "low", "high"], dtype=float)

    return biased.withColumn("_t", tested("n", "mean_diff", "std_diff", "t")).select(*biased.columns, "_t.*", X.effect_band(F.col("effect")).alias("band"))


def unpaired_bias(a: DataFrame, b: DataFrame, by: list[str], column: str = "x") -> DataFrame:
    """Difference of means of two groups of scores that are no pairs, its standard error, t, Welch's degrees
    of freedom and the effect by the pooled deviation."""
    side = lambda df, x: df.groupBy(*by).agg(F.count(column).alias(f"n{x}"), F.avg(column).alias(f"m{x}"), F.var_samp(column).alias(f"v{x}"))
    s = side(a, "a").join(side(b, "b"), by) if by else side(a, "a").join(side(b, "b"), F.lit(True))
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    pooled = F.sqrt(F.try_divide((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"), F.col("na") + F.col("nb") - 2))
    diff = F.col("ma") - F.col("mb")
    freedom = F.try_divide((ea + eb) * (ea + eb), ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1))
    return s.select(*by, "na", "nb", diff.alias("mean_diff"), F.sqrt(ea + eb).alias("std_error"), F.try_divide(diff, F.sqrt(ea + eb)).alias("t"),
                    freedom.alias("df"), F.try_divide(diff, pooled).alias("effect"))


def score_distribution(values: DataFrame, by: list[str], column: str = "x") -> DataFrame:
    """n, mean, sd and variance (n - 1), extremes, linear percentiles, interquartile range, biased
    skewness (n > 2) and excess kurtosis (n > 3)."""
    x = F.col(column)
    q = percentiles(values, by, column, (0.25, 0.5, 0.75))
    s = values.where(x.isNotNull()).groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"),
    )
    s = s.join(q, by) if by else s.join(q, F.lit(True))
    return s.select(
        *by, "n", "mean", "std", "variance", "min", "max", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"),
        (F.col("q")[2] - F.col("q")[0]).alias("iqr"), F.when(F.col("n") > 2, F.col("skew")).alias("skewness"), F.when(F.col("n") > 3, F.col("kurt")).alias("kurtosis"),
    )


def histogram(values: DataFrame, by: list[str], column: str = "x", low: float = 0.0, high: float = 1.0, bins: int = 10) -> DataFrame:
    """Counts of equal bins from ``low`` to ``high``; the last one holds ``high`` too."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return values.where(F.col(column).between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def _steps(values: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Both cumulative distributions at each distinct value, and the distance to the next one."""
    long = values.select(*by, F.explode(F.array(F.struct(F.col(a).alias("v"), F.lit(1).alias("a")), F.struct(F.col(b).alias("v"), F.lit(0).alias("a")))).alias("s"))
    at = long.where(F.col("s.v").isNotNull()).groupBy(*by, F.col("s.v").alias("v")).agg(F.sum("s.a").alias("na"), F.sum(1 - F.col("s.a")).alias("nb"))
    run = running(at, by, "v", ["na", "nb"], edges(at, "v")[0], follow=True)
    share = lambda c: F.try_divide((F.col(f"{c}_before") + F.col(c)).cast("double"), F.col(f"{c}_all"))
    return run.select(*by, "v", (share("na") - share("nb")).alias("gap"), (F.col("_next") - F.col("v")).alias("step"))


def distances(values: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Earth mover's distance and Kolmogorov-Smirnov statistic of two columns, from one table of their
    distinct values."""
    return _steps(values, by, a, b).groupBy(*by).agg(
        F.sum(F.abs("gap") * F.coalesce("step", F.lit(0.0))).alias("emd"), F.max(F.abs("gap")).alias("ks")
    )


def earth_movers(values: DataFrame, by: list[str], a: str, b: str, normalize: bool = True) -> DataFrame:
    """emd, mean_diff and std_diff (population) of ``a`` less ``b``, bias_direction (higher, lower or none, within
    0.01), bias_magnitude and interpretation. ``normalize`` scales both by the range that they have together, which
    changes nothing where that is 0. Null where a side has no value.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = values.groupBy(*by).agg(
        F.count(x).alias("na"), F.count(y).alias("nb"), F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.stddev_pop(x).alias("sa"), F.stddev_pop(y).alias("sb"),
        (F.greatest(F.max(x), F.max(y)) - F.least(F.min(x), F.min(y))).alias("range"),
    )
    moved = distances(values, by, a, b).select(*by, "emd")
    joined = s.join(moved, by, "left") if by else s.join(moved, F.lit(True), "left")
    scale = F.when(F.col("range") > 0, F.col("range")).otherwise(1.0) if normalize else F.lit(1.0)
    there = (F.col("na") > 0) & (F.col("nb") > 0)
    diff = F.when(there, (F.col("ma") - F.col("mb")) / scale)
    emd = F.when(there, F.col("emd") / scale)
    return joined.select(
        *by, emd.alias("emd"), diff.alias("mean_diff"), F.when(there, (F.col("sa") - F.col("sb")) / scale).alias("std_diff"),
        F.when(diff > 0.01, "higher").when(diff < -0.01, "lower").otherwise("none").alias("bias_direction"), F.abs(diff).alias("bias_magnitude"),
        F.when(there, X.emd_band(emd)).otherwise("insufficient data").alias("interpretation"),
    )


def ks_p(statistic: float, n: int, m: int) -> float:
    return special.kolmogorov_p(statistic, n * m / (n + m))


def ks_normal(values: DataFrame, column: str = "x") -> dict:
    """One-sample statistic against the normal of the same mean and population deviation, and its p.

    The distribution is compared at the distinct values; the normal CDF is an Arrow function of them.
    """
    at = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("k"))
    s = values.agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_pop(column).alias("sd")).first()
    if not s["n"] or not s["sd"]:
        return {"statistic": None, "p_value": None}
    m, sd = s["m"], s["sd"]

    @F.pandas_udf("double")
    def cdf(v: pd.Series) -> pd.Series:
        return v.map(lambda x: special.normal_cdf((x - m) / sd))

    up = running(at, [], "v", ["k"], edges(at, "v")[0]).withColumn("up", (F.col("k_before") + F.col("k")) / s["n"]).withColumn("c", cdf("v"))
    d = up.agg(F.max(F.greatest(F.abs(F.col("up") - F.col("c")), F.abs(F.col("c") - (F.col("up") - F.col("k") / s["n"]))))).first()[0]
    return {"statistic": d, "p_value": special.kolmogorov_p(d, s["n"])}
