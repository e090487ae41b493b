"""Pearson, Spearman and Kendall correlation of two columns, by group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.special import correlation_p
from .ordered import concordance, edges, running


def _r(x: Column, y: Column) -> Column:
    """Pearson's r, null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def pearson(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """n and r; null with fewer than three pairs."""
    own = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return own.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, _r(F.col(x), F.col(y))).alias("pearson"))


def _counted(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    own = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return own.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("w"))


def _ranked(counted: DataFrame, by: list[str], column: str, cuts: list[float]) -> DataFrame:
    """Average rank of each distinct value: ranks are taken over distinct values and their counts."""
    total = counted.groupBy(*by, column).agg(F.sum("w").alias("wv"))
    return running(total, by, column, ["wv"], cuts).select(*by, column, (F.col("wv_before") + (F.col("wv") + 1) / 2).alias(f"r{column}"))


def spearman(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """n and rho, Pearson's r of average ranks weighted by counts; null as for Pearson."""
    counted = _counted(pairs, by, x, y)
    cut_x, cut_y = edges(counted, "x", "y")
    ranked = counted.join(_ranked(counted, by, "x", cut_x), [*by, "x"]).join(_ranked(counted, by, "y", cut_y), [*by, "y"])
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    s = ranked.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab")
    )
    n = F.col("n")
    rho = F.try_divide(n * F.col("sab") - F.col("sa") * F.col("sb"), F.sqrt((n * F.col("saa") - F.col("sa") * F.col("sa")) * (n * F.col("sbb") - F.col("sb") * F.col("sb"))))
    return s.select(*by, "n", F.when(n >= 3, rho).alias("spearman"))


def kendall(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """n and tau-b from the table of distinct (x, y) and their counts, in n log n of these."""
    counted = _counted(pairs, by, x, y)
    s = concordance(counted, by)
    n = counted.groupBy(*by).agg(F.sum("w").alias("n"))
    half = lambda c: counted.groupBy(*by, c).agg(F.sum("w").alias("w")).groupBy(*by).agg((F.sum(F.col("w") * (F.col("w") - 1)) / 2).alias(f"t{c}"))
    out = n
    for part in (s, half("x"), half("y")):
        out = out.join(part, by) if by else out.join(part, F.lit(True))
    all_ = F.col("n") * (F.col("n") - 1) / 2
    tau = F.try_divide(F.col("s"), F.sqrt((all_ - F.col("tx")) * (all_ - F.col("ty"))))
    return out.select(*by, "n", F.when(F.col("n") >= 3, tau).alias("kendall"))


def with_p(result: DataFrame, column: str) -> DataFrame:
    """Adds the two-sided p-value of a coefficient and its band; the table has a row per group."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or b < 3 else correlation_p(a, b) for a, b in zip(r, n)], dtype=float)

    return result.withColumn("p_value", p(F.col(column).cast("double"), "n")).withColumn("band", X.correlation_band(F.col(column)))
