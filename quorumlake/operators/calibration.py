"""Calibration of a confidence cascade on two recorded runs, by any metric of the composed cascade.

Cells are counted once, by criterion, the first threshold at which they escalate, truth, and the verdicts of
both runs. From that cube, whose size depends on the rubric and the steps but not on the items, the
confusion matrices of every criterion under any vector of thresholds are put together, so a sweep and a
coordinate ascent over all criteria read no cell again. A metric of item scores is no function of counts: there,
an item's error is a step function of the threshold that varies, and one aggregation sums its steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import CANNOT_ASSESS, MET, UNMET, with_criteria
from .cascade import CELL, SWEEP, paired, undecided
from .scoring import contribution

#: Rows of the cube that the driver takes: a rubric's, not a corpus's.
MAX_CUBE = 2_000_000
SCORE_RMSE = "-score_rmse"


@dataclass(frozen=True)
class Counts:
    """One criterion's confusion matrix, rows truth and columns prediction, by class: UNMET 0, MET 1 and
    CANNOT_ASSESS 2, or options. Cells without a label or a verdict that stands are not in it."""

    key: str
    scale: str
    matrix: np.ndarray
    na: tuple[int, ...] = ()

    def scored(self) -> np.ndarray:
        """The matrix without classes that abstain."""
        keep = [i for i in range(len(self.matrix)) if i not in self.na]
        return self.matrix[np.ix_(keep, keep)]


Metric = Callable[[list[Counts]], float | None]


def _binary(counts: list[Counts]) -> np.ndarray:
    return sum((c.scored() for c in counts if c.scale == "binary"), np.zeros((2, 2)))


def criterion_accuracy(counts: list[Counts]) -> float | None:
    """Of all binary cells; without any, of choices, where NA options count as options."""
    m = _binary(counts)
    if not m.sum():
        hit, n = (sum(f(c.matrix) for c in counts if c.scale != "binary") for f in (np.trace, np.sum))
        return float(hit / n) if n else None
    return float(np.trace(m) / m.sum())


def _rate(top: Callable, bottom: Callable) -> Metric:
    def rate(counts: list[Counts]) -> float | None:
        m = _binary(counts)
        return (float(top(m) / bottom(m)) if bottom(m) else 0.0) if m.sum() else None

    return rate


def kappa(m: np.ndarray, quadratic: bool = False) -> float | None:
    """Cohen's kappa among the classes present; null with fewer than two."""
    on = np.flatnonzero(m.sum(0) + m.sum(1))
    if len(on) < 2:
        return None
    m = m[np.ix_(on, on)]
    i, j = np.indices(m.shape)
    w = (i - j) ** 2 if quadratic else (i != j).astype(float)
    by_chance = (w * np.outer(m.sum(1), m.sum(0))).sum() / m.sum()
    return float(1 - (w * m).sum() / by_chance) if by_chance else None


def mean_kappa(counts: list[Counts]) -> float | None:
    own = [k for c in counts if (k := kappa(c.scored(), c.scale == "ordinal")) is not None]
    return float(np.mean(own)) if own else None


METRICS: dict[str, Metric] = {
    "criterion_accuracy": criterion_accuracy,
    "criterion_precision": _rate(lambda m: m[1, 1], lambda m: m[:, 1].sum()),
    "criterion_recall": _rate(lambda m: m[1, 1], lambda m: m[1].sum()),
    "criterion_f1": _rate(lambda m: 2 * m[1, 1], lambda m: m[:, 1].sum() + m[1].sum()),
    "mean_kappa": mean_kappa,
}


@dataclass
class Plane:
    """The cube of one criterion (all of a name and a form): counts by first threshold, truth and verdict of
    each run, with one more class for none, and sums by first threshold."""

    key: str
    name: str | None
    scale: str
    na: tuple[int, ...]
    kept: np.ndarray
    up: np.ndarray
    #: n, labelled pairs, of these kept pairs with a verdict and right ones, escalated pairs with both verdicts,
    #: right ones of the first and of the second run, and the second run's cost and seconds.
    sums: np.ndarray

    def counts(self, k: int) -> Counts:
        """The cascade's matrix at the k-th threshold: cells whose first is not later escalate."""
        m = self.up[: k + 1].sum(0) + self.kept[k + 1 :].sum(0)
        return Counts(self.key, self.scale, m[:-1, :-1], self.na)

    def stats(self, k: int) -> np.ndarray:
        up, kept = self.sums[: k + 1].sum(0), self.sums[k + 1 :].sum(0)
        return np.array([up[0] + kept[0], up[0], kept[2], kept[3], up[4], up[5], up[6], up[7], up[8]])


def _class(options: Column, verdict: Column, index: Column) -> Column:
    b = F.when(verdict == MET, 1).when(verdict == UNMET, 0).when(verdict == CANNOT_ASSESS, 2)
    return F.coalesce(F.when(options.isNull(), b).otherwise(F.coalesce(index, X.na_index(options))), F.lit(-1)).cast("int")


def first_index(report: str, steps: tuple[float, ...]) -> Column:
    """The place of the first of the rising ``steps`` at which the cell escalates; as many as there are if at none."""
    below = F.filter(F.array(*[F.lit(float(c)) for c in steps]), lambda c: c <= F.col(f"{report}.confidence"))
    return F.when(undecided(report), 0).otherwise(F.size(below)).cast("int")


def _key(criteria: DataFrame) -> DataFrame:
    """``criteria`` with key: the name, which thresholds go by, or the place of a criterion without one."""
    return criteria.withColumn("key", F.coalesce("name", F.concat(F.lit("#"), F.col("criterion_idx"))))


def _both(dm: DataFrame, llm: DataFrame, truth: DataFrame, criteria: DataFrame, steps: tuple[float, ...]) -> DataFrame:
    given = truth if "true_idx" in truth.columns else truth.withColumn("true_idx", F.lit(None).cast("int"))
    joined = paired(dm, llm).join(given.select(*CELL, "true", "true_idx"), CELL, "left")
    if "rubric_id" in dm.columns:
        joined = joined.withColumn("rubric_id", F.col("dm.rubric_id"))
    return with_criteria(joined, _key(criteria), "key", "name", "weight", "scale", "options").withColumn("first", first_index("dm", steps))


def _field(df: DataFrame, side: str, name: str) -> Column:
    return F.col(f"{side}.{name}") if name in df.schema[side].dataType.names else F.lit(None)


def cube(dm: DataFrame, llm: DataFrame, truth: DataFrame, criteria: DataFrame, steps: tuple[float, ...] = SWEEP, runs: DataFrame | None = None) -> list[Plane]:
    """The planes of all criteria, in order of first appearance, of runs ``dm`` (the cheap judge's) and ``llm``.

    ``truth`` has the cell, ``true`` (verdict) and, for choices, ``true_idx``; ``runs`` may have item_idx, llm_cost
    and llm_seconds, of which a cell has its share of the item's cells. One shuffle pairs the runs, and counts are
    summed up before the next.
    """
    rising = tuple(sorted(steps))
    own = _both(dm, llm, truth, criteria, rising)
    options = F.col("options")
    cls = lambda side: F.when(F.col(f"{side}.error").isNull(), _class(options, F.col(f"{side}.final_verdict"), _field(own, side, "option_idx").cast("int"))).otherwise(-1)
    placed = own.select(
        "item_idx", "criterion_idx", "key", "name", "scale", "first", _class(options, F.col("true"), F.col("true_idx")).alias("t"), cls("dm").alias("a"), cls("llm").alias("b"),
        F.coalesce(F.size("options"), F.lit(3)).alias("k"), F.coalesce(F.transform(F.filter("options", lambda o: o["na"]), lambda o: o["idx"]), F.when(options.isNull(), F.array(F.lit(2))), F.array().cast("array<int>")).alias("na"),
    )
    share = lambda c: F.lit(0.0)
    if runs is not None:
        per = placed.groupBy("item_idx").agg(F.count("*").alias("cells"))
        placed = placed.join(per.join(runs.select("item_idx", "llm_cost", "llm_seconds"), "item_idx"), "item_idx", "left")
        share = lambda c: F.sum(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("cells")), F.lit(0.0)))
    by = ["key", "name", "scale", "k", "na", "first", "t", "a", "b"]
    summed = placed.groupBy(*by).agg(F.count("*").alias("n"), F.min("criterion_idx").alias("at"), share("llm_cost").alias("cost"), share("llm_seconds").alias("seconds"))
    rows = summed.limit(MAX_CUBE + 1).collect()
    if len(rows) > MAX_CUBE:
        raise ValueError(f"the cube has more than {MAX_CUBE} rows: too many criteria names for one calibration")
    planes: dict[tuple, Plane] = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["key"], r["scale"], r["k"], r["na"])):
        k, na = max(r["k"], *(rr + 1 for rr in (r["t"], r["a"], r["b"]))), tuple(r["na"])
        at = (r["key"], r["scale"], r["k"], na)
        if at not in planes:
            # one more class for an added NA option, one for none
            size = r["k"] + (0 if na else 1) + 1
            shape = (len(rising) + 1, size, size)
            planes[at] = Plane(r["key"], r["name"], r["scale"], na or (r["k"],), np.zeros(shape), np.zeros(shape), np.zeros((shape[0], 9)))
        p, n, f, t, a, b = planes[at], r["n"], r["first"], r["t"], r["a"], r["b"]
        if k > len(p.kept[0]) - 1:
            raise ValueError(f"criterion {r['key']}: class {k - 1} of {r['k']}")
        p.kept[f, t, a] += n
        p.up[f, t, b] += n
        known = t >= 0 and t not in p.na
        first, second = (c >= 0 and c not in p.na for c in (a, b))
        both = known and first and second
        p.sums[f] += [n, n * known, n * (known and first), n * (known and first and a == t), n * both, n * (both and a == t), n * (both and b == t), r["cost"], r["seconds"]]
    return list(planes.values())


class ScoreErrors:
    """Squared errors of the cascade's item scores against ``expected`` (item_idx, score), by threshold."""

    def __init__(self, dm, llm, truth, criteria, expected, steps, strategy="skip", partial_credit=0.5):
        own = _both(dm, llm, truth, criteria, tuple(sorted(steps)))
        parts = own
        for side in ("dm", "llm"):
            idx = _field(own, side, "option_idx").cast("int")
            value = F.coalesce(F.get("options", idx)["value"], F.when(F.col("options").isNotNull(), 0.0))
            seen = parts.withColumns({"final_verdict": F.col(f"{side}.final_verdict"), "na": F.coalesce(F.col(f"{side}.na"), F.lit(False)), "value": value})
            parts = seen.withColumn(f"{side}_part", contribution(strategy, partial_credit)).drop("final_verdict", "na", "value")
        cell = F.struct("first", "key", F.col("weight").alias("w"), F.col("dm_part").alias("a"), F.col("llm_part").alias("b"), F.col("llm.error").isNotNull().alias("failed"))
        per = parts.groupBy("item_idx").agg(F.collect_list(cell).alias("cells"))
        self.items = per.join(expected.select("item_idx", F.col("score").alias("expected")).where("expected is not null"), "item_idx").persist()
        self.k = len(steps)

    def close(self) -> None:
        self.items.unpersist()

    def metric(self, vary: set[str] | None, fixed: dict[str, int]) -> list[float | None]:
        """Minus the RMSE at each threshold of the criteria ``vary`` (None: all but ``fixed``), the others' being ``fixed``."""
        held = F.create_map(*[x for k, v in fixed.items() for x in (F.lit(k), F.lit(v))]) if fixed else F.lit(None).cast("map<string,int>")
        free = (lambda c: c["key"].isin(*sorted(vary))) if vary is not None else (lambda c: F.coalesce(F.try_element_at(held, c["key"]).isNull(), F.lit(True)))
        starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(F.filter("cells", lambda c: free(c) & (c["first"] < self.k)), lambda c: c["first"]))))

        def error(k: Column) -> Column:
            """Squared error, or null without a score."""
            up = lambda c: c["first"] <= F.when(free(c), k).otherwise(F.try_element_at(held, c["key"]))
            chosen = F.transform("cells", lambda c: F.struct(F.when(up(c), c["b"]).otherwise(c["a"]).alias("x"), c["w"].alias("w"), (up(c) & c["failed"]).alias("failed")))
            total = lambda f: F.aggregate(chosen, F.lit(0.0), lambda s, c: s + F.when(c["x"].isNotNull(), f(c)).otherwise(0.0))
            pos, neg = total(lambda c: F.greatest(c["w"], F.lit(0.0))), total(lambda c: F.greatest(-c["w"], F.lit(0.0)))
            clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
            score = F.when(pos > 0, clamp(F.try_divide(total(lambda c: c["x"]), pos))).when(neg > 0, clamp(1 + F.try_divide(total(lambda c: c["x"]), neg))).otherwise(0.0)
            none = F.forall(chosen, lambda c: c["failed"]) | F.forall(chosen, lambda c: c["x"].isNull())
            return F.when(~none, F.pow(score - F.col("expected"), 2))

        stepped = self.items.select(F.transform(starts, lambda k: F.struct(k.alias("k"), error(k).alias("e"))).alias("s"))
        now, before = (lambda i: F.get("s", i)["e"]), (lambda i: F.get("s", i - 1)["e"])
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        change = F.transform("s", lambda x, i: F.struct(x["k"].alias("k"), (zero(x["e"]) - zero(before(i))).alias("d"), (x["e"].isNotNull().cast("int") - before(i).isNotNull().cast("int")).alias("n")))
        rows = stepped.select(F.inline(change)).groupBy("k").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).collect()
        d, n = np.zeros(self.k), np.zeros(self.k)
        for r in rows:
            d[r["k"]], n[r["k"]] = r["d"], r["n"]
        return [-math.sqrt(max(0.0, s) / m) if m else None for s, m in zip(np.cumsum(d), np.cumsum(n))]


def selected(points: list[tuple[float | None, float | None, float]], max_rate: float | None = None, tolerance: float = 0.0) -> int | None:
    """The place of the point (rate, metric, threshold) of least escalation among those within the budget whose metric
    is within ``tolerance`` of the best; ties, to 12 digits, to the higher metric, then the lower threshold, then the
    earlier."""
    own = [(round(r, 12) if r is not None else 0.0, -round(m, 12), t, i) for i, (r, m, t) in enumerate(points) if m is not None and (max_rate is None or (r is not None and r <= max_rate))]
    top = max((-m for _, m, _, _ in own), default=None)
    return min((p for p in own if -p[1] >= top - tolerance), default=(None,) * 4)[3] if own else None


@dataclass
class Calibration:
    """The curve, a dict for each threshold in rising order, the thresholds fitted by name, and what was left out."""

    curve: list[dict]
    fitted: dict[str, float] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        names = ("threshold", "escalation_rate", "kept_accuracy", "escalated_dm_accuracy", "escalated_llm_accuracy", "metric", "cost", "seconds")
        return spark.createDataFrame([tuple(p[c] for c in names) for p in self.curve], ", ".join(f"{c} double" for c in names))

    def best(self, max_rate: float | None = None, tolerance: float = 0.0) -> dict | None:
        at = selected([(p["escalation_rate"], p["metric"], p["threshold"]) for p in self.curve], max_rate, tolerance)
        return None if at is None else self.curve[at] | {"per_criterion": self.fitted or None}


def calibrate(dm: DataFrame, llm: DataFrame, truth: DataFrame, criteria: DataFrame, steps: tuple[float, ...] = SWEEP, metric: str | Metric = "criterion_accuracy",
              per_criterion: bool = False, min_pairs: int = 30, expected: DataFrame | None = None, runs: DataFrame | None = None, strategy: str = "skip",
              partial_credit: float = 0.5, tolerance: float = 0.0) -> Calibration:
    """Measures the cascade at each of ``steps`` and, ``per_criterion``, fits a threshold to each name that has at
    least ``min_pairs`` labelled pairs.

    ``metric``, higher being better, is a name of METRICS or a function of the criteria's Counts under the cascade;
    "-score_rmse" is minus the error of item scores against ``expected``. The fit starts from the threshold that is
    best for all, and each name in turn takes the step that is best for the whole cascade with the others
    where they are. ``runs`` has item_idx, llm_cost, llm_seconds, and dm_cost and dm_seconds, which are paid whatever escalates.
    """
    if not steps or any(not 0 <= s <= 1 for s in steps):
        raise ValueError("steps are thresholds from 0 to 1, one at least")
    if min_pairs < 1:
        raise ValueError(f"min_pairs must be 1 or more, not {min_pairs}")
    if isinstance(metric, str) and metric != SCORE_RMSE and metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join([*METRICS, SCORE_RMSE])} or a function, not {metric!r}")
    if metric == SCORE_RMSE and expected is None:
        raise ValueError(f"{SCORE_RMSE} needs expected scores")
    rising = tuple(sorted(set(float(s) for s in steps)))
    planes = cube(dm, llm, truth, criteria, rising, runs)
    base = (None, None)
    if runs is not None:
        covered = runs.join(dm.select("item_idx").distinct(), "item_idx", "left_semi")
        row = covered.agg(F.sum("dm_cost").alias("cost"), F.sum("dm_seconds").alias("seconds")).first()
        base = (row["cost"] or 0.0, row["seconds"] or 0.0)
    scores = ScoreErrors(dm, llm, truth, criteria, expected, rising, strategy, partial_credit) if metric == SCORE_RMSE else None
    of = METRICS[metric] if isinstance(metric, str) and metric in METRICS else metric

    def at(p: Plane, k: int, fixed: dict[str, int]) -> int:
        return fixed.get(p.key, k)

    def value(got) -> float | None:
        if got is None or (isinstance(got, float) and math.isnan(got)):
            return None
        if isinstance(got, (bool, np.bool_)) or not np.isreal(got):
            raise ValueError(f"metric must give a number or None, not {got!r}")
        return None if math.isnan(float(got)) else float(got)

    def measured(fixed: dict[str, int], vary: str | None = None, start: int = 0) -> list[dict]:
        """A point for each step: of all but ``fixed``, or of ``vary`` alone, the rest being at ``start``."""
        others = {p.key: start for p in planes if p.key != vary} | fixed if vary else fixed
        errors = scores.metric({vary} if vary else None, others) if scores else None
        out = []
        for k, threshold in enumerate(rising):
            s = sum((p.stats(at(p, k, others)) for p in planes), np.zeros(9))
            share = lambda a, b: float(a / b) if b else None
            got = errors[k] if errors else value(of([p.counts(at(p, k, others)) for p in planes]))
            out.append({
                "threshold": threshold, "escalation_rate": share(s[1], s[0]), "kept_accuracy": share(s[3], s[2]), "escalated_dm_accuracy": share(s[5], s[4]),
                "escalated_llm_accuracy": share(s[6], s[4]), "metric": got, "cost": None if base[0] is None else base[0] + float(s[7]), "seconds": None if base[1] is None else base[1] + float(s[8]),
            })
        return out

    pick = lambda points: selected([(p["escalation_rate"], p["metric"], p["threshold"]) for p in points], tolerance=tolerance)
    try:
        points, notes, fitted = measured({}), [], {}
        if per_criterion:
            labelled: dict[str, float] = {}
            for p in planes:
                if p.name is not None:
                    labelled[p.name] = labelled.get(p.name, 0) + p.sums[:, 1].sum()
            if thin := [n for n, m in labelled.items() if m < min_pairs]:
                notes.append(f"fewer than {min_pairs} labelled pairs, so no threshold of their own: {', '.join(thin)}")
            start = pick(points)
            if start is None:
                notes.append("the metric is undefined at every threshold: none is fitted")
            for name in [n for n, m in labelled.items() if m >= min_pairs] if start is not None else []:
                fitted[name] = pick(measured(fitted, name, start))
            if fitted:
                points = measured(fitted)
        return Calibration(points, {n: rising[k] for n, k in fitted.items()}, notes)
    finally:
        if scores:
            scores.close()
