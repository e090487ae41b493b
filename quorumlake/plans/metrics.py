"""All metrics of a run against ground truth, as one set of tables over two frames of cells."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import agreement as A
from ..operators import bootstrap as B
from ..operators import cells as K
from ..operators import correlation as R
from ..operators import distribution as D
from ..operators import irr as I
from ..operators import pooled as P
from ..operators import sampling as T
from ..operators import scoring as S


@dataclass
class Metrics:
    """Result tables; ``warnings`` says what was left out. With rubrics that differ between items there is
    no table by criterion: ``pooled`` holds the points of all of them."""

    score: DataFrame
    criterion: DataFrame | None = None
    option: DataFrame | None = None
    confusion: DataFrame | None = None
    aggregate: DataFrame | None = None
    judge: DataFrame | None = None
    judge_aggregate: DataFrame | None = None
    judge_score: DataFrame | None = None
    coverage: DataFrame | None = None
    abstentions: DataFrame | None = None
    pooled: DataFrame | None = None
    bootstrap: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)

    def to_dataframe(self) -> DataFrame:
        """One flat table with a ``level`` column: aggregate, criterion, judge or pooled."""
        levels = (("aggregate", self.aggregate), ("criterion", self.criterion), ("judge", self.judge), ("pooled", self.pooled))
        tagged = [df.withColumn("level", F.lit(level)) for level, df in levels if df is not None]
        out = tagged[0]
        for df in tagged[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out

    def to_file(self, path: str | Path) -> None:
        """The tables, which have a row per criterion, judge or option, as one JSON document."""
        import json

        names = ("score", "criterion", "option", "confusion", "aggregate", "judge", "judge_aggregate", "judge_score", "coverage", "abstentions", "pooled", "bootstrap")
        tables = {n: [r.asDict(recursive=True) for r in df.collect()] for n in names if (df := getattr(self, n)) is not None}
        Path(path).write_text(json.dumps(tables | {"warnings": self.warnings}, indent=1, default=str), encoding="utf-8")

    def summary(self) -> str:
        """A few lines of text; the tables have a row per criterion or judge."""
        shown = self.aggregate if self.aggregate is not None else self.pooled
        lines = [", ".join(f"{k} {v:.4f}" if isinstance(v, float) else f"{k} {v}" for k, v in r.asDict().items()) for r in shown.collect()]
        if self.criterion is not None:
            lines += [f"criterion {r['criterion_idx']}: n {r['n']}, accuracy {r['accuracy']}, kappa {r['kappa']}" for r in self.criterion.orderBy("criterion_idx").collect()]
        return "\n".join([*lines, *self.warnings])


def criterion_table(classed: DataFrame, by: list[str]) -> DataFrame:
    """n, accuracy, adjacent, kappa (weighted on ordinal scales), errors and correlations of option values, and
    rates of binary criteria, by criterion and ``by``."""
    keys = [*by, "criterion_idx", "scale"]
    out = A.measured(A.counts(classed, keys), keys, F.col("scale") == "ordinal")
    rates = [F.when(F.col("scale") == "binary", F.col(c)).alias(c) for c in ("precision", "recall", "f1", "fpr", "fnr", "phi")]
    out = out.select(*keys, "n", "accuracy", F.when(F.col("scale") == "ordinal", F.col("adjacent")).alias("adjacent"), "kappa", X.kappa_band(F.col("kappa")).alias("kappa_band"), "rmse", "mae", *rates)
    own = classed.where("scale = 'ordinal'")
    for f in (R.spearman, R.kendall):
        out = out.join(f(own, [*by, "criterion_idx"], "pred_value", "true_value").drop("n"), [*by, "criterion_idx"], "left")
    return out


def aggregate_table(classed: DataFrame, raw: DataFrame, criterion: DataFrame, by: list[str]) -> DataFrame:
    """Pooled binary measures and the means over criteria, by ``by``. Without binary pairs, accuracy is that of
    the judged choices, NA options included, and the binary measures are null."""
    level = [*by, "_all"]
    binary = classed.where("scale = 'binary'").withColumn("_all", F.lit(0))
    pooled = A.measured(A.counts(binary, level), level).select(*level, "n", "accuracy", "precision", "recall", "f1", "phi", F.col("kappa").alias("micro_kappa"))
    choice = K.judged(raw).where("options is not null and pred_idx is not null and true_idx is not null").withColumn("_all", F.lit(0))
    choices = choice.groupBy(*level).agg(F.count("*").alias("_n"), F.avg((F.col("pred_idx") == F.col("true_idx")).cast("double")).alias("_a"))
    means = criterion.withColumn("_all", F.lit(0)).groupBy(*level).agg(F.avg("accuracy").alias("macro_accuracy"), F.avg("kappa").alias("mean_kappa"))
    out = means.join(pooled, level, "left").join(choices, level, "left")
    return out.withColumns({"n": F.coalesce("n", "_n"), "accuracy": F.coalesce("accuracy", "_a")}).drop("_n", "_a", "_all")


def score_table(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Errors, bias and rank correlations of (pred, true) scores, by ``by``."""
    own = pairs.withColumn("_all", F.lit(0))
    keys = [*by, "_all"]
    out = D.score_errors(own, keys).join(D.bias(own, keys).drop("n"), keys)
    for f in (R.pearson, R.spearman, R.kendall):
        out = out.join(f(own, keys, "pred", "true").drop("n"), keys, "left")
    return out.drop("_all")


def compute_metrics(reports: DataFrame, votes: DataFrame, labels: DataFrame, criteria: DataFrame, judges: DataFrame, cannot_assess: str = "exclude", na: str = "exclude",
                    replicates: int = 0, seed: int = 0, graded: DataFrame | None = None) -> Metrics:
    """Metrics of ``reports`` (and of each judge's ``votes``) on the labelled cells.

    Criteria with rubric_id or item_idx are several rubrics: where those of the items differ in structure, rubric points
    are pooled. ``graded`` are items with a result, be it without a report: see ``cells.cells``. An NA
    option that the grader added counts as one where a judged cell names it.
    """
    known = K.resolved_labels(labels, criteria)
    frame = K.cells(reports, known, criteria, graded)
    notes = _notes(reports, labels, known, frame)
    pairs = S.item_reports(reports).select("item_idx", F.col("score").alias("pred")).join(S.label_scores(known, criteria).select("item_idx", F.col("score").alias("true")), "item_idx")
    pairs = pairs.where("pred is not null and true is not null")
    score = score_table(pairs, [])
    if P.heterogeneous(criteria, frame):
        notes.append("items have rubrics of their own: rubric points are pooled, and there is no table by criterion")
        return Metrics(score, pooled=P.pooled(frame), warnings=notes)
    grid = K.judge_cells(votes, known, criteria, judges)
    own_criteria, criteria = criteria, P.common_rubric(criteria)
    shown = K.effective_criteria(criteria, frame, grid)
    frame, grid = K.with_effective_options(frame, shown), K.with_effective_options(grid, shown)
    classed, judged = K.classes(frame, cannot_assess, na), K.classes(grid, cannot_assess, na)
    criterion = criterion_table(classed, [])
    n_judges = judges.count()
    rated = I.rated(votes, criteria, cannot_assess)
    paired = I.rated(votes, shown, cannot_assess, superseded=True)
    ordinal = F.col("scale") == "ordinal"
    alpha = I.krippendorff_alpha(paired.where(~ordinal), ["criterion_idx"], ["item_idx"]).unionByName(I.krippendorff_alpha(paired.where(ordinal), ["criterion_idx"], ["item_idx"], "ordinal"))
    criterion = criterion.join(alpha.select("criterion_idx", "alpha"), "criterion_idx", "left")
    if n_judges > 1:
        criterion = criterion.join(I.fleiss_kappa(rated, ["criterion_idx"], ["item_idx"], n_judges).select("criterion_idx", "fleiss_kappa"), "criterion_idx", "left")
    aggregate = aggregate_table(classed, frame, criterion, []).join(criterion.agg(F.avg("alpha").alias("mean_alpha")), F.lit(True), "left")
    tp = A.counts(classed, ["criterion_idx"])
    sizes = shown.select("criterion_idx", F.col("options").isNotNull().alias("_choice"), F.coalesce(F.size("options"), F.lit(3 if cannot_assess == "as_category" else 2)).alias("_k"))
    sized = tp.join(F.broadcast(sizes), "criterion_idx")  # as many rows as a rubric has criteria
    by_judge = criterion_table(judged, ["judge_id"])
    own = S.judge_scores(votes, own_criteria).select("item_idx", "judge_id", F.col("score").alias("pred")).join(pairs.select("item_idx", "true"), "item_idx").where("pred is not null")
    boot = None
    if replicates:
        reps = B.replicate_metrics(classed, replicates, seed)
        boot = B.interval(reps, "accuracy", "mean_kappa").unionByName(B.interval(B.replicate_errors(pairs, replicates, seed), "rmse"))
    for r in T.degenerate(classed).orderBy("criterion_idx").collect():
        notes.append(f"criterion {r['criterion_idx']}: all {r['n']} labels are of one class")
    if pairs.select("true").distinct().limit(3).count() <= 2:
        notes.append("expected scores have at most two different values: correlations of scores say little")
    covered = A.coverage(frame, ["criterion_idx"]) if cannot_assess == na == "exclude" else None
    return Metrics(
        score, criterion, A.per_option(sized.where("_choice"), ["criterion_idx", "_k"], F.col("_k")).drop("_k"), A.confusion(sized, ["criterion_idx", "_k"], F.col("_k")).drop("_k"),
        aggregate, by_judge, aggregate_table(judged, grid, by_judge, ["judge_id"]), score_table(own, ["judge_id"]), covered,
        A.abstention_agreement(frame, ["scale"]), None, boot, notes,
    )


def _notes(reports: DataFrame, labels: DataFrame, known: DataFrame, frame: DataFrame) -> list[str]:
    """What metrics leave out."""
    out = []
    counted = lambda df: df.distinct().count()
    if lost := counted(labels.select("item_idx").join(known.select("item_idx"), "item_idx", "left_anti")):
        out.append(f"{lost} items were left out: a label is no verdict or option of its criterion")
    for r in K.item_sets(reports, labels).groupBy("where").count().orderBy("where").collect():
        out.append(f"{r['count']} items are in {'the results' if r['where'] == 'results only' else 'the labels'} only")
    errored = K.errored_items(reports)
    if n := errored.join(labels.select("item_idx").distinct(), "item_idx", "left_semi").count():
        out.append(f"{n} labelled items were left out: every judgment failed")
    if n := frame.where("failed").join(errored, "item_idx", "left_anti").count():
        out.append(f"{n} failed judgments were left out")
    return out
