"""Batch evaluation that can be stopped and resumed: what is in the sink is done."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.cascade import escalates
from ..operators.scoring import item_reports, penalised
from ..operators.voting import aggregate_votes, routed_votes
from ..schema import with_criteria, with_rubric
from ..sources import runs
from ..sources.judges import Judge, panel_votes

Keep = Callable[[DataFrame, str], DataFrame]


class Kept:
    """Keeps votes in memory for gradings that are not stored, until ``close``."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(df.persist())
        return df

    def close(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held.clear()

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_) -> None:
        self.close()


@dataclass
class Grader:
    """How cells become reports: judges with weights, strategies, and perhaps a cascade or a penalty.

    ``auto_na`` gives choices without an NA option one, for judges to abstain with. ``thresholds`` are for
    criteria of these names, ``threshold`` for the others.
    """

    judges: list[tuple[Judge, float]]
    binary: str = "majority"
    ordinal: str = "mean"
    nominal: str = "mode"
    abstain: str = "skip"
    partial_credit: float = 0.5
    escalation: list[tuple[Judge, float]] = field(default_factory=list)
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)
    penalty: X.LengthPenalty | None = None
    auto_na: bool = True

    def effective(self, criteria: DataFrame) -> DataFrame:
        """The criteria as judges see them."""
        return criteria.withColumn("options", X.with_na_option(F.col("options"))) if self.auto_na else criteria

    def votes(self, cells: DataFrame, criteria: DataFrame, keep: Keep | None = None) -> DataFrame:
        """Votes of the panel; with a cascade, the unsure cells' votes are superseded by the second panel's.

        ``keep`` stores each panel's votes before anything reads them: both the choice of cells and the
        result do, and a judge may be paid by call. By default they are kept in memory as long as the session is.
        """
        keep = keep or Kept()
        first = keep(routed_votes(panel_votes(cells, self.judges), criteria), "primary")
        if not self.escalation:
            return first
        known = with_criteria(first, criteria, "name", "options")
        na = X.is_na(F.col("verdict"), F.get(F.col("options"), F.col("option_idx"))["na"]) | (F.col("options").isNotNull() & F.col("option_idx").isNull())
        own = F.struct("error", na.alias("na"), "confidence")
        limit = F.lit(float(self.threshold))
        for name, value in self.thresholds.items():
            limit = F.when(F.col("name") == name, float(value)).otherwise(limit)
        up = known.withColumn("_r", own).where(escalates("_r", limit)).select("item_idx", "criterion_idx").distinct()
        again = keep(routed_votes(panel_votes(cells.join(up, ["item_idx", "criterion_idx"], "left_semi"), self.escalation, "escalation"), criteria), "escalation")
        marked = first.join(up.withColumn("_up", F.lit(True)), ["item_idx", "criterion_idx"], "left")
        return marked.withColumn("superseded", F.coalesce("_up", F.lit(False))).drop("_up").unionByName(again)

    def reports(self, votes: DataFrame, criteria: DataFrame) -> DataFrame:
        return aggregate_votes(votes, criteria, self.binary, self.ordinal, self.nominal)

    def cells(self, items: DataFrame, criteria: DataFrame) -> DataFrame:
        """Each item with each criterion of its rubric."""
        own = self.effective(criteria)
        return with_rubric(items, own, *[c for c in own.columns if c not in ("item_idx", "rubric_id", "criterion_idx")])

    def scores(self, reports: DataFrame, items: DataFrame) -> DataFrame:
        out = item_reports(reports, self.abstain, self.partial_credit)
        return out if self.penalty is None else penalised(out, items, self.penalty)

    def grade(self, items: DataFrame, criteria: DataFrame, keep: Keep | None = None) -> tuple[DataFrame, DataFrame]:
        """(item reports, criterion reports) of ``items`` (item_idx and what the judges read). A ``Kept`` that is closed
        afterwards frees the votes."""
        own = self.effective(criteria)
        reports = self.reports(self.votes(self.cells(items, criteria), own, keep), own)
        return self.scores(reports, items), reports


def finished(spark, path: str, run_id: str) -> DataFrame | None:
    """Items of the run that are in the sink."""
    done = runs.read(spark, path, "scores", run_id)
    return None if done is None else done.select("item_idx").distinct()


def evaluate(items: DataFrame, criteria: DataFrame, grader: Grader, path: str, run_id: str) -> DataFrame:
    """Grades the items that the sink does not have yet, appends them, and returns the run's item reports.

    Each panel's votes are written once, as they are cast, then the criteria's reports made of them, then the scores, and
    last the record that commits the attempt: what a stopped attempt wrote is not read, and its items are graded
    again. Tables are partitioned by run and attempt, so reading a run back prunes the others.
    """
    spark = items.sparkSession
    done = finished(spark, path, run_id)
    pending = items if done is None else items.join(done, "item_idx", "left_anti")
    own, attempt = grader.effective(criteria), uuid.uuid4().hex

    def keep(df: DataFrame, name: str) -> DataFrame:
        runs.append(df, path, "votes", run_id, attempt)
        kept = runs.written(spark, path, "votes", run_id, attempt, df.drop("superseded")).where(F.col("role") == name)
        return kept.withColumn("superseded", F.lit(False)).select(*df.columns)

    reports = runs.append(grader.reports(grader.votes(grader.cells(pending, criteria), own, keep), own), path, "reports", run_id, attempt)
    runs.append(grader.scores(reports, pending), path, "scores", run_id, attempt)
    runs.commit(spark, path, run_id, attempt)
    return runs.read(spark, path, "scores", run_id)


def grade_text(spark, text: str, criteria: DataFrame, grader: Grader, prompt: str | None = None, reference: str | None = None) -> tuple[dict, list[dict]]:
    """One submission's report and those of its criteria: the batch pipeline over one row."""
    items = spark.createDataFrame([(0, text, prompt, reference)], "item_idx long, submission string, prompt string, reference_submission string")
    scores, reports = grader.grade(items, criteria)
    return scores.first().asDict(), [r.asDict() for r in reports.drop("options").orderBy("criterion_idx").collect()]


def dataset_hash(items: DataFrame, criteria: DataFrame) -> str:
    """A digest of item contents and criteria that does not depend on row order or partitioning."""
    part = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    a, b = part(items), part(criteria)
    return items.sparkSession.range(1).select(F.substring(F.sha2(F.lit(f"{a['n']}:{a['h']}:{b['n']}:{b['h']}"), 256), 1, 16)).first()[0]


def calibration_fingerprint(items: DataFrame, criteria: DataFrame) -> str:
    """A digest of the contents of items, by their place, and of the requirements that they are graded against:
    it tells two sets of items of one data set apart."""
    content = items.select("item_idx", *[c for c in ("submission", "prompt", "reference_submission") if c in items.columns])
    return dataset_hash(content, criteria.select("criterion_idx", "requirement"))
