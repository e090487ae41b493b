"""Rubric improvement: grade, find issues, revise, accept what is no worse. The reviser is injected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import cells as K
from ..rubric import Rubric
from .runner import Grader, Kept


@dataclass
class Step:
    iteration: int
    rubric: Rubric
    scores: dict[str, float]
    accepted: bool
    issues: list[tuple[str, int]] = field(default_factory=list)


def pareto_accept(before: dict[str, float], after: dict[str, float], tolerance: float = 0.0) -> bool:
    """No measure falls by more than ``tolerance``, and one rises."""
    return all(after[k] >= before[k] - tolerance for k in before) and any(after[k] > before[k] for k in before)


def converged(steps: list[Step], patience: int, target: float | None, key: str) -> bool:
    """The last accepted score reaches the target, or ``patience`` steps in a row were not accepted."""
    best = next((s for s in reversed(steps) if s.accepted), None)
    return (target is not None and best is not None and best.scores[key] >= target) or (len(steps) >= patience and not any(s.accepted for s in steps[-patience:]))


def held_out_scores(reports: DataFrame, labels: DataFrame, criteria: DataFrame) -> tuple[dict[str, float], list[tuple[str, int]]]:
    """Mean accuracy and mean kappa over criteria, and each criterion's number of wrong cells."""
    tp = A.counts(K.classes(K.cells(reports, labels, criteria)), ["criterion_idx", "scale"])
    rows = A.measured(tp, ["criterion_idx", "scale"], F.col("scale") == "ordinal", rates=False).orderBy("criterion_idx").collect()
    mean = lambda c: sum(r[c] or 0.0 for r in rows) / max(1, len(rows))
    wrong = [(str(r["criterion_idx"]), round(r["n"] * (1 - r["accuracy"]))) for r in rows if r["accuracy"] < 1]
    return {"accuracy": mean("accuracy"), "kappa": mean("kappa")}, wrong


def improve(rubric: Rubric, items: DataFrame, labels: DataFrame, grader_for: Callable[[Rubric], Grader], revise: Callable[[Rubric, list[tuple[str, int]]], Rubric],
            iterations: int = 5, patience: int = 2, target: float | None = None, tolerance: float = 0.0, stop: Callable[[list[Step]], bool] | None = None) -> list[Step]:
    """Steps of the loop, the first with the rubric as it came. Each is one grading job. ``stop`` decides
    instead of ``converged``, where given."""
    spark = items.sparkSession
    steps: list[Step] = []
    current, candidate = rubric, rubric
    for k in range(iterations + 1):
        table = candidate.table(spark)
        with Kept() as kept:
            _, reports = grader_for(candidate).grade(items, table, kept)
            scores, wrong = held_out_scores(reports, labels, table)
        last = next((s for s in reversed(steps) if s.accepted), None)
        ok = last is None or pareto_accept(last.scores, scores, tolerance)
        steps.append(Step(k, candidate, scores, ok, wrong))
        current = candidate if ok else current
        if not wrong or (stop(steps) if stop else converged(steps, patience, target, "accuracy")):
            break
        candidate = revise(current, wrong)
        if len(candidate.criteria) != len(current.criteria):
            raise ValueError("a revision must keep the number of criteria")
    return steps


def fill_labels(items: DataFrame, labels: DataFrame, criteria: DataFrame, grader: Grader) -> DataFrame:
    """Labels of all items: those there are, and verdicts for items without, unless a judgment failed."""
    todo = items.join(labels.select("item_idx").distinct(), "item_idx", "left_anti")
    _, reports = grader.grade(todo, criteria)
    failed = reports.where("error is not null").select("item_idx").distinct()
    new = reports.join(failed, "item_idx", "left_anti").select("item_idx", "criterion_idx", F.col("final_verdict").alias("verdict"), "option_idx")
    return labels.select("item_idx", "criterion_idx", "verdict", "option_idx").unionByName(new)
