"""Runs that stop between any two writes have every vote, report and score once when they are taken up again."""

from __future__ import annotations

import collections

import pytest

from pyspark.sql import functions as F

from quorumlake.plans import runner
from quorumlake.rubric import Criterion, Rubric
from quorumlake.schema import MET, UNMET
from quorumlake.sources import runs
from quorumlake.sources.judges import RuleJudge


class Stop(Exception):
    pass


def grader():
    """A cheap judge that is never sure of itself, and a second one."""
    return runner.Grader([(RuleJudge("cheap", F.lit(UNMET)), 1.0)], escalation=[(RuleJudge("dear", F.when(F.col("submission") == "good", MET).otherwise(UNMET)), 1.0)])


@pytest.mark.parametrize("stops", [(0, 2), (1, 3, 4)])
def test_stopped_anywhere(spark, tmp_path, monkeypatch, stops):
    rubric = Rubric((Criterion("good?"),)).table(spark)
    items = spark.createDataFrame([(i, ("good", "poor", "poor")[i % 3]) for i in range(12)], "item_idx long, submission string")
    path = str(tmp_path / "runs")
    runner.evaluate(items.where("item_idx < 3"), rubric, grader(), path, "r")
    writes = {"n": 0, "stop": None}

    def counted(own):
        def write(*args, **how):
            if writes["n"] == writes["stop"]:
                raise Stop
            writes["n"] += 1
            return own(*args, **how)

        return write

    monkeypatch.setattr(runs, "append", counted(runs.append))
    monkeypatch.setattr(runs, "commit", counted(runs.commit))
    for stop in stops:
        writes.update(n=0, stop=stop)
        with pytest.raises(Stop):
            runner.evaluate(items, rubric, grader(), path, "r")
    monkeypatch.undo()
    assert runs.manifest(spark, path, "r", 12)["completed"] == 3
    scores = runner.evaluate(items, rubric, grader(), path, "r")
    assert sorted((r.item_idx, r.score) for r in scores.collect()) == [(i, float(i % 3 == 0)) for i in range(12)]
    votes = runs.read(spark, path, "votes", "r").collect()
    assert collections.Counter((v.item_idx, v.judge_id, v.superseded) for v in votes) == collections.Counter(
        [(i, "cheap", True) for i in range(12)] + [(i, "dear", False) for i in range(12)]
    )
    assert sorted(r.item_idx for r in runs.read(spark, path, "reports", "r").collect()) == list(range(12))
    assert runs.manifest(spark, path, "r", 12)["status"] == "completed" and len(runs.committed(spark, path, "r")) == 2
    assert runner.evaluate(items, rubric, grader(), path, "r").count() == 12  # nothing is pending


def test_runs_are_kept_apart(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert runs.read(spark, path, "votes", "a") is None and runs.committed(spark, path, "a") == []
    rows = spark.createDataFrame([(1, 0.5)], "item_idx long, score double")
    assert runs.append(rows, path, "scores", "a").count() == 1
    runs.append(rows, path, "scores", "b", attempt="open")
    assert runs.read(spark, path, "scores", "b") is None
    runs.commit(spark, path, "b", "open")
    assert runs.read(spark, path, "scores", "b").count() == 1 and runs.read(spark, path, "scores", "a").count() == 1


def test_kept_votes_are_freed(spark):
    rubric = Rubric((Criterion("good?"),)).table(spark)
    items = spark.createDataFrame([(0, "good")], "item_idx long, submission string")
    with runner.Kept() as kept:
        scores, _ = grader().grade(items, rubric, kept)
        assert scores.first().score == 1.0 and all(df.is_cached for df in kept.held)
        held = list(kept.held)
    assert held and not any(df.is_cached for df in held)
