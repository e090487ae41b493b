"""Rubrics by content: shared and own rubrics of data sets meet the grader, labels and metrics alike."""

from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F

from quorumlake.operators import cells, decision, pooled, scoring
from quorumlake.plans import metrics, runner
from quorumlake.schema import MET, UNMET, with_criteria
from quorumlake.sources import datasets
from quorumlake.sources.judges import NoisyJudge, RuleJudge


def a(requirement, **more):
    return {"requirement": requirement, **more}


def judge():
    own = RuleJudge("j", F.when(F.col("submission").contains("good"), MET).otherwise(UNMET), F.when(F.col("options").isNotNull(), 1))
    return runner.Grader([(own, 1.0)], auto_na=False)


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("data")
    choice = a("how", options=[{"label": "No", "value": 0}, {"label": "Yes", "value": 1}])
    shared = [a("x", weight=3), a("y", weight=1)]
    first = {"prompt": "p", "rubric": shared, "items": [
        {"submission": "good", "ground_truth": ["MET", "UNMET"]}, {"submission": "bad", "rubric": [choice], "ground_truth": ["yes"]},
        {"submission": "good", "rubric": {"criteria": shared}, "ground_truth": ["MET", "MET"]}]}
    second = {"prompt": "q", "rubric": [a("z")], "items": [{"submission": "bad", "ground_truth": ["MET"]}]}
    for name, data in (("d", first), ("e", second)):
        (path / f"{name}.json").write_text(json.dumps(data, indent=1))
    return lambda **how: datasets.read_dataset(spark, str(path), **how), path


def test_shared_and_own_rubrics_are_graded(spark, read):
    got = datasets.read_dataset(spark, str(read[1] / "d.json"))
    items, criteria, labels = (got[k].cache() for k in ("items", "criteria", "labels"))
    ids = {r.item_idx: r.rubric_id for r in items.collect()}
    assert ids[0] == ids[2] != ids[1] and criteria.count() == 3  # the same rubric in another form is the same
    scores, reports = judge().grade(items, criteria)
    assert {r.item_idx: r.score for r in scores.collect()} == {0: 1.0, 1: 1.0, 2: 1.0}
    known = cells.resolved_labels(labels, criteria)
    assert known.count() == labels.count() == 5
    assert {r.item_idx: r.score for r in scoring.label_scores(known, criteria).collect()} == {0: 0.75, 1: 1.0, 2: 1.0}
    got = metrics.compute_metrics(reports, judge().votes(judge().cells(items, criteria), criteria), labels, criteria, spark.createDataFrame([("j",)], "judge_id string"))
    rows = {r["of"]: r for r in got.pooled.collect()}
    assert rows["binary"]["n"] == 4 and rows["ordinal"]["n"] == 1 and rows["all"]["accuracy"] == 0.8


def test_files_are_kept_apart(spark, read):
    got = read[0](across_files=True)
    items = got["items"].collect()
    assert len({r.item_idx for r in items}) == 4 and max(r.item_idx for r in items) == 1 << 32
    scores, reports = judge().grade(got["items"], got["criteria"])
    assert {r.item_idx: r.score for r in scores.collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 1 << 32: 0.0}
    assert reports.groupBy("item_idx").count().where("item_idx = 0").first()["count"] == 2


def test_rubrics_of_one_structure_have_one_table(spark, tmp_path):
    """Another weight is no other structure; another label, requirement or scale is."""
    def grades(other):
        data = {"prompt": "p", "rubric": [a("x"), a("y", options=[{"label": "No", "value": 0}, {"label": "Yes", "value": 1}])], "items": [
            {"submission": "good", "ground_truth": ["MET", "Yes"]}, {"submission": "bad", "rubric": other, "ground_truth": ["MET", other[1]["options"][1]["label"]]}]}
        (tmp_path / "d.json").write_text(json.dumps(data))
        got = datasets.read_dataset(spark, str(tmp_path / "d.json"))
        assert got["items"].select("rubric_id").distinct().count() == 2
        return got, pooled.heterogeneous(got["criteria"])

    two = lambda *labels, **how: {"requirement": "y", "options": [{"label": x, "value": k} for k, x in enumerate(labels)], **how}
    assert grades([a("x"), two("No", "Yea")])[1] and grades([a("z"), two("No", "Yes")])[1] and grades([a("x"), two("No", "Yes", scale_type="nominal")])[1]
    got, differ = grades([a("x", weight=-2), two("No", "Yes")])
    assert not differ
    noisy = runner.Grader([(judge().judges[0][0], 1.0), (NoisyJudge(judge().judges[0][0], "k", 0.5), 1.0)], auto_na=False)
    votes = noisy.votes(noisy.cells(got["items"], got["criteria"]), got["criteria"])
    table = metrics.compute_metrics(noisy.reports(votes, got["criteria"]), votes, got["labels"], got["criteria"], spark.createDataFrame([("j",), ("k",)], "judge_id string"))
    assert table.pooled is None and {r.criterion_idx: r.n for r in table.criterion.collect()} == {0: 2, 1: 2}


def test_requests_ask_the_own_rubric(spark, read):
    got = datasets.read_dataset(spark, str(read[1] / "d.json"))
    asked = {r.item_idx: [q["requirement"] for q in json.loads(r.questions)] for r in decision.requests(got["items"], got["criteria"]).collect()}
    assert asked == {0: ["x", "y"], 1: ["how"], 2: ["x", "y"]}


def test_frames_without_rubrics_are_refused(spark, read):
    got = datasets.read_dataset(spark, str(read[1] / "d.json"))
    with pytest.raises(ValueError, match="rubric_id"):
        with_criteria(got["labels"].drop("rubric_id"), got["criteria"], "weight")


def test_items_without_a_report_count_as_unmet(spark, read):
    got = datasets.read_dataset(spark, str(read[1] / "d.json"))
    _, reports = judge().grade(got["items"].where("item_idx = 2"), got["criteria"])
    graded = spark.createDataFrame([(0,), (1,), (2,)], "item_idx long")
    frame = cells.cells(reports, got["labels"], got["criteria"], graded).collect()
    assert {(r.item_idx, r.criterion_idx, r.pred, r.pred_idx) for r in frame} == {(0, 0, UNMET, None), (0, 1, UNMET, None), (1, 0, None, None), (2, 0, MET, None), (2, 1, MET, None)}
