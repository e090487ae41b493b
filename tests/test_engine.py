"""Known answers and tie rules of the evaluation engine."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quorumlake import schema
from quorumlake.functions import exprs as X
from quorumlake.functions import content, prompts, special
from quorumlake.operators import agreement, bootstrap, cascade, cells, correlation, distribution, irr, sampling, scoring, voting
from quorumlake.plans import improve, metrics, runner, validation
from quorumlake.rubric import Criterion, Option, Rubric
from quorumlake.sources import configs, datasets, judges, runs
from quorumlake.streaming import votes as stream

STANDARD = (Option("bad", 0.0), Option("fair", 0.5), Option("good", 1.0), Option("none", 0.0, True))


def matrix_frame(spark, m):
    rows = [(t, p, n) for t, row in enumerate(m) for p, n in enumerate(row) if n]
    return spark.createDataFrame(rows, "t int, p int, n long").withColumn("g", F.lit(0))


@pytest.mark.parametrize(
    "matrix, weights, exact, adjacent, kappa",
    [
        ([[70, 2], [11, 17]], "none", 0.87, None, 0.642464),
        ([[16, 4, 0, 0], [3, 7, 8, 15], [0, 1, 0, 27], [0, 0, 0, 19]], "quadratic", 0.42, 0.85, 0.648320),
        ([[13, 5, 1, 0], [4, 3, 7, 13], [1, 0, 2, 31], [0, 0, 0, 20]], "quadratic", 0.38, 0.85, 0.624561),
        ([[2, 0, 0], [1, 1, 0], [0, 2, 0]], "quadratic", 0.5, 1.0, 0.571429),
    ],
)
def test_published_matrices(spark, matrix, weights, exact, adjacent, kappa):
    tp = matrix_frame(spark, matrix)
    row = agreement.accuracy(tp, ["g"]).join(agreement.kappa(tp, ["g"], weights), "g").first()
    assert row["accuracy"] == pytest.approx(exact) and row["kappa"] == pytest.approx(kappa, abs=1e-6)
    assert adjacent is None or row["adjacent"] == pytest.approx(adjacent)


def test_kappa_of_one_class_is_null(spark):
    assert agreement.kappa(matrix_frame(spark, [[5]]), ["g"]).first()["kappa"] is None


def test_alpha_and_fleiss(spark):
    table = [[1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None], [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3], [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None], [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None]]
    rows = [(0, u, c) for judge in table for u, c in enumerate(judge) if c is not None]
    frame = spark.createDataFrame(rows, "g int, u int, c int")
    assert irr.krippendorff_alpha(frame, ["g"], ["u"]).first()["alpha"] == pytest.approx(0.7434, abs=1e-4)
    assert irr.krippendorff_alpha(frame, ["g"], ["u"], "ordinal").first()["alpha"] == pytest.approx(0.8154, abs=1e-4)
    counts = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]
    votes = [(0, u, c) for u, row in enumerate(counts) for c, n in enumerate(row) for _ in range(n)]
    assert irr.fleiss_kappa(spark.createDataFrame(votes, "g int, u int, c int"), ["g"], ["u"], 14).first()["fleiss_kappa"] == pytest.approx(0.2099, abs=1e-4)
    assert irr.krippendorff_alpha(frame.withColumn("c", F.lit(1)), ["g"], ["u"]).first()["alpha"] is None


def vote_rows(spark, rows):
    """(criterion, judge weight, verdict, option, error) of one item."""
    full = [(0, c, f"j{k}", k, float(w), "primary", v, o, e, None, None, None, False) for k, (c, w, v, o, e) in enumerate(rows)]
    return spark.createDataFrame(full, schema.VOTES)


def test_majority_ignores_weights(spark):
    rubric = Rubric((Criterion("a", 10.0),)).table(spark)
    own = vote_rows(spark, [(0, 3, "UNMET", None, None), (0, 1, "MET", None, None), (0, 1, "MET", None, None)])
    assert voting.aggregate_votes(own, rubric).first()["final_verdict"] == "MET"
    assert voting.aggregate_votes(own, rubric, binary="weighted").first()["final_verdict"] == "UNMET"


@pytest.mark.parametrize("weight, verdict, option", [(5.0, "UNMET", 0), (-5.0, "MET", 1)])
def test_ties_go_to_the_worst_case(spark, weight, verdict, option):
    rubric = Rubric((Criterion("a", weight), Criterion("b", weight, options=STANDARD))).table(spark)
    own = vote_rows(spark, [(0, 1, "MET", None, None), (0, 1, "UNMET", None, None), (1, 1, None, 0, None), (1, 1, None, 1, None)])
    got = {r["criterion_idx"]: r for r in voting.aggregate_votes(own, rubric).collect()}
    assert got[0]["final_verdict"] == verdict
    assert got[1]["option_idx"] == option and got[1]["aggregated_value"] == 0.25


def test_failures_are_routed(spark):
    rubric = Rubric((Criterion("a", -5.0), Criterion("b", options=STANDARD), Criterion("c", options=STANDARD[:3]))).table(spark)
    raw = vote_rows(spark, [(c, 1, None, None, e) for c in range(3) for e in ("infrastructure: x", "unknown: y")])
    got = {(r["criterion_idx"], r["error"][:3]): (r["verdict"], r["option_idx"]) for r in voting.routed_votes(raw, rubric).collect()}
    assert got == {(0, "inf"): ("CANNOT_ASSESS", None), (0, "unk"): ("MET", None), (1, "inf"): (None, 3), (1, "unk"): (None, 0), (2, "inf"): (None, None), (2, "unk"): (None, 0)}


@pytest.mark.parametrize(
    "strategy, normalized, raw",
    [("skip", 10 / 10, 10.0), ("zero", 10 / 15, 10.0), ("partial", 12.5 / 15, 12.5), ("fail", (10 - 4) / 15, 6.0)],
)
def test_scoring_matrix(spark, strategy, normalized, raw):
    """A met +10, an abstained +5 and an abstained -4 criterion."""
    rubric = Rubric((Criterion("a", 10.0), Criterion("b", 5.0), Criterion("c", -4.0))).table(spark)
    own = vote_rows(spark, [(0, 1, "MET", None, None), (1, 1, "CANNOT_ASSESS", None, None), (2, 1, "CANNOT_ASSESS", None, None)])
    row = scoring.item_reports(voting.aggregate_votes(own, rubric), strategy).first()
    assert row["score"] == pytest.approx(normalized) and row["raw_score"] == pytest.approx(raw)


@pytest.mark.parametrize("weight, verdict, want", [(-4.0, "MET", 0.0), (-4.0, "UNMET", 1.0), (0.0, "MET", 0.0), (3.0, "CANNOT_ASSESS", None)])
def test_score_edges(spark, weight, verdict, want):
    rubric = Rubric((Criterion("a", weight),)).table(spark)
    assert scoring.item_reports(voting.aggregate_votes(vote_rows(spark, [(0, 1, verdict, None, None)]), rubric)).first()["score"] == want


def test_all_failed_has_no_score(spark):
    rubric = Rubric((Criterion("a"),)).table(spark)
    row = scoring.item_reports(voting.aggregate_votes(voting.routed_votes(vote_rows(spark, [(0, 1, None, None, "unknown: x")]), rubric), rubric)).first()
    assert row["score"] is None and row["error"] and row["raw_score"] is None


def test_weighted_kappa_skips_unused_classes(spark):
    used = agreement.kappa(matrix_frame(spark, [[3, 0, 1], [0, 0, 0], [1, 0, 3]]), ["g"], "quadratic").first()["kappa"]
    assert used == pytest.approx(agreement.kappa(matrix_frame(spark, [[3, 1], [1, 3]]), ["g"], "quadratic").first()["kappa"])


def test_correlations(spark):
    x, y = [1, 2, 3, 4, 5, 6], [1.0, 2.0, 2.0, 5.0, 4.0, 6.0]
    frame = spark.createDataFrame([(0, float(a), b) for a, b in zip(x, y)], "g int, x double, y double")
    assert correlation.kendall(frame, ["g"]).first()["kendall"] == pytest.approx(12 / math.sqrt(15 * 14))
    assert correlation.spearman(frame, ["g"]).first()["spearman"] == pytest.approx(0.9276336, abs=1e-6)
    assert correlation.with_p(correlation.pearson(frame, ["g"]), "pearson").first()["p_value"] < 0.05
    assert correlation.pearson(frame.withColumn("x", F.lit(1.0)), ["g"]).first()["pearson"] is None
    assert correlation.pearson(frame.limit(2), ["g"]).first()["pearson"] is None


def test_special_functions():
    assert special.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert special.kolmogorov_p(1.3581 / 10, 100) == pytest.approx(0.05, abs=1e-4)


@pytest.mark.parametrize("text, thinking, output", [
    ("<thinking>ABC</thinking><output>DEF</output>", "ABC", "DEF"), ("Just output", "", "Just output"), ("<THINKING> a\nb </thinking> Rest ", "a\nb", "Rest"), ("", "", ""), (" x ", "", " x "),
])
def test_sections(spark, text, thinking, output):
    row = spark.createDataFrame([(text,)], "t string").select(X.thinking_section(F.col("t")).alias("a"), X.output_section(F.col("t")).alias("b")).first()
    assert (row["a"], row["b"]) == (thinking, output)


def test_length_penalty(spark):
    p = X.LengthPenalty(free_budget=2, max_cap=4, penalty_at_cap=0.5, exponent=2.0)
    rows = [(t, None if t == "a b c d e" else 0.3) for t in ("a b", "a b c", "a b c d e")]
    frame = spark.createDataFrame(rows, "t string, s double").withColumn("p", p.of(F.lit(""), F.col("t"))).withColumn("s2", p.apply(F.col("s"), F.col("p")))
    assert [r["p"] for r in frame.collect()] == [0.0, 0.125, 0.5]
    assert [r["s2"] for r in frame.collect()] == [0.3, pytest.approx(0.175), None]


def test_word_count_is_unicode(spark):
    texts = ["a b", "a b\x85c", "", "  ", "x\x1cy"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.word_count(F.col("t"))).collect()]
    assert got == [len(t.split()) for t in texts]


def test_rubric_forms_and_checks(tmp_path, spark):
    flat = [{"requirement": "a", "weight": 3}, {"requirement": "b"}]
    for form in (flat, {"criteria": flat}, {"sections": [{"criteria": flat[:1]}, {"criteria": flat[1:]}]}, {"rubric": {"sections": [{"criteria": flat}]}, "guidelines": " "}):
        own = Rubric.from_json(json.dumps(form))
        assert [c.weight for c in own.criteria] == [3.0, 10.0] and own.guidelines is None
    with pytest.raises(ValueError, match="criterion 1"):
        Rubric.from_dict([{"requirement": "a"}, {"weight": 1}])
    with pytest.raises(ValueError, match="differ"):
        Criterion("a", options=(Option("x"), Option(" X ")))
    (tmp_path / "r.json").write_text(json.dumps(flat))
    assert Rubric.from_file(tmp_path / "r.json") == Rubric.from_dict(flat)
    bad = Rubric.from_dict(flat).table(spark).withColumn("scale", F.lit("odd"))
    with pytest.raises(ValueError, match="unknown scale"):
        schema.checked_criteria(bad)


def test_dataset_round_trip(spark, tmp_path):
    rubric = [{"requirement": "a"}, {"requirement": "b", "options": [{"label": o.label, "value": o.value, "na": o.na} for o in STANDARD]}]
    data = {"prompt": "p", "rubric": rubric, "items": [{"submission": "s0", "ground_truth": ["MET", " GOOD "]}, {"submission": "s1", "prompt": "own"}]}
    (tmp_path / "d.json").write_text(json.dumps(data, indent=1))
    got = datasets.read_dataset(spark, str(tmp_path / "d.json"))
    assert [(r["submission"], r["prompt"]) for r in got["items"].orderBy("item_idx").collect()] == [("s0", "p"), ("s1", "own")]
    assert [(r["verdict"], r["option_idx"]) for r in got["labels"].orderBy("criterion_idx").collect()] == [("MET", None), (None, 2)]
    assert got["criteria"].count() == 2


def test_dataset_with_guidelines_is_written_and_read(spark, tmp_path):
    choice = {"name": "c", "weight": 2.5, "requirement": "b", "options": [{"label": o.label, "value": o.value, "na": o.na} for o in STANDARD], "scale_type": "nominal"}
    shared = {"guidelines": "be strict", "criteria": [{"requirement": "a"}, choice]}
    sections = {"rubric": {"sections": [{"criteria": [{"requirement": "x"}]}, {"criteria": [choice, {"requirement": "z", "weight": -1}]}]}, "guidelines": "own"}
    data = {"name": "d", "prompt": "p", "rubric": shared, "items": [
        {"submission": "s0", "ground_truth": ["MET", " GOOD "], "ground_truth_reasons": ["why", None]}, {"submission": "s1", "rubric": [choice], "ground_truth": ["bad"]},
        {"submission": "s2", "rubric": sections, "prompt": "q", "ground_truth": ["UNMET", None, "CANNOT_ASSESS"]}, {"submission": "s3"}]}
    other = {"rubric": [{"requirement": "only"}], "items": [{"submission": "t0", "ground_truth": ["UNMET"]}]}
    (tmp_path / "in").mkdir()
    for name, own in (("d", data), ("e", other)):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(own, indent=1))
    first = datasets.read_dataset(spark, str(tmp_path / "in"))
    datasets.write_dataset(first["items"], first["labels"], first["criteria"], str(tmp_path / "out"))
    for got in (first, datasets.read_dataset(spark, str(tmp_path / "out"))):
        assert [(r["submission"], r["guidelines"], r["prompt"], r["name"]) for r in got["items"].orderBy("submission").collect()] == [
            ("s0", "be strict", "p", "d"), ("s1", None, "p", "d"), ("s2", "own", "q", "d"), ("s3", "be strict", "p", "d"), ("t0", None, None, None)]
        named = got["labels"].join(got["items"].select("dataset", "item_idx", "submission"), ["dataset", "item_idx"]).orderBy("submission", "criterion_idx").collect()
        assert [(r["submission"], r["criterion_idx"], r["verdict"], r["option_idx"], r["reason"]) for r in named] == [
            ("s0", 0, "MET", None, "why"), ("s0", 1, None, 2, None), ("s1", 0, None, 0, None),
            ("s2", 0, "UNMET", None, None), ("s2", 1, None, None, None), ("s2", 2, "CANNOT_ASSESS", None, None), ("t0", 0, "UNMET", None, None)]
        own = got["criteria"].orderBy(F.col("item_idx").asc_nulls_first(), "criterion_idx", "requirement").collect()
        assert [(r["item_idx"], r["criterion_idx"], r["requirement"], r["weight"], r["scale"]) for r in own] == [
            (None, 0, "a", 10.0, "binary"), (None, 0, "only", 10.0, "binary"), (None, 1, "b", 2.5, "nominal"), (1, 0, "b", 2.5, "nominal"),
            (2, 0, "x", 10.0, "binary"), (2, 1, "b", 2.5, "nominal"), (2, 2, "z", -1.0, "binary")]
        assert [(o["label"], o["value"], o["na"]) for o in own[2]["options"]] == [(o.label, o.value, o.na) for o in STANDARD]
    (tmp_path / "bad.json").write_text(json.dumps({"rubric": {"guidelines": "g"}, "items": [{"submission": "s"}]}))
    with pytest.raises(Exception, match="no criteria in the rubric"):
        datasets.read_dataset(spark, str(tmp_path / "bad.json"))["criteria"].collect()


def test_splits(spark):
    items = spark.range(1000).select(F.col("id").alias("item_idx"), (F.col("id") % 3).cast("string").alias("signature"))
    for n in (0, 137, 1000, 2000):
        assert sampling.train_test(items, n).where("split = 'train'").count() == min(n, 1000)
    own = sampling.stratified_split(items, 300).where("split = 'train'").groupBy("signature").count().collect()
    assert sum(r["count"] for r in own) == 300 and all(abs(r["count"] - 100) <= 1 for r in own)
    labels = items.select("item_idx", F.lit(0).alias("criterion_idx"), F.when(F.col("item_idx") < 2, "MET").otherwise("UNMET").alias("verdict"), F.lit(None).cast("int").alias("option_idx"))
    got = sampling.balanced_examples(labels, 6).collect()
    assert len(got) == 6 and sum(r["class"] == "MET" for r in got) == 2
    assert len(sampling.covering_items(labels, 2)) == 2


def test_covering_finds_a_rare_class_among_many_items(spark):
    items = spark.range(20_000).select(F.col("id").alias("item_idx"), F.lit(0).alias("criterion_idx"))
    rare = items.orderBy(sampling.seeded(0, "item_idx").desc()).first()["item_idx"]
    verdict = F.when(F.col("item_idx") == rare, "MET").when(F.col("item_idx") > 0, "UNMET")
    labels = items.select("item_idx", "criterion_idx", verdict.alias("verdict"), F.lit(None).cast("int").alias("option_idx"))
    assert sampling.covering_items(labels, 2) == [1, rare]
    assert sampling.covering_items(labels, 4) == [1, rare, 2, 3]
    assert sampling.covering_items(labels.limit(0), 2) == []


def word_judge(name):
    return judges.RuleJudge(name, F.when(F.col("submission").contains("good"), "MET").otherwise("UNMET"))


def test_runner_resumes(spark, tmp_path):
    rubric = Rubric((Criterion("good?"),)).table(spark)
    items = spark.createDataFrame([(i, "good" if i % 2 else "poor") for i in range(10)], "item_idx long, submission string")
    grader = runner.Grader([(word_judge("a"), 1.0), (judges.NoisyJudge(word_judge("a"), "b", 0.0, 0.0), 1.0)])
    path = str(tmp_path / "runs")
    assert runner.evaluate(items.where("item_idx < 4"), rubric, grader, path, "r").count() == 4
    rows = runner.evaluate(items, rubric, grader, path, "r").collect()
    assert sorted((r["item_idx"], r["score"]) for r in rows) == [(i, float(i % 2)) for i in range(10)]
    assert runner.evaluate(items, rubric, grader, path, "r").count() == 10
    assert runner.dataset_hash(items, rubric) == runner.dataset_hash(items.repartition(3), rubric) != runner.dataset_hash(items.limit(9), rubric)


def test_remote_judge_retries_and_caches(spark):
    items = spark.createDataFrame([(0, "good"), (1, "bad"), (2, "slow")], "item_idx long, submission string").withColumn("criterion_idx", F.lit(0))

    def transport(prompt):
        if "slow" in prompt:
            raise TimeoutError("late")
        return {"verdict": "MET" if "good" in prompt else "UNMET", "confidence": 0.9}

    cache = items.where("item_idx = 1").select(F.sha2("submission", 256).alias("prompt_sha256"), F.lit("MET").alias("verdict"), F.lit(None).cast("int").alias("option_idx"), F.lit("kept").alias("reason"), F.lit(1.0).alias("confidence"))
    got = {r["item_idx"]: r for r in judges.RemoteJudge("r", transport, F.col("submission"), attempts=2, pause=0.0, cache=cache).vote(items).collect()}
    assert (got[0]["verdict"], got[1]["reason"], got[2]["error"]) == ("MET", "kept", "infrastructure: late")


def test_cascade_supersedes(spark):
    rubric = Rubric((Criterion("good?"),)).table(spark)
    items = spark.createDataFrame([(0, "good"), (1, "poor")], "item_idx long, submission string")
    unsure = judges.RuleJudge("dm", F.lit("UNMET"))  # no confidence: every cell goes on
    grader = runner.Grader([(unsure, 1.0)], escalation=[(word_judge("llm"), 1.0)])
    scores, reports = grader.grade(items, rubric)
    assert sorted((r["item_idx"], r["score"]) for r in scores.collect()) == [(0, 1.0), (1, 0.0)]
    assert all(r["n_votes"] == 1 for r in reports.collect())


def test_streaming_votes(spark, tmp_path):
    rubric = Rubric((Criterion("a"),)).table(spark)
    one = lambda j, v: spark.createDataFrame([(i, 0, j, 0, 1.0, "primary", v, None, None, None, None, None, False) for i in range(3)], schema.VOTES)
    for name, verdict in (("a", "MET"), ("b", "UNMET"), ("c", "UNMET")):
        one(name, verdict).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.aggregate_stream(stream.vote_stream(spark, str(tmp_path / "in")), rubric, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    got = stream.latest_reports(spark, str(tmp_path / "out")).collect()
    assert [(r["final_verdict"], r["n_votes"]) for r in got] == [("UNMET", 3)] * 3


def test_metrics_and_improvement(spark):
    rubric = Rubric((Criterion("good?", name="g"),))
    items = spark.createDataFrame([(i, "good" if i % 3 else "poor") for i in range(30)], "item_idx long, submission string")
    labels = items.select("item_idx", F.lit(0).alias("criterion_idx"), F.when(F.col("submission") == "good", "MET").otherwise("UNMET").alias("verdict"), F.lit(None).cast("int").alias("option_idx"))
    noisy = lambda r: runner.Grader([(judges.NoisyJudge(word_judge("a"), "b", 0.3 if r.guidelines is None else 0.0, 0.0), 1.0)])
    table = rubric.table(spark)
    votes = noisy(rubric).votes(items.join(table, F.lit(True)), table)
    reports = noisy(rubric).reports(votes, table)
    got = metrics.compute_metrics(reports, votes, labels, table, spark.createDataFrame([("b",)], "judge_id string"), replicates=10)
    a, j = got.criterion.first(), got.judge.first()
    assert a["accuracy"] == j["accuracy"] and a["kappa"] == j["kappa"] and got.bootstrap.count() == 3
    assert {r["level"] for r in got.to_dataframe().collect()} == {"aggregate", "criterion", "judge"} and "accuracy" in got.summary()
    steps = improve.improve(rubric, items, labels, noisy, lambda r, wrong: Rubric(r.criteria, "read closely"), iterations=2)
    assert len(steps) == 2 and steps[1].accepted and steps[1].scores["accuracy"] == 1.0
    assert improve.fill_labels(items, labels.where("item_idx < 10"), table, noisy(Rubric(rubric.criteria, "x"))).count() == 30
    assert cells.resolved_labels(labels.withColumn("verdict", F.lit("odd")), table).count() == 0


def test_remote_calls_are_made_once(spark, tmp_path):
    """A cascade and a second run read stored votes and answers: each prompt is called once."""
    log = tmp_path / "calls"
    log.mkdir()

    def transport(prompt):
        (log / str(time.time_ns())).write_text(prompt)
        return {"verdict": "MET", "confidence": 0.1}

    rubric = Rubric((Criterion("good?"),)).table(spark)
    items = spark.createDataFrame([(0, "good")], "item_idx long, submission string")
    judge = judges.RemoteJudge("r", transport, F.col("submission"), attempts=1, pause=0.0, cache_path=str(tmp_path / "cache"))
    grader = runner.Grader([(judge, 1.0)], escalation=[(word_judge("llm"), 1.0)])
    runner.evaluate(items, rubric, grader, str(tmp_path / "runs"), "a").collect()
    assert len(list(log.iterdir())) == 1
    assert judge.vote(items.join(rubric, F.lit(True))).first()["verdict"] == "MET" and len(list(log.iterdir())) == 1
    old = dataclasses.replace(judge, cache_seconds=0)
    assert old.vote(items.join(rubric, F.lit(True))).count() == 1 and len(list(log.iterdir())) >= 2
    plain = dataclasses.replace(judge, cache_path=None)
    before = len(list(log.iterdir()))
    runner.evaluate(items, rubric, runner.Grader([(plain, 1.0)], escalation=[(word_judge("llm"), 1.0)]), str(tmp_path / "runs"), "b").collect()
    assert len(list(log.iterdir())) == before + 1


def test_configuration_errors_stop_the_job(spark):
    class AuthenticationError(Exception):
        pass

    def refused(prompt):
        raise AuthenticationError("no key")

    items = spark.createDataFrame([(0, 0, "x")], "item_idx long, criterion_idx int, submission string")
    with pytest.raises(Exception, match="no key"):
        judges.RemoteJudge("r", refused, F.col("submission"), pause=0.0).vote(items).collect()
    class RateLimitError(Exception):
        pass

    assert [judges.error_category(e) for e in (RateLimitError(), TimeoutError(), ValueError(), RuntimeError(), judges.ConfigurationError())] == ["infrastructure", "infrastructure", "parse", "unknown", "configuration"]


def test_run_is_stored_and_read_back(spark, tmp_path):
    rubric = Rubric((Criterion("good?"), Criterion("long?", options=STANDARD[:3]))).table(spark)
    items = spark.createDataFrame([(i, "good" if i % 2 else "poor") for i in range(4)], "item_idx long, submission string")
    pick = judges.RuleJudge("a", F.when(F.col("options").isNull(), F.when(F.col("submission") == "good", "MET").otherwise("UNMET")), F.when(F.col("options").isNotNull(), 2))
    path = str(tmp_path / "runs")
    assert runs.manifest(spark, path, "r", 4)["status"] == "pending"
    scores = runner.evaluate(items.where("item_idx < 2"), rubric, runner.Grader([(pick, 1.0)]), path, "r")
    assert runs.manifest(spark, path, "r", 4) == {"run_id": "r", "status": "running", "total_items": 4, "completed": 2, "failed": 0}
    rows = runs.records(scores, runs.read(spark, path, "reports", "r"), runs.read(spark, path, "votes", "r"), scoring.judge_scores(runs.read(spark, path, "votes", "r"), rubric))
    runs.write_records(rows, str(tmp_path / "lines"), "r")
    back = runs.read_records(spark, str(tmp_path / "lines"), "r")
    a = back["scores"].where("item_idx = 1").first()
    b = scores.where("item_idx = 1").first()
    assert (a["score"], a["raw_score"], a["mean_agreement"], a["cannot_assess_count"], a["report_type"]) == (b["score"], b["raw_score"], 1.0, 0, "single") and a["judge_scores"] == {"a": b["score"]}
    assert back["reports"].count() == 4 and {r["option_idx"] for r in back["votes"].collect()} == {None, 2}
    assert runs.successful(scores, scored=True).count() == 2 and runs.failed(scores).count() == 0
    with pytest.raises(ValueError, match="scores"):
        runs.read(spark, path, "other", "r")


def test_rubrics_of_items(spark):
    """Items with rubrics of their own are voted on, scored and pooled by these."""
    rows = [(0, 0, "a", None, 1.0, "binary", None, None), (0, 1, "b", None, 3.0, "binary", None, None), (1, 0, "c", None, 1.0, "ordinal", None, [(0, "no", 0.0, False), (1, "yes", 1.0, False)])]
    criteria = schema.local_table(spark, rows, "item_idx long, criterion_idx int, requirement string, name string, weight double, scale string, aggregation string, options array<struct<idx:int,label:string,value:double,na:boolean>>")
    votes = spark.createDataFrame(
        [(0, 0, "j", 0, 1.0, "primary", "MET", None, None, None, None, None, False), (0, 1, "j", 0, 1.0, "primary", "UNMET", None, None, None, None, None, False), (1, 0, "j", 0, 1.0, "primary", None, 1, None, None, None, None, False)], schema.VOTES)
    reports = voting.aggregate_votes(voting.routed_votes(votes, criteria), criteria)
    assert {r["item_idx"]: r["score"] for r in scoring.item_reports(reports).collect()} == {0: 0.25, 1: 1.0}
    labels = spark.createDataFrame([(0, 0, "MET", None), (0, 1, "MET", None), (1, 0, None, 1)], "item_idx long, criterion_idx int, verdict string, option_idx int")
    got = metrics.compute_metrics(reports, votes, labels, criteria, spark.createDataFrame([("j",)], "judge_id string"))
    pooled = {r["of"]: r for r in got.pooled.collect()}
    assert got.criterion is None and (pooled["binary"]["n"], pooled["binary"]["accuracy"]) == (2, 0.5) and pooled["ordinal"]["accuracy"] == 1.0 and pooled["all"]["n"] == 3
    assert pooled["binary"]["recall"] == 0.5 and any("own" in w for w in got.warnings) and "all" in got.summary()


def test_added_na_option_and_categories(spark):
    options = STANDARD[:3]
    table = Rubric((Criterion("q", options=options),)).table(spark)
    reports = spark.createDataFrame([(0, 0, None, 3, None), (1, 0, None, 1, None), (2, 0, None, None, "infrastructure: x")], "item_idx long, criterion_idx int, final_verdict string, option_idx int, error string")
    labels = spark.createDataFrame([(i, 0, None, 1) for i in range(3)], "item_idx long, criterion_idx int, verdict string, option_idx int")
    frame = cells.cells(reports, labels, table)
    shown = cells.effective_criteria(table, frame)
    assert len(shown.first()["options"]) == 4
    own = cells.with_effective_options(frame, shown)
    assert agreement.coverage(own, ["criterion_idx"]).first()["n_used"] == 1 and agreement.coverage(own, []).first()["n_cells"] == 3
    with pytest.raises(Exception, match="ordinal"):
        cells.classes(own, na="as_category").collect()
    assert [r["item_idx"] for r in cells.errored_items(reports).collect()] == [2]
    assert {(r["item_idx"], r["where"]) for r in cells.item_sets(reports, labels.where("item_idx > 0")).collect()} == {(0, "results only")}


def test_unanimous_choices_and_overrides(spark):
    """Dissent becomes the NA option where there is one; a criterion's own strategy comes first."""
    with_na = (*STANDARD[:3], Option("none", 0.0, True))
    table = Rubric((Criterion("x", options=with_na, scale_type="nominal"), Criterion("y", options=STANDARD[:3], scale_type="nominal"), Criterion("z", options=STANDARD[:3], aggregation="max"))).table(spark)
    rows = [(0, c, j, k, 1.0, "primary", None, o, None, None, None, None, False) for c in range(3) for k, (j, o) in enumerate((("a", 0), ("b", 2), ("c", 0)))]
    got = {r["criterion_idx"]: r for r in voting.aggregate_votes(spark.createDataFrame(rows, schema.VOTES), table, nominal="unanimous").collect()}
    assert (got[0]["option_idx"], got[0]["na"], got[0]["warning"]) == (3, True, None)
    assert got[1]["option_idx"] == 0 and "disagree" in got[1]["warning"] and got[2]["option_idx"] == 2


def test_errors_and_reasons_of_votes(spark):
    table = Rubric((Criterion("x"),)).table(spark)
    vote = lambda j, k, v, e, r: (0, 0, j, k, 1.0, "primary", v, None, e, r, None, None, False)
    both = spark.createDataFrame([vote("b", 1, "CANNOT_ASSESS", "parse: y", None), vote("a", 0, "CANNOT_ASSESS", "infrastructure: x", None)], schema.VOTES)
    row = voting.aggregate_votes(both, table).first()
    assert (row["error"], row["final_reason"]) == ("a: infrastructure: x | b: parse: y", "All judges voted CANNOT_ASSESS")
    row = voting.aggregate_votes(spark.createDataFrame([vote("b", 1, "MET", None, "fine"), vote("a", 0, "MET", None, None)], schema.VOTES), table).first()
    assert (row["error"], row["final_reason"]) == (None, "b: fine")


def test_single_text_and_rubric_of_rubrics(spark):
    rubric = Rubric((Criterion("good?"),))
    score, criteria = runner.grade_text(spark, "good", rubric.table(spark), runner.Grader([(word_judge("a"), 1.0)]))
    assert score["score"] == 1.0 and criteria[0]["final_verdict"] == "MET"
    scores, _ = validation.evaluate_rubrics(spark, [rubric, Rubric((Criterion("bad?"),))], runner.Grader([(word_judge("a"), 1.0)]))
    assert {r["item_idx"]: r["score"] for r in scores.collect()} == {0: 5 / 7, 1: 0.0}


def test_configs_and_capabilities():
    config = configs.JudgeConfig.from_dict({"model": "m", "attempts": 5, "base_url": "x"})
    assert config.to_dict() == {"model": "m", "attempts": 5, "extra": {"base_url": "x"}} and configs.JudgeConfig.from_dict(config.to_dict()) == config
    with pytest.raises(ValueError, match="model"):
        configs.JudgeConfig("")
    assert configs.strictest([None, 8, 3]) == 3 and configs.strictest([None]) is None
    registry = {"dm": {"provider": "p", "images": False}}
    assert configs.capabilities("dm", registry) == configs.capabilities("p/dm", registry) == registry["dm"] and configs.capabilities("q/dm", registry) is None


def test_judges_of_whole_rubrics(spark):
    """One call for an item: judgments by criterion, or a decision model's answers; a failed call fails all of them."""
    table = Rubric((Criterion("good?"), Criterion("how?", options=STANDARD[:3]))).table(spark)
    items = spark.createDataFrame([(0, "good"), (1, "slow"), (2, "odd")], "item_idx long, submission string")

    def reply(prompt):
        if "slow" in prompt:
            raise TimeoutError("late")
        assert "c1: good?" in prompt and "2. fair" in prompt
        second = [] if "odd" in prompt else [{"criterion_id": "c2", "selected_option": 2}]
        return json.dumps({"judgments": [{"criterion_id": "c1", "criterion_status": "MET", "explanation": "yes"}, *second]})

    null = F.lit(None).cast("string")
    ask = prompts.rubric_prompt(F.col("criteria"), F.col("submission"), null, null, null)
    one = judges.ItemJudge("j", reply, ask, judges.read_judgments, (("attempts", 1), ("pause", 0.0)))
    _, reports = runner.Grader([(one, 1.0)]).grade(items, table)
    got = {(r["item_idx"], r["criterion_idx"]): (r["final_verdict"], r["option_idx"], r["error"]) for r in reports.collect()}
    assert got[0, 0] == ("MET", None, None) and got[0, 1] == (None, 1, None) and got[2, 0][0] == "MET"
    assert got[1, 0] == ("CANNOT_ASSESS", None, "j: infrastructure: late") and got[1, 1][1] == 3 and got[2, 1][2] == "j: parse: no judgment with its id"

    def answer(prompt):
        return json.dumps([{"criterion_idx": 0, "type": "noul", "noul": 0.25}, {"criterion_idx": 1, "type": "score", "score": 1.5, "probabilities": {"0": 0.1, "1": 0.2, "2": 0.7}}])

    votes = judges.ItemJudge("d", answer, F.col("submission"), judges.read_answers).vote(runner.Grader([(one, 1.0)]).cells(items, table)).collect()
    assert {(r["criterion_idx"], r["verdict"], r["option_idx"]) for r in votes} == {(0, "UNMET", None), (1, None, 2)} and {round(r["confidence"], 2) for r in votes} == {0.5, 0.55}


def test_strict_datasets(spark, tmp_path):
    data = {"name": "d", "prompt": "p", "rubric": [{"requirement": "a"}, {"requirement": "b", "options": [{"label": "No", "value": 0}, {"label": "Yes", "value": 1}]}],
            "items": [{"submission": "x", "ground_truth": ["MET", " yes "]}, {"submission": "y", "ground_truth": ["MET", "maybe"]}]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(data))
    loose = datasets.read_dataset(spark, str(path))["labels"].collect()
    assert {(r["item_idx"], r["criterion_idx"], r["verdict"], r["option_idx"]) for r in loose} == {(0, 0, "MET", None), (0, 1, None, 1), (1, 0, "MET", None), (1, 1, None, None)}
    with pytest.raises(Exception, match="no such label: maybe"):
        datasets.read_dataset(spark, str(path), strict=True)["labels"].collect()
    del data["prompt"], data["items"][1]
    path.write_text(json.dumps(data))
    with pytest.raises(Exception, match="no prompt"):
        datasets.read_dataset(spark, str(path), strict=True)["items"].collect()


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "b.bin").write_bytes(b"RIFF0000WEBP")
    got = {r["path"].rsplit("/", 1)[1]: r for r in datasets.images(spark, str(tmp_path)).collect()}
    assert (got["a.png"]["media_type"], got["b.bin"]["media_type"]) == ("image/png", "image/webp")
    assert got["a.png"]["digest"] == hashlib.sha256(b"\x89PNG\r\n\x1a\n0000").hexdigest()


def test_fitted_thresholds_and_one_sample_distance(spark):
    rows = [(i, 0, "MET" if i % 2 else "UNMET", False, None, 0.9 if i % 4 < 2 else 0.1) for i in range(80)]
    dm = spark.createDataFrame(rows, "item_idx long, criterion_idx int, final_verdict string, na boolean, error string, confidence double")
    truth = dm.select("item_idx", "criterion_idx", F.when((F.col("confidence") > 0.5) == (F.col("final_verdict") == "MET"), "MET").otherwise("UNMET").alias("true"))
    llm = dm.drop("final_verdict").join(truth.withColumnRenamed("true", "final_verdict"), ["item_idx", "criterion_idx"])
    table = Rubric((Criterion("x", name="c"),)).table(spark)
    assert cascade.fitted_thresholds(dm, llm, truth, table) == {"c": pytest.approx(0.12)}
    assert cascade.fitted_thresholds(dm, llm, truth, table, min_pairs=100) == {}
    got = distribution.ks_normal(spark.createDataFrame([(float(x),) for x in range(11)], "x double"))
    assert 0.05 < got["statistic"] < 0.2 and got["p_value"] > 0.5
    assert distribution.ks_p(0.0, 10, 10) == 1.0 and special.kendall_p(45, 10, [], []) < 0.01
    tied = voting.top_tied(spark.createDataFrame([(0, "a", 2), (0, "b", 2), (0, "c", 1)], "i int, k string, n int"), ["i"], "k", "n")
    assert {r["k"] for r in tied.collect()} == {"a", "b"}


def test_prompts_with_examples(spark):
    row = spark.range(1).select(
        prompts.with_examples(F.lit("ask"), F.array(F.struct(F.lit("s").alias("submission"), F.lit("MET").alias("answer")))).alias("a"),
        prompts.with_examples(F.lit("ask"), F.array().cast("array<struct<submission:string,answer:string>>")).alias("b"),
        prompts.request_state(x=F.lit(1)).alias("c"), X.checked_option_value(F.array(F.struct(F.lit(0.5).alias("value"))), F.lit(0)).alias("d"),
        X.scale_of(F.lit(None).cast("array<int>"), F.lit("ordinal")).alias("e"), X.content_digest(F.lit("x")).alias("f"), content.without_prefix(F.lit("abc"), F.lit("ab")).alias("g"),
        content.content_key(F.array(F.struct(F.lit("a").alias("text"), F.lit(None).cast("string").alias("image")), F.struct(F.lit("b").alias("text"), F.lit(None).cast("string").alias("image")))).alias("h"),
        content.content_key(F.array(F.struct(F.lit("ab").alias("text"), F.lit(None).cast("string").alias("image")))).alias("i"),
    ).first()
    assert row["a"].startswith("Example 1:\ns\nAnswer: MET") and (row["b"], row["c"], row["d"], row["e"]) == ("ask", '{"x":1}', 0.5, "binary")
    assert row["f"] == hashlib.sha256(b"x").hexdigest() and row["g"] == "c" and row["h"] == row["i"]
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(X.checked_option_value(F.array(F.struct(F.lit(0.5).alias("value"))), F.lit(1))).collect()


def test_metrics_to_file(spark, tmp_path):
    table = Rubric((Criterion("a"), Criterion("b", options=STANDARD[:3]))).table(spark)
    rows = [(i, c, "j", 0, 1.0, "primary", "MET" if c == 0 and i % 2 else "UNMET" if c == 0 else None, None if c == 0 else i % 3, None, None, None, None, False) for i in range(12) for c in (0, 1)]
    votes = spark.createDataFrame(rows, schema.VOTES)
    labels = spark.createDataFrame([(i, c, "MET" if c == 0 else None, None if c == 0 else i % 2) for i in range(12) for c in (0, 1)], "item_idx long, criterion_idx int, verdict string, option_idx int")
    got = metrics.compute_metrics(voting.aggregate_votes(votes, table), votes, labels, table, spark.createDataFrame([("j",)], "judge_id string"))
    got.to_file(tmp_path / "m.json")
    data = json.loads((tmp_path / "m.json").read_text())
    assert len(data["option"]) == 3 and len(data["confusion"]) == 4 + 9 and any("one class" in w for w in data["warnings"])
    assert data["judge"][0]["n"] == data["criterion"][0]["n"] == 12 and data["aggregate"][0]["accuracy"] == 0.5


def test_sampling_helpers(spark):
    items = spark.createDataFrame([(i, f"text {i}") for i in (3, 1, 2)], "item_idx long, submission string")
    assert [r["item_idx"] for r in sampling.covered(items, items.where("item_idx > 1")).collect()] == [2, 3]
    table = Rubric((Criterion("good?"),)).table(spark)
    assert runner.calibration_fingerprint(items, table) == runner.calibration_fingerprint(items.repartition(3), table) != runner.calibration_fingerprint(items.where("item_idx > 1"), table)
    classed = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 1)], "criterion_idx int, t int")
    assert [r["criterion_idx"] for r in sampling.degenerate(classed).collect()] == [0]
    assert [s for s in validation.recent([1, 2, 3], 2)] == [2, 3] and validation.recent([1], 0) == []


def test_dimension_tables_know_their_size(spark):
    small = Rubric((Criterion("good?"),)).table(spark)
    assert small.first()["requirement"] == "good?"
    joined = spark.range(10).join(schema.dimension(small), F.lit(True))
    assert "BroadcastExchange" in joined._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_bootstrap_draws(spark):
    drawn = bootstrap.drawn(spark.range(2000).select(F.col("id").alias("item_idx")), 10, seed=1)
    per = [r["n"] for r in drawn.groupBy("replicate").agg(F.sum("times").alias("n")).collect()]
    assert len(per) == 10 and all(1850 < n < 2150 for n in per)


def test_entry_without_corpus_operators():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "doc_reports" in names


def test_entry_can_be_imported_before_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = str(Path(__file__).resolve().parents[1])
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) >= int(out[-1]) > 0
