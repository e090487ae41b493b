"""Calibration by any metric: the cube against plain code over cells, names, choices, metrics and refusals."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from quorumlake.operators import calibration as C
from quorumlake.operators import cascade
from quorumlake.rubric import Criterion, Option, Rubric
from quorumlake.schema import MET, UNMET

STEPS = (0.0, 0.25, 0.5, 0.75, 1.0)
REPORT = "item_idx long, criterion_idx int, final_verdict string, option_idx int, na boolean, error string, confidence double"


@pytest.fixture(scope="module")
def rubric(spark):
    options = tuple(Option(x, v) for x, v in (("low", 0.0), ("mid", 0.5), ("high", 1.0)))
    return Rubric((
        Criterion("a", name="one", weight=3.0), Criterion("b", name="two", weight=-1.0),
        Criterion("c", name="level", weight=2.0, options=options), Criterion("d", weight=1.0),
    )).table(spark)


@pytest.fixture(scope="module")
def runs(spark):
    rnd = random.Random(11)
    dm, llm, truth, score = [], [], [], []
    for i in range(90):
        score.append((i, rnd.random()))
        for c in range(4):
            t = rnd.randrange(3) if c == 2 else rnd.randrange(2)

            def report(right, i=i, c=c, t=t):
                p = t if rnd.random() < right else rnd.randrange(3 if c == 2 else 2)
                kind = rnd.random()
                if kind < 0.06:
                    return (i, c, None if c == 2 else "CANNOT_ASSESS", None, True, "infrastructure: x" if kind < 0.03 else None, None)
                return (i, c, None if c == 2 else (MET if p else UNMET), p if c == 2 else None, False, None, rnd.choice([0.1, 0.25, 0.4, 0.6, 0.75, 0.9]))

            dm.append(report(0.6 + 0.1 * c))
            llm.append(report(0.9)[:6] + (None,))
            if rnd.random() < 0.8 and c != 3:
                truth.append((i, c, None if c == 2 else (MET if t else UNMET), t if c == 2 else None))
    return dm, llm, truth, score


@pytest.fixture(scope="module")
def frames(spark, runs):
    dm, llm, truth, score = runs
    return (
        spark.createDataFrame(dm, REPORT), spark.createDataFrame(llm, REPORT), spark.createDataFrame(truth, "item_idx long, criterion_idx int, true string, true_idx int"),
        spark.createDataFrame(score, "item_idx long, score double"),
    )


def cls(r):
    if r[5] is not None:
        return None
    return {MET: 1, UNMET: 0, "CANNOT_ASSESS": 2}[r[2]] if r[1] != 2 else (3 if r[3] is None else r[3])


def replayed(runs, limits):
    """Of each cell: item, criterion, escalated, first and second class, final class, truth."""
    dm, llm, truth, _ = runs
    true = {(i, c): ({MET: 1, UNMET: 0}[v] if c != 2 else o) for i, c, v, o in truth}
    for a, b in zip(dm, llm):
        up = a[5] is not None or a[4] or a[6] is None or a[6] < limits[a[1]]
        yield a[0], a[1], up, cls(a), cls(b), cls(b if up else a), true.get(a[:2]), (b if up else a)


def kappa(pairs, quadratic):
    on = sorted({x for p in pairs for x in p})
    if len(on) < 2:
        return None
    w = lambda x, y: (on.index(x) - on.index(y)) ** 2 if quadratic else x != y
    seen = sum(w(*p) for p in pairs) / len(pairs)
    chance = sum(w(x, y) for x, _ in pairs for _, y in pairs) / len(pairs) ** 2
    return 1 - seen / chance


def brute(runs, limits, metric):
    cells = list(replayed(runs, limits))
    of = lambda c: [(t, p) for _, k, _, _, _, p, t, _ in cells if k == c and t is not None and p is not None and p != (3 if c == 2 else 2)]
    if metric == "mean_kappa":
        got = [k for c in range(4) if of(c) and (k := kappa(of(c), c == 2)) is not None]
        return sum(got) / len(got)
    binary = of(0) + of(1) + of(3)
    if metric == "criterion_accuracy":
        return sum(t == p for t, p in binary) / len(binary)
    if metric == "criterion_f1":
        return 2 * sum(t and p for t, p in binary) / (sum(t for t, _ in binary) + sum(p for _, p in binary))
    weight, squares = {0: 3.0, 1: -1.0, 2: 2.0, 3: 1.0}, []
    for i, s in runs[3]:
        own = [x for x in cells if x[0] == i]
        used = [(weight[c], (r[3] / 2 if c == 2 else float(r[2] == MET))) for _, c, _, _, _, _, _, r in own if not r[4]]
        if used and not all(up and r[5] is not None for _, _, up, _, _, _, _, r in own):
            pos, neg = sum(w for w, _ in used if w > 0), -sum(w for w, _ in used if w < 0)
            total = sum(w * v for w, v in used)
            squares.append((min(1, max(0, total / pos)) if pos else min(1, max(0, 1 + total / neg))) - s)
    return -np.sqrt(np.mean(np.square(squares)))


METRICS = ("criterion_accuracy", "criterion_f1", "mean_kappa", C.SCORE_RMSE)


@pytest.mark.parametrize("metric", METRICS)
def test_curve_is_that_of_replays(frames, rubric, runs, metric):
    dm, llm, truth, score = frames
    got = C.calibrate(dm, llm, truth, rubric, STEPS, metric, expected=score)
    assert [p["threshold"] for p in got.curve] == list(STEPS) and not got.fitted
    for p in got.curve:
        cells = list(replayed(runs, [p["threshold"]] * 4))
        assert p["metric"] == pytest.approx(brute(runs, [p["threshold"]] * 4, metric), abs=1e-12)
        assert p["escalation_rate"] == pytest.approx(sum(c[2] for c in cells) / len(cells))
        known = [c for c in cells if c[6] is not None and c[3] is not None and c[3] != (3 if c[1] == 2 else 2)]
        kept = [c[3] == c[6] for c in known if not c[2]]
        both = [c for c in known if c[2] and c[4] is not None and c[4] != (3 if c[1] == 2 else 2)]
        share = lambda x: pytest.approx(sum(x) / len(x)) if x else None
        assert p["kept_accuracy"] == share(kept)
        assert p["escalated_dm_accuracy"] == share([c[3] == c[6] for c in both]) and p["escalated_llm_accuracy"] == share([c[4] == c[6] for c in both])
        assert p["cost"] is None


@pytest.mark.parametrize("metric", METRICS)
def test_coordinate_ascent_is_that_of_replays(frames, rubric, runs, metric):
    dm, llm, truth, score = frames
    got = C.calibrate(dm, llm, truth, rubric, STEPS, metric, per_criterion=True, expected=score)

    def best(limits_of):
        points = []
        for t in STEPS:
            limits = limits_of(t)
            cells = list(replayed(runs, limits))
            points.append((-round(brute(runs, limits, metric), 12), round(sum(c[2] for c in cells) / len(cells), 12), t))
        top = min(p[0] for p in points)
        return min((r, m, t) for m, r, t in points if m == top)[2]

    start = best(lambda t: [t] * 4)
    limits = [start] * 4
    for c in (0, 1, 2):  # the fourth has no name
        limits[c] = best(lambda t, c=c: limits[:c] + [t] + limits[c + 1 :])
    assert got.fitted == {"one": limits[0], "two": limits[1], "level": limits[2]}
    for p in got.curve:
        assert p["metric"] == pytest.approx(brute(runs, limits[:3] + [p["threshold"]], metric), abs=1e-12)
    assert max(p["metric"] for p in got.curve) >= max(brute(runs, [t] * 4, metric) for t in STEPS) - 1e-12


def test_own_metrics_and_what_is_left_out(frames, rubric, spark):
    dm, llm, truth, score = frames
    wrong = lambda counts: -float(sum(c.matrix.sum() - np.trace(c.matrix) for c in counts))
    got = C.calibrate(dm, llm, truth, rubric, STEPS, wrong, per_criterion=True, min_pairs=10_000)
    assert got.fitted == {} and "one, two, level" in got.warnings[0]
    got = C.calibrate(dm, llm, truth, rubric, STEPS, lambda counts: float("nan"), per_criterion=True)
    assert got.fitted == {} and "undefined" in got.warnings[0] and got.best() is None
    costs = spark.createDataFrame([(i, 4.0, 8.0, 1.0, 0.5) for i in range(90)], "item_idx long, llm_cost double, llm_seconds double, dm_cost double, dm_seconds double")
    got = C.calibrate(dm, llm, truth, rubric, STEPS, runs=costs)
    for p in got.curve:
        assert p["cost"] == pytest.approx(90 + 4 * 90 * p["escalation_rate"]) and p["seconds"] == pytest.approx(45 + 8 * 90 * p["escalation_rate"])
    assert got.best(max_rate=0.5)["escalation_rate"] <= 0.5
    assert [r.threshold for r in got.to_dataframe(spark).collect()] == list(STEPS)
    for bad, how in (("one at least", {"steps": ()}), ("0 to 1", {"steps": (1.5,)}), ("metric", {"metric": "no"}), ("expected", {"metric": C.SCORE_RMSE}), ("number", {"metric": lambda c: True}), ("min_pairs", {"min_pairs": 0})):
        with pytest.raises(ValueError, match=bad):
            C.calibrate(dm, llm, truth, rubric, **how)


def test_cells_are_read_once(frames, rubric, spark, monkeypatch):
    """One job builds the cube, whatever the number of criteria and thresholds."""
    dm, llm, truth, _ = frames
    calls = []
    monkeypatch.setattr(C, "cube", lambda *a, own=C.cube, **k: calls.append(1) or own(*a, **k))
    C.calibrate(dm, llm, truth, rubric, per_criterion=True, metric="mean_kappa")
    assert calls == [1]
    assert cascade.fitted_thresholds(dm, llm, truth, rubric, steps=STEPS) == C.calibrate(dm, llm, truth, rubric, STEPS, per_criterion=True, min_pairs=20).fitted


def test_selection_rule():
    points = [(0.1, 0.5, 0.0), (0.2, 0.9, 0.1), (0.3, 0.9, 0.2), (0.4, 0.95, 0.3), (None, None, 0.4)]
    assert C.selected(points) == 3 and C.selected(points, tolerance=0.05) == 1 and C.selected(points, max_rate=0.3) == 1
    assert C.selected([(0.0, None, 0.0)]) is None and C.selected([(0.3, 0.1 + 0.2, 0.5), (0.3, 0.3, 0.1)]) == 1
