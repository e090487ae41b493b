"""Running sums, percentiles, ranks and inversions over blocks, against plain code, with blocks of a few rows."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from quorumlake.operators import correlation, distribution, ordered, sampling


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(np.round(rng.normal() * 10 ** (g % 2), 1)), float(np.round(rng.random(), 1 if g else 3))) for g in (0, 1, 2) for _ in range((700, 300, 3)[g])]
    rows += [(0, 1e9, 0.5), (0, -1e9, 0.5), (2, None, 1.0)]
    return rows, spark.createDataFrame(rows, "g int, x double, y double").cache()


@pytest.fixture(params=[50_000, 20])
def blocks(request, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", request.param)
    return request.param


def of(rows, g):
    return [(x, y) for k, x, y in rows if k == g and x is not None]


def test_percentiles_equal_numpy(table, blocks):
    rows, frame = table
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    for r in ordered.percentiles(frame, ["g"], "x", at).collect():
        assert r.q == pytest.approx(np.percentile([x for x, _ in of(rows, r.g)], [100 * p for p in at]), rel=1e-12)
    whole = ordered.percentiles(frame, [], "x", at).first().q
    assert whole == pytest.approx(np.percentile([x for g in (0, 1, 2) for x, _ in of(rows, g)], [100 * p for p in at]), rel=1e-12)


def test_kendall_and_spearman_equal_plain_code(table, blocks):
    rows, frame = table
    kendall = {r.g: r for r in correlation.kendall(frame, ["g"]).collect()}
    spearman = {r.g: r.spearman for r in correlation.spearman(frame, ["g"]).collect()}
    for g in (0, 1, 2):
        own = of(rows, g)
        x, y = map(np.array, zip(*own))
        sign = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
        n, ties = len(own), lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
        pairs = n * (n - 1) / 2
        assert kendall[g].n == n and kendall[g].kendall == pytest.approx(sign.sum() / 2 / np.sqrt((pairs - ties(x)) * (pairs - ties(y))))
        rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        assert spearman[g] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert correlation.kendall(frame.where("g < 0"), ["g"]).count() == 0


def test_distances_and_timing_equal_plain_code(table, blocks):
    rows, frame = table
    for r in distribution.distances(frame, ["g"], "x", "y").collect():
        x, y = map(np.array, zip(*of(rows, r.g)))
        y = np.array([b for k, _, b in rows if k == r.g])
        v = np.unique(np.r_[x, y])
        gap = np.abs([(x <= a).mean() - (y <= a).mean() for a in v])
        assert r.ks == pytest.approx(gap.max()) and r.emd == pytest.approx((gap[:-1] * np.diff(v)).sum())
    got = sampling.timing(frame.where("g = 0"), "x").first()
    v = sorted(x for x, _ in of(rows, 0))
    assert (got.n, got.p50, got.p95) == (len(v), v[len(v) // 2], v[min(int(0.95 * len(v)), len(v) - 1)])


def test_many_points_of_one_group(spark):
    """A hundred thousand different points: as pairs they would be ten thousand million."""
    frame = spark.range(100_000).select(F.col("id").cast("double").alias("x"), F.pmod(F.col("id") * 7919, F.lit(100_003)).cast("double").alias("y"))
    plan = correlation.kendall(frame, [])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin Inner, BuildRight, isnotnull" not in plan
    got = correlation.kendall(frame, []).first()
    x = np.arange(100_000)
    want = ordered.inversions(x, (x * 7919) % 100_003, np.ones(100_000)) / (100_000 * 99_999 / 2)
    assert got.n == 100_000 and got.kendall == pytest.approx(want)


def test_inversions_of_few_points():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 40):
        x, y, w = rng.integers(0, 6, n), rng.integers(0, 6, n), rng.integers(1, 4, n).astype(float)
        want = sum(w[i] * w[j] * np.sign((x[i] - x[j]) * (y[i] - y[j])) for i in range(n) for j in range(i))
        assert ordered.inversions(x, y, w) == pytest.approx(want)


@pytest.mark.parametrize("n_train", [0, 1, 57, 999, 5000])
def test_large_strata_are_cut_by_counts(spark, n_train):
    rows = [(i, "common" if i % 50 else f"rare {i % 3}") for i in range(1000)]
    signed = spark.createDataFrame(rows, "item_idx long, signature string")
    got = {r.item_idx: r.split for r in sampling.stratified_split(signed, n_train, seed=3).collect()}
    order = {r.item_idx: r.h for r in signed.select("item_idx", sampling.seeded(3, "item_idx").alias("h")).collect()}
    left, train, want = 1000, n_train, {}
    for signature in sorted({s for _, s in rows}):
        own = sorted((order[i], i) for i, s in rows if s == signature)
        k = max(0, min(len(own), round(len(own) * train / left)))
        left, train = left - len(own), train - k
        want |= {i: "train" if at < k else "test" for at, (_, i) in enumerate(own)}
    assert got == want
