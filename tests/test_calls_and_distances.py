"""Calls at once in a task, and normalised distances with a direction."""

from __future__ import annotations

import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from quorumlake.operators import distribution
from quorumlake.rubric import Criterion, Rubric
from quorumlake.sources import judges


@pytest.mark.parametrize("concurrency,threads,most", [(4, 4, 4), (2, 8, 2), (1, 4, 1)])
def test_calls_at_once(spark, tmp_path, concurrency, threads, most):
    """Calls of a task overlap, and no more than ``concurrency`` are under way at any time."""

    def transport(prompt):
        began = time.time()
        time.sleep(0.15)
        (tmp_path / f"{prompt}-{concurrency}").write_text(f"{began} {time.time()}")
        return {"verdict": "MET"}

    cells = spark.range(8).select(F.col("id").alias("item_idx"), F.col("id").cast("string").alias("submission")).join(Rubric((Criterion("x"),)).table(spark), F.lit(True))
    judge = judges.RemoteJudge("r", transport, F.col("submission"), concurrency=concurrency, threads=threads)
    assert judge.vote(cells).where("verdict = 'MET'").count() == 8
    spans = [tuple(map(float, p.read_text().split())) for p in tmp_path.iterdir()]
    at_once = max(sum(b <= t < e for b, e in spans) for t, _ in spans)
    assert len(spans) == 8 and at_once <= most and (most == 1 or at_once > 1)


def test_earth_movers(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(a) if a < 9 else None, float(b)) for g in (0, 1) for a, b in zip(rng.normal(5 + g, 2, 60), rng.normal(5, 1, 60))] + [(2, 1.0, 1.0), (2, 1.0, 1.0), (3, None, 4.0)]
    frame = spark.createDataFrame(rows, "g int, a double, b double")
    for normalize in (True, False):
        got = {r.g: r for r in distribution.earth_movers(frame, ["g"], "a", "b", normalize).collect()}
        for g in (0, 1, 2):
            a, b = (np.array([v for v in c if v is not None]) for c in zip(*[(x, y) for k, x, y in rows if k == g]))
            low, high = min(a.min(), b.min()), max(a.max(), b.max())
            if normalize and high > low:
                a, b = (a - low) / (high - low), (b - low) / (high - low)
            v = np.unique(np.r_[a, b])
            emd = sum(abs((a <= x).mean() - (b <= x).mean()) * (y - x) for x, y in zip(v, v[1:]))
            diff = a.mean() - b.mean()
            assert got[g].emd == pytest.approx(emd) and got[g].mean_diff == pytest.approx(diff) and got[g].std_diff == pytest.approx(a.std() - b.std())
            assert got[g].bias_direction == ("higher" if diff > 0.01 else "lower" if diff < -0.01 else "none") and got[g].bias_magnitude == pytest.approx(abs(diff))
        assert (got[3].emd, got[3].mean_diff, got[3].bias_direction, got[3].interpretation) == (None, None, "none", "insufficient data")
