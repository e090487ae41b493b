"""The parts of the toxicity operator against plain code: term counts, what voters see, the classifier's sums."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quorumlake.llm import toxicity

WORD = re.compile(r"[^\W\d_]+")


def texts(n, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 9))) for _ in range(150)]
    return [" ".join(rnd.choice(vocabulary).upper() if rnd.random() < 0.1 else rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 60))) + rnd.choice(["", "!!", "?", " 12 a_b"]) for _ in range(n)]


def plain_parts(words, kind):
    return {p for p in (toxicity.part_of(w, kind) for w in words) if p}


@pytest.mark.parametrize("kept", [toxicity.KEPT_WORDS, 40])
def test_terms_are_counted_once_a_document(spark, monkeypatch, kept):
    monkeypatch.setattr(toxicity, "KEPT_WORDS", kept)
    own = texts(300)
    rows = [(t, (i % 7) / 7, i % 2) for i, t in enumerate(own)]
    got = toxicity.mined_terms(spark.createDataFrame(rows, "text string, p double, half int"), (2.0, 0.3, -100.0))
    for half in (0, 1):
        for k, kind in enumerate(toxicity.KINDS):
            n, toxic = {}, {}
            for t, p, h in rows:
                if h == half:
                    for term in plain_parts(set(WORD.findall(t.lower())), kind):
                        n[term], toxic[term] = n.get(term, 0) + 1, toxic.get(term, 0) + p
            assert got[half, k] == {t for t in n if toxic[t] >= 2.0 - 1e-12 and toxic[t] / (n[t] + 0.5) >= 0.3}


def test_voters_see_what_a_loop_sees():
    own = texts(80, seed=9)
    known = sorted({w for t in own for w in WORD.findall(t.lower())})
    lexicons = [(kind, {p for w in known[k::9] if (p := toxicity.part_of(w, kind))}) for k, kind in enumerate(toxicity.KINDS)]
    got = toxicity.Voters(lexicons).seen(own)
    for t, row in zip(own, got):
        words = set(WORD.findall(t.lower()))
        hit = [{w for w in words if toxicity.part_of(w, kind) in terms} for kind, terms in lexicons]
        assert row[:-5].tolist() == [len(h) for h in hit] and row[-5:-3].tolist() == [len(set.union(*hit)), len(words)]
        assert row[-1] == ("!!" in t or "??" in t)


def test_classifier_minimises_the_loss_over_all_rows(spark):
    rng = np.random.default_rng(6)
    seen = np.column_stack([rng.poisson(1.0, (400, 10)), rng.integers(0, 4, 400), rng.integers(3, 90, 400), rng.random((400, 2)), rng.integers(0, 2, 400)]).astype(float)
    y = np.where(rng.random(400) < 0.3, (seen[:, 0] > 1).astype(float), np.nan)
    v = toxicity.votes(seen)
    _, model = toxicity.label_model(v, y, 0.3)
    held = spark.createDataFrame([(s.tolist(), None if np.isnan(t) else float(t)) for s, t in zip(seen, y)], "seen array<float>, y double").repartition(5)
    bias, weights, scale = toxicity._logistic(held, model)
    x = toxicity.columns(seen)
    assert np.allclose(scale, np.maximum(x.std(0), 1e-3), rtol=1e-5)
    p = model.posterior(v, y)
    off = 1 / (1 + np.exp(-(bias + x / scale @ weights))) - p
    slope = (x / scale).T @ off + (1e-2 * 400 * 0.01 + 0.1) * weights
    assert abs(off.sum()) < 1e-2 and np.abs(slope).max() < 1e-2


def test_counts_stand_for_documents():
    rng = np.random.default_rng(2)
    v = rng.integers(-1, 2, (60, 5))
    y = np.where(rng.random(60) < 0.4, rng.integers(0, 2, 60).astype(float), np.nan)
    counts = rng.integers(1, 6, 60)
    one, model = toxicity.label_model(v, y, 0.3, counts=counts.astype(float))
    many, same = toxicity.label_model(np.repeat(v, counts, 0), np.repeat(y, counts), 0.3)
    assert np.allclose(np.repeat(one, counts), many, atol=1e-6) and model.parent == same.parent
