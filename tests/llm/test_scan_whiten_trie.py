"""License scan, whitening and prefix trie against brute force on small fixtures: nulls, empty and very long
rows, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quorumlake.llm import licenses, prefix_trie, whitening

FILL = "alpha beta gamma delta epsilon zeta"


# ---------------------------------------------------------------- licenses
DOCS = "doc_id long, text string, rid long, t int, o long, h string, places string"


def notice(label, k=0):
    return [text for name, text in licenses.TEXTS if name == label][k]


def scan(spark, texts, **how):
    rows = [(i, t, 1, 1, 1, "x", "y") for i, t in enumerate(texts)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, DOCS), **how)
    return [tuple(r)[1:] for r in sorted(got.collect(), key=lambda r: r.doc_id)]


def test_phrases(spark):
    texts = ["the MIT\nLicense, mit license", None, "", " .,; ", "GNU General Public. License! cc-by CC BY", "gnu general public", "éMIT license mitlicense", "2026 cc by by cc"]
    got = scan(spark, texts)
    words = [re.findall(licenses.WORD, (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    assert [g[0] for g in got] == [len(w) for w in words]
    assert [g[1:5] for g in got] == [
        (2, 1, 3, "mit"), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (3, 0, 6, "cc-by,gpl"), (0, None, None, ""), (0, None, None, ""), (1, 1, 1, "cc-by"),
    ]
    assert [g[6] for g in got] == [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0]


def test_spans_with_changed_words(spark):
    mit = notice("mit").split()
    inserted = mit[:30] + ["really", "truly"] + mit[30:]
    lost = mit[:20] + mit[26:]
    half = mit[: len(mit) // 2]
    shuffled = random.Random(3).sample(mit, len(mit))
    twice = f"{notice('isc')} {FILL} {notice('isc')}"
    long = " ".join([FILL] * 3000 + [notice("bsd")] + [FILL] * 3000)
    got = scan(spark, [" ".join(x) for x in (mit, inserted, lost, half, shuffled)] + [twice, long, FILL])
    assert [g[5] for g in got] == ["mit", "mit", "mit", "", "", "isc", "bsd", ""]
    assert got[0][6] == 1.0 and got[5][6] == 1.0 and got[6][6] == 1.0
    assert licenses.LEAST <= got[1][6] < 1 and licenses.LEAST <= got[2][6] < 1 and got[3][6] == 0
    spans = licenses.license_spans(licenses.diagonals(spark.createDataFrame([(0, twice, 0, 0, 0, "", "")], DOCS))).orderBy("start").collect()
    n = len(re.findall(licenses.WORD, notice("isc").lower()))
    assert [(s.start, s.end) for s in spans] == [(0, n), (n + 6, 2 * n + 6)]


def test_repeated_short_notice_is_not_one_span(spark):
    assert scan(spark, [" ".join([notice("cc-by", 1)] * 40)])[0][4:] == ("cc-by", "cc-by", 1.0)
    assert scan(spark, [" ".join([notice("mit", 1)] * 3)], phrases=(("none", "no such words"),))[0][4:] == ("", "mit", 1.0)


def test_license_rows(spark):
    rows = [(None, "MIT license", 1, 1, 1, "", ""), (4, "x", 1, 1, 1, "", ""), (4, "x", 1, 1, 1, "", ""), (None, None, 1, 1, 1, "", "")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.labels) for r in got) == [("4", ""), ("4", ""), ("None", ""), ("None", "mit")]
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="words"):
        licenses.scan_licenses(spark.createDataFrame([], DOCS), texts=(("a", "too short"),))


# ---------------------------------------------------------------- whitening
VECTORS = "vec_id long, embedding array<float>, component int, n string, z string"


def whitened(rows):
    """Brute force over the covariance itself: n, deviations, whitened, explained."""
    x = np.floor(1024 * np.array(rows, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    return ((n * x - s).astype(object) ** 2).sum(1), c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_whitening(spark, parts):
    rnd = np.random.default_rng(4)
    rows = (rnd.normal(size=(700, 12)) * np.linspace(1, 3, 12)).astype(np.float32)
    rows[:230] = rows[0]  # a third are copies
    table = [(i, r.tolist(), 0, "", "") for i, r in enumerate(rows)]
    table += [(900, None, 0, "", ""), (901, [1.0, None] * 6, 0, "", ""), (902, [float("nan")] * 12, 0, "", ""), (903, [float("inf")] * 12, 0, "", ""), (904, [], 0, "", ""), (905, [1.0] * 5, 0, "", ""), (906, [3e30] * 12, 0, "", "")]
    got = whitening.whiten(spark.createDataFrame(table, VECTORS).repartition(parts)).toPandas().sort_values(["vec_id", "component"])
    deviation, z, explained = whitened(rows)
    assert got["vec_id"].tolist() == [i for i in range(700) for _ in range(8)] and set(got["n"]) == {700}
    assert got["deviation"].tolist() == [int(d) for d in deviation for _ in range(8)] and got["deviation_digits"].isna().all()
    own = got["whitened"].to_numpy().reshape(700, 8)
    assert np.abs(own * np.sign((own * z).sum(0)) - z).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy()[:8], explained, rtol=1e-9) and got["identity_error"].max() < 1e-9


def test_whitening_merges_losslessly():
    rnd = np.random.default_rng(1)
    x = rnd.integers(99_000, 101_000, size=(500, 9))
    x[:, 8] = x[:, 7]  # a dimension that adds no rank is kept as a dimension
    n, s, w = whitening.merged(whitening.merged(whitening.summary(x[:3]), whitening.summary(x[3:200])), whitening.summary(x[200:]))
    c = x - x.mean(0)
    assert n == 500 and s.tolist() == x.sum(0).tolist() and w.shape == (9, 9)
    assert np.allclose(w.T @ w, c.T @ c, rtol=1e-12, atol=1e-6)


def test_whitening_of_few_and_equal_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None, 0, "", "")])).count() == 0
    got = whitening.whiten(make([(None, [1.0, 2.0], 0, "", ""), (3, [1.0, 2.0], 0, "", ""), (3, [1.0, 2.0], 0, "", "")])).collect()
    assert len(got) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(3, 0, None, None, None)}
    assert collections.Counter((r.vec_id, r.component) for r in got) == {(None, 1): 1, (None, 2): 1, (3, 1): 2, (3, 2): 2}
    got = whitening.whiten(make([(1, [0.0, 0.0], 0, "", ""), (2, [1.0, 0.0], 0, "", "")])).orderBy("vec_id", "component").collect()
    assert [abs(r.whitened) if r.whitened is not None else None for r in got] == [1.0, None, 1.0, None] and got[0].identity_error < 1e-12
    # deviations that fit no long keep their digits
    got = whitening.whiten(make([(1, [1e12], 0, "", ""), (2, [0.0], 0, "", "")])).orderBy("vec_id").first()
    a = int(np.floor(1024 * float(np.float32(1e12))))
    assert got.deviation is None and int(got.deviation_digits) == a * a


# ---------------------------------------------------------------- prefix trie
TURNS = "conv_id long, turn long, role string, text string, key string, id string, bucket string"


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((t is not None, t or 0, tie, (role, text)))
    own = {c: [v[3] for v in sorted(vs)] for c, vs in own.items()}
    base = lambda c: c - (abs(c) % 5) * (1 if c >= 0 else -1)
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    built = {c: tuple(own.get(base(c), [])[: h(c)] + o[h(c) :]) for c, o in own.items()}
    members = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    below, out = collections.defaultdict(list), []
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    childless = {p for p in members if len(below[p]) == 1}
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below[p]), sum(q in childless for q in below[p]), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rnd = random.Random(8)
    say = [(rnd.choice(["user", "bot", None]), rnd.choice(["", "hi", "héllo", "x" * 300, None, "1:a"])) for _ in range(9)]
    rows = []
    for c in [*range(0, 120), *range(-12, 0), 9223372036854775805, -9223372036854775807, 777]:
        own = say[:4] if c % 3 == 0 else [rnd.choice(say) for _ in range(rnd.randrange(1, 12))]
        rows += [(c, t, *turn) for t, turn in enumerate(own)]
    rows += [(777, None, "user", "before all"), (777, 0, "user", "a tie"), (777, 0, "user", "a tie"), (None, 0, "user", "of none"), (500, 3, None, None)]
    rows += [(c, t, "user", f"same {t}" if t < 40 or c % 2 else f"{c}") for c in range(600, 640, 5) for t in range(45)]  # a long chain
    return rows


@pytest.mark.parametrize("how", [{}, {"local_turns": 30, "piece": 8}, {"local_turns": 1, "piece": 1}])
def test_prefix_trie(spark, how):
    rows = conversations()
    table = spark.createDataFrame([(*r, "k", "i", "b") for r in rows], TURNS).repartition(3)
    assert sorted(map(tuple, prefix_trie.trie(table, **how).collect()), key=str) == brute_trie(rows)


def test_trie_of_none_and_of_one(spark):
    make = lambda rows: prefix_trie.trie(spark.createDataFrame([(*r, "", "", "") for r in rows], TURNS)).collect()
    assert make([]) == [] and make([(None, 0, "a", "b")]) == []
    one = [(500, 0, "user", "hello")]  # its base is itself
    assert [tuple(r) for r in sorted(make(one), key=lambda r: r.depth)] == sorted(brute_trie(one), key=lambda r: r[1])
    turnless = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    got = make([(turnless, 0, "user", "lost")])
    assert [tuple(r) for r in got] == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_quicksort_emits_parents_first():
    rnd = random.Random(2)
    rows = [(list(s), [1] * len(s), 1, k, "e") for k, s in enumerate(sorted({tuple(rnd.randrange(4) for _ in range(rnd.randrange(1, 7))) for _ in range(400)}, key=lambda _: rnd.random()))]
    nodes = prefix_trie.quicksorted(rows, 0)
    prefixes = {s[:d] for s in (tuple(r[0]) for r in rows) for d in range(1, len(s) + 1)}
    assert len(nodes) == len(prefixes) and all(n[2] < k for k, n in enumerate(nodes))
    assert sum(n[7] == "e" for n in nodes) == len(rows)


def test_deep_sequences_are_sorted_without_recursion():
    rows = [([7] * 20_000 + [k], [2] * 20_001, 1, k, "e") for k in range(3)]
    nodes = prefix_trie.quicksorted(rows, 0)
    assert len(nodes) == 20_003 and nodes[0][5] == 3 and nodes[0][6] == 20_000 * 2 * 2
