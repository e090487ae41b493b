"""Each corpus operator against brute force on small fixtures: nulls, empty and very long texts, ties,
repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from quorumlake.llm import bloom, bpe, components, exact_dedup, mixing, near_dedup, packing, quality_model, quality_rules, repeats, scratch, sharding, suffix_sort, tokens, toxicity
from quorumlake.llm import shingles as shingles_module
from quorumlake.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _q_h string"
LIBRARY = Tokenizer.from_file(TOKENIZER)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    base = [words(rnd, rnd.randrange(8, 90)) for _ in range(30)]
    near = words(rnd, 60).split()
    copies = []
    for _ in range(50):
        own = list(near)
        own[rnd.randrange(60)] = "zz" + str(rnd.randrange(9))
        copies.append(" ".join(own))
    texts = [*base, *copies, base[0], base[0], base[1].upper(), "", None, "  \n\t ", "a", "a b", "don't stop <|endoftext|> now", words(rnd, 6000), "x" * 70000, base[2] + " tail " + base[3]]
    rows = [(i, t, "en", rnd.choice(["s1", "s2", None]), len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base[4], None, "s1", None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, empty, corpus):
    groups = collections.defaultdict(list)
    for r in corpus:
        groups[r[1] or ""].append(r[0])
    for cells in (1 << 28, 1 << 20):
        got = exact_dedup.exact_groups(docs, max_cells=cells).collect()
        assert len(got) == len(corpus)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in got:
            ids = by_sha[r["text_sha256"]]
            assert r["group_size"] == len(ids)
            assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
        assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_keeps_columns(docs, empty, corpus):
    got = exact_dedup.exact_dedup(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r["text"] or "") for r in rows) == sorted({r[1] or "" for r in corpus})
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_repeats(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(0, 150))) for _ in range(40)]
    texts += [texts[1] + texts[2], texts[3][:60] * 2, "a" * 90, texts[4], None, ""]
    shared = "the same passage of text"
    texts += ["".join(rnd.choice("abcdefgh") for _ in range(30)) + shared[: rnd.randrange(12, 24)] + "".join(rnd.choice("abcdefgh") for _ in range(30)) for _ in range(30)]
    frame = spark.createDataFrame([(None if i == 7 else i % 40, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, kept string, rid string")
    n = 20
    seen = collections.Counter(t.encode()[i : i + n] for t in map(lambda t: t or "", texts) for i in range(len(t) - n + 1))
    want = []
    for t in texts:
        raw = (t or "").encode()
        cover = np.zeros(len(raw), bool)
        for i in range(len(raw) - n + 1):
            if seen[raw[i : i + n]] > 1:
                cover[i : i + n] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], cover.astype(int)])) == 1))
        want.append((len(raw), int(cover.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~cover])))
    for most, piece in ((4096, 1 << 17), (3, 1 << 17), (4096, 61)):  # all sorts at once, in ranges and by strings, in pieces
        got = [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.repeats_removed(frame, n, 6, most, piece).collect()]
        assert sorted(got) == sorted(want)
    assert repeats.repeats_removed(frame.limit(0)).count() == 0


def test_deep_shallow_sort():
    rnd = random.Random(3)
    for _ in range(100):
        pool = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 90))) for _ in range(3)]
        own = [(rnd.choice(pool) * 3)[: rnd.randrange(0, 150)] for _ in range(rnd.randrange(1, 40))]
        for shallow in (0, 8, 64):
            order, lcp = suffix_sort.sorted_with_prefixes(own, shallow)
            assert [own[i] for i in order] == sorted(own)
            assert lcp == [suffix_sort.common(own[a], own[b]) for a, b in zip(order, order[1:])]


def shingles(text):
    own = (text or "").encode().lower().split()
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((str(r[0]), len(sets[i]), str(least.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 16])
def test_near_groups(docs, empty, corpus, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = near_dedup.near_groups(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(corpus)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_groups(empty).count() == 0


def test_near_dedup_keeps_columns(docs):
    got = near_dedup.near_dedup(docs)
    assert got.columns == docs.columns
    kept = {r["doc_id"] for r in got.collect()}
    assert {i for i in kept if i is not None} == {r["doc_id"] for r in near_dedup.near_groups(docs).where("kept").collect()}


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rnd = random.Random(9)
    bases = [words(rnd, 60).split() for _ in range(7)]
    near = lambda b, k: " ".join([*bases[b][:k], "zz", *bases[b][k + 1 :]])
    rows = [(None, near(0, k)) for k in (0, 1, 58, 59)]  # null ids only
    rows += [(7, near(1, 0)), (7, near(1, 59)), (8, near(1, 1))]  # the least id twice, with two texts
    rows += [(9, near(2, 0)), (9, near(2, 0)), (9, near(2, 0))]  # equal rows
    rows += [(None, near(3, 0))] * 3  # equal rows with a null id
    rows += [(None, near(4, 0)), (11, near(4, 59)), (None, near(4, 1))]  # an id among nulls
    rows += [(7, near(5, 0)), (7, near(5, 59))]  # an id that another group has too
    rows += [(None, near(6, 0)), (None, None), (None, None), (3, ""), (3, "")]  # linked with nothing
    frame = spark.createDataFrame([(i, t, "en", None, k, None, None) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    got = near_dedup.near_dedup(frame).collect()
    group = [0] * 4 + [1] * 3 + [2] * 3 + [3] * 3 + [4] * 3 + [5] * 2 + [6, 7, 8, 9, 10]
    assert sorted(group[r["n_chars"]] for r in got) == list(range(11))
    assert all((r["doc_id"], r["text"]) == rows[r["n_chars"]] for r in got)
    assert {group[r["n_chars"]]: r["doc_id"] for r in got} == {0: None, 1: 7, 2: 9, 3: None, 4: 11, 5: 7, 6: None, 7: None, 8: None, 9: 3, 10: 3}


def test_near_groups_at_lower_thresholds(spark):
    assert [near_dedup.band_rows(p) for p in (100, 75, 50, 40, 20, 7)] == [4, 4, 2, 2, 1, 1]
    for percent in (0, 6, 101):
        with pytest.raises(ValueError, match="percent"):
            near_dedup.band_rows(percent)
    rnd = random.Random(11)
    rows = []
    for k in range(150):  # pairs of 80 shingles each that share 40: a third of the union
        own = [f"w{k}x{i}" for i in range(128)]
        rows += [(2 * k, " ".join(own[:84])), (2 * k + 1, " ".join(own[40:124]))]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(len(shingles(t)) == 80 for _, t in rows)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(frame, percent=33).collect()}
    assert got == {i: i - i % 2 for i in range(300)}
    assert near_dedup.near_groups(frame, percent=34).where("kept").count() == 300


def test_posterior_bounds_rise():
    least = near_dedup.least_matches()
    assert least == sorted(least) and 0.55 * 128 < least[-1] < 0.75 * 128


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (5, 4), (9, 8), (8, 7), (7, 6), (2, 1)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark, docs, empty, corpus, tmp_path):
    path = str(tmp_path / "map")
    rows = sharding.shard(docs, 3, map_path=path).collect()
    assert sorted(r["size"] for r in rows) == sorted(len((r[1] or "").encode()) + 1 for r in corpus)
    loads = collections.Counter()
    for s in {r["shard"] for r in rows}:
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        loads[s] = sum(r["size"] for r in own)
    assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in rows)
    first = sharding.SlotMap.load(spark, path)
    assert first.version == 1 and sum(first.rows_of) == len(corpus)
    sizes = [100 + (i % 7) for i in range(sharding.SLOTS)]
    even = sharding.SlotMap.balanced(sizes, [1] * len(sizes), 8)
    grown = even.rebalanced(sizes, [1] * len(sizes), 9)
    moved = [(a, b) for a, b in zip(even.shard_of, grown.shard_of) if a != b]
    assert grown.version == 2 and all(b == 8 for _, b in moved) and len(moved) < 1.1 * len(sizes) / 9
    grown.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == grown and sharding.SlotMap.load(spark, path, 1) == first
    assert sharding.shard(empty, 3).count() == 0


def test_tokens(docs, empty, corpus):
    got = tokens.token_counts(docs, TOKENIZER).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(LIBRARY.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert tokens.token_counts(empty, TOKENIZER).count() == 0


def test_splicing_widens():
    encoder = bpe.encoder(TOKENIZER)
    rnd = random.Random(2)
    marks = list("ab '\n\t19!.sldre") + ["'s", "'ll", "  ", "é", "<|endoftext|>", "日", "\x1c", "\x85"]
    for text in ["".join(rnd.choice(marks) for _ in range(4000)), "x" * 3000 + " " * 900 + "y", ""]:
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        for chunk, lap in ((200, 20), (1000, 64)):
            assert [i for _, ids in bpe.spliced(encoder, text, chunk, lap) for i in ids.tolist()] == want
    for _ in range(200):
        text = "".join(rnd.choice(marks) for _ in range(rnd.randrange(40)))
        assert encoder.encode([text])[1].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_packing(docs, empty, corpus):
    length = 256
    got = packing.pack(docs, TOKENIZER, length=length, open_windows=4).collect()
    want = collections.Counter()
    for r in corpus:
        ids = [*LIBRARY.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[(r[0], len(ids))] += len(ids)
    have = collections.Counter()
    for r in got:
        have[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert have == want
    by_id = {r[0]: [*LIBRARY.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in corpus if r[0] is not None}
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        if r["doc_id"] is not None:
            own = np.array(by_id[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(own.tobytes()) == r["ids_crc32"]
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    assert len(sequences) * length < 1.15 * sum(want.values()) + length
    assert packing.pack(empty, TOKENIZER).count() == 0


def brute_mix(rows):
    sized = [(r[0], r[3], len((r[1] or "").encode().split())) for r in rows]
    size = collections.Counter()
    for _, s, n in sized:
        size[s] += n
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
    return sized, size, target


def test_mixing(docs, empty, corpus):
    got = mixing.mix(docs, range_rows=8).collect()
    sized, size, target = brute_mix(corpus)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), n) for i, _, n in sized)
    by_target = {round(t, 6): s for s, t in target.items()}
    taken = collections.Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        taken[by_target[r["target"]]] += r["taken"]
    assert all(taken[s] == int(t) for s, t in target.items())
    again = mixing.mix(docs.repartition(5), range_rows=100).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(empty).count() == 0


def test_mixed_documents(docs, corpus):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    _, _, target = brute_mix(corpus)
    taken = collections.Counter()
    for r in got.collect():
        taken[r["source"]] += len(r["text"].encode().split())
    assert all(taken[s] == int(t) for s, t in target.items())


def test_quality_rules(spark, docs, empty, corpus):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(corpus)
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert all(r["base_failed"] for r in got if r["n_words"] < 50)
    rnd = random.Random(9)
    prose = lambda: " ".join(words(rnd, 8).capitalize() + "." for _ in range(12))
    good = [(i, prose()) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose().split())) for i in range(8)] + [(200 + i, " ".join(w + " ###" for w in prose().split())) for i in range(8)]
    rows = quality_rules.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()
    assert all(r["kept"] == (r["doc_id"] < 100) for r in rows)
    assert quality_rules.quality_rules(empty).count() == 0


def test_rule_statistics(docs, corpus):
    def brute(text):
        own = (text or "").split()
        own = (text or "").replace("\x0b", " ").encode().split()
        own = [w.decode() for w in own]
        at = collections.defaultdict(list)
        for i in range(len(own) - 2):
            at[tuple(own[i : i + 3])].append(i)
        covered = {x for v in at.values() if len(v) > 1 for i in v for x in (i, i + 1, i + 2)}
        return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(covered)

    got = quality_rules.text_statistics(docs).collect()
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"]) for r in got) == sorted(brute(r[1]) for r in corpus)


def labelled(spark, bad, good, column):
    rnd = random.Random(4)
    rows = [(i, bad(rnd) if i % 4 == 0 else good(rnd)) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1)], f"doc_id long, {column} int")


def held_out_accuracy(frame):
    rows = [r for r in frame.collect() if r["held_out"]]
    return sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in rows) / len(rows)


def test_quality_model(spark, docs, empty):
    own, labels = labelled(spark, lambda r: words(r, 60).upper(), lambda r: words(r, 60), "quality")
    scored = quality_model.quality_scores(own, labels)
    assert held_out_accuracy(scored) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored.collect())
    assert all(0 <= r["score"] <= 1 for r in quality_model.quality_scores(docs, labels).collect())
    assert quality_model.quality_scores(empty, labels).count() == 0
    assert len({r["score"] for r in quality_model.quality_scores(docs, labels.limit(0)).collect()}) == 1


def test_toxicity(spark, docs, empty):
    insults = ["blurgo", "snarfen", "gritzel"]
    good = lambda r: words(r, 50)
    bad = lambda r: words(r, 30) + " " + " ".join(r.choice(insults) for _ in range(4)) + " " + words(r, 10)
    own, labels = labelled(spark, bad, good, "toxic")
    scored = toxicity.toxicity_scores(own, labels)
    assert held_out_accuracy(scored) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored.collect())
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity_scores(docs, labels).collect())
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert all(r["score"] < 0.3 for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect())


def test_tokenizer_is_public():
    assert TOKENIZER == public_tokenizers.path("byte_bpe_50k.json")


def test_sharding_again_edits_the_stored_map(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = [(i, "x" * (i % 50), "en", None, None, None, None) for i in range(3000)]
    sharding.shard(spark.createDataFrame(rows[:2000], SCHEMA), 4, map_path=path)
    first = sharding.SlotMap.load(spark, path)
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 5, map_path=path).collect()
    second = sharding.SlotMap.load(spark, path)
    assert (first.version, second.version, second.shards) == (1, 2, 5)
    assert len(second.shard_of) == sharding.SLOTS and sum(second.rows_of) == len(got) == 3000
    assert all(second.shard_of[r["virtual_slot"]] == r["shard"] for r in got)
    assert sum(a != b for a, b in zip(first.shard_of, second.shard_of)) < sharding.SLOTS / 2
    assert sharding.SlotMap.load(spark, path, 1) == first
    with pytest.raises(ValueError, match="4096 slots"):
        sharding.shard(spark.createDataFrame(rows, SCHEMA), 5, slots=64, map_path=path)


@pytest.mark.parametrize("doc_id", [None, 5])
def test_sharding_deals_equal_rows(spark, monkeypatch, doc_id):
    monkeypatch.setattr(sharding, "RUN", 300)
    rows = [(doc_id, "same text", "en", None, None, None, None)] * 1000 + [(100 + i, "other text", "en", None, None, None, None) for i in range(1000)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 8).collect()
    loads, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r[0], len(r[1]) + 1) for r in rows)
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 11
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_toxic_terms_are_all_kept(spark):
    name = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:03d}")
    rows = [(" ".join(name(k) for k in range(700)), 1.0)] * 5 + [("xyz " * 3, 1.0)] * 4 + [("all is well", 0.0)] * 5
    got = toxicity.mined_terms(spark.createDataFrame(rows, "text string, p double").withColumn("half", F.lit(0)), (2.5, 0.7, 1.5))
    assert got[0, 0] == {name(k) for k in range(700)} | {"xyz"}


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_in_every_base(spark, n):
    """Two such words have one polynomial hash modulo 2^64, whatever the base."""
    a, b = thue_morse(n)
    text = f"{a}1{b}"
    assert bpe.BatchEncoder(TOKENIZER).encode([text, b + " " + a])[1].tolist() == [i for t in (text, b + " " + a) for i in LIBRARY.encode(t, add_special_tokens=False).ids]
    rows = [(1, " ".join([a] * 7)), (2, " ".join([b] * 7)), (3, " ".join([a] * 7)), (4, a), (5, b)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 4), 5: (1, 5)}


def test_long_texts_of_one_pass_and_more(spark):
    rnd = random.Random(8)
    long = words(rnd, 60_000)
    texts = [long, long.upper() + " end", "x" * 300_000 + " " + words(rnd, 20), "", "a b c"]
    assert [len(s) for s in shingles_module.shingle_sets(texts)] == [len(shingles(t)) for t in texts]
    assert [len(s) for s in shingles_module.exact_sets(texts)] == [len(shingles(t)) for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(frame, TOKENIZER).collect()}
    assert counts == {i: len(LIBRARY.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_filters_in_rounds(spark):
    frame = spark.range(6000).select(F.xxhash64(F.col("id") % 5000).alias("h"))
    got = bloom.in_rounds(frame, "h", 6000, max_cells=1 << 11)
    assert bloom.rounds_for(6000, 1 << 11) == 6 and got.count() == 6000
    twice = {r["h"] for r in frame.groupBy("h").count().where("count > 1").collect()}
    maybe = {r["h"] for r in got.where("maybe").collect()}
    assert twice <= maybe and len(maybe) < 2500


def test_model_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    model = quality_model.AdditiveModel.fit(x, y, rounds=20, pair_rounds=20, n_pairs=2)
    for row, got in zip(x[:50], model.scores(x[:50])):
        z = model.base
        for k, (edges, table) in enumerate(zip(model.edges, model.tables)):
            z += table[sum(row[k] >= e for e in edges)]
        for (i, j), table in zip(model.pairs, model.pair_tables):
            a, b = (sum(row[k] >= e for e in model.pair_edges[k]) for k in (i, j))
            z += table[a * (len(model.pair_edges[j]) + 1) + b]
        assert got == pytest.approx(1 / (1 + np.exp(-z)))
    assert ((model.scores(x) > 0.5) == (y == 1)).mean() > 0.9
    assert (0, 1) in model.pairs


def test_label_model_is_a_tree_of_chances():
    rng = np.random.default_rng(5)
    truth = rng.random(3000) < 0.2
    right = lambda a: np.where(rng.random(3000) < a, truth, ~truth)
    a, b, c = right(0.9), right(0.85), right(0.8)
    votes = np.where(np.column_stack([a, b, c, c]), 1, -1)
    votes[rng.random(3000) < 0.3, 0] = 0
    y = np.where(rng.random(3000) < 0.1, truth.astype(float), np.nan)
    p, model = toxicity.label_model(votes, y, 0.2)
    assert model.parent[3] == 2 or model.parent[2] == 3  # the copy depends on its original
    assert np.abs(model.accuracy(votes, p) - [0.9, 0.85, 0.8, 0.8]).max() < 0.06
    for i in range(20):
        z = np.log(model.prior / (1 - model.prior))
        for j, up in enumerate(model.parent):
            if votes[i, j]:
                above = votes[i, up] + 1 if up >= 0 else 0
                z += np.log(model.chances[j][1, above, votes[i, j] + 1] / model.chances[j][0, above, votes[i, j] + 1])
        known = 0 if np.isnan(y[i]) else (1 if y[i] else -1) * np.log(toxicity.TRUST / (1 - toxicity.TRUST))
        assert p[i] == pytest.approx(1 / (1 + np.exp(-(z + known))), abs=1e-3)
    assert ((p > 0.5) == truth).mean() > 0.9


def test_rule_estimates_equal_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    good = rng.random(600) < 0.8
    names = ["a", "b", "c"]
    votes = np.column_stack([np.where(~good & (rng.random(600) < 0.5), -1, 0), np.where(rng.random(600) < np.where(good, 0.9, 0.5), 1, np.where(~good, -1, 0)), np.where(~good & (rng.random(600) < 0.3), -1, 1)])
    prior, tables = quality_rules.estimated(spark.createDataFrame([tuple(map(int, r)) for r in votes], "a int, b int, c int"), names)
    hit, k, n = np.concatenate([votes == -1, votes == 1], 1), 3, 600
    start = [np.repeat([e[c] for e in quality_rules.EXPECTED], k) for c in (0, 1)]
    (bad, fine), share, w = start, quality_rules.GOOD, quality_rules.WEIGHT * n
    for _ in range(quality_rules.MOST):
        p = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + hit @ np.log(fine / bad))))
        wg, wb = w * quality_rules.GOOD, w * (1 - quality_rules.GOOD)
        new = ((1 - p) @ hit + wb * start[0]) / (n - p.sum() + wb), (p @ hit + wg * start[1]) / (p.sum() + wg), (p.sum() + wg) / (n + w)
        moved = max(np.abs(new[0] - bad).max(), np.abs(new[1] - fine).max(), abs(new[2] - share))
        bad, fine, share = new
        if moved < quality_rules.CLOSE:
            break
    assert prior == pytest.approx(share, abs=1e-6)
    for i, name in enumerate(names):
        assert np.ravel(tables[name]) == pytest.approx([bad[i], fine[i], bad[i + k], fine[i + k]], abs=1e-6)


def test_rule_lines_and_verdicts(docs, corpus):
    lines = lambda t: [x for x in (t or "").split("\n") if x.encode().split()]
    got = quality_rules.text_statistics(docs).collect()
    assert sorted((r["n_words"], r["n_dup_lines"]) for r in got) == sorted((len((t or "").encode().split()), len(lines(t)) - len(set(lines(t)))) for t in (r[1] for r in corpus))
    for r in quality_rules.quality_rules(docs).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)


def test_shard_columns(docs, corpus):
    got = sharding.shard(docs, 3).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_slot_map_versions_stay(spark, tmp_path):
    one = sharding.SlotMap.balanced([3, 1, 2], [1, 1, 1], 4)  # more shards than slots: some are empty
    one.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == one
    with pytest.raises(ValueError, match="is there"):
        one.save(spark, str(tmp_path / "map"))


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 5])
def test_mix_of_rows_with_one_key(spark, ids):
    """A third of all rows with one key, or with none, are taken to the word."""
    rows = [(ids(i), f"w{i % 3} " * 5, "en", "s", 15, "x", "y") for i in range(60)] + [(100 + i, "a b c", "en", "t", 5, "x", "y") for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    _, size, target = brute_mix([(r[0], r[1], None, r[3]) for r in rows])
    for got, n in ((mixing.mix(frame, range_rows=7), lambda r: r["taken"]), (mixing.mixed_documents(frame, range_rows=7), lambda r: len(r["text"].split()))):
        assert sum(n(r) for r in got.collect()) == sum(int(t) for t in target.values())


def test_pipeline(spark, tmp_path):
    """Every stage against brute force, on what the one before kept."""
    import corpus_pipeline as pipeline

    rnd = random.Random(12)
    base = [words(rnd, rnd.randrange(20, 90)) for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in words(rnd, 40).split()) for _ in range(20)]
    texts = base + junk + base[:5] + [base[7] + " tail", None, "", words(rnd, 5000)]
    rows = [(i, t, "en", rnd.choice(["a", "b", None]), len(t or ""), "clash") for i, t in enumerate(texts)] + [(None, base[9], "en", "a", 5, "clash"), (0, base[0], "en", "a", 5, "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60)) for i in range(80)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append((before.collect(), docs.collect()))
        assert stage(spark, before.limit(0), str(tmp_path)).count() == 0
    (_, a), (_, b), (_, c), (_, d) = kept
    assert {r["text"] for r in a} >= set(base) and not {r["text"] for r in a} & set(junk)
    groups = collections.defaultdict(list)
    for r in a:
        groups[r["text"] or ""].append(r["doc_id"])
    assert sorted((r["text"] or "", str(r["doc_id"])) for r in b) == sorted((t, str(max((i for i in ids if i is not None), default=None))) for t, ids in groups.items())
    wanted = {x[2] for x in brute_components([(r["doc_id"], r["text"]) for r in b])}
    assert {str(r["doc_id"]) for r in c} == wanted and len(c) == len(wanted)
    _, _, target = brute_mix([(r["doc_id"], r["text"], None, r["source"]) for r in c])
    taken = collections.Counter()
    for r in d:
        taken[r["source"]] += len(r["text"].encode().split())
    assert all(taken[s] == int(t) for s, t in target.items())
    packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r["length"] for r in packed) == sum(len(LIBRARY.encode(r["text"], add_special_tokens=False).ids) + 1 for r in d)
    assert pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_scratch_is_cleared(spark):
    held = scratch.stored(spark.range(3), "three")
    assert held.count() == 3
    scratch.clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(scratch._own_folder(spark))


def test_windows_of_one_hash_are_told_apart(spark):
    """xxhash64 of ``north wind sunlightoverhill`` is that of the last three words."""
    text = "north wind sunlightoverhill and then bright lamp dwdnboel.7svK?AM"
    frame = spark.createDataFrame([(1, text), (2, f"{text} {text}"), (3, f"{text} x north wind sunlightoverhill")], "doc_id long, text string")
    w = F.split("text", " ")
    one, other = (F.xxhash64(*[F.get(w, i + k) for k in range(3)]) for i in (0, 5))
    assert frame.where("doc_id = 1").select(one == other).first()[0]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.text_statistics(frame).collect()}
    assert got == {1: 0, 2: 16, 3: 6}


def test_near_dedup_rows_without_ids(spark):
    """Groups of rows with null and repeated ids keep one row each, and no group is lost."""
    rnd = random.Random(31)
    rows, groups = [], []
    for g in range(12):
        own = words(rnd, 60).split()
        texts = [" ".join(own)] + [" ".join(own[:k] + ["zz"] + own[k + 1 :]) for k in rnd.sample(range(60), 2)] + [" ".join(own)] * (g % 3)
        ids = [[None, None, None], [None, 5, None], [7, 7, 7], [None, 7, 5]][g % 4] + [None] * (g % 3)
        rows += list(zip(ids, texts))
        groups.append((ids, set(texts)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for ids, texts in groups:
        assert [r.doc_id for r in got if r.text in texts] == [min((i for i in ids if i is not None), default=None)]
    assert len(got) == len(groups)


def test_repeats_with_filters_in_rounds(spark, docs):
    """A filter far too small for the anchors is not one that lets all pass, but several: the result stays."""
    long = spark.createDataFrame([(i, "en", words(random.Random(i % 7), 400) + str(i)) for i in range(40)], "doc_id long, lang string, text string")
    want = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.repeats_removed(long).collect())
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.repeats_removed(long, max_cells=1 << 10).collect())
    assert got == want and sum(r[2] for r in got) > 0


def test_a_filter_that_cannot_serve_is_not_built(spark, monkeypatch):
    monkeypatch.setattr(bloom, "_hit", lambda *_, **__: pytest.fail("built"))
    frame = spark.range(5000).select(F.xxhash64("id").alias("h"))
    for build in (bloom.possibly_in, bloom.possibly_repeated):
        assert frame.where(build(frame, "h", 5000, 1 << 10)(F.col("h"))).count() == 5000
