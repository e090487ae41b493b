"""MinHash near-dedup with sequential Bayesian verification.

Every distinct shingle set gets a signature of HASHES minhashes. Sets that share a band of up to ROWS
hashes (fewer for a threshold under 75 %: see band_rows) are candidates; inside their bucket their signatures are compared batch by batch, and a pair
is dropped as soon as the posterior probability that its similarity reaches the threshold falls
below MISS. Survivors are verified on the words of the full texts. Equal sets are one node
throughout, and a large bucket never emits all its pairs: see SMALL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import possibly_in
from .components import components
from .scratch import bounded_batches, fresh, join_keyed, join_salted, released, stored, utf8
from .shingles import exact_sets, mixed, set_digest, shingle_sets

#: Similarity as intersection over union, in whole percent.
PERCENT = 75
HASHES, ROWS = 128, 4
BATCH = 32
#: Probability of dropping a pair that reaches the threshold, at each batch.
MISS = 1e-4
#: Largest probability that a pair exactly at the threshold shares no band.
UNSEEN = 1e-4
#: A bucket of more nodes than two blocks is compared in pairs of blocks of about BLOCK nodes; where
#: their texts are needed too, of at most about BLOCK_BYTES of them.
BLOCK = 1024
BLOCK_BYTES = 2 << 20
#: A bucket of at most this many nodes sends all its surviving pairs. Of a larger one, each node sends
#: those with its PARTNERS most similar partners; the rest, where its ends are not connected by then,
#: are verified inside the bucket, which gets the texts of such ends and sends links only. A pair
#: belongs to its first large bucket.
SMALL = 32
PARTNERS = 4
#: Characters of texts whose words are numbered together when links are verified.
VERIFIED_CHARS = 1 << 19

_KEY = ["bucket", "lo", "hi"]
_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_SEED = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def band_rows(percent: int) -> int:
    """Hashes in a band: the most, up to ROWS, at which a pair of ``percent`` is a candidate but with
    probability UNSEEN. Single hashes serve 7 % and more; a lower threshold is refused."""
    for rows in range(ROWS, 0, -1):
        if 0 < percent <= 100 and (1 - (percent / 100) ** rows) ** (HASHES // rows) <= UNSEEN:
            return rows
    raise ValueError(f"percent must be from 7 to 100, not {percent}: {HASHES} hashes do not find pairs of lower similarity")


def least_matches(percent: int = PERCENT, miss: float = MISS, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest matching bytes of a signature at which a pair goes on.

    With a uniform prior, the posterior of the match rate after m of n matches is Beta(m+1, n-m+1);
    it reaches t with probability P(Binomial(n+1, t) <= m). Bytes of different minhashes also match
    once in 256 times, which raises the rate that stands for the threshold.
    """
    t = percent / 100
    t += (1 - t) / 256
    out = []
    for n in range(batch, HASHES + 1, batch):
        p, m = 0.0, -1
        while p < miss:
            m += 1
            p += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def signatures(sets: list[np.ndarray], in_band: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Byte signatures and 64-bit hashes of the bands of ``in_band`` minhashes, of non-empty sets."""
    heads = np.cumsum([0] + [len(s) for s in sets])[:-1]
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        least[:, k] = np.minimum.reduceat(h * _MULTIPLY[k] + _ADD[k], heads)
    n = HASHES // in_band
    rows = least[:, : n * in_band].astype(np.uint64).reshape(len(sets), n, in_band)
    bands = np.broadcast_to(_SEED[:n], (len(sets), n)).copy()
    for r in range(in_band):
        bands = mixed(bands + rows[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8), bands.view(np.int64)


def _chunks(sizes: list[int], most: int):
    """Runs of rows of at most ``most`` in all, or of one row."""
    begin, size = 0, 0
    for i, n in enumerate(sizes):
        if size + n > most and i > begin:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _described(batches: Iterator[pd.Series], in_band: int) -> Iterator[pd.DataFrame]:
    for texts in batches:
        sets = shingle_sets(texts.tolist())
        n = np.array([len(s) for s in sets], np.int64)
        fp, sig, bands = ([None] * len(sets) for _ in range(3))
        full = np.flatnonzero(n)
        own = [sets[i] for i in full]
        for b, e in _chunks([len(x) for x in own], 1 << 17):
            s, hashes = signatures(own[b:e], in_band)
            for i, at in enumerate(full[b:e].tolist()):
                fp[at] = set_digest(own[b + i])
                sig[at], bands[at] = s[i].tobytes(), hashes[i].tolist()
        yield pd.DataFrame({"n": n, "fp": fp, "sig": sig, "bands": bands})
    released()


def _survivors(sig: np.ndarray, i: int, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the rows ``j`` whose pair with row ``i`` no batch drops, and their matches."""
    m = np.zeros(len(j), np.int64)
    for b, need in enumerate(least):
        at = slice(b * BATCH, (b + 1) * BATCH)
        m = m + np.count_nonzero(sig[j, at] == sig[i, at], axis=1)
        on = m >= need
        j, m = j[on], m[on]
    return j, m


class _Bucket:
    """A bucket, or a pair of its blocks: its nodes in order and who is compared with whom."""

    def __init__(self, rows: dict):
        self.order = np.argsort(rows["nid"])
        self.nodes = rows["nid"][self.order]
        self.sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(self.order), HASHES)[self.order]
        bands = np.stack(rows["bands"])[self.order]
        self.earlier = bands[:, : int(np.flatnonzero(bands[0] == rows["bucket"][0])[0])]
        self.block = rows["block"][self.order] if rows["lo"][0] != rows["hi"][0] else None
        self.root = rows["root"][self.order] if "root" in rows else None

    def partners(self, i: int, least: list[int], after: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the other block, if there are two, and of other roots, if these are known, that share
        no earlier band with row ``i`` and survive with it; ``after``: only those that follow it."""
        j = np.arange(i + 1 if after else 0, len(self.sig))
        on = j != i
        if self.block is not None:
            on &= self.block[j] != self.block[i]
        if self.root is not None:
            on &= self.root[j] != self.root[i]
        j, m = _survivors(self.sig, i, j[on], least)
        if self.earlier.shape[1]:
            on = ~(self.earlier[j] == self.earlier[i]).any(1)
            j, m = j[on], m[on]
        return j, m


def _surviving_twos(sig: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the pairs of rows 0 and 1, 2 and 3, and so on no batch drops."""
    on = np.arange(len(sig) // 2)
    m = np.zeros(len(on), np.int64)
    for b, need in enumerate(least):
        at = slice(b * BATCH, (b + 1) * BATCH)
        m = m + (sig[2 * on, at] == sig[2 * on + 1, at]).sum(1)
        on, m = on[m >= need], m[m >= need]
    return on


def _grouped_rows(batches):
    """Rows of whole buckets, as arrays by column; rows arrive sorted by bucket and blocks."""
    held: dict | None = None
    for pdf in batches:
        rows = {c: pdf[c].to_numpy() for c in pdf.columns}
        if held is not None:
            rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
        if not len(rows["nid"]):
            continue
        same = np.ones(len(rows["nid"]), bool)
        for c in _KEY:
            same &= rows[c] == rows[c][-1]
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if last:
            yield {c: v[:last] for c, v in rows.items()}
        held = {c: v[last:] for c, v in rows.items()}
    if held is not None and len(held["nid"]):
        yield held


def _cuts(rows: dict) -> tuple[np.ndarray, np.ndarray]:
    size = len(rows["nid"])
    new = np.zeros(size, bool)
    new[0] = True
    for c in _KEY:
        new[1:] |= rows[c][1:] != rows[c][:-1]
    cuts = np.flatnonzero(new)
    return cuts, np.append(cuts[1:], size)


def _compare(batches, least: list[int]):
    """Sends the pairs to verify: all survivors of small buckets, and of large ones those of each node
    with its PARTNERS most similar partners. A row of -1 says that more pairs remain."""

    def large(rows: dict):
        own, out, more = _Bucket(rows), [], False
        for i in range(len(own.nodes)):
            j, m = own.partners(i, least)
            more |= len(j) > PARTNERS
            j = j[np.argsort(-m, kind="stable")[:PARTNERS]]
            out.append(_pairs(own.nodes, np.full(len(j), i), j))
        return [*out, np.full((1, 2), -1, np.int64)] if more else out

    def small(rows: dict, cuts: np.ndarray, ends: np.ndarray):
        out = []
        two = cuts[ends - cuts == 2]
        both = np.column_stack([two, two + 1]).ravel()
        if len(both):
            sig = np.frombuffer(b"".join(rows["sig"][both]), np.uint8).reshape(len(both), HASHES)
            at = two[_surviving_twos(sig, least)]
            out.append(_pairs(rows["nid"], at, at + 1))
        for b, e in zip(cuts.tolist(), ends.tolist()):
            if e - b > 2:
                sig = np.frombuffer(b"".join(rows["sig"][b:e]), np.uint8).reshape(e - b, HASHES)
                for i in range(e - b - 1):
                    j, _ = _survivors(sig, i, np.arange(i + 1, e - b), least)
                    out.append(_pairs(rows["nid"], np.full(len(j), b + i), b + j))
        return out

    for rows in _grouped_rows(batches):
        cuts, ends = _cuts(rows)
        is_large = rows["n"][cuts] > SMALL
        out = small(rows, cuts[~is_large], ends[~is_large])
        for b, e in zip(cuts[is_large].tolist(), ends[is_large].tolist()):
            out += large({c: v[b:e] for c, v in rows.items()}) if e - b > 1 else []
        yield pd.DataFrame(np.concatenate([np.zeros((0, 2), np.int64), *out]), columns=["na", "nb"])
    released()


def _each_bucket(batches):
    for rows in _grouped_rows(batches):
        for b, e in zip(*(x.tolist() for x in _cuts(rows))):
            yield {c: v[b:e] for c, v in rows.items()}


def _still_apart(batches, least: list[int]):
    """The nodes of large buckets that survive with a node of another root."""
    for rows in _each_bucket(batches):
        own = _Bucket(rows)
        on = np.zeros(len(own.nodes), bool)
        for i in range(len(on)):
            j, _ = own.partners(i, least, after=True)
            on[j] = True
            on[i] |= len(j) > 0
        yield pd.DataFrame({"bucket": rows["bucket"][0], "nid": own.nodes[on]})


def _link_inside(batches, least: list[int], percent: int):
    """Links that connect what is not connected yet, of large buckets whose rows have their texts.

    Survivors are verified most similar first, and only while their ends lie apart; so each link sent
    joins two components, and there are fewer of them than nodes.
    """
    for rows in _each_bucket(batches):
        own = _Bucket(rows)
        root = dict(zip(own.root.tolist(), own.root.tolist()))
        at = own.root.tolist()

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = [own.partners(i, least, after=True) for i in range(len(at))]
        i = np.repeat(np.arange(len(at), dtype=np.int32), [len(j) for j, _ in found])
        j, m = (np.concatenate([f[k] for f in found]).astype(np.int32) for k in (0, 1))
        used = np.unique(np.concatenate([i, j]))
        sets = dict(zip(used.tolist(), exact_sets(rows["text"][own.order][used].tolist())))
        out = []
        for k in np.argsort(-m, kind="stable").tolist():
            x, y = int(i[k]), int(j[k])
            if (a := find(at[x])) == (c := find(at[y])):
                continue
            if _alike(sets[x], sets[y], percent):
                root[a] = c
                out.append((own.nodes[x], own.nodes[y]))
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    released()


def _pairs(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """(smaller node, larger node) of pairs of rows."""
    return np.column_stack([np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])])


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(batches, percent: int):
    for pdf in batches:
        ta, tb = pdf["ta"].tolist(), pdf["tb"].tolist()
        on = np.zeros(len(pdf), bool)
        for b, e in _chunks([x + y for x, y in zip(map(len, ta), map(len, tb))], VERIFIED_CHARS):
            sets = exact_sets(ta[b:e] + tb[b:e])
            on[b:e] = [_alike(sets[k], sets[e - b + k], percent) for k in range(e - b)]
        yield pdf.loc[on, ["na", "nb"]].rename(columns={"na": "a", "nb": "b"})
    released()


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _texts_of(wanted: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """(nid, text) of the nodes ``wanted`` (nid, th): a filter keeps other texts from being shuffled."""
    wanted = stored(wanted, "ends")
    short = lambda c: F.xxhash64(c)
    hit = possibly_in(wanted.select(short(F.col("th")).alias("h")), "h", wanted.count())
    texts = docs.select(_text_key(text).alias("th"), text.alias("text")).where(hit(short(F.col("th")))).dropDuplicates(["th"])
    return texts.join(wanted, "th").select("nid", "text")


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: Column, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    ends = pairs.select(F.col("na").alias("nid")).unionByName(pairs.select(F.col("nb").alias("nid"))).distinct()
    texts = _texts_of(ends.join(nodes.select("nid", "th"), "nid"), docs, text)
    a, b = (texts.select(F.col("nid").alias(f"n{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
    total = pairs.count()
    joined = join_salted(join_salted(pairs, a, "na", total, "nb"), b, "nb", total, "na", pairs)
    return stored(joined.select("na", "nb", "ta", "tb").mapInPandas(partial(_verified, percent=percent), "a long, b long"), "verified")


def _in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """Each node of a bucket of several ``blocks`` once for each pair of blocks that holds its own."""
    return (
        members.withColumn("blocks", blocks.cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .drop("blocks", "other")
    )


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Documents are linked when 100 * intersection >= percent * union of their shingle sets. Null and
    empty texts, and texts without words, have an empty set and are their own component. Rows of one
    id share what their texts are linked to; null ids never name a component that has another id, and
    are not kept. Texts of any length are read whole. An empty table gives no rows. ``percent`` is from
    7 to 100; a pair exactly at it is missed by the bands with probability UNSEEN at most, and by each
    batch of the signatures with probability ``miss``.
    """
    return _grouped(docs, id_col, text_col, percent, miss).drop("row_key", "root", "group_rows")


def _row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: the id itself, null or not, and the SHA-256 of the text."""
    own = F.col(id_col).cast("string")
    return F.concat(F.when(own.isNull(), F.lit("null")).otherwise(F.concat(F.lit("id "), own)).cast("binary"), _text_key(utf8(text_col)))


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, miss: float) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    text = utf8(text_col)
    in_band = band_rows(percent)

    @F.pandas_udf("n long, fp binary, sig binary, bands array<long>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _described(batches, in_band)

    described = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), _text_key(text).alias("th"), F.octet_length(text).alias("size"), _row_key(id_col, text_col).alias("row_key"),
            F.monotonically_increasing_id().alias("rid"), describe(text).alias("d"),
        ).select("doc_id", "th", "size", "row_key", "rid", "d.*"),
        "near-signatures",
    )
    total = described.count()
    full = described.where(F.col("fp").isNotNull())
    sets = stored(full.groupBy("fp").agg(F.min("rid").alias("nid"), F.count("*").alias("n_rows"), F.min("doc_id").alias("least_id")), "near-sets")
    nodes = stored(
        full.select("rid", "th", "size", "sig", "bands").join(sets.select(F.col("nid").alias("rid")), "rid").withColumnRenamed("rid", "nid"), "near-nodes"
    )
    banded = nodes.select("nid", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = _in_blocks(banded.join(shared, "bucket"), F.when(F.col("n") > 2 * BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(1))
    members = stored(members.join(nodes.select("nid", "sig", "bands"), "nid").withColumn("bands", F.when(F.col("n") > SMALL, F.col("bands"))), "near-members")
    least = least_matches(percent, miss)
    sent = stored(_dealt(members).mapInPandas(partial(_compare, least=least), "na long, nb long").distinct(), "candidates")
    links = _verify(sent.where("na >= 0"), nodes, docs, text, percent)
    stars = components(links)
    if sent.where("na < 0").limit(1).count():
        more = _rest_of_large(members.where(F.col("n") > SMALL), stars, nodes, docs, text, least, percent)
        stars = components(links.unionByName(more))
    named = sets.join(stars.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n_rows").alias("group_rows"))
    table = stored(named.join(ids, "root").select("fp", "n_rows", "component_id", "root", "group_rows"), "near-components")
    linked = join_keyed(full.select("doc_id", "row_key", "n", "fp"), table, "fp", "n_rows", total)
    alone = described.where(F.col("fp").isNull()).withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone, allowMissingColumns=True).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "row_key", "root", "group_rows",
    )


def _rest_of_large(members: DataFrame, stars: DataFrame, nodes: DataFrame, docs: DataFrame, text: Column, least: list[int], percent: int) -> DataFrame:
    """Links between components that large buckets hold and their nodes' best partners did not show.

    Only buckets of several components are looked at, and of these only nodes that survive with one of
    another component get their texts.
    """
    rows = members.join(stars.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    apart = rows.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("bucket")
    rows = stored(rows.join(apart, "bucket"), "near-apart")
    on = stored(_dealt(rows).mapInPandas(partial(_still_apart, least=least), "bucket long, nid long").distinct(), "near-apart-nodes")
    sized = on.join(nodes.select("nid", "size"), "nid")
    per = sized.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    several = F.ceil(F.greatest(F.col("n") / (2 * BLOCK), F.col("bytes") / BLOCK_BYTES))
    placed = _in_blocks(on.join(per, "bucket"), F.greatest(several, F.lit(1))).drop("n", "bytes")
    own = rows.select("bucket", "nid", "root").distinct().join(placed, ["bucket", "nid"]).join(nodes.select("nid", "sig", "bands"), "nid")
    texts = _texts_of(on.select("nid").distinct().join(nodes.select("nid", "th"), "nid"), docs, text)
    return stored(_dealt(own.join(texts, "nid")).mapInPandas(partial(_link_inside, least=least, percent=percent), "a long, b long"), "verified")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """One row of each group of linked rows of ``docs``, and all rows that are linked with nothing; all
    columns kept.

    The row with the least id stays, one with a null id only where all are null; of several with that id,
    the one with the least SHA-256 of the text, and any one of those that have both in common.

    Rows to keep pass straight through; only those that a filter of the dropped and the repeated rows
    may hold are shuffled. The filters go by 64-bit hashes, which only let more rows through; what goes and
    what stays is decided by id and SHA-256.
    """
    grouped = _grouped(docs, id_col, text_col, percent, miss)
    linked = stored(grouped.where("group_rows > 1").select("row_key", "root", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first")), "near-linked")
    stay = linked.where("first").groupBy("root").agg(F.min("row_key").alias("row_key")).select("row_key", F.lit(True).alias("stays"))
    keys = linked.groupBy("row_key").agg(F.count("*").alias("n")).join(stay, "row_key", "left").withColumn("stays", F.col("stays").isNotNull())
    held = stored(keys.where("n > 1 or not stays").select("row_key", "stays", F.xxhash64("row_key").alias("h")), "near-dropped")
    key, maybe = fresh(docs, "key", "maybe")
    may_be_held = possibly_in(held, "h", held.count())
    marked = docs.withColumn(key, _row_key(id_col, text_col))
    split = marked.withColumn(maybe, may_be_held(F.xxhash64(key)))
    own = [F.col(f"`{c}`") for c in marked.columns]
    kept = split.where(~F.col(maybe)).select(*own).unionByName(
        split.where(F.col(maybe)).join(held.select(F.col("row_key").alias(key)), key, "left_anti").select(*own)
    )
    repeated = held.where("stays").select("row_key", "h")
    if n := repeated.count():
        may_be_repeated = possibly_in(repeated, "h", n)
        single = marked.where(may_be_repeated(F.xxhash64(key))).dropDuplicates([key])
        kept = kept.unionByName(single.join(repeated.select(F.col("row_key").alias(key)), key, "left_semi").select(*own))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


#: Brute force over all pairs of documents that share a shingle: for small tables.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS own FROM d),
e AS (SELECT doc_id, len(own) AS n, unnest(own) AS x FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.doc_id),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(own)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least USING (doc_id)
"""
