"""Suffix-array dedup: removal of bytes that long repeated strings cover.

Every LENGTH-byte string holds an anchor: the place of the least GRAM-byte hash in it, the leftmost
of ties. Equal strings have their anchors at the same place, so only suffixes at anchors need to be
sorted, one position in about eighty. The strings that share an anchor are one context. Contexts of
the same gram are sorted, to the right and, reversed, to the left of the anchor, and the common
prefixes in both orders say which of their strings occur in another. A context that occurs twice, by
the hash of its gram and two more of its bytes, is one row with its count, and repeated whole.

A sort holds at most MOST contexts. The contexts of a gram that has more are dealt by the bytes
around the anchor: those that a string which starts in a given range of places before the anchor has
in any case. Contexts without these bytes in common share no string there, so each of the finer
groups is sorted by itself for its range. What still has more than MOST contexts agrees in nearly all
bytes of a string, and is dealt once more by whole strings, of which equal ones need no order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_CELLS, in_rounds, possibly_in
from .scratch import bounded_batches, join_keyed, released, stored, utf8
from .shingles import PRIME, mixed, prime_powers
from .suffix_sort import sorted_with_prefixes

LENGTH = 200
GRAM = 40
#: Most contexts of one sort, and the ranges of places that larger groups are dealt by.
MOST = 4096
RANGES = 13
_PIECE = 1 << 17
_POSITION = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_CONTEXT = ["h", "ctx", "ctx2"]
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.full(max(n, 2 * _PIECE + 1), x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def _anchors_of(buf: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Anchors of the documents joined in ``buf`` that end at ``ends``: place, first and last string
    start, gram hash, two context hashes."""
    n = len(buf)
    up, down = _tables(n + 1)
    plus = buf.astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(plus * up[:n])])
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    w = length - gram + 1
    key = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    pad = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(key)] = key
    blocks = pad.reshape(-1, w)
    front = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - length + 1], front[w - 1 : n - length + w])
    heads = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(n + 2, np.int32)
    full = ends - heads >= length
    np.add.at(edge, heads[full], 1)
    np.add.at(edge, ends[full] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge)[: n - length + 1])
    if not len(starts):
        return None
    place = (least[starts] & _POSITION).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    at, first, last = place[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]
    form = mixed(((at - first) * 1024 + (last - first)).astype(np.uint64) + np.uint64(1))
    context = mixed((sums[last + length] - sums[first]) * down[first] + form)
    second = form
    for ups, downs in prime_powers(n + 1):  # a sum has at most 2^18 terms below 2^40
        own = np.concatenate([np.zeros(1, np.uint64), np.cumsum(plus * ups[:n])])
        second = mixed(second + (own[last + length] - own[first]) % PRIME * downs[first] % PRIME)
    return at, first, last, grams[at], context, second


def _anchors(batches: Iterator[pd.DataFrame], length: int, gram: int, most_bytes: int = _PIECE) -> Iterator[pd.DataFrame]:
    def found(pieces):
        raws = [raw for _, _, raw in pieces]
        ends = np.cumsum([len(r) for r in raws])
        if ends[-1] < length:
            return
        got = _anchors_of(np.frombuffer(b"".join(raws), np.uint8), ends, length, gram)
        if got is None:
            return
        at, first, last, h, context, second = got
        doc = np.searchsorted(ends, at, side="right")
        shift = np.array([s for _, s, _ in pieces])[doc] - np.concatenate([[0], ends[:-1]])[doc]
        yield pd.DataFrame({
            "h": h.view(np.int64), "ctx": context.view(np.int64), "ctx2": second.view(np.int64), "rid": np.array([r for r, _, _ in pieces])[doc],
            "pos": at + shift, "lo": (at - first).astype(np.int32), "hi": (last + length - at).astype(np.int32),
        })

    for pdf in batches:
        group, size = [], 0
        for rid, raw in zip(pdf["rid"].tolist(), pdf["raw"]):
            for shift in range(0, max(1, len(raw) - length + 1), most_bytes - length + 1):
                piece = raw[shift : shift + most_bytes]
                if size + len(piece) > 2 * most_bytes - 1:
                    yield from found(group)
                    group, size = [], 0
                group.append((rid, shift, piece))
                size += len(piece)
        if group:
            yield from found(group)
    released()


def repeated_strings(contexts: list[bytes], lo: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Of contexts that share their anchor's gram: for each the runs (least, most) of places before
    the anchor at which a string of ``length`` bytes starts that occurs at that place in another.

    A string that starts l before the anchor occurs in another context if the two agree on l bytes to
    the left and length - l to the right. Sorted by what follows the anchor, contexts that agree on d
    bytes are neighbours; among these, sorted by what precedes it, the neighbour agrees on most.
    """
    n = len(contexts)
    right = [c[p:] for c, p in zip(contexts, lo)]
    left = [c[:p][::-1] for c, p in zip(contexts, lo)]
    order, lcp = sorted_with_prefixes(right)
    by_left, left_lcp = sorted_with_prefixes(left)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    order, lcp = np.array(order), np.array(lcp)
    table = [np.array(left_lcp)]
    while 2 ** len(table) < n:
        half = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    marks = np.zeros((n, length + 2), np.int32)
    for d in np.unique(lcp):
        run = np.concatenate([[0], np.cumsum(lcp < d)])
        by = np.lexsort((rank[order], run))
        near = np.flatnonzero(run[by][1:] == run[by][:-1])
        a, b = order[by[near]], order[by[near + 1]]
        i, j = rank[a], rank[b]
        level = np.log2(j - i).astype(int)
        agreed = np.empty(len(i), np.int64)
        for k in np.unique(level):
            own = level == k
            agreed[own] = np.minimum(table[k][i[own]], table[k][j[own] - 2**k])
        on = agreed + d >= length
        for side in (a[on], b[on]):
            np.add.at(marks, (side, length - d), 1)
            np.add.at(marks, (side, agreed[on] + 1), -1)
    covered = np.zeros((n, length + 3), np.int8)
    covered[:, 1:] = marks.cumsum(1) > 0
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    who, begin = np.nonzero((covered[:, 1:] == 1) & (covered[:, :-1] == 0))
    _, end = np.nonzero((covered[:, 1:] == 0) & (covered[:, :-1] == 1))
    for i, b, e in zip(who.tolist(), begin.tolist(), end.tolist()):
        out[i].append((b, e - 1))
    return out


def _runs(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """The runs of each context; rows come sorted by group, so a group is held, and no more."""
    held: list[tuple] = []

    def decided(rows):
        runs = repeated_strings([r[2] for r in rows], [r[3] for r in rows], length)
        return [(*row[1], -most, length - least) for row, own in zip(rows, runs) for least, most in own]

    def frame(out):
        return pd.DataFrame(out, columns=[*_CONTEXT, "b", "e"])

    for pdf in batches:
        out = []
        keys = zip(pdf["h"].tolist(), pdf["part"].tolist(), pdf["fixed"].tolist())
        for key, *own, raw, lo in zip(keys, *(pdf[c].tolist() for c in _CONTEXT), pdf["bytes"], pdf["lo"].tolist()):
            if held and held[-1][0] != key:
                out += decided(held) if len(held) > 1 else []
                held = []
            held.append((key, own, raw, lo))
        if out:
            yield frame(out)
    if len(held) > 1:
        yield frame(decided(held))
    released()


def _repeated_runs(pieces: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """(h, ctx, ctx2, b, e): runs of bytes, counted from the anchor, that repeated strings cover.
    ``pieces`` has a context's bytes, ``lo`` of them before the anchor, and k, the contexts of its gram."""
    own = [*_CONTEXT, "part", "fixed", "bytes", "lo"]
    sortable = pieces.where(F.col("k") <= most).withColumns({"part": F.lit(-1), "fixed": F.lit("")}).select(*own)
    large = pieces.where(F.col("k") > most)
    extra = None
    if large.limit(1).count():
        width = -(-(length - gram + 1) // RANGES)
        a, b = F.col("part") * width, F.least((F.col("part") + 1) * width, F.lit(length - gram + 1)) - 1
        ranged = (
            large.drop("k").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-(length - gram + 1) // width) - 1))))
            .withColumns({"a": a, "b": b}).where("lo >= a and hi >= {0} - b".format(length))
            .withColumn("fixed", F.md5(F.expr(f"substring(bytes, lo - a + 1, a + {length} - b)")))
        )
        ranged = stored(ranged, "ranged")
        group = ["h", "part", "fixed"]
        sized = ranged.groupBy(*group).agg(F.count("*").alias("k")).where("k > 1")
        dealt = stored(join_keyed(ranged, sized, group, "k", ranged.count()), "dealt")
        window = F.expr(f"substring(bytes, lo - least(lo, b) + 1, least(lo, b) + least(hi, {length} - a))")
        small = dealt.where(F.col("k") <= most).select(*_CONTEXT, "part", "fixed", window.alias("bytes"), F.least("lo", "b").alias("lo"))
        sortable = sortable.unionByName(small)
        places = F.explode(F.sequence(F.greatest("a", F.lit(length) - F.col("hi")), F.least("b", "lo")))
        every = dealt.where(F.col("k") > most).withColumn("l", places).select(*_CONTEXT, "l", F.md5(F.expr(f"substring(bytes, lo - l + 1, {length})")).alias("s"))
        every = stored(every, "strings")
        twice = every.groupBy("h", "l", "s").agg(F.count("*").alias("k")).where("k > 1")
        extra = join_keyed(every, twice, ["h", "l", "s"], "k", every.count()).select(*_CONTEXT, (-F.col("l")).alias("b"), (length - F.col("l")).alias("e"))
    group = ["h", "part", "fixed"]
    runs = sortable.repartition(*group).sortWithinPartitions(*group, "ctx", "ctx2").mapInPandas(
        partial(_runs, length=length), "h long, ctx long, ctx2 long, b int, e int"
    )
    return runs if extra is None else runs.unionByName(extra)


def _cut(raws: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for raw, own in zip(raws, spans):
        kept, at, removed, n = [], 0, 0, 0
        for s in sorted((x["b"], x["e"]) for x in own) if own is not None else []:
            if n and s[0] <= at:
                if s[1] > at:
                    removed += s[1] - at
                    at = s[1]
                continue
            kept.append(raw[at : s[0]])
            removed += s[1] - s[0]
            at, n = s[1], n + 1
        kept.append(raw[at:])
        out.append((removed, n, b"".join(kept)))
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])


def repeats_removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, piece: int = _PIECE, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of every row of ``docs``.

    Removed is each byte covered by a ``length``-byte string that also starts elsewhere in any
    document, the same one included; strings are judged on the input and do not cross documents. A
    null text counts as empty. Rows are told apart by position, so null and repeated ids do not
    matter; repeated rows repeat each other's strings. Very long texts are read in overlapping pieces and
    give what they would as a whole; other columns, whatever their names, are not read. An empty table
    gives no rows. ``most`` bounds the contexts of one sort, and
    ``piece`` the bytes of one pass, not the result. ``max_cells`` bounds a filter of anchors: more are filtered in rounds.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = stored(
        docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), utf8(text_col).cast("binary").alias("raw")), "repeat-texts"
    )
    anchors = stored(
        texts.select("rid", "raw").mapInPandas(partial(_anchors, length=length, gram=gram, most_bytes=piece), "h long, ctx long, ctx2 long, rid long, pos long, lo int, hi int"), "anchors"
    )
    total = anchors.count()
    shared = in_rounds(anchors, "h", total, max_cells).where("maybe").drop("maybe")
    contexts = stored(
        shared.groupBy(*_CONTEXT).agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos", "lo", "hi")).alias("at")).select(*_CONTEXT, "n", "at.*"), "contexts"
    )
    several = contexts.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    compared = join_keyed(contexts, several, "h", "k", contexts.count()).select(*_CONTEXT, "k", "rid", "pos", "lo", "hi")
    compared = stored(compared, "compared")
    rids = compared.select("rid").distinct()
    has_some = possibly_in(rids, "rid", rids.count())
    cut_out = F.expr("substring(raw, cast(pos - lo + 1 as int), lo + hi)")
    pieces = compared.join(texts.select("rid", "raw").where(has_some(F.col("rid"))), "rid").select(*_CONTEXT, "k", cut_out.alias("bytes"), "lo", "hi")
    runs = _repeated_runs(stored(pieces, "context-bytes"), length, gram, most)
    whole = contexts.where("n > 1").select(*_CONTEXT, "n", F.array(F.struct((-F.col("lo")).alias("b"), F.col("hi").alias("e"))).alias("runs"))
    part = runs.groupBy(*_CONTEXT).agg(F.lit(1).cast("long").alias("n"), F.collect_list(F.struct("b", "e")).alias("runs")).join(whole, _CONTEXT, "left_anti")
    covers = stored(whole.unionByName(part), "covers")
    spans = (
        join_keyed(shared.select(*_CONTEXT, "rid", "pos"), covers, _CONTEXT, "n", total).select("rid", "pos", F.explode("runs").alias("r"))
        .select("rid", (F.col("pos") + F.col("r.b")).alias("b"), (F.col("pos") + F.col("r.e")).alias("e"))
        .groupBy("rid").agg(F.collect_list(F.struct("b", "e")).alias("spans"))
    )
    spans = stored(spans, "spans")
    has_spans = possibly_in(spans, "rid", spans.count())
    marked = texts.withColumn("maybe", has_spans(F.col("rid")))
    cut = F.pandas_udf(_cut, "n_removed long, n_spans long, kept binary")
    found = marked.where("maybe").join(spans, "rid", "left").select("doc_id", F.length("raw").cast("long").alias("n_bytes"), cut("raw", "spans").alias("c"))
    return found.select("doc_id", "n_bytes", "c.*").unionByName(
        marked.where("not maybe").select("doc_id", F.length("raw").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("raw").alias("kept"))
    )


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
st AS (SELECT r, i, md5(substr(hx, 2 * i + 1, 400)) AS h FROM (SELECT r, hx, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
rep AS (SELECT r, i FROM st QUALIFY count(*) OVER (PARTITION BY h) > 1),
cut AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true)::INT AS fresh FROM rep),
run AS (SELECT r, min(i) AS b, max(i) + 200 AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM cut) GROUP BY r, k),
gap AS (SELECT run.r, b, e, substr(hx, 2 * coalesce(lag(e) OVER (PARTITION BY run.r ORDER BY b), 0) + 1, 2 * (b - coalesce(lag(e) OVER (PARTITION BY run.r ORDER BY b), 0))) AS g FROM run JOIN d ON d.r = run.r),
out AS (SELECT r, sum(e - b)::BIGINT AS removed, count(*)::BIGINT AS spans, max(e) AS last, string_agg(g, '' ORDER BY b) AS kept FROM gap GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN hx ELSE kept || substr(hx, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN out ON out.r = d.r
"""
