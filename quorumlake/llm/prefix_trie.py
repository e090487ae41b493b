"""Prefix trie of conversations by MSD radix partitioning.

Turns are encoded by a dictionary of ids, so that a conversation is one array of ids, and equal
conversations are one sequence with a count. Sequences are dealt into buckets by their next id. A bucket
too large for one task is a node by itself: it is moved forward over all ids that its sequences have in common and
dealt again; the others are finished where they are, by a multikey quicksort whose recursion emits the nodes below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import bounded_batches, join_salted, stored, utf8

#: Conversations c - c % FAMILY and up share first turns; at most SHARED - 1 of them.
FAMILY, SHARED = 5, 9
#: Turns of a bucket that one task finishes; more where there would be over MAX_LARGE larger buckets of a depth.
LOCAL_TURNS = 4096
MAX_LARGE = 100_000
ROOT = 0
#: Characters of one piece of a list of ids.
PIECE = 1 << 20
NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, bucket long"
)
_NONE = hashlib.sha256(b"").hexdigest()


def _turn_key(role: Column, text: Column) -> Column:
    """SHA-256 of a turn: the length of the role keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def encoded_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, key, id, size): turns with the id of the dictionary and the bytes of the text.

    The dictionary has one row for each different turn, named by SHA-256; a turn that very many conversations hold
    is joined in shares.
    """
    role, text = utf8("role"), utf8("text")
    keyed = stored(
        conversations.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"), "turn", _turn_key(role, text).alias("key"), F.octet_length(text).alias("size")
        ),
        "trie-turns",
    )
    dictionary = stored(keyed.groupBy("key").agg(F.max("size").alias("size")).withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    return join_salted(keyed.drop("size"), dictionary, "key", keyed.count(), "conv_id")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """(conv_id, seq, sizes): each conversation as arrays of the ids and sizes of its rebuilt turns.

    Conversations of one family, at most 2 * family - 1, are dealt to one task together, so that nothing is shuffled
    again.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    dealt = turns.withColumn("base", base).repartition("base")
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn", "key", "id", "size")
    own = dealt.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(place)).alias("own"))
    families = own.groupBy("base").agg(F.collect_list(F.struct("conv_id", F.transform("own", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("own"))).alias("all"))
    first = F.get(F.filter("all", lambda c: c["conv_id"] == F.col("base")), F.lit(0))["own"]
    each = families.withColumn("first", F.coalesce(first, F.expr("cast(array() as array<struct<id: bigint, size: int>>)"))).select("first", F.inline("all"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).cast("int")
    turns_of = F.concat(F.slice("first", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    built = each.withColumn("h", h).select("conv_id", turns_of.alias("built"))
    return built.select("conv_id", F.col("built.id").alias("seq"), F.col("built.size").alias("sizes"))


def _pieces(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Runs of equal ``fp``, sorted by conv_id, as pieces of at most some ``most`` characters. A piece is
    whole if its run is inside the partition; the first and last runs and those of several pieces are open."""
    held: dict | None = None
    first = True

    def row(closed: bool) -> dict:
        text = ",".join(held["ids"])
        return {
            "fp": held["fp"], "conv": held["conv"], "n": len(held["ids"]), "seq": held["seq"], "sizes": held["sizes"],
            "text": None if closed else text, "sha": hashlib.sha256(text.encode()).hexdigest() if closed else None,
        }

    for pdf in batches:
        out = []
        for fp, conv, seq, sizes in zip(pdf["fp"], pdf["conv_id"].tolist(), pdf["seq"], pdf["sizes"]):
            if held is None or fp != held["fp"]:
                if held is not None:
                    out.append(row(not held["open"]))
                held = {"fp": fp, "conv": conv, "seq": seq, "sizes": sizes, "ids": [], "chars": 0, "open": first}
                first = False
            elif held["chars"] >= most:
                out.append(row(False))
                held = {"fp": fp, "conv": conv, "seq": None, "sizes": None, "ids": [], "chars": 0, "open": True}
            held["ids"].append(str(conv))
            held["chars"] += len(held["ids"][-1]) + 1
        if out:
            yield pd.DataFrame(out)
    if held is not None:
        yield pd.DataFrame([row(False)])


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Open pieces, sorted by fp and conv, hashed one after another: one piece is in memory at a time."""
    held = None
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if held is None or r.fp != held["fp"]:
                if held is not None:
                    out.append(_whole(held))
                held = {"fp": r.fp, "conv": r.conv, "n": 0, "seq": r.seq, "sizes": r.sizes, "hash": hashlib.sha256()}
            elif held["n"]:
                held["hash"].update(b",")
            held["hash"].update(r.text.encode())
            held["n"] += r.n
        if out:
            yield pd.DataFrame(out)
    if held is not None:
        yield pd.DataFrame([_whole(held)])


def _whole(held: dict) -> dict:
    return {"conv": held["conv"], "n": held["n"], "seq": held["seq"], "sizes": held["sizes"], "sha": held["hash"].hexdigest()}


def distinct_sequences(built: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv, n, seq, sizes, sha): one row for each different sequence, its smallest conversation, their number,
    and the SHA-256 of their ids in order.

    Members are range-sorted by sequence, then id, so that one sequence of very many conversations is dealt over
    tasks; each hands on long pieces of the list, and only those are hashed in one task, one after
    another, as SHA-256 asks for.
    """
    ranged = built.repartitionByRange("fp", "conv_id").sortWithinPartitions("fp", "conv_id").select("fp", "conv_id", "seq", "sizes")
    pieces = stored(
        ranged.mapInPandas(partial(_pieces, most=piece), "fp binary, conv long, n long, seq array<long>, sizes array<int>, text string, sha string"), "trie-pieces"
    )
    opened = pieces.where("text is not null").repartition("fp").sortWithinPartitions("fp", "conv").drop("sha")
    schema = "conv long, n long, seq array<long>, sizes array<int>, sha string"
    return pieces.where("text is null").select("conv", "n", "seq", "sizes", "sha").unionByName(opened.mapInPandas(_joined, schema))


def quicksorted(rows: list[tuple], depth: int) -> list[list]:
    """The nodes of the sequences ``rows`` (seq, sizes, n, conv, sha), different ones that agree on the first ``depth`` ids
    and are longer: [conv, depth, parent's place or -1, n_convs, n_children, n_leaves, saved_tokens, sha].

    Multikey quicksort: rows are split by their id at ``depth`` into smaller, equal and larger; equal ones are a
    node, whose longer rows are sorted by the next id.
    """
    nodes: list[list] = []
    stack = [(rows, depth, -1)]
    while stack:
        own, d, parent = stack.pop()
        if len(own) == 1:  # nothing is left to sort: a chain to the end
            seq, sizes, n, conv, sha = own[0]
            for e in range(d, len(seq)):
                nodes.append([conv, e + 1, parent, n, 0, 0, (n - 1) * sizes[e], _NONE])
                parent = len(nodes) - 1
            nodes[-1][7] = sha
            continue
        a, b, c = own[0][0][d], own[len(own) // 2][0][d], own[-1][0][d]
        pivot = max(min(a, b), min(max(a, b), c))
        less, same, more = [], [], []
        for row in own:
            x = row[0][d]
            (same if x == pivot else less if x < pivot else more).append(row)
        for part in (less, more):
            if part:
                stack.append((part, d, parent))
        longer = [r for r in same if len(r[0]) > d + 1]
        ended = [r for r in same if len(r[0]) == d + 1]
        n = sum(r[2] for r in same)
        nodes.append([min(r[3] for r in same), d + 1, parent, n, 0, 0, (n - 1) * same[0][1][d], ended[0][4] if ended else _NONE])
        if longer:
            stack.append((longer, d + 1, len(nodes) - 1))
    for node in reversed(nodes):  # parents come before their children
        node[5] = node[5] or 1
        if node[2] >= 0:
            above = nodes[node[2]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return nodes


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """All buckets of one task, each sorted and emitted; parents of their first nodes are known by ``bucket`` alone."""
    buckets: dict[int, tuple[int, list]] = {}
    for r in pdf.itertuples(index=False):
        buckets.setdefault(r.bucket, (r.depth, []))[1].append((r.seq.tolist(), r.sizes.tolist(), r.n, r.conv, r.sha))
    out = []
    for bucket, (depth, rows) in buckets.items():
        nodes = quicksorted(rows, depth)
        for conv, d, parent, n, children, leaves, saved, sha in nodes:
            out.append((conv, d, None if parent < 0 else nodes[parent][0], n, children, leaves, saved, sha, bucket if parent < 0 else None))
    columns = dict(zip([c.split()[0] for c in NODES.split(", ")], zip(*out)))
    return pd.DataFrame({c: pd.array(v, dtype="string" if c == "ends_sha256" else "Int64") for c, v in columns.items()})


def _common(least: Column, most: Column) -> Column:
    """How many first ids the least and the largest sequence of a bucket, and so all of it, have in common."""
    return F.coalesce(F.nullif(F.array_position(F.zip_with(least, most, lambda x, y: x.eqNullSafe(y)), F.lit(False)), F.lit(0).cast("long")) - 1, F.size(least).cast("long"))


def trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS, piece: int = PIECE) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt ``conversations`` (conv_id, turn, role, text): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty. Turns are ordered by ``turn``, null first, and equal ones by the
    SHA-256 of role and text, so repeated rows are turns each. Rows without a conv_id belong to no conversation. Texts
    of any length count whole. Other columns, whatever their names, are not read. A table without
    conversations has no nodes, not even a root.

    One conversation is one row of ids wherever it is. Buckets of more than ``local_turns`` turns, of which there are at
    most MAX_LARGE at a time, go to the driver as a row of numbers each, and so do sums of what is below.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    fp = F.unhex(F.sha2(F.array_join(F.col("seq").cast("array<string>"), ",").cast("binary"), 256))
    built = stored(rebuilt(encoded_turns(conversations)).withColumn("fp", fp), "trie-conversations")
    rows = stored(distinct_sequences(built, piece).withColumns({"bucket": F.lit(ROOT).cast("long"), "depth": F.lit(0)}), "trie-sequences")
    root = rows.agg(F.sum(F.size("seq")).alias("turns"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max(F.when(F.size("seq") == 0, F.col("sha"))).alias("sha")).first()
    if root["n"] is None:
        return spark.createDataFrame([], NODES).drop("bucket")
    local = max(local_turns, -(-root["turns"] // MAX_LARGE))
    small, spans = _dealt(rows.where(F.size("seq") > 0), local)
    bins = max(1, -(-2 * root["turns"] // local))
    binned = small.groupBy(F.pmod(F.xxhash64("bucket", _digit()), F.lit(bins)).alias("bin")).applyInPandas(_finish, NODES)
    nodes = stored(binned, "trie-nodes")
    tops = nodes.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    # sums of what is below each large bucket, from the deepest up: a bucket has a larger number than the one it is in
    below = {ROOT: [0, 0, 0]} | {r["next"]: [0, 0, 0] for s in spans for r in s["numbers"]}
    for r in tops.collect():
        below[r["bucket"]] = [r["children"], r["leaves"], r["saved"]]
    convs = {ROOT: root["conv"]} | {r["next"]: r["conv"] for s in spans for r in s["numbers"]}
    for r in sorted((r for s in spans for r in s["numbers"]), key=lambda r: -r["next"]):
        own, above = below[r["next"]], below[r["bucket"]]
        above[0] += 1
        above[1] += own[1]
        above[2] += own[2] + r["saved"]
    top = below[ROOT]
    first = spark.createDataFrame([(root["conv"], 0, None, root["n"], top[0], top[1] or 1, top[2], root["sha"] or _NONE, None)], NODES)
    known = spark.createDataFrame([(k, convs[k], *v) for k, v in below.items()], "number long, top_conv long, children long, leaves long, saved long")
    parents = F.broadcast(known.select(F.col("number").alias("bucket"), "top_conv"))
    out = nodes.join(parents, "bucket", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top_conv")).drop("top_conv").select(*first.columns).unionByName(first)
    for s in spans:
        out = out.unionByName(_chains(s["spans"], parents, F.broadcast(known.drop("top_conv").withColumnRenamed("number", "next"))))
    return out.drop("bucket")


def _digit() -> Column:
    return F.get("seq", F.col("depth"))


def _dealt(rows: DataFrame, local: int) -> tuple[DataFrame, list[dict]]:
    """Rows of the buckets that one task can finish, and for each round the ``spans`` of the larger ones, with the few
    ``numbers`` of each that the driver needs.

    A round deals each bucket by its next id; of the parts that are still too large, all ids that their
    sequences have in common are passed at once, so that a round splits every bucket it looks at.
    """
    spark, small, spans, last = rows.sparkSession, [], [], ROOT
    while True:
        grouped = rows.groupBy("bucket", _digit().alias("digit")).agg(F.count("*").alias("rows"), F.sum(F.size("seq") - F.col("depth")).alias("turns"))
        found = [(r["bucket"], r["digit"], last + 1 + k) for k, r in enumerate(grouped.where((F.col("rows") > 1) & (F.col("turns") > local)).select("bucket", "digit").collect())]
        if not found:
            small.append(rows)
            return reduce(DataFrame.unionByName, small), spans
        last += len(found)
        known = F.broadcast(spark.createDataFrame(found, "bucket long, digit long, next long"))  # at most MAX_LARGE rows
        marked = rows.withColumn("digit", _digit()).join(known, ["bucket", "digit"], "left").drop("digit")
        small.append(marked.where("next is null").drop("next"))
        large = marked.where("next is not null")
        common = large.groupBy("bucket", "next", "depth").agg(
            F.min("seq").alias("least"), F.max("seq").alias("most"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
            F.min(F.struct(F.size("seq").alias("length"), "sha", "sizes")).alias("shortest"),
        ).withColumn("common", _common(F.col("least"), F.col("most")).cast("int"))
        own = stored(
            common.select(
                "bucket", "next", "depth", "n", "conv", "common", F.when(F.col("shortest.length") == F.col("common"), F.col("shortest.sha")).alias("sha"),
                F.slice("shortest.sizes", F.col("depth") + 1, F.col("common") - F.col("depth")).alias("sizes"),
            ),
            "trie-spans",
        )
        saved = (F.col("n") - 1) * F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
        spans.append({"spans": own, "numbers": own.select("bucket", "next", "conv", saved.alias("saved")).collect()})
        ahead = large.drop("bucket", "depth").join(F.broadcast(own.select("next", F.col("next").alias("bucket"), F.col("common").alias("depth"))), "next").drop("next")
        rows = stored(ahead.where(F.size("seq") > F.col("depth")), "trie-large")


def _chains(spans: DataFrame, parents: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of large buckets: each id that all sequences of a bucket have in common is one, with one child but for
    the last."""
    placed = spans.join(parents, "bucket").drop("bucket").join(below, "next").select("*", F.posexplode("sizes").alias("k", "size"))
    rest = F.sum(F.col("size").cast("long")).over(Window.partitionBy("next").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    end = F.col("depth") + F.col("k") + 1 == F.col("common")
    return placed.select(
        "conv", (F.col("depth") + F.col("k") + 1).cast("long").alias("d"), F.when(F.col("k") == 0, F.col("top_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(end, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * rest).alias("saved_tokens"), F.when(end, F.coalesce("sha", F.lit(_NONE))).otherwise(_NONE).alias("ends_sha256"),
        F.lit(None).cast("long").alias("bucket"),
    ).withColumnsRenamed({"conv": "conv_id", "d": "depth"})


#: Brute force over all prefixes as lists of turns; crc32 bit by bit.
OP13_SQL = f"""
WITH t AS (SELECT conv_id, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS u,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(u ORDER BY p) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % {SHARED} AS h FROM o),
b AS (SELECT a.conv_id, list_concat(coalesce(f.own[1 : a.h], []), a.own[a.h + 1 :]) AS seq FROM h a LEFT JOIN o f ON f.conv_id = a.conv_id - a.conv_id % {FAMILY}),
pre AS (SELECT conv_id, d, seq[1 : d] AS p, d = len(seq) AS ends FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM b)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM pre GROUP BY p, d),
k AS (SELECT p[1 : d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(p[d].x) END AS own FROM n LEFT JOIN k USING (p)),
s AS (SELECT p[1 : a] AS p, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM w) GROUP BY ALL)
SELECT w.conv_id, w.d::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s ON w.p = s.p LEFT JOIN n up ON w.d > 0 AND up.p = w.p[1 : w.d - 1]
"""
