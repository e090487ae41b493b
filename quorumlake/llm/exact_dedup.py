"""Exact dedup: two-pass Bloom filtering, then grouping of the possibly repeated rows only.

Pass one hashes every text and fills the filter; pass two tests every hash. Rows whose hash is
certainly unique are results as they stand. The others are grouped by SHA-256, so the result is
exact whatever the filter lets through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_CELLS, in_rounds, possibly_in, possibly_repeated, rounds_for
from .scratch import fresh, join_keyed, stored, utf8


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the
    largest id stays; among rows that tie on it (repeated rows) exactly one stays; null ids lose to
    all others, and a group of null ids has a null keep_id. Texts are hashed whole, whatever their
    length. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    hashed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(utf8(text_col).cast("binary"), 256).alias("text_sha256"),
        F.xxhash64(utf8(text_col)).alias("h"),
        F.monotonically_increasing_id().alias("rid"),
    )
    held = stored(hashed, "exact-hashes")
    total = held.count()
    marked = in_rounds(held, "h", total, max_cells).drop("h")
    unique = marked.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    maybe = marked.where("maybe").drop("maybe")
    groups = maybe.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")
    )
    joined = join_keyed(maybe, groups, "text_sha256", "group_size", total)
    return unique.unionByName(
        joined.select(
            "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
            (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256",
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops, all columns kept.

    Only rows whose hash may be repeated are shuffled with their texts; the rest pass straight
    through. Where one filter of all hashes is too small, one of the repeated hashes alone, which rounds
    find first, is used, and lets more rows pass than it need where these are too many as well. Nulls,
    ties, long texts and empty tables as in ``exact_groups``.
    """
    h, sha, maybe, row = fresh(docs, "h", "sha", "maybe", "row")
    hashed = docs.withColumn(h, F.xxhash64(utf8(text_col)))
    hashes = stored(hashed.select(F.col(h).alias("h")), "exact-hashes")
    total = hashes.count()
    if rounds_for(total, max_cells) == 1:
        test = possibly_repeated(hashes, "h", total, max_cells)
    else:
        twice = stored(in_rounds(hashes, "h", total, max_cells).where("maybe").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
        test = possibly_in(twice, "h", twice.count(), max_cells)
    marked = hashed.withColumn(maybe, test(F.col(h)))
    straight = marked.where(~F.col(maybe)).select(*[F.col(f"`{c}`") for c in docs.columns])
    grouped = (
        marked.where(F.col(maybe))
        .withColumn(sha, F.sha2(utf8(text_col).cast("binary"), 256))
        .groupBy(sha)
        .agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(id_col).isNotNull(), F.col(id_col))).alias(row))
        .select(f"{row}.*")
    )
    return straight.unionByName(grouped)


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
"""
