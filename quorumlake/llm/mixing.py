"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import stored, utf8

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Rows of one range of the random order that are sorted together.
RANGE_ROWS = 20_000
#: Sources whose cuts are broadcast; more are joined.
MAX_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target of each source from ``sizes`` (key, source, source_size: one row per source).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes; a target stops at ``epochs`` times its source's size and the excess is shared again by
    weight. Resharing until none is above is the water level at which the capped sources, those of
    least size per weight, are full: found in one pass over the sources in that order.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")).withColumn(
        "cap", (F.col("source_size") * epochs).cast("double")
    )
    everything = Window.partitionBy(F.lit(0))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full = (
        weighed.withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
        .withColumn("full", F.col("cap") * F.col("open") <= F.col("left") * F.col("w"))
    )
    level = (F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)) / F.nullif(
        F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything), F.lit(0.0)
    )
    return full.withColumn("target", F.round(F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("w")), 6)).select(
        "skey", "source_size", "target"
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """rid, skey, source, size and key: the hash-random place in the order of the source. A row without
    an id has that of its text."""
    text, own = utf8(text_col), F.col(id_col).cast("string")
    source = F.col(source_col).cast("string")
    return [
        F.monotonically_increasing_id().alias("rid"), F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("skey"), source.alias("source"),
        word_count(text).alias("size"), F.md5(F.coalesce(own, F.md5(text.cast("binary"))).cast("binary")).alias("key"),
    ]


def source_cuts(sized: DataFrame, weights=WEIGHTS, share=SHARE, epochs=MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(skey, source_size, target, whole, cut, rest): a source's rows are taken ``whole`` times, those
    before the key ``cut`` once more, and at that key ``rest`` words more.

    ``sized`` (rid, skey, source, size, key) is written and read more than once. Keys fall into ranges;
    sums of the earlier ranges say in which range a source's budget ends, and only the rows of that
    range are sorted, by key, and summed up to the budget.
    """
    log2 = min(32, max(0, math.ceil(math.log2(max(1, sized.count()) / range_rows))))
    place = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - log2)
    ranged = sized.withColumn("range", place)
    by_range = ranged.groupBy("skey", "range").agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
    sources = by_range.groupBy("skey").agg(F.sum("range_size").alias("source_size"), F.first("source").alias("source"))
    budget = F.floor("target").cast("long")
    whole = F.coalesce(F.try_divide(budget - F.pmod(budget, F.greatest("source_size", F.lit(1))), F.col("source_size")), F.lit(0)).cast("long")
    rest = F.pmod(budget, F.greatest(F.col("source_size"), F.lit(1)))
    budgets = stored(source_targets(sources, weights, share, epochs).withColumns({"whole": whole, "rest": rest}), "mix-budgets")
    earlier = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    ends_in = (F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("range_size"))
    cut_range = starts.join(budgets.select("skey", "rest"), "skey").where(ends_in).select("skey", "range", (F.col("rest") - F.col("start")).alias("rest"))
    keys = ranged.join(cut_range, ["skey", "range"]).groupBy("skey", "rest", "key").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("skey").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = keys.withColumn("before", before).where("before <= rest and rest < before + size").select("skey", F.col("key").alias("cut"), (F.col("rest") - F.col("before")).alias("rest"))
    named = budgets.drop("rest").join(cut, "skey", "left")
    return named.withColumns({"cut": F.coalesce("cut", F.lit("")), "rest": F.coalesce("rest", F.lit(0))})


def with_taken(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """``sized`` (rid, skey, size, key and any more columns) with source_size, target and taken.

    Only rows at the cuts' keys move. Rows of one key, be they copies of each other or not, are taken in
    the order of their partition, then their place in it.
    """
    small = cuts.count() <= MAX_SOURCES
    joined = sized.join(F.broadcast(cuts) if small else cuts, "skey")
    epochs = F.col("whole") * F.col("size")
    plain = joined.where("key <> cut").withColumn("taken", epochs + F.when(F.col("key") < F.col("cut"), F.col("size")).otherwise(0))
    at = joined.where("key = cut").withColumn("part", F.shiftright("rid", 33))
    parts = at.groupBy("skey", "part").agg(F.sum("size").alias("part_size"))
    start = F.coalesce(F.sum("part_size").over(Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("skey", "part").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("rest") - F.col("start") - inside
    edge = at.join(parts.select("skey", "part", start.alias("start")), ["skey", "part"]).withColumn("taken", epochs + F.least(F.greatest(left, F.lit(0)), F.col("size")))
    return plain.unionByName(edge.drop("part", "start")).withColumn("taken", F.col("taken").cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row.

    A null text has no words; null sources are one source, the last; a null id has a place in the order
    by its text; repeated rows keep their own share. Texts are counted whole, whatever their length, and
    other columns, whatever their names, are not read. An empty table gives no rows; a source without
    words has target 0.
    """
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), *_keyed(docs, id_col, text_col, source_col)), "mix-sizes")
    return with_taken(sized, source_cuts(sized, **how)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns kept.

    A document taken for k whole epochs and a part appears k times whole and once cut after the
    words of the part; documents not taken do not appear. ``n_chars``, where there is such a column,
    follows the text. The texts do not move: what is taken follows from a row's own key and its source.
    """
    row = "doc"  # all columns of a document in one, so that no name clashes
    held = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *_keyed(docs, id_col, text_col, source_col)), "mix-documents")
    shares = with_taken(held, source_cuts(held.drop(row), **how)).where("taken > 0")
    copies = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1),
        lambda k: F.least(F.col("taken") - k * F.col("size"), F.col("size")),
    )
    repeated = shares.withColumn("words", F.explode(copies)).select(row, "size", "words")

    @F.pandas_udf("string")
    def first_words(texts, counts):
        import re

        import pandas as pd

        out = []
        for text, n in zip(texts, counts):
            end = 0
            for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
                if i == n:
                    break
                end = m.end()
            out.append(text[:end])
        return pd.Series(out, dtype=object)

    whole = repeated.where("words = size").select(f"{row}.*")
    part = repeated.where("words < size").withColumn("text", first_words(F.col(f"{row}.{text_col}"), F.col("words")))
    changed = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return whole.unionByName(part.select(*[(changed[c] if c in changed else F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns]))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
             (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w,
             1.5::DOUBLE * sum(source_size) OVER () AS everything FROM s),
f AS (SELECT *, cap * (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) <= (everything - coalesce(sum(cap) OVER p, 0)) * w AS isfull
      FROM w WINDOW p AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, round(CASE WHEN isfull THEN cap ELSE
        w * (everything - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN isfull THEN 0 ELSE w END) OVER (), 0) END, 6) AS target FROM f),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
        + least(greatest(budget % source_size - before, 0), size) END)::BIGINT AS taken
FROM o
"""
