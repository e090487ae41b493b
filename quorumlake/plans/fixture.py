"""A rubric, judges, labels and votes over the tables of a scale factor, in Spark and in SQL.

Votes are the truth perturbed by a hash, so that any engine reproduces them. Criteria: quality
(binary, +10), toxic (binary, -15), length_band (ordinal, +5, with an NA option) and language
(nominal, +2, without one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bootstrap import hash32
from ..operators.voting import routed_votes
from ..schema import CANNOT_ASSESS, CRITERIA, MET, NA_LABEL, UNMET, local_table

LANGUAGES = ("de", "en", "es", "fr")
JUDGES = (("ja", 1.0), ("jb", 1.0), ("jc", 3.0))
_LENGTHS = [(0, "short", 0.0, False), (1, "medium", 0.5, False), (2, "long", 1.0, False), (3, NA_LABEL, 0.0, True)]
_TONGUES = [(0, "de", 0.0, False), (1, "en", 1.0, False), (2, "es", 0.5, False), (3, "fr", 0.5, False)]
_RUBRIC = [
    (0, "quality", "The text is well formed.", 10.0, "binary", None, None),
    (1, "toxic", "The text insults.", -15.0, "binary", None, None),
    (2, "length_band", "How long is the text?", 5.0, "ordinal", None, _LENGTHS),
    (3, "language", "Which language is it?", 2.0, "nominal", None, _TONGUES),
]
WORD = r"[^\x20\x09-\x0D]+"


def criteria(spark: SparkSession) -> DataFrame:
    return local_table(spark, _RUBRIC, CRITERIA)


def judges(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(JUDGES), "judge_id string, weight double")


def _tagged(*parts: str | Column) -> Column:
    return hash32(F.concat_ws(":", F.col("item_idx").cast("string"), *[F.lit(p) if isinstance(p, str) else p for p in parts]))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_idx, criterion_idx, k (classes), t (true class), labelled: one row per document and criterion."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("item_idx"), "lang", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("n_words")
    )
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("item_idx"), "quality", "toxic")
    guess = lambda c: F.pmod(_tagged(f"c{c}", "truth"), F.lit(2))
    band = F.when(F.col("n_words") < 100, 0).when(F.col("n_words") < 400, 1).otherwise(2)
    tongue = F.coalesce(*[F.when(F.col("lang") == x, i) for i, x in enumerate(LANGUAGES)], F.lit(0))
    values = [F.coalesce("quality", guess(0)), F.coalesce("toxic", guess(1)), band, tongue]
    own = [F.struct(F.lit(c).alias("criterion_idx"), F.lit(k).alias("k"), v.cast("int").alias("t")) for c, (k, v) in enumerate(zip((2, 2, 3, 4), values))]
    return docs.join(known, "item_idx", "left").select("item_idx", F.col("quality").isNotNull().alias("labelled"), F.explode(F.array(*own)).alias("x")).select(
        "item_idx", "x.*", "labelled"
    )


def _verdict(c: Column) -> Column:
    return F.when(F.col("criterion_idx") < 2, F.when(c == 1, MET).when(c == 0, UNMET).otherwise(CANNOT_ASSESS))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth of the labelled documents; one in fifty of the first three criteria's is an abstention."""
    own = truth(spark, sf_dir).where("labelled")
    unsure = (F.pmod(_tagged(F.concat(F.lit("c"), F.col("criterion_idx")), "label"), F.lit(50)) == 0) & (F.col("criterion_idx") < 3)
    na = F.when(F.col("criterion_idx") == 2, 3).otherwise(2)
    value = F.when(unsure, na).otherwise(F.col("t"))
    return own.select("item_idx", "criterion_idx", _verdict(value).alias("verdict"), F.when(F.col("criterion_idx") >= 2, value).cast("int").alias("option_idx"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed votes: of a hundred, 5 fail for infrastructure, 2 for unknown reasons, 7 abstain, 20 are off by one class."""
    panel = F.array(*[F.struct(F.lit(j).alias("judge_id"), F.lit(i).alias("judge_ord"), F.lit(w).alias("judge_weight")) for i, (j, w) in enumerate(JUDGES)])
    each = truth(spark, sf_dir).select("item_idx", "criterion_idx", "k", "t", F.explode(panel).alias("j")).select("item_idx", "criterion_idx", "k", "t", "j.*")
    b = F.pmod(_tagged(F.concat(F.lit("c"), F.col("criterion_idx")), F.col("judge_id")), F.lit(100))
    error = F.when(b < 5, "infrastructure: timeout").when(b < 7, "unknown: crash")
    picked = F.when(b < 34, F.pmod(F.col("t") + 1, F.col("k"))).otherwise(F.col("t"))
    option = F.when(b >= 14, picked).when(F.col("criterion_idx") == 2, 3)
    raw = each.select(
        "item_idx", "criterion_idx", "judge_id", "judge_ord", "judge_weight", F.lit("primary").alias("role"),
        F.when(b >= 7, _verdict(F.when(b < 14, 2).otherwise(picked))).alias("verdict"),
        F.when((F.col("criterion_idx") >= 2) & (b >= 7), option).cast("int").alias("option_idx"), error.alias("error"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("map<string,double>").alias("probabilities"), F.lit(None).cast("double").alias("confidence"),
        F.lit(False).alias("superseded"),
    )
    return routed_votes(raw, criteria(spark))


def unsure_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a cheap judge on the binary criteria: right three times in four, with a confidence."""
    own = truth(spark, sf_dir).where("criterion_idx < 2")
    h = _tagged(F.concat(F.lit("c"), F.col("criterion_idx")), "dm")
    side = F.when(F.pmod(F.floor(h / 1009), F.lit(100)) < 25, 1 - F.col("t")).otherwise(F.col("t"))
    failed = F.pmod(h, F.lit(97)) < 3
    return own.select(
        "item_idx", "criterion_idx", F.when(failed, CANNOT_ASSESS).otherwise(_verdict(side)).alias("final_verdict"), failed.alias("na"),
        F.when(~failed, F.pmod(h, F.lit(1001)) / 1000).alias("confidence"), F.when(failed, F.lit("parse: no answer")).alias("error"),
    )


#: The same in SQL: d (documents), crit, judge, tr (truth), lab (labels), v (routed votes; pick is 1
#: MET, 0 UNMET, 2 CANNOT_ASSESS or an option index).
SQL = r"""
WITH d AS (SELECT doc_id AS i, lang, quality, toxic, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS nw FROM documents LEFT JOIN labels USING (doc_id)),
crit AS (SELECT c::INT AS c, w::DOUBLE AS w, scale, k::INT AS k FROM (VALUES (0, 10.0, 'binary', 2), (1, -15.0, 'binary', 2), (2, 5.0, 'ordinal', 3), (3, 2.0, 'nominal', 4)) x(c, w, scale, k)),
judge AS (SELECT j, o::INT AS o, jw::DOUBLE AS jw FROM (VALUES ('ja', 0, 1.0), ('jb', 1, 1.0), ('jc', 2, 3.0)) x(j, o, jw)),
opt AS (SELECT c::INT AS c, idx::INT AS idx, val::DOUBLE AS val, na FROM (VALUES (2, 0, 0.0, false), (2, 1, 0.5, false), (2, 2, 1.0, false), (2, 3, 0.0, true),
        (3, 0, 0.0, false), (3, 1, 1.0, false), (3, 2, 0.5, false), (3, 3, 0.5, false)) x(c, idx, val, na)),
tr AS (SELECT i, c, w, scale, k, quality IS NOT NULL AS labelled, (CASE c
        WHEN 0 THEN coalesce(quality, ('0x' || substr(md5(i::VARCHAR || ':c0:truth'), 1, 8))::BIGINT % 2)
        WHEN 1 THEN coalesce(toxic, ('0x' || substr(md5(i::VARCHAR || ':c1:truth'), 1, 8))::BIGINT % 2)
        WHEN 2 THEN CASE WHEN nw < 100 THEN 0 WHEN nw < 400 THEN 1 ELSE 2 END
        ELSE CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 0 END END)::INT AS t FROM d, crit),
lab AS (SELECT i, c, w, scale, k, CASE WHEN c < 3 AND ('0x' || substr(md5(i::VARCHAR || ':c' || c || ':label'), 1, 8))::BIGINT % 50 = 0 THEN CASE c WHEN 2 THEN 3 ELSE 2 END ELSE t END AS t
        FROM tr WHERE labelled),
vb AS (SELECT *, ('0x' || substr(md5(i::VARCHAR || ':c' || c || ':' || j), 1, 8))::BIGINT % 100 AS b FROM tr, judge),
v AS (SELECT i, c, w, scale, k, j, o, jw, CASE WHEN b < 5 THEN 'infrastructure: timeout' WHEN b < 7 THEN 'unknown: crash' END AS err, (CASE
        WHEN b < 5 OR b BETWEEN 7 AND 13 THEN CASE WHEN c < 2 THEN 2 WHEN c = 2 THEN 3 END
        WHEN b < 7 THEN CASE WHEN c = 1 THEN 1 ELSE 0 END
        WHEN b < 34 THEN (t + 1) % k ELSE t END)::INT AS pick FROM vb)
"""
