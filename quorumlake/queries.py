"""Registered queries of the evaluation engine, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import content as CT
from .functions import exprs as X
from .functions import prompts as P
from .operators import agreement as A
from .operators import bootstrap as B
from .operators import calibration as CL
from .operators import cascade as C
from .operators import cells as K
from .operators import decision as DM
from .operators import correlation as R
from .operators import distribution as D
from .operators import irr as I
from .operators import issues as IS
from .operators import pooled as PL
from .operators import sampling as T
from .operators import scoring as S
from .operators import single_call as SC
from .operators import usage as U
from .operators import voting as V
from .operators.bootstrap import hash32
from .plans import fixture as fx
from .plans import validation as VD
from .plans.reports_sql import REPORTS, SQL, VERDICT, scored
from .schema import MET

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _r(c: str, digits: int = 6):
    """Rounded, without a negative zero."""
    return (F.round(F.col(c), digits) + 0.0).alias(c)


def _reports(spark: SparkSession, d: str, **how) -> DataFrame:
    return V.aggregate_votes(fx.votes(spark, d), fx.criteria(spark), **how)


def _labelled_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of labelled items alone: votes that no label meets are not aggregated."""
    known = spark.read.parquet(f"{d}/labels.parquet").where("quality IS NOT NULL").select(F.col("doc_id").alias("item_idx"))
    return V.aggregate_votes(fx.votes(spark, d).join(known, "item_idx", "left_semi"), fx.criteria(spark))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return K.cells(_labelled_reports(spark, d), fx.labels(spark, d), fx.criteria(spark))


# --- voting ---------------------------------------------------------------------------------------


def _vote_binary(spark, d, how):
    return _reports(spark, d, binary=how).where("scale = 'binary'").select("item_idx", "criterion_idx", "final_verdict", "n_votes")


_BINARY_SQL = {
    "majority": "CASE WHEN m > u THEN 1 WHEN u > m THEN 0 ELSE (w < 0)::INT END",
    "weighted": "CASE WHEN mw > uw THEN 1 WHEN uw > mw THEN 0 ELSE (w < 0)::INT END",
    "unanimous": "(uw = 0)::INT",
    "any": "(mw > 0)::INT",
}
for _how, _sql in _BINARY_SQL.items():
    _register(
        f"vote_{_how}", partial(_vote_binary, how=_how),
        REPORTS + f"SELECT i AS item_idx, c AS criterion_idx, {VERDICT.format(f'(CASE WHEN m + u = 0 THEN 2 ELSE {_sql} END)')} AS final_verdict, n AS n_votes FROM bin",
    )


def _vote_ordinal(spark, d, how):
    return _reports(spark, d, ordinal=how).where("scale = 'ordinal'").select("item_idx", "option_idx", "na", _r("aggregated_value"))


_SNAPPED = "SELECT o.i AS item_idx, coalesce(s.idx, 3)::INT AS option_idx, {x} IS NULL AS na, round(coalesce({x}, 0.0), 6) AS aggregated_value FROM ordv o LEFT JOIN snap s ON s.i = o.i AND s.x = o.{x}"
_BY_VALUE = "SELECT i AS item_idx, coalesce((2 * {x})::INT, 3)::INT AS option_idx, {x} IS NULL AS na, coalesce({x}, 0.0) AS aggregated_value FROM ordv"
for _how, _sql in {
    "mean": _SNAPPED.format(x="mean"), "median": _SNAPPED.format(x="med"), "weighted_mean": _SNAPPED.format(x="wmean"),
    "min": _BY_VALUE.format(x="low"), "max": _BY_VALUE.format(x="high"),
    "mode": "SELECT o.i AS item_idx, coalesce(t.pick, 3)::INT AS option_idx, t.pick IS NULL AS na, coalesce(t.val, 0.0) AS aggregated_value FROM ordv o LEFT JOIN top t ON t.i = o.i AND t.c = 2 AND r = 1",
}.items():
    _register(f"vote_ordinal_{_how}", partial(_vote_ordinal, how=_how), REPORTS + _sql)


def _vote_nominal(spark, d, how):
    return _reports(spark, d, nominal=how).where("scale = 'nominal'").select("item_idx", "option_idx", "na", "value")


for _how, _rank in {"mode": "r", "weighted_mode": "rw", "unanimous": "r"}.items():  # without an NA option, dissent falls back to the mode
    _register(
        f"vote_nominal_{_how}", partial(_vote_nominal, how=_how),
        REPORTS + f"SELECT q.i AS item_idx, t.pick AS option_idx, t.pick IS NULL AS na, coalesce(t.val, 0.0) AS value FROM (SELECT DISTINCT i FROM v) q LEFT JOIN top t ON t.i = q.i AND t.c = 3 AND {_rank} = 1",
    )

_AGREED = "agreed AS (SELECT i, c, avg((v.pick IS NOT DISTINCT FROM r.pick)::INT)::DOUBLE AS agreement FROM v JOIN (SELECT i, c, pick FROM rep) r USING (i, c) GROUP BY i, c)"
_WITH_AGREED = REPORTS + ", " + _AGREED.replace("r.pick)", "r.pick)") + ", rep_a AS (SELECT f.*, agreement FROM full_rep f JOIN agreed USING (i, c))\n"
_register(
    "vote_agreement", lambda s, d: _reports(s, d).select("item_idx", "criterion_idx", _r("agreement"), F.col("error").isNotNull().alias("failed")),
    _WITH_AGREED + "SELECT i AS item_idx, c AS criterion_idx, round(agreement, 6) AS agreement, failed FROM rep_a",
)

# --- scoring --------------------------------------------------------------------------------------


def _doc_reports(spark, d, strategy="skip"):
    return S.item_reports(_reports(spark, d), strategy).select("item_idx", _r("score"), _r("raw_score"), _r("mean_agreement"), "cannot_assess_count", F.col("error").isNotNull().alias("failed"))


_register(
    "doc_reports", _doc_reports,
    _WITH_AGREED + f"SELECT a.i AS item_idx, round(a.score, 6) AS score, round(b.score, 6) AS raw_score, round(a.agreed, 6) AS mean_agreement, a.nas::BIGINT AS cannot_assess_count, a.gone AS failed FROM {scored('rep_a', 'i')} a JOIN {scored('rep_a', 'i', normalize=False)} b USING (i)",
)
for _how in ("skip", "zero", "partial", "fail"):
    _register(
        f"score_{_how}", lambda s, d, how=_how: S.item_reports(_reports(s, d), how).select("item_idx", _r("score"), _r("raw_score")),
        _WITH_AGREED + f"SELECT a.i AS item_idx, round(a.score, 6) AS score, round(b.score, 6) AS raw_score FROM {scored('rep_a', 'i', _how)} a JOIN {scored('rep_a', 'i', _how, False)} b USING (i)",
    )
_register(
    "score_negative_only", lambda s, d: S.item_reports(_reports(s, d).where("criterion_idx = 1"), "skip").select("item_idx", _r("score")),
    _WITH_AGREED + ", neg AS (SELECT * FROM rep_a WHERE c = 1) SELECT i AS item_idx, round(score, 6) AS score FROM " + scored("neg", "i"),
)
_JUDGE_REP = SQL + """, jr AS (SELECT v.i, v.c, v.w, v.j, err IS NOT NULL AS failed, NULL::DOUBLE AS agreement,
  CASE WHEN v.c < 2 THEN pick = 2 ELSE coalesce(na, true) END AS na, CASE WHEN v.c < 2 THEN (pick = 1)::INT::DOUBLE ELSE coalesce(val, 0.0) END AS val
  FROM v LEFT JOIN opt ON opt.c = v.c AND idx = pick)\n"""
_register(
    "judge_scores", lambda s, d: S.judge_scores(fx.votes(s, d), fx.criteria(s)).select("item_idx", "judge_id", _r("score")),
    _JUDGE_REP + "SELECT i AS item_idx, j AS judge_id, round(score, 6) AS score FROM " + scored("jr", "i, j"),
)
_LABEL_REP = """lr AS (SELECT lab.i, lab.c, lab.w, false AS failed, NULL::DOUBLE AS agreement, CASE WHEN lab.c < 2 THEN t = 2 ELSE coalesce(na, true) END AS na,
  CASE WHEN lab.c < 2 THEN (t = 1)::INT::DOUBLE ELSE coalesce(val, 0.0) END AS val FROM lab LEFT JOIN opt ON opt.c = lab.c AND idx = t)\n"""
_register(
    "label_scores", lambda s, d: S.label_scores(fx.labels(s, d), fx.criteria(s)).select("item_idx", _r("score")),
    SQL + ", " + _LABEL_REP + "SELECT i AS item_idx, round(score, 6) AS score FROM " + scored("lr", "i"),
)
_register(
    "rubric_totals", lambda s, d: S.rubric_totals(fx.criteria(s)), SQL + "SELECT count(*) AS n_criteria, sum(greatest(w, 0.0)) AS positive_weight FROM crit",
)

# --- text functions -------------------------------------------------------------------------------


def _conversations(spark, d):
    """Turns with a thinking section made up from the turn number, so that all forms occur."""
    t = F.col("text")
    form = F.pmod("turn", F.lit(3))
    tagged = F.when(form == 0, F.concat(F.lit("<Thinking> plan "), t, F.lit(" </thinking>\n<output> "), t, F.lit(" </output>"))).when(
        form == 1, F.concat(F.lit("<thinking>"), t, F.lit("</thinking> rest "), t)
    ).otherwise(t)
    return spark.read.parquet(f"{d}/conversations.parquet").withColumn("text", tagged)


_TURNS = r"""WITH turns AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<Thinking> plan ' || text || ' </thinking>' || chr(10) || '<output> ' || text || ' </output>'
  WHEN 1 THEN '<thinking>' || text || '</thinking> rest ' || text ELSE text END AS text FROM conversations),
parts AS (SELECT conv_id, turn, text, regexp_matches(text, '(?is)<thinking>(.*?)</thinking>') AS ht, regexp_matches(text, '(?is)<output>(.*?)</output>') AS ho,
  trim(regexp_extract(text, '(?is)<thinking>(.*?)</thinking>', 1), E' \t\n\r\x0B\f') AS thinking,
  trim(regexp_extract(text, '(?is)<output>(.*?)</output>', 1), E' \t\n\r\x0B\f') AS outp,
  trim(regexp_replace(text, '(?is)<thinking>(.*?)</thinking>', '', 'g'), E' \t\n\r\x0B\f') AS rest FROM turns),
sec AS (SELECT conv_id, turn, CASE WHEN ht THEN thinking ELSE '' END AS thinking, CASE WHEN ho THEN outp WHEN ht THEN rest ELSE text END AS output FROM parts)
"""
_register(
    "thinking_sections",
    lambda s, d: _conversations(s, d).select("conv_id", "turn", F.sha2(X.thinking_section(F.col("text")), 256).alias("thinking"), F.sha2(X.output_section(F.col("text")), 256).alias("output")),
    _TURNS + "SELECT conv_id, turn, sha256(thinking) AS thinking, sha256(output) AS output FROM sec",
)
_PENALTY = X.LengthPenalty(free_budget=20, max_cap=120)
_register(
    "length_penalty",
    lambda s, d: _conversations(s, d).select("conv_id", "turn", F.round(_PENALTY.of(X.thinking_section(F.col("text")), X.output_section(F.col("text"))), 6).alias("penalty")),
    _TURNS + r"""SELECT conv_id, turn, round(CASE WHEN n <= 20 THEN 0.0 WHEN n >= 120 THEN 0.5 ELSE 0.5 * pow((n - 20) / 100.0, 1.6) END, 6) AS penalty
  FROM (SELECT *, len(regexp_extract_all(thinking || ' ' || output, '[^\s]+')) AS n FROM sec)""",
)
_register(
    "confidence_snap",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select(
        "event_id", F.round(X.selection_confidence(F.pmod("event_id", F.lit(100)) / 99, F.lit(4)), 6).alias("confidence"),
        X.snapped_level(F.pmod("event_id", F.lit(13)) / 2 - 1, F.lit(4)).alias("level"),
    ),
    """SELECT event_id, round(greatest(0.0, least(1.0, (4 * ((event_id % 100) / 99.0::DOUBLE) - 1) / 3)), 6) AS confidence,
       greatest(0, least(3, round_even((event_id % 13) / 2.0 - 1, 0)))::INT AS level FROM events""",
)

# --- cells and metrics ----------------------------------------------------------------------------

_CELLS = REPORTS + """, cel AS (SELECT r.i, r.c, r.w, r.scale, r.k, r.pick AS p, lab.t, failed FROM (SELECT rep.*, k FROM rep JOIN crit USING (c)) r JOIN lab USING (i, c)),
jcel AS (SELECT v.i, v.c, v.w, v.scale, v.k, v.j, v.pick AS p, lab.t, err IS NOT NULL AS failed FROM v JOIN lab USING (i, c))
"""
#: Of judged cells, whether truth and prediction abstain.
_NA = "(c < 2 AND {0} = 2 OR c = 2 AND {0} = 3 OR c = 3 AND {0} IS NULL)"


def _class_sql(source: str, ca: str, na: str) -> str:
    """A subquery like cells.classes."""
    number = lambda x: f"""CASE WHEN c < 2 THEN CASE WHEN {x} = 2 AND '{ca}' = 'as_unmet' THEN 0 ELSE {x} END
        WHEN {_NA.format(x)} THEN {'0' if na == 'as_unmet' else 'CASE c WHEN 2 THEN 3 ELSE 4 END'} ELSE {x} END"""  # noqa: E731
    drop = f"({_NA.format('t')} OR {_NA.format('p')}) AND CASE WHEN c < 2 THEN {ca == 'exclude'} ELSE {na == 'exclude'} END"
    return f"(SELECT * REPLACE ({number('t')} AS t, {number('p')} AS p) FROM {source} WHERE NOT failed AND NOT coalesce({drop}, false))"


_PRF = """sum((t = 1 AND p = 1)::INT)::BIGINT AS tp, sum((t <> 1 AND p = 1)::INT)::BIGINT AS fp, sum((t = 1 AND p <> 1)::INT)::BIGINT AS fn, sum((t <> 1 AND p <> 1)::INT)::BIGINT AS tn"""
_RATES = """tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr,
  round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS phi"""


def _kappa_sql(source: str, by: str, weights: str = "none") -> str:
    """A subquery (by, kappa) over ``source`` (by, t, p): one row per group."""
    weight = "(a.r - b.r) ^ 2" if weights == "quadratic" else "(a.r <> b.r)::INT"
    obs = "(rt - rp) ^ 2" if weights == "quadratic" else "(rt <> rp)::INT"
    return f"""(WITH src AS (SELECT {by}, t, p FROM {source}),
      pres AS (SELECT {by}, x, row_number() OVER (PARTITION BY {by} ORDER BY x) AS r FROM (SELECT {by}, t AS x FROM src UNION SELECT {by}, p FROM src)),
      rk AS (SELECT {', '.join('src.' + b.strip() for b in by.split(','))}, a.r AS rt, b.r AS rp FROM src JOIN pres a ON {_same('src', 'a', by)} AND a.x = t JOIN pres b ON {_same('src', 'b', by)} AND b.x = p),
      ob AS (SELECT {by}, sum({obs})::DOUBLE AS o, count(*)::DOUBLE AS n FROM rk GROUP BY {by}),
      mt AS (SELECT {by}, rt AS r, count(*) AS m FROM rk GROUP BY {by}, rt), mp AS (SELECT {by}, rp AS r, count(*) AS m FROM rk GROUP BY {by}, rp),
      ex AS (SELECT {', '.join('a.' + b.strip() for b in by.split(','))}, sum(a.m * b.m * {weight})::DOUBLE AS e FROM mt a JOIN mp b ON {_same('a', 'b', by)} GROUP BY {', '.join('a.' + b.strip() for b in by.split(','))})
      SELECT {by}, 1 - o * n / nullif(e, 0) AS kappa FROM ob JOIN ex USING ({by}))"""


def _same(a: str, b: str, by: str) -> str:
    return " AND ".join(f"{a}.{x.strip()} = {b}.{x.strip()}" for x in by.split(","))


def _criterion_metrics(spark, d, mode):
    tp = A.counts(K.classes(_cells(spark, d), mode, "exclude").where("scale = 'binary'"), ["criterion_idx"])
    out = A.measured(tp, ["criterion_idx"])
    floats = ("accuracy", "precision", "recall", "f1", "fpr", "fnr", "phi", "kappa")
    return out.select("criterion_idx", "n", "tp", "fp", "fn", "tn", *map(_r, floats))


for _how in K.MODES:
    _src = _class_sql("cel", _how, "exclude")
    _register(
        f"criterion_metrics_{_how}", partial(_criterion_metrics, mode=_how),
        _CELLS + f", k AS (SELECT * FROM {_src} WHERE c < 2) SELECT c AS criterion_idx, n, round(acc, 6) AS accuracy, {_RATES}, round(kappa, 6) AS kappa FROM (SELECT c, count(*) AS n, avg((t = p)::INT)::DOUBLE AS acc, {_PRF} FROM k GROUP BY c) JOIN {_kappa_sql('k', 'c')} USING (c)",
    )


def _choice_metrics(spark, d, scale):
    own = K.classes(_cells(spark, d)).where(F.col("scale") == scale)
    tp, by = A.counts(own, ["criterion_idx"]), ["criterion_idx"]
    out = A.measured(tp, by, "quadratic" if scale == "ordinal" else "none", rates=False)
    return out.select("criterion_idx", "n", *map(_r, ("accuracy", "adjacent", "kappa", "rmse", "mae")))


for _how, _weights in {"ordinal": "quadratic", "nominal": "none"}.items():
    _register(
        f"{_how}_metrics", partial(_choice_metrics, scale=_how),
        _CELLS + f""", k AS (SELECT q.*, a.val AS tv, b.val AS pv FROM {_class_sql('cel', 'exclude', 'exclude')} q JOIN opt a ON a.c = q.c AND a.idx = t JOIN opt b ON b.c = q.c AND b.idx = p WHERE scale = '{_how}')
        SELECT c AS criterion_idx, n, round(acc, 6) AS accuracy, round(adj, 6) AS adjacent, round(kappa, 6) AS kappa, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM (SELECT c, count(*) AS n, avg((t = p)::INT)::DOUBLE AS acc,
        avg((abs(t - p) <= 1)::INT)::DOUBLE AS adj, sqrt(avg((pv - tv) ^ 2)) AS rmse, avg(abs(pv - tv)) AS mae FROM k GROUP BY c) JOIN {_kappa_sql('k', 'c', _weights)} USING (c)""",
    )


def _n_options():
    return F.when(F.col("criterion_idx") < 2, 2).otherwise(4)


_register(
    "per_option_metrics",
    lambda s, d: A.per_option(A.counts(K.classes(_cells(s, d)).where("options is not null"), ["criterion_idx"]), ["criterion_idx"], F.lit(4)).select("criterion_idx", "class", _r("precision"), _r("recall"), _r("f1"), "support", "support_pred"),
    _CELLS + f""", k AS (SELECT * FROM {_class_sql('cel', 'exclude', 'exclude')} WHERE c >= 2),
    z AS (SELECT opt.c, idx AS x, coalesce(sum((t = idx)::INT), 0) AS nt, coalesce(sum((p = idx)::INT), 0) AS np, coalesce(sum((t = idx AND p = idx)::INT), 0) AS hit FROM opt LEFT JOIN k ON k.c = opt.c GROUP BY opt.c, idx)
    SELECT c AS criterion_idx, x::INT AS class, round(coalesce(hit / nullif(np, 0), 0.0), 6) AS precision, round(coalesce(hit / nullif(nt, 0), 0.0), 6) AS recall, round(coalesce(2 * hit / nullif(nt + np, 0), 0.0), 6) AS f1, nt::BIGINT AS support, np::BIGINT AS support_pred FROM z""",
)
_register(
    "confusion_matrix",
    lambda s, d: A.confusion(A.counts(K.classes(_cells(s, d)), ["criterion_idx"]), ["criterion_idx"], _n_options()).select("criterion_idx", "t", "p", "n"),
    _CELLS + f""", k AS (SELECT * FROM {_class_sql('cel', 'exclude', 'exclude')}), g AS (SELECT c, t, p FROM crit, (SELECT unnest(range(4))::INT AS t) x, (SELECT unnest(range(4))::INT AS p) y WHERE c >= 2 OR t < 2 AND p < 2)
    SELECT g.c AS criterion_idx, g.t, g.p, count(k.i) AS n FROM g LEFT JOIN k ON k.c = g.c AND k.t = g.t AND k.p = g.p GROUP BY ALL""",
)


def _judge_cells(spark, d):
    return K.judge_cells(fx.votes(spark, d), fx.labels(spark, d), fx.criteria(spark), fx.judges(spark))


_register(
    "judge_confusion_3x3",
    lambda s, d: A.counts(K.classes(_judge_cells(s, d).where("scale = 'binary'"), "as_category"), ["judge_id"]).select("judge_id", "t", "p", "n"),
    _CELLS + f"SELECT j AS judge_id, t, p, count(*) AS n FROM {_class_sql('jcel', 'as_category', 'exclude')} WHERE c < 2 GROUP BY ALL",
)
_register(
    "judge_metrics",
    lambda s, d: A.measured(A.counts(K.classes(_judge_cells(s, d)), ["judge_id", "criterion_idx"]), ["judge_id", "criterion_idx"], rates=False).select("judge_id", "criterion_idx", "n", _r("accuracy"), _r("adjacent"), _r("kappa")),
    _CELLS + f", k AS (SELECT * FROM {_class_sql('jcel', 'exclude', 'exclude')}) SELECT j AS judge_id, c AS criterion_idx, n, round(acc, 6) AS accuracy, round(adj, 6) AS adjacent, round(kappa, 6) AS kappa FROM (SELECT j, c, count(*) AS n, avg((t = p)::INT)::DOUBLE AS acc, avg((abs(t - p) <= 1)::INT)::DOUBLE AS adj FROM k GROUP BY j, c) JOIN {_kappa_sql('k', 'j, c')} USING (j, c)",
)
_register(
    "cells",
    lambda s, d: _cells(s, d).select("item_idx", "criterion_idx", "pred", "true", "pred_idx", "true_idx", "failed"),
    _CELLS + f"SELECT i AS item_idx, c AS criterion_idx, CASE WHEN c < 2 THEN {VERDICT.format('p')} END AS pred, CASE WHEN c < 2 THEN {VERDICT.format('t')} END AS \"true\", CASE WHEN c >= 2 THEN p END AS pred_idx, CASE WHEN c >= 2 THEN t END AS true_idx, failed FROM cel",
)
_register(
    "resolved_labels", lambda s, d: K.resolved_labels(fx.labels(s, d).withColumn("option_idx", F.when((F.col("criterion_idx") == 3) & (F.pmod("item_idx", F.lit(17)) == 0), 9).otherwise(F.col("option_idx"))), fx.criteria(s)).groupBy("criterion_idx").agg(F.count("*").alias("n")),
    SQL + "SELECT c AS criterion_idx, count(*) AS n FROM lab WHERE i % 17 <> 0 GROUP BY c",
)
_register(
    "failed_cells", lambda s, d: _cells(s, d).groupBy("criterion_idx").agg(F.count_if("failed").alias("n_failed"), F.count("*").alias("n")),
    _CELLS + "SELECT c AS criterion_idx, sum(failed::INT)::BIGINT AS n_failed, count(*) AS n FROM cel GROUP BY c",
)
_register(
    "missing_votes",
    lambda s, d: K.judge_cells(fx.votes(s, d).where("judge_id <> 'jb' or item_idx % 3 <> 0"), fx.labels(s, d), fx.criteria(s), fx.judges(s)).groupBy("judge_id").agg(F.count_if("missing").alias("n_missing"), F.count("*").alias("n")),
    SQL + "SELECT j AS judge_id, sum((j = 'jb' AND i % 3 = 0)::INT)::BIGINT AS n_missing, count(*) AS n FROM lab, judge GROUP BY j",
)
_register(
    "coverage_stats",
    lambda s, d: A.coverage(_cells(s, d), ["criterion_idx"]).select("criterion_idx", "n_cells", "n_failed", "n_used", _r("coverage")),
    _CELLS + f"SELECT c AS criterion_idx, n_cells, n_failed, coalesce(n_used, 0) AS n_used, round(coalesce(n_used, 0) / nullif(n_cells - n_failed, 0), 6) AS coverage FROM (SELECT c, count(*) AS n_cells, sum(failed::INT)::BIGINT AS n_failed FROM cel GROUP BY c) LEFT JOIN (SELECT c, count(*) AS n_used FROM {_class_sql('cel', 'exclude', 'exclude')} GROUP BY c) USING (c)",
)
for _name, _where in {"na_stats": "c >= 2", "cannot_assess_stats": "c < 2"}.items():
    _register(
        _name, lambda s, d, w=_where.replace("c ", "criterion_idx "): K.abstentions(_cells(s, d).where(w), ["criterion_idx"]),
        _CELLS + f"SELECT c AS criterion_idx, sum((a AND b)::INT)::BIGINT AS \"both\", sum((NOT a AND b)::INT)::BIGINT AS only_predicted, sum((a AND NOT b)::INT)::BIGINT AS only_true, sum((NOT a AND NOT b)::INT)::BIGINT AS neither FROM (SELECT c, coalesce({_NA.format('t')}, false) AS a, coalesce({_NA.format('p')}, false) AS b FROM cel WHERE NOT failed AND {_where}) GROUP BY c",
    )


def _micro_macro(spark, d):
    """Per criterion and pooled measures of one table of counts, as grouping sets would give them."""
    own = K.classes(_cells(spark, d)).where("scale = 'binary'")
    tp = A.counts(own, ["criterion_idx"])
    level = tp.withColumn("of", F.explode(F.array(F.col("criterion_idx"), F.lit(-1)))).groupBy("of", "t", "p").agg(F.sum("n").alias("n"))
    each = A.measured(level, ["of"])
    pooled, part = F.col("of") < 0, F.col("of") >= 0
    pick = lambda c, name: F.max(F.when(pooled, F.col(c))).alias(name)
    mean = lambda c, name: F.avg(F.when(part, F.col(c))).alias(name)
    out = each.agg(pick("accuracy", "micro_accuracy"), pick("f1", "f1"), pick("phi", "phi"), mean("accuracy", "macro_accuracy"), mean("kappa", "mean_kappa"))
    return out.select(*map(_r, ("micro_accuracy", "f1", "phi", "macro_accuracy", "mean_kappa")))


_register(
    "micro_macro", _micro_macro,
    _CELLS + f", k AS (SELECT * FROM {_class_sql('cel', 'exclude', 'exclude')} WHERE c < 2) SELECT round(acc, 6) AS micro_accuracy, f1, phi, round(macc, 6) AS macro_accuracy, round(mk, 6) AS mean_kappa FROM (SELECT acc, {_RATES} FROM (SELECT avg((t = p)::INT)::DOUBLE AS acc, {_PRF} FROM k)), (SELECT avg(acc) AS macc, avg(kappa) AS mk FROM (SELECT c, avg((t = p)::INT)::DOUBLE AS acc FROM k GROUP BY c) JOIN {_kappa_sql('k', 'c')} USING (c))",
)

# --- inter-rater ----------------------------------------------------------------------------------


#: Ratings as irr.rated has them, by mode: what becomes of a binary CANNOT_ASSESS.
_UNSURE = {"exclude": "NULL", "as_unmet": "0", "as_category": "2"}


def _rated_sql(mode: str) -> str:
    x = f"CASE WHEN c < 2 AND pick = 2 THEN {_UNSURE[mode]} ELSE pick END"
    return SQL + f", rt AS (SELECT i, c, j, {x} AS x, scale FROM v WHERE err IS NULL AND {x} IS NOT NULL)\n"


_FLEISS_SQL = """, per AS (SELECT c, i, x, count(*) AS k FROM rt GROUP BY c, i, x), whole AS (SELECT * FROM per QUALIFY sum(k) OVER (PARTITION BY c, i) = 3),
    a AS (SELECT c, avg(pi) AS pbar, count(*) AS units FROM (SELECT c, i, (sum(k * k) - 3.0) / 6.0 AS pi FROM whole GROUP BY c, i) GROUP BY c),
    b AS (SELECT c, sum(kc * kc) / sum(kc) ^ 2 AS pe FROM (SELECT c, x, sum(k)::DOUBLE AS kc FROM whole GROUP BY c, x) GROUP BY c)
    SELECT c AS criterion_idx, units, round(CASE WHEN units >= 2 THEN (pbar - pe) / nullif(1 - pe, 0) END, 6) AS fleiss_kappa FROM a JOIN b USING (c)"""
for _how in K.MODES:
    _register(
        "fleiss_kappa" + ("" if _how == "exclude" else f"_{_how}"),
        lambda s, d, how=_how: I.fleiss_kappa(I.rated(fx.votes(s, d), fx.criteria(s), how), ["criterion_idx"], ["item_idx"], 3).select("criterion_idx", "units", _r("fleiss_kappa")),
        _rated_sql(_how) + _FLEISS_SQL,
    )
_ALPHA_SQL = """, per AS (SELECT c, i, x, count(*) AS k FROM rt WHERE {where} GROUP BY c, i, x), pr AS (SELECT *, sum(k) OVER (PARTITION BY c, i) AS m FROM per QUALIFY sum(k) OVER (PARTITION BY c, i) > 1),
    o AS (SELECT a.c, a.x, b.x AS y, sum(a.k * (b.k - (a.x = b.x)::INT) / (a.m - 1)::DOUBLE) AS o FROM pr a JOIN pr b USING (c, i) GROUP BY a.c, a.x, b.x),
    nc AS (SELECT c, x, sum(k)::DOUBLE AS n FROM pr GROUP BY c, x),
    g AS (SELECT a.c, a.x, b.x AS y, a.n AS na, b.n AS nb, CASE WHEN a.x = b.x THEN 0.0 ELSE {delta} END AS d2 FROM nc a JOIN nc b USING (c))
    SELECT g.c AS criterion_idx, any_value(u.units) AS units, round(1 - (any_value(u.n) - 1) * sum(coalesce(o.o, 0) * d2) / nullif(sum(na * nb * d2), 0), 6) AS alpha
    FROM g LEFT JOIN o ON o.c = g.c AND o.x = g.x AND o.y = g.y JOIN (SELECT c, count(DISTINCT i) AS units, sum(k)::DOUBLE AS n FROM pr GROUP BY c) u ON u.c = g.c GROUP BY g.c"""


def _alpha(s, d, how, ordinal):
    own = I.rated(fx.votes(s, d), fx.criteria(s), how, superseded=True).where((F.col("scale") == "ordinal") == ordinal)
    return I.krippendorff_alpha(own, ["criterion_idx"], ["item_idx"], "ordinal" if ordinal else "nominal").select("criterion_idx", "units", _r("alpha"))


for _how in K.MODES:
    _register(
        "krippendorff_nominal" + ("" if _how == "exclude" else f"_{_how}"), partial(_alpha, how=_how, ordinal=False),
        _rated_sql(_how) + _ALPHA_SQL.format(where="scale <> 'ordinal'", delta="1.0"),
    )
_register(
    "krippendorff_ordinal", partial(_alpha, how="exclude", ordinal=True),
    _rated_sql("exclude") + _ALPHA_SQL.format(where="scale = 'ordinal'", delta="((SELECT sum(z.n) FROM nc z WHERE z.c = a.c AND z.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x)) - (a.n + b.n) / 2) ^ 2"),
)

# --- scores ---------------------------------------------------------------------------------------


def _pairs(spark, d):
    """(item_idx, pred, true): predicted and expected scores of labelled items."""
    pred = S.item_reports(_labelled_reports(spark, d)).select("item_idx", F.round("score", 9).alias("pred"))
    true = S.label_scores(fx.labels(spark, d), fx.criteria(spark)).select("item_idx", F.round("score", 9).alias("true"))
    return pred.join(true, "item_idx").where("pred is not null and true is not null").withColumn("g", F.pmod("item_idx", F.lit(2)))


_PAIRS = _WITH_AGREED + ", " + _LABEL_REP + f", pairs AS (SELECT a.i, a.i % 2 AS g, round(a.score, 9) AS x, round(b.score, 9) AS y FROM {scored('rep_a', 'i')} a JOIN {scored('lr', 'i')} b USING (i) WHERE a.score IS NOT NULL AND b.score IS NOT NULL)\n"
_register("score_error", lambda s, d: D.score_errors(_pairs(s, d), ["g"]).select("g", "n", _r("rmse"), _r("mae")), _PAIRS + "SELECT g, count(*) AS n, round(sqrt(avg((x - y) ^ 2)), 6) AS rmse, round(avg(abs(x - y)), 6) AS mae FROM pairs GROUP BY g")
_register(
    "bias", lambda s, d: D.bias(_pairs(s, d), ["g"]).select("g", "n", _r("mean_diff"), _r("std_diff"), _r("t", 4), _r("effect", 5), "direction"),
    _PAIRS + "SELECT g, n, round(m, 6) AS mean_diff, round(sd, 6) AS std_diff, round(m * sqrt(n) / nullif(sd, 0), 4) AS t, round(m / nullif(sd, 0), 5) AS effect, CASE WHEN m > 0.001 THEN 'positive' WHEN m < -0.001 THEN 'negative' ELSE 'none' END AS direction FROM (SELECT g, count(*) AS n, avg(x - y) AS m, stddev_samp(x - y) AS sd FROM pairs GROUP BY g)",
)
_register("score_pearson", lambda s, d: R.pearson(_pairs(s, d), ["g"], "pred", "true").select("g", "n", _r("pearson")), _PAIRS + "SELECT g, count(*) AS n, round(corr(x, y), 6) AS pearson FROM pairs GROUP BY g")
_register(
    "score_spearman", lambda s, d: R.spearman(_pairs(s, d), ["g"], "pred", "true").select("g", "n", _r("spearman")),
    _PAIRS + "SELECT g, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM pairs) GROUP BY g",
)
_register(
    "score_kendall", lambda s, d: R.kendall(_pairs(s, d), ["g"], "pred", "true").select("g", "n", _r("kendall")),
    _PAIRS + """, w AS (SELECT g, x, y, count(*) AS w FROM pairs GROUP BY g, x, y), s AS (SELECT a.g, sum(a.w * b.w * sign((a.x - b.x) * (a.y - b.y))) / 2 AS s FROM w a JOIN w b USING (g) GROUP BY a.g),
    tx AS (SELECT g, sum(n * (n - 1)) / 2 AS tx FROM (SELECT g, x, count(*) AS n FROM pairs GROUP BY g, x) GROUP BY g), ty AS (SELECT g, sum(n * (n - 1)) / 2 AS ty FROM (SELECT g, y, count(*) AS n FROM pairs GROUP BY g, y) GROUP BY g),
    nn AS (SELECT g, count(*) AS n FROM pairs GROUP BY g) SELECT g, n, round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS kendall FROM s JOIN tx USING (g) JOIN ty USING (g) JOIN nn USING (g)""",
)
_register(
    "score_distribution",
    lambda s, d: D.score_distribution(_pairs(s, d), ["g"], "pred").select("g", "n", *map(_r, ("mean", "std", "variance", "min", "max", "p25", "median", "p75", "iqr", "skewness", "kurtosis"))),
    _PAIRS + """, m AS (SELECT g, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, var_samp(x) AS v, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM pairs GROUP BY g),
    k AS (SELECT g, avg((x - mean) ^ 2) AS m2, avg((x - mean) ^ 3) AS m3, avg((x - mean) ^ 4) AS m4 FROM pairs JOIN m USING (g) GROUP BY g)
    SELECT g, n, round(mean, 6) AS mean, round(sd, 6) AS std, round(v, 6) AS variance, round(lo, 6) AS min, round(hi, 6) AS max, round(a, 6) AS p25, round(b, 6) AS median, round(c, 6) AS p75, round(c - a, 6) AS iqr,
    round(m3 / m2 ^ 1.5, 6) AS skewness, round(m4 / m2 ^ 2 - 3, 6) AS kurtosis FROM m JOIN k USING (g)""",
)
_register("score_histogram", lambda s, d: D.histogram(_pairs(s, d), ["g"], "pred"), _PAIRS + "SELECT g, least(floor(x / 0.1), 9)::INT AS bin, count(*) AS n FROM pairs GROUP BY ALL")
_register(
    "emd_ks", lambda s, d: D.distances(_pairs(s, d), ["g"], "pred", "true").select("g", _r("emd"), _r("ks")),
    _PAIRS + """, l AS (SELECT g, x AS v, 1 AS a FROM pairs UNION ALL SELECT g, y, 0 FROM pairs), q AS (SELECT g, v, sum(a) AS na, sum(1 - a) AS nb FROM l GROUP BY g, v),
    c AS (SELECT g, v, sum(na) OVER r / sum(na) OVER (PARTITION BY g) - sum(nb) OVER r / sum(nb) OVER (PARTITION BY g) AS gap, lead(v) OVER (PARTITION BY g ORDER BY v) - v AS step FROM q WINDOW r AS (PARTITION BY g ORDER BY v))
    SELECT g, round(sum(abs(gap) * coalesce(step, 0)), 6) AS emd, round(max(abs(gap)), 6) AS ks FROM c GROUP BY g""",
)


_register(
    "earth_movers_normalised",
    lambda s, d: D.earth_movers(_pairs(s, d).withColumns({"pred": F.col("pred") * 4 - 1, "true": F.col("true") * 4 - 1}), ["g"], "pred", "true").select(
        "g", *map(_r, ("emd", "mean_diff", "std_diff", "bias_magnitude")), "bias_direction", "interpretation"),
    _PAIRS + """, w AS (SELECT g, 4 * x - 1 AS x, 4 * y - 1 AS y FROM pairs), b AS (SELECT g, greatest(max(x), max(y)) AS hi, least(min(x), min(y)) AS lo FROM w GROUP BY g), n AS (SELECT g, (x - lo) / (hi - lo) AS x, (y - lo) / (hi - lo) AS y FROM w JOIN b USING (g)),
    l AS (SELECT g, x AS v, 1 AS a FROM n UNION ALL SELECT g, y, 0 FROM n), q AS (SELECT g, v, sum(a) AS na, sum(1 - a) AS nb FROM l GROUP BY g, v),
    c AS (SELECT g, v, sum(na) OVER r / sum(na) OVER (PARTITION BY g) - sum(nb) OVER r / sum(nb) OVER (PARTITION BY g) AS gap, lead(v) OVER (PARTITION BY g ORDER BY v) - v AS step FROM q WINDOW r AS (PARTITION BY g ORDER BY v)),
    e AS (SELECT g, sum(abs(gap) * coalesce(step, 0)) AS emd FROM c GROUP BY g), m AS (SELECT g, avg(x) - avg(y) AS d, stddev_pop(x) - stddev_pop(y) AS sd FROM n GROUP BY g)
    SELECT g, round(emd, 6) AS emd, round(d, 6) AS mean_diff, round(sd, 6) AS std_diff, round(abs(d), 6) AS bias_magnitude, CASE WHEN d > 0.01 THEN 'higher' WHEN d < -0.01 THEN 'lower' ELSE 'none' END AS bias_direction,
    CASE WHEN emd >= 0.2 THEN 'large' WHEN emd >= 0.1 THEN 'moderate' WHEN emd >= 0.05 THEN 'small' ELSE 'negligible' END AS interpretation FROM e JOIN m USING (g)""",
)


_REPLICATES = 1000


def _bootstrap(spark, d):
    cells, pairs = _cells(spark, d), _pairs(spark, d)
    reps = B.replicate_metrics(K.classes(cells).where("scale = 'binary'"), _REPLICATES, seed=3)
    both = B.interval(reps, "accuracy", "mean_kappa").unionByName(B.interval(B.replicate_errors(pairs, _REPLICATES, seed=3), "rmse"))
    return both.select("metric", "n", _r("mean"), _r("low"), _r("high"))


_TIMES = " + ".join(f"(h >= {c})::INT" for c in B.CUTS)
_DRAWN = f"""SELECT *, {_TIMES} AS times FROM (SELECT *, ('0x' || substr(md5('3:' || i || ':' || (b // 4)), 8 * (b % 4) + 1, 8))::BIGINT AS h FROM {{0}}, (SELECT unnest(range({_REPLICATES})) AS b)) q"""
_register(
    "bootstrap_ci", _bootstrap,
    _PAIRS + ", " + _CELLS.removeprefix(REPORTS).removeprefix(", ") + f""", k AS (SELECT i, c, t, p FROM {_class_sql('cel', 'exclude', 'exclude')} WHERE c < 2),
    kb AS (SELECT b, c, t, p FROM (SELECT b, c, t, p, unnest(range(times)) AS again FROM ({_DRAWN.format('k')}) x)),
    m AS (SELECT b, acc, mk FROM (SELECT b, avg((t = p)::INT)::DOUBLE AS acc FROM kb GROUP BY b) LEFT JOIN (SELECT b, avg(kappa) AS mk FROM {_kappa_sql('kb', 'b, c')} GROUP BY b) USING (b)),
    e AS (SELECT b, sqrt(sum(times * (x - y) ^ 2) / sum(times)) AS rmse FROM ({_DRAWN.format('pairs')}) z WHERE times > 0 GROUP BY b)
    SELECT 'accuracy' AS metric, count(acc) AS n, round(avg(acc), 6) AS mean, round(quantile_cont(acc, 0.025), 6) AS low, round(quantile_cont(acc, 0.975), 6) AS high FROM m
    UNION ALL SELECT 'mean_kappa', count(mk), round(avg(mk), 6), round(quantile_cont(mk, 0.025), 6), round(quantile_cont(mk, 0.975), 6) FROM m
    UNION ALL SELECT 'rmse', count(rmse), round(avg(rmse), 6), round(quantile_cont(rmse, 0.025), 6), round(quantile_cont(rmse, 0.975), 6) FROM e""",
)


def _pooled(spark, d):
    own = K.classes(_cells(spark, d))
    tp = A.counts(own, ["scale"])
    errors = own.where("options is not null").groupBy("scale").agg(F.sqrt(F.avg(F.pow(F.col("pred_value") - F.col("true_value"), F.lit(2)))).alias("rmse"))
    return A.accuracy(tp, ["scale"]).join(errors, "scale", "left").select("scale", "n", _r("accuracy"), _r("rmse"))


_register(
    "pooled_by_scale", _pooled,
    _CELLS + f"SELECT scale, count(*) AS n, round(avg((t = p)::INT)::DOUBLE, 6) AS accuracy, round(sqrt(avg(CASE WHEN q.c >= 2 THEN (a.val - b.val) ^ 2 END)), 6) AS rmse FROM {_class_sql('cel', 'exclude', 'exclude')} q LEFT JOIN opt a ON a.c = q.c AND a.idx = t LEFT JOIN opt b ON b.c = q.c AND b.idx = p GROUP BY scale",
)

# --- cascade --------------------------------------------------------------------------------------

_DM = REPORTS + r""", dm0 AS (SELECT i, c, w, labelled, t, ('0x' || substr(md5(i::VARCHAR || ':c' || c || ':dm'), 1, 8))::BIGINT AS h FROM tr WHERE c < 2),
dm AS (SELECT i, c, w, CASE WHEN h % 97 < 3 THEN 2 WHEN (h // 1009) % 100 < 25 THEN 1 - t ELSE t END AS p, h % 97 < 3 AS na, CASE WHEN h % 97 >= 3 THEN (h % 1001) / 1000.0::DOUBLE END AS conf FROM dm0),
both2 AS (SELECT dm.i, dm.c, dm.w, dm.p AS dp, rep.pick AS lp, na, conf, lab.t FROM dm JOIN rep USING (i, c) LEFT JOIN lab USING (i, c))
"""
_SWEEP_SQL = _DM + """, th AS (SELECT unnest(range(51)) / 50.0::DOUBLE AS threshold), e AS (SELECT threshold, dp, lp, t, na OR conf IS NULL OR conf < threshold AS up FROM both2, th),
sw AS (SELECT round(threshold, 2) AS threshold, avg(up::INT)::DOUBLE AS r, avg((dp = t)::INT) FILTER (NOT up AND t IS NOT NULL)::DOUBLE AS ka, avg((dp = t)::INT) FILTER (up AND t IS NOT NULL)::DOUBLE AS ea,
  avg((lp = t)::INT) FILTER (up AND t IS NOT NULL)::DOUBLE AS la, avg((CASE WHEN up THEN lp ELSE dp END = t)::INT) FILTER (t IS NOT NULL)::DOUBLE AS metric FROM e GROUP BY threshold)
"""


def _runs(spark, d):
    dm = fx.unsure_judge(spark, d)
    llm = _reports(spark, d).where("scale = 'binary'").select("item_idx", "criterion_idx", "final_verdict", "na", "error").withColumn("confidence", F.lit(None).cast("double"))
    return dm, llm, fx.labels(spark, d).where("criterion_idx < 2").select("item_idx", "criterion_idx", F.col("verdict").alias("true"))


def _sweep(spark, d):
    return C.sweep(*_runs(spark, d))


_POINT = ("escalation_rate", "kept_accuracy", "escalated_dm_accuracy", "escalated_llm_accuracy", "metric", "cost")
_POINT_SQL = "threshold, round(r, 6) AS escalation_rate, round(ka, 6) AS kept_accuracy, round(ea, 6) AS escalated_dm_accuracy, round(la, 6) AS escalated_llm_accuracy, round(metric, 6) AS metric, round(1 + 10 * r, 6) AS cost"
_register("cascade_sweep", lambda s, d: _sweep(s, d).select("threshold", *map(_r, _POINT)), _SWEEP_SQL + f"SELECT {_POINT_SQL} FROM sw")
_register(
    "cascade_best", lambda s, d: C.best(_sweep(s, d), max_rate=0.6, tolerance=0.02).select("threshold", *map(_r, _POINT)),
    _SWEEP_SQL + f"SELECT {_POINT_SQL} FROM (SELECT * FROM sw WHERE r <= 0.6 QUALIFY metric >= max(metric) OVER () - 0.02) ORDER BY r, metric DESC, threshold LIMIT 1",
)


def _replay(spark, d):
    dm, llm, _ = _runs(spark, d)
    th = C.threshold_of(fx.criteria(spark), 0.5, {"toxic": 0.8})
    out = C.replay(dm, llm, th).join(fx.criteria(spark).select("criterion_idx", "weight", "options"), "criterion_idx").withColumn("value", F.lit(None).cast("double")).withColumn("agreement", F.lit(None).cast("double"))
    scores = S.item_reports(out).select("item_idx", _r("score"), "cannot_assess_count")
    return scores.join(out.groupBy("item_idx").agg(F.count_if("escalated").alias("n_escalated")), "item_idx")


_register(
    "cascade_replay", _replay,
    _DM + f""", o AS (SELECT i, c, w, na OR conf IS NULL OR conf < CASE c WHEN 0 THEN 0.5 ELSE 0.8 END AS up, dp, lp FROM both2),
    oc AS (SELECT o.i, o.c, o.w, up, CASE WHEN up THEN lp ELSE dp END = 2 AS na, (CASE WHEN up THEN lp ELSE dp END = 1)::INT::DOUBLE AS val, up AND rep.failed AS failed, NULL::DOUBLE AS agreement FROM o JOIN rep USING (i, c))
    SELECT q.i AS item_idx, round(score, 6) AS score, nas::BIGINT AS cannot_assess_count, n_escalated FROM {scored('oc', 'i')} q JOIN (SELECT i, sum(up::INT)::BIGINT AS n_escalated FROM oc GROUP BY i) USING (i)""",
)

_CAL = _DM + """, cb AS (SELECT dm.i, dm.c, dm.w, dm.p AS dp, CASE WHEN rep.failed THEN NULL ELSE rep.pick END AS lp, rep.pick AS shown, rep.failed AS lf, na, conf, lab.t FROM dm JOIN rep USING (i, c) LEFT JOIN lab USING (i, c)),
th AS (SELECT unnest(range(51)) AS k), e AS (SELECT k, cb.*, na OR conf IS NULL OR conf < k / 50.0::DOUBLE AS up, CASE WHEN i % 4 > 0 THEN (i % 11) / 8.0 ELSE 0 END AS cost FROM cb, th),
pr AS (SELECT *, CASE WHEN up THEN lp ELSE dp END AS p FROM e),
base AS (SELECT sum(CASE WHEN i % 5 > 0 THEN (i % 7) / 8.0 ELSE 0 END) AS cost, sum(0.5) AS seconds FROM (SELECT DISTINCT i FROM dm)),
pt AS (SELECT k, avg(up::INT) AS r, avg((dp = t)::INT) FILTER (NOT up AND t < 2 AND dp < 2) AS ka, avg((dp = t)::INT) FILTER (up AND t < 2 AND dp < 2 AND lp < 2) AS ea, avg((lp = t)::INT) FILTER (up AND t < 2 AND dp < 2 AND lp < 2) AS la,
       (SELECT cost FROM base) + sum(CASE WHEN up THEN cost ELSE 0 END) AS cost, (SELECT seconds FROM base) + sum(CASE WHEN up THEN 2 ELSE 0 END) AS seconds FROM pr GROUP BY k),
kc AS (SELECT k, c, avg((p = t)::INT) AS a, avg(t) AS mt, avg(p) AS mp, avg(t) * avg(p) + (1 - avg(t)) * (1 - avg(p)) AS ch FROM pr WHERE t < 2 AND p < 2 GROUP BY k, c),
kk AS (SELECT k, c, CASE WHEN (mt + mp) IN (0, 2) THEN NULL ELSE 1 - (1 - a) / (1 - ch) END AS kappa FROM kc),
ov AS (SELECT k, 2.0 * count(*) FILTER (t = 1 AND p = 1) / (count(*) FILTER (t = 1) + count(*) FILTER (p = 1)) AS f1 FROM pr WHERE t < 2 AND p < 2 GROUP BY k),
"""
_CURVE = "k / 50.0::DOUBLE AS threshold, round(r, 6) AS escalation_rate, round(ka, 6) AS kept_accuracy, round(ea, 6) AS escalated_dm_accuracy, round(la, 6) AS escalated_llm_accuracy, round(cost, 6)::DOUBLE AS cost, round(seconds, 6)::DOUBLE AS seconds"
#: Coordinate ascent over a grid of both thresholds: g (k0, k1, m), picks by rate, metric and threshold.
_ASCENT = """, gm AS (SELECT k0, k1, round(m, 12) AS m, (SELECT sum(n) FROM rt WHERE rt.c = 0 AND rt.k = k0) + (SELECT sum(n) FROM rt WHERE rt.c = 1 AND rt.k = k1) AS r FROM g),
s0 AS (SELECT k0 AS k FROM gm WHERE k0 = k1 QUALIFY m = max(m) OVER () ORDER BY r, k0 LIMIT 1),
f0 AS (SELECT k0 AS k FROM gm WHERE k1 = (SELECT k FROM s0) QUALIFY m = max(m) OVER () ORDER BY r, k0 LIMIT 1),
f1 AS (SELECT k1 AS k FROM gm WHERE k0 = (SELECT k FROM f0) QUALIFY m = max(m) OVER () ORDER BY r, k1 LIMIT 1)
SELECT 'quality' AS name, k / 50.0::DOUBLE AS threshold FROM f0 UNION ALL SELECT 'toxic', k / 50.0::DOUBLE FROM f1"""


def _calibrate(spark, d, **how):
    own = fx.criteria(spark).where("criterion_idx < 2")
    i = F.col("item_idx")
    dm, llm, true = _runs(spark, d)
    runs = dm.select("item_idx").distinct().select(
        "item_idx", F.when(F.pmod(i, F.lit(5)) > 0, F.pmod(i, F.lit(7)) / 8.0).alias("dm_cost"), F.lit(0.5).alias("dm_seconds"),
        F.when(F.pmod(i, F.lit(4)) > 0, F.pmod(i, F.lit(11)) / 4.0).alias("llm_cost"), F.lit(4.0).alias("llm_seconds"),
    )
    expected = S.label_scores(fx.labels(spark, d).where("criterion_idx < 2"), own)
    return CL.calibrate(dm, llm, true, own, runs=runs, expected=expected, **how)


def _curve(spark, d, metric):
    columns = ("escalation_rate", "kept_accuracy", "escalated_dm_accuracy", "escalated_llm_accuracy", "metric", "cost", "seconds")
    return _calibrate(spark, d, metric=metric).to_dataframe(spark).select("threshold", *map(_r, columns))


def _fitted(spark, d, metric):
    got = _calibrate(spark, d, metric=metric, per_criterion=True).fitted
    return spark.createDataFrame(sorted(got.items()), "name string, threshold double")


_LABEL_2 = "lr2 AS (SELECT i, c, w, t = 2 AS na, (t = 1)::INT::DOUBLE AS val, false AS failed, NULL::DOUBLE AS agreement FROM lab WHERE c < 2)"
_RATES = "rt AS (SELECT k, c, count(*) FILTER (up) AS n FROM pr GROUP BY k, c)"
_register("cascade_sweep_kappa", partial(_curve, metric="mean_kappa"), _CAL + f"mk AS (SELECT k, avg(kappa) AS m FROM kk GROUP BY k) SELECT {_CURVE}, round(m, 6) AS metric FROM pt JOIN mk USING (k)")
_register("cascade_sweep_f1", partial(_curve, metric="criterion_f1"), _CAL + f"mk AS (SELECT k, f1 AS m FROM ov) SELECT {_CURVE}, round(m, 6) AS metric FROM pt JOIN mk USING (k)")
_register(
    "cascade_sweep_rmse", partial(_curve, metric=CL.SCORE_RMSE),
    _CAL + f"""{_LABEL_2}, oc AS (SELECT i, k, c, w, coalesce(CASE WHEN up THEN shown ELSE dp END, 2) = 2 AS na, coalesce((CASE WHEN up THEN shown ELSE dp END = 1)::INT, 0)::DOUBLE AS val, up AND lf AS failed, NULL::DOUBLE AS agreement FROM pr),
    sc AS (SELECT o.k, sqrt(avg((o.score - x.score) ^ 2)) AS m FROM {scored('oc', 'i, k')} o JOIN {scored('lr2', 'i')} x USING (i) WHERE o.score IS NOT NULL AND x.score IS NOT NULL GROUP BY o.k)
    SELECT {_CURVE}, round(-m, 6) AS metric FROM pt JOIN sc USING (k)""",
)
_register(
    "calibrated_thresholds", partial(_fitted, metric="mean_kappa"),
    _CAL + f"{_RATES}, g AS (SELECT a.k AS k0, b.k AS k1, (a.kappa + b.kappa) / 2 AS m FROM kk a, kk b WHERE a.c = 0 AND b.c = 1)" + _ASCENT,
)
_register(
    "calibrated_thresholds_rmse", partial(_fitted, metric=CL.SCORE_RMSE),
    _CAL + f"""{_RATES}, {_LABEL_2}, oc AS (SELECT i, k, c, w, coalesce(CASE WHEN up THEN shown ELSE dp END, 2) = 2 AS na, coalesce((CASE WHEN up THEN shown ELSE dp END = 1)::INT, 0)::DOUBLE AS val, up AND lf AS failed, NULL::DOUBLE AS agreement
      FROM pr WHERE i IN (SELECT i FROM lab)),
    gr AS (SELECT o.*, o.k AS k0, b.k AS k1 FROM oc o, th b WHERE c = 0 UNION ALL SELECT o.*, a.k AS k0, o.k AS k1 FROM oc o, th a WHERE c = 1),
    g AS (SELECT k0, k1, -sqrt(avg((o.score - x.score) ^ 2)) AS m FROM {scored('gr', 'i, k0, k1')} o JOIN {scored('lr2', 'i')} x USING (i) WHERE o.score IS NOT NULL AND x.score IS NOT NULL GROUP BY k0, k1)""" + _ASCENT,
)

# --- several rubrics ------------------------------------------------------------------------------

#: Of rubric "b": the fixture's criterion that stands at each place, and its weight there.
_PLACES = ((1, -4.0), (2, 5.0), (3, 1.0))


def _mixed(spark, d):
    """Criteria of two rubrics, and the frame -> frame that puts cells under the rubric of their item: German and
    French documents have "b", the others "a", the fixture's first two criteria."""
    own = fx.criteria(spark)
    at = F.create_map(*[x for k, (c, _) in enumerate(_PLACES) for x in (F.lit(c), F.lit(k))])
    weight = F.create_map(*[x for c, w in _PLACES for x in (F.lit(c), F.lit(w))])
    b = own.where("criterion_idx > 0").withColumns({"rubric_id": F.lit("b"), "weight": weight[F.col("criterion_idx")], "criterion_idx": at[F.col("criterion_idx")]})
    criteria = own.where("criterion_idx < 2").withColumn("rubric_id", F.lit("a")).unionByName(b)
    rubric = F.when(F.col("lang").isin("de", "fr"), "b").otherwise("a").alias("rubric_id")
    items = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("item_idx"), rubric)

    def placed(frame):
        cells = frame.join(items, "item_idx").where(F.when(F.col("rubric_id") == "a", F.col("criterion_idx") < 2).otherwise(F.col("criterion_idx") > 0))
        return cells.withColumn("criterion_idx", F.when(F.col("rubric_id") == "a", F.col("criterion_idx")).otherwise(at[F.col("criterion_idx")]))

    return criteria, placed


def _mixed_scores(spark, d):
    criteria, placed = _mixed(spark, d)
    reports = V.aggregate_votes(placed(fx.votes(spark, d)), criteria)
    known = K.resolved_labels(placed(fx.labels(spark, d)), criteria)
    true = S.label_scores(known, criteria).select("item_idx", _r("score")).withColumnRenamed("score", "expected")
    n = reports.groupBy("item_idx", "rubric_id").agg(F.count("*").alias("n_criteria"))
    return S.item_reports(reports).select("item_idx", _r("score")).join(n, "item_idx").join(true, "item_idx", "left")


def _mixed_pooled(spark, d):
    criteria, placed = _mixed(spark, d)
    frame = K.cells(V.aggregate_votes(placed(fx.votes(spark, d)), criteria), placed(fx.labels(spark, d)), criteria)
    out = PL.pooled(frame).where(F.lit(PL.heterogeneous(criteria, frame)))
    return out.select("of", "n", "n_abstain", *map(_r, ("accuracy", "rmse", "mae")))


_MIXED = REPORTS + """, r2 AS (SELECT doc_id AS i, CASE WHEN lang IN ('de', 'fr') THEN 'b' ELSE 'a' END AS rb FROM documents),
mix AS (SELECT f.i, f.c, rb, CASE WHEN rb = 'a' THEN f.w ELSE CASE f.c WHEN 1 THEN -4.0 WHEN 2 THEN 5.0 ELSE 1.0 END END::DOUBLE AS w, na, val, pick, failed, NULL::DOUBLE AS agreement, oval
        FROM full_rep f JOIN r2 USING (i) WHERE CASE WHEN rb = 'a' THEN f.c < 2 ELSE f.c > 0 END),
lmix AS (SELECT lab.i, lab.c, rb, lab.t, CASE WHEN rb = 'a' THEN lab.w ELSE CASE lab.c WHEN 1 THEN -4.0 WHEN 2 THEN 5.0 ELSE 1.0 END END::DOUBLE AS w, CASE WHEN lab.c < 2 THEN lab.t = 2 ELSE opt.na END AS na,
         CASE WHEN lab.c < 2 THEN (lab.t = 1)::INT::DOUBLE ELSE opt.val END AS val, false AS failed, NULL::DOUBLE AS agreement FROM lab JOIN r2 USING (i) LEFT JOIN opt ON opt.c = lab.c AND opt.idx = lab.t
         WHERE CASE WHEN rb = 'a' THEN lab.c < 2 ELSE lab.c > 0 END)
"""
_register(
    "dataset_mixed_rubrics", _mixed_scores,
    _MIXED + f"""SELECT q.i AS item_idx, round(q.score, 6) AS score, n.rb AS rubric_id, n.n AS n_criteria, round(x.score, 6) AS expected FROM {scored('mix', 'i')} q
    JOIN (SELECT i, rb, count(*) AS n FROM mix GROUP BY i, rb) n USING (i) LEFT JOIN {scored('lmix', 'i')} x USING (i)""",
)
_register(
    "pooled_mixed_rubrics", _mixed_pooled,
    _MIXED + """, pt AS (SELECT CASE WHEN m.c < 2 THEN 'binary' WHEN m.c = 2 THEN 'ordinal' ELSE 'nominal' END AS sc, m.na AS ab, CASE WHEN m.c < 2 THEN (l.t = 1)::INT::DOUBLE ELSE l.val END AS x, m.val AS y, m.pick = l.t AS exact
      FROM mix m JOIN lmix l USING (i, c) WHERE NOT m.failed), lv AS (SELECT sc AS of, ab, x, y, exact FROM pt UNION ALL SELECT 'all', ab, x, y, exact FROM pt)
    SELECT of, count(*) FILTER (NOT ab) AS n, count(*) FILTER (ab) AS n_abstain, round(avg(exact::INT) FILTER (NOT ab), 6) AS accuracy, round(sqrt(avg((x - y) ^ 2) FILTER (NOT ab)), 6) AS rmse, round(avg(abs(x - y)) FILTER (NOT ab), 6) AS mae
    FROM lv GROUP BY of""",
)


def _mixed_requests(spark, d):
    criteria, _ = _mixed(spark, d)
    rubric = F.when(F.col("lang").isin("de", "fr"), "b").otherwise("a").alias("rubric_id")
    items = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("item_idx"), rubric, F.md5(F.coalesce("text", F.lit(""))).alias("submission"))
    return DM.requests(items, criteria.select("rubric_id", "criterion_idx", "requirement", "scale", "options"))


_register(
    "decision_requests_mixed_rubrics", _mixed_requests,
    """SELECT doc_id AS item_idx, CASE WHEN lang IN ('de', 'fr') THEN 'b' ELSE 'a' END AS rubric_id, '{"submission":"' || md5(coalesce(text, '')) || '"}' AS state,
    CASE WHEN lang IN ('de', 'fr') THEN '[{"criterion_idx":0,"kind":"noul","requirement":"The text insults."},{"criterion_idx":1,"kind":"score","requirement":"How long is the text?","outcomes":["0","1","2"]},{"criterion_idx":2,"kind":"choice","requirement":"Which language is it?","outcomes":["de","en","es","fr"]}]'
    ELSE '[{"criterion_idx":0,"kind":"noul","requirement":"The text is well formed."},{"criterion_idx":1,"kind":"noul","requirement":"The text insults."}]' END AS questions FROM documents""",
)

# --- sampling, diagnostics, runs ------------------------------------------------------------------

_register(
    "diagnostic_topk", lambda s, d: T.diagnostic_items(_pairs(s, d).select("item_idx", F.round(F.col("pred") - F.col("true"), 6).alias("gap"))).select("item_idx", "gap", "side", F.col("rank").cast("long").alias("rank")),
    _PAIRS + ", gp AS (SELECT i, round(x - y, 6) AS gap FROM pairs) SELECT i AS item_idx, gap, side, rank FROM (SELECT *, CASE WHEN gap > 0 THEN 'over' ELSE 'under' END AS side, row_number() OVER (PARTITION BY gap > 0 ORDER BY abs(gap) DESC, i) AS rank FROM gp WHERE gap <> 0) WHERE rank <= 3",
)
_register(
    "issues", lambda s, d: T.issues(_reports(s, d)).select("item_idx", "criterion_idx", "final_verdict"),
    REPORTS + f"SELECT i AS item_idx, c AS criterion_idx, {VERDICT.format('pick')} AS final_verdict FROM rep WHERE c < 2 AND (w > 0 AND pick = 0 OR w < 0 AND pick = 1)",
)
_register(
    "issue_diff", lambda s, d: T.issue_diff(T.issues(_reports(s, d)), T.issues(_reports(s, d, binary="weighted")), ["item_idx", "criterion_idx"]),
    REPORTS + """, a AS (SELECT i, c FROM rep WHERE c < 2 AND (w > 0 AND pick = 0 OR w < 0 AND pick = 1)), wb AS (SELECT i, c, w, CASE WHEN m + u = 0 THEN 2 WHEN mw > uw THEN 1 WHEN uw > mw THEN 0 ELSE (w < 0)::INT END AS pick FROM bin),
    b AS (SELECT i, c FROM wb WHERE w > 0 AND pick = 0 OR w < 0 AND pick = 1)
    SELECT i AS item_idx, c AS criterion_idx, 'fixed' AS change FROM a ANTI JOIN b USING (i, c) UNION ALL SELECT i, c, 'introduced' FROM b ANTI JOIN a USING (i, c)""",
)


def _hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({' || '.join(parts)}), 1, 8))::BIGINT"


_register(
    "train_test_split", lambda s, d: T.train_test(fx.labels(s, d).select("item_idx").distinct(), 50, seed=7),
    SQL + f"SELECT i AS item_idx, CASE WHEN row_number() OVER (ORDER BY {_hash_sql(chr(39) + '7:' + chr(39), 'i')}, i) <= 50 THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT i FROM lab)",
)
_register(
    "few_shot_balanced", lambda s, d: T.balanced_examples(fx.labels(s, d), 5, seed=1).select("criterion_idx", "item_idx", "class", F.col("pick").cast("long").alias("pick")),
    SQL + f""", o AS (SELECT c, i, CASE WHEN c < 2 THEN {VERDICT.format('t')} ELSE t::VARCHAR END AS class, {_hash_sql(chr(39) + '1:' + chr(39), 'c', chr(39) + ':' + chr(39), 'i')} AS h FROM lab),
    r AS (SELECT *, row_number() OVER (PARTITION BY c, class ORDER BY h, i) AS rn FROM o), g AS (SELECT c, class, row_number() OVER (PARTITION BY c ORDER BY class) AS g, count(*) OVER (PARTITION BY c) AS k FROM (SELECT DISTINCT c, class FROM o)),
    q AS (SELECT r.*, 5 // k + (g <= 5 % k)::INT AS quota FROM r JOIN g USING (c, class))
    SELECT c AS criterion_idx, i AS item_idx, class, pick FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY (rn > quota)::INT, h, i) AS pick FROM q) WHERE pick <= 5""",
)
_register(
    "resume_pending", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("item_idx")).join(s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("item_idx")), "item_idx", "left_anti"),
    "SELECT doc_id AS item_idx FROM documents ANTI JOIN labels USING (doc_id)",
)
_register(
    "timing_stats", lambda s, d: T.timing(s.read.parquet(f"{d}/events.parquet"), "value").select("n", _r("mean"), _r("min"), _r("max"), _r("p50"), _r("p95")),
    """WITH e AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
    SELECT count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(min(v) FILTER (k = n // 2), 6) AS p50, round(min(v) FILTER (k = least(floor(n * 0.95), n - 1)), 6) AS p95 FROM e""",
)


# --- beyond SQL: distribution functions, Python judges, streams and loops -------------------------


def _p_values(spark, d):
    r = R.with_p(R.spearman(_pairs(spark, d), ["g"], "pred", "true"), "spearman").select("g", "n", "spearman", "p_value", "band")
    return r.join(D.with_test(D.bias(_pairs(spark, d), ["g"])).select("g", "t", F.col("p_value").alias("bias_p"), "low", "high", F.col("band").alias("effect_band")), "g")


def _answer(prompt: str) -> dict:
    """A stand-in for a remote judge: it fails on some prompts and is sure of the rest."""
    if prompt.endswith("7"):
        raise TimeoutError("no answer")
    return {"verdict": MET if len(prompt) % 2 else "UNMET", "confidence": 0.9}


def _remote(spark, d):
    from .sources.judges import RemoteJudge

    cells_ = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("item_idx"), F.lit(0).alias("criterion_idx"), F.concat(F.lit("judge "), F.col("doc_id").cast("string")).alias("prompt"))
    return RemoteJudge("remote", _answer, F.col("prompt"), attempts=2, pause=0.0).vote(cells_)


def _improve(spark, d):
    from .plans.improve import improve
    from .plans.runner import Grader
    from .rubric import Criterion, Rubric
    from .sources.judges import NoisyJudge, RuleJudge

    items = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("item_idx"), "quality")
    truth = items.select("item_idx", F.lit(0).alias("criterion_idx"), F.when(F.col("quality") == 1, MET).otherwise("UNMET").alias("verdict"), F.lit(None).cast("int").alias("option_idx"))
    rule = RuleJudge("rule", F.when(F.col("quality") == 1, MET).otherwise("UNMET"))
    grader = lambda r: Grader([(NoisyJudge(rule, "noisy", 0.3 / (1 + len(r.guidelines or "")), 0.0), 1.0)])
    steps = improve(Rubric((Criterion("well formed", name="quality"),)), items, truth, grader, lambda r, wrong: Rubric(r.criteria, (r.guidelines or "") + "x"), iterations=3)
    return spark.createDataFrame([(s.iteration, s.scores["accuracy"], s.scores["kappa"], s.accepted) for s in steps], "iteration int, accuracy double, kappa double, accepted boolean")


_register("p_values", _p_values)
_register(
    "remote_judge_fake", _remote,
    """SELECT doc_id AS item_idx, 0 AS criterion_idx, 'remote' AS judge_id, CASE WHEN doc_id % 10 <> 7 THEN CASE WHEN (6 + length(doc_id::VARCHAR)) % 2 = 1 THEN 'MET' ELSE 'UNMET' END END AS verdict, NULL::INT AS option_idx,
      CASE WHEN doc_id % 10 = 7 THEN 'infrastructure: no answer' END AS error, NULL::VARCHAR AS reason, CASE WHEN doc_id % 10 <> 7 THEN 0.9::DOUBLE END AS confidence FROM documents""",
)
_register("improve_loop", _improve)

_SHOWN = """WITH o AS (SELECT doc_id, idx, label, row_number() OVER (PARTITION BY doc_id ORDER BY md5('3:' || doc_id || ':2:ja:' || idx)) AS place
  FROM documents, (VALUES (0, 'short'), (1, 'medium'), (2, 'long'), (3, 'Cannot assess / not applicable')) x(idx, label))
"""
_register(
    "prompts",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").join(F.broadcast(fx.criteria(s).where("criterion_idx = 2")), F.lit(True)).select(
        "doc_id", F.sha2(P.choice_prompt(F.col("requirement"), P.presented(F.col("options"), P.shuffled_order(3, F.col("doc_id"), F.col("criterion_idx"), F.lit("ja"), F.col("options"))), F.col("text"), F.lit("Judge it."), F.lit(None).cast("string"), F.lit(None).cast("string")), 256).alias("prompt_sha256")
    ),
    _SHOWN + r"""SELECT doc_id, sha256('<task>' || chr(10) || 'Judge it.' || chr(10) || '</task>' || chr(10) || chr(10) ||
      CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN '<submission>' || chr(10) || text || chr(10) || '</submission>' || chr(10) || chr(10) ELSE '' END
      || 'Question: How long is the text?' || chr(10) || 'Options:' || chr(10) || opts || chr(10) || 'Answer with the number of one option.') AS prompt_sha256
    FROM documents JOIN (SELECT doc_id, string_agg(place || '. ' || label, chr(10) ORDER BY place) AS opts FROM o GROUP BY doc_id) USING (doc_id)""",
)
_register(
    "shown_options",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id").join(F.broadcast(fx.criteria(s).where("criterion_idx = 2")), F.lit(True)).select(
        "doc_id", P.shuffled_order(3, F.col("doc_id"), F.col("criterion_idx"), F.lit("ja"), F.col("options")).alias("order")
    ).select("doc_id", "order", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("answer")).select("doc_id", "answer", P.original_index(F.col("order"), F.col("answer")).alias("option_idx")),
    _SHOWN + "SELECT doc_id, place::INT AS answer, idx::INT AS option_idx FROM o",
)

# --- usage, decision models, single calls, documents ----------------------------------------------


def _calls(spark, d):
    unknown = F.pmod("doc_id", F.lit(3)) == 0
    return spark.read.parquet(f"{d}/documents.parquet").select(
        "lang", *[F.when(~unknown & (F.col("lang") != "es"), (F.col("n_chars") * k).cast("long")).alias(c) for k, c in ((1, "prompt_tokens"), (2, "completion_tokens"), (3, "total_tokens"))],
        F.when(F.col("lang") == "de", 0.0).when(F.col("lang") == "en", F.col("n_chars") / 4.0).alias("completion_cost"),
    )


_register(
    "usage_sums", lambda s, d: U.usage_sums(_calls(s, d), ["lang"]).select("lang", "prompt_tokens", "completion_tokens", "total_tokens", _r("completion_cost")),
    """WITH c AS (SELECT lang, CASE WHEN doc_id % 3 <> 0 AND lang <> 'es' THEN n_chars END AS n, CASE lang WHEN 'de' THEN 0.0 WHEN 'en' THEN n_chars / 4.0 END AS cost FROM documents)
    SELECT lang, sum(n)::BIGINT AS prompt_tokens, sum(2 * n)::BIGINT AS completion_tokens, sum(3 * n)::BIGINT AS total_tokens, round(nullif(sum(cost), 0), 6)::DOUBLE AS completion_cost FROM c GROUP BY lang""",
)


def _costs(spark, d, per_item):
    dm, _, _ = _runs(spark, d)
    cells = dm.select("item_idx", "criterion_idx", F.struct("error", "na", "confidence").alias("dm"))
    i = F.col("item_idx")
    runs = dm.select("item_idx").distinct().select(
        "item_idx", F.when(F.pmod(i, F.lit(5)) > 0, F.pmod(i, F.lit(7)) / 8.0).alias("dm_cost"), F.lit(0.5).alias("dm_seconds"),
        F.when(F.pmod(i, F.lit(4)) > 0, F.pmod(i, F.lit(11)) / 4.0).alias("llm_cost"), F.lit(4.0).alias("llm_seconds"),
    )
    return U.replayed_costs(cells, runs, F.lit(0.5), per_item).select("item_idx", "n_escalated", _r("share"), _r("cost"), _r("seconds"))


for _how, _share in {"criterion": "u / n::DOUBLE", "item": "least(u, 1)::DOUBLE"}.items():
    _register(
        f"cascade_costs_per_{_how}", partial(_costs, per_item=_how == "item"),
        _DM + f""", e AS (SELECT i, count(*) AS n, sum((na OR conf IS NULL OR conf < 0.5)::INT)::BIGINT AS u FROM dm GROUP BY i),
        s AS (SELECT i, u, {_share} AS share, CASE WHEN i % 5 > 0 THEN (i % 7) / 8.0 END AS a, CASE WHEN i % 4 > 0 THEN (i % 11) / 4.0 END AS b FROM e),
        t AS (SELECT *, coalesce(a, 0) + coalesce(b * share, 0) AS cost FROM s)
        SELECT i AS item_idx, u AS n_escalated, round(share, 6) AS share, CASE WHEN cost > 0 THEN round(cost, 6) END::DOUBLE AS cost, round(0.5 + 4 * share, 6)::DOUBLE AS seconds FROM t""",
    )


def _answers(spark, d):
    """Answers of a decision model made up from a hash: some missing, of a wrong kind or without a label."""
    h = F.pmod(hash32(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("answer"))), F.lit(1000)).cast("int")
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("item_idx"), h.alias("h"))
    weigh = lambda keys, values: F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*map(F.lit, values)))
    null = lambda t: F.lit(None).cast(t)
    one = lambda c, kind, noul=null("double"), choice=null("string"), score=null("double"), p=null("map<string,double>"): F.struct(
        F.lit(c).alias("criterion_idx"), F.lit(kind).alias("type"), noul.cast("double").alias("noul"), choice.alias("choice"), score.cast("double").alias("score"), p.alias("probabilities"))
    p = F.pmod("h", F.lit(101)) / 100
    met = one(0, "noul", p)
    toxic = F.when(F.pmod("h", F.lit(10)) > 0, one(1, "noul", F.when(F.pmod("h", F.lit(17)) == 0, 1.5).otherwise(F.pmod("h", F.lit(5)) / 4)))
    length = one(2, "score", score=F.pmod("h", F.lit(40)) / 10 - 0.5, p=F.when(F.pmod("h", F.lit(11)) == 0, weigh("01", (0.5, 0.5))).otherwise(weigh("012", (0.2, 0.3, 0.5))))
    tongue = one(3, "choice", choice=F.element_at(F.array(*map(F.lit, (*fx.LANGUAGES, "xx"))), F.pmod("h", F.lit(5)) + 1), p=weigh(fx.LANGUAGES, (0.1, 0.2, 0.3, 0.4)))
    return docs.select("item_idx", F.array_compact(F.array(met, toxic, length, tongue)).alias("answers"))


_register(
    "decision_answers",
    lambda s, d: DM.answer_votes(_answers(s, d), fx.criteria(s)).select("item_idx", "criterion_idx", "verdict", "option_idx", _r("confidence"), "error", F.round(F.try_element_at("probabilities", F.lit("1")), 6).alias("p1")),
    """WITH d AS (SELECT doc_id AS i, ('0x' || substr(md5(doc_id::VARCHAR || ':answer'), 1, 8))::BIGINT % 1000 AS h FROM documents),
    a AS (SELECT i, h, (h % 101) / 100.0::DOUBLE AS p, (h % 5) / 4.0::DOUBLE AS q, (h % 40) / 10.0 - 0.5 AS s FROM d),
    lv AS (SELECT *, greatest(0, least(2, round_even(s, 0)))::INT AS l FROM a)
    SELECT i AS item_idx, 0 AS criterion_idx, CASE WHEN p > 0.5 THEN 'MET' ELSE 'UNMET' END AS verdict, NULL::INT AS option_idx, round(2 * greatest(p, 1 - p) - 1, 6) AS confidence, NULL AS error, NULL::DOUBLE AS p1 FROM a
    UNION ALL SELECT i, 1, CASE WHEN h % 10 > 0 AND h % 17 > 0 THEN CASE WHEN q >= 0.5 THEN 'MET' ELSE 'UNMET' END END, NULL, CASE WHEN h % 10 > 0 AND h % 17 > 0 THEN round(2 * greatest(q, 1 - q) - 1, 6) END,
      CASE WHEN h % 10 = 0 THEN 'parse: no answer' WHEN h % 17 = 0 THEN 'parse: its probability is not from 0 to 1' END, NULL FROM a
    UNION ALL SELECT i, 2, NULL, CASE WHEN h % 11 > 0 THEN l END, CASE WHEN h % 11 > 0 THEN round(greatest(0.0, (3 * [0.2, 0.3, 0.5][l + 1] - 1) / 2), 6) END,
      CASE WHEN h % 11 = 0 THEN 'parse: its probabilities do not cover what was offered' END, CASE WHEN h % 11 > 0 THEN 0.3 END FROM lv
    UNION ALL SELECT i, 3, NULL, CASE WHEN h % 5 < 4 THEN h % 5 END::INT, CASE WHEN h % 5 < 4 THEN round(greatest(0.0, (4 * [0.1, 0.2, 0.3, 0.4][h % 5 + 1] - 1) / 3), 6) END,
      CASE WHEN h % 5 = 4 THEN 'parse: its choice was not offered' END, CASE WHEN h % 5 < 4 THEN 0.2 END FROM a""",
)
_register(
    "decision_requests",
    lambda s, d: DM.requests(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("item_idx"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("submission"), F.lit(" ").alias("guidelines"), F.col("lang").alias("prompt")), fx.criteria(s).where("criterion_idx < 1")),
    """SELECT doc_id AS item_idx, '{"input":"' || lang || '","submission":"' || md5(coalesce(text, '')) || '"}' AS state, '[{"criterion_idx":0,"kind":"noul","requirement":"The text is well formed."}]' AS questions FROM documents""",
)


def _replies(spark, d):
    """Replies to one call about a whole rubric, some unusable in whole or in part."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("item_idx"), F.col("doc_id").alias("i"))
    entry = lambda c, **f: F.struct(F.lit(c).alias("criterion_id"), *[v.alias(k) for k, v in f.items()])
    text = lambda x: F.to_json(x)
    first = text(entry("c1", criterion_status=F.when(F.pmod("i", F.lit(2)) == 0, MET).otherwise("UNMET"), explanation=F.lit("so"), affects=F.array(F.lit(2))))
    second = F.when(F.pmod("i", F.lit(3)) > 0, text(entry("c2", criterion_status=F.lit("MAYBE"))))
    third = text(entry("c3", selected_option=(F.pmod("i", F.lit(6))).cast("int")))
    again = F.when(F.pmod("i", F.lit(5)) == 0, first)
    whole = F.concat(F.lit('{"judgments": ['), F.array_join(F.array_compact(F.array(first, second, third, again)), ", "), F.lit("]}"))
    return docs.select("item_idx", F.when(F.pmod("i", F.lit(7)) == 0, "sorry").otherwise(whole).alias("reply"))


_register(
    "single_call_votes", lambda s, d: SC.reply_votes(_replies(s, d), fx.criteria(s)).select("item_idx", "criterion_idx", "verdict", "option_idx", "reason", "error"),
    """WITH d AS (SELECT doc_id AS i, doc_id % 7 = 0 AS bad FROM documents)
    SELECT i AS item_idx, 0 AS criterion_idx, CASE WHEN NOT bad AND i % 5 > 0 THEN CASE WHEN i % 2 = 0 THEN 'MET' ELSE 'UNMET' END END AS verdict, NULL::INT AS option_idx,
      CASE WHEN NOT bad AND i % 5 > 0 THEN '[Affects: #2] so' END AS reason, CASE WHEN bad THEN 'parse: the reply is no list of judgments' WHEN i % 5 = 0 THEN 'parse: several judgments with its id' END AS error FROM d
    UNION ALL SELECT i, 1, NULL, NULL, NULL, CASE WHEN bad THEN 'parse: the reply is no list of judgments' WHEN i % 3 = 0 THEN 'parse: no judgment with its id' ELSE 'parse: it needs a criterion_status' END FROM d
    UNION ALL SELECT i, 2, NULL, CASE WHEN NOT bad AND i % 6 BETWEEN 1 AND 4 THEN i % 6 - 1 END::INT, NULL, CASE WHEN bad THEN 'parse: the reply is no list of judgments' WHEN i % 6 NOT BETWEEN 1 AND 4 THEN 'parse: it needs a selected_option that was shown' END FROM d
    UNION ALL SELECT i, 3, NULL, NULL, NULL, CASE WHEN bad THEN 'parse: the reply is no list of judgments' ELSE 'parse: no judgment with its id' END FROM d""",
)


def _documents_of_parts(spark, d):
    part = lambda t, i: F.struct(t.cast("string").alias("text"), i.cast("string").alias("image"))
    no = F.lit(None)
    image = F.when(F.pmod("doc_id", F.lit(3)) > 0, part(no, F.concat(F.lit("a/b/"), F.col("doc_id").cast("string"), F.lit(".png"))))
    raw = F.array_compact(F.array(part(F.lit(""), no), part(F.substring("text", 1, 5), no), part(F.expr("substring(text, 6)"), no), image, part(F.lit(""), no), part(F.col("lang"), no)))
    return spark.read.parquet(f"{d}/documents.parquet").withColumn("parts", CT.normalized_parts(raw))


_register(
    "document_parts",
    lambda s, d: _documents_of_parts(s, d).select("doc_id", F.size("parts").alias("n_parts"), CT.is_document(F.col("parts")).alias("has_image"), F.sha2(CT.content_text(F.col("parts")), 256).alias("text_sha256"), F.sha2(CT.content_preview(F.col("parts")), 256).alias("preview_sha256"), F.array_join(CT.images_of(F.col("parts")), "|").alias("images")),
    """WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS head, doc_id % 3 > 0 AS img FROM documents)
    SELECT doc_id, (CASE WHEN img THEN 1 + (head <> '')::INT + 1 ELSE 1 END)::INT AS n_parts, img AS has_image, sha256(head || CASE WHEN img THEN chr(10) ELSE '' END || lang) AS text_sha256,
      sha256(head || CASE WHEN img THEN '[image: ' || doc_id || '.png]' ELSE '' END || lang) AS preview_sha256, CASE WHEN img THEN 'a/b/' || doc_id || '.png' ELSE '' END AS images FROM d""",
)

def _content_identity(spark, d):
    """Documents of whole texts and an image, of which every ten have one that is equal but for its path."""
    docs = _documents_of_parts(spark, d).select("doc_id", "parts")
    files = docs.select(F.explode(CT.images_of(F.col("parts"))).alias("path"), F.sha2(F.pmod("doc_id", F.lit(10)).cast("string"), 256).alias("digest"))
    return CT.content_identities(docs, files, ["doc_id"]).select("doc_id", "identity")


_register(
    "content_identity", _content_identity,
    """WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS head, doc_id % 3 > 0 AS img FROM documents)
    SELECT doc_id, sha256(CASE WHEN img THEN CASE WHEN head <> '' THEN 't' || strlen(head) || ':' || head ELSE '' END || 'i' || sha256((doc_id % 10)::VARCHAR) || 't' || strlen(lang) || ':' || lang ELSE 't' || strlen(head || lang) || ':' || head || lang END) AS identity FROM d""",
)

# --- more metrics ---------------------------------------------------------------------------------

_register(
    "abstention_kappa", lambda s, d: A.abstention_agreement(_cells(s, d), ["scale"]).select("scale", "count_true", "count_pred", "false_positive", "false_negative", _r("kappa"), "band"),
    _CELLS + f""", k AS (SELECT scale, coalesce({_NA.format('t')}, false)::INT AS t, coalesce({_NA.format('p')}, false)::INT AS p FROM cel WHERE NOT failed),
    q AS (SELECT scale, sum(t)::BIGINT AS count_true, sum(p)::BIGINT AS count_pred, sum(p * (1 - t))::BIGINT AS false_positive, sum(t * (1 - p))::BIGINT AS false_negative, CASE WHEN max(greatest(t, p)) > min(least(t, p)) THEN true END AS two FROM k GROUP BY scale)
    SELECT q.scale, count_true, count_pred, false_positive, false_negative, CASE WHEN two THEN round(kappa, 6) END AS kappa, CASE WHEN NOT two OR kappa IS NULL THEN NULL WHEN kappa >= 0.81 THEN 'almost perfect' WHEN kappa >= 0.61 THEN 'substantial'
      WHEN kappa >= 0.41 THEN 'moderate' WHEN kappa >= 0.21 THEN 'fair' WHEN kappa >= 0 THEN 'slight' ELSE 'poor' END AS band FROM q JOIN {_kappa_sql('k', 'scale')} USING (scale)""",
)


def _pooled_points(spark, d):
    out = PL.pooled(_cells(spark, d))
    return out.select(F.col("of").alias("scale"), "n", "n_abstain", *map(_r, ("accuracy", "rmse", "mae", "spearman", "pearson", "kappa", "phi", "precision", "recall", "f1")))


_register(
    "pooled_points", _pooled_points,
    _CELLS + f""", pt AS (SELECT cel.scale, na_p AS gone, CASE WHEN cel.c < 2 THEN (t = 1)::INT::DOUBLE ELSE coalesce(a.val, 0) END AS x, CASE WHEN cel.c < 2 THEN (p = 1)::INT::DOUBLE ELSE coalesce(b.val, 0) END AS y, (p = t)::INT AS hit
      FROM (SELECT *, coalesce({_NA.format('p')}, false) AS na_p FROM cel) cel LEFT JOIN opt a ON a.c = cel.c AND a.idx = t LEFT JOIN opt b ON b.c = cel.c AND b.idx = p WHERE NOT failed),
    al AS (SELECT * FROM pt UNION ALL SELECT 'all', gone, x, y, hit FROM pt), us AS (SELECT * FROM al WHERE NOT gone),
    rk AS (SELECT scale, corr(rx, ry) AS sp, corr(x, y) AS pe FROM (SELECT scale, x, y, rank() OVER (PARTITION BY scale ORDER BY x) + (count(*) OVER (PARTITION BY scale, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY scale ORDER BY y) + (count(*) OVER (PARTITION BY scale, y) - 1) / 2.0 AS ry FROM us) GROUP BY scale),
    bk AS (SELECT scale, x::INT AS t, y::INT AS p FROM us WHERE scale = 'binary'),
    bm AS (SELECT scale, tp, fp, fn, tn FROM (SELECT scale, {_PRF} FROM bk GROUP BY scale)),
    n AS (SELECT scale, sum((NOT gone)::INT)::BIGINT AS n, sum(gone::INT)::BIGINT AS n_abstain FROM al GROUP BY scale),
    m AS (SELECT scale, avg(hit)::DOUBLE AS acc, sqrt(avg((y - x) ^ 2)) AS rmse, avg(abs(y - x)) AS mae FROM us GROUP BY scale)
    SELECT scale, n, n_abstain, round(acc, 6) AS accuracy, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(sp, 6) AS spearman, round(pe, 6) AS pearson, round(kappa, 6) AS kappa,
      round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS phi,
      round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1
    FROM n LEFT JOIN m USING (scale) LEFT JOIN rk USING (scale) LEFT JOIN bm USING (scale) LEFT JOIN {_kappa_sql('bk', 'scale')} USING (scale)""",
)
_register(
    "binary_report_rates", lambda s, d: A.binary_rates(A.counts(K.classes(_cells(s, d)).where("scale = 'binary'"), ["criterion_idx"]), ["criterion_idx"], undefined="null").select("criterion_idx", "tp", "fp", "fn", "tn", _r("precision"), _r("recall"), _r("fpr"), _r("fnr")),
    _CELLS + f"""SELECT c AS criterion_idx, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr
    FROM (SELECT c, {_PRF} FROM {_class_sql('cel', 'exclude', 'exclude')} WHERE c < 2 GROUP BY c)""",
)
_register(
    "agreement_validity", lambda s, d: VD.agreement_validity(_reports(s, d), S.item_reports(_reports(s, d)), fx.criteria(s)).select("criterion", _r("agreement")),
    _WITH_AGREED + f""", it AS (SELECT * FROM {scored('rep_a', 'i')} WHERE NOT gone)
    SELECT NULL AS criterion, round(avg(agreed), 6) AS agreement FROM it UNION ALL
    SELECT ['quality', 'toxic', 'length_band', 'language'][c + 1], round(avg(agreement), 6) FROM rep_a WHERE i IN (SELECT i FROM it) GROUP BY c""",
)
_register(
    "ground_truth_validity", lambda s, d: VD.ground_truth_validity(_pairs(s, d).select("item_idx", F.col("pred").alias("score")), _pairs(s, d).select("item_idx", F.col("true").alias("score"))).select("n", _r("metric")),
    _PAIRS + "SELECT count(*) AS n, round(corr(rx, ry), 6) AS metric FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM pairs)",
)
_register(
    "held_out_validity", lambda s, d: VD.held_out_validity(_reports(s, d), fx.labels(s, d), fx.criteria(s))[0].where("scale = 'binary'").select("criterion_idx", "n_paired", "n_abstained", _r("coverage"), _r("abstention_rate"), "n", _r("accuracy"), _r("kappa"), _r("fpr"), _r("fnr")),
    _CELLS + f""", k AS (SELECT * FROM {_class_sql('cel', 'exclude', 'exclude')} WHERE c < 2), raw AS (SELECT c, count(*) AS n_paired, sum((NOT failed AND (coalesce({_NA.format('t')}, false) OR coalesce({_NA.format('p')}, false)))::INT)::BIGINT AS gone,
      sum((NOT failed AND NOT coalesce({_NA.format('t')}, false) AND NOT coalesce({_NA.format('p')}, false))::INT)::BIGINT AS used FROM cel WHERE c < 2 GROUP BY c)
    SELECT c AS criterion_idx, n_paired, gone AS n_abstained, round(used / n_paired::DOUBLE, 6) AS coverage, round(gone / n_paired::DOUBLE, 6) AS abstention_rate, n, round(acc, 6) AS accuracy, round(kappa, 6) AS kappa, fpr, fnr
    FROM raw JOIN (SELECT c, n, acc, {_RATES} FROM (SELECT c, count(*) AS n, avg((t = p)::INT)::DOUBLE AS acc, {_PRF} FROM k GROUP BY c)) USING (c) JOIN {_kappa_sql('k', 'c')} USING (c)""",
)
_register(
    "held_out_exemplars", lambda s, d: VD.held_out_validity(_reports(s, d), fx.labels(s, d), fx.criteria(s))[1].select("criterion_idx", "item_idx", F.col("pick").cast("long").alias("pick")),
    _CELLS + f"SELECT c AS criterion_idx, i AS item_idx, pick FROM (SELECT c, i, row_number() OVER (PARTITION BY c ORDER BY i) AS pick FROM {_class_sql('cel', 'exclude', 'exclude')} WHERE t <> p) WHERE pick <= 3",
)
_register(
    "item_sets", lambda s, d: K.item_sets(fx.labels(s, d).where("item_idx % 5 <> 0"), s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("item_idx")).where("item_idx % 7 <> 0")),
    "SELECT doc_id AS item_idx, CASE WHEN doc_id % 5 = 0 THEN 'items only' ELSE 'results only' END AS \"where\" FROM labels WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0)",
)
_register(
    "repeated_judges", lambda s, d: T.repeated_judges(fx.votes(s, d).unionByName(fx.votes(s, d).where("judge_id = 'jb' and item_idx % 3 = 0"))),
    SQL + "SELECT 'jb' AS judge_id, count(*) AS n_cells FROM v WHERE j = 'jb' AND i % 3 = 0",
)
_register(
    "unpaired_bias", lambda s, d: D.unpaired_bias(_pairs(s, d).where("g = 0").select(F.col("pred").alias("x")), _pairs(s, d).where("g = 1").select(F.col("pred").alias("x")), []).select("na", "nb", _r("mean_diff"), _r("std_error"), _r("t", 4), _r("df", 3), _r("effect", 5)),
    _PAIRS + """, s AS (SELECT count(*) FILTER (g = 0) AS na, count(*) FILTER (g = 1) AS nb, avg(x) FILTER (g = 0) AS ma, avg(x) FILTER (g = 1) AS mb, var_samp(x) FILTER (g = 0) AS va, var_samp(x) FILTER (g = 1) AS vb FROM pairs)
    SELECT na, nb, round(ma - mb, 6) AS mean_diff, round(sqrt(va / na + vb / nb), 6) AS std_error, round((ma - mb) / sqrt(va / na + vb / nb), 4) AS t,
      round((va / na + vb / nb) ^ 2 / ((va / na) ^ 2 / (na - 1) + (vb / nb) ^ 2 / (nb - 1)), 3) AS df, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 5) AS effect FROM s""",
)
_register(
    "bands", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", (F.pmod("event_id", F.lit(200)) / 100 - 1).alias("x")).select(
        "event_id", X.correlation_band(F.col("x")).alias("correlation"), X.kappa_band(F.col("x")).alias("kappa"), X.effect_band(F.col("x")).alias("effect"), X.emd_band(F.col("x")).alias("emd")),
    """SELECT event_id, CASE WHEN abs(x) >= 0.9 THEN 'very strong' WHEN abs(x) >= 0.7 THEN 'strong' WHEN abs(x) >= 0.5 THEN 'moderate' WHEN abs(x) >= 0.3 THEN 'weak' ELSE 'negligible' END AS correlation,
      CASE WHEN x >= 0.81 THEN 'almost perfect' WHEN x >= 0.61 THEN 'substantial' WHEN x >= 0.41 THEN 'moderate' WHEN x >= 0.21 THEN 'fair' WHEN x >= 0 THEN 'slight' ELSE 'poor' END AS kappa,
      CASE WHEN abs(x) >= 0.8 THEN 'large' WHEN abs(x) >= 0.5 THEN 'medium' WHEN abs(x) >= 0.2 THEN 'small' ELSE 'negligible' END AS effect,
      CASE WHEN x >= 0.2 THEN 'large' WHEN x >= 0.1 THEN 'moderate' WHEN x >= 0.05 THEN 'small' ELSE 'negligible' END AS emd FROM (SELECT event_id, (event_id % 200) / 100.0::DOUBLE - 1 AS x FROM events)""",
)


# --- runs -----------------------------------------------------------------------------------------


def _live_votes(spark, d):
    """Votes of a cheap judge on the first three criteria; of the third it sometimes picks the NA option, and is sure of it."""
    binary = fx.unsure_judge(spark, d).select("item_idx", "criterion_idx", F.when(F.col("error").isNull(), F.col("final_verdict")).alias("verdict"), F.lit(None).cast("int").alias("option_idx"), "error", "confidence")
    h = hash32(F.concat_ws(":", F.col("item_idx").cast("string"), F.lit("live")))
    na = F.pmod(h, F.lit(13)) == 0
    choice = fx.truth(spark, d).where("criterion_idx = 2").select(
        "item_idx", "criterion_idx", F.lit(None).cast("string").alias("verdict"), F.when(na, 3).otherwise(F.col("t")).cast("int").alias("option_idx"), F.lit(None).cast("string").alias("error"),
        F.when(na, 0.99).otherwise(F.pmod(h, F.lit(101)) / 100).alias("confidence"),
    )
    return binary.unionByName(choice).withColumns({"judge_id": F.lit("dm"), "reason": F.lit(None).cast("string")})


def _live_grader(spark, d):
    from .plans.runner import Grader
    from .sources.judges import RecordedJudge

    return Grader([(RecordedJudge("dm", _live_votes(spark, d)), 1.0)], escalation=[(RecordedJudge("ja", fx.votes(spark, d)), 1.0)], threshold=0.5, thresholds={"toxic": 0.8})


def _items(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("item_idx"))


_LIVE_SQL = _DM + f""", lv AS (SELECT i, c, na OR conf IS NULL OR conf < CASE c WHEN 0 THEN 0.5 ELSE 0.8 END AS up, p FROM dm
  UNION ALL SELECT i, c, h % 13 = 0 OR (h % 101) / 100.0::DOUBLE < 0.5, t FROM (SELECT i, c, t, {_hash_sql("i", "':live'")} AS h FROM tr WHERE c = 2)),
fin AS (SELECT lv.i, lv.c, up, CASE WHEN up THEN v.pick ELSE p END AS pick FROM lv JOIN v ON v.i = lv.i AND v.c = lv.c AND v.j = 'ja')
"""
_register(
    "cascade_live", lambda s, d: _live_grader(s, d).grade(_items(s, d), fx.criteria(s).where("criterion_idx < 3"))[1].select("item_idx", "criterion_idx", "final_verdict", "option_idx"),
    _LIVE_SQL + f"SELECT i AS item_idx, c AS criterion_idx, CASE WHEN c < 2 THEN {VERDICT.format('pick')} END AS final_verdict, CASE WHEN c = 2 THEN pick END AS option_idx FROM fin",
)


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or with a local master a temporary one."""
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/quorumlake-runs/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="quorumlake-runs-")


def _round_trip(spark, d):
    """Evaluated in two goes, written as JSON lines, read back, and counted by criterion and verdict."""
    from .plans.runner import evaluate
    from .sources import runs

    path, criteria, items = _folder(spark), fx.criteria(spark).where("criterion_idx < 3"), _items(spark, d)
    evaluate(items.where("item_idx % 2 = 0"), criteria, _live_grader(spark, d), path, "a")
    scores = evaluate(items, criteria, _live_grader(spark, d), path, "a")
    rows = runs.records(scores, runs.read(spark, path, "reports", "a"), runs.read(spark, path, "votes", "a"))
    runs.write_records(rows, f"{path}/lines", "a")
    back = runs.read_records(spark, f"{path}/lines", "a")
    votes = back["votes"].groupBy("item_idx", "criterion_idx").agg(F.count_if("superseded").alias("n_superseded"))
    return back["reports"].join(votes, ["item_idx", "criterion_idx"]).select("item_idx", "criterion_idx", "final_verdict", "option_idx", "n_votes", "n_superseded")


def _streamed(spark, d):
    """The default reports, of votes that arrive judge by judge, the first judge's twice."""
    from .streaming import votes as ST

    folder = _folder(spark)
    fx.votes(spark, d).write.parquet(f"{folder}/all")  # so that texts are read once, not for each judge
    own = spark.read.parquet(f"{folder}/all")
    for judge in ("ja", "jb", "ja", "jc"):
        own.where(F.col("judge_id") == judge).write.mode("append").parquet(f"{folder}/in")
    ST.aggregate_cells(ST.vote_stream(spark, f"{folder}/in", 4), fx.criteria(spark), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    got = ST.latest_reports(spark, f"{folder}/out")
    return got.select("item_idx", "criterion_idx", "final_verdict", F.when(F.col("scale") != "binary", F.col("option_idx")).alias("option_idx"), "n_votes")


_register(
    "streamed_votes", _streamed,
    REPORTS + f"SELECT i AS item_idx, c AS criterion_idx, CASE WHEN c < 2 THEN {VERDICT.format('pick')} END AS final_verdict, CASE WHEN c >= 2 THEN pick END AS option_idx, n::BIGINT AS n_votes FROM rep",
)


_SAID = ("[Affects: #1, #3] ", "see [AFFECTS: All] ", "[affects: #9] criterion 2: ", "its Length_Band and #4: ", "index 1, criteria 3: ", "is THE TEXT IS WELL FORMED? ", "it asks how long is the tex: ", "nothing ")


def _issue_matches(spark, d):
    """Feedback made of what documents say, whole, after a phrase that names criteria in one of several ways."""
    said = F.get(F.array(*map(F.lit, _SAID)), F.pmod("doc_id", F.lit(len(_SAID))).cast("int"))
    issues = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(said, F.coalesce("text", F.lit(""))).alias("feedback"))
    return IS.matched(issues, fx.criteria(spark)).select("doc_id", F.array_join(F.col("criteria").cast("array<string>"), ",").alias("criteria"))


_SAID_LIST = ", ".join(f"'{s}'" for s in _SAID)
_register(
    "issue_matches", _issue_matches,
    rf"""WITH cr AS (SELECT * FROM (VALUES (1, 'quality', 'the text is well formed.'), (2, 'toxic', 'the text insults.'), (3, 'length_band', 'how long is the text?'), (4, 'language', 'which language is it?')) x(k, name, req)),
    t AS (SELECT doc_id, lower([{_SAID_LIST}][doc_id % {len(_SAID)} + 1] || coalesce(text, '')) AS t FROM documents),
    g AS (SELECT *, trim(regexp_extract(t, '\[affects:\s*(.+?)\]', 1)) AS tag FROM t),
    tg AS (SELECT doc_id, t, CASE WHEN tag = 'all' THEN [1, 2, 3, 4] ELSE list_filter(list_transform(regexp_extract_all(tag, '#?(\d+)', 1), lambda x: try_cast(x AS INT)), lambda k: k BETWEEN 1 AND 4) END AS tagged FROM g),
    w AS (SELECT k, substr(req, s + 1, 20) AS win FROM (SELECT k, req, unnest(range(0, length(req) - 19, 10)) AS s FROM cr WHERE length(req) >= 20)),
    fit AS (SELECT doc_id, k FROM tg, cr WHERE contains(t, name) UNION SELECT doc_id, k FROM tg, w WHERE contains(t, win)
      UNION SELECT doc_id, k FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(t, '(?:criteri(?:on|a)\s+|#|index\s+)(\d+)', 1), lambda x: try_cast(x AS INT))) AS k FROM tg) WHERE k BETWEEN 1 AND 4),
    f AS (SELECT doc_id, list_sort(list(k)) AS ks FROM fit GROUP BY doc_id)
    SELECT doc_id, array_to_string(CASE WHEN len(tagged) > 0 THEN list_sort(list_distinct(tagged)) ELSE coalesce(ks, []) END, ',') AS criteria FROM tg LEFT JOIN f USING (doc_id)""",
)


def _after_stop(spark, d):
    """A run whose second attempt stopped between votes and commit, then finished: by cell, its votes and reports."""
    from .plans.runner import evaluate
    from .sources import runs

    path, criteria, items = _folder(spark), fx.criteria(spark).where("criterion_idx < 3"), _items(spark, d)
    grader = _live_grader(spark, d)
    evaluate(items.where("item_idx % 2 = 0"), criteria, grader, path, "a")
    own = grader.effective(criteria)
    lost = grader.votes(grader.cells(items.where("item_idx % 3 = 1"), criteria), own)
    runs.append(lost, path, "votes", "a", attempt="stopped")
    runs.append(grader.reports(lost, own), path, "reports", "a", attempt="stopped")
    scores = evaluate(items, criteria, grader, path, "a")
    votes, reports = runs.read(spark, path, "votes", "a"), runs.read(spark, path, "reports", "a")
    cast = votes.groupBy("item_idx", "criterion_idx").agg(F.count("*").alias("n_votes"), F.count_if("superseded").alias("n_superseded"))
    told = reports.groupBy("item_idx", "criterion_idx").agg(F.count("*").alias("n_reports"), F.max("final_verdict").alias("final_verdict"))
    per = scores.groupBy("item_idx").agg(F.count("*").alias("n_scores"))
    return cast.join(told, ["item_idx", "criterion_idx"], "full").join(per, "item_idx", "left")


_register(
    "run_after_stop", _after_stop,
    _LIVE_SQL + f"SELECT i AS item_idx, c AS criterion_idx, 1 + up::INT::BIGINT AS n_votes, up::INT::BIGINT AS n_superseded, 1::BIGINT AS n_reports, CASE WHEN c < 2 THEN {VERDICT.format('pick')} END AS final_verdict, 1::BIGINT AS n_scores FROM fin",
)
_register(
    "run_round_trip", _round_trip,
    _LIVE_SQL + f"SELECT i AS item_idx, c AS criterion_idx, CASE WHEN c < 2 THEN {VERDICT.format('pick')} END AS final_verdict, CASE WHEN c = 2 THEN pick END AS option_idx, 1::BIGINT AS n_votes, up::INT::BIGINT AS n_superseded FROM fin",
)


def _added_na(spark, d):
    """Options of choices under a grader that may add an NA option: only where a judged cell names it."""
    bare = fx.criteria(spark).withColumn("options", F.filter("options", lambda o: ~o["na"]))
    frame = K.cells(_reports(spark, d), fx.labels(spark, d), bare)
    return K.effective_criteria(bare, frame).select("criterion_idx", F.coalesce(F.size("options"), F.lit(0)).alias("n_options"))


_register(
    "effective_options", _added_na,
    _CELLS + """SELECT crit.c AS criterion_idx, (CASE WHEN crit.c < 2 THEN 0 ELSE crit.k + coalesce(needs, false)::INT END)::INT AS n_options
    FROM crit LEFT JOIN (SELECT c, bool_or(p IS NULL OR p >= k OR coalesce(t >= k, false)) AS needs FROM cel WHERE NOT failed AND c >= 2 GROUP BY c) USING (c)""",
)
_register(
    "thinking_round_trip", lambda s, d: _conversations(s, d).select("conv_id", "turn", F.sha2(X.tagged(X.thinking_section(F.col("text")), X.output_section(F.col("text"))), 256).alias("tagged"), X.has_sections(F.col("text")).alias("has"), X.blank_to_null(X.thinking_section(F.col("text"))).isNull().alias("blank")),
    _TURNS + r"""SELECT conv_id, turn, sha256(CASE WHEN thinking = '' THEN output ELSE '<thinking>' || thinking || '</thinking><output>' || output || '</output>' END) AS tagged, turn % 3 < 2 AS has, NOT regexp_matches(thinking, '\S') AS blank FROM sec""",
)
_register(
    "affected_criteria", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", X.affects(F.pmod("event_id", F.lit(9)), F.concat(F.lit("then "), X.affects(F.pmod("event_id", F.lit(4)), F.lit("end")))).alias("text")).select("event_id", F.array_join(X.affected(F.col("text")).cast("array<string>"), ",").alias("found")),
    "SELECT event_id, (event_id % 9) || ',' || (event_id % 4) AS found FROM events",
)
_STRATA = SQL + f""", sg AS (SELECT i, string_agg(CASE WHEN c < 2 THEN {VERDICT.format('t')} ELSE t::VARCHAR END, '|' ORDER BY c) AS signature FROM lab GROUP BY i),
    z AS (SELECT signature, count(*) AS n, row_number() OVER (ORDER BY signature) AS k FROM sg GROUP BY signature),
    q AS (WITH RECURSIVE f AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS signature, 0::BIGINT AS quota, (SELECT sum(n) FROM z)::BIGINT AS rest, 40::BIGINT AS train
      UNION ALL SELECT z.k, z.signature, greatest(0, least(z.n, round_even(z.n * f.train / f.rest::DOUBLE, 0)))::BIGINT, (f.rest - z.n)::BIGINT,
        (f.train - greatest(0, least(z.n, round_even(z.n * f.train / f.rest::DOUBLE, 0))))::BIGINT FROM f JOIN z ON z.k = f.k + 1) SELECT * FROM f WHERE k > 0)
    SELECT i AS item_idx, signature, CASE WHEN row_number() OVER (PARTITION BY signature ORDER BY {_hash_sql("'7:'", 'i')}, i) <= quota THEN 'train' ELSE 'test' END AS split FROM sg JOIN q USING (signature)"""


def _strata(s, d):
    return T.stratified_split(T.signatures(fx.labels(s, d)), 40, seed=7).select("item_idx", "signature", "split")


_register("stratified_split", _strata, _STRATA)
_register(
    "stratified_split_counts", lambda s, d: _strata(s, d).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("signature").alias("signatures")),
    f"SELECT split, count(*) AS n, count(DISTINCT signature) AS signatures FROM ({_STRATA}) st GROUP BY split",
)
