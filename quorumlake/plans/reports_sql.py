"""SQL of the default reports (majority, mean, mode) over the fixture, shared by the oracles."""

from __future__ import annotations

from .fixture import SQL

VERDICT = "CASE {0} WHEN 1 THEN 'MET' WHEN 0 THEN 'UNMET' ELSE 'CANNOT_ASSESS' END"

#: bin: counts of binary cells; ord: values of ordinal cells; nom: ranked options of nominal cells;
#: rep: the reports; pick as in the votes, na, val (score value), agg (before the snap), failed.
REPORTS = SQL + r""",
bin AS (SELECT i, c, any_value(w) AS w, count(*) AS n, sum((pick = 1)::INT) AS m, sum((pick = 0)::INT) AS u, sum(CASE pick WHEN 1 THEN jw ELSE 0 END) AS mw,
        sum(CASE pick WHEN 0 THEN jw ELSE 0 END) AS uw, bool_and(err IS NOT NULL) AS failed FROM v WHERE c < 2 GROUP BY i, c),
ordv AS (SELECT i, v.c, any_value(w) AS w, count(*) AS n, bool_and(err IS NOT NULL) AS failed, list(val ORDER BY o) FILTER (pick < 3) AS vals,
        avg(val) FILTER (pick < 3) AS mean, median(val) FILTER (pick < 3) AS med, sum(val * jw) FILTER (pick < 3) / sum(jw) FILTER (pick < 3) AS wmean,
        min(val) FILTER (pick < 3) AS low, max(val) FILTER (pick < 3) AS high FROM v JOIN opt ON opt.c = v.c AND idx = pick WHERE v.c = 2 GROUP BY i, v.c),
snap AS (SELECT i, x, idx FROM (SELECT i, x, idx, row_number() OVER (PARTITION BY i, x ORDER BY round(abs(val - x), 8), val) AS r
        FROM (SELECT DISTINCT i, unnest([mean, med, wmean]) AS x FROM ordv) q, opt WHERE opt.c = 2 AND NOT na AND x IS NOT NULL) z WHERE r = 1),
cnt AS (SELECT i, v.c, pick, count(*) AS n, sum(jw) AS nw, any_value(val) AS val FROM v JOIN opt ON opt.c = v.c AND idx = pick AND NOT na GROUP BY i, v.c, pick),
top AS (SELECT *, row_number() OVER (PARTITION BY i, c ORDER BY n DESC, val, pick) AS r, row_number() OVER (PARTITION BY i, c ORDER BY nw DESC, val, pick) AS rw,
        count(*) OVER (PARTITION BY i, c) AS kinds FROM cnt),
rep AS (SELECT i, c, w, 'binary' AS scale, n, (CASE WHEN m + u = 0 THEN 2 WHEN m > u THEN 1 WHEN u > m THEN 0 ELSE (w < 0)::INT END)::INT AS pick, NULL::DOUBLE AS agg, failed FROM bin
  UNION ALL SELECT o.i, c, w, 'ordinal', n, coalesce(s.idx, 3)::INT, coalesce(mean, 0.0), failed FROM ordv o LEFT JOIN snap s ON s.i = o.i AND s.x = o.mean
  UNION ALL SELECT q.i, 3, q.w, 'nominal', q.n, t.pick::INT, coalesce(t.val, 0.0), q.failed FROM (SELECT i, any_value(w) AS w, count(*) AS n, bool_and(err IS NOT NULL) AS failed FROM v WHERE c = 3 GROUP BY i) q
        LEFT JOIN top t ON t.i = q.i AND t.c = 3 AND r = 1),
full_rep AS (SELECT rep.*, opt.val AS oval, CASE WHEN rep.c < 2 THEN pick = 2 ELSE coalesce(opt.na, true) END AS na,
        CASE WHEN rep.c < 2 THEN (pick = 1)::INT::DOUBLE ELSE coalesce(opt.val, 0.0) END AS val FROM rep LEFT JOIN opt ON opt.c = rep.c AND opt.idx = rep.pick)
"""


def scored(source: str, by: str, strategy: str = "skip", normalize: bool = True) -> str:
    """A subquery: score of each ``by`` of ``source`` (w, c, na, val, failed)."""
    part = {"skip": "NULL", "zero": "0.0", "partial": "CASE WHEN w > 0 THEN 0.5 * w ELSE 0.0 END", "fail": "CASE WHEN c < 2 THEN least(w, 0.0) ELSE 0.0 END"}[strategy]
    score = "total" if not normalize else (
        "CASE WHEN pos > 0 THEN greatest(0.0, least(1.0, total / pos)) WHEN neg > 0 THEN greatest(0.0, least(1.0, 1.0 + total / neg)) ELSE 0.0 END"
    )
    return f"""(SELECT {by}, CASE WHEN gone OR cnt = 0 THEN NULL ELSE {score} END AS score, agreed, nas, gone FROM (
      SELECT {by}, sum(x) AS total, count(x) AS cnt, sum(CASE WHEN x IS NOT NULL AND w > 0 THEN w ELSE 0.0 END) AS pos,
             sum(CASE WHEN x IS NOT NULL AND w <= 0 THEN -w ELSE 0.0 END) AS neg, bool_and(failed) AS gone, avg(agreement) AS agreed, sum(na::INT) AS nas
      FROM (SELECT *, CASE WHEN na THEN {part} ELSE val * w END AS x FROM {source}) p GROUP BY {by}) q)"""
