"""Quality rules as weak supervision, in DataFrame operations only.

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the counts of vote
patterns estimates how often each rule votes so on good and on bad documents; the posterior
probability of good replaces a filter that asks every rule to pass. No labels tell the classes apart,
so the estimates start from, and are drawn towards, what one expects of such rules: most documents
are good, rules seldom vote bad on these, and an abstention says nothing. The weight of that
expectation is a share of the documents, so that a corpus of any size can overrule it alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored, utf8

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: What is expected: the share of good documents, and the chances of a bad and of a good vote on bad and on
#: good ones; and its weight, as a share of all documents.
GOOD = 0.9
EXPECTED = ((0.3, 0.002), (0.6, 0.9))
WEIGHT = 0.5
#: EM ends when no estimate moves by CLOSE, or after MOST rounds; the posterior from which a document is kept.
CLOSE, MOST = 1e-7, 500
KEEP = 0.5


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that rules look at, of every row; a null text has no words."""
    text = utf8(text_col)
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).withColumn("w", F.regexp_extract_all("t", F.lit(WORD), 0))
    n = F.size("w")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))

    def keyed(key: Callable[[Column], Column]) -> Column:
        """The windows with their keys, in order of these."""
        return F.sort_array(F.transform(starts, lambda i: F.struct(key(i).alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        """Of windows in order, those whose key another one has."""
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

    def differs(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & ~(
            (F.get("w", x["i"]) == F.get("w", y["i"])) & (F.get("w", x["i"] + 1) == F.get("w", y["i"] + 1)) & (F.get("w", x["i"] + 2) == F.get("w", y["i"] + 2))
        )

    three = [lambda i: F.get("w", i), lambda i: F.get("w", i + 1), lambda i: F.get("w", i + 2)]
    by_hash = read.withColumn("s", keyed(lambda i: F.xxhash64(*[word(i) for word in three]))).withColumn("again", repeated(F.col("s")))
    # where windows of one hash differ, which is next to never, that text's windows are compared as they are
    clash = F.size(F.filter("again", lambda x, k: (k > 0) & F.coalesce(differs(x, F.get("again", k - 1)), F.lit(False)))) > 0
    as_text = repeated(keyed(lambda i: F.concat_ws(" ", *[word(i) for word in three])))
    places = F.sort_array(F.when(clash, F.transform(as_text, lambda x: x["i"])).otherwise(F.transform("again", lambda x: x["i"])))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    held = by_hash.select("doc_id", "t", "w", places.alias("places"), lines.alias("lines"))
    # a window covers three words, less those that the next repeated one covers
    covered = F.aggregate(F.transform("places", lambda i, k: F.least(F.coalesce(F.get("places", k + 1) - i, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    return held.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count(SYMBOL).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"\p{L}").alias("n_letters"),
        count("!").alias("n_exclaim"),
        count(r"[.?!…。]").alias("n_stops"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """The rules by name, over the columns of ``text_statistics``. An empty document gets abstentions."""
    n, words = F.col("n_words"), F.col("n_words") > 0
    c, never = F.col, F.lit(False)
    return {
        "symbols": _vote(words & (c("n_symbols") > 0.1 * n), never),
        "upper_case": _vote(c("n_upper") > 0.4 * c("n_letters"), never),
        "exclamations": _vote(words & (c("n_exclaim") > 0.1 * n), never),
        "repeats": _vote(c("n_repeat_words") > 0.4 * n, never),
        "lines": _vote(c("n_dup_lines") > 0.5 * c("n_lines"), never),
        "letters": _vote(words & (c("n_letters") < 0.7 * c("word_chars")), never),
        # different words grow with the root of all: their square over all does not depend on the length
        "variety": _vote((n >= 50) & (c("n_distinct") * c("n_distinct") < 2 * n), (n >= 20) & (c("n_distinct") * c("n_distinct") >= 10 * n)),
        "word_length": _vote(words & ((c("word_chars") < 2 * n) | (c("word_chars") > 15 * n)), words & c("word_chars").between(3 * n, 11 * n)),
        "stops": _vote((n >= 50) & (c("n_stops") < 0.002 * n), c("n_stops").between(0.01 * n, 0.4 * n) & words),
    }


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(array: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + of(x))


def _round(state: Column, patterns: Column, total: Column, k: int) -> Column:
    """The next estimates: prior, the chances of each rule's bad, then good votes by class, and how far they moved."""
    expected = [[e[c] for e in EXPECTED for _ in range(k)] for c in (0, 1)]

    def share(chance: Column, prior: Column) -> Column:
        return 1 / (1 + F.exp(-(F.log(prior / (1 - prior)) + chance)))

    def weighed(odds: Column) -> Column:
        return F.transform(patterns, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * share(_sum(x["votes"], lambda i: F.get(odds, i)), state["prior"])).alias("g")))

    def estimate(w: Column, good: Column, c: int) -> Column:
        of = (lambda y: y["g"]) if c else (lambda y: y["n"] - y["g"])
        held, drawn = (good if c else total - good), WEIGHT * total * (GOOD if c else 1 - GOOD)
        start = F.array(*map(F.lit, expected[c]))
        one = lambda i: (_sum(w, lambda y: F.when(F.array_contains(y["votes"], i), of(y)).otherwise(0.0)) + drawn * F.get(start, i)) / (held + drawn)
        return F.transform(F.sequence(F.lit(0), F.lit(2 * k - 1)), one)

    def far(a: Column, b: Column) -> Column:
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))

    def after(w: Column) -> Column:
        return _let(_sum(w, lambda y: y["g"]), lambda good: _let(
            F.struct(((good + WEIGHT * total * GOOD) / (total + WEIGHT * total)).alias("prior"), estimate(w, good, 0).alias("bad"), estimate(w, good, 1).alias("good")),
            lambda t: F.struct(t["prior"].alias("prior"), t["bad"].alias("bad"), t["good"].alias("good"),
                               F.greatest(far(t["bad"], state["bad"]), far(t["good"], state["good"]), F.abs(t["prior"] - state["prior"])).alias("moved")),
        ))

    return _let(F.zip_with(state["good"], state["bad"], lambda g, b: F.log(g / b)), lambda odds: _let(weighed(odds), after))


def estimated(votes: DataFrame, names: list[str]) -> tuple[float, dict[str, tuple]]:
    """The share of good documents and each rule's chances ((bad vote if bad, if good), (good vote if bad, if
    good)), by EM until it stands still.

    The table of vote patterns has at most 3 ** rules rows whatever the number of documents; EM is one
    expression over it, and its result, one row, goes to the driver.
    """
    k = len(names)
    cast = F.array_compact(F.array(*[F.when(F.col(c) == v, i + (0 if v < 0 else k)) for v in (-1, 1) for i, c in enumerate(names)]))
    counted = votes.groupBy(*names).agg(F.count("*").cast("double").alias("n")).select(F.struct(cast.alias("votes"), "n").alias("x"))
    held = counted.agg(F.array_sort(F.collect_list("x")).alias("patterns")).withColumn("total", _sum(F.col("patterns"), lambda x: x["n"]))
    by_class = [F.array(*[F.lit(e[c]) for e in EXPECTED for _ in names]) for c in (0, 1)]
    start = F.struct(F.lit(GOOD).alias("prior"), by_class[0].alias("bad"), by_class[1].alias("good"), F.lit(1.0).alias("moved"))
    last = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST)), start,
        lambda s, _: F.when((s["moved"] < CLOSE) | (F.col("total") == 0), s).otherwise(_round(s, F.col("patterns"), F.col("total"), k)),
    )
    m = held.select(last.alias("m")).first()["m"]
    return m["prior"], {c: ((m["bad"][i], m["good"][i]), (m["bad"][i + k], m["good"][i + k])) for i, c in enumerate(names)}


def _log_odds(names: list[str], prior: float, tables: dict[str, tuple]) -> Column:
    """Log odds of good from the votes; ``tables`` has for each rule the chances of -1 and of 1."""
    out = F.lit(math.log(prior / (1 - prior)))
    for name in names:
        (bad_if_bad, bad_if_good), (good_if_bad, good_if_good) = tables[name]
        out = out + F.when(F.col(name) == -1, math.log(bad_if_good / bad_if_bad)).when(F.col(name) == 1, math.log(good_if_good / good_if_bad)).otherwise(0.0)
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, p_good (the posterior) and the votes by rule.

    A null or empty text has no words and fails the base test. Rows are judged one by one, so null
    and repeated ids do not matter; texts are read whole, whatever their length, and other columns,
    whatever their names, are not read. An empty table gives no rows. Repeated word windows are found by
    64-bit hashes within one text and compared word for word.
    """
    named = rules()
    votes = stored(text_statistics(docs, id_col, text_col).withColumns({f"vote_{k}": v for k, v in named.items()}), "rule-votes")
    names = [f"vote_{k}" for k in named]
    prior, tables = estimated(votes, names)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    p = 1 / (1 + F.exp(-_log_odds(names, prior, tables)))
    return votes.withColumn("base_failed", failed).withColumn("p_good", p).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("p_good") >= keep)).alias("kept"), "p_good", *names,
    )


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + o AS j FROM twice, (SELECT unnest(range(3)) AS o)) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(DISTINCT l) AS n_different FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (SELECT r, doc_id, len(w)::BIGINT AS n, length(array_to_string(w, ''))::BIGINT AS wc, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS sy, coalesce(n_lines, 0) AS nl, coalesce(n_lines - n_different, 0) AS dl,
      coalesce(rep.n, 0) AS rw, len(list_distinct(w)) AS nd, len(regexp_extract_all(t, '\p{Lu}')) AS up, len(regexp_extract_all(t, '\p{L}')) AS le, len(regexp_extract_all(t, '!')) AS ex, len(regexp_extract_all(t, '[.?!…。]')) AS st
      FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
v AS (SELECT *, (n > 0 AND sy > 0.1 * n) AS b0, up > 0.4 * le AS b1, (n > 0 AND ex > 0.1 * n) AS b2, rw > 0.4 * n AS b3, dl > 0.5 * nl AS b4, (n > 0 AND le < 0.7 * wc) AS b5,
      (n >= 50 AND nd * nd < 2 * n) AS b6, (n > 0 AND (wc < 2 * n OR wc > 15 * n)) AS b7, (n >= 50 AND st < 0.002 * n) AS b8,
      (n >= 20 AND nd * nd >= 10 * n) AS g6, (n > 0 AND wc BETWEEN 3 * n AND 11 * n) AS g7, (n > 0 AND st BETWEEN 0.01 * n AND 0.4 * n) AS g8 FROM s),
c AS (SELECT *, list_filter([CASE WHEN b0 THEN 1 END, CASE WHEN b1 THEN 2 END, CASE WHEN b2 THEN 3 END, CASE WHEN b3 THEN 4 END, CASE WHEN b4 THEN 5 END, CASE WHEN b5 THEN 6 END, CASE WHEN b6 THEN 7 END, CASE WHEN b7 THEN 8 END, CASE WHEN b8 THEN 9 END,
      CASE WHEN NOT b6 AND g6 THEN 16 END, CASE WHEN NOT b7 AND g7 THEN 17 END, CASE WHEN NOT b8 AND g8 THEN 18 END], lambda x: x IS NOT NULL) AS votes FROM v),
pat AS (SELECT list({'votes': votes, 'n': k}) AS ps, sum(k) AS total FROM (SELECT votes, count(*)::DOUBLE AS k FROM c GROUP BY votes)),
em AS (SELECT 0 AS it, 0.9::DOUBLE AS prior, list_concat(list_transform(range(9), lambda i: 0.3::DOUBLE), list_transform(range(9), lambda i: 0.6::DOUBLE)) AS bad,
              list_concat(list_transform(range(9), lambda i: 0.002::DOUBLE), list_transform(range(9), lambda i: 0.9::DOUBLE)) AS good, 1.0::DOUBLE AS moved
  UNION ALL
  SELECT it + 1, p2, b2, g2, greatest(abs(p2 - prior), list_max(list_transform(range(1, 19), lambda i: greatest(abs(b2[i] - bad[i]), abs(g2[i] - good[i]))))) FROM (
    SELECT *, (ng + 0.45 * total) / (1.5 * total) AS p2,
      list_transform(range(1, 19), lambda i: (list_sum(list_transform(w, lambda y: CASE WHEN list_contains(y.votes, i) THEN y.n - y.g ELSE 0 END)) + 0.5 * total * (1 - 0.9::DOUBLE) * (CASE WHEN i < 10 THEN 0.3 ELSE 0.6 END)) / (total - ng + 0.5 * total * (1 - 0.9::DOUBLE))) AS b2,
      list_transform(range(1, 19), lambda i: (list_sum(list_transform(w, lambda y: CASE WHEN list_contains(y.votes, i) THEN y.g ELSE 0 END)) + 0.45 * total * (CASE WHEN i < 10 THEN 0.002 ELSE 0.9 END)) / (ng + 0.45 * total)) AS g2
    FROM (SELECT *, list_sum(list_transform(w, lambda y: y.g)) AS ng FROM (
      SELECT em.*, total, list_transform(ps, lambda x: {'votes': x.votes, 'n': x.n, 'g': x.n / (1 + exp(-(ln(prior / (1 - prior)) + coalesce(list_sum(list_transform(x.votes, lambda i: ln(good[i] / bad[i]))), 0))))}) AS w FROM em, pat WHERE moved >= 1e-7 AND it < 500)))),
fin AS (SELECT * FROM em ORDER BY it DESC LIMIT 1)
SELECT doc_id, n AS n_words, wc AS word_chars, sy AS n_symbols, dl AS n_dup_lines, rw AS n_repeat_words, (n < 50 OR 100 * rw > 50 * n) AS base_failed,
       NOT (n < 50 OR 100 * rw > 50 * n) AND 1 / (1 + exp(-(ln(prior / (1 - prior)) + coalesce(list_sum(list_transform(votes, lambda i: ln(good[i] / bad[i]))), 0)))) >= 0.5 AS kept
FROM c, fin
"""
