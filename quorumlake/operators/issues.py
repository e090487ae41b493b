"""Which criteria an issue is about: by its tag, or else by names, wording and numbers in its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import criterion_keys, dimension

#: Wording matches where so many characters of a requirement, from every STEP-th on, stand in the text.
WINDOW, STEP = 20, 10
#: A rubric of at most so many windows has each looked for in the text; the windows of a text, which cost some hundred
#: times its bytes, are made for larger ones only.
FEW = 100
TAG = r"\[affects:\s*(.+?)\]"
NUMBER = r"(?:criteri(?:on|a)\s+|#|index\s+)(\d+)"


def _numbers(text: Column, pattern: str, most: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: x.try_cast("int"))
    return F.filter(found, lambda k: F.coalesce(k.between(1, most), F.lit(False)))


def _windows(requirement: Column) -> Column:
    """The windows of a requirement's wording, in lower case."""
    text = F.lower(requirement)
    starts = F.when(F.char_length(text) >= WINDOW, F.sequence(F.lit(0), F.char_length(text) - WINDOW, F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(WINDOW)))


def matched(issues: DataFrame, criteria: DataFrame, text_col: str = "feedback") -> DataFrame:
    """``issues`` with ``criteria``: the numbers, from 1 and in order, of the criteria that each is about.

    A tag such as ``[Affects: #1, #3]`` or ``[Affects: all]``, whatever its case, decides alone if it has a number that
    there is. Else a criterion is meant whose name stands in the text, whose wording does for WINDOW characters, or whose
    number follows ``#``, "criterion" or "index". A rubric's windows are looked for one by one where they are FEW; where not, a
    text's windows meet them all at once, in a hash table. Criteria are asked only for the few that were met; texts are not shuffled. A null text is about nothing. ``issues`` of several rubrics have their key.
    """
    keys = criterion_keys(criteria)[:-1]
    one = F.struct((F.col("criterion_idx") + 1).alias("place"), F.lower("name").alias("name"), _windows(F.col("requirement")).alias("windows"))
    rubrics = criteria.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_all")).withColumn("_wording", F.array_distinct(F.flatten(F.transform("_all", lambda c: c["windows"]))))
    own = issues.withColumn("_t", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    told = own.join(dimension(rubrics), keys) if keys else own.join(dimension(rubrics), F.lit(True))
    n, text = F.size("_all"), F.col("_t")
    tag = F.trim(F.regexp_extract(text, TAG, 1))
    tagged = F.when(tag == "all", F.transform("_all", lambda c: c["place"])).otherwise(_numbers(tag, r"#?(\d+)", n))
    # all windows of a text in one pass over it: a lookahead moves on by one character
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{WINDOW}}}))"), 1)
    met = F.when(F.size("_wording") <= FEW, F.filter("_wording", lambda w: F.contains(text, w))).otherwise(F.array_intersect("_wording", every))
    read = told.withColumn("_tagged", tagged)
    named = lambda c: F.coalesce((c["name"] != "") & F.contains(text, c["name"]), F.lit(False))
    # as the one element of an array, what was met is found once, not for each criterion
    once = F.transform(F.array(met), lambda m: F.filter("_all", lambda c: named(c) | F.arrays_overlap(c["windows"], m)))
    meant = F.get(once, F.lit(0))
    about = F.when(F.size("_tagged") > 0, F.col("_tagged")).otherwise(F.concat(F.transform(meant, lambda c: c["place"]), _numbers(text, NUMBER, n)))
    return read.withColumn("criteria", F.array_sort(F.array_distinct(about))).select(*issues.columns, "criteria")
