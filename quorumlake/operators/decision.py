"""Judges that answer with probabilities: one request for each item, and answers that become votes.

A criterion is posed in one of three kinds: ``noul`` asks for the probability of MET, ``choice`` for one
of the verdicts or option labels, ``score`` for a level of an ordered scale, in which an NA option has no
place. An answer that is not usable is a failed vote of category parse, of its criterion alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import CANNOT_ASSESS, MET, UNMET, criterion_keys, with_rubric

ANSWER = "criterion_idx:int,type:string,noul:double,choice:string,score:double,probabilities:map<string,double>"
VERDICTS = (MET, UNMET, CANNOT_ASSESS)


def question_kind(options: Column, scale: Column, binary: str = "noul", ordinal: str = "score") -> Column:
    return F.when(options.isNull(), F.lit(binary)).when((scale == "ordinal") & F.lit(ordinal == "score"), F.lit("score")).otherwise(F.lit("choice"))


def _offered(kind: Column) -> Column:
    """The outcomes that an answer's probabilities must cover, in the rubric's order."""
    labels = F.transform("options", lambda o: o["label"])
    levels = F.transform(F.filter("options", lambda o: ~o["na"]), lambda o, i: i.cast("string"))
    return F.when(kind == "score", levels).when(F.col("options").isNull(), F.array(*map(F.lit, VERDICTS))).otherwise(labels)


def requests(items: DataFrame, criteria: DataFrame, binary: str = "noul", ordinal: str = "score") -> DataFrame:
    """(item_idx, state, questions): one request for each item about the criteria of its own rubric, whatever their number.

    ``items`` has item_idx, submission and perhaps prompt, reference_submission and guidelines. The state is
    what all questions see; a submission with sections is sent as these. Blank fields are left out.
    """
    column = lambda c: X.blank_to_null(F.col(c)) if c in items.columns else F.lit(None).cast("string")
    text = F.col("submission")
    parts = X.has_sections(text)
    own = F.struct(
        column("guidelines").alias("guidelines"), column("prompt").alias("input"), column("reference_submission").alias("reference_submission"),
        F.when(parts, X.thinking_section(text)).alias("thinking"), F.when(parts, X.output_section(text)).alias("output"), F.when(~parts, text).alias("submission"),
    )
    kind = question_kind(F.col("options"), F.col("scale"), binary, ordinal)
    keys = criterion_keys(criteria)
    q = F.struct("criterion_idx", "kind", "requirement", F.when(F.col("kind") != "noul", _offered(F.col("kind"))).alias("outcomes"))
    asked = criteria.withColumn("kind", kind).groupBy(*keys[:-1]).agg(F.to_json(F.array_sort(F.collect_list(q))).alias("questions"))  # one row for each rubric
    carried = ["item_idx", *[c for c in ("rubric_id",) if c in items.columns]]
    return with_rubric(items.select(*carried, F.to_json(own).alias("state")), asked.withColumn("criterion_idx", F.lit(0)), "questions").select(*carried, "state", "questions")


def answer_votes(answers: DataFrame, criteria: DataFrame, threshold: float = 0.5, binary: str = "noul", ordinal: str = "score") -> DataFrame:
    """Votes (verdict, option_idx, probabilities, confidence, error) of every item and criterion.

    ``answers`` has item_idx and answers, an array of ANSWER. An unusable answer: none or several for the
    criterion, another kind than was asked, a choice that was not offered, probabilities that do not
    cover what was offered or are none. A level is rounded half to even; a score never abstains.
    """
    carried = [c for c in ("rubric_id",) if c in answers.columns]
    every = with_rubric(answers.select("item_idx", *carried, "answers"), criteria, "weight", "scale", "options")
    kind = question_kind(F.col("options"), F.col("scale"), binary, ordinal)
    own = every.withColumn("kind", kind).withColumn("mine", F.filter("answers", lambda a: a["criterion_idx"] == F.col("criterion_idx"))).withColumn("a", F.get("mine", F.lit(0)))
    offered = _offered(F.col("kind"))
    p, k = F.col("a.probabilities"), F.size(offered)
    fine = X.probabilities_ok(p, offered)
    levels = F.transform(F.filter("options", lambda o: ~o["na"]), lambda o: o["idx"])
    level = X.snapped_level(F.col("a.score"), F.size(levels))
    problem = (
        F.when(F.size("mine") == 0, "no answer").when(F.size("mine") > 1, "several answers").when(~F.col("a.type").eqNullSafe(F.col("kind")), "another kind of answer")
        .when(F.col("kind") == "noul", F.when(~F.coalesce(F.col("a.noul").between(0, 1), F.lit(False)), "its probability is not from 0 to 1"))
        .when(~F.coalesce(fine, F.lit(False)), "its probabilities do not cover what was offered")
        .when((F.col("kind") == "choice") & ~F.coalesce(F.array_contains(offered, F.col("a.choice")), F.lit(False)), "its choice was not offered")
        .when((F.col("kind") == "score") & ~F.coalesce(F.abs("a.score") < float("inf"), F.lit(False)), "its score is no number")
    )
    usable = F.col("problem").isNull()
    of_binary = F.when(F.col("kind") == "noul", X.binary_answer(F.col("a.noul"), F.lit(threshold), F.col("weight"))).otherwise(F.col("a.choice"))
    of_choice = F.when(F.col("kind") == "score", F.get(levels, level)).otherwise(X.option_by_label(F.col("options"), F.col("a.choice")))
    met = F.create_map(F.lit(MET), F.col("a.noul"), F.lit(UNMET), 1 - F.col("a.noul"))
    by_index = F.map_from_entries(F.transform(F.filter("options", lambda o: (F.col("kind") != "score") | ~o["na"]), lambda o, i: F.struct(
        o["idx"].cast("string").alias("key"), F.when(F.col("kind") == "score", F.try_element_at(p, i.cast("string"))).otherwise(F.try_element_at(p, o["label"])).alias("value"))))
    known = F.when(F.col("kind") == "noul", met).when(F.col("options").isNull(), p).otherwise(by_index)
    picked = F.when(F.col("options").isNull(), F.col("verdict")).otherwise(F.col("option_idx").cast("string"))
    return (
        own.withColumn("problem", problem)
        .withColumn("verdict", F.when(usable & F.col("options").isNull(), of_binary))
        .withColumn("option_idx", F.when(usable & F.col("options").isNotNull(), of_choice).cast("int"))
        .withColumn("probabilities", F.when(usable, known))
        .withColumn("outcomes", F.when(F.col("kind") == "noul", 2).otherwise(k))
        .select("item_idx", "criterion_idx", *carried, "verdict", "option_idx", "probabilities",
                F.when(usable, X.selection_confidence(F.try_element_at("probabilities", picked), F.col("outcomes"))).alias("confidence"),
                F.when(~usable, F.concat(F.lit("parse: "), F.col("problem"))).alias("error"))
    )
