"""One call for an item's whole rubric: the reply's judgments become votes, each for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import prompts as P
from ..schema import CANNOT_ASSESS, MET, UNMET, with_rubric

#: A reply's judgments as text, so that one that is malformed spoils itself only.
_REPLY = "struct<judgments:array<string>>"
_JUDGMENT = "struct<criterion_id:string,criterion_status:string,selected_option:int,explanation:string,affects:array<int>>"


def criterion_id(index):
    return F.concat(F.lit("c"), (index + 1).cast("string"))


def reply_votes(replies: DataFrame, criteria: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Votes (verdict, option_idx, reason, error) of every item and criterion from ``replies`` (item_idx, reply).

    Exactly one usable judgment counts for a criterion; else its vote fails as parse, and the others stand.
    A reply without a list of judgments fails for all. Options are counted from 1 as they were shown:
    ``order`` (item_idx, criterion_idx, order) has their permutation, by default none. A judgment's ``affects``
    go into its reason as tags.
    """
    parsed = replies.withColumn("judgments", F.from_json("reply", _REPLY, {"mode": "PERMISSIVE"})["judgments"])
    own = with_rubric(parsed, criteria, "options").withColumn("cid", criterion_id(F.col("criterion_idx")))
    if order is not None:
        own = own.join(order, ["item_idx", "criterion_idx"], "left")
    else:
        own = own.withColumn("order", F.lit(None).cast("array<int>"))
    mine = F.filter(F.transform("judgments", lambda t: F.from_json(t, _JUDGMENT)), lambda j: j["criterion_id"] == F.col("cid"))
    full = F.coalesce("order", F.transform("options", lambda o: o["idx"]))
    binary = F.col("options").isNull()
    status = F.when(F.col("j.criterion_status").isin(MET, UNMET, CANNOT_ASSESS), F.col("j.criterion_status"))
    picked = P.original_index(full, F.col("j.selected_option"))
    problem = (
        F.when(F.col("judgments").isNull(), "the reply is no list of judgments").when(F.size("mine") == 0, "no judgment with its id")
        .when(F.size("mine") > 1, "several judgments with its id").when(binary & status.isNull(), "it needs a criterion_status")
        .when(~binary & picked.isNull(), "it needs a selected_option that was shown")
    )
    tags = F.transform(F.coalesce("j.affects", F.array().cast("array<int>")), lambda i: F.concat(F.lit("[Affects: #"), i.cast("string"), F.lit("] ")))
    reason = F.concat(F.array_join(tags, ""), F.coalesce("j.explanation", F.lit("")))
    out = own.withColumn("mine", mine).withColumn("j", F.get("mine", F.lit(0))).withColumn("problem", problem)
    usable = F.col("problem").isNull()
    return out.select(
        "item_idx", "criterion_idx", F.when(usable & binary, status).alias("verdict"), F.when(usable & ~binary, picked).cast("int").alias("option_idx"),
        F.when(usable, X.blank_to_null(reason)).alias("reason"), F.when(~usable, F.concat(F.lit("parse: "), F.col("problem"))).alias("error"),
    )
