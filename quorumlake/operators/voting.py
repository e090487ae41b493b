"""Vote aggregation: votes of several judges on (item, criterion) cells become one verdict each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import BINARY_STRATEGIES, CANNOT_ASSESS, MET, NOMINAL_STRATEGIES, ORDINAL_STRATEGIES, UNMET, cell_keys, with_criteria


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def routed_votes(votes: DataFrame, criteria: DataFrame) -> DataFrame:
    """What a failed call votes: an infrastructure or parse failure abstains, into the NA option where
    there is one; any other failure takes the worst case by the sign of the criterion's weight."""
    known = with_criteria(votes, criteria, "weight", "options")
    abstains = F.col("error").rlike("^(infrastructure|parse)")
    mc = F.col("options").isNotNull()
    verdict = F.when(F.col("error").isNull(), F.col("verdict")).when(~mc, F.when(abstains, CANNOT_ASSESS).otherwise(X.binary_worst(F.col("weight"))))
    option = F.when(F.col("error").isNull(), F.col("option_idx")).when(
        mc, F.when(abstains, X.na_index(F.col("options"))).otherwise(X.worst_scored(F.col("options"), F.col("weight")))
    )
    return known.withColumn("verdict", verdict).withColumn("option_idx", option).select(*votes.columns)


def _binary(strategy: str, weight: Column) -> Column:
    met_n, unmet_n, met_w, unmet_w = (F.col(c) for c in ("met_n", "unmet_n", "met_w", "unmet_w"))
    a, b = (met_n, unmet_n) if strategy == "majority" else (met_w, unmet_w)
    decided = F.when(a > b, MET).when(b > a, UNMET).otherwise(X.binary_worst(weight))
    if strategy == "unanimous":
        decided = F.when(unmet_w == 0, MET).otherwise(UNMET)
    elif strategy == "any":
        decided = F.when(met_w > 0, MET).otherwise(UNMET)
    return F.when(met_n + unmet_n == 0, CANNOT_ASSESS).otherwise(decided)


def _choices() -> Column:
    """(judge_ord, judge_id, option_idx, value, judge_weight) of the votes that chose a scored option, in judge order."""
    own = F.struct("judge_ord", "judge_id", "option_idx", F.col("value").alias("value"), F.col("judge_weight").alias("w"))
    return F.array_sort(F.collect_list(F.when(F.col("chosen"), own)))


def aggregate_votes(votes: DataFrame, criteria: DataFrame, binary: str = "majority", ordinal: str = "mean", nominal: str = "mode") -> DataFrame:
    """One row per cell with votes: final_verdict (binary), option_idx, value, na, aggregated_value,
    n_votes, agreement, error, final_reason, warning.

    ``votes`` are routed (see ``routed_votes``); superseded ones are set aside. A criterion's own
    ``aggregation`` overrides the scale's strategy. Ties go to the worst case by the sign of the
    criterion's weight. One shuffle, on the item, serves this and any later step by item.
    """
    _one_of("binary", binary, BINARY_STRATEGIES), _one_of("ordinal", ordinal, ORDINAL_STRATEGIES), _one_of("nominal", nominal, NOMINAL_STRATEGIES)
    columns = ("weight", "scale", "aggregation", "options")
    # the strategies in use, which are few, so that the plan has no branch that no criterion takes
    used = {(r["scale"], r["aggregation"]) for r in criteria.select("scale", "aggregation").distinct().collect()}
    ordinals, nominals = ({a or default for scale, a in used if scale == kind} for kind, default in (("ordinal", ordinal), ("nominal", nominal)))
    live = votes.where(~F.coalesce(F.col("superseded"), F.lit(False))).repartition("item_idx")
    options, weight = F.col("options"), F.col("weight")
    joined = with_criteria(live, criteria, *columns).withColumn("opt", F.get(options, F.col("option_idx")))
    cell = with_criteria(
        joined.withColumn("value", F.col("opt.value"))
        .withColumn("chosen", options.isNotNull() & F.col("option_idx").isNotNull() & ~F.coalesce(F.col("opt.na"), F.lit(True)))
        .groupBy(*cell_keys(votes))
        .agg(
            F.count("*").alias("n_votes"),
            F.count_if(F.col("verdict") == MET).alias("met_n"),
            F.count_if(F.col("verdict") == UNMET).alias("unmet_n"),
            F.sum(F.when(F.col("verdict") == MET, F.col("judge_weight")).otherwise(0.0)).alias("met_w"),
            F.sum(F.when(F.col("verdict") == UNMET, F.col("judge_weight")).otherwise(0.0)).alias("unmet_w"),
            _choices().alias("choices"),
            F.min(F.when(F.col("option_idx").isNotNull(), F.struct("judge_ord", "option_idx")))["option_idx"].alias("first_idx"),
            F.bool_and(F.col("error").isNotNull()).alias("all_failed"),
            F.array_sort(F.collect_list(F.struct("judge_ord", "judge_id", "verdict", "option_idx", "error", "reason"))).alias("cast"),
        ),
        criteria, *columns,
    )
    field = lambda name: F.transform("choices", lambda x: x[name])
    idxs, vals, ws = field("option_idx"), field("value"), field("w")
    n = F.size("choices")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    strategy = F.when(F.col("scale") == "ordinal", F.coalesce("aggregation", F.lit(ordinal))).when(F.col("scale") == "nominal", F.coalesce("aggregation", F.lit(nominal)))
    continuous = F.try_divide(total(vals), n)
    if "weighted_mean" in ordinals:
        weighted = F.coalesce(F.try_divide(total(F.zip_with(vals, ws, lambda v, w: v * w)), total(ws)), continuous)
        continuous = F.when(strategy == "weighted_mean", weighted).otherwise(continuous)
    if "median" in ordinals:
        rising = F.array_sort(vals)
        median = (F.get(rising, F.floor((n - 1) / 2).cast("int")) + F.get(rising, F.floor(n / 2).cast("int"))) / 2
        continuous = F.when(strategy == "median", median).otherwise(continuous)
    means = bool(ordinals - {"mode", "min", "max"})
    is_mean = (F.col("scale") == "ordinal") & ~strategy.isin("mode", "min", "max") if means else F.lit(False)
    common = X.most_common(options, weight, idxs) if ordinals & {"mode"} or nominals & {"mode", "unanimous"} else F.lit(None).cast("int")
    picked = F.when(n == 0, F.col("first_idx"))
    if means:
        picked = picked.when(is_mean, X.snapped(options, weight, continuous))
    if "min" in ordinals:
        picked = picked.when(strategy == "min", F.array_min(F.transform("choices", lambda x: F.struct(x["value"], x["option_idx"].alias("i"))))["i"])
    if "max" in ordinals:
        picked = picked.when(strategy == "max", -F.array_max(F.transform("choices", lambda x: F.struct(x["value"], (-x["option_idx"]).alias("i"))))["i"])
    if "weighted_mode" in nominals:
        picked = picked.when(strategy == "weighted_mode", X.most_common(options, weight, idxs, ws))
    if "unanimous" in nominals:
        agreed = F.when(F.size(F.array_distinct(idxs)) == 1, F.get(idxs, F.lit(0))).otherwise(F.coalesce(X.na_index(options), common))
        picked = picked.when((F.col("scale") == "nominal") & (strategy == "unanimous"), agreed)
    picked = picked.otherwise(common)
    mc = options.isNotNull()
    out = (
        cell.withColumn("final_verdict", F.when(~mc, _binary(binary, weight)))
        .withColumn("option_idx", F.when(mc, picked).cast("int"))
        .withColumn("opt", F.get(options, F.col("option_idx")))
        .withColumn("na", F.when(mc, F.coalesce(F.col("opt.na"), F.lit(True)) | (n == 0)).otherwise(F.col("final_verdict") == CANNOT_ASSESS))
        .withColumn("value", F.when(mc, F.coalesce(F.col("opt.value"), F.lit(0.0))))
        .withColumn("aggregated_value", F.when(mc, F.when(is_mean & (n > 0), continuous).otherwise(F.col("value"))))
    )
    same = F.filter("cast", lambda v: F.when(options.isNull(), v["verdict"] == F.col("final_verdict")).otherwise(v["option_idx"].eqNullSafe(F.col("option_idx"))))
    told = F.filter("cast", lambda v: v["reason"].isNotNull())
    return out.select(
        *cell_keys(votes), "weight", "scale", "options", "final_verdict", "option_idx", "value", "na", "aggregated_value", "n_votes",
        F.try_divide(F.size(same), F.size("cast")).alias("agreement"),
        F.when(F.col("all_failed"), F.array_join(F.transform("cast", lambda v: F.concat(v["judge_id"], F.lit(": "), v["error"])), " | ")).alias("error"),
        F.when(~mc & (F.col("n_votes") == 0), "No votes").when(~mc & F.col("na"), "All judges voted CANNOT_ASSESS").when(
            F.size(told) > 0, F.array_join(F.transform(told, lambda v: F.concat(v["judge_id"], F.lit(": "), v["reason"])), "\n")
        ).alias("final_reason"),
        (F.when((F.col("scale") == "nominal") & (strategy == "unanimous") & (F.size(F.array_distinct(idxs)) > 1) & X.na_index(options).isNull(),
                "judges disagree and no option abstains: the most common option stands") if "unanimous" in nominals else F.lit(None).cast("string")).alias("warning"),
    )


def top_tied(counts: DataFrame, keys: list[str], key: str, n: str) -> DataFrame:
    """All rows of each group with the group's greatest ``n``."""
    most = counts.groupBy(*keys).agg(F.max(n).alias("_most"))
    return counts.join(most, keys).where(F.col(n) == F.col("_most")).drop("_most")
