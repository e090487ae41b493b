"""Tables of the engine, in long form, and checks of rubrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTION = "struct<idx:int,label:string,value:double,na:boolean>"
CRITERIA = f"criterion_idx int, name string, requirement string, weight double, scale string, aggregation string, options array<{OPTION}>"
VOTES = (
    "item_idx long, criterion_idx int, judge_id string, judge_ord int, judge_weight double, role string, verdict string, option_idx int, "
    "error string, reason string, probabilities map<string,double>, confidence double, superseded boolean"
)
LABELS = "item_idx long, criterion_idx int, verdict string, option_idx int, reason string"

MET, UNMET, CANNOT_ASSESS = "MET", "UNMET", "CANNOT_ASSESS"
SCALES = ("binary", "ordinal", "nominal")
NA_LABEL = "Cannot assess / not applicable"
BINARY_STRATEGIES = ("majority", "weighted", "unanimous", "any")
ORDINAL_STRATEGIES = ("mean", "median", "weighted_mean", "mode", "min", "max")
NOMINAL_STRATEGIES = ("mode", "weighted_mode", "unanimous")
ABSTAIN_STRATEGIES = ("skip", "zero", "partial", "fail")

#: Dimension tables (criteria, judges, thresholds) are broadcast up to this many rows and bytes.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 20_000, 8 << 20


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a literal of the plan: no Python worker reads them, and the optimizer knows their size."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    text = json.dumps([dict(zip(names, _plain(r, T.StructType.fromDDL(schema)))) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def _plain(row: tuple, schema: T.StructType) -> list:
    """A row's values with structs, given as tuples, as dicts."""

    def one(v, kind):
        if v is None:
            return None
        if isinstance(kind, T.StructType):
            return dict(zip(kind.names, _plain(v, kind)))
        return [one(x, kind.elementType) for x in v] if isinstance(kind, T.ArrayType) else v

    return [one(v, f.dataType) for v, f in zip(row, schema.fields)]


def dimension(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is as small as a dimension should be, else as it is: by the
    optimizer's estimate, or where that is large, by counting rows and bytes."""
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= MAX_BROADCAST_BYTES:
        return F.broadcast(df)
    held = df.limit(MAX_BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("b")).first()
    return F.broadcast(df) if held["n"] <= MAX_BROADCAST_ROWS and (held["b"] or 0) <= MAX_BROADCAST_BYTES else df


def criterion_keys(criteria: DataFrame) -> list[str]:
    """What names a criterion: its index, and beside it its rubric where there are several, or its item where
    items have criteria of their own. Tables of several rubrics may have item_idx too, which then names nothing."""
    several = [c for c in ("rubric_id", "item_idx") if c in criteria.columns][:1]
    return [*several, "criterion_idx"]


def cell_keys(frame: DataFrame) -> list[str]:
    """What names a cell of ``frame``: item and criterion, and the item's rubric where the frame carries it."""
    return ["item_idx", "criterion_idx", *[c for c in ("rubric_id",) if c in frame.columns]]


def _of_rubric(frame: DataFrame, keys: list[str]) -> None:
    if "rubric_id" in keys and "rubric_id" not in frame.columns:
        raise ValueError("criteria of several rubrics need frames with the rubric_id of their items")


def with_criteria(frame: DataFrame, criteria: DataFrame, *columns: str) -> DataFrame:
    """``frame`` with the named columns of its criteria: rubrics, one or several, are broadcast if they are as small as
    dimensions are; criteria of single items are joined on item and index."""
    keys = criterion_keys(criteria)
    _of_rubric(frame, keys)
    own = criteria.select(*keys, *columns)
    return frame.join(own if "item_idx" in keys else dimension(own), keys)


def with_rubric(items: DataFrame, criteria: DataFrame, *columns: str) -> DataFrame:
    """Each of ``items`` with the named columns of each criterion of its rubric."""
    keys = criterion_keys(criteria)
    _of_rubric(items, keys)
    own = criteria.select(*keys, *columns)
    if keys[0] == "criterion_idx":
        return items.join(dimension(own), F.lit(True))
    return items.join(own if "item_idx" in keys else dimension(own), keys[0])


def criteria_problems(criteria: DataFrame) -> DataFrame:
    """(criterion_idx, problem) of each broken rule: scales, option counts, values and labels."""
    normal = F.transform("options", lambda o: F.lower(F.trim(o["label"])))
    scored = F.filter("options", lambda o: ~o["na"])
    mc = F.col("options").isNotNull()
    checks = {
        "unknown scale": ~F.col("scale").isin(*SCALES),
        "binary criterion with options": (F.col("scale") == "binary") & mc,
        "options missing": (F.col("scale") != "binary") & ~mc,
        "fewer than two options": mc & (F.size("options") < 2),
        "fewer than two scored options": mc & (F.size(scored) < 2),
        "labels not unique": mc & (F.size(F.array_distinct(normal)) < F.size("options")),
        "value outside 0 to 1": mc & F.exists(scored, lambda o: (o["value"] < 0) | (o["value"] > 1)),
        "weight not finite": F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == float("inf")),
        "scored option with the label of the added NA option": mc & ~F.exists("options", lambda o: o["na"]) & F.array_contains(normal, NA_LABEL.lower()),
    }
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])
    return criteria.select("criterion_idx", F.explode(F.array_compact(found)).alias("problem"))


def checked_criteria(criteria: DataFrame) -> DataFrame:
    """``criteria``, or a ValueError that names the first broken rules."""
    bad = criteria_problems(criteria).orderBy("criterion_idx", "problem").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"criterion {r['criterion_idx']}: {r['problem']}" for r in bad))
    return criteria
