"""Datasets: JSON files of items with rubrics and ground truth, and reports as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import CANNOT_ASSESS, MET, UNMET, dimension

_CRITERION = "name:string,weight:double,requirement:string,options:array<struct<label:string,value:double,na:boolean>>,scale_type:string,aggregation:string"
#: A list holds criteria, or sections that have criteria themselves.
_ENTRIES = f"array<struct<{_CRITERION},criteria:array<struct<{_CRITERION}>>>>"
_RUBRIC = f"struct<guidelines:string,rubric:string,sections:{_ENTRIES},criteria:{_ENTRIES}>"
#: Rubrics come in several forms, so they are read as text first.
DATASET = (
    "name string, prompt string, reference_submission string, rubric string, "
    "items array<struct<submission:string,description:string,ground_truth:array<string>,ground_truth_reasons:array<string>,rubric:string,reference_submission:string,prompt:string>>"
)


def _entries(text: Column) -> Column:
    """The entries of a rubric that is a list, or a dict with sections or criteria."""
    own = F.from_json(text, _RUBRIC)
    return F.when(text.startswith("["), F.from_json(text, _ENTRIES)).otherwise(F.coalesce(own["sections"], own["criteria"]))


def parsed_rubric(text: Column) -> Column:
    """struct<guidelines, criteria> of a rubric's JSON, in the forms of ``Rubric.from_dict``; a rubric
    without criteria is an error."""
    own = F.from_json(F.when(text.startswith("{"), text), _RUBRIC)
    inner = own["rubric"]
    beside = F.from_json(F.when(inner.startswith("{"), inner), _RUBRIC)["guidelines"]
    entries = F.when(inner.isNotNull(), _entries(inner)).otherwise(_entries(text))
    bare = lambda c: F.struct(*[c[n].alias(n) for n in ("name", "weight", "requirement", "options", "scale_type", "aggregation")])
    flat = F.flatten(F.transform(entries, lambda e: F.when(e["criteria"].isNotNull(), F.transform(e["criteria"], bare)).otherwise(F.array(bare(e)))))
    flat = F.when(F.size(flat) > 0, flat).otherwise(F.raise_error(F.concat(F.lit("no criteria in the rubric "), text)))
    guidelines = F.coalesce(beside, own["guidelines"])
    return F.when(text.isNotNull(), F.struct(F.when(F.trim(guidelines) != "", guidelines).alias("guidelines"), flat.alias("criteria")))


def read_dataset(spark: SparkSession, path: str, strict: bool = False, across_files: bool = False) -> dict[str, DataFrame]:
    """``items``, ``criteria`` and ``labels`` of dataset files: one file, or a folder of them.

    A rubric is named by its content: items carry the rubric_id of their own rubric or, without one, of
    their dataset's, and criteria have one row for each rubric and criterion, however many items share it. (Their item_idx
    says whose own rubric it is, null for a dataset's.) An item's own prompt and reference come before the
    dataset's, and its own rubric's guidelines, even none, before those of the dataset's rubric. Labels are
    verdicts, or option labels that are matched whatever their case and outer space; one that matches nothing has
    neither verdict nor option, or, with ``strict``, is an error, as are as many labels as there are no criteria
    and an item without a rubric or a prompt of its own or its dataset's. item_idx is the place in the file; to grade
    the items of several files together, ``across_files`` puts the file's number above it, in bits 32 and up.
    """
    files = spark.read.schema(DATASET).json(path, multiLine=True).withColumn("dataset", F.col("_metadata.file_path"))
    if across_files:
        numbers = files.select("dataset").distinct().withColumn("_file", F.row_number().over(Window.orderBy("dataset")) - 1)  # a row for each file
        files = files.join(dimension(numbers), "dataset")
    place = (F.shiftleft(F.col("_file").cast("long"), 32) if across_files else F.lit(0).cast("long")) + F.col("pos")
    each = files.select("dataset", "name", "prompt", "reference_submission", "rubric", *(["_file"] if across_files else []), F.posexplode("items").alias("pos", "item"))
    own = lambda c: F.coalesce(F.col(f"item.{c}"), F.col(c)).alias(c)
    bare = each.select(
        "dataset", "name", place.alias("item_idx"), "item.submission", "item.description", own("prompt"), own("reference_submission"),
        F.sha2(own("rubric"), 256).alias("text_id"), "item.ground_truth", "item.ground_truth_reasons",
    )
    # each text of a rubric is parsed once, a dataset's once for the file; equal rubrics in different forms are one
    told = files.select("rubric", F.lit(None).cast("long").alias("item_idx")).unionByName(each.select(F.col("item.rubric").alias("rubric"), place.alias("item_idx")))
    texts = told.where("rubric is not null").groupBy("rubric").agg(F.min("item_idx").alias("item_idx"), F.bool_or(F.col("item_idx").isNull()).alias("shared"))
    parsed = texts.select(F.sha2("rubric", 256).alias("text_id"), "item_idx", "shared", parsed_rubric(F.col("rubric")).alias("r")).withColumn("rubric_id", F.sha2(F.to_json("r"), 256))
    rubrics = parsed.groupBy("rubric_id").agg(F.first("r").alias("r"), F.when(~F.bool_or("shared"), F.min("item_idx")).alias("item_idx"))
    criteria = rubrics.select("rubric_id", "item_idx", F.posexplode("r.criteria").alias("criterion_idx", "c")).select(
        "rubric_id", "item_idx", "criterion_idx", "c.name", "c.requirement",
        F.coalesce("c.weight", F.lit(10.0)).alias("weight"), F.when(F.col("c.options").isNull(), "binary").otherwise(F.coalesce("c.scale_type", F.lit("ordinal"))).alias("scale"),
        "c.aggregation",
        F.transform("c.options", lambda o, i: F.struct(i.cast("int").alias("idx"), o["label"].alias("label"), F.coalesce(o["value"], F.lit(0.0)).alias("value"), F.coalesce(o["na"], F.lit(False)).alias("na"))).alias("options"),
    )
    known = parsed.select("text_id", "rubric_id", F.col("r.guidelines").alias("guidelines"), F.size("r.criteria").alias("n_criteria"))
    items = bare.join(dimension(known), "text_id", "left").drop("text_id")
    truth = items.where("ground_truth is not null").select("dataset", "item_idx", "rubric_id", "ground_truth_reasons", F.posexplode("ground_truth").alias("criterion_idx", "label"))
    truth = truth.join(dimension(criteria.select("rubric_id", "criterion_idx", "options", F.lit(True).alias("_there"))), ["rubric_id", "criterion_idx"], "left")
    options = F.col("options")
    normal = lambda c: F.lower(F.trim(c))
    at = F.filter(F.transform(options, lambda o, i: F.struct(normal(o["label"]).alias("l"), i.cast("int").alias("i"))), lambda o: o["l"] == normal(F.col("label")))
    if strict:
        matched = F.when(options.isNull(), F.col("label").isin(MET, UNMET, CANNOT_ASSESS)).otherwise(F.size(at) > 0)
        told = F.concat(F.lit("item "), F.col("item_idx"), F.lit(", criterion "), F.col("criterion_idx"), F.lit(": no such label: "), F.coalesce("label", F.lit("null")))
        truth = truth.withColumn("label", F.when(F.coalesce(matched, F.lit(False)), F.col("label")).otherwise(F.raise_error(told)))
        uneven = F.size("ground_truth") != F.col("n_criteria")
        problem = F.when(F.col("rubric_id").isNull(), "no rubric").when(F.col("prompt").isNull(), "no prompt").when(F.coalesce(uneven, F.lit(False)), "labels and criteria differ in number")
        items = items.withColumn("item_idx", F.when(problem.isNull(), F.col("item_idx")).otherwise(F.raise_error(F.concat(F.lit("item "), F.col("item_idx"), F.lit(": "), problem))))
    labels = truth.select(
        "dataset", "item_idx", "rubric_id", "criterion_idx", F.when(options.isNull() & F.col("label").isin(MET, UNMET, CANNOT_ASSESS), F.col("label")).alias("verdict"),
        F.get(at, F.lit(0))["i"].alias("option_idx"), F.get("ground_truth_reasons", F.col("criterion_idx")).alias("reason"),
    )
    return {"items": items.drop("ground_truth", "ground_truth_reasons", "n_criteria"), "criteria": criteria, "labels": labels}


def write_dataset(items: DataFrame, labels: DataFrame, criteria: DataFrame, path: str) -> None:
    """Dataset files from tables such as ``read_dataset`` returns, which reads them back: one file for
    each dataset, as a whole, with its items in order of item_idx.

    Tables without a dataset column are one dataset. Of rubrics with rubric_id, the one that most items of a dataset have
    is written for the dataset, if all its items have one, and the others with their items; else criteria without item_idx make the dataset's
    rubric, the others their item's own. Prompts and references are written with the items.
    """
    items = _filled(items, "dataset", "name", "description", "prompt", "reference_submission", "guidelines")
    if "rubric_id" in criteria.columns:
        own_of = F.col("item_idx") if "item_idx" in criteria.columns else F.lit(None)
        shared = criteria.groupBy("rubric_id").agg(F.bool_or(own_of.isNull()).alias("shared"))
        per = items.groupBy("dataset", "rubric_id").agg(F.count("*").alias("n")).join(shared, "rubric_id", "left")
        best = per.groupBy("dataset").agg(F.max(F.struct("shared", "n", "rubric_id"))["rubric_id"].alias("rubric_id"), F.bool_or(F.col("rubric_id").isNull()).alias("_some"))
        one = best.where("not _some").select("dataset", F.lit(None).cast("bigint").alias("item_idx"), "rubric_id")
        several = items.select("dataset", "item_idx", "rubric_id").join(one.select("dataset", "rubric_id"), ["dataset", "rubric_id"], "left_anti")
        criteria = one.unionByName(several).join(criteria.drop("item_idx", "dataset"), "rubric_id").drop("rubric_id")
    criteria, labels = _filled(criteria, "dataset", "item_idx:bigint"), _filled(labels, "dataset", "reason")
    na = lambda o: F.struct(o["label"].alias("label"), o["value"].alias("value"), o["na"].alias("na"))
    one = F.struct(
        "criterion_idx", "name", "weight", "requirement", F.transform("options", na).alias("options"),
        F.when(F.col("options").isNotNull(), F.col("scale")).alias("scale_type"), "aggregation",
    )
    listed = F.array_sort(F.collect_list(one))
    shared = criteria.where("item_idx is null").groupBy("dataset").agg(listed.alias("shared"))
    own = criteria.where("item_idx is not null").groupBy("dataset", "item_idx").agg(listed.alias("own"))
    entry = F.struct("criterion_idx", F.struct("verdict", "option_idx", "reason"))
    given = labels.groupBy("dataset", "item_idx").agg(F.map_from_entries(F.collect_list(entry)).alias("given"))
    full = items.join(own, ["dataset", "item_idx"], "left").join(given, ["dataset", "item_idx"], "left").join(shared, "dataset", "left")

    def written(rubric: Column) -> Column:
        bare = F.transform(rubric, lambda c: c.dropFields("criterion_idx"))
        as_dict = F.to_json(F.struct(F.col("guidelines").alias("guidelines"), bare.alias("criteria")))
        return F.when(rubric.isNotNull(), F.when(F.col("guidelines").isNull(), F.to_json(bare)).otherwise(as_dict))

    rubric = F.coalesce("own", "shared")
    last = F.greatest(F.coalesce(F.size(rubric), F.lit(0)) - 1, F.array_max(F.map_keys("given")))
    at = F.when(F.col("given").isNotNull() & (last >= 0), F.sequence(F.lit(0), last))
    label = lambda i: F.coalesce(F.col("given")[i]["verdict"], F.get(F.get(rubric, i)["options"], F.col("given")[i]["option_idx"])["label"])
    reasons = F.transform(at, lambda i: F.col("given")[i]["reason"])
    item = F.struct(
        "item_idx", "submission", "description", F.transform(at, label).alias("ground_truth"),
        F.when(F.exists(reasons, lambda r: r.isNotNull()), reasons).alias("ground_truth_reasons"),
        written(F.col("own")).alias("rubric"), "reference_submission", "prompt",
    )
    parsed = lambda x: x.dropFields("item_idx").withField("rubric", F.try_parse_json(x["rubric"]))
    dataset = full.withColumns({"item": item, "rubric": F.when(F.col("own").isNull(), written(F.col("shared")))}).groupBy("dataset").agg(
        F.max("name").alias("name"), F.try_parse_json(F.max("rubric")).alias("rubric"), F.transform(F.array_sort(F.collect_list("item")), parsed).alias("items")
    )
    dataset.drop("dataset").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def _filled(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with those of ``columns`` (strings, or name:type) that it lacks: null, and "" for dataset."""
    for name, _, kind in (c.partition(":") for c in columns):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("" if name == "dataset" else None).cast(kind or "string"))
    return df


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with digest and the type their first bytes say."""
    files = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 12))
    kind = F.when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif").when(
        head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp"
    )
    return files.select("path", F.sha2("content", 256).alias("digest"), kind.alias("media_type"), "content")
