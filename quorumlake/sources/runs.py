"""Runs: votes, criterion reports and item scores of an evaluation, as tables and as JSON lines.

Tables are partitioned by run and attempt. What an attempt writes does not count until its commit record is there,
which is written last: a run that stops at any moment and is taken up again has every vote once.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = ("scores", "reports", "votes")
_CAST = ("judge_ord", "judge_id", "verdict", "option_idx", "error", "reason", "confidence", "superseded", "judge_weight", "role")
_REPORT = ("criterion_idx", "weight", "scale", "final_verdict", "option_idx", "value", "na", "aggregated_value", "n_votes", "agreement", "error", "final_reason")
_VOTE_SCHEMA = "struct<judge_ord:int,judge_id:string,verdict:string,option_idx:int,error:string,reason:string,confidence:double,superseded:boolean,judge_weight:double,role:string>"
_REPORT_SCHEMA = (
    "struct<criterion_idx:int,weight:double,scale:string,final_verdict:string,option_idx:int,value:double,na:boolean,aggregated_value:double,n_votes:bigint,"
    f"agreement:double,error:string,final_reason:string,votes:array<{_VOTE_SCHEMA}>>"
)
#: One line per item: the item's report holds its criteria's, and these hold their votes.
RECORD = (
    "item_idx bigint, duration_seconds double, error string, report struct<score:double,raw_score:double,error:string,cannot_assess_count:bigint,mean_agreement:double,"
    f"completion_cost:double,report_type:string,judge_scores:map<string,double>,criterion_reports:array<{_REPORT_SCHEMA}>>"
)


def append(df: DataFrame, path: str, table: str, run_id: str, attempt: str | None = None) -> DataFrame:
    """Adds rows to a table of the run. They count once their attempt is committed (see ``commit``); without an
    ``attempt`` they are one by themselves, and the run's rows of the table are returned."""
    own = attempt or uuid.uuid4().hex
    df.drop("superseded").withColumns({"run_id": F.lit(run_id), "attempt": F.lit(own)}).write.mode("append").partitionBy("run_id", "attempt").parquet(f"{path}/{table}")
    if attempt is None:
        commit(df.sparkSession, path, run_id, own)
        return read(df.sparkSession, path, table, run_id)
    return written(df.sparkSession, path, table, run_id, attempt, df.drop("superseded"))


def written(spark: SparkSession, path: str, table: str, run_id: str, attempt: str, like: DataFrame) -> DataFrame:
    """What an attempt has written of a table, committed or not."""
    own = _there(lambda: spark.read.schema(like.schema).parquet(f"{path}/{table}/run_id={run_id}/attempt={attempt}"))
    return spark.createDataFrame([], like.schema) if own is None else own


def commit(spark: SparkSession, path: str, run_id: str, attempt: str) -> None:
    """Makes all rows that the attempt wrote, in all tables, rows of the run, at once: one record, written last."""
    record = spark.range(1).select(F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at"), F.lit(run_id).alias("run_id"))
    record.coalesce(1).write.mode("append").partitionBy("run_id").parquet(f"{path}/commits")


def committed(spark: SparkSession, path: str, run_id: str) -> list[str]:
    """The attempts of the run that have come to their end; there are as many as times it was taken up again."""
    rows = _there(lambda: spark.read.schema("attempt string, at timestamp, run_id string").parquet(f"{path}/commits").where(F.col("run_id") == run_id).select("attempt").distinct().collect())
    return sorted(r["attempt"] for r in rows or [])


def _there(load):
    """What ``load`` gives, or None where there is no such path."""
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read(spark: SparkSession, path: str, table: str, run_id: str) -> DataFrame | None:
    """The run's rows of a table, or None where there is none; rows of attempts that stopped, and other runs, are not read.

    A vote is superseded where the escalation panel has voted on its cell.
    """
    if table not in TABLES:
        raise ValueError(f"a run has {', '.join(TABLES)}, not {table!r}")
    done = committed(spark, path, run_id)
    if not done:
        return None
    rows = _there(lambda: spark.read.option("mergeSchema", True).parquet(f"{path}/{table}"))
    if rows is None:
        return None
    own = rows.where((F.col("run_id") == run_id) & F.col("attempt").isin(done)).drop("run_id", "attempt")
    return with_superseded(own) if table == "votes" else own


def with_superseded(votes: DataFrame) -> DataFrame:
    """Votes with superseded: of a cell that the escalation panel has voted on, the first panel's are."""
    if "role" not in votes.columns:
        return votes.withColumn("superseded", F.lit(False))
    again = F.max(F.when(F.col("role") == "escalation", 1).otherwise(0)).over(Window.partitionBy("item_idx", "criterion_idx"))
    return votes.withColumn("superseded", (F.col("role") != "escalation") & (again == 1))


def manifest(spark: SparkSession, path: str, run_id: str, total: int) -> dict:
    """Status, items done and failed and the last of them, from what the run has stored: nothing else is kept
    that could disagree with it."""
    scores = read(spark, path, "scores", run_id)
    if scores is None:
        return {"run_id": run_id, "status": "pending", "total_items": total, "completed": 0, "failed": 0}
    row = scores.agg(F.count("*").alias("n"), F.count("error").alias("failed")).first()
    status = "completed" if row["n"] >= total else "running" if row["n"] else "pending"
    return {"run_id": run_id, "status": status, "total_items": total, "completed": row["n"], "failed": row["failed"]}


def successful(scores: DataFrame, scored: bool = False) -> DataFrame:
    """Items without an error; ``scored``: that have a score too."""
    return scores.where("error is null and score is not null" if scored else "error is null")


def failed(scores: DataFrame) -> DataFrame:
    return scores.where("error is not null")


def records(scores: DataFrame, reports: DataFrame, votes: DataFrame, judge_scores: DataFrame | None = None) -> DataFrame:
    """RECORD rows of a run. Columns that a table lacks are null."""
    given = lambda df, c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    cast = F.struct(*[given(votes, c, {"judge_ord": "int", "confidence": "double", "superseded": "boolean", "judge_weight": "double", "option_idx": "int"}.get(c, "string")).alias(c) for c in _CAST])
    per_cell = votes.groupBy("item_idx", "criterion_idx").agg(F.array_sort(F.collect_list(cast)).alias("votes"))
    own = reports.join(per_cell, ["item_idx", "criterion_idx"], "left")
    per_item = own.groupBy("item_idx").agg(F.array_sort(F.collect_list(F.struct(*_REPORT, "votes"))).alias("criterion_reports"), F.count_distinct("n_votes").alias("_k"))
    full = scores.join(per_item, "item_idx", "left")
    if judge_scores is not None:
        per_judge = judge_scores.groupBy("item_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("judge_id", "score")))).alias("judge_scores"))
        full = full.join(per_judge, "item_idx", "left")
    report = F.struct(
        "score", "raw_score", F.col("error").alias("error"), "cannot_assess_count", "mean_agreement", given(full, "completion_cost", "double").alias("completion_cost"),
        F.when(F.coalesce(F.array_max(F.transform("criterion_reports", lambda r: r["n_votes"])), F.lit(0)) > 1, "ensemble").otherwise("single").alias("report_type"),
        given(full, "judge_scores", "map<string,double>").alias("judge_scores"), "criterion_reports",
    )
    return full.select("item_idx", given(full, "duration_seconds", "double").alias("duration_seconds"), "error", report.alias("report"))


def write_records(rows: DataFrame, path: str, run_id: str) -> None:
    """Append RECORD rows as JSON lines, a folder for each run."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)


def read_records(spark: SparkSession, path: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """``scores``, ``reports`` and ``votes`` of JSON lines that ``write_records`` wrote."""
    rows = spark.read.schema(f"{RECORD}, run_id string").json(path)
    rows = (rows if run_id is None else rows.where(F.col("run_id") == run_id)).drop("run_id")
    scores = rows.select(
        "item_idx", "duration_seconds", F.coalesce("error", "report.error").alias("error"), "report.score", "report.raw_score", "report.mean_agreement",
        "report.cannot_assess_count", "report.completion_cost", "report.report_type", "report.judge_scores",
    )
    each = rows.select("item_idx", F.explode("report.criterion_reports").alias("r"))
    cast = each.select("item_idx", "r.criterion_idx", F.explode("r.votes").alias("v"))
    return {"scores": scores, "reports": each.select("item_idx", *[f"r.{c}" for c in _REPORT]), "votes": cast.select("item_idx", "criterion_idx", "v.*")}
