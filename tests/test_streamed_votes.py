"""Votes as a stream of cell states: repeated and late votes, several panels, and the size of what a batch touches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake import schema
from quorumlake.rubric import Criterion, Rubric
from quorumlake.streaming import votes as stream


def test_states_of_cells(spark, tmp_path):
    rubric = Rubric((Criterion("a"),)).table(spark)
    path, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def send(*rows):
        given = [(i, 0, j, 0, 1.0, role, v, None, None, None, {"MET": 0.5}, 0.5, superseded) for i, j, v, role, superseded in rows]
        spark.createDataFrame(given, schema.VOTES).coalesce(1).write.mode("append").parquet(path)
        stream.aggregate_cells(stream.vote_stream(spark, path), rubric, sink, checkpoint).awaitTermination()

    send((0, "a", "MET", "primary", False), (1, "a", "MET", "primary", False))
    send((0, "b", "UNMET", "primary", False), (0, "c", "UNMET", None, False))
    send((0, "b", "UNMET", "primary", False), (0, "c", "UNMET", "primary", False))  # the same again
    batches = {r.batch: r["count"] for r in spark.read.parquet(sink).groupBy("batch").count().collect()}
    assert batches == {0: 2, 1: 1, 2: 1}  # a batch writes its own cells only
    got = {r.item_idx: (r.final_verdict, r.n_votes) for r in stream.latest_reports(spark, sink).collect()}
    assert got == {0: ("UNMET", 3), 1: ("MET", 1)}
    send((1, "a", "UNMET", "primary", False))  # a judge that changes its mind
    send((0, "a", "MET", "primary", True), (0, "b", "UNMET", "primary", True), (0, "c", "UNMET", "primary", True), (0, "d", "MET", "escalation", False))
    got = {r.item_idx: (r.final_verdict, r.n_votes) for r in stream.latest_reports(spark, sink).collect()}
    assert got == {0: ("MET", 1), 1: ("UNMET", 1)}
    stream.compact_reports(spark, sink, str(tmp_path / "small"))
    assert {r.item_idx: r.final_verdict for r in stream.latest_reports(spark, str(tmp_path / "small")).collect()} == {0: "MET", 1: "UNMET"}


def test_votes_keep_their_fields(spark, tmp_path):
    path = str(tmp_path / "in")
    row = (2**60 + 1, 3, "j", 7, 2.5, "primary", None, 4, "parse: x", "why", {"0": 0.25, "4": 0.75}, None, False)
    spark.createDataFrame([row], schema.VOTES).write.parquet(path)
    held = []
    query = stream.cell_votes(stream.vote_stream(spark, path)).writeStream.outputMode("update").foreachBatch(lambda df, _: held.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in held] == [row]


def test_neighbouring_cells_share_a_state(spark, tmp_path):
    path, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    rubric = Rubric(tuple(Criterion(f"c{i}") for i in range(4))).table(spark)
    cells = spark.range(64).selectExpr("id AS item_idx", "explode(sequence(0, 3)) AS criterion_idx")
    before, own = dict(spark.conf.getAll), schema.VOTES.split(", ")[2:]

    def send(judge, where):
        values = {"judge_id": f"'{judge}'", "judge_ord": "0", "judge_weight": "1.0D", "role": "'primary'", "verdict": "IF(item_idx % 2 = 0, 'MET', 'UNMET')", "superseded": "false"}
        rows = cells.where(where).selectExpr("item_idx", "criterion_idx", *(f"CAST({values.get(f.split()[0], 'NULL')} AS {f.split()[1]}) AS {f.split()[0]}" for f in own))
        rows.coalesce(1).write.mode("append").parquet(path)
        query = stream.aggregate_cells(stream.vote_stream(spark, path), rubric, sink, checkpoint)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]

    assert send("a", "true")["numRowsTotal"] == 4  # not one of each of 256 cells
    later = send("b", "item_idx = 17 AND criterion_idx = 2")
    assert later["numRowsTotal"] == 4 and later["numRowsUpdated"] == 1
    batches = {r.batch: r["count"] for r in spark.read.parquet(sink).groupBy("batch").count().collect()}
    assert batches == {0: 256, 1: 1}
    got = {(r.item_idx, r.criterion_idx): (r.final_verdict, r.n_votes) for r in stream.latest_reports(spark, sink).collect()}
    assert got == {(i, c): ("UNMET" if i % 2 else "MET", 1 + ((i, c) == (17, 2))) for i in range(64) for c in range(4)}
    assert dict(spark.conf.getAll) == before
