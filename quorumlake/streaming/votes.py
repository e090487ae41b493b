"""Votes that arrive as files are aggregated as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.voting import aggregate_votes
from ..schema import VOTES

#: Parts of the stored votes, by hash of the item: a batch reads the parts of its own items only.
BUCKETS = 64


def vote_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(VOTES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def aggregate_stream(votes: DataFrame, criteria: DataFrame, store: str, sink: str, checkpoint: str, buckets: int = BUCKETS, **how) -> StreamingQuery:
    """Keeps all votes in ``store``, by bucket of the item, and appends to ``sink`` the new reports of the
    cells that a batch touches, with the batch's number: the last one of a cell counts.

    A batch that is run again writes the same folders again, so nothing is counted twice. It reads the
    buckets of its items, not the whole history.
    """

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        bucket = F.pmod(F.xxhash64("item_idx"), F.lit(buckets)).cast("int")
        new.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")
        own = spark.read.parquet(f"{store}/batch={number}")
        touched = own.select("bucket", "item_idx", "criterion_idx").distinct()
        parts = [r[0] for r in touched.select("bucket").distinct().collect()]  # at most ``buckets``
        seen = spark.read.parquet(store).where((F.col("batch") <= number) & F.col("bucket").isin(parts)).drop("batch", "bucket")
        reports = aggregate_votes(seen.join(touched.drop("bucket"), ["item_idx", "criterion_idx"], "left_semi"), criteria, **how)
        reports.drop("options").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return votes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A vote without its cell, and a vote on its way through the states.
_OWN = [f.strip().split()[0] for f in VOTES.replace("map<string,double>", "map").split(",")][2:]
_VOTE = ", ".join(VOTES.split(", ")[2:])
#: A state has the cells of so many neighbouring items and criteria (powers of two, as shifts).
ITEM_BITS, CRITERION_BITS = 4, 3
#: States are on the executors' disks: their number is that of all cells, which no heap holds.
STATES = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def cell_votes(votes: DataFrame) -> DataFrame:
    """Of a stream of votes, for each cell that a batch touches, all votes that count so far.

    Of a cell one vote of each judge and role is kept, whatever the number of votes that came: a vote that
    comes again, or late, takes the place of the one before it, and a null role is the primary panel's. A
    state has the cells of at most 16 items and 8 criteria, since a call of Python costs more than a cell; a batch
    reads and writes the states of its own cells, so its cost does not depend on the history.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {tuple(k): vote for *k, vote in zip(*state.get)} if state.exists else {}
        came = [k for pdf in batches for k in zip(pdf["item_idx"].tolist(), pdf["criterion_idx"].tolist(), pdf["voter"], pdf["vote"])]
        held.update((k[:3], k[3]) for k in came)
        state.update(tuple(map(list, zip(*((*k, vote) for k, vote in held.items())))))
        touched = {k[:2] for k in came}
        yield pd.DataFrame([(*k[:2], vote) for k, vote in held.items() if k[:2] in touched], columns=["item_idx", "criterion_idx", "vote"])

    voter = F.concat_ws(":", F.coalesce(F.nullif("role", F.lit("")), F.lit("primary")), "judge_id")
    near = {"items": F.shiftright("item_idx", ITEM_BITS), "criteria": F.shiftright("criterion_idx", CRITERION_BITS)}
    plain = votes.withColumns(near).select(*near, "item_idx", "criterion_idx", voter.alias("voter"), F.to_json(F.struct(*_OWN)).alias("vote"))
    out = plain.groupBy(*near).applyInPandasWithState(
        update, "item_idx long, criterion_idx int, vote string", "items array<long>, criteria array<int>, voters array<string>, votes array<string>", "update", GroupStateTimeout.NoTimeout
    )
    return out.withColumn("v", F.from_json("vote", _VOTE)).select("item_idx", "criterion_idx", "v.*").select(*votes.columns)


def aggregate_cells(votes: DataFrame, criteria: DataFrame, sink: str, checkpoint: str, **how) -> StreamingQuery:
    """Appends to ``sink`` the new reports of the cells that a batch touches, from their states (``cell_votes``), with the
    batch's number: the last one of a cell counts. A batch that is run again writes the same folder again."""

    def batch(cells: DataFrame, number: int) -> None:
        aggregate_votes(cells, criteria, **how).drop("options").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    conf = votes.sparkSession.conf
    before = dict(conf.getAll)
    try:  # a query keeps what holds when it starts
        for k, v in STATES.items():
            conf.set(k, v)
        return cell_votes(votes).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k in STATES:
            conf.set(k, before[k]) if k in before else conf.unset(k)


def compact_reports(spark: SparkSession, sink: str, into: str) -> None:
    """The last report of each cell, as the first batch of a new sink: what later batches are added to."""
    latest_reports(spark, sink).write.mode("overwrite").parquet(f"{into}/batch=-1")


def latest_reports(spark: SparkSession, sink: str) -> DataFrame:
    """The last report of each cell."""
    rows = spark.read.parquet(sink)
    own = [c for c in rows.columns if c not in ("item_idx", "criterion_idx", "batch")]
    return rows.groupBy("item_idx", "criterion_idx").agg(F.max_by(F.struct(*own), "batch").alias("r")).select("item_idx", "criterion_idx", "r.*")
