"""Shared-folder scratch tables and small planning helpers for the corpus operators.

Lineage is cut with written tables, never with executor-local copies: a table written here can be
read again after any executor is lost. The folder is the one the session names in
``spark.checkpoint.dir``; only where that is unset (tests, a laptop) is a local one chosen.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_local_root: list[str] = []

#: Rows and bytes of one Arrow batch: whole texts can be long, so a batch is bounded in both.
ARROW_ROWS = 512
ARROW_BYTES = 4 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share; where the session names none, a temporary one, of this machine and so
    for a local master only."""
    root = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{_SETTING} must name a folder that all executors of {master} share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="quorumlake-"))
        atexit.register(shutil.rmtree, _local_root[0], True)
    return _local_root[0]


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/quorumlake/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder: for when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back with its lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole texts of any length."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES),
    ):
        now = int(spark.conf.get(key, str(most)))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that do not clash with any column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"_q_{name}"
        while candidate.lower() in taken:
            candidate = f"_{candidate}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


#: At most this many keys are handled as hot, whatever the input: a key is hot with at least
#: 1/HOT_KEYS of the rows, so there cannot be more of them.
HOT_KEYS = 1000


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``keyed``, which has one row per key and the key's row count.

    Keys with at least ``max(1000, total / HOT_KEYS)`` rows are at most HOT_KEYS, so their side is
    broadcast and their rows do not move; all other keys meet in an ordinary shuffle join, where no
    key can weigh more than that.
    """
    key = [key] if isinstance(key, str) else key
    least = max(1000, -(-total // HOT_KEYS))
    held = F.broadcast(keyed.where(F.col(count) >= least))
    mark = fresh(rows, "hot")[0]
    flagged = rows.join(F.broadcast(held.select(*key, F.lit(True).alias(mark))), key, "left")
    return (
        flagged.where(F.col(mark)).drop(mark).join(held, key)
        .unionByName(flagged.where(F.col(mark).isNull()).drop(mark).join(keyed.where(F.col(count) < least), key))
    )


def join_salted(rows: DataFrame, keyed: DataFrame, key: str, total: int, spread_by: str, counted: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` to ``keyed``, which has one row per key and may be too large to broadcast.

    A key with at least ``max(1000, total / HOT_KEYS)`` rows is dealt over as many copies of its row in
    ``keyed`` as it has such shares, by hash of ``spread_by``: at most HOT_KEYS copies are added. Keys are
    counted in ``counted``, by default in ``rows``.
    """
    least = max(1000, -(-total // HOT_KEYS))
    salt, copies = fresh(rows, "salt", "copies")
    per = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias(copies)).where(F.col(copies) >= least)
    hot = F.broadcast(per.select(key, F.ceil(F.col(copies) / least).cast("int").alias(copies)))
    dealt = rows.join(hot, key, "left").withColumn(salt, F.when(F.col(copies).isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by), F.col(copies)))).drop(copies)
    spread = keyed.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1))).drop(copies)
    return dealt.join(spread.withColumn(salt, F.col(salt).cast("long")), [key, salt]).drop(salt)


def released() -> None:
    """Give memory that a task's batches used back to the system, as Python workers are used again."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def utf8(text: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
