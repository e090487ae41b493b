"""Embedding whitening by hierarchical merging of singular value decompositions.

Each partition of vectors is summed up by its number, its exact sums and all singular values and right
vectors of its centred rows. Two such summaries merge into one: the weighted singular vectors of both
are stacked, a row that corrects for the difference of the means is appended, and the stack is decomposed
again. No dimension is dropped, so nothing is lost but rounding. Summaries are merged in groups of a few,
round by round, until one is left: its squares over n are the eigenvalues of the covariance, and no
covariance matrix, which would square the error, is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .scratch import bounded_batches, released, stored

#: Entries c become x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Rows that are decomposed at a time, besides four for each dimension.
ROWS = 1024
#: Bytes of the summaries that one merging task holds; at least two are merged.
MERGED_BYTES = 64 << 20
COMPONENTS = 8
#: The exact sums are held as decimals: 18 digits for x, 20 for the number of rows.
SUMMARY = "dims int, part long, n long, sums array<decimal(38,0)>, weighted binary"
_ARROW = pa.schema([("dims", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("weighted", pa.binary())])
_LOW = np.int64((1 << 32) - 1)


def integers(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Lengths of the usable vectors of an Arrow list column (-1 for others) and, for each length, places and x-vectors.

    A vector is usable if neither it nor an entry is null, all are finite and every x is below 2**61.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(-1), dtype=np.int64)
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(values * SCALE)
        bad = ~(np.abs(x) < 2.0**61)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    sizes[(sizes > 0) & (wrong[starts[1:]] > wrong[starts[:-1]])] = -1
    out = []
    for dims in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dims)
        out.append((at, x[starts[at][:, None] + np.arange(dims)].astype(np.int64) + SHIFT))
    return sizes, out


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of columns as Python integers: halves of 32 bits cannot overflow within a batch."""
    return (x >> 32).sum(0).astype(object) * (1 << 32) + (x & _LOW).sum(0).astype(object)


def _triangle(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors of ``rows``: as many rows as their rank can be."""
    _, s, v = np.linalg.svd(np.linalg.qr(rows, mode="r"), full_matrices=False)
    return s[:, None] * v


def summary(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, weighted vectors) of the rows ``x`` of longs. Rows are centred by their exact mean, in whole
    numbers as far as they go."""
    n, sums = len(x), exact_sums(x)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - int(w) * n) / n for s, w in zip(sums, whole)])
    return n, sums, _triangle((x - whole).astype(np.float64) - rest)


def merged(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """The summary of both: the mean correction is sqrt(na nb / (na + nb)) times the difference of the means,
    which is worked out in whole numbers."""
    (na, sa, wa), (nb, sb, wb) = a, b
    apart = np.array([(p * nb - q * na) / (na * nb) for p, q in zip(sa, sb)], np.float64)
    correction = np.sqrt(na) * np.sqrt(nb / (na + nb)) * apart
    return na + nb, sa + sb, _triangle(np.vstack([wa, wb, correction]))


def _row(dims: int, part: int, held: tuple) -> dict:
    n, sums, weighted = held
    return {"dims": dims, "part": part, "n": int(n), "sums": [Decimal(int(s)) for s in sums], "weighted": weighted.astype("<f8").tobytes()}


def _held(dims: int, n: int, sums, weighted: bytes) -> tuple:
    return int(n), np.array([int(s) for s in sums], object), np.frombuffer(weighted, "<f8").reshape(-1, dims)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary for each length of the partition's vectors."""
    held, waiting = {}, {}

    def flush(dims: int) -> None:
        own = summary(np.concatenate(waiting.pop(dims)))
        held[dims] = merged(held[dims], own) if dims in held else own

    for batch in batches:
        for _, x in integers(batch.column(0))[1]:
            dims = x.shape[1]
            waiting.setdefault(dims, []).append(x)
            if sum(map(len, waiting[dims])) >= ROWS + 4 * dims:
                flush(dims)
    for dims in list(waiting):
        flush(dims)
    part = TaskContext.get().partitionId()
    if held:
        yield pa.RecordBatch.from_pylist([_row(d, part, h) for d, h in held.items()], _ARROW)
    released()


def _merge_group(pdf: pd.DataFrame, fanout: int) -> pd.DataFrame:
    dims, held = int(pdf["dims"].iloc[0]), None
    for row in pdf.sort_values("part").itertuples():
        own = _held(dims, row.n, row.sums, row.weighted)
        held = merged(held, own) if held else own
    return pd.DataFrame([_row(dims, int(pdf["part"].min()) // fanout, held)])


class Whitening(NamedTuple):
    """Of the x-vectors fitted on: their number, exact sums, covariance's trace, and its largest eigenvalues,
    falling, with their vectors as rows. An eigenvalue within rounding of none is 0."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fits on all usable vectors of the most frequent length, of equally frequent ones the longest; None without any.

    What the driver gets is one summary: as many rows as dimensions.
    """
    bounded_batches(vectors.sparkSession)
    parts = stored(vectors.select(F.col(vector_col).alias("v")).mapInArrow(_summed, SUMMARY), "whitening-parts")
    usual = parts.groupBy("dims").agg(F.sum("n").alias("n"), F.max("part").alias("last")).orderBy(F.desc("n"), F.desc("dims")).first()
    if usual is None:
        return None
    dims, last = usual["dims"], usual["last"]
    fanout = int(max(2, min(64, MERGED_BYTES // (8 * dims * dims))))
    left = parts.where(F.col("dims") == dims)
    while last:
        left = left.groupBy(F.floor(F.col("part") / fanout).alias("group")).applyInPandas(lambda pdf: _merge_group(pdf, fanout), SUMMARY)
        last //= fanout
    row = left.first()
    n, sums, weighted = _held(dims, row["n"], row["sums"], row["weighted"])
    _, s, v = np.linalg.svd(weighted, full_matrices=False)
    values = np.where(s > s[0] * max(dims, n) ** 0.5 * np.finfo(float).eps * 8, s, 0.0)[:components] ** 2 / n
    return Whitening(n, [int(x) for x in sums], float((s**2).sum() / n), values, v[: len(values)])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x less its mean as doubles, and the exact sums over dimensions of (n * x - sums) ** 2, as longs if they
    surely fit and else as Python integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    own = x - whole
    most = (int(np.abs(own).max(initial=0)) + 1) * n
    if most * most * x.shape[1] < 2**62:
        return own - rest / n, ((own * n - rest) ** 2).sum(1)
    return own - rest / n, ((own.astype(object) * n - rest.astype(object)) ** 2).sum(1)


def _projected(batches: Iterator[pa.RecordBatch], model: Whitening, ids: pa.DataType) -> Iterator[pa.RecordBatch]:
    dims, scale = len(model.sums), np.sqrt(np.where(model.values > 0, model.values, np.nan))
    for batch in batches:
        for at, x in integers(batch.column(1))[1]:
            if x.shape[1] != dims:
                continue
            centred, exact = deviations(x, model.n, model.sums)
            z = centred @ model.vectors.T / scale
            fits = [int(d) if d < 2**63 else None for d in exact]
            flat = pa.array(z.ravel(), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)).cast(ids), pa.array(fits, pa.int64()),
                    pa.array([None if f is not None else str(d) for d, f in zip(exact, fits)], pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), flat),
                ],
                ["vec_id", "deviation", "deviation_digits", "z"],
            )
    released()


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        z = np.nan_to_num(np.asarray(batch.column(0).flatten().fill_null(0.0), np.float64).reshape(batch.num_rows, -1))
        if len(z):
            own = np.column_stack([np.ones(len(z)), z])
            total = own.T @ own + (0 if total is None else total)
    if total is not None:
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])


def identity_error(projected: DataFrame, model: Whitening) -> float | None:
    """The largest entry, by amount, of the covariance of ``z`` over all rows less the identity; null without a component."""
    on = np.flatnonzero(model.values > 0)
    if not len(on):
        return None
    sums = projected.select("z").mapInArrow(_products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    k = len(model.values) + 1
    total = np.zeros((k, k))
    for r in sums:
        total[r["i"], r["j"]] = r["s"]
    mean = total[0, 1:] / model.n
    covariance = total[1:, 1:] / model.n - np.outer(mean, mean)
    return float(np.abs(covariance[np.ix_(on, on)] - np.eye(len(on))).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row and component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error, deviation_digits.

    Rows are dropped whose vector is null or empty, holds null or non-finite entries or entries whose x is
    2**61 or more, or is not of the most frequent length. Null and repeated ids are kept, each row by itself. There
    are as many components as dimensions, ``components`` at most; one whose eigenvalue is 0 has null for
    ``whitened`` and is not in ``identity_error``. ``deviation`` is null where it fits no long, and its digits
    are in ``deviation_digits`` then. Other columns, whatever their names, are not read. An empty table gives
    no rows.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    schema = StructType([StructField("vec_id", kind), *StructType.fromDDL("deviation long, deviation_digits string, z array<double>").fields])
    read = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    model = fit(vectors, vector_col, components)
    if model is None:
        held, error, shares = spark.createDataFrame([], schema), None, [None]
    else:
        ids = to_arrow_type(kind)
        held = stored(read.mapInArrow(partial(_projected, model=model, ids=ids), schema), "whitened")
        error, shares = identity_error(held, model), [float(e / model.trace) if model.trace else None for e in model.values]
    exploded = held.select("*", F.posexplode("z").alias("place", "whitened"))
    return exploded.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_digits",
    )
