"""Bloom filters that find possibly repeated 64-bit hashes with bounded memory.

A cell counts hits up to two. A hash whose two cells were both hit twice may be repeated; any other
hash is certainly unique. Tasks send the cells they hit, slices of the cell range are merged in
parallel, and only the "hit twice" bits are broadcast: ``cells / 8`` bytes, at most MAX_CELLS / 8.
A filter has CELLS_PER_ROW cells for each row, and fewer for more rows than that many cells serve, down
to LEAST_PER_ROW, where about one unique hash in fourteen passes. Still more hashes are split into
rounds by hash: each round is a part of a written table, so that its filter reads that part alone.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import scratch_path

#: Cells for each row, the least of them, and the most that one filter holds (32 MB of bits).
CELLS_PER_ROW, LEAST_PER_ROW = 16, 2
MAX_CELLS = 1 << 28
SLICE = 1 << 20
_FLUSH = 1 << 21
#: Rounds that run at the same time, each with a filter of its own.
ROUNDS_AT_ONCE = 4


def _cells(h: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64) if h.dtype == np.int64 else h.astype(np.uint64)
    shift = np.uint64(64 - log2)
    a = (u * np.uint64(0x9E3779B97F4A7C15)) >> shift
    b = ((u ^ (u >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift
    return a.astype(np.int64), b.astype(np.int64)


def rounds_for(rows: int, max_cells: int = MAX_CELLS) -> int:
    """Filters that so many rows need."""
    return max(1, -(-rows * LEAST_PER_ROW // max_cells))


def round_of(h: Column, rounds: int) -> Column:
    return F.pmod(F.shiftright(h, 17), F.lit(rounds)).cast("int")


def _hit(hashes: DataFrame, name: str, log2: int, most: int = 2) -> bytes:
    """The bits of cells hit ``most`` times or more; ``most`` 1 is the ordinary Bloom filter."""

    def send(batches):
        def flush(parts):
            cells, n = np.unique(np.concatenate(parts), return_counts=True)
            cuts = np.searchsorted(cells, np.arange(0, (1 << log2) + SLICE, SLICE))
            for s in np.flatnonzero(np.diff(cuts)):
                at = slice(cuts[s], cuts[s + 1])
                own, twice = (cells[at] - s * SLICE).astype("<u4"), n[at] > 1
                yield {"slice": int(s), "once": own[~twice].tobytes(), "twice": own[twice].tobytes()}

        held, size = [], 0
        for pdf in batches:
            a, b = _cells(pdf[name].to_numpy(np.int64), log2)
            held += [a, b[b != a]]
            size += 2 * len(a)
            if size >= _FLUSH:
                yield pd.DataFrame(list(flush(held)))
                held, size = [], 0
        if size:
            yield pd.DataFrame(list(flush(held)))

    def merge(key, pdf):
        hits = np.zeros(SLICE, np.uint8)
        for once, twice in zip(pdf["once"], pdf["twice"]):
            own = np.frombuffer(once, "<u4")
            hits[own] = np.minimum(hits[own] + 1, 2)
            hits[np.frombuffer(twice, "<u4")] = 2
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(hits >= most).tobytes()]})

    sent = hashes.select(name).mapInPandas(send, "slice int, once binary, twice binary")
    merged = sent.groupBy("slice").applyInPandas(merge, "slice int, bits binary").collect()
    bits = np.zeros(max(SLICE, 1 << log2) // 8, np.uint8)
    for row in merged:
        bits[row["slice"] * (SLICE // 8) :][: SLICE // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits.tobytes()


def _log2_for(rows: int, max_cells: int) -> int:
    return min(int(math.log2(max_cells)), max(10, math.ceil(math.log2(max(1, rows) * CELLS_PER_ROW))))


def _member(spark, h: Column, bits: bytes, log2: int) -> Column:
    held = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def in_filter(s: pd.Series) -> pd.Series:
        cells = np.frombuffer(held.value, np.uint8)
        out = np.ones(len(s), bool)
        for c in _cells(s.to_numpy(np.int64), log2):
            out &= (cells[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(out)

    return in_filter(h)


def possibly_repeated(hashes: DataFrame, name: str, rows: int, max_cells: int = MAX_CELLS):
    """First pass over ``hashes[name]`` (non-null longs); returns the second pass's test, a function
    from a hash Column to a boolean Column that is false only for hashes that occur once.

    One filter: where there are more ``rows`` than it serves, all hashes pass (see ``in_rounds``).
    """
    if rounds_for(rows, max_cells) > 1:
        return lambda h: F.lit(True)
    log2 = _log2_for(rows, max_cells)
    bits = _hit(hashes, name, log2)
    return lambda h: _member(hashes.sparkSession, h, bits, log2)


def in_rounds(hashes: DataFrame, name: str, rows: int, max_cells: int = MAX_CELLS) -> DataFrame:
    """``hashes`` with ``maybe``, false only for rows whose hash occurs once.

    What one filter cannot serve is written by round, and each round's part is filtered, tested and
    written by itself, ROUNDS_AT_ONCE of them at a time: a row is read three times whatever the number of rounds.
    """
    rounds = rounds_for(rows, max_cells)
    if rounds == 1:
        return hashes.withColumn("maybe", possibly_repeated(hashes, name, rows, max_cells)(F.col(name)))
    spark = hashes.sparkSession
    path, out = scratch_path(spark, "rounds"), scratch_path(spark, "tested")
    # each round's rows are dealt over a few tasks, so that files are as many as tasks and not tasks times rounds
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // rounds))
    dealt = hashes.withColumn("round", round_of(F.col(name), rounds)).repartition(rounds * salts, "round", F.pmod(F.col(name), F.lit(salts)))
    dealt.write.partitionBy("round").parquet(path)

    def one(r: int) -> None:
        try:
            own = spark.read.schema(hashes.schema).parquet(f"{path}/round={r}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        own.withColumn("maybe", possibly_repeated(own, name, -(-rows // rounds), max_cells)(F.col(name))).write.parquet(f"{out}/round={r}")

    with ThreadPoolExecutor(ROUNDS_AT_ONCE) as pool:
        list(pool.map(one, range(rounds)))
    return spark.read.schema(hashes.withColumn("maybe", F.lit(True)).schema).option("recursiveFileLookup", True).parquet(out)


def possibly_in(hashes: DataFrame, name: str, rows: int, max_cells: int = MAX_CELLS):
    """An ordinary Bloom filter of ``hashes[name]``: the test is false only for hashes not in it, and for none where
    there are more than one filter serves."""
    if rounds_for(rows, max_cells) > 1:
        return lambda h: F.lit(True)
    log2 = _log2_for(rows, max_cells)
    bits = _hit(hashes, name, log2, most=1)
    return lambda h: _member(hashes.sparkSession, h, bits, log2)
