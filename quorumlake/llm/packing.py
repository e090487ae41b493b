"""Packing by bounded-space best fit: a fixed number of open windows in each partition.

A task cuts full windows off each document and places the rest in the open window it fills best. If
none has room and all windows are open, the fullest is emitted. What is open when the partition ends
is merged: the leftovers of MERGE partitions are joined end to end and cut anew.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .scratch import bounded_batches, stored, utf8

#: Tokens of a sequence, open windows of a partition, partitions whose leftovers meet.
LENGTH = 2048
OPEN = 32
MERGE = 64
#: Sequence ids: the merged leftovers' ids follow all those of the partitions.
_PER_PARTITION = 1 << 32
_MERGED = 1 << 62


class Windows:
    """The open windows of one partition. A piece is (doc, start, ids, tokens of its document), doc an id and whether it is null."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most = length, most
        self.free: list[int] = []
        self.held: list[list[tuple]] = []

    def place(self, piece: tuple) -> list[list[tuple]]:
        """Place a piece shorter than a window; returns the windows that are done by it."""
        need, done = len(piece[2]), []
        best = min((i for i, f in enumerate(self.free) if f >= need), key=self.free.__getitem__, default=-1)
        if best < 0:
            if len(self.free) == self.most:
                done.append(self._close(min(range(len(self.free)), key=self.free.__getitem__)))
            self.free.append(self.length)
            self.held.append([])
            best = len(self.free) - 1
        self.held[best].append(piece)
        self.free[best] -= need
        if not self.free[best]:
            done.append(self._close(best))
        return done

    def _close(self, i: int) -> list[tuple]:
        self.free.pop(i)
        return self.held.pop(i)


def _rows(pieces: list[tuple], sequence: int) -> list[tuple]:
    out, offset = [], 0
    for doc, start, ids, total in pieces:
        out.append((*doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, None, None))
        offset += len(ids)
    return out


_COLUMNS = ["doc_id", "no_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "merge"]


def _pack(batches, path: str, length: int, most: int, end_id: int):
    own, part = encoder(path), TaskContext.get().partitionId()
    windows, sequence = Windows(length, most), part * _PER_PARTITION
    for pdf in batches:
        counts, ids = own.encode(pdf["text"].tolist())
        at, rows = 0, []
        for *doc, n in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), counts.tolist()):
            tokens = np.append(ids[at : at + n], np.uint32(end_id))
            at += n
            for start in range(0, n + 1, length):
                piece = (doc, start, tokens[start : start + length], n + 1)
                for full in [[piece]] if len(piece[2]) == length else windows.place(piece):
                    rows += _rows(full, sequence)
                    sequence += 1
        yield pd.DataFrame(rows, columns=_COLUMNS)
    left = [(*doc, start, len(ids), 0, total, 0, 0, ids.astype("<u4").tobytes(), part // MERGE) for w in windows.held for doc, start, ids, total in w]
    if left:
        yield pd.DataFrame(left, columns=_COLUMNS)


def _merge(key, pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "no_id", "start", "ids"], kind="stable")
    sequence, offset, rows = _MERGED + int(key[0]) * _PER_PARTITION, 0, []
    for *doc, start, raw, total in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["start"].tolist(), pdf["ids"], pdf["doc_tokens"].tolist()):
        ids = np.frombuffer(raw, "<u4")
        while len(ids):
            own = ids[: length - offset]
            rows.append((*doc, start, len(own), zlib.crc32(own.tobytes()), total, sequence, offset))
            start, offset, ids = start + len(own), offset + len(own), ids[len(own) :]
            if offset == length:
                sequence, offset = sequence + 1, 0
    return pd.DataFrame(rows, columns=_COLUMNS[:8])


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Ids are long or
    null and need not differ: a row's pieces are told apart by their sequences. Other columns are not
    read. An empty table gives no rows. Tokenizing happens once, where the text is read; only the
    leftovers, at most ``open_windows`` windows of a partition, are shuffled.
    """
    bounded_batches(docs.sparkSession)
    own = F.col(id_col).cast("long")
    texts = docs.select(F.coalesce(own, F.lit(0)).alias("doc_id"), own.isNull().alias("no_id"), utf8(text_col).alias("text"))
    schema = "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = stored(
        texts.mapInPandas(partial(_pack, path=tokenizer, length=length, most=open_windows, end_id=end_id), schema + ", ids binary, merge int"),
        "packed",
    )
    names = [c.split()[0] for c in schema.split(", ")]
    done = placed.where(F.col("merge").isNull()).select(*names)
    merged = placed.where(F.col("merge").isNotNull()).groupBy("merge").applyInPandas(lambda key, pdf: _merge(key, pdf, length), schema)
    return done.unionByName(merged).withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
