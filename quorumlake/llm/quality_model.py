"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting visits the features in turn; at each visit a shallow tree over that feature's bins is fitted
to the gradient and added, shrunk, to the feature's lookup table. The pairs whose joint bins explain
most of what is left get tables of their own, boosted the same way. A score is the sum of one table
entry for each feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches, released, utf8
from .text_features import NAMES, matrix

#: The most labelled rows a model is fitted on: a random sample by hash of the id beyond that.
MAX_FIT_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


@dataclass
class AdditiveModel:
    """Bin edges of each feature, a table for each feature and for each pair, and the base rate."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 8, rounds: int = 120, pair_rounds: int = 40,
            n_pairs: int = 6, rate: float = 0.15, splits: int = 3, ridge: float = 2.0) -> AdditiveModel:
        """Deterministic for given rows in a given order. Without rows or with one class, the base rate alone."""
        y = y.astype(float)
        base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
        model = AdditiveModel(edges, float(base), [np.zeros(len(e) + 1) for e in edges])
        if len(np.unique(y)) < 2:
            return model
        binned = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
        score = np.full(len(y), base)
        for _ in range(rounds):
            for k, b in enumerate(binned):
                step = _tree(b, len(model.tables[k]), score, y, splits, ridge) * rate
                model.tables[k] += step
                score += step[b]
        coarse_edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, pair_bins + 1)[1:-1])) for k in range(x.shape[1])]
        coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse_edges)]
        gains = []
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                width = len(coarse_edges[j]) + 1
                g, h = _sums(coarse[i] * width + coarse[j], (len(coarse_edges[i]) + 1) * width, score, y)
                gains.append((float((g**2 / (h + ridge)).sum()), i, j))
        model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
        model.pair_edges = coarse_edges
        cells = [coarse[i] * (len(coarse_edges[j]) + 1) + coarse[j] for i, j in model.pairs]
        shapes = [(len(coarse_edges[i]) + 1, len(coarse_edges[j]) + 1) for i, j in model.pairs]
        model.pair_tables = [np.zeros(a * b) for a, b in shapes]
        for _ in range(pair_rounds):
            for p, (cell, shape) in enumerate(zip(cells, shapes)):
                step = _pair_tree(cell, shape, score, y, ridge) * rate
                model.pair_tables[p] += step
                score += step[cell]
        return model

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1."""
        out = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, k], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            a, b = self.pair_edges[i], self.pair_edges[j]
            out += t[np.searchsorted(a, x[:, i], side="right") * (len(b) + 1) + np.searchsorted(b, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _sums(cell: np.ndarray, n: int, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-score))
    return np.bincount(cell, y - p, n), np.bincount(cell, p * (1 - p), n)


def _tree(cell: np.ndarray, n: int, score: np.ndarray, y: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """Leaf values by bin of a tree of at most ``splits`` splits of the bins' order, best first."""
    g, h = (np.concatenate([[0.0], np.cumsum(s)]) for s in _sums(cell, n, score, y))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    cuts = [0, n]
    for _ in range(splits):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                own = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(own.argmax())
                best = max(best, (float(own[k]), int(at[k])), key=lambda z: z[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(n)
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _pair_tree(cell: np.ndarray, shape: tuple[int, int], score: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values by cell of the best tree that splits once on each feature of the pair."""
    g, h = (s.reshape(shape) for s in _sums(cell, shape[0] * shape[1], score, y))
    cg, ch = (np.pad(s, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for s in (g, h))
    best, out = -1.0, np.zeros(shape)
    for i in range(1, shape[0]):
        for j in range(1, shape[1]):
            value, leaves = 0.0, []
            for a, b in ((0, i), (i, shape[0])):
                for c, d in ((0, j), (j, shape[1])):
                    gs = cg[b, d] - cg[a, d] - cg[b, c] + cg[a, c]
                    hs = ch[b, d] - ch[a, d] - ch[b, c] + ch[a, c]
                    value += gs**2 / (hs + ridge)
                    leaves.append(((a, b, c, d), gs / (hs + ridge)))
            if value > best:
                best = value
                for (a, b, c, d), v in leaves:
                    out[a:b, c:d] = v
    return out.ravel()


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _featured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(list(matrix(texts.tolist())))
    released()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, learn: Column, most: int) -> DataFrame:
    """Rows of ``docs`` with a label (column ``y``) that ``learn`` allows, at most about ``most`` by hash of the id.

    The sampled ids, which ``most`` bounds, are broadcast, so no text moves.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
    n = own.count()
    if n > most:
        own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < F.lit(int(most / n * (1 << 20))))
    own = own.groupBy(F.col("doc_id").alias("_label_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return docs.join(F.broadcast(own), docs[id_col] == own["_label_id"]).drop("_label_id")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_FIT_ROWS) -> AdditiveModel:
    """The model of at most about ``most`` labelled rows outside the held-out fold. The driver gets
    their features, 8 bytes each, not their texts."""
    bounded_batches(docs.sparkSession)
    featured = F.pandas_udf(_featured, "array<double>")
    rows = labelled_sample(docs.select(id_col, text_col), labels, label, id_col, fold("doc_id", FOLDS) != HELD_OUT, most)
    got = rows.select(F.col(id_col).alias("id"), "y", featured(utf8(text_col)).alias("x")).collect()
    got.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    x = np.array([r["x"] for r in got], np.float64).reshape(len(got), len(NAMES))
    return AdditiveModel.fit(x, np.array([r["y"] for r in got]))


def scored(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> Column:
    """The score of each row's whole text as a Column."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.scores(matrix(texts.tolist())))
        released()

    return F.pandas_udf(score, "double")(utf8(text_col))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (score >= threshold).

    A null text counts as empty and gets the score of a text without words; null ids are scored like
    all others and never learnt from; of repeated labels the higher counts, and repeated rows are scored
    each. Texts are read whole, whatever their length; other columns, whatever their names, are not read.
    Without labels, or with one class, all scores are the base rate. An empty table gives no rows.
    """
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    return docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), scored(docs, model, text_col).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
