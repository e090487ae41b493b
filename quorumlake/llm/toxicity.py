"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Each lexicon looks at one part of words: the word, its first four, five or six letters, or its last
five. Lexicons are mined twice, from labels that may be learnt from and then from the posteriors that
the label model gives to these documents, each half of them by itself, so that two lexicons of a
kind have seen different documents. Patterns of form vote by themselves. The label model is a tree: a
voter's votes have chances that depend on the class and on the vote of one other voter, the one that
it is most correlated with beyond the class. Expectation-maximisation over the counts of vote patterns
of all documents, labelled or not, estimates the chances, and from them accuracies and correlations. Its posteriors are the labels on
which the linear classifier is trained, by Newton's method on sums over all documents.

Texts are read once besides the labelled ones: what all voters see in a document, a few numbers, is stored
and serves the label model, the classifier's fit and, where the same documents are scored, the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_model import fold, labelled_sample
from .scratch import bounded_batches, released, stored, utf8
from .text_features import WORDS

#: The most labelled rows that lexicons are mined from. Both models are fitted on all rows outside the held-out fold.
MAX_FIT_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: The parts of words that lexicons look at: the first letters, if positive, or the last, of longer words; 0 is the word.
KINDS = (0, 4, 5, 6, -5)
#: Stands for documents among the kinds.
WHOLE = -1
#: Columns of the classifier besides two for each lexicon.
COLUMNS = 9
#: A term enters a lexicon if its documents' posteriors of toxic sum up to the first number or more, their smoothed
#: share reaches the second, and they are more than chance would bring by the third, a log likelihood ratio: for terms
#: mined from labels, and from posteriors, which ask for more.
LABELLED = (2.5, 0.7, 7.0)
POSTERIOR = (6.0, 0.9, 15.0)
#: Words whose terms' counts a task keeps before it hands them on.
KEPT_WORDS = 50_000
#: How far the label of a row that may be learnt from is trusted.
TRUST = 0.95


def part_of(word: str, kind: int) -> str | None:
    if kind == 0 or len(word) <= abs(kind):
        return word if kind == 0 else None
    return word[:kind] + "*" if kind > 0 else "*" + word[kind:]


class _Terms:
    """Counts of terms by half: documents and the sum of ``p``. A term counts once in a document."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.parts = np.zeros((1024, len(KINDS)), np.int32)  # by word, the number of its term of each kind
        self.terms: dict[tuple[int, str], int] = {}
        self.n, self.toxic = np.zeros((2, 0)), np.zeros((2, 0))
        self.documents = np.zeros((2, 2))  # by half: how many, and the sum of ``p``

    def number(self, word: str) -> int:
        at = self.words.get(word)
        if at is None:
            at = self.words[word] = len(self.words)
            if at == len(self.parts):
                self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
            own = ((k, part_of(word, kind)) for k, kind in enumerate(KINDS))
            self.parts[at] = [-1 if t is None else self.terms.setdefault((k, t), len(self.terms)) for k, t in own]
        return at

    def add(self, sets: list[set[str]], p: np.ndarray, half: np.ndarray) -> None:
        number = self.number
        self.documents += np.column_stack([np.bincount(half, minlength=2), np.bincount(half, p, 2)])
        ids = np.array([number(w) for words in sets for w in words], np.int64)
        if not len(ids):
            return
        doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        if len(self.terms) > self.n.shape[1]:
            more = np.zeros((2, 2 * len(self.terms) - self.n.shape[1]))
            self.n, self.toxic = np.hstack([self.n, more]), np.hstack([self.toxic, more])
        size = self.n.shape[1]
        for k in range(len(KINDS)):
            term = self.parts[ids, k].astype(np.int64)
            own, term = doc[term >= 0], term[term >= 0]
            if KINDS[k]:  # several words of a document may have the part in common
                key = np.unique(own * size + term)
                own, term = key // size, key % size
            for h in (0, 1):
                on = half[own] == h
                self.n[h] += np.bincount(term[on], minlength=size)
                self.toxic[h] += np.bincount(term[on], p[own[on]], size)

    def rows(self) -> pd.DataFrame:
        names = list(self.terms)
        half, at = np.nonzero(self.n)
        return pd.DataFrame({
            "half": np.r_[half, 0, 1].astype(np.int32), "kind": np.array([*(names[i][0] for i in at), WHOLE, WHOLE], np.int32),
            "term": np.array([*(names[i][1] for i in at), "", ""], object),
            "n": np.r_[self.n[half, at], self.documents[:, 0]].astype(np.int64), "toxic": np.r_[self.toxic[half, at], self.documents[:, 1]],
        })


def _counted(batches: Iterator[pd.DataFrame], posterior=None) -> Iterator[pd.DataFrame]:
    """Documents and toxic ones of each term and half, summed up by task before the shuffle."""
    held = _Terms()
    for pdf in batches:
        texts = pdf["text"].tolist()
        sets = [set(WORDS.findall(t.lower())) for t in texts]
        p = pdf["p"].to_numpy(float)
        held.add(sets, p if posterior is None else posterior(texts, sets, p), pdf["half"].to_numpy())
        if len(held.words) > KEPT_WORDS:
            yield held.rows()
            held = _Terms()
    yield held.rows()
    released()


def mined_terms(rows: DataFrame, need: tuple[float, float, float] = LABELLED, posterior=None) -> dict[tuple[int, int], set[str]]:
    """The terms of each (half, kind) that qualify. ``rows`` has a text, a half (0 or 1) and p, how toxic it is held
    to be; with ``posterior``, which is given texts, their words and p, that says so, and p is a label or null."""
    counted = rows.select("text", F.col("p").cast("double").alias("p"), "half").mapInPandas(lambda b: _counted(b, posterior), "half int, kind int, term string, n long, toxic double")
    counted = stored(counted.groupBy("half", "kind", "term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "toxic-terms")
    sizes = {r["half"]: (r["n"], r["toxic"]) for r in counted.where((F.col("kind") == WHOLE) & (F.col("n") > 0)).collect()}
    out: dict[tuple[int, int], set[str]] = {(h, k): set() for h in sizes for k in range(len(KINDS))}
    own, clean = F.col("toxic") / F.col("n"), F.greatest(F.col("n") - F.col("toxic"), F.lit(0.0))
    good = F.lit(False)
    for half, (n, p) in sizes.items():
        share = min(max(p / n, 1e-3), 0.5)
        # log likelihood ratio of the term's own share of toxic documents against the share of all
        ratio = F.col("toxic") * F.log(own / share) + F.when(clean > 0, clean * F.log(clean / F.col("n") / (1 - share))).otherwise(0.0)
        good = good | ((F.col("half") == half) & (F.col("kind") >= 0) & (F.col("toxic") >= need[0]) & (F.col("toxic") / (F.col("n") + 0.5) >= need[1]) & (ratio >= need[2]))
    for r in counted.where(good).select("half", "kind", "term").collect():
        out[r["half"], r["kind"]].add(r["term"])
    return out


@dataclass
class Voters:
    """The lexicons: the part of words that each looks at, and its terms."""

    lexicons: list[tuple[int, set[str]]]

    def __post_init__(self):
        """The first four and the last five letters that a word must have to be in any lexicon."""
        self.heads = {t[:4] for kind, terms in self.lexicons if kind >= 0 for t in terms}
        self.tails = {t[kind:] for kind, terms in self.lexicons if kind < 0 for t in terms}

    def hits(self, word: str) -> list[int]:
        return [i for i, (kind, terms) in enumerate(self.lexicons) if part_of(word, kind) in terms]

    def seen(self, texts: list[str], sets: list[set[str]] | None = None) -> np.ndarray:
        """By text: words hit by each lexicon, words hit by any, different words, shares of capitals and of exclamation and
        question marks, and whether such marks come in runs."""
        heads, tails, hits = self.heads, self.tails, self.hits
        out = np.zeros((len(texts), len(self.lexicons) + 5))
        sets = [set(WORDS.findall(t.lower())) for t in texts] if sets is None else sets
        for i, (text, words) in enumerate(zip(texts, sets)):
            found = [own for w in words if (w[:4] in heads or w[-5:] in tails) and (own := hits(w))]
            for own in found:
                out[i, own] += 1
            kinds = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
            upper, lower = kinds[65:91].sum(), kinds[97:123].sum()
            out[i, -5:] = len(found), len(words), upper / max(1, upper + lower), (kinds[33] + kinds[63]) / max(1, len(words)), "!!" in text or "??" in text
        return out


def votes(seen: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstain, by row and voter.

    A lexicon votes toxic where two words hit it, and abstains where one does. On a text of at least 5 different words, the lexicons
    mined from labels and those mined again vote clean together, where no word hits one of them.
    Patterns: a share of hits, in the lexicon of most, of 2 % or more votes toxic, and so do three words that any
    lexicons hold; shouting in capitals,
    many exclamation and question marks, and runs of these vote toxic, and texts with few capitals or
    no marks clean, whatever their words.
    """
    hits, words, n_words, upper, marks, runs = seen[:, :-5], *seen[:, -5:].T
    enough, k = n_words >= 5, len(KINDS)
    none = [np.where(enough & ~(own > 0).any(1), -1, 0) for own in (hits[:, :k], hits[:, k:]) if own.shape[1]]
    dense = np.where(hits.max(1, initial=0) / np.maximum(1, n_words) >= 0.02, 1, 0)
    shout = np.where(upper > 0.5, 1, np.where(enough & (upper < 0.1), -1, 0))
    excited = np.where(marks > 0.2, 1, np.where(enough & (marks == 0), -1, 0))
    return np.column_stack([hits > 1, *none, dense, words > 2, shout, excited, runs > 0]).astype(int)


def columns(seen: np.ndarray) -> np.ndarray:
    """The classifier's columns, from the same numbers."""
    hits, words, n_words, upper, marks, runs = seen[:, :-5], *seen[:, -5:].T
    most = hits.max(1, initial=0)
    several = [words > 0, words > 1, words > 2, np.log1p(words)]
    return np.column_stack([np.log1p(hits), np.minimum(hits, 1), *several, np.minimum(most / np.maximum(1, n_words), 0.2) * 10, most > 0, upper, np.minimum(marks, 1), runs])


@dataclass
class LabelModel:
    """Prior of toxic, and for each voter its parent (-1: none) and the chances [class, parent's vote, vote].
    That a voter abstains says nothing about a text."""

    prior: float
    parent: list[int]
    chances: list[np.ndarray]

    def log_odds(self, v: np.ndarray) -> np.ndarray:
        out = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for j, (up, t) in enumerate(zip(self.parent, self.chances)):
            above = v[:, up] + 1 if up >= 0 else np.zeros(len(v), int)
            out += np.where(v[:, j] != 0, np.log(t[1, above, v[:, j] + 1] / t[0, above, v[:, j] + 1]), 0.0)
        return out

    def posterior(self, v: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(v) + _trusted(y), -30, 30)))

    def accuracy(self, v: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Of each voter, the share of its votes, abstentions apart, that the posterior ``p`` says are right."""
        cast = v != 0
        right = np.where(v == 1, p[:, None], 1 - p[:, None]) * cast
        return (right.sum(0) + 1) / (cast.sum(0) + 2)


def _joint(v: np.ndarray, w: np.ndarray, j: int, k: int) -> np.ndarray:
    """Weights of the votes of ``j`` and ``k``, by class: [class, vote of k, vote of j]."""
    cell = (v[:, k] + 1) * 3 + v[:, j] + 1
    return np.stack([np.bincount(cell, w[c], 9).reshape(3, 3) for c in (0, 1)])


def _tree(v: np.ndarray, w: np.ndarray) -> list[int]:
    """Parents: the spanning tree of most correlation between voters beyond what the class explains, as
    mutual information given the class; a link that explains next to nothing is left out."""
    k = v.shape[1]
    info = np.zeros((k, k))
    for i in range(k):
        for j in range(i):
            t = _joint(v, w, i, j) + 1e-9
            t /= t.sum()
            each = t.sum((1, 2), keepdims=True)
            info[i, j] = info[j, i] = (t * np.log(t * each / (t.sum(1, keepdims=True) * t.sum(2, keepdims=True)))).sum()
    parent, inside = [-1] * k, [0]
    while len(inside) < k:
        rest = [i for i in range(k) if i not in inside]
        _, i, j = max((info[i, j], i, j) for i in rest for j in inside)
        parent[i] = j if info[i, j] > 1e-3 else -1
        inside.append(i)
    return parent


def _trusted(y: np.ndarray) -> np.ndarray:
    """Log odds that a label adds; none where it is nan."""
    return np.where(np.isnan(y), 0.0, np.where(y == 1, 1.0, -1.0) * np.log(TRUST / (1 - TRUST)))


def label_model(v: np.ndarray, y: np.ndarray, prior: float, most: int = 200, close: float = 1e-5, counts: np.ndarray | None = None) -> tuple[np.ndarray, LabelModel]:
    """Posterior of toxic by row, and the model, by EM until posteriors move by less than ``close``.

    ``v`` has the votes and ``y`` the labels, nan where there is none or it may not be learnt from: a label
    is right with the chance TRUST. A row stands for ``counts`` documents. ``prior`` is the share of toxic rows
    among labels and stays. The tree is found anew in the first rounds, then kept.
    """
    known = _trusted(y)
    p = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + known + v.sum(1), -30, 30)))
    model = LabelModel(prior, [-1] * v.shape[1], [])
    for r in range(most):
        w = np.stack([1 - p, p]) * (1.0 if counts is None else counts)
        if r < 5:
            model.parent = _tree(v, w)
        model.chances = []
        for j, up in enumerate(model.parent):
            if up >= 0:
                t = _joint(v, w, j, up)
            else:
                t = np.stack([np.bincount(v[:, j] + 1, w[c], 3) for c in (0, 1)])[:, None, :]
            t = t + 0.5 * (t.sum(1, keepdims=True) + 1) / (t.sum((1, 2), keepdims=True) + 3)  # smoothed by the voter's own shares
            model.chances.append(t / t.sum(2, keepdims=True))
        new = 1 / (1 + np.exp(-np.clip(model.log_odds(v) + known, -30, 30)))
        moved = np.abs(new - p).max(initial=0.0)
        p = new
        if r > 5 and moved < close:
            break
    return p, model


def _sums(held: DataFrame, of) -> np.ndarray:
    """The sum over all rows of what ``of`` (what voters saw, labels) gives for a batch, as an array of fixed length."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                own = of(np.stack(pdf["seen"].tolist()).astype(float), pdf["y"].to_numpy(float))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "s": total})

    rows = held.select("seen", "y").mapInPandas(summed, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["s"]
    return out


def _scale(held: DataFrame) -> tuple[float, np.ndarray]:
    """The number of rows, and the standard deviations of the classifier's columns."""

    def moments(seen, y):
        x = columns(seen)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    n, *rest = _sums(held, moments)
    mean, square = np.array(rest).reshape(2, -1) / n
    return n, np.maximum(np.sqrt(np.maximum(square - mean * mean, 0)), 1e-3)


def _logistic(held: DataFrame, labels: LabelModel, rounds: int = 30, ridge: float = 1e-2) -> tuple[float, np.ndarray, np.ndarray]:
    """Newton's method for the posteriors of the label model: bias, weights and scale. A round is one pass over what
    voters saw, and sums as many numbers as the columns' products."""
    n, scale = _scale(held)
    k = len(scale) + 1
    w = np.zeros(k)
    penalty = np.r_[0, np.full(k - 1, ridge * n * 0.01)] + np.r_[0, np.full(k - 1, 0.1)]
    for _ in range(rounds):

        def slopes(seen, y, w=w):
            z = np.column_stack([np.ones(len(seen)), columns(seen) / scale])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.concatenate([z.T @ (labels.posterior(votes(seen), y) - p), ((z * (p * (1 - p) + 1e-6)[:, None]).T @ z).ravel()])

        got = _sums(held, slopes)
        step = np.linalg.solve(got[k:].reshape(k, k) + np.diag(penalty + 1e-3), got[:k] - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return float(w[0]), w[1:], scale


@dataclass
class ToxicityModel:
    """The voters, the columns' scales and the linear classifier's weights; and the label model."""

    voters: Voters
    bias: float
    weights: np.ndarray
    scale: np.ndarray
    labels: LabelModel | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.of_seen(self.voters.seen(texts))

    def of_seen(self, seen: np.ndarray) -> np.ndarray:
        x = columns(seen) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.weights, -30, 30)))


def _fitted(patterns: DataFrame, prior: float) -> LabelModel:
    """The label model of (pattern, y, n): how many documents voters gave which votes. Patterns are a few thousand; a
    lexicon has two votes and a pattern of form three, which bounds them whatever the number of documents."""
    got = patterns.collect()
    got.sort(key=lambda r: (bytes(r["pattern"]), -1 if r["y"] is None else r["y"]))
    v = np.array([np.frombuffer(r["pattern"], np.int8) for r in got]).astype(int) - 1
    y = np.array([np.nan if r["y"] is None else r["y"] for r in got], float)
    return label_model(v, y, prior, counts=np.array([r["n"] for r in got], float))[1]


def _counts(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern", "y").agg(F.count("*").alias("n"))


def _patterns(seen: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in (votes(seen) + 1).astype(np.int8)]


def _learnt(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int) -> tuple[ToxicityModel, DataFrame | None]:
    """The model, and (doc_id, held_out, y, seen) of all rows of ``docs``; None where no label is toxic."""
    spark = docs.sparkSession
    bounded_batches(spark)
    may = fold("doc_id", FOLDS) != HELD_OUT
    drawn = labelled_sample(labels.select(F.col("doc_id").alias("id")).distinct(), labels, label, "id", may, most).where("y in (0, 1)")
    read = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(2)).cast("int").alias("half"))
    drawn = F.broadcast(drawn)  # at most about ``most`` ids
    taught = stored(read.join(drawn, "id").repartition(spark.sparkContext.defaultParallelism, "id"), "toxic-sample")
    n_toxic, n_known = taught.agg(F.sum("y"), F.count("*")).first()
    prior = ((n_toxic or 0) + 1) / (n_known + 10)
    if not n_toxic:
        return ToxicityModel(Voters([]), float(np.log(prior / (1 - prior))), np.zeros(COLUMNS), np.ones(COLUMNS)), None
    labelled = taught.withColumn("p", F.col("y").cast("double"))
    first = Voters([(KINDS[k], terms) for (_, k), terms in sorted(mined_terms(labelled.withColumn("half", F.lit(0))).items())])
    pattern = lambda of: F.pandas_udf(lambda s: pd.Series(_patterns(of(s.tolist()))), "binary")
    model = _fitted(_counts(taught.select("y", pattern(first.seen)("text").alias("pattern"))), prior)
    again = mined_terms(labelled, POSTERIOR, lambda texts, sets, y: model.posterior(votes(first.seen(texts, sets)), y))
    voters = Voters(first.lexicons + [(KINDS[k], terms) for (_, k), terms in sorted(again.items())])

    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(voters.seen(texts.tolist()).astype(np.float32)))
        released()

    held_out = (fold("id", FOLDS) == HELD_OUT).alias("held_out")
    marked = read.join(drawn, "id", "left")
    held = stored(marked.select(F.col("id").alias("doc_id"), held_out, F.col("y").cast("double").alias("y"), F.pandas_udf(numbers, "array<float>")("text").alias("seen")), "toxic-seen")
    own = held.where(F.col("doc_id").isNotNull() & ~F.col("held_out"))
    model = _fitted(_counts(own.select("y", pattern(lambda rows: np.stack(rows).astype(float))("seen").alias("pattern"))), prior)
    bias, weights, scale = _logistic(own, model)
    return ToxicityModel(voters, bias, weights, scale, model), held


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_FIT_ROWS) -> ToxicityModel:
    """Mines the lexicons from at most about ``most`` labelled rows outside the held-out fold, and fits both models on
    all rows of ``docs`` outside it.

    The driver gets the qualifying terms, counts of vote patterns and sums, no texts.
    """
    return _learnt(docs, labels, label, id_col, text_col, most)[0]


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> Column:
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.scores(texts.tolist()))
        released()

    return F.pandas_udf(score, "double")(utf8(text_col))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (score >= threshold).

    A null text counts as empty and has no term; null ids are scored and never learnt from; of
    repeated labels the higher counts, and repeated rows are scored each. Without toxic labels all scores
    are one low base rate. An empty table gives no rows. The scored text is read whole, whatever its
    length, and other columns, whatever their names, are not read.
    """
    model, held = _learnt(docs, labels, "toxic", id_col, text_col, MAX_FIT_ROWS)
    if held is None:
        out = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), scored(docs, model, text_col).alias("score"))
    else:
        score = F.pandas_udf(lambda s: pd.Series(model.of_seen(np.stack(s.tolist()).astype(float))), "double")
        out = held.select("doc_id", "held_out", score("seen").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
