"""Toxicity by a classifier chain (operator 8).

Categories are predicted one after another (``insult``, ``contempt``, ``toxic``); each linear
model reads the text's own evidence for its category and the probabilities of the categories
before it. Evidence is lexical: from the labelled sample, each word and word start (4 and 5
characters, so that inflections of a term share it) gets a smoothed log odds ratio, less one
standard error; a text's evidence is its two strongest words, which a long clean text does
not dilute. Everything a later model is trained on is out of fold: a document's evidence
comes from the other folds' counts and its earlier probabilities from models that did not
see it.

Only a bounded sample of labelled documents is used for training (``SAMPLE``, the smallest by
a hash of doc_id); every document is scored on its whole text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursewise.llm.common import batches, stored

#: Bound of the training sample (documents), number of folds, fewest positives of a feature.
SAMPLE, FOLDS, SUPPORT = 10_000, 4, 2
STARTS = (4, 5)
THRESHOLD = 0.5
_STRIP = string.punctuation + "«»„“”‘’…¿¡–—"

# Rule labels for the first two categories, of documents that are labelled toxic.
INSULT = ("idiot", "moron", "loser", "clown", "scum", "fool")
CONTEMPT = ("stupid", "pathetic", "worthless", "disgusting", "trash", "dumb")


def _any_of(terms) -> Column:
    return F.lower("text").rlike(r"\b(" + "|".join(terms) + r")\b")


#: Category name -> its label, from the columns doc_id, text, toxic. The last one decides.
CATEGORIES = {
    "insult": lambda: (F.col("toxic") == 1) & _any_of(INSULT),
    "contempt": lambda: (F.col("toxic") == 1) & _any_of(CONTEMPT),
    "toxic": lambda: F.col("toxic") == 1,
}


def word_features(token: str) -> list[str]:
    word = token.strip(_STRIP)
    if not word:
        return []
    return [f"w:{word}", *(f"{n}:{word[:n]}" for n in STARTS if len(word) >= n)]


def _tokens(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


class Evidence(dict):
    """Token -> scores by category (None: no evidence); emptied at ``limit`` tokens."""

    def __init__(self, lexicon: dict[str, tuple[float, ...]], limit: int = 100_000):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, token: str):
        if len(self) >= self.limit:
            self.clear()
        found = [self.lexicon[f] for f in word_features(token) if f in self.lexicon]
        got = self[token] = tuple(map(max, zip(*found))) if found else None
        return got

    def top_two(self, text: str | None, categories: int) -> list[float]:
        """For each category the strongest and second strongest word of the text."""
        hits = [s for s in map(self.__getitem__, _tokens(text)) if s]
        out = []
        for c in range(categories):
            best = sorted((s[c] for s in hits), reverse=True)[:2]
            out += (best + [0.0, 0.0])[:2]
        return out


# ------------------------------------------------------------------ training

def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled documents: doc_id, text, fold, one 0/1 column a category."""
    known = (labels.where("doc_id is not null and toxic is not null")
             .groupBy(F.col("doc_id").alias("__d")).agg(F.max("toxic").cast("int").alias("toxic")))
    known = known.orderBy(F.xxhash64("__d"), "__d").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__d"))
    ys = [F.coalesce(y(), F.lit(False)).cast("int").alias(f"y{i}") for i, y in enumerate(CATEGORIES.values())]
    return rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"), *ys)


def _feature_counts(sample: DataFrame) -> pd.DataFrame:
    """Documents holding each feature, by fold and category: columns feature, n<fold>, p<c>_<fold>."""
    k = len(CATEGORIES)
    cols = [f"n{f}" for f in range(FOLDS)] + [f"p{c}_{f}" for c in range(k) for f in range(FOLDS)]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for b in batches(frames, 1):
            ys = list(zip(*(b.column(3 + c).to_pylist() for c in range(k))))
            for text, fold, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), ys):
                at = [fold, *(FOLDS * (c + 1) + fold for c in range(k) if y[c])]
                for f in {f for t in _tokens(text) for f in word_features(t)}:
                    row = counts.get(f)
                    if row is None:
                        row = counts[f] = [0] * len(cols)
                    for i in at:
                        row[i] += 1
            if len(counts) > 50_000:
                yield _rows(counts, cols)
                counts = {}
        if counts:
            yield _rows(counts, cols)

    out = sample.mapInArrow(run, "feature string, " + ", ".join(f"{c} long" for c in cols))
    out = out.groupBy("feature").agg(*[F.sum(c).alias(c) for c in cols])
    positives = sum((F.col(f"p{k - 1}_{f}") for f in range(FOLDS)), F.lit(0))
    # of the bounded sample's features only those that speak for a category leave the executors
    total = sum((F.col(f"n{f}") for f in range(FOLDS)), F.lit(0))
    return out.where((positives >= SUPPORT) & (2 * positives > total)).toPandas()


def _rows(counts, cols) -> pa.RecordBatch:
    values = np.array(list(counts.values()), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(values[:, i]) for i in range(len(cols)))],
                                      names=["feature", *cols])


def _lexicon(counts: pd.DataFrame, docs: np.ndarray, positives: np.ndarray, without: int | None) -> dict[str, tuple[float, ...]]:
    """feature -> log odds less its standard error for each category, leaving out one fold."""
    use = [f for f in range(FOLDS) if f != without]
    n = sum((counts[f"n{f}"].to_numpy(float) for f in use), np.zeros(len(counts)))
    scores = []
    for c in range(len(CATEGORIES)):
        a = sum((counts[f"p{c}_{f}"].to_numpy(float) for f in use), np.zeros(len(counts)))
        yes, no = positives[c, use].sum(), docs[use].sum() - positives[c, use].sum()
        b = n - a
        odds = np.log((a + .5) / (yes + 1)) - np.log((b + .5) / (no + 1))
        s = odds - np.sqrt(1 / (a + .5) + 1 / (b + .5))
        scores.append(np.where(a >= SUPPORT, np.maximum(s, 0), 0))
    s = np.stack(scores, axis=1) if scores else np.zeros((0, 0))
    keep = s.max(axis=1, initial=0) > 0
    return {f: tuple(map(float, row)) for f, row in zip(counts.feature[keep], s[keep])}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """The lexicon and the weights of the chain's linear models."""

    def __init__(self, lexicon: dict[str, tuple[float, ...]], weights: list[np.ndarray]):
        self.lexicon, self.weights = lexicon, weights

    def probabilities(self, evidence: np.ndarray) -> np.ndarray:
        """(texts, categories) from the (texts, 2 * categories) evidence."""
        done: list[np.ndarray] = []
        for c, w in enumerate(self.weights):
            done.append(_predict(np.column_stack([evidence[:, 2 * c:2 * c + 2], *done]), w))
        return np.column_stack(done)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Train the chain on at most ``sample`` labelled documents.

    Without any labelled toxic document no text has evidence and none is rejected.
    """
    k = len(CATEGORIES)
    rows = stored(training_sample(docs, labels, sample), "toxicity-sample")
    tally = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y{c}").alias(f"y{c}") for c in range(k)]).toPandas()
    n, pos = np.zeros(FOLDS), np.zeros((k, FOLDS))
    for r in tally.itertuples():
        n[r.fold] = r.n
        for c in range(k):
            pos[c, r.fold] = getattr(r, f"y{c}")
    counts = _feature_counts(rows)
    held_out = [_lexicon(counts, n, pos, f) for f in range(FOLDS)]
    shared = rows.sparkSession.sparkContext.broadcast(held_out)  # features of the bounded sample
    names = [f"e{i}" for i in range(2 * k)]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Evidence(lex) for lex in shared.value]
        for b in batches(frames, 1):
            e = [seen[f].top_two(t, k) for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            e = np.array(e, float).reshape(-1, 2 * k)
            yield pa.RecordBatch.from_arrays([b.column(2), *b.columns[3:], *(pa.array(e[:, i]) for i in range(2 * k))],
                                             names=["fold", *(f"y{c}" for c in range(k)), *names])

    data = rows.mapInArrow(run, "fold int, " + ", ".join(f"y{c} int" for c in range(k)) + ", "
                           + ", ".join(f"{e} double" for e in names)).toPandas()
    data = data.sort_values(list(data.columns), ignore_index=True)  # the same sums in every run
    ev, fold = data[names].to_numpy(float), data.fold.to_numpy()
    weights, done = [], []
    for c in range(k):
        x, y = np.column_stack([ev[:, 2 * c:2 * c + 2], *done]), data[f"y{c}"].to_numpy(float)
        out_of_fold = np.zeros(len(y))
        for f in range(FOLDS):
            train, test = fold != f, fold == f
            if train.any() and test.any():
                out_of_fold[test] = _predict(x[test], _logistic(x[train], y[train]))
        done.append(out_of_fold)
        weights.append(_logistic(x, y) if len(y) else np.append(np.zeros(x.shape[1]), -30.0))
    return Chain(_lexicon(counts, n, pos, None), weights)


# ------------------------------------------------------------------ scoring

def scores(docs: DataFrame, chain: Chain) -> DataFrame:
    """Rows of ``docs`` (doc_id, text): doc_id, p_<category>..., rejected.

    Null and empty texts have no evidence and are never rejected; repeated rows get a row
    each, null ids stay null, an empty table gives no rows, other columns are ignored.
    """
    names = [f"p_{c}" for c in CATEGORIES]
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    k = len(names)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Evidence(shared.value.lexicon)
        for b in batches(frames, 1):
            ev = np.array([seen.top_two(t, k) for t in b.column(1).to_pylist()], float).reshape(-1, 2 * k)
            p = np.round(shared.value.probabilities(ev), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, i]) for i in range(k))], names=["doc_id", *names])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{p} double" for p in names))
    return out.withColumn("rejected", F.col(names[-1]) >= THRESHOLD)


def clean_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with their own columns.

    Filtered inside the scoring task: the texts are not shuffled.
    """
    own = docs.columns
    text = own.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    k = len(CATEGORIES)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Evidence(shared.value.lexicon)
        for b in batches(frames, text):
            ev = np.array([seen.top_two(t, k) for t in b.column(text).to_pylist()], float).reshape(-1, 2 * k)
            p = np.round(shared.value.probabilities(ev)[:, -1], 6)
            yield b.filter(pa.array(p < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
