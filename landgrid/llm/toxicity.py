"""Toxicity by a classifier chain.

Categories are predicted one after another: the linear model of a category sees the hashed word features of a text and
the probabilities of the categories before it. For training, those probabilities are out-of-fold predictions, so that
a later model learns from what it will meet. Features of a text: its words in lower case and their first three to six
letters, each once.

Defined cases: null and empty texts have no features and get the chain's prior; labels with a null id or value and
labels of absent documents are left out; of labels that repeat an id the greatest value of each column counts; of
documents that repeat a labelled id at most twice the sample's rows are learned from, those of least hash, equal ones
once; with no labels or one class only the probability is the labels' share (0 without any); rows that repeat an id are
scored row by row; an empty table gives an empty result; of docs only the id, the text and the columns that the
categories name are read, and a column of docs that is named like a label doesn't hide it.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.llm.linear import Logistic, Sparse, fit, slot
from landgrid.llm.shared import body, hold, unused

BITS = 18
FOLDS = 3
_WORD = re.compile(r"[^\W\d_]+")


class WordFeatures:
    """Slots of a text's words and word beginnings; remembered by piece between white space, up to ``held``."""

    def __init__(self, held: int = 200_000):
        self.known: dict[str, np.ndarray] = {}
        self.held = held

    def _of(self, piece: str) -> np.ndarray:
        names = set()
        for word in _WORD.findall(piece.lower()):
            names.add(word)
            names.update(f"^{word[:k]}" for k in range(3, min(6, len(word)) + 1))
        return np.array(sorted({slot(n, BITS) for n in names}), np.int32)

    def of(self, text: str) -> np.ndarray:
        known, pieces = self.known, set(text.split())
        if len(known) > self.held:
            known.clear()
        for piece in pieces:
            if piece not in known:
                known[piece] = self._of(piece)
        return np.unique(np.concatenate([np.empty(0, np.int32), *(known[p] for p in pieces)]))


_features = WordFeatures()


@dataclass
class Chain:
    categories: list[str]
    models: list[Logistic]
    threshold: float

    def predict(self, x: Sparse) -> np.ndarray:
        """A column of probabilities for each category."""
        out = np.empty((len(x), 0))
        for model in self.models:
            out = np.column_stack([out, model.score(x, _logit(out))])
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def _best_threshold(target: np.ndarray, p: np.ndarray) -> float:
    """Of the out-of-fold probabilities, the threshold of the best F1."""
    if not target.any() or target.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(target[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + target.sum())
    best = int(np.argmax(f1))
    below = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return float(np.clip((p[order[best]] + below) / 2, 0.02, 0.98))


def fit_chain(x: Sparse, labels: np.ndarray, categories: list[str], folds: np.ndarray) -> Chain:
    """labels: a 0/1 column for each category, in the chain's order; folds: a number for each row."""
    held_out = np.empty((len(x), 0))
    models = []
    for k in range(len(categories)):
        earlier, target = _logit(held_out), labels[:, k].astype(np.float64)
        models.append(fit(x, target, 1 << BITS, earlier))
        p = np.full(len(x), target.mean() if len(x) else 0.0)
        for f in np.unique(folds):
            rest, own = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            if len(rest):
                p[own] = fit(x.take(rest), target[rest], 1 << BITS, earlier[rest]).score(x.take(own), earlier[own])
        held_out = np.column_stack([held_out, p])
    threshold = _best_threshold(labels[:, -1].astype(bool), held_out[:, -1]) if len(x) else 0.5
    return Chain(categories, models, threshold)


def _features_of(extra: list[str]):
    def rows(batches):
        hold("toxicity", _features.known.clear)
        for batch in batches:
            found = [_features.of(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array(found, pa.list_(pa.int32()))], [*extra, "slots"])

    return rows


def _fit(categories: list[str]):
    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("order", "ascending")])
        x = Sparse.of([np.array(s, np.int64) for s in table.column("slots").to_pylist()])
        labels = np.column_stack([np.array(table.column(f"y{k}").to_pylist(), np.int8) for k in range(len(categories))])
        chain = fit_chain(x, labels, categories, np.array(table.column("fold").to_pylist(), np.int64))
        return pa.table({"model": pa.array([pickle.dumps(chain)], pa.binary())})

    return one


def train_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], final_label: str, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000) -> Chain:
    """A chain trained on at most ``sample`` labelled documents, half of each class.

    categories: for each category, in order, a 0/1 expression over the label columns and those of docs that have no
    namesake there; final_label: the 0/1 column of labels by which the sample is balanced.
    """
    names, values = list(categories), [c for c in labels.columns if c != id_col]
    given = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(*(F.max(c).alias(c) for c in values))
    rank = F.xxhash64(F.col(id_col).cast("long"))
    final = F.col(final_label).cast("int")
    # the sample's ids are bounded by its parameter, so the texts meet them by broadcast and never move
    chosen = [given.filter(final == y).orderBy(rank, id_col).limit(sample // 2) for y in (1, 0)]
    ids = chosen[0].unionByName(chosen[1])
    hidden = {c.lower() for c in values}
    own_id, own_text = unused([*docs.columns, *values, *names], "_id", "_text")
    texts = docs.filter(F.col(id_col).isNotNull()).withColumn(own_text, body(text_col)).withColumnRenamed(id_col, own_id)
    texts = texts.drop(*(c for c in texts.columns if c.lower() in hidden))
    texts = texts.join(F.broadcast(ids.withColumnRenamed(id_col, f"{own_id}l")), F.col(own_id) == F.col(f"{own_id}l"))
    order = F.xxhash64(F.col(own_id).cast("long"), own_text)
    rows = texts.select(F.col(own_id).cast("long").alias("doc_id"), order.alias("order"), F.pmod(F.xxhash64(F.col(own_id).cast("long")), F.lit(FOLDS)).alias("fold"), *(categories[c].cast("int").alias(f"y{k}") for k, c in enumerate(names)), F.col(own_text).alias("t"))
    rows = rows.dropna(subset=[f"y{k}" for k in range(len(names))])
    columns = ["doc_id", "order", "fold", *(f"y{k}" for k in range(len(names)))]
    kinds = "doc_id long, order long, fold long, " + "".join(f"y{k} int, " for k in range(len(names)))
    found = rows.mapInArrow(_features_of(columns), kinds + "slots array<int>")
    found = found.dropDuplicates(["doc_id", "order"]).orderBy("order", "doc_id").limit(2 * sample)  # more than the sample only where ids repeat
    model = found.groupBy(F.lit(1).alias("one")).applyInArrow(_fit(names), "model binary").collect()
    if not model:
        none = Logistic(np.zeros(1 << BITS), np.empty(0), -40.0)
        return Chain(names, [Logistic(none.weights, np.zeros(k), none.bias) for k in range(len(names))], 0.5)
    return pickle.loads(model[0]["model"])


def _score(chain: Chain):
    def rows(batches):
        hold("toxicity", _features.known.clear)
        for batch in batches:
            p = chain.predict(Sparse.of([_features.of(t) for t in batch.column("t").to_pylist()]))
            columns = [pa.array(p[:, k], pa.float64()) for k in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(p[:, -1] > chain.threshold, pa.bool_())], ["doc_id", *(f"p_{c}" for c in chain.categories), "flagged"])

    return rows


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, p_ and a category's name for each, flagged (by the last category)."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("t"))
    return df.mapInArrow(_score(chain), "doc_id long, " + "".join(f"p_{c} double, " for c in chain.categories) + "flagged boolean")
