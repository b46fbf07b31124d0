"""Quality by weak labels: overlapping heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Each labeller votes good, poor or nothing on a text. The votes of all documents are counted by pattern (at most three
to the power of the labellers, whatever the input), and expectation-maximisation over those counts estimates how often
each labeller gives each vote on good texts and on each kind of poor ones: poor texts are noise or repeat themselves, and
labellers of one kind say little of the other. The posterior of a text's pattern, over all kinds, is its label; posterior
labels of a bounded sample train a linear scorer over hashed word shapes, which then scores every document.

Defined cases: null and empty texts have no words, on which no labeller votes; their posterior is the prior; rows that
repeat an id are scored row by row; with no documents the scorer keeps all; only the id and text columns are read.
"""

from __future__ import annotations

import math
import operator
import pickle
import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.linear import Logistic, Sparse, fit, slot
from landgrid.llm.shared import body, hold

BITS = 16
GOOD, POOR, NONE = 0, 1, 2

BLOCK = 200  # words whose repeats count together, as long texts repeat more of their words anyway

#: Labellers: a measure, its value from which a text is poor, and the value up to which it is good.
#: "unusual" and "marks" overlap with all but the last three, "repeated" and "stuttered" with several.
LABELLERS = (
    ("unusual", 0.4, 0.2),
    ("marks", 0.15, 0.08),
    ("symbols", 0.2, 0.05),
    ("shouted", 0.3, 0.1),
    ("bars", 0.1, 0.02),
    ("exclaimed", 0.1, 0.03),
    ("stuttered", 0.06, 0.04),
    ("repeated", 0.9, 0.6),
    ("same_lines", 0.3, 0.1),
)
#: Kinds of poor texts, by the labellers that see them: noise, and text that repeats itself.
KINDS = (("unusual", "marks", "symbols", "shouted", "bars", "exclaimed"), ("stuttered", "repeated", "same_lines"))


class Measures:
    """Shares of a text's words, and how many words have which shape; shapes are remembered, up to ``held`` words."""

    def __init__(self, held: int = 100_000):
        self.known: dict[str, int] = {}
        self.held = held

    @staticmethod
    def shape(word: str) -> str:
        """Letters as a or A, digits as 0, other characters as they are; runs once."""
        out = ""
        for c in word:
            c = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
            if c != out[-1:]:
                out += c
        return out

    def of(self, text: str) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
        """Measures by name, slots and their values."""
        words = text.split()
        n = len(words)
        if not n:
            return {}, np.empty(0, np.int64), np.empty(0)
        known = self.known
        try:
            shapes = np.fromiter(map(known.__getitem__, words), np.int64, n)
        except KeyError:
            if len(known) > self.held:
                known.clear()
            for word in set(words):
                if word not in known:
                    shape = self.shape(word)
                    loud = shape.startswith("A") and "a" not in shape and len(word) > 1
                    known[word] = slot(f"shape {shape}", BITS) << 2 | (not _PLAIN.fullmatch(shape)) << 1 | loud
            shapes = np.fromiter(map(known.__getitem__, words), np.int64, n)
        raw = text.encode("utf-8", "surrogatepass")
        solid = max(1, len(raw.translate(None, b" \t\n\v\f\r")))
        lines = [x for x in text.split("\n") if x.strip()]
        found = {
            "unusual": float((shapes >> 1 & 1).sum()) / n,
            "marks": len(raw.translate(None, _ORDINARY)) / solid,
            "symbols": sum(map(text.count, "#*$%&<>")) / n,
            "shouted": float((shapes & 1).sum()) / n if n >= 8 else 0.0,
            "bars": text.count("|") / n,
            "exclaimed": text.count("!!") / n,
            "stuttered": sum(map(operator.eq, words, islice(words, 1, None))) / n,
            "repeated": 1 - sum(len(set(words[i : i + BLOCK])) for i in range(0, n, BLOCK)) / n,
            "same_lines": 1 - len(set(lines)) / len(lines),
        }
        seen, counts = np.unique(shapes >> 2, return_counts=True)
        bins = [slot(f"{name} {min(9, int(10 * x))}", BITS) for name, x in found.items()]
        return found, np.concatenate([seen, bins]), np.concatenate([np.sqrt(counts / n), np.ones(len(bins))])


#: Shapes of words of a sentence.
_PLAIN = re.compile(r"[\"'(]?(A?a|A|0)('a|-a)?[.,;:!?)\"']{0,2}")
#: Bytes of spaces, letters, digits, sentence marks and of characters beyond ASCII.
_ORDINARY = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b) in " \t\n\v\f\r.,;:'\"?-")
_measures = Measures()


def votes(found: dict[str, float]) -> int:
    """The votes as a number in base 3, the first labeller's lowest."""
    pattern = 0
    for name, poor, good in reversed(LABELLERS):
        x = found.get(name)
        pattern = 3 * pattern + (NONE if x is None else POOR if x >= poor else GOOD if x <= good else NONE)
    return pattern


@dataclass
class LabelModel:
    shares: np.ndarray  # of good texts and of each kind of poor ones
    by_kind: np.ndarray  # labeller x kind (good first) x vote: how often the vote is given

    @property
    def prior(self) -> float:
        """Share of poor texts."""
        return float(1 - self.shares[0])

    @property
    def rates(self) -> np.ndarray:
        """labeller x class (good, poor) x vote."""
        poor = np.einsum("lkv,k->lv", self.by_kind[:, 1:], self.shares[1:] / max(self.shares[1:].sum(), 1e-12))
        return np.stack([self.by_kind[:, 0], poor], axis=1)

    def kinds(self, patterns: np.ndarray) -> np.ndarray:
        """Probabilities of the kinds for each pattern. A text without a vote has their shares."""
        rest, log = np.asarray(patterns, np.int64).copy(), np.tile(np.log(self.shares), (len(patterns), 1))
        silent = np.ones(len(rest), bool)
        for rates in self.by_kind:
            vote, rest = rest % 3, rest // 3
            silent &= vote == NONE
            log += np.log(rates[:, vote]).T
        log[silent] = np.log(self.shares)
        odds = np.exp(log - log.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text of each pattern is good."""
        return self.kinds(patterns)[:, 0]


#: Where estimation starts, and what it is drawn to: good, poor and no vote on texts that a labeller doesn't mind, and on its own kind.
QUIET, OWN = np.array([0.975, 0.005, 0.02]), np.array([0.5, 0.45, 0.05])
POOR_SHARE = 0.2


def start() -> LabelModel:
    by_kind = np.tile(QUIET, (len(LABELLERS), 1 + len(KINDS), 1))
    for kind, names in enumerate(KINDS, 1):
        by_kind[[i for i, labeller in enumerate(LABELLERS) if labeller[0] in names], kind] = OWN
    return LabelModel(np.array([1 - POOR_SHARE, *[POOR_SHARE / len(KINDS)] * len(KINDS)]), by_kind)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, pull: float = 0.01) -> LabelModel:
    """Expectation-maximisation over pattern counts. The start counts as ``pull`` of the texts, so that a labeller that fires alone isn't read as noise."""
    first = model = start()
    if not len(patterns):
        return model
    vote = [np.asarray(patterns, np.int64) // 3**i % 3 for i in range(len(LABELLERS))]
    weight = pull * counts.sum()
    for _ in range(rounds):
        mass = counts[:, None] * model.kinds(patterns)
        rates = np.stack([np.stack([np.bincount(v, mass[:, c], minlength=3) for c in range(mass.shape[1])]) for v in vote]) + weight * first.by_kind
        model = LabelModel((mass.sum(axis=0) + weight * first.shares) / (mass.sum() + weight), rates / rates.sum(axis=2, keepdims=True))
    return model


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Logistic
    threshold: float


def _patterns(batches):
    hold("quality", _measures.known.clear)
    for batch in batches:
        found = [votes(_measures.of(t)[0]) for t in batch.column("t").to_pylist()]
        seen, n = np.unique(np.array(found, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n, pa.int64())], ["pattern", "n"])


def _sampled(batches):
    hold("quality", _measures.known.clear)
    for batch in batches:
        found = [_measures.of(t) for t in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("order"), pa.array([votes(m) for m, _, _ in found], pa.int64()), pa.array([s for _, s, _ in found], pa.list_(pa.int64())), pa.array([v for _, _, v in found], pa.list_(pa.float64()))],
            ["doc_id", "order", "pattern", "slots", "vals"],
        )


def _fit(labels: LabelModel):
    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("doc_id", "ascending")])
        x = Sparse.of([np.array(s, np.int64) for s in table.column("slots").to_pylist()], [np.array(v) for v in table.column("vals").to_pylist()])
        scorer = fit(x, labels.posterior(np.array(table.column("pattern").to_pylist(), np.int64)), 1 << BITS, features=2048)
        return pa.table({"model": pa.array([pickle.dumps(scorer)], pa.binary())})

    return one


def train_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 8000, threshold: float = 0.5) -> QualityModel:
    """Accuracies from the votes on all documents; the scorer from at most ``sample`` of them, those of least hash of id and text; rows that repeat both count once."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("t"))
    counts = df.select("t").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns, n = (np.array([r[c] for r in counts], np.int64) for c in ("pattern", "n"))
    labels = estimate(patterns, n)
    total = int(n.sum()) if len(n) else 0
    part = min(1.0, sample / total) if total else 1.0
    chosen = df.withColumn("order", F.xxhash64("doc_id", "t")).filter(F.pmod("order", F.lit(1 << 30)) < F.lit(math.ceil(1.1 * part * (1 << 30))))
    rows = chosen.mapInArrow(_sampled, "doc_id long, order long, pattern long, slots array<long>, vals array<double>")
    rows = rows.dropDuplicates(["doc_id", "order"]).orderBy(F.pmod("order", F.lit(1 << 30)), "order", "doc_id").limit(sample)
    found = rows.groupBy(F.lit(1).alias("one")).applyInArrow(_fit(labels), "model binary").collect()
    scorer = pickle.loads(found[0]["model"]) if found else Logistic(np.zeros(1 << BITS), np.empty(0), 40.0)
    return QualityModel(labels, scorer, threshold)


def _score(model: QualityModel):
    def rows(batches):
        hold("quality", _measures.known.clear)
        for batch in batches:
            found = [_measures.of(t) for t in batch.column("t").to_pylist()]
            posterior = model.labels.posterior(np.array([votes(m) for m, _, _ in found], np.int64))
            score = model.scorer.score(Sparse.of([s for _, s, _ in found], [v for _, _, v in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(posterior, pa.float64()), pa.array(score, pa.float64()), pa.array(score >= model.threshold, pa.bool_())], ["doc_id", "weak_label", "score", "kept"]
            )

    return rows


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, weak_label (posterior that it is good), score, kept."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("t"))
    return df.mapInArrow(_score(model), "doc_id long, weak_label double, score double, kept boolean")


def _keep(model: QualityModel, text_col: str):
    def rows(batches):
        hold("quality", _measures.known.clear)
        for batch in batches:
            found = [_measures.of(t or "") for t in batch.column(text_col).to_pylist()]
            score = model.scorer.score(Sparse.of([s for _, s, _ in found], [v for _, _, v in found]))
            yield batch.filter(pa.array(score >= model.threshold))

    return rows


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that the scorer keeps, where they are."""
    return docs.mapInArrow(_keep(model, text_col), docs.schema)
