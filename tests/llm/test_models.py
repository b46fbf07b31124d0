"""Classifiers on held-out labels, line rules, and the pipeline."""

import collections

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from landgrid.llm import queries
from landgrid.llm.line_rules import line_rules
from landgrid.llm.linear import Sparse, fit
from landgrid.llm.quality_model import GOOD, NONE, POOR, LABELLERS, estimate, score_quality, train_quality
from landgrid.llm.toxicity import fit_chain, score_toxicity, train_toxicity
from tests.llm.conftest import ODD, prose

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels():
    return pq.read_table(f"{LARGER}/labels.parquet").to_pylist()


def test_logistic_learns_and_prunes():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 500, 20)) for _ in range(400)]
    target = np.array([float(7 in r or 9 in r) for r in rows])
    model = fit(Sparse.of(rows), target, 512, features=64)
    assert (((model.score(Sparse.of(rows)) > 0.5) == target).mean()) > 0.97 and (model.weights != 0).sum() <= 64
    assert fit(Sparse.of(rows), np.ones(400), 512).score(Sparse.of(rows)).min() > 0.99


def test_chain_feeds_earlier_categories():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 300, 15)) for _ in range(600)]
    first = np.array([int(5 in r or 6 in r) for r in rows])
    chain = fit_chain(Sparse.of(rows), np.column_stack([first, first]), ["a", "b"], np.arange(600) % 3)
    assert chain.models[1].dense[0] > 0.1  # the second model uses the first's probability
    p = chain.predict(Sparse.of(rows))
    assert p.shape == (600, 2) and ((p[:, 1] > chain.threshold) == first).mean() > 0.95


def test_toxicity_held_out(spark, labels):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    table = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic").filter("doc_id % 4 <> 0")
    chain = train_toxicity(docs, table, {"toxic": F.col("toxic")}, "toxic")
    found = {r.doc_id: r.flagged for r in score_toxicity(docs, chain).collect()}
    held = [r for r in labels if r["doc_id"] % 4 == 0]
    right = sum(found[r["doc_id"]] == bool(r["toxic"]) for r in held)
    assert len(held) > 60 and right / len(held) > 0.9


def test_toxicity_odd(odd, none, spark):
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    one_class = spark.createDataFrame([(1, 1), (2, 1), (None, 1), (77, 1), (3, None)], "doc_id bigint, toxic int")
    for given in (empty, one_class):
        chain = train_toxicity(odd, given, {"first": F.col("toxic"), "toxic": F.col("toxic")}, "toxic")
        found = score_toxicity(odd, chain)
        assert found.columns == ["doc_id", "p_first", "p_toxic", "flagged"] and found.count() == len(ODD)
        assert score_toxicity(none, chain).collect() == []


def test_toxicity_columns_and_repeated_rows(spark):
    """Columns of documents named like labels, labels that repeat an id, and a labelled document that comes many times."""
    rows = [(i, ("awful nasty words " if i % 2 else "kind gentle words ") + prose(i, 10), 7, "x") for i in range(60)] + [(1, "awful nasty words", 7, "x")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, y0 string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (3, None)], "doc_id bigint, toxic int")
    chain = train_toxicity(docs, labels, {"any": F.col("toxic"), "toxic": F.col("toxic")}, "toxic", sample=40)
    found = score_toxicity(docs, chain).collect()
    assert len(found) == len(rows) and all(r.flagged == bool(r.doc_id % 2) for r in found)


def test_chain_by_hand():
    """The chain against the same steps written out: folds, earlier probabilities, later models."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 200, 12)) for _ in range(300)]
    labels = np.column_stack([[int(3 in r or 4 in r or 5 in r) for r in rows], [int(3 in r or 9 in r or 10 in r) for r in rows]])
    folds = np.arange(300) % 3
    x = Sparse.of(rows)
    chain = fit_chain(x, labels, ["a", "b"], folds)
    logit = lambda p: (np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4))) / 4)[:, None]
    held = np.empty(300)
    for f in range(3):
        rest, own = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
        held[own] = fit(Sparse.of([rows[i] for i in rest]), labels[rest, 0].astype(float), 1 << 18).score(Sparse.of([rows[i] for i in own]))
    first = fit(x, labels[:, 0].astype(float), 1 << 18)
    second = fit(x, labels[:, 1].astype(float), 1 << 18, logit(held))
    p = chain.predict(x)
    assert np.allclose(p[:, 0], first.score(x)) and np.allclose(p[:, 1], second.score(x, logit(first.score(x))))


def test_votes_estimate_accuracies():
    rng = np.random.default_rng(2)
    k = len(LABELLERS)
    poor = rng.random(4000) < 0.2
    vote = np.where(rng.random((4000, k)) < 0.05, NONE, GOOD)
    vote[(rng.random((4000, k)) < 0.5) & poor[:, None]] = POOR
    vote[(rng.random((4000, k)) < 0.01) & ~poor[:, None]] = POOR
    patterns = (vote * 3 ** np.arange(k)).sum(axis=1)
    seen, counts = np.unique(patterns, return_counts=True)
    model = estimate(seen, counts)
    assert abs(model.prior - 0.2) < 0.03 and abs(model.rates[:, 1, POOR] - 0.5).max() < 0.08
    assert ((model.posterior(patterns) < 0.5) == poor).mean() > 0.97
    assert model.posterior(np.array([3**k - 1]))[0] == pytest.approx(1 - model.prior)


def test_estimation_by_brute_force():
    """Expectation-maximisation text by text gives what it gives on counts of patterns."""
    from landgrid.llm.quality_model import KINDS, OWN, QUIET

    rng = np.random.default_rng(5)
    k = len(LABELLERS)
    vote = rng.choice([GOOD, POOR, NONE], (500, k), p=[0.7, 0.2, 0.1])
    seen, counts = np.unique((vote * 3 ** np.arange(k)).sum(axis=1), return_counts=True)
    model = estimate(seen, counts, rounds=6)
    begin = np.array([[QUIET] + [OWN if name in kind else QUIET for kind in KINDS] for name, _, _ in LABELLERS])
    shares, rates, weight = np.array([0.8] + [0.2 / len(KINDS)] * len(KINDS)), begin, 0.01 * 500
    first = shares
    for _ in range(6):
        p = []
        for row in vote:
            odds = shares * [np.prod([rates[i][c][v] for i, v in enumerate(row)]) for c in range(len(shares))]
            p.append(odds / odds.sum() if (row != NONE).any() else shares)
        p = np.array(p)
        rates = np.array([[[p[vote[:, i] == v, c].sum() + weight * begin[i][c][v] for v in range(3)] for c in range(len(shares))] for i in range(k)])
        rates /= rates.sum(axis=2, keepdims=True)
        shares = (p.sum(axis=0) + weight * first) / (500 + weight)
    assert np.allclose(model.shares, shares) and np.allclose(model.by_kind, rates) and model.prior == pytest.approx(1 - shares[0])


def test_kinds_of_poor_texts_are_told_apart():
    """Few texts that only the labellers of repeats blame, among many that those of noise blame, are poor as well."""
    rng = np.random.default_rng(7)
    names = [name for name, _, _ in LABELLERS]
    vote = np.full((5000, len(names)), GOOD)
    vote[:600, names.index("unusual")] = vote[:600, names.index("marks")] = POOR
    vote[600:800, names.index("stuttered")] = vote[600:800, names.index("repeated")] = POOR
    vote[rng.random(vote.shape) < 0.003] = POOR
    patterns = (vote * 3 ** np.arange(len(names))).sum(axis=1)
    good = estimate(*np.unique(patterns, return_counts=True)).posterior(patterns) > 0.5
    assert not good[:800].any() and good[800:].mean() > 0.95


def test_sample_is_bounded(spark):
    """A third of all rows under a null id, and a row that repeats: at most sample rows train, equal ones once."""
    rows = [(None, prose(i, 12)) for i in range(40)] + [(5, prose(7, 12))] * 40 + [(i, prose(100 + i, 12)) for i in range(40)]
    model = train_quality(spark.createDataFrame(rows, "doc_id bigint, text string"), sample=20)
    assert 0 <= model.labels.prior <= 1


def test_quality_against_labels(spark, labels):
    found = {r.doc_id: r.kept for r in queries.op4_quality_model(spark, LARGER).collect()}
    good = [found[r["doc_id"]] for r in labels if r["quality"]]
    poor = [found[r["doc_id"]] for r in labels if not r["quality"]]
    assert np.mean(good) > 0.98 and np.mean(poor) < 0.1  # labels are held out: the model never sees them


def test_long_texts_may_repeat_their_words():
    from landgrid.llm.quality_model import Measures

    text = " ".join(prose(i, 60) for i in range(60))
    assert Measures().of(text)[0]["repeated"] < 0.2 < 0.8 < Measures().of("again and again " * 200)[0]["repeated"]


def test_quality_odd(odd, none):
    model = train_quality(odd)
    assert score_quality(odd, model).count() == len(ODD)
    nothing = train_quality(none)
    assert score_quality(none, nothing).collect() == [] and all(r.kept for r in score_quality(odd, nothing).collect())


# line rules


def brute_rules(rows, min_docs, share, lost, most=1000):
    import re

    words_of = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    tidy = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    hosts, held = collections.Counter(), collections.defaultdict(set)
    for i, (_, t, h) in enumerate(rows):
        hosts[h or ""] += 1
        for x in (t or "").split("\n"):
            if words_of(x):
                held[h or "", tidy(x)].add(i)
    out = []
    for d, t, h in rows:
        t, h = t or "", h or ""
        words = words_of(t)
        runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        count = collections.Counter(runs)
        repeat = len({i + k for i, r in enumerate(runs) if count[r] > 1 for k in range(8)})
        lines = [x for x in t.split("\n") if words_of(x)]
        gone = sum(len(words_of(x)) for x in lines if len(held[h, tidy(x)]) > max(min_docs, min(share * hosts[h], most)))
        failed = len(words) < 20 or 100 * repeat > 30 * len(words)
        out.append((d, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, failed, not failed and gone < lost * len(words), gone))
    return sorted(out, key=repr)


def test_line_rules(spark, odd, none):
    line = "All rights reserved by the owner"
    rows = [(d, t, None) for d, t in ODD] + [(100 + i, f"{prose(700 + i, 30)}\n{line}\n{line}", "h") for i in range(8)] + [(200 + i, "\n".join([line, "Home About Contact " * 3, prose(5, 20), str(i)]), "h") for i in range(8)]
    rows += [(300 + i, f"{prose(800, 25)}\n{prose(801, 25)}", "mirror") for i in range(6)] + [(400 + i, prose(900 + i, 30), "mirror") for i in range(12)]  # copies are documents of their own
    docs = spark.createDataFrame([(d, t, h, 1) for d, t, h in rows], "doc_id bigint, text string, source string, words int").repartition(3)
    found = line_rules(docs, min_docs=3, host_share=0.1)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_rules(rows, 3, 0.1, 0.7)
    bounded = line_rules(docs, min_docs=3, host_share=0.9, most_docs=5)
    assert sorted((tuple(r) for r in bounded.collect()), key=repr) == brute_rules(rows, 3, 0.9, 0.7, 5)
    verdict = {r.doc_id: r.kept for r in found.collect()}
    assert verdict[100] and not verdict[200] and not verdict[300] and verdict[400]
    assert line_rules(none).collect() == [] and line_rules(odd).count() == len(ODD)


def test_line_rules_use_no_python(odd):
    plan = line_rules(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# pipeline


def test_pipeline(spark, data):
    from landgrid.llm.shared import documents

    docs = documents(spark, data)
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], data).cache())
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in steps]
    assert all(s.columns == docs.columns for s in steps[1:-1])
    assert ids[0] > ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    assert steps[2].select(plain).distinct().count() == steps[2].count() == steps[1].select(plain).distinct().count()
    kept = {r["doc_id"]: r["kept"] for r in score_quality(docs, train_quality(docs)).collect()}
    assert ids[1] == {d for d, k in kept.items() if k}
    whole = [s.agg(F.sum("length"), F.count_distinct("doc_id")).first() for s in (corpus_pipeline.run(spark, data), steps[-1])]
    assert whole[0] == whole[1]


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_stand_odd_documents(spark, odd, none, stage):
    for docs in (odd, none):
        out = stage[1](spark, docs, "")
        assert out.count() <= 3 * docs.count()


def test_one_of_repeated_rows_stays(spark, odd):
    import re

    left = corpus_pipeline.exact(spark, odd, "")
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(plain(r["text"]) for r in left.collect()) == sorted({plain(t) for _, t in ODD})
