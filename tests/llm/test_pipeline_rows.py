"""The dedup stages keep exactly the rows that the operators keep, also where an id covers several texts."""

import pytest

import corpus_pipeline
from landgrid.llm.near_dedup import near_dedup
from tests.llm.conftest import prose

A, B, C, D = prose(801, 60), prose(802, 30), prose(803, 45), prose(804, 20)
SCHEMA = "doc_id bigint, text string, kept string"


@pytest.mark.parametrize("stage", [corpus_pipeline.exact, corpus_pipeline.near], ids=["exact", "near"])
@pytest.mark.parametrize(
    "rows",
    [
        [(1, A), (None, A), (None, B)],
        [(1, A), (2, A), (2, B), (2, C)],
        [(None, A), (None, A), (None, B), (None, B), (None, C)],
        [(5, A), (5, A), (5, B), (5, B), (6, C), (7, C), (None, D), (None, None), (7, D)],
    ],
)
def test_each_text_stays_once(spark, stage, rows):
    left = stage(spark, spark.createDataFrame([(d, t, "k") for d, t in rows], SCHEMA).repartition(3), "")
    assert left.columns == ["doc_id", "text", "kept"]
    assert sorted(r["text"] or "" for r in left.collect()) == sorted({t or "" for _, t in rows})


def test_rows_are_those_of_the_exact_report(spark):
    rows = [(1, "A long text"), (None, "A long text"), (None, "B"), (3, "B"), (3, "C  c"), (3, "C c")]
    left = corpus_pipeline.exact(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(map(tuple, left.collect())) == [(1, "A long text"), (3, "B"), (3, "C  c")]


def test_classes_without_ids_are_apart(spark):
    near = " ".join([*A.split()[:-1], "other"])
    rows = [(None, A), (None, near), (None, B), (None, B), (4, C), (4, C), (4, D), (4, D)]
    found = near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum(r.kept for r in found) == 4 and len(found) == len(rows)
    left = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert len(left) == 4 and {r["text"] for r in left} - {A, near} == {B, C, D}


def brute_exact(rows):
    """One row of each normalised text: that of the least id (null only where there is no other)."""
    import re

    best = {}
    for d, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        best[key] = min((d is None, d, t or "") if d is not None else (True, 0, t or "") for d, t in rows if re.sub(r"[\x20\x09-\x0D]+", " ", t or "") == key)[:2]
    return sorted((None if no_id else d, key) for key, (no_id, d) in best.items())


NAMES = ["_id", "_kept", "_key", "_found", "_n", "_rows", "_row", "_copies", "_digest", "_k1", "_k2", "kept", "n", "n_kept", "k1", "node", "label", "bucket", "size"]
MIXED = [(1, A), (1, B), (1, A + " "), (2, A), (2, C), (2, None), (3, C), (3, D), (None, B), (None, D), (4, ""), (5, " ".join([*A.split()[:-1], "other"])), (5, D.replace(" ", "\n"))]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:4], ids=lambda s: s[0])
def test_stages_pass_columns_of_any_name(spark, stage):
    """Rows with ids that repeat over different texts and columns named as the operators' own: values stay with their rows."""
    schema = "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in NAMES)
    docs = spark.createDataFrame([(d, t, len(t or ""), *[100 * i + j for j in range(len(NAMES))]) for i, (d, t) in enumerate(MIXED)], schema).repartition(3)
    left = stage[1](spark, docs, "")
    assert left.columns == docs.columns
    kept = left.collect()
    for r in kept:
        i = r["_id"] // 100
        assert r["doc_id"] == MIXED[i][0] and tuple(r)[3:] == tuple(100 * i + j for j in range(len(NAMES)))
        if stage[0] != "suffix-array dedup":
            assert r["text"] == MIXED[i][1]
    assert len({r["_id"] for r in kept}) == len(kept)
    if stage[0] == "exact dedup":
        import re

        found = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in kept]
        assert sorted(t for _, t in found) == sorted(t for _, t in brute_exact(MIXED)) and set(found) == set(brute_exact(MIXED))
    if stage[0] == "near dedup":  # A with its variant, and B, C, D and the empty text
        assert sorted(" ".join((r["text"] or "").split()) for r in kept) == sorted([A, B, C, D, ""])
