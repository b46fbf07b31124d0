from __future__ import annotations

import pytest

#: Texts that operators must stand: null, empty, white space, long, repeated rows, ties, characters of all kinds.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) + ("." if rng.random() < 0.1 else "") for _ in range(n))


ODD = [
    (1, prose(1, 120)), (2, prose(1, 120)), (2, prose(1, 120)), (3, None), (4, ""), (5, "  \n\t "), (None, prose(1, 120)), (None, None), (6, prose(6, 4000)), (7, prose(6, 4000).replace("alpha", "other", 3)),
    (8, "naïve café Ünïcödé 中文字符 \U0001f600 \x1c\x85 é <|endoftext|>"), (9, "a " * 300), (10, prose(1, 120).replace(" ", "\n ")), (11, "x" * 5000), (12, "one two three"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, kept string, row string, _n int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with all kinds of texts, and columns whose names operators use themselves."""
    rows = [(d, t, "en", "s0" if i % 3 else None, 0, i, "k", "r", i) for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark, data):
    """The small table's documents by id."""
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
