"""Exact, near and suffix dedup, by brute force."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from landgrid.llm import queries
from landgrid.llm.bwt import repeated_starts
from landgrid.llm.components import components
from landgrid.llm.exact_dedup import Chains, ExtendibleDirectory, exact_dedup
from landgrid.llm.near_dedup import Shingler, _rarest_lists, links, near_dedup, signatures
from landgrid.llm.suffix_dedup import anchors, halves, kept_bytes, removed_runs, suffix_dedup, without_repeats
from tests.llm.conftest import ODD, prose


# exact


def test_directory_doubles_and_splits():
    counts = [90, 1, 1, 1, 10, 10, 0, 0]
    directory = ExtendibleDirectory(25, 3)
    for slot, n in enumerate(counts):
        directory.insert(slot, n)
    assert directory.depth == 3 and len(directory.slots) == 8
    keys = (np.arange(8, dtype=np.uint64) << np.uint64(61)).view(np.int64)
    buckets = directory.bucket_of(keys)
    load = collections.Counter()
    for b, n in zip(buckets.tolist(), counts):
        load[b] += n
    # only the bucket whose keys agree in all bits known may be overfull; a split happens only where one overfills
    assert [n for n in load.values() if n > 25] == [90] and len(set(buckets[4:].tolist())) == 1
    assert dict(enumerate(directory.load)) == {b: load[b] for b in range(len(directory.load))}


def test_directory_holds_every_key_once():
    rng = random.Random(5)
    directory = ExtendibleDirectory(100, 10)
    given = collections.Counter()
    for _ in range(600):
        slot = rng.randrange(1 << 10) if rng.random() < 0.7 else 77
        given[slot] += (size := rng.randint(1, 40))
        directory.insert(slot, size)
    for slot, size in given.items():
        bucket = int(directory.bucket_of(np.array([slot << 54], np.uint64).view(np.int64))[0])
        assert directory.held[bucket][slot] == size
        assert directory.load[bucket] <= 100 or len(directory.held[bucket]) == 1


def test_chains_keep_texts_of_one_key_apart():
    chains = Chains()
    for text, low in ((b"a", 5), (b"b", 3), (b"a", 2), (b"a", 2), (b"b", None)):
        chains.add(7, b"", low, 1, 1, text)
    assert [(r[2], r[3], r[4]) for r in chains.records()] == [(2, 2, 3), (3, 1, 2)]


def expected_exact(rows):
    plain = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    size, low = collections.Counter(t for _, t in plain), {}
    for d, t in plain:
        if d is not None:
            low[t] = min(low.get(t, d), d)
    return sorted(((d, low.get(t), size[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in plain), key=repr)


def test_exact(odd, none):
    found = exact_dedup(odd, capacity=2).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == expected_exact(ODD)
    stay = collections.Counter(r.text_sha256 for r in found if r.kept)
    assert set(stay.values()) == {1} and len(stay) == len({x[3] for x in expected_exact(ODD)})
    assert exact_dedup(none).collect() == []


def test_owners_chain_texts_of_one_key(odd, monkeypatch):
    """All texts under one key: chains alone tell them apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr("landgrid.llm.exact_dedup.F.xxhash64", lambda *c: F.lit(5).cast("long"))
    found = exact_dedup(odd, capacity=2).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == expected_exact(ODD)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, data, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    found, wanted = queries.QUERIES[name](spark, data).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    order = lambda f: sorted(map(repr, f[columns].astype(object).itertuples(index=False, name=None)))
    assert order(found) == order(wanted)


# near


def expected_near(rows, width=5, percent=80):
    """Classes by the weighted similarity of all pairs of different texts with a common run."""
    groups: dict = {}
    for i, (_, t) in enumerate(rows):
        groups.setdefault(tuple((t or "").lower().split()), []).append(i)
    keys = list(groups)
    sets = [collections.Counter(k[i : i + width] for i in range(max(1, len(k) - width + 1))) if k else collections.Counter() for k in keys]
    total = [sum(s.values()) for s in sets]
    holders = collections.defaultdict(list)
    for a, s in enumerate(sets):
        for run in s:
            holders[run].append(a)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in enumerate(sets):
        common = collections.Counter()
        for run, n in s.items():
            for b in holders[run]:
                if b < a:
                    common[b] += min(n, sets[b][run])
        for b, n in common.items():
            if 100 * n >= percent * (total[a] + total[b] - n):
                root[max(find(a), find(b))] = min(find(a), find(b))
    members = collections.defaultdict(list)
    for k, own in enumerate(groups.values()):
        members[find(k)] += own
    out = []
    for own in members.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        out += [(rows[i][0], min(ids, default=None), len(own)) for i in own]
    return sorted(out, key=repr)


def near_rows():
    base = prose(50, 100).split()
    rows = list(ODD)
    rng = random.Random(9)
    for i in range(30):  # a group of near copies, some of which only meet through others
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = f"edit{rng.randint(0, 999)}"
        rows.append((100 + i, " ".join(words)))
    shared = prose(77, 40)  # a passage in texts that aren't similar
    rows += [(200 + i, f"{prose(300 + i, 40)} {shared} {prose(400 + i, 40)}") for i in range(20)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_near(spark, none, monkeypatch, small):
    if small:  # members of buckets meet further leaders and go by blocks, clusters go to several tasks
        for name, value in (("BUCKET", 3), ("TASK_BYTES", 4000)):
            monkeypatch.setattr(f"landgrid.llm.near_dedup.{name}", value)
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, bucket string").repartition(3)
    found = near_dedup(docs).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in found), key=repr) == expected_near(rows)
    if not small:
        assert near_dedup(none).collect() == []


def test_a_large_bucket_loses_no_link(spark):
    """Over 8192 different texts that share most of their words, in groups that are near copies only among themselves."""
    rng = random.Random(12)
    shared, rows = prose(90, 30).split(), []
    for group in range(12):
        own = prose(2000 + group, 90).split()
        for i in range(700):
            words = [*shared, *own]
            words[rng.randrange(len(words))] = f"edit{group}x{i}"
            rows.append((len(rows), " ".join(words)))
    # one edit each leaves two texts of a group 106 of 126 runs in common, of two groups 26 of 206
    found = near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {(r.doc_id, r.class_id, r.class_size) for r in found} == {(i, i // 700 * 700, 700) for i in range(len(rows))}


def test_real_weights_and_regions():
    """Darts fall below the weight only, at rates that don't hang on how it is cut into regions."""
    rng = np.random.default_rng(6)
    runs = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    wa = rng.uniform(0.2, 9.0, len(runs))
    wb = wa * rng.uniform(0.6, 1.4, len(runs))
    sig = signatures([runs, runs], [wa, wb], 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.03


def test_one_of_each_class_stays(spark):
    rows = near_rows()
    found = near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for class_id in {r.class_id for r in found if r.class_size > 1}:
        assert sum(r.kept for r in found if r.class_id == class_id and r.class_size > 1) == 1
    assert all(r.kept for r in found if r.class_size == 1)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    runs = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    a, b = runs[:2000], runs[500:2500]
    weights = rng.integers(1, 4, len(runs)).astype(np.uint32)
    wa, wb = weights[:2000], weights[500:2500]
    sig = signatures([a, b], [wa, wb], 2048)
    exact = weights[500:2000].sum() / (wa.sum() + wb.sum() - weights[500:2000].sum())
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04
    # a text's signature doesn't hang on what it is signed with, and tiny sets fill all coordinates
    assert (signatures([b], [wb], 2048)[0] == sig[1]).all()
    assert len(set(signatures([runs[:1]], [weights[:1]], 64)[0].tolist())) > 32


def test_links_by_brute_force():
    rng = random.Random(1)
    shingler = Shingler(2, True)
    texts = [[rng.choice("abcd") for _ in range(rng.randint(2, 8))] for _ in range(60)]
    packed = []
    for t in texts:
        runs, weights = shingler.elements(t)
        packed.append(runs.tobytes() + weights.tobytes())
    counts = [collections.Counter(zip(t, t[1:])) for t in texts]
    root = list(range(60))

    def find(r, x):
        while r[x] != x:
            x = r[x]
        return x

    for i in range(60):
        for j in range(i):
            if 10 * sum((counts[i] & counts[j]).values()) >= 6 * sum((counts[i] | counts[j]).values()):
                root[max(find(root, i), find(root, j))] = min(find(root, i), find(root, j))
    mine = list(range(60))
    for i, j in links(packed, 60):
        mine[max(find(mine, i), find(mine, j))] = min(find(mine, i), find(mine, j))
    part = lambda r: {frozenset(j for j in range(60) if find(r, j) == find(r, i)) for i in range(60)}
    assert part(mine) == part(root)


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 30)] + [(50, 40), (45, 50), (40, 45), (7, 7)]
    for bound in (100, 0):
        found = {tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5), bound).collect()}
        assert found == {(i, 10) for i in range(11, 31)} | {(45, 40), (50, 40)}


# suffix


def test_interval_expansion():
    rng = random.Random(3)
    for n in range(150):
        least = rng.randint(1, 6)
        strings = [bytes(rng.choice(b"ab\0" if n % 2 else b"abcd\xff") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        count = collections.Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
        wanted = [[i for i in range(len(s) - least + 1) if count[s[i : i + least]] > 1] for s in strings]
        assert [x.tolist() for x in repeated_starts(strings, least)] == wanted


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    for n in range(40):
        texts = [bytes(rng.choice(b"ab" if n % 3 else b"abcdefgh") for _ in range(rng.randint(0, 150))) for _ in range(5)]
        text, gram, first, windows, at = anchors(texts, 40)
        assert all((0 <= at) & (at <= 8) & (at >= windows - 1))
        places = [(int(a), int(b) + k, int(g)) for a, g, b, c in zip(text, gram, first, windows) for k in range(c)]
        assert sorted(p[:2] for p in places) == [(i, j) for i, t in enumerate(texts) for j in range(len(t) - 39)]
        seen: dict = {}
        assert all(seen.setdefault(texts[i][j : j + 40], g) == g for i, j, g in places)


def expected_suffix(rows, least=200):
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = collections.Counter(b[i : i + least] for _, b in raw for i in range(len(b) - least + 1))
    out = []
    for d, b in raw:
        runs = removed_runs([(i, i) for i in range(len(b) - least + 1) if count[b[i : i + least]] > 1], least)
        out.append((d, len(b), sum(y - x for x, y in runs), len(runs), hashlib.sha256(kept_bytes(b, runs)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"most_bytes": 1000, "task_bytes": 5000}, {"most_bytes": 1, "task_bytes": 5000}])
def test_suffix(spark, none, sizes):
    passage = prose(60, 60)
    rows = [*ODD, *((300 + i, f"{prose(500 + i, 10)} {passage} {prose(600 + i, 10)}") for i in range(12)), (400, prose(61, 80) + prose(61, 80)), (401, "é" * 150 + prose(5, 40)), (402, "zé" + "é" * 150)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, found int").repartition(3)
    assert sorted((tuple(r) for r in suffix_dedup(docs, **sizes).collect()), key=repr) == expected_suffix(rows)
    assert suffix_dedup(none).collect() == []


def test_halves_deal_equal_windows_alike():
    rng = random.Random(8)
    least, gram = 40, 32
    for _ in range(60):
        base = bytes(rng.choice(b"abcd") for _ in range(90))
        segments = []
        for _ in range(4):  # segments around one anchor, with other bytes beside it
            at, n = rng.randint(0, 8), rng.randint(1, 9)
            n = min(n, at + 1)
            left = bytes(rng.choice(b"ab") for _ in range(at))
            right = bytes(rng.choice(b"ab") for _ in range(n - 1 + least - gram - at))
            segments.append((left + base[:gram] + right, at))
        todo, dealt = [(s, at, 0, 8, 0, 0, k) for k, (s, at) in enumerate(segments)], {}
        while todo:
            segment, at, lo, hi, group, shift, k = todo.pop()
            if lo == hi:
                assert len(segment) == least and shift not in dealt.get((k, shift), {})
                dealt[k, shift] = (group, segment)
                continue
            todo += [(part, at - s, low, high, g, shift + s, k) for s, g, low, high, part in halves(segment, at, lo, hi, group, least)]
        # each window is dealt once, and groups at the end are those of equal windows
        assert sorted(dealt) == [(k, w) for k, (s, _) in enumerate(segments) for w in range(len(s) - least + 1)]
        by_group, by_window = {}, {}
        for (k, w), (group, piece) in dealt.items():
            assert piece == segments[k][0][w : w + least]
            assert by_group.setdefault(group, piece) == piece and by_window.setdefault(piece, group) == group


def test_suffix_removal_keeps_columns(spark, odd, none):
    out = without_repeats(odd)
    assert out.schema == odd.schema and out.count() == odd.count()
    assert without_repeats(none).collect() == []
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[12] == "one two three" and kept[1] == ""


def test_suffix_table(spark, data, texts):
    found = sorted((tuple(r) for r in queries.op3_suffix_dedup(spark, data).collect()), key=repr)
    assert found == expected_suffix(texts.items())


def test_near_table(spark, data, texts):
    found = sorted(((r.doc_id, r.class_id, r.class_size) for r in queries.op7_near_dedup(spark, data).collect()), key=repr)
    assert found == expected_near(list(texts.items()))


def test_near_larger_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(((r.doc_id, r.class_id, r.class_size) for r in queries.op7_near_dedup(spark, folder).collect()), key=repr)
    assert found == expected_near(rows)


def test_rarest_lists_spare_what_all_have_in_common():
    """Signatures that share 30 of 72 coordinates, and some 41: those few meet, and no pair is lost."""
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 30, (400, 72)).astype(np.int32)
    sig[:, :30] = sig[0, :30]
    for i in range(0, 100, 2):
        sig[i + 1, 30 : 41 + i % 3] = sig[i, 30 : 41 + i % 3]
    others = _rarest_lists(sig, 41)
    met = {(i, j) for i in range(400) for j in others(i).tolist() if i < j}
    assert {(i, j) for i in range(400) for j in range(i + 1, 400) if (sig[i] == sig[j]).sum() >= 41} <= met
    assert len(met) < 400  # of 79,800 pairs
