"""Near-dedup by dart throwing (sparse weighted minwise signatures) and banded joining.

The elements of a document are its distinct runs of ``width`` words, weighted by how often they occur (or 1 each). The
weight axis of an element is cut into regions, 0 to 1 and then twice as long each; hashed darts fall on a region at the
arrivals of a Poisson process with the region's length as its rate, each at a hashed height, and all documents see the
same darts. A document takes the darts below its element's weight that arrive before a time at which about
``t = k (ln k + 2)`` have hit its total weight, deals them to k coordinates by hash, and keeps the earliest of each;
where a coordinate stays empty it waits twice as long. So a signature costs about t darts and a few regions for each
element, however large the weights. Two signatures agree in a coordinate with the probability of the documents' weighted
Jaccard similarity.

Documents with equal words (by a 128-bit hash) fold into one node first. Nodes that agree in all rows of a band share a
bucket. Clusters are the components of nodes of one bucket whose signatures agree in so many coordinates that a pair at
the least similarity misses it by 4.6 standard deviations only. All members of a bucket meet a leader; then, in buckets
that still span several clusters, all members outside the bucket's largest cluster meet all members, as every link that
is left has an end outside. Large buckets have their members meet further leaders first, and then go to tasks by blocks
of those outside and blocks of all; nothing is left out at any size. Within a task, members are compared where they share
one of their rarest coordinates (or elements), as any pair of enough in common does. Searches give one link for each merger, not all
pairs. Within a cluster, links are exact: inverted lists of the whole element sets give a node's common weight with all
others at once, and the classes are the components of the pairs that reach the least similarity. Members of a cluster
beyond a task meet their leader exactly, and those that aren't linked to it meet all members, in blocks as well.

Defined cases: null and empty texts have no words and form one class, as do other texts of equal words; texts of fewer
words than ``width`` have one run of all; rows with a null id join classes, whose id is their least other id (null
without any); rows that repeat an id keep a row each; of a class one row is kept; an empty table gives an empty
result; only the id and text columns are read, and other columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.llm.components import components
from landgrid.llm.shared import Scratch, body, hold, key_bitmap, tidy, written

BUCKET = 8192  # signatures of a block
FEW = 64  # signatures that are compared without lists of the rarest coordinates
MASK = (1 << 64) - 1
LEADERS = 3  # that members of buckets with more than a block outside the largest cluster meet before blocks meet
TASK_BYTES = 4 << 20  # of element sets of clusters that a task searches; a larger cluster goes by blocks of twice as many
SEEN = 100_000  # texts that a task remembers so as not to sign their copies again
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, width: int, weighted: bool, held: int = 100_000):
        self.width, self.weighted, self.held = width, weighted, held
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        return text.lower().split()

    def elements(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashed runs in ascending order, and their weights."""
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.uint32)
        known = self.known
        if len(known) > self.held:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(hashed) - self.width + 1)
        run = np.full(n, len(words) if n == 1 else self.width, np.uint64)
        for i in range(min(self.width, len(hashed))):
            run = mix(run * STEP + hashed[i : i + n])
        runs, counts = np.unique(run, return_counts=True)
        return runs, counts.astype(np.uint32) if self.weighted else np.ones(len(runs), np.uint32)


def signatures(elements: list[np.ndarray], weights: list[np.ndarray], k: int) -> np.ndarray:
    """A row of k 32-bit values for each document; no document may be without elements. Weights are above 0."""
    out = np.zeros((len(elements), k), np.int32)
    todo, wait = np.arange(len(elements)), 1.0
    while len(todo):
        sizes = np.array([len(elements[d]) for d in todo])
        weight = np.concatenate([weights[d] for d in todo]).astype(np.float64)
        owner = np.repeat(np.arange(len(todo)), sizes)
        total = np.bincount(owner, weight, minlength=len(todo))
        regions = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # 0 to 1, 1 to 2, 2 to 4, ... up to the weight
        ends = np.cumsum(regions)
        region = np.arange(ends[-1]) - np.repeat(ends - regions, regions)
        low = np.where(region == 0, 0.0, 2.0 ** (region - 1))
        length = np.where(region == 0, 1.0, low)
        doc = np.repeat(owner, regions)
        share = (np.repeat(weight, regions) - low) / length  # of the region's heights that are below the weight
        until = (wait * k * (math.log(k) + 2) / total)[doc] * length
        line = mix(np.repeat(np.concatenate([elements[d] for d in todo]), regions) + STEP * (region.astype(np.uint64) + np.uint64(1)))
        time, round_ = np.zeros(len(line)), 0  # in units in which each region has one dart
        found: list[tuple[np.ndarray, ...]] = []
        while len(line):
            round_ += 1
            dart = mix(line + np.uint64((int(STEP) * round_) & MASK))
            time = time - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            early = time < until
            line, time, until, doc, share, length, dart = (x[early] for x in (line, time, until, doc, share, length, dart))
            inside = share >= 1
            if not inside.all():
                part = np.flatnonzero(~inside)
                inside[part] = ((mix(dart[part] + STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53) < share[part]
            name = mix(dart[inside] ^ STEP)
            place = doc[inside] * k + ((name >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            found.append((place, time[inside] / length[inside], (name & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
        place, when, value = (np.concatenate(x) for x in zip(*found))
        late_first = np.argsort(-when)
        rows, filled = np.zeros(len(todo) * k, np.int32), np.zeros(len(todo) * k, bool)
        rows[place[late_first]] = value[late_first]  # the earliest is written last and stays
        filled[place] = True
        whole = filled.reshape(-1, k).all(axis=1)
        out[todo[whole]] = rows.reshape(-1, k)[whole]
        todo, wait = todo[~whole], wait * 2
    return out


def _key(words: list[str]) -> int:
    return xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))


def _halves(keys: list[int]) -> list[pa.Array]:
    raw = np.frombuffer(b"".join(x.to_bytes(16, "big") for x in keys), ">i8").reshape(-1, 2).astype(np.int64)
    return [pa.array(raw[:, 0]), pa.array(raw[:, 1])]


def _sign(width: int, weighted: bool, k: int, at_once: int = 300_000):
    """at_once: elements and darts that are held together."""
    darts = round(k * (math.log(k) + 2))

    def rows(batches):
        hold("near")
        shingler, seen = Shingler(width, weighted), set()
        for batch in batches:
            ids, keys, sigs = batch.column("doc_id").to_pylist(), [], {}
            pending, held = [], 0

            def flush():
                for i, sig in zip([p[0] for p in pending], signatures([p[1] for p in pending], [p[2] for p in pending], k)):
                    sigs[i] = sig.tobytes()

            for i, text in enumerate(batch.column("t").to_pylist()):
                words = shingler.words(text)
                keys.append(_key(words))
                if keys[-1] in seen or not words:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(keys[-1])
                pending.append((i, *shingler.elements(words)))
                held += 2 * len(pending[-1][2]) + darts
                if held > at_once:
                    flush()
                    pending, held = [], 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *_halves(keys), pa.array([sigs.get(i) for i in range(len(ids))], pa.binary())],
                ["doc_id", "k1", "k2", "sig"],
            )

    return tidy(rows)


def with_words_key(docs: DataFrame, k1: str, k2: str, text_col: str = "text") -> DataFrame:
    """docs with the halves of the hash of their words."""

    def rows(batches):
        for batch in batches:
            keys = [_key((t or "").lower().split()) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_halves(keys)], [*batch.schema.names, k1, k2])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(k1, T.LongType()), T.StructField(k2, T.LongType())]))


def _bands(k: int, rows_: int):
    def rows(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.int32).reshape(n, k)
            node = np.array(batch.column("node").to_pylist(), np.int64)
            key = np.tile(np.arange(1, k // rows_ + 1, dtype=np.uint64), (n, 1))
            for i in range(rows_):
                key = mix(key * STEP + sig[:, i::rows_].astype(np.uint32).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(node, k // rows_))], ["bucket", "node"])

    return rows


def _sets(width: int, weighted: bool, bitmap: np.ndarray, bits: int):
    def rows(batches):
        hold("near")
        shingler, seen = Shingler(width, weighted), set()
        for batch in batches:
            keys, sets = [], []
            for text in batch.column("t").to_pylist():
                words = shingler.words(text)
                key = _key(words)
                bit = key >> 64 & ((1 << bits) - 1)
                if not words or key in seen or not int(bitmap[bit >> 6]) >> (bit & 63) & 1:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(key)
                runs, weights = shingler.elements(words)
                keys.append(key)
                sets.append(runs.tobytes() + weights.tobytes())
            yield pa.RecordBatch.from_arrays([*_halves(keys), pa.array(sets, pa.binary())], ["k1", "k2", "runs"])

    return tidy(rows)


def _agreeing(k: int, least: int):
    """Pairs whose signatures agree in at least so many coordinates."""

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).reshape(-1, k) for c in ("sig_a", "sig_b"))
                batch = batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))
            yield batch.select(["a", "b"])

    return rows


def _weights_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n).astype(np.int64)


class _Merging:
    """Components of the places 0 to n - 1 while links come in."""

    def __init__(self, n: int, labels: np.ndarray | None = None):
        self.of = np.unique(labels, return_inverse=True)[1] if labels is not None else np.arange(n)
        self.size = np.bincount(self.of, minlength=n)

    def link(self, i: int, others: np.ndarray) -> list[int]:
        """Merges i with others; those whose link merged two components."""
        new = []
        for j in others[self.of[others] != self.of[i]].tolist():
            a, b = self.of[i], self.of[j]
            if a != b:
                self.of[self.of == b] = a
                self.size[a] += self.size[b]
                self.size[b] = 0
                new.append(j)
        return new

    @property
    def largest(self) -> int:
        return int(np.argmax(self.size))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after another."""
    last = np.cumsum(lengths)
    return np.arange(last[-1] if len(last) else 0) + np.repeat(starts - (last - lengths), lengths)


def links(sets: list[bytes], percent: int, label: np.ndarray | None = None, asking: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of element sets of at least the similarity that join them into their components (a spanning forest).

    Every link between two components has an end outside the largest, so that only members outside it are compared
    with all. label: components that are known; asking: only members marked are compared with all.

    Sets of the least similarity share an element among their rarest ones, those before the weight that each may lack in
    common with the other: only sets that meet in those lists are compared, as what all have in common is in none of them.
    """
    n = len(sets)
    runs, weights = map(list, zip(*map(_weights_of, sets)))
    sizes = np.array([len(r) for r in runs])
    total = np.array([int(w.sum()) for w in weights])
    ids = np.unique(np.concatenate(runs), return_inverse=True)[1].astype(np.int32)
    weight = np.concatenate(weights).astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    rarest = np.lexsort((ids, np.bincount(ids)[ids], owner))
    ids, weight = ids[rarest], weight[rarest]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    upto = np.cumsum(weight, dtype=np.int64) - weight
    spare = total - (percent * total + 99) // 100  # weight that a set may lack in common with a similar one
    early = upto - np.repeat(upto[begins], sizes) <= spare[owner]
    heads = np.bincount(owner[early], minlength=n)
    listed = np.flatnonzero(early)
    listed = listed[np.argsort(ids[listed], kind="stable")]
    counts = np.bincount(ids[listed], minlength=int(ids.max(initial=-1)) + 1)
    firsts, listed = np.cumsum(counts) - counts, owner[listed]
    own = np.zeros(len(counts), np.int32)  # the weights of the set that is compared
    merging, done, found = _Merging(n, label), np.zeros(n, bool), []

    def compare(i: int) -> None:
        done[i] = True
        met = listed[_ranges(firsts[ids[begins[i] : begins[i] + heads[i]]], counts[ids[begins[i] : begins[i] + heads[i]]])]
        others = np.unique(met[merging.of[met] != merging.of[i]])
        others = others[100 * np.minimum(total[others], total[i]) >= percent * np.maximum(total[others], total[i])]
        if not len(others):
            return
        all_own = slice(begins[i], ends[i])
        own[ids[all_own]] = weight[all_own]
        places = _ranges(begins[others], sizes[others])
        common = np.add.reduceat(np.minimum(weight[places], own[ids[places]]), np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        own[ids[all_own]] = 0
        near = 100 * common >= percent * (total[i] + total[others] - common)
        found.extend((i, j) for j in merging.link(i, others[near]))

    if asking is not None:
        for i in np.flatnonzero(asking).tolist():
            compare(i)
        return found
    if n:
        compare(0)
    while len(todo := np.flatnonzero(~done & (merging.of != merging.largest))):
        for i in todo.tolist():
            if merging.of[i] != merging.largest:
                compare(i)
    return found


def _edges(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return np.array(table.column(name).to_pylist(), np.int64)


def _linked(percent: int):
    """A task's clusters, each searched for its links."""

    def one(table: pa.Table) -> pa.Table:
        hold("near")
        cluster, node = _ints(table, "cluster"), _ints(table, "node")
        runs = table.column("runs").to_pylist()
        order = np.argsort(cluster, kind="stable")
        cuts = np.flatnonzero(np.diff(cluster[order], prepend=cluster[order[:1]] - 1))
        a, b = [], []
        for part in np.split(order, cuts[1:]):
            for i, j in links([runs[k] for k in part.tolist()], percent):
                a.append(int(node[part[i]]))
                b.append(int(node[part[j]]))
        return _edges(a, b)

    return one


def _linked_across(percent: int):
    """Links of a block of a cluster's asking members with a block of all its members."""

    def one(table: pa.Table) -> pa.Table:
        hold("near")
        node, label, asking = _ints(table, "node"), _ints(table, "label"), _ints(table, "asking") > 0
        found = links(table.column("runs").to_pylist(), percent, label, asking) if asking.any() else []
        return _edges([int(node[i]) for i, _ in found], [int(node[j]) for _, j in found])

    return one


def _met_leader(percent: int):
    """node, lead: members whose elements are similar enough to their leader's."""

    def rows(batches):
        hold("near")
        lead, own, held = None, None, None
        for batch in batches:
            keep = []
            for i, (l, leading, runs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lead", "lead_runs", "runs")))):
                if l != lead:
                    lead, (own, held) = l, _weights_of(leading)
                other, weight = _weights_of(runs)
                _, x, y = np.intersect1d(own, other, assume_unique=True, return_indices=True)
                common = int(np.minimum(held[x], weight[y]).sum())
                if 100 * common >= percent * (int(held.sum()) + int(weight.sum()) - common):
                    keep.append(i)
            yield batch.select(["node", "lead"]).take(pa.array(keep, pa.int64()))

    return rows


def _rarest_lists(sig: np.ndarray, least: int):
    """others(i): the rows that may agree with row i in so many coordinates: they share one of its rarest values.

    In a bucket whose members have a passage in common, its coordinates are in no list, and what is left is short.
    """
    n, k = sig.shape
    token, count, many = np.empty((n, k), np.int64), np.empty((n, k), np.int64), 0
    for c in range(k):
        _, token[:, c], times = np.unique(sig[:, c], return_inverse=True, return_counts=True)
        count[:, c] = times[token[:, c]]
        token[:, c] += many
        many += len(times)
    head = np.take_along_axis(token, np.argsort(count * many + token, axis=1)[:, : k - least + 1], axis=1)
    listed = np.argsort(head, axis=None, kind="stable")
    counts = np.bincount(head.ravel(), minlength=many)
    firsts, listed = np.cumsum(counts) - counts, listed // head.shape[1]
    return lambda i: np.unique(listed[_ranges(firsts[head[i]], counts[head[i]])])


def _searched(k: int, least: int):
    """Links that merge the clusters of a bucket's nodes, by their signatures: the asking ones are compared with all that may agree."""

    def one(table: pa.Table) -> pa.Table:
        hold("near")
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.int32).reshape(-1, k)
        node, label = _ints(table, "node"), _ints(table, "label")
        merging, a, b = _Merging(len(node), label), [], []
        every = np.arange(len(node))
        maybe = _rarest_lists(sig, least) if len(node) > FEW else lambda i: every
        for i in np.flatnonzero(_ints(table, "asking")).tolist():
            others = maybe(i)
            others = others[merging.of[others] != merging.of[i]]
            others = others[(sig[others] == sig[i]).sum(axis=1) >= least]
            for j in merging.link(i, others):
                a.append(int(node[i]))
                b.append(int(node[j]))
        return _edges(a, b)

    return one


class _Search:
    """Clusters of nodes, while buckets are searched."""

    def __init__(self, sigs: DataFrame, k: int, percent: int):
        self.sigs, self.k = sigs, k
        p = percent / 100
        self.least = max(1, math.floor(k * (p - 4.6 * math.sqrt(p * (1 - p) / k))))
        self.stars = sigs.sparkSession.createDataFrame([], "a long, b long")

    def open(self, entries: DataFrame) -> DataFrame:
        """Entries, with their labels, of buckets that span several clusters; the buckets' sizes; whether a member is outside the largest cluster."""
        stars = self.stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
        labelled = entries.select("bucket", "node").join(stars, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
        labelled = written(labelled, "near-labelled")
        wide = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
        parts = labelled.join(wide, "bucket", "left_semi").groupBy("bucket", "label").agg(F.count("*").alias("n"))
        sizes = parts.groupBy("bucket").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("major"))
        found = labelled.join(sizes, "bucket").select("bucket", "node", "label", "size", (F.col("size") - F.col("most")).alias("outside"), (F.col("label") != F.col("major")).alias("asking"))
        return written(found, "near-open")

    def link(self, edges: DataFrame) -> None:
        edges = written(edges, "near-links")
        if not edges.isEmpty():
            self.stars = components(self.stars.unionByName(edges))

    def star(self, entries: DataFrame, seed: int, leading="true") -> None:
        """All members of a bucket meet its leader, by one order of all nodes for each seed, so that alike buckets share it."""
        lead = entries.filter(leading).groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", F.lit(seed))).alias("lead"))
        met = entries.join(lead, "bucket").filter("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        side = lambda c: self.sigs.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
        self.link(met.join(side("a"), "a").join(side("b"), "b").mapInArrow(_agreeing(self.k, self.least), "a long, b long"))

    def search(self, entries: DataFrame) -> None:
        """Members outside the largest cluster with all."""
        rows = across(entries.join(self.sigs, "node"), F.ceil(F.col("outside") / BUCKET), F.ceil(F.col("size") / BUCKET))
        rows = rows.select("bucket", "ask_block", "all_block", "node", "label", "sig", F.col("asking").cast("int").alias("asking"))
        self.link(rows.groupBy("bucket", "ask_block", "all_block").applyInArrow(_searched(self.k, self.least), "a long, b long"))


def across(rows: DataFrame, asks, alls) -> DataFrame:
    """Rows (with node and asking) for tasks ask_block, all_block: each row of all asking blocks, and each asking row beside all blocks.

    Where there is one block of either, rows come once. In other tasks only rows that come for their asking are marked so.
    """
    rows = rows.withColumns({"_asks": F.greatest(asks.cast("int"), F.lit(1)), "_alls": F.greatest(alls.cast("int"), F.lit(1))})
    block = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    one = rows.filter("_alls = 1").withColumns({"ask_block": F.lit(0), "all_block": F.lit(0)})
    several = rows.filter("_alls > 1")
    base = several.withColumn("all_block", block("_alls", 1)).withColumn("ask_block", F.explode(F.sequence(F.lit(0), F.col("_asks") - 1))).withColumn("asking", F.lit(False))
    asked = several.filter("asking").withColumn("ask_block", block("_asks", 2)).withColumn("all_block", F.explode(F.sequence(F.lit(0), F.col("_alls") - 1)))
    return one.unionByName(base).unionByName(asked).drop("_asks", "_alls")


def _classes(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stars (a, b) of the verified links within clusters (the stars given)."""
    cluster = stars.select(F.col("a").alias("node"), F.col("b").alias("cluster")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("cluster")).distinct())
    rows = cluster.join(sets, "node").withColumn("bytes", F.length("runs").cast("long"))
    rows = written(rows, "near-clusters")
    sizes = rows.groupBy("cluster").agg(F.sum("bytes").alias("total"))
    tasks = max(1, math.ceil((sizes.agg(F.sum("total")).first()[0] or 0) / TASK_BYTES))
    kind = "a long, b long"
    large = written(sizes.filter(F.col("total") > 2 * TASK_BYTES), "near-large")
    some_large = not large.isEmpty()
    small = rows.join(large.select("cluster"), "cluster", "left_anti") if some_large else rows
    found = small.select("cluster", "node", "runs", F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("task")).groupBy("task").applyInArrow(_linked(percent), kind)
    if not some_large:
        return components(written(found, "near-found"))  # written apart from their reduction, so that a task has one Python worker at a time
    rows = rows.join(large, "cluster").select("cluster", "node", "runs", "bytes", "total")
    leaders = rows.filter("node = cluster").select("cluster", F.col("node").alias("lead"), F.col("runs").alias("lead_runs"))
    met = rows.filter("node <> cluster").join(leaders, "cluster").select("node", "lead", "runs", "lead_runs")
    starred = written(met.mapInArrow(_met_leader(percent), "node long, lead long"), "near-met")
    rows = rows.join(starred, "node", "left").withColumn("asking", F.col("lead").isNull() & (F.col("node") != F.col("cluster"))).withColumn("label", F.coalesce("lead", "node")).drop("lead")
    outside = rows.groupBy("cluster").agg(F.sum(F.when(F.col("asking"), F.col("bytes")).otherwise(0)).alias("outside")).filter("outside > 0")
    rows = across(rows.join(outside, "cluster"), F.ceil(F.col("outside") / (2 * TASK_BYTES)), F.ceil(F.col("total") / (2 * TASK_BYTES)))
    rows = rows.select("cluster", "ask_block", "all_block", "node", "label", "runs", F.col("asking").cast("int").alias("asking"))
    found = found.unionByName(starred.select(F.col("node").alias("a"), F.col("lead").alias("b")))
    return components(written(found.unionByName(rows.groupBy("cluster", "ask_block", "all_block").applyInArrow(_linked_across(percent), kind)), "near-found"))


def shared_buckets(entries: DataFrame) -> DataFrame:
    entries = written(entries, "near-entries")
    several = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    return written(entries.join(several, "bucket"), "near-buckets")


def _near_classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """The documents with the hash of their words, and root, class_id and class_size of hashes in classes of several.

    Classes are told apart by root: those without ids, or of rows that repeat an id, may share class_id.
    """
    k = bands * rows
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("t"))
    signed = df.mapInArrow(_sign(width, weighted, k), "doc_id long, k1 long, k2 long, sig binary").withColumn("row", F.monotonically_increasing_id())
    signed = written(signed, "near-signed")
    nodes = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("sig").alias("sig"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")  # a number for each hash of 128 bits
    sigs = nodes.filter("sig is not null").select("node", "sig")
    buckets = shared_buckets(sigs.mapInArrow(_bands(k, rows), "bucket long, node long"))
    paired = written(nodes.join(buckets.select("node").distinct(), "node").select("node", "sig"), "near-paired")

    search = _Search(paired, k, percent)
    search.star(buckets, 0)
    left = search.open(buckets)
    for seed in range(1, LEADERS):
        large = left.filter(F.col("outside") > BUCKET)
        if large.isEmpty():
            break
        search.star(large, seed, "asking")
        left = search.open(left)
    search.search(left)

    stars = search.stars
    clustered = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    clustered = written(clustered.join(nodes.select("node", "k1", "k2"), "node"), "near-clustered")
    bitmap, bits = key_bitmap(clustered.select(F.col("k1").alias("key")))
    sets = df.select("t").mapInArrow(_sets(width, weighted, bitmap, bits), "k1 long, k2 long, runs binary")
    sets = sets.join(clustered, ["k1", "k2"]).groupBy("node").agg(F.first("runs").alias("runs"))
    label = _classes(stars, sets, percent).select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = nodes.join(label, "node", "left").select("k1", "k2", "least", "copies", F.coalesce("root", "node").alias("root"))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")).filter("class_size > 1")
    return signed, written(named.join(classes, "root").select("k1", "k2", "root", "class_id", "class_size"), "near-classes")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 24, rows: int = 3, weighted: bool = True) -> DataFrame:
    """One row for each document: doc_id, class_id (least id of the class), class_size, kept.

    Parameters: runs of ``width`` words, links from a similarity of ``percent``, ``bands`` of ``rows`` coordinates,
    ``weighted``: whether runs count as often as they occur. With 24 bands of 3 rows, a link at exactly 0.8 is missed
    where no band agrees (3 in 100 million) or too few coordinates do (3 in a million), at any size of a bucket.
    """
    return near_rows(docs, id_col, text_col, width, percent, bands, rows, weighted).drop("k1", "k2")


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 24, rows: int = 3, weighted: bool = True) -> DataFrame:
    """The rows of near_dedup with the halves of the hash of their words, k1 and k2."""
    with Scratch() as scratch:
        signed, named = _near_classes(docs, id_col, text_col, width, percent, bands, rows, weighted)
        scratch.keep(signed), scratch.keep(named)
    one = F.lit(1).cast("long")
    out = signed.select("row", "doc_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    alone = F.col("class_size").isNull()
    out = out.select("row", "doc_id", "k1", "k2", "root", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", one).alias("class_size"), alone.alias("alone"))
    lead = ~F.col("alone") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    led = out.filter(lead)  # rows that repeat the least id, or null ids, lead together: one stays
    first = led.groupBy("root").agg(F.min(F.struct("k1", "k2", "row")).alias("first"))
    led = led.join(first, "root").withColumn("kept", F.col("row") == F.col("first.row")).drop("first")
    return out.filter(~lead).withColumn("kept", F.col("alone")).unionByName(led).drop("alone", "root", "row")
