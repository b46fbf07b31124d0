"""Token counts, byte-level BPE, token files and packing, against the libraries and by round trips."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from landgrid.llm import queries
from landgrid.llm.byte_bpe import byte_bpe, rank_encoder, stitch
from landgrid.llm.packing import best_cuts, cut_points, pack, powers, tail_cost
from landgrid.llm.token_counts import MARK, PrefixTrie, piece_scores, token_counts
from landgrid.llm.token_files import decode_ranks, encode_ranks, pack_shard, token_files, unpack_shard
from landgrid.llm.word_tokens import WordEncoder
from tests.llm.conftest import ODD

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*"abcÉéßÀÿŒœİıŉſ×÷ªµ'_  \n\t.,!12sdΣ\x1c\x85​\U0001F600́Z½٣\r-$<|>", "'re", "'S", "<|endoftext|>", "ΑΣ ", "'ll", "\n\n"]


def fuzz(n, seed, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(WORDS)
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_as_the_library(library):
    found = fuzz(8000, 2) + [f"{chr(c)}a{chr(c)} b{chr(c)}" for c in range(0x2500) if not 0xD800 <= c < 0xE000]
    for held in (600_000, 50):
        assert [x.tolist() for x in WordEncoder(WORDS, held).encode(found)] == library(found)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# byte-level BPE


def test_ranks_as_the_library():
    encoder = rank_encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for text in fuzz(4000, 4, 60):
        wanted = encoder.core.encode_ordinary(text)
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == wanted
        size, overlap = rng.randint(3, 12), rng.randint(4, 10)
        chunks = [(s, text[s : s + size + overlap], encoder.boundaries(text[s : s + size + overlap])) for s in range(0, max(1, len(text) - overlap), size)]
        pieces = stitch(chunks, encoder.boundaries)
        assert "".join(pieces) == text and np.frombuffer(encoder.encode_pieces(pieces), "<u4").tolist() == wanted
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_stitching_a_run_without_boundaries_is_linear():
    """White space has no boundary to resynchronise at; what is scanned again at most doubles with the text."""
    encoder = rank_encoder(RANKS, public_tokenizers.PATTERN)
    for text in (" " * 40_000, "a" * 40_000 + " b", " " * 20_000 + "a b c " * 3000):
        scanned = [0]

        def boundaries(t):
            scanned[0] += len(t)
            return encoder.boundaries(t)

        chunks = [(s, text[s : s + 580], encoder.boundaries(text[s : s + 580])) for s in range(0, len(text) - 80, 500)]
        assert stitch(chunks, boundaries) == [m.group() for m in encoder.pattern.finditer(text)]
        assert scanned[0] < 6 * len(text)


def expected_bpe(rows):
    encoder = rank_encoder(RANKS, public_tokenizers.PATTERN)
    out = []
    for d, t in rows:
        ids = np.array(encoder.core.encode_ordinary(t or ""), "<u4").tobytes()
        out.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [{}, {"chunk": 64, "overlap": 16}])
def test_bpe(odd, none, chunk):
    assert sorted((tuple(r) for r in byte_bpe(odd, RANKS, public_tokenizers.PATTERN, **chunk).collect()), key=repr) == expected_bpe(ODD)
    assert byte_bpe(none, RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_decodes(odd):
    assert all(r["decoded"] is not None for r in byte_bpe(odd, RANKS, public_tokenizers.PATTERN, full=True).collect())


# token counts


def viterbi(word, scores, fallback):
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        n = len(word[d - 1].encode("utf-8", "surrogatepass"))
        top = (best[d - 1][0] + n * fallback, best[d - 1][1] + n)
        for k in range(d):
            score = scores.get(word[k:d])
            if score is not None and best[k][0] + score > top[0]:
                top = (best[k][0] + score, best[k][1] + 1)
        best.append(top)
    return best[-1][1]


def test_counts(odd, none):
    scores = piece_scores(PIECES)
    fallback = PrefixTrie(scores).fallback
    wanted = sorted(((d, len((t or "").split()), sum(viterbi(MARK + p, scores, fallback) for p in (t or "").split())) for d, t in ODD), key=repr)
    for nodes in (500_000, 50):
        assert sorted((tuple(r) for r in token_counts(odd, PIECES, max_nodes=nodes).collect()), key=repr) == wanted
    assert token_counts(none, PIECES).collect() == []


def test_long_pretokens_need_no_nodes():
    rng = random.Random(6)
    trie = PrefixTrie(piece_scores(PIECES))
    for _ in range(60):
        word = MARK + "".join(rng.choice("abcdeimnorst中é\U0001f600") for _ in range(rng.randint(1, 80)))
        assert trie.roll(word) == trie.insert(word) == viterbi(word, trie.scores, trie.fallback)
    before = len(trie)
    assert trie.count("base64" * 50_000, 500_000) > 50_000 and len(trie) == before


def test_trie_shares_prefixes():
    trie = PrefixTrie({"a": -1.0, "ab": -1.5, "b": -1.0, "abc": -5.0})
    assert [trie.insert(w) for w in ("ab", "aba", "abc", "é")] == [1, 2, 1, 2]
    assert len(trie) == 1 + len({"a", "ab", "aba", "abc", "é"})


# token files


def test_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000, 300_001):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = encode_ranks(ranks)
        assert len(control) == -(-n // 4) and (decode_ranks(control, data, n) == ranks).all()


def test_shard_round_trip():
    ids = [np.array(x, np.uint16) for x in ([5, 5, 7], [], [9])]
    by_rank = np.array([5, 7, 9], "<u4")
    rank_of = np.zeros(10, np.uint32)
    rank_of[by_rank] = [0, 1, 2]
    doc_ids, counts, flat = unpack_shard(pack_shard([None, -3, 4], ids, rank_of), by_rank)
    assert doc_ids == [None, -3, 4] and counts.tolist() == [3, 0, 1] and flat.tolist() == [5, 5, 7, 9]
    with pytest.raises(ValueError):
        unpack_shard(b"something else" * 10, by_rank)


@pytest.mark.parametrize("shard", [1 << 22, 40])
def test_files(odd, none, library, shard):
    found = token_files(odd, WORDS, shard_tokens=shard, full=True).collect()
    wanted = sorted(((d, [*ids, 2]) for (d, _), ids in zip(ODD, library([t or "" for _, t in ODD]))), key=repr)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found), key=repr) == wanted
    in_order = sorted(found, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0, *(r.n_tokens for r in in_order)])[:-1].tolist()
    ids = [r.doc_id for r in in_order if r.doc_id is not None]
    assert ids == sorted(ids) and [r.doc_id for r in in_order][:2] == [None, None]
    assert token_files(none, WORDS).collect() == []


def test_files_table(spark, data, texts, library):
    wanted, at = [], 0
    for d, ids in zip(sorted(texts), library([texts[d] for d in sorted(texts)])):
        wanted.append((d, at, len(ids) + 1, crc([*ids, 2])))
        at += len(ids) + 1
    assert sorted(tuple(r) for r in queries.op8_token_files(spark, data).collect()) == wanted


# packing


def test_cuts_are_the_best():
    rng = random.Random(5)
    for _ in range(60):
        window, n = 12, rng.randint(1, 40)
        ends = np.unique([*rng.sample(range(1, n + 1), rng.randint(0, min(4, n))), n])
        places, cost = cut_points(ends, np.array(sorted(rng.sample(range(1, n + 1), rng.randint(0, min(6, n))))), window)
        least = {0: 0}
        for j, c in zip(places[1:-1].tolist(), cost[1:-1].tolist()):
            least[j] = min(least[i] + window - (j - i) + c for i in least if j - i <= window)
        wanted = min(v + tail_cost(n - i, window) for i, v in least.items() if n - i <= window)
        cuts = best_cuts(places, cost, window)
        price, at = 0, 0
        by = dict(zip(places.tolist(), cost.tolist()))
        for c in cuts:
            assert 0 < c - at <= window
            price += tail_cost(c - at, window) if c == n else window - (c - at) + by[c]
            at = c
        assert at == n and price == wanted
    assert powers(13, 16) == [8, 4, 1] and powers(16, 16) == [16]


def check_packing(rows, full, window=2048):
    by_doc, by_sequence, padding = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(full[d]) and r.ids_crc32 == crc(full[d][at : at + r.length])
            at += r.length
        assert at == len(full[d])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    assert set(by_doc) == set(full)
    return padding / sum(map(len, full.values()))


def test_packing_table(spark, data, texts, library):
    full = dict(zip(texts, ([*ids, 1] for ids in library(list(texts.values())))))
    assert check_packing(queries.op9_packing(spark, data).collect(), full) < 0.01
    small = pack(spark.read.parquet(f"{data}/documents.parquet"), WORDS, block=5000, window=64)
    assert check_packing(small.collect(), full, 64) < 0.1


def test_packing_odd(odd, none, library):
    tokens = sorted(len(ids) + 1 for ids in library([t or "" for _, t in ODD]))
    found = pack(odd, WORDS).collect()
    assert sorted(r.doc_tokens for r in found if r.start == 0) == tokens
    assert sum(r.length for r in found) == sum(tokens)
    assert pack(none, WORDS).collect() == []
