"""Token counts by a unigram vocabulary, with dynamic programming shared in a trie.

The distinct pre-tokens that a task meets are inserted in a trie. A node stands for a prefix and keeps the forward
score of the best segmentation of that prefix and its number of tokens, found once from the nodes above it however
many pre-tokens share the prefix; a pre-token's count is stored at its terminal. A document's count is the sum over
its pre-tokens. Nothing is shuffled; trie and counts start anew beyond ``max_nodes`` nodes, which bounds memory. A
pre-token beyond LONG characters, which shares little with others, runs through the same recursion without nodes: only
the scores of as many prefixes as the longest piece has characters are held.

Scores: the vocabulary is ordered by rank, and a piece of rank r weighs -log(r + 1) less a constant for each token. A
character without a piece falls back to one token for each of its bytes.

Defined cases: null and empty texts have no tokens; rows that repeat an id are counted row by row; an empty table gives
an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.shared import body, hold

LONG = 4096  # characters of a pre-token that the trie takes
MARK = "▁"  # begins a pre-token in the vocabulary


def piece_scores(path: str) -> dict[str, float]:
    """Scores of a vocabulary file's ordinary pieces, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    scale = math.log(sum(1 / (r + 1) for r in range(len(ordinary))))
    return {model.id_to_piece(i): -math.log(r + 1) - scale for r, i in enumerate(ordinary)}


class PrefixTrie:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.fallback = min(scores.values(), default=0.0) - 10  # of a byte
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.known = [(0.0, 0)]  # by node: score and tokens
        self.terminal: dict[str, int] = {}

    def __len__(self) -> int:
        return len(self.known)

    def _step(self, word: str, d: int, before: list[tuple[float, int]]) -> tuple[float, int]:
        """Score and tokens of the best segmentation of word[:d]; before: those of the last prefixes, the shortest first.

        Of equal scores the one with the longest last piece.
        """
        n_bytes = len(word[d - 1].encode("utf-8", "surrogatepass"))
        top, count = before[-1][0] + n_bytes * self.fallback, before[-1][1] + n_bytes
        for k, (best, tokens) in enumerate(before, d - len(before)):
            score = self.scores.get(word[k:d])
            if score is not None and best + score > top:
                top, count = best + score, tokens + 1
        return top, count

    def insert(self, word: str) -> int:
        """Adds the prefixes of word; the number of tokens in the best segmentation of word."""
        child, known = self.child, self.known
        last, node = [known[0]], 0
        for d, char in enumerate(word, 1):
            nxt = child.get((node, char))
            if nxt is None:
                nxt = child[node, char] = len(known)
                known.append(self._step(word, d, last))
            last.append(known[nxt])
            if len(last) > self.longest:
                del last[0]
            node = nxt
        return known[node][1]

    def roll(self, word: str) -> int:
        """The same number without nodes."""
        last = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            last.append(self._step(word, d, last))
            if len(last) > self.longest:
                del last[0]
        return last[-1][1]

    def count(self, pretoken: str, max_nodes: int) -> int:
        """Tokens of a pre-token, from its terminal if it has one."""
        n = self.terminal.get(pretoken)
        if n is None:
            if len(pretoken) > LONG:
                return self.roll(MARK + pretoken)
            if len(self) > max_nodes:
                self.clear()
            n = self.terminal[pretoken] = self.insert(MARK + pretoken)
        return n


@lru_cache(maxsize=2)
def _trie(path: str) -> PrefixTrie:
    return PrefixTrie(piece_scores(path))


def _count(path: str, max_nodes: int):
    def rows(batches):
        trie = _trie(path)
        hold("trie", trie.clear)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("t").to_pylist():
                parts = text.split()
                try:
                    n = sum(map(trie.terminal.__getitem__, parts))
                except KeyError:
                    n = sum(times * trie.count(part, max_nodes) for part, times in Counter(parts).items())
                words.append(len(parts))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return rows


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_nodes: int = 500_000) -> DataFrame:
    """One row for each document: doc_id, n_pretokens (runs without white space), n_tokens."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("t"))
    return df.mapInArrow(_count(path, max_nodes), "doc_id long, n_pretokens long, n_tokens long")
