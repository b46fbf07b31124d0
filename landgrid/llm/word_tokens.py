"""Token ids of a vocabulary of the tokenizers library whose tokens never span white space."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from landgrid.llm.shared import hold

#: str.split() also splits at these; the tokenizer's pattern does not.
_OTHER_SPLITS = re.compile("[\x1c-\x1f]")
#: Text for which the tokenizer's normaliser only makes letters small: printable ASCII and Latin letters.
_LATIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
#: The tokenizer's pattern, for such text in small letters.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")


def _visible_bytes() -> dict[int, str]:
    """What a byte-level vocabulary writes for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts by their words between white space.

    What a word gives is remembered, up to ``held`` words, and what each piece of the tokenizer's pattern gives, up to
    half as many; words beyond Latin letters, and those that may hold a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str, held: int = 350_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.visible = _visible_bytes()
        self.held = held
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """As encode_batch(texts, add_special_tokens=False), for each text an array of ids."""
        return [np.frombuffer(x, self.dtype) for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if _OTHER_SPLITS.search(text):
                out.append(self._whole(text))
                continue
            words = text.split()
            new = set(words).difference(self.words)
            if new:
                if len(self.words) + len(new) > self.held:
                    self.words.clear()
                    new = set(words)
                for word in new:
                    self.words[word] = self._word(word)
            out.append(b"".join(map(self.words.__getitem__, words)))
        return out

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            piece = word.lower()
            return self.pieces.get(piece) or self._piece(piece)
        if "<|" in word or not _LATIN.fullmatch(word):
            return self._whole(word)
        found = _PIECES.findall(word.lower())
        if len(found) == 1:
            return self.pieces.get(found[0]) or self._piece(found[0])
        return b"".join([self.pieces.get(p) or self._piece(p) for p in found])

    def _piece(self, piece: str) -> bytes:
        if 2 * len(self.pieces) > self.held:
            self.pieces.clear()
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.visible)
        ids = b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])
        self.pieces[piece] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def sentence_ends(self) -> np.ndarray:
        """Ids of tokens that close a sentence."""
        return np.array(sorted(i for token, i in self.tokenizer.get_vocab().items() if re.fullmatch(r"[.!?]+(</w>)?", token)), np.int64)


@lru_cache(maxsize=2)
def _encoder(path: str, held: int) -> WordEncoder:
    return WordEncoder(path, held)


def word_encoder(path: str, held: int = 350_000) -> WordEncoder:
    """One for each Python worker."""
    encoder = _encoder(path, held)
    hold("words", _encoder.cache_clear)
    return encoder
