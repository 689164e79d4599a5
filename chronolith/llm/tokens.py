"""Token ids of whole texts by a public tokenizer, with a cache of what stands between white space."""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

CACHE, CACHED_LENGTH = 250_000, 48  # remembered pieces of at most so many characters, some 50 MB in each worker; beyond it the cache starts anew

# The tokenizer lower-cases, splits runs of letters, single digits and runs of other
# characters, and never joins across white space, so a text's ids are those of its pieces.
_ODD = {chr(c) for c in (*range(0x1C, 0x20), 0x85)}  # str.split and the tokenizer disagree on these


class WordEncoder(dict):
    """Piece to its ids as little-endian unsigned 32-bit bytes.

    For a tokenizer whose ids do not depend on what stands beyond white space,
    such as ``word_bpe_49k.json``; texts with a control character that is white
    space to one side only are encoded whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.bpe = self.whole.model
        self.byte = self._byte_characters()

    @staticmethod
    def _byte_characters() -> dict[int, str]:
        """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _by_tokenizer(self, piece: str) -> bytes:
        return np.array(self.whole.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of a run of lower-case Latin-1 letters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.byte)
        return np.array([t.id for t in self.bpe.tokenize(word)], dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if piece.isalpha() and max(piece) < "Ā":
            low = piece.lower()
            ids = self._letters(low) if low == piece else self[low]
        else:
            end = len(piece)
            while end and not piece[end - 1].isalnum() and piece[end - 1] not in "'<>|" and piece[end - 1] < "\u007f":
                end -= 1
            word = piece[:end]
            if 0 < end < len(piece) and word.isalpha() and max(word) < "Ā":
                ids = self[word] + self[piece[end:]]
            else:
                ids = self._by_tokenizer(piece)
        if len(piece) <= CACHED_LENGTH:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of the whole text, as bytes."""
        if "<|" in text or not text.isprintable() and not _ODD.isdisjoint(text):
            return self._by_tokenizer(text)
        if text.isascii() or max(text) < "Ā":  # lower-casing goes letter by letter there
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
