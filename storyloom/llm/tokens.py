"""Token ids of whole texts, with repeated pieces encoded once."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from storyloom.llm.common import kept

#: Pieces whose ids a worker keeps, half of them at most from the memory before; it is started afresh when it is full.
KEPT_PIECES = 1_000_000
#: Longer pieces are encoded but not kept, so that the memory is bounded in bytes as well.
KEPT_CHARS = 64

# Pieces that can be encoded on their own. Both tokenizers cut texts by a pattern before they merge
# anything, and no match of it goes on from a character that is not white space over a blank or newline:
# such a place starts a new match, which sees nothing of what lies before. Texts are cut there and only
# there. Runs of white space, of which ``\s`` takes more than a tokenizer does, stay inside their pieces.
_RUN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=[!-~])(?=[ \n])")


def pieces(text: str) -> list[str]:
    if "\0" in text or _RUN.search(text):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file; strings of special tokens in a text are ordinary text."""
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


_LETTERS = _byte_letters()
#: A word of letters that no normalization touches but lower case, a newline before and marks behind it. Both
#: patterns cut between these, so each can be encoded on its own.
_SIMPLE = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_TRIED = (" the", "Straße", " Éclairs", "QU")


class _Pieces(dict):
    """Ids of pieces, encoded when they are first asked for."""

    def __init__(self, tokenizer: Tokenizer, dtype: np.dtype) -> None:
        self.tokenizer = tokenizer
        self.dtype = dtype
        self.before: dict[str, bytes] = {}
        self.model = tokenizer.model
        self.as_word = next((f for f in (_spaced, _bare) if self._agrees(f)), None)
        self.cut_lines = all(self._by_tokenizer("\n" + w) == self._by_tokenizer("\n") + self._by_tokenizer(w) for w in _TRIED)

    def _agrees(self, as_word: Callable[[str], str]) -> bool:
        """Whether words can go to the tokenizer's model directly, which saves most of the time of a call."""
        return all(self._by_model(as_word(w)) == self._by_tokenizer(w) for w in _TRIED)

    def _by_model(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def _by_tokenizer(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encoded(self, piece: str) -> bytes:
        simple = _SIMPLE.fullmatch(piece) if self.as_word else None
        if simple is None:
            return self._by_tokenizer(piece)
        line, word, marks = simple.groups()
        if line:
            return self[line] + self[piece[1:]] if self.cut_lines else self._by_tokenizer(piece)
        return self[word] + self[marks] if marks else self._by_model(self.as_word(piece))

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            word = piece[1:] if piece[:1] == " " else piece
            if word.isascii() and word.isalpha() and self.as_word:
                ids = self._by_model(self.as_word(piece))
            else:
                ids = self._encoded(piece)
        if len(piece) <= KEPT_CHARS:
            # Pieces that come back are kept over a fresh start; only those that do not are forgotten.
            if len(self) >= KEPT_PIECES // 2:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def _spaced(word: str) -> str:
    if word.isascii():  # letters, and a blank before them
        return word.replace(" ", _LETTERS[32])
    return word.encode().decode("latin-1").translate(_LETTERS)


def _bare(word: str) -> str:
    return _spaced(word.lstrip(" ").lower())


class Encoder:
    """Ids of texts, the same as ``encode(text, add_special_tokens=False)`` gives."""

    def __init__(self, path: str, dtype: type[np.unsignedinteger], cut: Callable[[str], list[str]] = pieces) -> None:
        self.cut = cut
        self.kept = _Pieces(tokenizer(path), np.dtype(dtype).newbyteorder("<"))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian integers, one after the other."""
        return [b"".join(map(self.kept.__getitem__, self.cut(t))) for t in texts]


@lru_cache(maxsize=1)
def encoder(path: str, dtype: type[np.unsignedinteger]) -> Encoder:
    """The encoder of this worker process, kept from task to task with the pieces that it knows."""
    return Encoder(path, dtype)


kept(encoder.cache_clear)
