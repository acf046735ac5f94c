"""Token ids by the tokenizers library, with a cache of white-space pieces in each worker.

A text is cut before single spaces and around single line feeds between other characters, where both kinds of
pre-tokenizer cut too, so the pieces' ids joined are the text's ids.  Texts with any other white space go to the
library whole.
"""

from __future__ import annotations

import string
import sys
from array import array

import numpy as np

#: White space other than spaces and line feeds.
_OTHER = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)]
_OTHER_ASCII = [s for s in _OTHER if s.isascii()]
#: Pieces in a worker's cache, at most.
CACHE = 400_000
#: Marks that end a piece are one pre-token of their own after letters.
_TAIL = string.punctuation


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file of a name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable bytes as themselves, the others from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes texts with one tokenizer file; ids come as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.tokenize, self.normalizer = self.library.model.tokenize, self.library.normalizer
        self.letters = str.maketrans({chr(b): s for b, s in _byte_letters().items()})
        self.lowers = self.normalizer is not None and self.normalizer.normalize_str("AZ") == "az"
        self.spelt = {"": "", " ": " ".translate(self.letters)}
        self.keeps_space = self.library.normalizer is None
        self.first = _Pieces(self, "", cache)
        self.spaced = _Pieces(self, " ", cache) if self.keeps_space else self.first
        self.line = self.bytes_of(self.library.encode("\n", add_special_tokens=False).ids)

    def bytes_of(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype=self.dtype).tobytes()

    def word(self, word: str, lead: str) -> bytes:
        """The ids of letters only, one pre-token.  Normalisation leaves Latin-1 letters but for their case."""
        if word.isascii():
            spelt = self.spelt[lead] + (word.lower() if self.lowers else word)
            return self.bytes_of([t.id for t in self.tokenize(spelt)])
        if _latin(word):
            if self.lowers:
                word = word.lower()
        elif self.normalizer is not None:
            word = self.normalizer.normalize_str(word)
            if not word.isalpha():
                return self.piece(word, lead)
        spelt = word.encode().decode("latin-1").translate(self.letters)
        return self.bytes_of([t.id for t in self.tokenize(self.spelt[lead] + spelt)])

    def piece(self, piece: str, lead: str) -> bytes:
        """The ids of a piece without white space, after ``lead``."""
        return self.bytes_of(self.library.encode(lead + piece, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in (_OTHER_ASCII if text.isascii() else _OTHER)):
            return self.whole(text)
        try:
            return self.pieces(text.lower() if self.lowers and _latin(text) else text)
        except _UnevenError:
            return self.whole(text)

    def whole(self, text: str) -> bytes:
        return self.bytes_of(self.library.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str) -> bytes:
        """The ids of a text's pieces; spaces and line feeds that do not stand single leave an empty one, an error."""
        out: list[bytes] = []
        first, spaced, line = self.first, self.spaced.__getitem__, self.line
        for part in text.split("\n"):
            head, *rest = part.split(" ")
            out.append(first[head])
            out.extend(map(spaced, rest))
            out.append(line)
        out.pop()
        return b"".join(out)


def _latin(text: str) -> bool:
    """Whether all characters are of Latin-1, each its own normal form, whose lower case is one of them too."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _UnevenError(Exception):
    """A text begins or ends with white space, or has two in a row."""


class _Pieces(dict):
    """Piece -> ids, in two generations of half the limit each, so that a piece in use is not forgotten with the others.

    Letters before a closing mark are looked up without it.
    """

    def __init__(self, encoder: Encoder, lead: str, limit: int) -> None:
        super().__init__()
        self.encoder, self.lead, self.limit = encoder, lead, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if not piece:
            raise _UnevenError
        if 2 * len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = self.anew(piece)
        self[piece] = ids
        return ids

    def anew(self, piece: str) -> bytes:
        if piece.isalpha():
            return self.encoder.word(piece, self.lead)
        core = piece.rstrip(_TAIL)
        if not core.isalpha() or self.encoder.normalizer is not None and not _latin(core):
            return self.encoder.piece(piece, self.lead)  # normalised, letters may join the marks
        return self[core] + self.encoder.first[piece[len(core) :]]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """The worker's encoder for a file and a size of its cache."""
    if (path, cache) not in _encoders:
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]
