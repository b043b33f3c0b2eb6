"""A public byte-level BPE vocabulary as a sentencepiece model.

The model file is written directly, without training: one piece for each token, its bytes
mapped to printable characters, scored by its negative rank, with identity normalisation.
Merging the best-scored neighbours first is then merging the lowest rank first, so encoding
a pre-token gives the vocabulary's own ids.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import regex

# The splitting rule that belongs to the vocabulary, with white space spelt out as the
# Unicode property White_Space, and the bytes that stand for themselves in the byte mapping.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Pre-tokens remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Longer pre-tokens are encoded each time they occur.
LONG = 48
#: Pre-tokens of one text that are held at once.
STRETCH = 200_000


def byte_chars() -> list[str]:
    """The character of each byte: itself if printable, else the next free one from 256 on."""
    free = itertools.count(256)
    stay = set(PRINTABLE)
    return [chr(b) if b in stay else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from lines of base64 token and rank."""
    ranked = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranked[int(rank)] = base64.b64decode(token)
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """The sentencepiece model: token i has id i; the unknown piece, never produced, comes last."""
    chars = byte_chars()
    normal, unknown, bpe = 1, 2, 2
    pieces = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        pieces += _block(1, _block(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, normal))
    pieces += _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0) + _number(3, unknown))
    trainer = _number(3, bpe) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _block(1, b"identity") + _block(2, b"") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return bytes(pieces) + _block(2, trainer) + _block(3, normalizer)


class Encoder(dict):
    """Ids of texts. As a dict it remembers the ids of pre-tokens met before."""

    def __init__(self, model: bytes):
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._chars = dict(enumerate(byte_chars()))
        self._split = regex.compile(SPLIT)

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = tuple(self._sp.encode(token.encode("utf-8", "replace").decode("latin-1").translate(self._chars)))
        if len(token) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = ids
        return ids

    def parts(self, text: str | None) -> Iterator[list[tuple[int, ...]]]:
        """Ids by pre-token, in stretches, so that a very long text is never held as tokens."""
        if not text:
            return
        get = self.__getitem__
        if len(text) <= STRETCH:
            yield list(map(get, self._split.findall(text)))
            return
        found = (m.group() for m in self._split.finditer(text))
        while some := list(itertools.islice(found, STRETCH)):
            yield list(map(get, some))

    def encode(self, text: str | None) -> np.ndarray:
        got = [np.fromiter(itertools.chain.from_iterable(p), np.int32) for p in self.parts(text)]
        return got[0] if len(got) == 1 else np.concatenate(got) if got else np.empty(0, np.int32)

    def count(self, text: str | None) -> int:
        return sum(sum(map(len, p)) for p in self.parts(text))


class Decoder:
    """The inverse mapping: ids to pieces, pieces to bytes, bytes to text."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: b for b, c in enumerate(byte_chars())}
        self._bytes = [bytes(back[c] for c in sp.id_to_piece(i)) for i in range(sp.get_piece_size() - 1)]

    def decode(self, ids) -> str:
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(model: bytes) -> Encoder:
    """One encoder for each model in a worker's process, kept from task to task."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]
