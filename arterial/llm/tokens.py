"""Encoding of whole texts with the tokenizers library, by way of a cache of chunks that no token crosses.

Both vocabularies split a text at fixed places before they merge anything, so encoding the pieces between such places
one by one gives the ids of the whole text. Most words recur; each worker encodes each only once. Texts that hold a
special token's string go to the library whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from arterial.llm.common import quiet_worker

#: Entries a worker keeps, the bound on its memory; beyond them new chunks are held for a batch only.
CACHE_ENTRIES = 400_000
# Words that both vocabularies take as one piece and that normalisation at most lowers: they go straight to the model.
_SIMPLE = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
# A word with the space before it, ended by white space or one mark; that mark; any other run; white space.
_BYTE_CHUNK = re.compile(r" ?[^\W\d_]+(?=[.,]?(?:\s|$))|[.,](?=\s|\Z)| ?\S+|\s+(?!\S)|\s+")
# Such a word, with or without ASCII marks after it, of which none is an apostrophe.
_MARKED = re.compile("(" + _SIMPLE.pattern + ")([!-&(-/:-@\\[-^`{-~]+)?")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
# The same without white space, which that vocabulary drops.
_WORD_CHUNK = re.compile(r"[^\W\d_]+(?=[.,]?(?:\s|$))|[.,](?=\s|\Z)|\S+")
# Python takes these for white space; the library doesn't.
_ODD = "\x1c\x1d\x1e\x1f"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


_KEPT: dict = {}


def encoder(kind: type, path: str):
    """The worker's encoder of this vocabulary; its cache lives as long as the worker, across tasks."""
    quiet_worker()
    key = (kind, path)
    if key not in _KEPT:
        _KEPT[key] = kind(path)
    return _KEPT[key]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Table(dict):
    """What the encoder cuts chunks to, with `before` in front of each. One that isn't there is cut when it is looked up, so
    there is one lookup a chunk; once the encoder is full, it is held for a batch only."""

    def __init__(self, encoder: ChunkEncoder, before: str = ""):
        self.encoder, self.before = encoder, before

    def __missing__(self, chunk: str):
        found = self.encoder._cut(self.before + chunk)
        if self.encoder.full():
            self.encoder.passing.append((self, chunk))
        self[chunk] = found
        return found


class ChunkEncoder:
    """ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        quiet_worker()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.words = self.tokenizer.normalizer is not None
        self.chunks = _WORD_CHUNK if self.words else _BYTE_CHUNK
        self.letters = {b: chr(c) for b, c in _byte_letters().items()}
        self.cache = _Table(self)
        self.spaced = _Table(self, " ")
        self.passing: list = []

    def whole(self, text: str) -> bool:
        """Texts that only the library itself takes apart."""
        return any(s in text for s in self.special) or any(c in text for c in _ODD)

    def _cut(self, chunk: str) -> bytes:
        """ids of a chunk; letters and the marks after them are encoded apart, as both vocabularies split them."""
        if chunk.isascii() and (word := chunk.rstrip(_MARKS)).isalpha():  # most are; the pattern tells the same, but slower
            marks = chunk[len(word) :]
        elif both := _MARKED.fullmatch(chunk):
            word, marks = both.groups()
        else:
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if marks:
            return self._known(word) + self._known(marks)
        if self.words:
            word = word.lower()
        if not word.isalpha() or not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(word)]).tobytes()

    def full(self) -> bool:
        return len(self.cache) + len(self.spaced) >= CACHE_ENTRIES

    def _known(self, chunk: str) -> bytes:
        found = self.cache.get(chunk)
        if found is None:
            found = self._cut(chunk)
            if not self.full():
                self.cache[chunk] = found
        return found

    def _forget(self) -> None:
        for table, chunk in self.passing:
            table.pop(chunk, None)
        self.passing = []

    def encode(self, texts: list[str]) -> list[bytes]:
        self._forget()
        return [self._encode(t) for t in texts]

    def _encode(self, text: str) -> bytes:
        if self.whole(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.words:
            # that vocabulary lowers everything; of Latin-1 letters Python does so in the same way
            return self._join(self.cache, (text.lower() if _latin(text) else text).split())
        if " ".join(text.split()) != text.replace("\n", " "):
            return self._join(self.cache, self.chunks.findall(text))
        # single spaces and line feeds only: every word but a line's first takes the space before it
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self._known(first) + self._join(self.spaced, rest))
        return self._known("\n").join(out)

    def _join(self, table: _Table, chunks) -> bytes:
        return b"".join(map(table.__getitem__, chunks))


class OffsetEncoder(ChunkEncoder):
    """Character spans of all tokens of whole texts: (starts, ends) as int64 arrays."""

    def _cut(self, chunk: str):
        offsets = self.tokenizer.encode(chunk, add_special_tokens=False).offsets
        return len(offsets), len(chunk), array("i", [x for span in offsets for x in span]).tobytes()

    def spans(self, texts: list[str]):
        self._forget()
        for text in texts:
            yield self._spans(text)

    def _spans(self, text: str):
        if self.whole(text) or self.words:
            pairs = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            return pairs[:, 0], pairs[:, 1]
        chunks = self.chunks.findall(text)
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts, sizes, flat = zip(*map(self.cache.__getitem__, chunks), strict=True)
        counts, sizes = np.array(counts), np.array(sizes)
        pairs = np.frombuffer(b"".join(flat), np.int32).reshape(-1, 2)
        base = np.repeat(np.cumsum(sizes) - sizes, counts)
        return pairs[:, 0] + base, pairs[:, 1] + base
