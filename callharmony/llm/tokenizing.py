"""Token ids of whole texts, as packed bytes, with a bounded memory of words seen before.

Two things about a tokenizer are found out when it is loaded, by comparing it with the rule on probes. If it drops
white space and never joins across it, a text's ids are those of its chunks between white space, one after another.
If besides it lower-cases and parts letters, digits and marks as ``_units`` does, they are those of these units. Units
repeat far more than chunks, so each worker keeps the ids of those it has met. Texts with letters for which the probes
do not prove the rule are taken chunk by chunk where they have them, and those of other tokenizers whole.
"""

from __future__ import annotations

import re
import struct
import unicodedata

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

# Default vocabulary file; a parameter of every operator that needs one.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
# Units and chunks remembered, of which a worker holds twice as many at most, and the longest one remembered.
REMEMBERED, LONGEST = 300_000, 48

ID = np.dtype("<u4")
_PROBES = ("Two words,  and\nmore", "It's he'll ISN'T 'd''s 'x", "a1b22 3.5,c-d_e", "\x01a\x1cb\x7f\v(c)\f[d]\t{~}", "!?.", "", "l'été '")
# Letters that may be found to follow the rule: of the scripts that are written with blanks and case.
_LETTERS = [chr(i) for i in (*range(0xAA, 0x250), *range(0x370, 0x530)) if chr(i).isalpha()]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (i for i in range(256) if i not in shown)
    return {i: chr(i) for i in shown} | {i: chr(256 + n) for n, i in enumerate(hidden)}


_AS_LETTERS = str.maketrans({chr(byte): letter for byte, letter in _byte_letters().items()})


class _Known(dict):
    """Ids of the units, or chunks, met so far; ``older`` are those of the generation before."""

    def __init__(self, make, older: dict):
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            ids = self.make(unit)
        if len(unit) <= LONGEST:
            self[unit] = ids
        return ids


class Encoder:
    """A vocabulary file's ids for texts, as packed little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.units = _Known(self._model, {})
        self.chunks = _Known(self._library, {})
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_chunk = all(b"".join(map(self._library, probe.split())) == self._library(probe) for probe in _PROBES[:3])
        self.by_unit, self.letters = self.by_chunk, ""
        self._compile()
        self.by_unit = self.by_chunk and all(self._in_units(probe) == self._library(probe) for probe in _PROBES[:-1])
        if self.by_unit:
            self.letters = "".join(filter(self._follows, _LETTERS))
            self._compile()
            self.by_unit = self._in_units(_PROBES[-1]) == self._library(_PROBES[-1])

    def _compile(self) -> None:
        proven = "".join(dict.fromkeys(self.letters + self.letters.lower()))
        self._odd = re.compile(f"[^\\x00-\\x7f{proven}]")
        self._units = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{proven}]+|[0-9]|[^ \\t-\\ra-z0-9{proven}]+").findall

    def _follows(self, letter: str) -> bool:
        """Whether a letter is lower-cased, kept in its word and spelled in bytes, wherever it stands."""
        if unicodedata.normalize("NFC", letter) != letter or len(letter.lower()) != 1:
            return False
        words = (f"a{letter}b", f"{letter}{letter}", f"x{letter}", f"{letter}Y")
        return b"".join(self._model(word.lower()) for word in words) == self._library(" ".join(words))

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def _model(self, unit: str) -> bytes:
        spelled = unit.encode("utf-8").decode("latin-1").translate(_AS_LETTERS)
        return struct.pack(f"<{len(tokens := self.model.tokenize(spelled))}I", *[token.id for token in tokens])

    def _in_units(self, text: str) -> bytes:
        return b"".join(map(self.units.__getitem__, self._units(text.lower())))

    def ids(self, text: str | None) -> bytes:
        """A whole text's ids; none for a null."""
        if not text:
            return b""
        if not self.by_chunk:
            return self._library(text)
        for name in ("units", "chunks"):
            known = getattr(self, name)
            if len(known) >= REMEMBERED:
                known.older = {}  # the generation before that is dropped
                setattr(self, name, _Known(known.make, known))
        if self.by_unit and (text.isascii() or not self._odd.search(text)) and not any(token in text for token in self.added):
            return self._in_units(text)
        return b"".join(map(self._of_chunk, re.split(r"[ \t-\r]+", text)))

    def _of_chunk(self, chunk: str) -> bytes:
        if self.by_unit and (chunk.isascii() or not self._odd.search(chunk)) and not any(token in chunk for token in self.added):
            return self._in_units(chunk)
        return self.chunks[chunk] if chunk else b""


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
