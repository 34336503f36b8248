"""Token ids of whole texts, exactly as the `tokenizers` library gives them, several times faster.

A byte-level BPE splits a text into pre-tokens and encodes each alone. A single space between two characters that are
not white space always starts a pre-token, so a text falls apart there into units (a space and what follows it), each a
whole number of pre-tokens, and the ids of a text are those of its units. Worker processes keep the ids of the units
they have met, so the text mostly costs a split at spaces and a look-up per unit.

Where a rank file is given, texts of plain Latin letters and ASCII signs go as a whole to the faster encoder of the same
merges (equal on this alphabet: tests/llm/test_tokens.py compares all of it), for ids; in other texts, and for counts,
units of this alphabet that are not yet known do. All other units, and texts that hold a special token's string, go to
the library itself."""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: A single space between characters that are not white space.
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Where both encoders agree: ASCII without controls but for line feeds, Latin-1 letters, Latin Extended A and B.
PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ɏ]+")
#: Longer units are not kept, and are encoded by the library.
LONGEST_UNIT = 128
#: Texts are given to the faster encoder in pieces of about so many characters, which bounds its lists of ids.
PIECE = 1 << 16
#: Units that a worker keeps at most: some 60 MB.
MOST_UNITS = 250_000


class _Irregular(Exception):
    """A unit that begins or ends with white space, or is empty: its end isn't a border between pre-tokens."""


class _Units(dict):
    """Unit without its space: what `value` makes of it; starts again from `base` when full."""

    def __init__(self, value: Callable, base: dict | None, most: int):
        super().__init__(base or {})
        self.value, self.base, self.most = value, base or {}, most

    def __missing__(self, unit: str):
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise _Irregular
        made = self.value(" " + unit)
        if len(unit) <= LONGEST_UNIT:
            if len(self) >= self.most:
                self.clear()
                self.update(self.base)
            self[unit] = made
        return made


class TextEncoder:
    """Ids or token counts of texts. vocabulary: a .json of the tokenizers library; ranks: the same merges as ranks."""

    def __init__(self, vocabulary: str, ranks: str | None = None, most_units: int = MOST_UNITS, lengths: dict[str, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")  # struct knows both by .char
        self.ranks = ranks and self._fast(ranks)
        self.ids_of = _Units(self._unit_ids, None, most_units)
        self.lengths = _Units(lambda unit: len(self._encode(unit)), lengths, most_units)

    def _fast(self, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def _encode(self, unit: str) -> list[int]:
        if self.ranks and len(unit) <= LONGEST_UNIT and PLAIN.fullmatch(unit):
            if unit[1:].isalpha() and unit[0] == " ":
                return self.ranks._core_bpe.encode_single_piece(unit.encode())
            return self.ranks.encode_ordinary(unit)
        return self.library.encode(unit, add_special_tokens=False).ids

    def _unit_ids(self, unit: str) -> bytes:
        return struct.pack(f"<{len(ids := self._encode(unit))}{self.dtype.char}", *ids)

    def _plain(self, text: str) -> bool:
        """Whether a text goes to the faster encoder as a whole: no words, and no white space, that are long."""
        if not self.ranks or not PLAIN.fullmatch(text):
            return False
        white = np.flatnonzero(np.frombuffer(f" {text} ".encode(), np.uint8) <= 32)
        return int(np.diff(white).max()) <= LONGEST_UNIT and not (white[LONGEST_UNIT:] - white[:-LONGEST_UNIT] == LONGEST_UNIT).any()

    def _plain_ids(self, text: str) -> np.ndarray:
        encode, at, found = self.ranks._core_bpe.encode_ordinary, 0, []
        while len(text) - at > PIECE and (cut := SINGLE_SPACE.search(text, at + PIECE)):
            found.append(np.array(encode(text[at : cut.start()]), self.dtype))
            at = cut.start()
        found.append(np.array(encode(text[at:] if at else text), self.dtype))
        return found[0] if len(found) == 1 else np.concatenate(found)

    def _special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def _units(self, text: str, known: _Units, alone: Callable) -> list:
        """What is known of each unit of a text; alone: what is made of a unit that is not looked up."""
        units = text.split(" ")
        try:
            if not units[0] or units[0][-1].isspace():
                raise _Irregular
            return [alone(units[0]), *map(known.__getitem__, units[1:])]
        except _Irregular:  # several spaces in a row, or a space beside another white space
            first, *rest = SINGLE_SPACE.split(text)
            if not rest:
                return [alone(first)]
            return [alone(first), *map(known.__getitem__, rest[:-1]), alone(" " + rest[-1])]

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.dtype)
        if self._special(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)
        if self._plain(text):
            return self._plain_ids(text)
        return np.frombuffer(b"".join(self._units(text, self.ids_of, self._unit_ids)), self.dtype)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self._special(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(self._units(text, self.lengths, lambda unit: len(self._encode(unit))))


@lru_cache(2)
def encoder(vocabulary: str, ranks: str | None = None) -> TextEncoder:
    """One encoder in each worker process, kept from task to task."""
    return TextEncoder(vocabulary, ranks)
