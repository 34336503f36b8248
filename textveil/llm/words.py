"""Words of texts as 64-bit hashes, and shingles of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed together, about; words over LONG bytes are hashed one by one.
CHUNK, LONG = 1 << 18, 64
#: Bytes of texts that are worked on together, and texts at most.
BYTES, ROWS = 1 << 21, 2000
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them (MurmurHash3's finalizer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def small(batches: Iterator[pa.RecordBatch], text: int = -1) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a bounded number of rows and of bytes in the column of texts (one text may be longer), for
    work whose arrays are several times as large as the texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text if text >= 0 else batch.num_columns - 1)), 0)
        part = np.cumsum(np.r_[0, sizes.to_numpy(zero_copy_only=False)])[:-1] // BYTES
        begins = np.unique(np.r_[np.arange(0, batch.num_rows, ROWS), np.flatnonzero(np.diff(part)) + 1])
        for at, end in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows]):
            yield batch.slice(at, end - at)


def _powers_of(base: int, n: int, name: str) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        _powers[name] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])
    return _powers[name][:n]


def powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2^64."""
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and begins of the words of a byte string. A word is the value of a polynomial at an odd base, modulo 2^64;
    for words of up to LONG bytes no two are known to meet but by chance."""
    octets = np.frombuffer(raw, np.uint8)
    white = (octets == 32) | ((octets >= 9) & (octets <= 13))
    edge = np.flatnonzero(np.diff(white, prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    if len(octets) > 4 * CHUNK:  # a single word, longer than all that is hashed together
        out = np.zeros(len(begin), np.uint64)
    else:
        sums = np.r_[np.uint64(0), np.add.accumulate((octets + np.uint64(1)) * _powers_of(_BASE, len(octets), "up"))]
        out = (sums[end] - sums[begin]) * _powers_of(pow(_BASE, -1, 1 << 64), len(octets), "down")[begin]
        out = mixed(out + (end - begin).astype(np.uint64))
    if (long := np.flatnonzero(end - begin > LONG)).size:
        from xxhash import xxh3_64_intdigest

        out[long] = [xxh3_64_intdigest(raw[begin[k] : end[k]]) for k in long]
    return out, begin


_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A byte string, cut at white space into pieces of some CHUNK bytes; a longer one holds one long word at its end."""
    at = 0
    while len(raw) - at > 2 * CHUNK:
        cut = next((m.end() for m in [_WHITE.search(raw, at + CHUNK)] if m), len(raw))
        if cut - at > 2 * CHUNK:  # the word that lies over the place goes alone
            start = max((raw.rfind(w, at, at + CHUNK) + 1 for w in (b" ", *(bytes([c]) for c in range(9, 14)))), default=0)
            if start > at:
                yield raw[at:start]
                at = start
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def words_of(texts: list[str | bytes | None]) -> list[np.ndarray]:
    """Hashes of the words of each text: runs of bytes but the six ASCII white-space characters, A-Z as a-z (bytes.lower
    changes nothing else). Nothing depends on what is hashed together, and texts of any length take some 50 bytes for
    each byte of CHUNK besides 8 for each word."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal part, size
        if part:
            hashes, begin = _hashed(b"\n".join(part) + b"\n")
            ends = np.cumsum([len(p) + 1 for p in part])
            out.extend(np.split(hashes, np.searchsorted(begin, ends[:-1])))
            part, size = [], 0

    for text in texts:
        raw = (text if isinstance(text, bytes) else (text or "").encode()).lower()
        if len(raw) > CHUNK:
            flush()
            out.append(np.concatenate([_hashed(piece)[0] for piece in _pieces(raw)]))
            continue
        part.append(raw)
        size += len(raw) + 1
        if size >= CHUNK:
            flush()
    flush()
    return out


def word_hashes(text: str | bytes | None) -> np.ndarray:
    return words_of([text])[0]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; of fewer words, one of all of them; of none, none."""
    k = min(k, len(words))
    if not k:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j])
    return out


def sequence_key(values: np.ndarray) -> int:
    """A signed 64-bit key of a sequence of hashes."""
    from xxhash import xxh3_64_intdigest

    key = xxh3_64_intdigest(np.ascontiguousarray(values).tobytes(), len(values))
    return key - (1 << 64) if key >> 63 else key
