"""Words of Arrow text columns as numpy arrays: no Python object is made per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Texts are handled in runs of about so many bytes, which bounds the memory of a task; one longer text is a run of its own.
RUN_BYTES = 1 << 20
#: Bytes hashed at once: each Python process holds as many powers, and what is computed of them stays within a core's cache.
_SEGMENT = 1 << 16
_BASE = _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values (splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE) | _U(1)
_POWER = np.cumprod(np.full(_SEGMENT + 1, _BASE | _U(1), dtype=_U), dtype=_U)
#: The power that hashes are scaled by, whatever the place of their words.
_SCALE = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; a null text is empty."""
    flat = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    if not len(flat) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(flat) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[data]


@dataclass
class Words:
    """Words of consecutive texts: byte range and 64-bit hash of each; first[i]:first[i + 1] are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def texts(self, a: int, b: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True)]


def words(texts: pa.Array, lower: bool = False, separator: np.ndarray = _SPACE, hashed: bool = True) -> Words:
    """Runs of bytes that aren't separators. lower: A-Z as a-z, no other letter changed."""
    data, at = raw(texts)
    if lower:
        data = _LOWER[data]
    inside = ~separator[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[:-1][at[:-1] < len(data)]
    begins[edge] = inside[edge]
    last = at[1:][at[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    return Words(data, start, end, first, hashes(data, start, end) if hashed else np.zeros(0, _U))


#: All ASCII but letters and digits separates tokens.
_NO_TOKEN = np.ones(256, dtype=bool)
_NO_TOKEN[48:58] = _NO_TOKEN[65:91] = _NO_TOKEN[97:123] = _NO_TOKEN[128:] = False


def tokens(texts: pa.Array) -> Words:
    """Runs of ASCII letters, digits and characters beyond ASCII, all in lower case."""
    return words(pc.utf8_lower(texts.cast(pa.large_string())), separator=_NO_TOKEN)


@cache
def powers() -> np.ndarray:
    """The powers of the base of hashes from the first on, 16 MB of them; only processes that ask for them hold them."""
    return np.cumprod(np.full(_SCALE + 1, _BASE | _U(1), dtype=_U), dtype=_U)


def _power(k: int) -> np.uint64:
    """The base of hashes to the power of k."""
    return _U(pow(int(_BASE) | 1, int(k), 1 << 64))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; the ranges are in order and don't overlap."""
    out = np.empty(len(start), dtype=_U)
    scale = _power(_SCALE - _SEGMENT)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + _SEGMENT, side="right")))
        if end[i] - lo > _SEGMENT:  # one huge word: the same sum piece by piece
            h = _U(0)
            for k in range(lo, end[i], _SEGMENT):
                part = data[k : min(k + _SEGMENT, end[i])]
                h = h + (_BYTE[part] * _POWER[: len(part)]).sum(dtype=_U, keepdims=True) * _power(k - lo)
            out[i] = (h * _power(_SCALE + 1) + _U(end[i] - lo))[0]
        else:
            part = data[lo : end[j - 1]]
            total = np.zeros(len(part) + 1, dtype=_U)
            np.cumsum(_BYTE[part] * _POWER[: len(part)], out=total[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (total[e] - total[s]) * (_POWER[_SEGMENT - s] * scale) + (e - s).astype(_U)
        i = j
    return mix(out)


def window_sums(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range of up to a few hundred bytes; the ranges may overlap."""
    out = np.zeros(len(start), dtype=_U)
    for k in range(int(length.max(initial=0))):
        inside = k < length
        out[inside] += _BYTE[data[start[inside] + k]] * _POWER[k]
    return mix(out)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of each n consecutive words of one text, in order."""
    if len(w.hash) < n:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    row = w.row
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    return at, gram_hash(w.hash, at, n)


def gram_hash(word_hash: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(at), n, dtype=_U)
    for k in range(n):
        h = h * _BASE + word_hash[at + k]
    return mix(h)


def runs(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about RUN_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + RUN_BYTES, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(_U).view(np.int64)
