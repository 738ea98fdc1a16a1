"""Words and word n-grams of whole columns of texts, as 64-bit hashes, vectorised over UTF-8 bytes.

A word's hash is a polynomial over its bytes, a gram's one over its words' hashes; both come from prefix sums, so a
gram of any length costs the same. Arithmetic is modulo 2**64 and a bijective mixer ends each hash. Polynomials modulo a
power of two have known collisions between long inputs, so words of more than ``PLAIN`` bytes are hashed by BLAKE2b;
grams here have far fewer words than such a collision needs. A second hash of each word has other byte values and
another base, so grams of both seeds are independent from the bytes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 1 << 18
#: Bytes up to which a word is hashed by a polynomial.
PLAIN = 64
_BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95), U(0xC2B2AE3D27D4EB4F))
_SEEDS = (U(0x9E3779B97F4A7C15), U(0x8EBC6AF09C88C6E3))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        have = np.ones(size + 1, U)
        have[1:] = U(base)
        np.cumprod(have, out=have)
        if size <= 1 << 19:  # longer ones are made again for the few long texts, so that workers stay small
            _powers[base] = have
    return have[: n + 1]


@lru_cache
def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    z = z ^ (z >> U(30))
    z *= U(0xBF58476D1CE4E5B9)
    z ^= z >> U(27)
    z *= U(0x94D049BB133111EB)
    z ^= z >> U(31)
    return z


@lru_cache
def table(kind: str, lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to a word, and its 64-bit value under a seed. kind "space": words are runs without
    U+0020 and U+0009..U+000D; "alnum": runs of ASCII letters, ASCII digits and characters outside ASCII; "letters": the
    same without digits."""
    codes = np.arange(256)
    if kind == "space":
        inside = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    elif kind in ("alnum", "letters"):
        inside = ((codes >= 97) & (codes <= 122)) | (codes >= 128)
        inside |= (codes >= 48) & (codes <= 57) if kind == "alnum" else np.False_
        inside |= (codes >= 65) & (codes <= 90) if lower else np.False_
    else:
        raise ValueError(f"no such kind of word: {kind}")
    if lower:
        codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return inside, mix((codes.astype(U) + U(1)) * _SEEDS[seed])


@dataclass
class Words:
    """Words of some texts in order: byte bounds, hashes, and ``first``: for text i its words are first[i]:first[i+1].
    ``second`` (where asked for) has other hashes of the same words, independent of the first ones."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    second: np.ndarray | None = None

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value_of: np.ndarray, seed: int) -> np.ndarray:
    n, base = len(data), int(_BASES[seed + 1])
    sums = np.zeros(n + 1, U)
    np.cumsum(value_of[data] * powers(base, n)[:n], out=sums[1:])
    hashes = (sums[end] - sums[start]) * powers(inverse(base), n)[start]
    return mix(hashes + (end - start).astype(U) * _BASES[0])


def words(data: np.ndarray, offsets: np.ndarray, kind: str = "space", lower: bool = True, both: bool = False) -> Words:
    """Words of the texts that ``offsets`` cut ``data`` into; with ``both`` also their second hashes."""
    inside_of, value_of = table(kind, lower)
    n = len(data)
    inside = inside_of[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = False
    after[cuts - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    out = Words(start, end, _hashes(data, start, end, value_of, 0), np.searchsorted(start, offsets))
    if both:
        out.second = _hashes(data, start, end, table(kind, lower, 1)[1], 1)
    for k in np.flatnonzero(end - start > PLAIN).tolist():
        raw = data[start[k] : end[k]].tobytes()
        digest = blake2b(raw.lower() if lower else raw, digest_size=16).digest()  # bytes.lower is ASCII only
        out.hash[k] = int.from_bytes(digest[:8], "little")
        if both:
            out.second[k] = int.from_bytes(digest[8:], "little")
    return out


class Grams:
    """Hashes of runs of words; seed 1 takes the words' second hashes, so both seeds together count as 128 bits."""

    def __init__(self, w: Words, seed: int = 0):
        hashes = w.second if seed else w.hash
        n, base = len(hashes), int(_BASES[seed + 1])
        self.sums = np.zeros(n + 1, U)
        np.cumsum(hashes * powers(base, n)[:n], out=self.sums[1:])
        self.back = powers(inverse(base), n)

    def at(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the runs of ``length`` words (one number, or one a run) that begin at ``start``."""
        value = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return mix(value + np.asarray(length, U) * _BASES[0])


def starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of n words fits in its text: positions, and the number in each text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    total = int(counts.sum())
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    return at, counts


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def parts(column, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, bytes, offsets) for the slices of a string column."""
    data, offs = utf8(column)
    for i, j in slices(offs, most):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
