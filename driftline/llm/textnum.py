"""Texts of an Arrow batch as numpy arrays of bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes looked at in one go. A longer text is alone and takes arrays of about its own length, and of its number of words.
PIECE = 1 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another, and the n + 1 offsets at which they begin and end. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, most: int = PIECE):
    """Ranges (first, last) of whole texts with about ``most`` bytes each; a longer text is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = _LOWER.copy()
_LETTERS[:128][[not chr(c).isalnum() for c in range(128)]] = 32
_MARKS = _LOWER.copy()
_MARKS[:32] = 32


def lower(text: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return _LOWER[text]


def letters(text: np.ndarray) -> np.ndarray:
    """As ``lower``, and a blank for every ASCII byte that is neither letter nor digit."""
    return _LETTERS[text]


def marks(text: np.ndarray) -> np.ndarray:
    """As ``lower``, and a blank for every control character; punctuation stays."""
    return _MARKS[text]


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than blank and \\t \\n \\v \\f \\r, and each text's first word (n + 1 numbers)."""
    inside = np.ones(len(text) + 2, bool)
    inside[1:-1] = (text == 32) | ((text >= 9) & (text <= 13))
    np.logical_not(inside, out=inside)
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(text))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]])  # a word may not run on into the next text
    if len(cuts):
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


_FILL = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words of more bytes are put through BLAKE2b instead.
LONG = 64


def hash_words(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of words; different seeds give independent ones.

    The state begins with seed and length and takes eight bytes at a time, through a bijection of 64 bits that every
    bit goes into. So two words of up to eight bytes and the same length never collide, and longer ones by chance only.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    whole = np.zeros(len(text) + 8, np.uint8)
    whole[: len(text)] = text
    eight = np.ndarray((len(text) + 1,), "<u8", buffer=whole, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mix(np.array([seed], np.uint64) + _ODD))
    h = mix(h ^ (eight[starts] & _FILL[np.minimum(size, 8)]))
    more, at = np.flatnonzero(size > 8), 8
    while len(more) and at < LONG:
        left = size[more] - at
        h[more] = mix(h[more] ^ (eight[starts[more] + at] & _FILL[np.minimum(left, 8)]))
        more, at = more[left > 8], at + 8
    for i in more.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(text[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of neighbours as one."""
    return mix(a * _ODD + b)


def hash_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all k consecutive hashes (len - k + 1 numbers, none if there are fewer), joined by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    levels, width = {1: hashes}, 1
    while 2 * width <= k:
        below = levels[width]
        levels[2 * width] = _join(below[:-width], below[width:])
        width *= 2
    out, at = levels[width][:n], width
    while at < k:
        width //= 2
        if (k - at) & width:
            out, at = _join(out, levels[width][at : at + n]), at + width
    return mix(out ^ np.uint64(k))


def exact_ids(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of words that are equal if, and only if, the words' bytes are."""
    seen: dict[bytes, int] = {}
    raw = text.tobytes()
    return np.fromiter((seen.setdefault(raw[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))


def exact_grams(ids: np.ndarray, k: int) -> np.ndarray:
    """As ``hash_grams`` of exact numbers, without any collision: equal if, and only if, all k numbers are."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    both = lambda a, b: np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]  # noqa: E731  both are ranks, so this fits 64 bits
    out, at = ids, 1
    while at < k:
        more = min(at, k - at)
        out = both(out[: len(ids) - at - more + 1], out[at : len(ids) - more + 1]) if more == at else both(out[:n], exact_grams(ids, more)[at : at + n])
        at += more
    return out
