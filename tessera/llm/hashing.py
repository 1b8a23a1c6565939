"""Vectorised 64-bit hashes of byte windows, words and word shingles (NumPy inside Spark tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
CHUNK = 1 << 20
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_ROW_BYTE = np.random.default_rng(20240608).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LIMIT = CHUNK + 1024
#: Bytes of a word from which on it has a hash of its own kind: sums modulo 2^64 are equal for some long words that differ.
LONG_WORD = 64
_POW = np.cumprod(np.concatenate([[U(1)], np.full(_LIMIT, U(_BASE))]), dtype=np.uint64)
_INV = np.cumprod(np.concatenate([[U(1)], np.full(_LIMIT, U(_INVERSE))]), dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(b: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences identify byte windows; ``b`` holds at most CHUNK + 1024 bytes."""
    out = np.empty(len(b) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[b] * _POW[: len(b)], out=out[1:])
    return out


def windows(p: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the byte windows [start, stop), equal for equal bytes wherever they stand."""
    return mix((p[stop] - p[start]) * _INV[start])


def name_words(data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the words [start, stop) of at most CHUNK + 1024 bytes: by sums where they are short, else one by one."""
    h = windows(prefix(np.frombuffer(data, np.uint8)), start, stop)
    for i in np.flatnonzero(stop - start > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : stop[i]])
    return h


def row_hashes(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of each row of a byte matrix; the salts 0 and 1 give two that have nothing in common."""
    h = np.zeros(len(x), np.uint64)
    for j in range(x.shape[1]):
        h += _ROW_BYTE[salt][x[:, j]] * _POW[j]
    return mix(h)


def all_windows(p: np.ndarray, k: int) -> np.ndarray:
    n = len(p) - k
    return mix((p[k:] - p[:n]) * _INV[:n])


def _chunks(data: bytes):
    """Cuts at white space into pieces of at most CHUNK bytes; a longer word comes alone."""
    at, n = 0, len(data)
    while n - at > CHUNK:
        piece = np.frombuffer(data, np.uint8, CHUNK, at)
        gaps = np.flatnonzero(_SPACE[piece])
        if len(gaps):
            stop = at + int(gaps[-1]) + 1
        else:
            later = next((i for i in range(at + CHUNK, n) if _SPACE[data[i]]), n)
            stop = later
        yield data[at:stop]
        at = stop
    yield data[at:]


def word_hashes(data: bytes) -> np.ndarray:
    """One hash per word (maximal run without ``[\\x20\\x09-\\x0D]``) of the lower-cased (A-Z) bytes."""
    out = []
    for piece in _chunks(data.lower()):
        if len(piece) > CHUNK:
            out += [np.array([xxhash.xxh3_64_intdigest(w)], np.uint64) for w in piece.split()]
            continue
        b = np.frombuffer(piece, np.uint8)
        if not len(b):
            continue
        gap = np.concatenate([[True], _SPACE[b], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        if len(edge):
            out.append(name_words(piece, edge[0::2], edge[1::2]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive hashes."""
    n, out = len(h) - width + 1, []
    for at in range(0, max(n, 0), CHUNK):
        part = h[at : min(len(h), at + CHUNK + width - 1)]
        p = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POW[: len(part)], out=p[1:])
        out.append(mix((p[width:] - p[: len(p) - width]) * _INV[: len(p) - width]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all k-word windows in order; with fewer words the whole sequence as one; none without words."""
    n = len(words)
    if not n:
        return words
    return rolling(words, k) if n >= k else rolling(words, n) + U(n)
