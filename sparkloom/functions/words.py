"""Word and shingle hashes of many texts at once, on NumPy arrays.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Texts are laid end to end with a line feed between, so one pass
over the bytes serves a whole chunk of documents, however short each one is. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = int(_RNG.integers(1, 2**62)) * 2 + 1
_ODD_INV = pow(_ODD, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}
#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= CHUNK_BYTES * 2:
            _powers[kind] = have
    return have[:n]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts in order, and where each text's words begin (one more entry at the end)."""
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    a = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(lens + 1)])
    space = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[a] * _power("up", _ODD, len(a)), out=total[1:])
    h = mix((total[end] - total[start]) * _power("down", _ODD_INV, len(a))[start])
    return h, np.searchsorted(start, at)


def lowered(texts: list[str]) -> list[bytes]:
    """UTF-8 with A-Z, and nothing else, in lower case."""
    return [t.encode("utf-8", "surrogatepass").lower() for t in texts]


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and where each text's runs begin.

    A text of fewer words has its whole sequence as one run; a text without words has none.
    """
    n = len(words)
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(at[-1], dtype=np.uint64)
    if n >= size:
        h = np.zeros(n - size + 1, dtype=np.uint64)
        for j in range(size):
            h += words[j : n - size + 1 + j] * _PLACE[j]
        text = np.repeat(np.arange(len(counts)), counts)
        inside = text[: n - size + 1] == text[size - 1 :]
        full = np.repeat(counts >= size, runs)
        out[full] = h[inside]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        w = words[first[i] : first[i + 1]]
        out[at[i]] = np.concatenate([w * _PLACE[: len(w)], _PLACE[8 + len(w) % 8 :][:1]]).sum(dtype=np.uint64)
    return mix(out), at
