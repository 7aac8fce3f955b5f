"""Hashes of five-word shingles of whole texts, vectorised over the bytes of an Arrow batch.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A word's 64-bit hash is a
polynomial over its bytes and its length, finalised; a shingle's hash combines its five words'
hashes in order. With fewer than five words the whole sequence is one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
#: Bytes that are hashed at a time.
GROUP_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _power
    if n > len(_power):
        more = np.full(max(n, 2 * len(_power)), _BASE, np.uint64)
        more[0] = 1
        _power = np.cumprod(more)
    return _power


def _words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``data``, and where they start; a word ends where a text of ``firsts`` begins."""
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    firsts = firsts[firsts < len(data)]
    start[firsts] = solid[firsts]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), at
    chars = _LOWER[data[solid]].astype(np.uint64) + np.uint64(1)
    head = (np.cumsum(solid) - 1)[at]
    lens = np.diff(np.append(head, len(chars)))
    inside = np.arange(len(chars)) - np.repeat(head, lens)
    return mixed(np.add.reduceat(chars * _powers(int(lens.max()))[inside], head) + lens.astype(np.uint64) * _BASE), at


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, in pieces cut at white space."""
    out, a = [], 0
    while a < len(data):
        b = a + GROUP_BYTES
        while b < len(data) and not _SPACE[data[b]]:
            near = np.flatnonzero(_SPACE[data[b : b + 65536]])
            b = b + int(near[0]) if len(near) else b + 65536
        out.append(_words(data[a:b], np.zeros(1, np.int64))[0])
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _combined(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    acc = np.zeros(len(words) - n + 1, np.uint64)
    factor = 1
    for k in range(n):
        factor = (factor * 0xD6E8FEB86659FD93 + 2 * n) % (1 << 64)
        acc += words[k : len(words) - n + 1 + k] * np.uint64(factor)
    return mixed(acc)


def shingle_hashes(texts: pa.Array):
    """For each text the hashes of its shingles in order (uint64, repeats kept), one array after the other."""
    texts = texts.cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + GROUP_BYTES, "right")) - 1)
        part = data[offs[i] : offs[j]]
        if j == i + 1 and len(part) > GROUP_BYTES:
            words, bounds = _long_words(part), np.zeros(1, np.int64)
            bounds = np.array([0, len(words)])
        else:
            firsts = offs[i:j] - offs[i]
            words, at = _words(part, firsts)
            bounds = np.append(np.searchsorted(at, firsts), len(at))
        runs = _combined(words, SHINGLE_WORDS) if len(words) >= SHINGLE_WORDS else words[:0]
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            if b - a >= SHINGLE_WORDS:
                yield runs[a : b - SHINGLE_WORDS + 1]
            else:
                yield _combined(words[a:b], b - a) if b > a else words[:0]
        i = j
