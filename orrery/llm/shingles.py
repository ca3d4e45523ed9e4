"""Distinct word shingles of whole batches of texts, hashed by array operations on their bytes.

A text is taken in its consistent form and in lower case; words are unbroken runs of letters and digits; a shingle is ``k``
consecutive words, identified by a 48-bit hash. Texts with fewer than ``k`` words, empty and null texts have none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

from orrery.llm.lookalikes import _OUTSIDE_ASCII, Normaliser

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes taken at a time; one text is never split, so a longer one is a slab of its own.
SLAB = 1 << 21
_LOW16 = np.uint64(0xFFFF)


def _byte_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for c in range(128):
        if chr(c).isalnum():
            t[c] = ord(chr(c).lower())
    t[128:] = np.arange(128, 256)
    return t


_TABLE = _byte_table()
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    key = hex(base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        with np.errstate(over="ignore"):
            _POWERS[key] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, SLAB + 4096), base, np.uint64)]), dtype=np.uint64)
    return _POWERS[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def clean(text: str | None, norm: Normaliser) -> bytes:
    """UTF-8 bytes of the text in the form in which every byte outside ASCII belongs to a word."""
    if not text:
        return b""
    if not text.isascii():
        text = norm(text).lower()
        for c in set(_OUTSIDE_ASCII.findall(text)):
            if not c.isalnum():
                text = text.replace(c, " ")
    elif "\x00" in text or not text.isprintable():
        text = norm(text)
    return text.encode("utf-8", "replace")


def text_hash(cleaned: bytes) -> int:
    """A signed 64-bit hash of a cleaned text, in lower case."""
    return xxhash.xxh3_64_intdigest(cleaned.lower()) - (1 << 63)


def shingle_sets(cleaned: Sequence[bytes], k: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, times): the distinct shingles of each text by its position, sorted, and how often each stands there."""
    docs, hashes, times, first = [], [], [], 0
    while first < len(cleaned):
        size, last = 0, first
        while last < len(cleaned) and last - first < 65535 and (last == first or size + len(cleaned[last]) < SLAB):
            size += len(cleaned[last]) + 1
            last += 1
        d, h, n = _slab(cleaned[first:last], k)
        docs.append(d + first)
        hashes.append(h)
        times.append(n)
        first = last
    empty = np.zeros(0, np.int64)
    return (np.concatenate(docs), np.concatenate(hashes), np.concatenate(times)) if docs else (empty, empty.astype(np.uint64), empty)


def _slab(texts: Sequence[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = _TABLE[np.frombuffer(b"\x00" + b"\x00".join(texts) + b"\x00", np.uint8)]
    word = x != 0
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    if len(start) < k:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z
    with np.errstate(over="ignore"):
        total = np.cumsum(x * _powers(_BASE, len(x))[: len(x)])
        w = mix((total[end - 1] - total[start - 1]) * _powers(_INVERSE, len(x))[start] + (end - start).astype(np.uint64))
        s = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            s = (s + w[i : len(w) - k + 1 + i]) * np.uint64(_ODD) ^ (s >> np.uint64(29))
        s = mix(s) >> np.uint64(16)
    begins = np.cumsum([1] + [len(t) + 1 for t in texts[:-1]])
    doc = np.searchsorted(begins, start, side="right") - 1
    same = doc[: len(s)] == doc[k - 1 :]
    both = np.sort(s[same] | doc[: len(s)][same].astype(np.uint64) << np.uint64(48))
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    both, n = both[new], np.diff(np.concatenate([new, [len(both)]]))
    return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1), n
