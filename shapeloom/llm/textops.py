"""Vectorised word hashing for whole batches of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = re.compile(rb"[ \t-\r]")
_P = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Polynomial hashes are sound for words of usual length; longer ones are hashed by xxhash.
_LONG = 200
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            table = np.full(max(n, CHUNK + (1 << 16)), p, np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS[0], _POWERS[1]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (between ASCII white space) of all texts, and each text's first word, with
    the number of words at the end.  ``CHUNK`` bytes are hashed at a time; longer texts are cut between words."""
    hashes, counts, lo, total = [], [], 0, 0
    for hi, text in enumerate([*texts, None]):
        if hi > lo and (text is None or total + len(text) > CHUNK):
            if total > CHUNK:  # one long text
                parts = [_hash_chunk([x])[0] for x in _segments(texts[lo])]
                hashes += parts
                counts.append(sum(map(len, parts)))
            else:
                h, first = _hash_chunk(texts[lo:hi])
                hashes.append(h)
                counts += np.diff(first).tolist()
            lo, total = hi, 0
        total += len(text or b"")
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.cumsum([0, *counts])


def _segments(text: bytes) -> Iterator[bytes]:
    lo = 0
    while lo < len(text):
        m = _SPACE.search(text, lo + CHUNK)
        hi = m.end() if m else len(text)
        yield text[lo:hi]
        lo = hi


def _hash_chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = b" " + b" ".join(texts) + b" "
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    powers, inverse = _powers(len(raw))
    sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], dtype=np.uint64)
    h = (sums[ends - 1] - sums[starts - 1]) * inverse[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(ends - starts > _LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(starts, at)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; the whole sequence as one, if it is shorter; none of no words."""
    width = min(width, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k : k + n])
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``size`` bytes of text (or one text), and their texts; null is empty."""
    for batch in batches:
        lo, texts, total = 0, [], 0
        for hi, value in enumerate(batch.column(column).cast(pa.binary())):
            text = value.as_py() or b""
            if texts and total + len(text) > size:
                yield batch.slice(lo, hi - lo), texts
                lo, texts, total = hi, [], 0
            texts.append(text)
            total += len(text)
        if texts:
            yield batch.slice(lo), texts
