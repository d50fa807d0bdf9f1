"""Word and window fingerprints inside tasks.

A word's fingerprint is a polynomial of random numbers, one for each byte value, modulo 2**64,
mixed at the end; all words of many texts are done at once. Words of over 64 bytes take 64
bits of BLAKE2b. A window's fingerprint is a polynomial of its words', again mixed. Two
different words or windows agree with a chance of about 2**-57.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES, LONG_WORD = 512 << 10, 64


def _digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little")


_BYTE = np.array([_digest(bytes([b])) for b in range(256)], np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers 0 to n-1."""
    if len(_POWERS[0]) < n:
        size = max(4096, 2 * n)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash: every bit depends on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words (runs of anything but ASCII white space) and where they start."""
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate(([True], _IS_SPACE[raw], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[:len(raw)], out=sums[1:])
        out = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[k] = _digest(data[start[k]:end[k]])
    return out, start


def _long_text_hashes(data: bytes) -> np.ndarray:
    """Of a text beyond a chunk: it is cut at white space."""
    parts, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > CHUNK_BYTES:
            blank = max(data.rfind(c, at, at + CHUNK_BYTES) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if blank < 0:  # one word fills the chunk
                blanks = [x for x in (data.find(c, at) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
                end = min(blanks, default=len(data))
                parts.append(np.array([_digest(data[at:end])], np.uint64))
                at = end
                continue
            end = blank + 1
        parts.append(_chunk_hashes(data[at:end])[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def text_hashes(texts: Sequence[str | None], lower: bool = False) -> Iterator[np.ndarray]:
    """For each text the fingerprints of its words in order; ``lower`` turns A to Z into a to z first."""
    held: list[bytes] = []
    size = 0

    def settled():
        out, start = _chunk_hashes(b"\n".join(held))
        ends = np.cumsum([len(d) + 1 for d in held])
        return np.split(out, np.searchsorted(start, ends[:-1]))

    for text in texts:
        data = (text or "").encode()
        data = data.lower() if lower else data  # of bytes A to Z alone
        if held and size + len(data) > CHUNK_BYTES:
            yield from settled()
            held, size = [], 0
        if len(data) > CHUNK_BYTES:
            yield _long_text_hashes(data)
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        yield from settled()


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of all runs of ``width`` words, in order; none if there are fewer words."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)))
        return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1] + np.uint64(width))


def span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the runs of words from each start to before each end."""
    up, down = _powers(len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:len(hashes)], dtype=np.uint64)))
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        x = best(x[size:], x[:-size])
        size *= 2
    rest = width - size
    return best(x[rest:], x[:len(x) - rest]) if rest else x
