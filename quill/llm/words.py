"""Words of many texts at once: spans, 64-bit hashes and hashes of runs of words, as numpy arrays.

A word's hash is a polynomial over its bytes modulo 2**64, taken from one running sum over
the whole buffer, then mixed. Hashes only find candidates; whoever needs certainty compares
the bytes.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1

#: Bytes of words: digits, lower-case letters and everything outside ASCII.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = f"{base}"
    if key not in _powers or len(_powers[key]) < n:
        out = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        out[0] = 1
        _powers[key] = np.multiply.accumulate(out)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_weights(n: int) -> np.ndarray:
    """Odd multipliers for the places of a run of n words."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def run_hashes(hashes: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs of n words that start at each word, or only at the given words."""
    weights = run_weights(n)
    m = len(hashes) - n + 1
    if at is None and m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m if at is None else len(at), dtype=np.uint64)
    for j in range(n):
        out += weights[j] * (hashes[j : m + j] if at is None else hashes[at + j])
    return mix(out + np.uint64(n))


class Words:
    """The words of a list of texts: buffer, starts, ends, hashes, and the number of the text of each."""

    def __init__(self, texts: list[bytes | None], word_bytes: np.ndarray = WORD_BYTES):
        lowered = [(t or b"").lower() for t in texts]
        self.raw = b"\n".join(lowered) + b"\n"
        buffer = np.frombuffer(self.raw, dtype=np.uint8)
        inside = word_bytes[buffer]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[::2], edges[1::2]
        offsets = np.cumsum([0] + [len(t) + 1 for t in lowered])[:-1]
        firsts = np.searchsorted(self.starts, offsets)
        self.bounds = np.concatenate([firsts, [len(self.starts)]])  # of the words of each text
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        total = np.empty(len(buffer) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(buffer)), out=total[1:])
        span = (total[self.ends] - total[self.starts]) * _power(_INVERSE, len(buffer))[self.starts]
        self.hashes = mix(span ^ ((self.ends - self.starts).astype(np.uint64) << np.uint64(56)))

    def __len__(self) -> int:
        return len(self.starts)

    def same_text(self, n: int) -> np.ndarray:
        """For each run of n words, whether one text holds it."""
        m = len(self) - n + 1
        return self.text[:m] == self.text[n - 1 :] if m > 0 else np.zeros(0, dtype=bool)

    def joined(self, start: int, n: int) -> bytes:
        return b" ".join(self.raw[s:e] for s, e in zip(self.starts[start : start + n], self.ends[start : start + n], strict=True))
