"""Byte-level BPE by rank-synchronous merging of ragged arrays.

Many pre-tokens are held as one array of symbols with an array of their owners. In each
round every pre-token finds the pair of lowest rank that it holds and merges all its
non-overlapping occurrences, all pre-tokens at once, until none holds a pair. Since a
pre-token merges its own lowest pair first, the result is that of the sequential algorithm.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

#: The pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks whose tokens a worker remembers, at most, and the longest chunk remembered.
REMEMBER, REMEMBER_CHARS = 400_000, 64
#: Symbols in one run of merging, at most, unless one pre-token is longer.
SYMBOLS = 1 << 18
_NONE = np.int32(2**31 - 1)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary file: itself if printable, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTable:
    """Pairs of symbols to rank and merged symbol: open addressing in numpy arrays, looked up many at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = int(np.ceil(np.log2(max(2, len(left))))) + 2
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.ranks = np.full(size, _NONE, dtype=np.int32)
        self.merged = np.zeros(size, dtype=np.int32)
        self.probes = 1
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = self._slots(keys)
        left_over = np.arange(len(keys))
        step = 0
        while len(left_over):
            at = (slots[left_over] + step) & (size - 1)
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            put = left_over[first]
            self.keys[at[first]], self.ranks[at[first]], self.merged[at[first]] = keys[put], put, merged[put]
            left_over = np.delete(left_over, first)
            step += 1
        self.probes = step

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE: no such pair) and merged symbol of each pair."""
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slots(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        left_over = np.arange(len(keys))
        for step in range(self.probes):
            at = (slots[left_over] + step) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[left_over]
            out[left_over[hit]] = at[hit]
            left_over = left_over[~hit & (found != -1)]
            if not len(left_over):
                break
        ranks = np.where(out >= 0, self.ranks[out], _NONE)
        return ranks, self.merged[out]


class Merger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int64).reshape(-1, 3)
        self.table = PairTable(ids[:, 0], ids[:, 1], ids[:, 2])
        characters = byte_characters()
        self.bytes = np.array([vocab[characters[b]] for b in range(256)], dtype=np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._pattern = regex.compile(PATTERN)
        self._space = regex.compile(r"\s").match
        #: Tokens, as little-endian 32-bit ids, of a chunk that follows a space; None: it can't be taken by itself.
        self.known: dict[str, bytes | None] = {"": None}
        self.first: dict[str, bytes] = {}

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All surviving symbols of pre-tokens and how many each has."""
        ids, counts, start = [], [], 0
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        total = np.cumsum(sizes)
        while start < len(tokens):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + SYMBOLS, side="right")))
            a, b = self._merge(b"".join(tokens[start:stop]), sizes[start:stop])
            ids.append(a)
            counts.append(b)
            start = stop
        if not ids:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    def _merge(self, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_owners = len(sizes)
        symbols = self.bytes[np.frombuffer(raw, dtype=np.uint8)]
        owner = np.repeat(np.arange(n_owners, dtype=np.int32), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks = merged = None
        while len(symbols):
            joined = np.zeros(len(symbols), dtype=bool)  # a symbol and its right neighbour have one owner
            joined[:-1] = owner[1:] == owner[:-1]
            if ranks is None:
                ranks = np.full(len(symbols), _NONE, dtype=np.int32)
                merged = np.zeros(len(symbols), dtype=np.int32)
                at = np.flatnonzero(joined)
                ranks[at], merged[at] = self.table.find(symbols[at], symbols[at + 1])
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(ranks, heads)
            lengths = np.diff(np.concatenate([heads, [len(symbols)]]))
            ended = np.repeat(lowest == _NONE, lengths)
            if ended.any():
                done.append((symbols[ended], owner[ended]))
                keep = ~ended
                symbols, owner, ranks, merged, joined = symbols[keep], owner[keep], ranks[keep], merged[keep], joined[keep]
                going = lowest != _NONE
                lowest, lengths = lowest[going], lengths[going]
                if not len(symbols):
                    break
            pick = ranks == np.repeat(lowest, lengths)
            run = np.flatnonzero(pick)
            if len(run) > 1:  # of picked pairs that overlap, every other one from the left
                chain = np.concatenate([[False], (run[1:] == run[:-1] + 1)])
                if chain.any():
                    begin = np.maximum.accumulate(np.where(chain, 0, np.arange(len(run))))
                    run = run[(np.arange(len(run)) - begin) % 2 == 0]
            symbols[run] = merged[run]
            keep = np.ones(len(symbols), dtype=bool)
            keep[run + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, ranks, merged = symbols[keep], owner[keep], ranks[keep], merged[keep]
            new = place[run]
            touched = np.zeros(len(symbols), dtype=bool)
            touched[new] = True
            touched[new[new > 0] - 1] = True
            stale = np.flatnonzero(touched)
            ranks[stale] = _NONE
            inner = stale[stale < len(symbols) - 1]
            inner = inner[owner[inner] == owner[inner + 1]]
            ranks[inner], merged[inner] = self.table.find(symbols[inner], symbols[inner + 1])
        if not done:
            return symbols, np.zeros(n_owners, dtype=np.int64)
        symbols, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=n_owners)

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that hold no special token, without memory."""
        tokens: list[bytes] = []
        sizes = []
        for t in texts:
            found = self._pattern.findall(t)
            sizes.append(len(found))
            tokens += map(str.encode, found)
        ids, counts = self.merge(tokens)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])] * 4
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that each follow a space. Side by side they are a text in which only a chunk's first pre-token begins with a space."""
        if not chunks:
            return []
        tokens = list(map(str.encode, self._pattern.findall(" " + " ".join(chunks))))
        ids, counts = self.merge(tokens)
        starts = np.flatnonzero(np.fromiter((t[0] == 32 for t in tokens), dtype=bool, count=len(tokens)))
        ends = np.append(np.concatenate([[0], np.cumsum(counts)])[starts], len(ids)) * 4
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; special strings become their tokens; null is empty.

        A text is cut at its single spaces: what follows a space, up to the next, is
        tokenized alike wherever it stands, so a worker remembers it. A text with a chunk
        that is empty or begins with white space is tokenized whole.
        """
        parts: list[str] = []
        plans: list[list[int | bytes]] = []
        for t in texts:
            plan: list[int | bytes] = []
            at = 0
            for m in self._special.finditer(t) if t and self._special else ():
                plan.append(len(parts))
                parts.append(t[at : m.start()])
                plan.append(np.uint32(self.special[m[0]]).tobytes())
                at = m.end()
            plan.append(len(parts))
            parts.append((t or "")[at:])
            plans.append(plan)
        split = [p.split(" ") for p in parts]
        later: set[str] = set()
        heads: set[str] = set()
        for chunks in split:
            heads.add(chunks[0])
            later.update(chunks[1:])
        if len(self.known) > REMEMBER:  # what this batch has again stays
            self.known = {c: self.known[c] for c in later & self.known.keys()} | {"": None}
        if len(self.first) > REMEMBER // 8:
            self.first = {}
        later -= self.known.keys()
        heads -= self.first.keys()
        new = list(later)
        odd = [c for c in new if c[0].isspace() or self._space(c)]
        if odd:
            new = list(later.difference(odd))
        ids = self._encode_chunks(new)
        firsts = list(heads)
        known = self.known | dict(zip(new, ids, strict=True)) | dict.fromkeys(odd) if len(new) > REMEMBER // 2 else self.known
        if known is self.known:
            known.update(zip(new, ids, strict=True))
            known.update(dict.fromkeys(odd))
        first = dict(zip(firsts, self._encode(firsts), strict=True))
        for c, x in first.items():
            if len(c) <= REMEMBER_CHARS:
                self.first[c] = x
        out: list[bytes | None] = []
        whole: list[int] = []
        for i, chunks in enumerate(split):
            head = first.get(chunks[0]) if chunks[0] in first else self.first[chunks[0]]
            try:
                out.append(head + b"".join([known[c] for c in chunks[1:]]))
            except TypeError:
                out.append(None)
                whole.append(i)
        for i in whole:
            out[i] = self._encode([parts[i]])[0]
        if known is self.known:
            for c in [c for c in new if len(c) > REMEMBER_CHARS]:
                del known[c]
        return [b"".join(x if isinstance(x, bytes) else out[x] for x in plan) for plan in plans]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)
