"""Sentences, pieces of them and chunks, over Arrow batches: one pass over each text, whatever its length."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quill.sources.shared import tune

# Words whose full stop ends no sentence.
ABBREVIATIONS = ("al", "approx", "ca", "cf", "e.g", "eq", "eqs", "etc", "fig", "figs", "i.e", "inc", "no", "pp", "ref", "refs", "resp", "sec", "secs", "st", "tab", "tabs", "vs", "vol")

_SPACE = " \t\n\r\f\x0b"
_BOUNDARY = re.compile(r"(?<=[.!?])[ \t\n]+(?=[A-Z(\[\"'])")
_ABBREVIATED = re.compile(rf"(?:^|[{_SPACE}])(?:{'|'.join(map(re.escape, ABBREVIATIONS))})\.$", re.IGNORECASE | re.ASCII)
_LONGEST = max(map(len, ABBREVIATIONS)) + 2
_WORD = re.compile(r"\S+", re.ASCII)

KIND = "array<struct<text:string,start:int,end:int>>"


def split(text: str) -> list[tuple[int, int]]:
    """(start, end) of a text's sentences; white space around them is no part, and an abbreviation's full stop ends none."""
    out, start = [], 0

    def close(stop: int) -> None:
        a, b = start, stop
        while a < b and text[a] in _SPACE:
            a += 1
        while b > a and text[b - 1] in _SPACE:
            b -= 1
        if b > a:
            out.append((a, b))

    for m in _BOUNDARY.finditer(text):
        if not _ABBREVIATED.search(text, max(0, m.start() - _LONGEST), m.start()):
            close(m.start())
            start = m.end()
    close(len(text))
    return out


def fitted(text: str, spans: list[tuple[int, int]], budget: int, counter) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of sentences; one of more tokens than the budget is cut between words, each piece as long as fits."""
    out = []
    for (a, b), n in zip(spans, counter.counts([text[a:b] for a, b in spans]), strict=True):
        out.extend([(a, b, n)] if n <= budget else cut(text, a, b, budget, counter))
    return out


def cut(text: str, a: int, b: int, budget: int, counter) -> list[tuple[int, int, int]]:
    """A sentence's pieces of at most budget tokens, or of one longer word."""
    words = [(a + m.start(), a + m.end()) for m in _WORD.finditer(text[a:b])]
    texts = [text[x:y] for x, y in words]
    out, first = [], 0
    while first < len(words):
        # Tokens don't fall as words are added: the last word that fits is found by doubling, then by halving.
        fits = lambda n: n <= 1 or counter.counts([" ".join(texts[first : first + n])])[0] <= budget  # noqa: B023, E731
        low, high = 1, 2
        while first + high <= len(words) and fits(high):
            low, high = high, 2 * high
        high = min(high, len(words) - first + 1)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if fits(middle) else (low, middle)
        start, end = words[first][0], words[first + low - 1][1]
        out.append((start, end))
        first += low
    return [(x, y, n) for (x, y), n in zip(out, counter.counts([text[x:y] for x, y in out]), strict=True)]


def pack(tokens: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) sentence numbers, from 0, of each chunk.

    A chunk is closed when the next sentence would not fit. The next one begins with the
    longest run of sentences at its end that has at most overlap tokens and isn't all of it, unless
    that run and the next sentence together don't fit.
    """
    total = [0]
    for t in tokens:
        total.append(total[-1] + t)
    out, first = [], 0
    for i, t in enumerate(tokens):
        if i > first and total[i + 1] - total[first] > budget:
            out.append((first, i - 1))
            # The first sentence after the chunk's own first from which overlap tokens reach to its end.
            start = i
            while overlap > 0 and start - 1 > first and total[i] - total[start - 1] <= overlap:
                start -= 1
            first = i if total[i] - total[start] + t > budget else start
    if tokens:
        out.append((first, len(tokens) - 1))
    return out


class Pages:
    """Where pages begin and end in a document's text, in order."""

    def __init__(self, pages: list[dict] | None, figure_only: list[int] | None):
        rows = sorted((p["char_start"], p["char_end"], p["page"]) for p in pages or ())
        self.starts, self.ends, self.pages = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        self.figure_only = set(figure_only or ())

    def range(self, a: int, b: int) -> tuple[int, int]:
        """First and last page that a stretch of text overlaps; 1, 1 if none."""
        low, high = bisect_right(self.ends, a), bisect_right(self.starts, b - 1)
        return (self.pages[low], self.pages[high - 1]) if low < high else (1, 1)

    def only_figures(self, a: int, b: int) -> bool:
        first, last = self.range(a, b)
        return bool(self.figure_only) and self.figure_only.issuperset(range(first, last + 1))


def sentences(text: Column) -> Column:
    """array<struct<text, start, end>>: sentences and where they stand; a null text has none."""
    return _placed(text, F.lit(None).cast("long"))


def pieces(text: Column, budget: Column | int) -> Column:
    """The same, those with more words than the budget cut into pieces."""
    return _placed(text, (F.lit(budget) if isinstance(budget, int) else budget).cast("long"))


def _placed(text: Column, budget: Column) -> Column:
    tune(SparkSession.active())

    @F.arrow_udf(KIND)
    def run(texts: pa.Array, budgets: pa.Array) -> pa.Array:
        from quill.functions.tokens import WhitespaceCounter

        counter, sizes, own, starts, ends = WhitespaceCounter(), [0], [], [], []
        for t, n in zip(texts.to_pylist(), budgets.to_pylist(), strict=True):
            spans = split(t) if t else []
            if n is not None:
                spans = [(a, b) for a, b, _ in fitted(t or "", spans, n, counter)]
            own += [t[a:b] for a, b in spans]
            starts += [a for a, _ in spans]
            ends += [b for _, b in spans]
            sizes.append(len(own))
        rows = pa.StructArray.from_arrays([pa.array(own, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["text", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.array(sizes), pa.int32()), rows)

    return run(text, budget)
