"""Token counters: how long a text is to a model. A counter is made once a worker, by name or by a factory."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class TokenCounter(Protocol):
    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, without special tokens."""
        ...


class WhitespaceCounter:
    """Words between white space (of ASCII): what people can count."""

    _word = re.compile(r"\S+", re.ASCII)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self._word.findall(t)) for t in texts]


class VocabularyCounter:
    """Tokens of a tokenizer file (WordPiece and others that the tokenizers library reads), untruncated, unpadded, without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]


def vocabulary(path: str) -> Callable[[], TokenCounter]:
    """A factory of counters for a tokenizer file, which every worker reads for itself."""
    return lambda: VocabularyCounter(path)


def token_count(text: Column, factory: Callable[[], TokenCounter] = WhitespaceCounter) -> Column:
    """Tokens of each text as a long; null of a null text."""

    made: dict = {}  # what a worker keeps

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        own = texts.to_pylist()
        if not made:
            made["counter"] = factory()
        counts = iter(made["counter"].counts([t for t in own if t is not None]))
        return pa.array([None if t is None else next(counts) for t in own], pa.int64())

    return run(text)
