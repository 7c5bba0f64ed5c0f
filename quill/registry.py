"""What can be supplied by name: encoders, scorers of reranking, token counters, extractors of files."""

from __future__ import annotations

from collections.abc import Callable

from quill.functions.tokens import WhitespaceCounter
from quill.operators.embedding import DigestEncoder
from quill.operators.ranking import constant_scorer, word_overlap_scorer


class Registry:
    """Factories by name; an unknown name is an error that names the known."""

    def __init__(self, what: str, **known: Callable):
        self.what, self._known = what, dict(known)

    def add(self, name: str, factory: Callable) -> None:
        self._known[name] = factory

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"no {self.what} {name!r}; known are {', '.join(sorted(self._known)) or 'none'}")
        return self._known[name]


#: Factories of objects with encode_documents and encode_query, made once a worker.
ENCODERS = Registry("encoder", digest=DigestEncoder)
#: Makers of functions from pairs (query, content) to pairs with rerank_score.
SCORERS = Registry("scorer", word_overlap=word_overlap_scorer, constant=constant_scorer)
#: Factories of token counters, made once a worker.
COUNTERS = Registry("token counter", whitespace=WhitespaceCounter)
#: Functions from a file's bytes to rows of spans.
EXTRACTORS = Registry("extractor")
