"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.bpe import merger
from quill.llm.runtime import map_arrow, pieces


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_bytes, n_tokens and over_limit.

    tokenizer is the path of a byte-level BPE .json file on every executor. Null text
    counts as empty: 0 bytes, 0 tokens. Rows that repeat are each counted; null ids are
    kept; other columns are not carried. Special strings inside texts become one token, as
    the file's own library does by default.
    """

    def count(batch):
        texts = batch.column("text").to_pylist()
        merge = merger(tokenizer)
        n_tokens = [0] * len(texts)
        for a, b in pieces([t or "" for t in texts], 4 << 20):
            n_tokens[a:b] = [len(ids) // 4 for ids in merge.encode(texts[a:b])]
        yield {"id": batch.column("id"), "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n_tokens}

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_arrow(rows, count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
