"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how the tokenizer of that vocabulary cuts text before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoder of a vocabulary file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a text; none for null and empty ones."""
    return len(encoder(path).encode_ordinary(text)) if text else 0


def with_tokens(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``n_tokens``; texts go to Python once and do not come back."""
    kinds = dict(df.dtypes)

    def run(batches):
        for pdf in batches:
            out = pdf[keep].copy()
            out["n_tokens"] = [count(t, path) for t in pdf["__text"]]
            yield out

    return df.selectExpr(*[f"`{c}`" for c in keep], f"`{text}` as __text").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long")
