"""Token counts by a public tokenizer, in Arrow batches. The vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def default_vocabulary() -> str:
    """Path of the byte-level vocabulary that the installed tokenizer package brings along."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str | None = None) -> Callable:
    """A Column function: number of tokens of a text, 0 for null and empty ones."""
    where = path or default_vocabulary()

    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(where)
        return pd.Series([len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, LongType())
