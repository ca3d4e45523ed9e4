"""Sizes of texts in tokens of a public tokenizer, given by the path of its rank file."""

from __future__ import annotations

import base64
import functools
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank file of byte pairs and the pattern that splits text before the merges; both are parameters everywhere.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(4)
def encoding(ranks: bytes, pattern: str):
    import tiktoken

    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})


def token_count(text: Column, ranks: str = RANKS, pattern: str = PATTERN) -> Column:
    """The number of tokens of a text, taken whole; 0 for null and empty texts. The rank file (under a megabyte) is read by
    the driver alone and broadcast."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(Path(ranks).read_bytes())

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        e = encoding(shared.value, pattern)
        return s.map(lambda t: len(e.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)


def with_tokens(df: DataFrame, text: str, name: str = "n_tokens", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column exists already: {name}")
    return df.withColumn(name, token_count(F.col(text), ranks, pattern))
