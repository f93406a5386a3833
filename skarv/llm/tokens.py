"""Tokens of a public tokenizer, counted and placed, whole texts only."""

from __future__ import annotations

import base64
import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A byte-level vocabulary in rank order: one base64 token and its rank a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, tuple] = {}


def distribute(spark: SparkSession, vocabulary: str = VOCABULARY) -> None:
    """Sends the vocabulary to all executors, where they don't have it at its path."""
    spark.sparkContext.addFile(vocabulary)


def _found(vocabulary: str) -> str:
    """The vocabulary at its path, or as ``distribute`` sent it."""
    if os.path.exists(vocabulary):
        return vocabulary
    from pyspark import SparkFiles

    try:
        sent = SparkFiles.get(os.path.basename(vocabulary))
    except Exception:
        sent = ""
    if not os.path.exists(sent):
        raise FileNotFoundError(f"no vocabulary at {vocabulary} on this worker; put it there or send it by skarv.llm.tokens.distribute")
    return sent


def encoding(vocabulary: str):
    """The tokenizer and the byte length of each token, loaded once a worker."""
    if vocabulary not in _LOADED:
        import tiktoken

        with open(_found(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int32)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _LOADED[vocabulary] = (tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths)
    return _LOADED[vocabulary]


def tokenize(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Token ids of the whole text, as the tokenizer gives them; special tokens' strings are ordinary text."""
    return np.asarray(encoding(vocabulary)[0].encode_ordinary(text), dtype=np.int32)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens of each text; 0 for a null or empty one."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if not t else len(tokenize(t, vocabulary)) for t in texts], dtype="int64")

    return count.asNondeterministic()(text)  # lest a filter behind it count twice
