"""Sizes of texts in tokens of a public tokenizer; the vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: A vocabulary for many languages; any file of ranks in this format can be given.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level vocabularies cut a text before pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_count(spark: SparkSession, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Callable[[Column | str], Column]:
    """A column function: the number of tokens of a whole text; null for null, 0 for empty.

    The vocabulary is read by the driver and sent to the executors; a file of ranks has a fixed size of about 1 MB.
    """
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        e = _encoding(ranks.value, pattern)
        return pa.array([None if x is None else len(e.encode_ordinary(x)) for x in texts.to_pylist()], pa.int64())

    return lambda text: count(F.col(text) if isinstance(text, str) else text)
