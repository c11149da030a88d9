"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file (token in base64 and rank a line), read where the tasks run.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to that vocabulary; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer; once per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_lengths(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens) for each row; a null text has 0 tokens. Whole texts are tokenised."""
    d = df.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["k", "n_tokens"])

    out = d.mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, n_tokens bigint")
    return out.withColumnRenamed("k", key)
