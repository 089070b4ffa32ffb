"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("QUILLGRAPH_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the pattern that splits text before the merges of this rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def with_tokens(rows: DataFrame, text: str, out: str = "tokens", path: str = TOKENIZER) -> DataFrame:
    """Add ``out``, the number of tokens of the whole text in column ``text`` (null and empty: 0).

    The rank file is read on the driver and broadcast (about 1 MB), so the executors need not have it.
    """
    with open(path, "rb") as f:
        sent = rows.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in texts:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return rows.withColumn(out, count(F.col(text)))
