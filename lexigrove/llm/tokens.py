"""Token counts by a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; every executor needs them at this place.
DEFAULT_RANKS = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")

#: Fixed value: the pattern that splits text before the merges of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(ranks_file: str):
    """The byte-level encoding of a rank file; loaded once in a worker."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, doc_id: str, text: str, ranks_file: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; a null or empty text has 0 tokens.

    Only the counts leave the Python workers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_file)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(count, "doc_id BIGINT, n_tokens BIGINT")
