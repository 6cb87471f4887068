"""Text sizes in tokens of a public byte-level BPE tokenizer, as a Spark column."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The vocabulary file; every executor has it at this place.
DEFAULT_VOCABULARY = os.environ.get("LODEGRAPH_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed pattern: the pieces that the vocabulary's tokenizer cuts a text into.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer runs without white space are cut before they are encoded, as the encoder's time grows with the square of a piece.
RUN = 20_000


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = DEFAULT_VOCABULARY) -> int:
    if not text:
        return 0
    encode = encoder(vocabulary).encode_ordinary
    if len(text) <= RUN:
        return len(encode(text))
    total, start = 0, 0
    while start < len(text):
        end = start + RUN
        if end < len(text):
            # cut before a blank that a letter follows: no piece spans it
            at = text.rfind(" ", start + 1, end)
            while at > start and not text[at + 1 : at + 2].isalpha():
                at = text.rfind(" ", start + 1, at)
            end = at if at > start else end
        total += len(encode(text[start:end]))
        start = end
    return total


def token_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens (long) of the whole text; 0 for null and empty texts."""

    @F.arrow_udf(T.LongType())
    def count(x: pa.Array) -> pa.Array:
        return pa.array([count_tokens(t, vocabulary) for t in x.to_pylist()], pa.int64())

    return count(text)
