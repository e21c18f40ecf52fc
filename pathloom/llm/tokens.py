"""Token counts by a public tokenizer, read from its vocabulary file on every worker."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files are; a parameter of every operator that counts tokens.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the published split pattern of the byte-level BPE vocabularies.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: A text is encoded in pieces of at most this many characters, cut after a line break or blank where there is one.
PIECE = 1 << 16


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The whole text in pieces that end before a blank, so that the split pattern sees the same words."""
    at = 0
    while len(text) - at > size:
        end = at + size
        cut = max(text.rfind("\n", at + size // 2, end), text.rfind(" ", at + size // 2, end))
        end = cut if cut > at else end
        yield text[at:end]
        at = end
    yield text[at:]


def count_tokens(text: str, path: str) -> int:
    enc = encoding(path)
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text))


def token_count(text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text, all of it; 0 for null and empty texts."""
    path = f"{tokenizers}/{vocabulary}"

    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if not t else count_tokens(t, path) for t in texts], dtype="int64")

    return counted(text)
