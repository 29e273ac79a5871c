"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: Rank file (base64 token, rank a line) of the byte-level BPE used for sizes.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern published with that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BLANKS = 2_000
_LONG_BLANK = re.compile(r"\s{%d}" % _BLANKS)
_PIECES = regex.compile(PATTERN)
_ENCODERS: dict[str, object] = {}


def encoder(ranks: str = RANKS):
    """The tokenizer, loaded once per process."""
    if ranks not in _ENCODERS:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[ranks] = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[ranks]


def count_tokens(text: str | None, ranks: str = RANKS) -> int:
    """Tokens of one text.

    A run of very many blanks overflows the stack of the tokenizer's own pattern engine, so such
    texts are cut into pieces by the ``regex`` module with the same pattern; the count is the same.
    """
    if not text:
        return 0
    enc = encoder(ranks)
    if len(text) >= _BLANKS and _LONG_BLANK.search(text):
        return sum(len(enc._encode_single_piece(w.encode("utf-8", "replace"))) for w in _PIECES.findall(text))
    return len(enc.encode_ordinary(text))


def with_token_counts(df: DataFrame, text: str, out: str = "n_tokens", ranks: str = RANKS) -> DataFrame:
    """``df`` without ``text``, with the number of tokens of the whole text in ``out``.

    Null and empty texts have 0 tokens. Special-token strings in a text are ordinary text.
    Only the text crosses to Python, in Arrow batches.
    """

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([count_tokens(t, ranks) for t in s], dtype="int64")

    return df.withColumn(out, count(F.col(text))).drop(text)
