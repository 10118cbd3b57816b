"""Token counts: a native estimate by default, any tokenizer through an Arrow-batched UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.config import DEFAULT_EMBEDDING_TOKEN_LIMIT, EMBEDDING_MODEL_TOKEN_LIMITS

CHARS_PER_TOKEN = 4

# Control tokens that may not reach a tokenizer as text.
SPECIAL_TOKENS = (
    "endoftext",
    "endofprompt",
    "fim_prefix",
    "fim_middle",
    "fim_suffix",
    "start_header_id",
    "end_header_id",
    "eot_id",
)


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, tokens: list[int]) -> str: ...


TokenizerFactory = Callable[[], Tokenizer]


def sanitize_special_tokens(col: Column) -> Column:
    return F.regexp_replace(
        col, "<\\|(" + "|".join(SPECIAL_TOKENS) + ")\\|>", "&lt;&#124;$1&#124;&gt;"
    )


def estimate_tokens(col: Column) -> Column:
    """About four characters per token, rounded up; empty and null count 0."""
    return F.ceil(F.coalesce(F.length(col), F.lit(0)) / F.lit(CHARS_PER_TOKEN)).cast("int")


def count_tokens(col: Column, tokenizer: TokenizerFactory | None = None) -> Column:
    if tokenizer is None:
        return estimate_tokens(col)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer().encode
        for texts in batches:
            yield texts.map(lambda text: len(encode(text)) if text else 0).astype("int32")

    return count(sanitize_special_tokens(col))


def embedding_token_limit(
    df: DataFrame,
    model_col: str = "model",
    explicit_col: str | None = None,
    limits: tuple[tuple[str, int], ...] = EMBEDDING_MODEL_TOKEN_LIMITS,
) -> DataFrame:
    """Add ``token_limit``: explicit limit, exact model, first declared prefix, default."""
    model = F.lower(F.trim(F.col(model_col)))
    exact = prefix = None
    for name, limit in limits:
        exact = F.when(model == name, limit) if exact is None else exact.when(model == name, limit)
        hit = model.startswith(name)
        prefix = F.when(hit, limit) if prefix is None else prefix.when(hit, limit)
    chosen = [c for c in (exact, prefix) if c is not None] + [F.lit(DEFAULT_EMBEDDING_TOKEN_LIMIT)]
    if explicit_col is not None:
        explicit = F.col(explicit_col)
        chosen.insert(0, F.when(explicit > 0, F.floor(explicit)))
    return df.withColumn("token_limit", F.coalesce(*chosen).cast("int"))
