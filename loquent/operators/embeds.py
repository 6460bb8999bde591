"""Vectors for rows that lack a fresh one, by an encoder that the caller passes; stored rows are replaced by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.operators.state import upsert

#: Takes a batch of texts, or of binary images, and returns a vector for each; None where it has none.
Encoder = Callable[[pd.Series], Sequence[list[float] | None]]


def due(rows: DataFrame, stored: DataFrame, keys: list[str], content: str = "text") -> DataFrame:
    """Rows with a content whose SHA-256 isn't what is stored under their keys, or that have no vector there."""
    hashed = rows.filter(F.col(content).isNotNull()).withColumn("content_hash", F.sha2(content, 256))
    fresh = stored.filter(F.col("vec").isNotNull()).select(*keys, "content_hash")
    return hashed.join(fresh, [*keys, "content_hash"], "left_anti")


def embed_and_upsert(rows: DataFrame, stored: DataFrame, keys: list[str], encoder: Encoder, content: str = "text", model: str = "encoder") -> DataFrame:
    """The new state of ``stored`` (keys, vec, content_hash, tokens, model): due rows are encoded in batches, others stay.

    Tokens are a fourth of the characters, rounded; null for images. Rows for which the encoder has no vector are left as
    they were stored, so a later pass tries them again.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if v is None else [float(x) for x in v] for v in encoder(batch)], index=batch.index, dtype=object)

    todo = due(rows, stored, keys, content)
    is_text = dict(rows.dtypes)[content] == "string"
    tokens = F.round(F.length(content) / 4).cast("long") if is_text else F.lit(None).cast("long")
    made = todo.select(*keys, encode(F.col(content)).alias("vec"), "content_hash", tokens.alias("tokens"), F.lit(model).alias("model"))
    return upsert(stored, made.filter(F.col("vec").isNotNull()), keys)
