"""Text embeddings by an encoder that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_with(df: DataFrame, key: str, text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64, unit: bool = True, name: str = "embedding") -> DataFrame:
    """(key, embedding): ``encoder()`` is called once a task and gives a function from texts to rows of numbers.

    Rows are divided by their length if ``unit``; a zero row stays zero. Null texts are encoded as empty ones.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for f in frames:
            texts, out = f["text"].fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                x = np.asarray(encode(texts[at : at + batch]), np.float64)
                if unit:
                    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
                out += x.tolist()
            yield pd.DataFrame({key: f["key"], name: out})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"`{key}` {kind}, `{name}` array<double>")


def hashing_encoder(width: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An encoder without a model: signed counts of words by their hash."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % width] += 1 if h & 0x80000000 else -1
        return out

    return encode
