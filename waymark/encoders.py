"""Encoders are opaque functions of a row's input; a worker makes one and feeds it Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Encoder(Protocol):
    dimension: int

    def encode_texts(self, texts: list[str]) -> np.ndarray: ...

    def encode_images(self, images: list[bytes]) -> np.ndarray: ...


class HashingEncoder:
    """A deterministic stand-in for tests: a signed count of hashed words (or bytes' chunks), normalised."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def _vector(self, parts: list[bytes]) -> np.ndarray:
        v = np.zeros(self.dimension, np.float32)
        for p in parts:
            h = int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little")
            v[h % self.dimension] += 1.0 if h >> 63 else -1.0
        size = float(np.linalg.norm(v))
        return v / size if size else v

    def encode_texts(self, texts: list[str]) -> np.ndarray:
        return np.stack([self._vector(t.lower().encode().split()) for t in texts]) if texts else np.zeros((0, self.dimension), np.float32)

    def encode_images(self, images: list[bytes]) -> np.ndarray:
        return np.stack([self._vector([b[i : i + 64] for i in range(0, len(b), 64)]) for b in images]) if images else np.zeros((0, self.dimension), np.float32)


def encode(df: DataFrame, column: str, make: Callable[[], Encoder], kind: str = "text", on_error: str = "null", name: str = "embedding") -> DataFrame:
    """df with a vector for each row. on_error: null, zero, drop or raise for inputs that the encoder refuses; null inputs are refused."""
    if on_error not in ("null", "zero", "drop", "raise"):
        raise ValueError(f"unknown error policy: {on_error}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        call = encoder.encode_texts if kind == "text" else encoder.encode_images

        def one(x):
            try:
                return call([x])[0]
            except Exception:
                if on_error == "raise":
                    raise
                return np.zeros(encoder.dimension, np.float32) if on_error == "zero" else None

        for batch in batches:
            inputs = batch[column].tolist()
            try:
                vectors = list(call(inputs)) if inputs else []
            except Exception:  # one bad input must not cost the batch
                vectors = [one(x) for x in inputs]
            batch[name] = pd.Series([None if v is None else v.tolist() for v in vectors], index=batch.index, dtype=object)
            yield batch[batch[name].notna()] if on_error == "drop" else batch

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    return df.mapInPandas(run, schema)


def frames_pooled(vectors: np.ndarray) -> np.ndarray:
    """The mean of a clip's frame vectors, normalised."""
    m = vectors.mean(axis=0)
    return m / max(float(np.linalg.norm(m)), 1e-12)
