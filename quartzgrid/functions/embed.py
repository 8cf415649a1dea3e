"""Embedding and reranking models that need no weights."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
#: The last dimension holds this constant, so no text has a zero vector (a fixed value).
CONSTANT = 0.1


def hashed_vector(text: str | None, dims: int) -> np.ndarray:
    """Signed counts of the distinct words' hash buckets, of length one. Null counts as empty."""
    vector = np.zeros(dims)
    for word in set(_WORD.findall((text or "").lower())):
        value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        vector[value % (dims - 1)] += -1.0 if value >> 63 else 1.0
    vector[-1] = CONSTANT
    return vector / np.linalg.norm(vector)


def hash_embedder(dims: int = 768):
    """A function of a text column that gives array<float>; dims 8 or more."""
    if dims < 8:
        raise ValueError("at least 8 dimensions")

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed_vector(t, dims).astype(np.float32))

    return embed


def sentence_embedder(model_name: str):
    """A sentence-transformers model, loaded once a worker; the library is optional."""

    @F.pandas_udf("array<float>")
    def embed(batches):  # an iterator, so that a worker loads the model once
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(model_name)
        for texts in batches:
            yield pd.Series(list(model.encode(texts.fillna("").tolist(), normalize_embeddings=True)))

    return embed


EMBEDDERS = {"hashing": hash_embedder, "sentence": sentence_embedder}


def checked(vector: Column, dims: int) -> Column:
    """The vector, or an error if it has another size: a wrong-sized vector is refused, not stored."""
    return F.when(vector.isNull() | (F.size(vector) == dims), vector).otherwise(F.raise_error(F.lit(f"a vector must have {dims} dimensions")))
