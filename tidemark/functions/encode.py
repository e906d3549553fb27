"""Encoders: the deterministic lexical one, and a hook for any embedder object."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed as K


def _code(data: str) -> int:
    return int.from_bytes(hashlib.md5(data.encode()).digest()[:4], "little")


class LexicalEncoder:
    """Unit vectors from the words and character trigrams of a text: equal wording gives equal vectors.

    A word adds a sine wave whose frequency its hash picks, damped by the word's place; a trigram adds
    a fixed weight at the place its hash picks.
    """

    def __init__(self, dim: int = K.ENCODER_WIDTH):
        self.dim = dim
        self._waves: dict[int, np.ndarray] = {}
        self._places: dict[str, int] = {}

    def _wave(self, word: str) -> np.ndarray:
        step = _code(word) % 1000 + 1
        if step not in self._waves:
            self._waves[step] = np.sin(np.arange(self.dim) * step * 0.01)
        return self._waves[step]

    def _place(self, trigram: str) -> int:
        found = self._places.get(trigram)
        if found is None:
            found = _code(trigram) % self.dim
            if len(self._places) < 200_000:
                self._places[trigram] = found
        return found

    def embed(self, text) -> np.ndarray:
        low = str(text or "").lower().strip()
        out = np.zeros(self.dim, np.float32)
        for at, word in enumerate(low.split()):
            out += self._wave(word) * (1.0 / (1.0 + 0.05 * at))
        np.add.at(out, [self._place(low[k : k + 3]) for k in range(len(low) - 2)], np.float32(K.TRIGRAM_WEIGHT))
        return out / (np.linalg.norm(out) + 1e-8)

    def embed_batch(self, texts) -> np.ndarray:
        return np.stack([self.embed(t) for t in texts]) if len(texts) else np.zeros((0, self.dim), np.float32)


def embed_column(text: Column, embedder=None) -> Column:
    """Vectors of a text column by any object with ``embed_batch(texts) -> rows``, in Arrow batches."""
    held = embedder or LexicalEncoder()

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(held.embed_batch(list(texts)), np.float32)), index=texts.index)

    return embed(text)
