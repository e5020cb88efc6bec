"""Character functions over UTF-16 units, in Arrow batches: hashed n-gram profile and trigram repetition."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION = 128
_SPACES = re.compile(r"\s+")
_DIGITS = re.compile("[0-9]")


def units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.uint64)


def _counts(u: np.ndarray, at: np.ndarray, dimension: int) -> np.ndarray:
    """Signed counts of hashed 3- to 5-grams of the units between the offsets ``at`` (texts x dimension)."""
    n = len(at) - 1
    owner, out = np.repeat(np.arange(n), np.diff(at)), np.zeros(n * dimension)
    h = np.full(len(u), 2166136261, dtype=np.uint32)
    for size in range(1, 6):  # a hash of k units is that of its first k - 1, carried on
        if len(u) < size:
            break
        h = (h[: len(u) - size + 1] ^ u[size - 1 :]) * np.uint32(16777619)
        if size >= 3:
            whole = owner[: len(h)] == owner[size - 1 :]
            g = h[whole]
            sign = np.where(g & np.uint32(0x40000000), -1.0, 1.0)
            out += np.bincount(owner[: len(h)][whole] * dimension + g % np.uint32(dimension), sign, n * dimension)
    return out.reshape(n, dimension)


def profiles(u: np.ndarray, at: np.ndarray, dimension: int = DIMENSION) -> np.ndarray:
    """Profiles of length 1 of texts given by their units (lower case, digits as 0, collapsed space)."""
    v = _counts(u, at, dimension)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=v, where=norm > 0)


def _units_of(text: str) -> np.ndarray:
    text = text.replace("‘", "'").replace("’", "'").lower()
    return units(_SPACES.sub(" ", _DIGITS.sub("0", text)).strip()).astype(np.uint32)


def profile_counts(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """Signed counts of hashed 3- to 5-grams of lower-case text with digits as 0 and collapsed space."""
    u = _units_of(text)
    return _counts(u, np.array([0, len(u)]), dimension)[0]


def profile(text: str, dimension: int = DIMENSION) -> np.ndarray:
    u = _units_of(text)
    return profiles(u, np.array([0, len(u)]), dimension)[0]


def trigrams(text: str) -> tuple[int, int]:
    """(all, distinct) unit trigrams of lower-case collapsed text."""
    u = units(_SPACES.sub(" ", text.lower()))
    if len(u) < 3:
        return 0, 0
    key = (u[:-2] << np.uint64(32)) | (u[1:-1] << np.uint64(16)) | u[2:]
    return len(key), len(np.unique(key))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def char_profile(text: pd.Series) -> pd.Series:
    return text.map(lambda t: profile(t or ""))


@F.pandas_udf(T.StructType([T.StructField("total", T.LongType()), T.StructField("different", T.LongType())]))
def char_trigrams(text: pd.Series) -> pd.DataFrame:
    pairs = [trigrams(t or "") for t in text]
    return pd.DataFrame({"total": [a for a, _ in pairs], "different": [b for _, b in pairs]}, dtype="int64")
