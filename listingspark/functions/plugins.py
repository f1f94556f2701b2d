"""Places where a user's own code joins in: text encoders, patterns with positions, fuzzy scores. All work on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def encoder(encode: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """A column function text -> array<double> from a function on lists of texts; null texts are empty."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def vectors(texts: pd.Series) -> pd.Series:
        made = np.asarray(encode(texts.fillna("").tolist()), float)
        return pd.Series(list(made), index=texts.index)

    return vectors


def letter_shares(letters: str) -> Callable[[list[str]], np.ndarray]:
    """An encoder by the shares of some letters in a text: the plainest one that depends on the text alone."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) / max(1, len(t)) for c in letters] for t in texts]).reshape(len(texts), len(letters))

    return encode


def matches(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, signal, match, start, end): every match of each pattern, with its place in characters. A text gives as many rows as it has matches."""
    compiled = {k: re.compile(p) for k, p in patterns.items()}
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, name, m[0], m.start(), m.end()) for k, t in zip(frame[key], frame[text].fillna(""), strict=True) for name, p in compiled.items() for m in p.finditer(t)]
            yield pd.DataFrame(rows, columns=[key, "signal", "match", "start", "end"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, signal string, match string, start int, end int")


def alike(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, in percent; 100 for two empty texts."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def set_ratio(a: str, b: str) -> float:
    """The best likeness of the sorted common words with or without each text's own words: 100 if one text's words are all in the other."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, (both, " ".join(sorted(own))))) for own in (x - y, y - x))
    return max(alike(one, two), *((alike(both, one), alike(both, two)) if both else (0.0,)))


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """For blocked pairs only: a pair costs the product of its lengths."""
    return pd.Series([set_ratio(x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], index=a.index)
