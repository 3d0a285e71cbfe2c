"""Geometric agreement of two pictures' points: a ratio test on descriptors, then consensus on one homography.

Points of a picture are an array of structs (x, y, code), bounded by the detector. The ratio test is columns; the consensus
is numpy over one pair's matches at a time, in Arrow batches that Spark deals out. Its random choices come from the pair's
ids alone, so a pair has the same result in every run and on every machine.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .hamming import hamming

#: Fixed: the share of the second distance that the first must be under (78 of 100), the tolerance in pixels, the fewest matches, and the fewest points of a picture.
RATIO, TOLERANCE, LEAST, LEAST_POINTS = 78, 3.0, 4, 6


def good_matches(a: Column, b: Column, words: int, ratio: int = RATIO) -> Column:
    """Points of a whose nearest point of b is nearer than `ratio` hundredths of the second one's distance: array of structs (x, y, to_x, to_y). None unless both have LEAST_POINTS."""

    def match(p: Column) -> Column:
        # the two least of (distance, place), so that a tie keeps the first; one point more than a's own is never held
        ordered = F.array_sort(F.transform(b, lambda q, n: F.struct(hamming(p["code"], q["code"], words).alias("d"), n.alias("n"))))
        one, two = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
        to = F.get(b, one["n"])
        return F.when(one["d"] * 100 < two["d"] * ratio, F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"), to["x"].cast("double").alias("to_x"), to["y"].cast("double").alias("to_y")))

    found = F.filter(F.transform(a, match), lambda m: m.isNotNull())
    return F.when((F.size(a) >= LEAST_POINTS) & (F.size(b) >= LEAST_POINTS), found).otherwise(F.array().cast("array<struct<x:double,y:double,to_x:double,to_y:double>>"))


def _fitted(matches: np.ndarray) -> np.ndarray:
    """Homographies (n, 3, 3) through n sets (n, m, 4) of m >= 4 matches, by least squares where m > 4; of sets without one the matrix is nan."""
    x, y, u, v = np.moveaxis(matches, -1, 0)
    zero, one = np.zeros_like(x), np.ones_like(x)
    left = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], 1)
    right = np.concatenate([u, v], 1)[..., None]
    square, side = (left, right) if left.shape[1] == 8 else (np.swapaxes(left, 1, 2) @ left, np.swapaxes(left, 1, 2) @ right)
    # what is solved is what the determinant is of: one that has a zero pivot has the determinant 0
    scale = np.abs(square).max((1, 2), keepdims=True)
    scale[scale == 0] = 1
    square, side = square / scale, side / scale
    sound = np.abs(np.linalg.det(square)) > 1e-18
    out = np.full((len(matches), 9), np.nan)
    if sound.any():
        out[sound, :8] = np.linalg.solve(square[sound], side[sound])[..., 0]
        out[sound, 8] = 1
    return out.reshape(-1, 3, 3)


def _agree(homographies: np.ndarray, matches: np.ndarray, tolerance: float) -> np.ndarray:
    """Which matches (columns) each homography (rows) maps to within the tolerance."""
    points = np.concatenate([matches[:, :2], np.ones((len(matches), 1))], 1)
    with np.errstate(all="ignore"):
        to = points @ np.swapaxes(homographies, 1, 2)
        gap = to[..., :2] / to[..., 2:] - matches[:, 2:]
        return (gap * gap).sum(-1) <= tolerance * tolerance


def consensus(matches: np.ndarray, seed: int, tolerance: float = TOLERANCE, tries: int = 500, block: int = 1 << 20) -> int:
    """The most matches (n, 4: x, y, to_x, to_y) that one homography agrees with: the best of `tries` through four matches each (of all, where there are no more), fitted anew to those that agree. 0 for fewer than four."""
    n = len(matches)
    spread = (float(matches[:, :2].std()), float(matches[:, 2:].std())) if n >= LEAST else (0.0, 0.0)
    if not min(spread) > 0:
        return 0
    # both sides about 0 and of spread 1, where the equations are well conditioned
    matches = np.concatenate([(matches[:, side] - matches[:, side].mean(0)) / s for side, s in zip((slice(0, 2), slice(2, 4)), spread)], 1)
    tolerance /= spread[1]
    if comb(n, 4) <= tries:
        chosen = np.array(list(combinations(range(n), 4)))
    else:
        chosen = np.argsort(np.random.default_rng(seed & ((1 << 63) - 1)).random((tries, n)), axis=1)[:, :4] if n <= 2000 else np.random.default_rng(seed & ((1 << 63) - 1)).integers(0, n, (tries, 4))
    most, held = 0, None
    step = max(1, block // n)
    for at in range(0, len(chosen), step):
        agree = _agree(_fitted(matches[chosen[at : at + step]]), matches, tolerance)
        counts = agree.sum(1)
        if counts.max() > most:
            most, held = int(counts.max()), agree[int(counts.argmax())]
    while held is not None and most > LEAST:
        agree = _agree(_fitted(matches[held][None]), matches, tolerance)[0]
        if agree.sum() <= most:
            break
        most, held = int(agree.sum()), agree
    return most


def inliers(matches: Column, seed: Column, tolerance: float = TOLERANCE) -> Column:
    """consensus() of each row's matches; null matches have none."""

    @F.pandas_udf(LongType())
    def count(matches: pd.Series, seed: pd.Series) -> pd.Series:
        told = (None if own is None else np.array([[m[c] for c in ("x", "y", "to_x", "to_y")] for m in own], float).reshape(-1, 4) for own in matches)
        return pd.Series([0 if m is None else consensus(m, int(s), tolerance) for m, s in zip(told, seed)], dtype="int64")

    return count(matches, seed)


def geometric_rerank(pairs: DataFrame, points: DataFrame, words: int, ratio: int = RATIO, tolerance: float = TOLERANCE) -> DataFrame:
    """pairs (query, id) with n_good and n_inliers of their points. points: id, points. A picture without points has none."""
    a, b = points.select(F.col("id").alias("query"), F.col("points").alias("_a")), points.select("id", F.col("points").alias("_b"))
    rows = pairs.join(a, "query", "left").join(b, "id", "left").withColumn("_m", good_matches(F.col("_a"), F.col("_b"), words, ratio))
    n = F.coalesce(F.size("_m"), F.lit(0)).cast("long")
    return rows.select(*pairs.columns, F.when(n > 0, n).otherwise(F.lit(0)).cast("long").alias("n_good"), inliers(F.col("_m"), F.xxhash64("query", "id"), tolerance).alias("n_inliers"))
