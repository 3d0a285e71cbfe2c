"""A picture's few main colours: balanced light, then weighted k-means in LAB."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.functions.colour import _TO_XYZ, _WHITE

PALETTE = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("L", "a", "b", "w")]))

#: Fixed: how far a channel may be balanced, how many colours, how many rounds, and the share that a colour must have.
GAINS, COLOURS, ROUNDS, LEAST = (0.75, 1.33), 3, 12, 0.06


def balanced(rgb: np.ndarray) -> np.ndarray:
    """Grey-world balance of pixels (n, 3) of 0 to 255: each channel's mean becomes the mean of all, within GAINS, as a picture of one strong colour isn't grey."""
    mean = np.maximum(rgb.mean(0), 1.0)
    return np.clip(rgb * np.clip(mean.mean() / mean, *GAINS), 0, 255)


def lab_of(rgb: np.ndarray) -> np.ndarray:
    c = rgb / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ np.array(_TO_XYZ).T / np.array(_WHITE)
    f = np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], 1)


def palette_of(rgb: np.ndarray, colours: int = COLOURS, rounds: int = ROUNDS, least: float = LEAST, balance: bool = True) -> list[tuple[float, float, float, float]]:
    """L, a, b and share of the main colours, the largest share first.

    Equal pixels count once, with their number as weight. The first seed is the most frequent colour (of equals the first in
    order of red, green, blue), each next one the colour that is furthest from the seeds so far, so nothing is random. In a
    tie a colour belongs to the earlier centre, and a centre without colours stays. Fewer different colours than `colours`
    give as many centres; no pixels give none."""
    if not len(rgb):
        return []
    points, weight = np.unique(rgb, axis=0, return_counts=True)
    if balance:
        # the balance is that of all pixels; it maps equal pixels to equal ones
        mean = np.maximum((points * weight[:, None]).sum(0) / weight.sum(), 1.0)
        points = np.clip(points * np.clip(mean.mean() / mean, *GAINS), 0, 255)
    lab = lab_of(points.astype(float))
    seeds = [int(weight.argmax())]
    apart = ((lab - lab[seeds[0]]) ** 2).sum(1)
    while len(seeds) < colours and apart.max() > 0:
        seeds.append(int(apart.argmax()))
        apart = np.minimum(apart, ((lab - lab[seeds[-1]]) ** 2).sum(1))
    centres = lab[seeds].copy()
    nearest = lambda: ((lab[:, None] - centres) ** 2).sum(2).argmin(1)
    for _ in range(rounds):
        of = nearest()
        for c in range(len(centres)):
            own = of == c
            if own.any():
                centres[c] = (lab[own] * weight[own, None]).sum(0) / weight[own].sum()
    share = np.bincount(nearest(), weights=weight, minlength=len(centres)) / weight.sum()
    order = sorted(range(len(centres)), key=lambda c: (-share[c], c))
    return [(*centres[c].tolist(), float(share[c])) for c in order if share[c] >= least]


def palette(red: Column, green: Column, blue: Column, keep: Column | None = None, colours: int = COLOURS, rounds: int = ROUNDS, least: float = LEAST, balance: bool = True) -> Column:
    """palette_of() a raster's three channels (arrays of 0 to 255) as an array of structs L, a, b, w, which palette_distance takes. keep: an array of booleans, the pixels that count. Null channels, or ones of different lengths, give null."""

    @F.pandas_udf(PALETTE)
    def work(red: pd.Series, green: pd.Series, blue: pd.Series, keep: pd.Series) -> pd.Series:
        out = []
        for r, g, b, k in zip(red, green, blue, keep):
            if r is None or g is None or b is None or not len(r) == len(g) == len(b) or (k is not None and len(k) != len(r)):
                out.append(None)
                continue
            rgb = np.stack([np.asarray(c, float) for c in (r, g, b)], 1)
            if k is not None:
                rgb = rgb[np.asarray(k, bool)]
            out.append([dict(zip(("L", "a", "b", "w"), c)) for c in palette_of(rgb, colours, rounds, least, balance)])
        return pd.Series(out, dtype=object)

    return work(red, green, blue, keep if keep is not None else F.lit(None).cast("array<boolean>"))
