"""Colour: hexadecimal to LAB and back, CIEDE2000, families, and the nearest code of a palette."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvage.functions.columns import let

#: Fixed: the D65 white point, and the matrices between linear sRGB and XYZ.
_WHITE = (0.95047, 1.0, 1.08883)
_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))


def _dot(row: tuple[float, float, float], values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(k) * v for k, v in zip(row, values)])


def lab_of_hex(hex_: Column) -> tuple[Column, Column, Column]:
    """L, a, b of "#RRGGBB" or "RRGGBB"; null if it isn't one."""
    text = F.regexp_extract(F.upper(hex_), "^#?([0-9A-F]{6})$", 1)
    text = F.when(text != "", text)
    linear = []
    for n in range(3):
        c = F.conv(F.substring(text, 1 + 2 * n, 2), 16, 10).cast("double") / 255
        linear.append(F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4)))
    f = []
    for row, white in zip(_TO_XYZ, _WHITE):
        t = _dot(row, linear) / white
        f.append(F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def hex_of_lab(lightness: Column, a: Column, b: Column) -> Column:
    """"#RRGGBB", clipped to what can be shown; null for null."""
    fy = (lightness + 16) / 116
    xyz = []
    for f, white in zip((fy + a / 500, fy, fy - b / 200), _WHITE):
        cube = F.pow(f, 3)
        xyz.append(F.when(cube > 216 / 24389, cube).otherwise((116 * f - 16) / (24389 / 27)) * white)
    out = []
    for row in _TO_RGB:
        c = F.greatest(F.least(_dot(row, xyz), F.lit(1.0)), F.lit(0.0))
        c = F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, 1 / 2.4) - 0.055)
        out.append(F.lpad(F.hex(F.round(c * 255).cast("long")), 2, "0"))
    return F.when(lightness.isNotNull(), F.concat(F.lit("#"), *out))


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def _hue(b: Column, a: Column) -> Column:
    h = F.degrees(F.atan2(b, a))
    return F.when((a == 0) & (b == 0), 0.0).when(h < 0, h + 360).otherwise(h)


def delta_e_2000(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    """CIEDE2000 with all weights 1."""
    (l1, a1, b1), (l2, a2, b2) = one, two

    def stretched(v: Column) -> Column:
        g = 1 + 0.5 * (1 - F.sqrt(v["c7"] / (v["c7"] + 25.0**7)))
        return let(polar, a1=a1 * g, a2=a2 * g)

    def polar(v: Column) -> Column:
        return let(differences, c1=chroma(v["a1"], b1), c2=chroma(v["a2"], b2), h1=_hue(b1, v["a1"]), h2=_hue(b2, v["a2"]))

    def differences(v: Column) -> Column:
        c1, c2, h1, h2 = v["c1"], v["c2"], v["h1"], v["h2"]
        grey, gap, total = c1 * c2 == 0, h2 - h1, h1 + h2
        turn = F.when(grey, 0.0).when(gap > 180, gap - 360).when(gap < -180, gap + 360).otherwise(gap)
        mean_h = F.when(grey, total).when(F.abs(gap) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
        return let(weighted, d_c=c2 - c1, d_h=2 * F.sqrt(c1 * c2) * F.sin(F.radians(turn / 2)), c=(c1 + c2) / 2, h=mean_h, low=F.pow((l1 + l2) / 2 - 50, 2))

    def weighted(v: Column) -> Column:
        cos = lambda k, off: F.cos(F.radians(k * v["h"] + off))
        t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)
        c7 = F.pow(v["c"], 7)
        turn = -2 * F.sqrt(c7 / (c7 + 25.0**7)) * F.sin(F.radians(60 * F.exp(-F.pow((v["h"] - 275) / 25, 2))))
        return let(distance, l=(l2 - l1) / (1 + 0.015 * v["low"] / F.sqrt(20 + v["low"])), c=v["d_c"] / (1 + 0.045 * v["c"]), h=v["d_h"] / (1 + 0.015 * v["c"] * t), r=turn)

    def distance(v: Column) -> Column:
        return F.sqrt(v["l"] * v["l"] + v["c"] * v["c"] + v["h"] * v["h"] + v["r"] * v["c"] * v["h"])

    return let(stretched, c7=F.pow((chroma(a1, b1) + chroma(a2, b2)) / 2, 7))


def delta_verdict(de: Column) -> Column:
    return F.when(de < 1, "same").when(de < 2, "very close").when(de < 3.5, "close").when(de < 5, "visible").otherwise("different")


def family_of(lightness: Column, a: Column, b: Column) -> Column:
    """Black, grey or white below a chroma of 12; else a name by hue."""
    h = _hue(b, a)
    tinted = F.when((h < 20) | (h >= 340), "pink red").when(h < 50, "red orange").when(h < 75, "orange").when(h < 105, "yellow").when(h < 170, "green").when(h < 225, "teal").when(h < 290, "blue").otherwise("purple")
    brown = (h >= 30) & (h < 90) & (lightness < 50)
    return F.when(chroma(a, b) < 12, F.when(lightness < 25, "black").when(lightness < 75, "grey").otherwise("white")).when(brown, "brown").otherwise(tinted)


def nearest_codes(colours: DataFrame, palette: list[tuple[str, float, float, float]], key: str, top: int = 3) -> DataFrame:
    """The `top` palette entries of each colour (columns L, a, b) by CIEDE2000. The palette is a fixed list, worked on within the row."""
    lab = (F.col("L"), F.col("a"), F.col("b"))
    entries = F.array(*[F.struct(F.lit(code).alias("code"), *[F.lit(float(v)).alias(n) for n, v in zip("xyz", own)]) for code, *own in palette])
    scored = F.transform(entries, lambda p: F.struct(F.bround(delta_e_2000(lab, (p["x"], p["y"], p["z"])), 4).alias("delta_e"), p["code"].alias("code")))
    out = colours.select(key, F.posexplode(F.slice(F.array_sort(scored), 1, top)).alias("place", "m"))
    return out.select(key, (F.col("place") + 1).cast("long").alias("place"), "m.code", "m.delta_e", delta_verdict(F.col("m.delta_e")).alias("verdict"))


def tone_of(lightness: Column, a: Column, b: Column) -> Column:
    """How light and how strong a colour is."""
    strong = chroma(a, b)
    light = F.when(lightness >= 80, "pale").when(lightness >= 60, "light").when(lightness >= 35, "middle").otherwise("dark")
    return F.when(strong < 12, F.concat(light, F.lit(" neutral"))).when(strong < 35, F.concat(light, F.lit(" muted"))).otherwise(F.concat(light, F.lit(" vivid")))


def palette_coverage(codes: DataFrame, names: list[str], values: list[str]) -> DataFrame:
    """How far a table of codes is filled: codes, those with any of the names, those with all of the values, and the share of the named that have values."""
    named = F.greatest(*[F.coalesce(F.col(c) != "", F.lit(False)) for c in names], F.lit(False))
    filled = F.least(*[F.col(c).isNotNull() for c in values], F.lit(True))
    out = codes.agg(F.count("*").alias("n"), F.count_if(named).alias("n_named"), F.count_if(filled).alias("n_filled"))
    return out.withColumn("share", F.bround(F.col("n_filled") / F.greatest("n_named", F.lit(1)), 3))
