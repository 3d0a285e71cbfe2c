"""Codes that differ by one wrong character or by two neighbours in each other's place, and the images that codes miss.

Two codes of one length are near if they agree once one place is masked, or once two different neighbours are put in
order. So each code gives a mask for each place and for each such pair of neighbours, and near codes meet by an equal
mask: no two codes are compared that don't agree elsewhere. A near pair shares exactly one mask, so none comes twice.
Codes are made distinct first; then a mask is shared by at most as many codes as there are characters, so no mask is hot
however often a code comes. Codes of different lengths are never near, as a code's length is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masks(code: Column) -> Column:
    """The code's masks: place, a mark for its kind, and the rest of the code. None for an empty or null code."""
    n = F.length(code)
    part = lambda start, length=None: F.substring(code, start, length if length is not None else n)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(i.cast("string"), F.lit(":"), part(F.lit(1), i - 1), F.lit("\0"), part(i + 1)))
    places = F.when(n > 1, F.filter(F.sequence(F.lit(1), n - 1), lambda i: part(i, F.lit(1)) != part(i + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    both = lambda i: F.concat(F.least(part(i, F.lit(1)), part(i + 1, F.lit(1))), F.greatest(part(i, F.lit(1)), part(i + 1, F.lit(1))))
    turned = F.transform(places, lambda i: F.concat(i.cast("string"), F.lit("~"), part(F.lit(1), i - 1), both(i), part(i + 2)))
    return F.when(n > 0, F.concat(one, turned)).otherwise(F.array().cast("array<string>"))


def near_keys(wanted: DataFrame, present: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Pairs of a wanted code (`key` of wanted) and a near one that is there (`other` of present): key, near, place, turned."""
    left = wanted.select(F.col(key).alias("_a")).distinct().select("_a", F.explode(masks(F.col("_a"))).alias("_mask"))
    right = present.select(F.col(other or key).alias("_b")).distinct().select("_b", F.explode(masks(F.col("_b"))).alias("_mask"))
    pairs = left.join(right, "_mask").where(F.col("_a") != F.col("_b"))
    place = F.regexp_extract("_mask", r"(?s)^(\d+)[:~]", 1).cast("int")
    return pairs.select(F.col("_a").alias(key), F.col("_b").alias("near"), place.alias("place"), F.substring(F.col("_mask"), F.length(place.cast("string")) + 1, F.lit(1)).eqNullSafe("~").alias("turned"))


#: How an image was found, from the strictest on.
LAYERS = ["file name", "folder name", "case", "signs or wide letters", "digits only", "one character off"]


def _plain(name: Column) -> Column:
    """Upper case, wide letters and digits as narrow ones, without anything else."""
    narrow = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    wide = "".join(chr(ord(c) + 0xFEE0) for c in narrow)
    return F.regexp_replace(F.upper(F.translate(name, wide, narrow)), "[^A-Z0-9]", "")


def image_keys(images: DataFrame, prefix: str = "KA", digits: int = 7) -> DataFrame:
    """layer, key, path (the smallest) and n_paths of every key under which an image's path can be asked for. images: path."""
    code = f"{prefix}\\d{{{digits}}}"
    name, folders = F.regexp_extract("path", r"([^/\\]*)$", 1), F.regexp_extract("path", r"^(.*)[/\\][^/\\]*$", 1)
    every = lambda text, pattern=code: F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    strict = F.slice(every(name), 1, 1)
    deepest = F.when(F.size(strict) == 0, F.slice(F.reverse(every(folders)), 1, 1)).otherwise(F.array().cast("array<string>"))
    runs = F.filter(F.regexp_extract_all(_plain(name), F.lit(r"(\d+)"), F.lit(1)), lambda d: F.length(d) == digits)
    found = [strict, deepest, every(F.upper(name)), every(_plain(name)), runs]
    of_layer = lambda n: lambda k: F.struct(F.lit(n).alias("layer"), k.alias("key"))
    pairs = F.concat(*[F.transform(keys, of_layer(n)) for n, keys in enumerate(found)])
    rows = images.where("path is not null").select("path", F.explode(F.array_distinct(pairs)).alias("_k"))
    return rows.groupBy(F.col("_k.layer").alias("layer"), F.col("_k.key").alias("key")).agg(F.min("path").alias("path"), F.countDistinct("path").alias("n_paths"))


def match_images(items: DataFrame, images: DataFrame, prefix: str = "KA", digits: int = 7) -> DataFrame:
    """sku, found (the first of LAYERS that finds an image, or `no image`), path and n_paths of each distinct sku of items.

    One character off counts only for images of no sku of the items, as an image that belongs to another isn't mistyped.
    Keys of images are counted before they meet a sku, so a folder of many files is one row; a null sku is left out."""
    keys = image_keys(images, prefix, digits)
    skus = items.where("sku is not null").select("sku").distinct()
    number = F.nullif(F.regexp_extract(F.upper("sku"), f"(\\d{{{digits}}})", 1), F.lit(""))
    asked = F.array(*[F.struct(F.lit(n).alias("layer"), (number if n == 4 else F.upper("sku")).alias("key")) for n in range(5)])
    direct = skus.select("sku", F.explode(asked).alias("_k")).select("sku", "_k.*").join(keys, ["layer", "key"])
    best = direct.groupBy("sku").agg(F.min_by(F.struct("layer", "path", "n_paths"), "layer").alias("_b"))
    numbers = skus.select("sku", number.alias("_number"))
    rest = numbers.join(best.select("sku"), "sku", "left_anti")
    orphans = keys.where("layer = 4").select(F.col("key").alias("near"), "path", "n_paths").join(numbers.select(F.col("_number").alias("near")), "near", "left_anti")
    near = near_keys(rest.where("_number is not null"), orphans, "_number", "near").join(orphans, "near")
    near = rest.join(near, "_number").groupBy("sku").agg(F.min_by(F.struct(F.lit(5).alias("layer"), "path", "n_paths"), F.struct("path", "near")).alias("_b"))
    found = skus.join(best.unionByName(near), "sku", "left")
    name = F.coalesce(F.get(F.array(*map(F.lit, LAYERS)), F.col("_b.layer")), F.lit("no image"))
    return found.select("sku", name.alias("found"), "_b.path", F.coalesce("_b.n_paths", F.lit(0).cast("long")).alias("n_paths"))
