"""Images inside office files, found by their bytes."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BYTES, LEAST_SIDE = 2048, 64


def _png(data: bytes, at: int) -> int:
    """Where the PNG that begins at `at` ends, by its chunks; 0 if it isn't whole."""
    at += 8
    while at + 12 <= len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        kind = data[at + 4 : at + 8]
        at += 12 + size
        if kind == b"IEND":
            return at if at <= len(data) else 0
    return 0


def _jpeg(data: bytes, at: int) -> int:
    end = data.find(b"\xff\xd9", at)
    return end + 2 if end >= 0 else 0


def side_lengths(image: bytes) -> tuple[int, int]:
    """Width and height from the header, 0 if unknown."""
    if image.startswith(b"\x89PNG\r\n\x1a\n") and len(image) >= 24:
        return struct.unpack(">II", image[16:24])
    at = 2
    while image.startswith(b"\xff\xd8") and at + 9 < len(image) and image[at] == 0xFF:
        if image[at + 1] in (0xC0, 0xC1, 0xC2):
            height, width = struct.unpack(">HH", image[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", image[at + 2 : at + 4])[0]
    return 0, 0


def images_in(data: bytes) -> list[bytes]:
    """Media entries of a zipped office file, or the images carved from another one; small ones and repeats left out."""
    found = []
    if data.startswith(b"PK\x03\x04"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                found = [z.read(n) for n in sorted(z.namelist()) if "/media/" in f"/{n}"]
        except zipfile.BadZipFile:
            return []
    else:
        for mark, end_of in ((b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8\xff", _jpeg)):
            at = data.find(mark)
            while at >= 0:
                end = end_of(data, at)
                if end:
                    found.append(data[at:end])
                at = data.find(mark, end or at + 1)
    out: dict[str, bytes] = {}
    for image in found:
        if len(image) >= LEAST_BYTES and (min(side_lengths(image)) >= LEAST_SIDE or side_lengths(image) == (0, 0)):
            out.setdefault(hashlib.sha1(image).hexdigest(), image)
    return list(out.values())


def embedded_images(files: DataFrame) -> DataFrame:
    """path, sha1, width, height, image of the images in files (path, content)."""

    def work(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = [(path, hashlib.sha1(x).hexdigest(), *side_lengths(x), x) for x in images_in(bytes(content or b""))]
                yield pd.DataFrame(rows, columns=["path", "sha1", "width", "height", "image"])

    return files.select("path", "content").mapInPandas(work, "path string, sha1 string, width int, height int, image binary")


#: Fixed: kinds of images and the bounds of their statistics, the first that holds. Bounds: a statistic, and the least and the most that it may be (None: any); `upright` stands for the least height by width of a garment.
KINDS: list[tuple[str, list[tuple[str, float | str | None, float | None]]]] = [
    ("stamp", [("ncolor", None, 24), ("white", 0.55, None)]),
    ("line art", [("white", 0.62, None), ("sat", None, 22)]),
    ("line art", [("white", 0.45, None), ("aspect", None, 1.0)]),
    ("sample photo", [("longest", 400, None), ("aspect", "upright", None), ("fill", 0.12, 0.94), ("sat", 18, None)]),
]
#: Fixed: a picture with a background has a border of one colour, and that without much spread.
BACKGROUND = [("edge_bg", 0.70, None), ("ring_sd", None, 20)]
#: Fixed: these upper bounds are themselves outside.
_OPEN = {("sat", 22), ("aspect", 1.0)}


def kind_of_image(strict_photo: bool = True) -> Column:
    """Kind by statistics (columns edge_bg, ring_sd, ncolor, white, sat, aspect, fill, longest) of an image: fabric without a background, else the first of KINDS, else other; null without statistics. strict_photo: a garment must be upright, else it may be a little wider."""
    upright = 1.05 if strict_photo else 0.85

    def within(bounds: list) -> Column:
        held = F.lit(True)
        for name, least, most in bounds:
            if least is not None:
                held &= F.col(name) >= F.lit(upright if least == "upright" else least)
            if most is not None:
                held &= (F.col(name) < F.lit(most)) if (name, most) in _OPEN else (F.col(name) <= F.lit(most))
        return held

    out = F.when(F.col("edge_bg").isNull(), F.lit(None)).when(~within(BACKGROUND), "fabric")
    for label, bounds in KINDS:
        out = out.when(within(bounds), label)
    return out.otherwise("other")


def suffix_patterns(files: DataFrame, top: int = 30) -> DataFrame:
    """What follows the sku in file names, digits as #: how often, how many distinct, and the share that could be a colour code."""
    suffix = F.regexp_extract("name", r"KA\d{7}([^.]*)", 1)
    rows = files.where(F.col("name").rlike(r"KA\d{7}")).select(suffix.alias("suffix"), F.regexp_replace(suffix, r"\d", "#").alias("pattern"))
    two = F.regexp_extract("suffix", r"(?:^|\D)(\d{2})(?:\D|$)", 1).try_cast("int")
    out = rows.groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("suffix").alias("n_distinct"), F.bround(F.avg(F.coalesce(two.between(10, 92), F.lit(False)).cast("double")), 6).alias("could_be_colour"))
    return out.orderBy(F.desc("n"), "pattern").limit(top)


def freshness(files: DataFrame, now: str, stale_days: int = 30) -> DataFrame:
    """Age in days of each file, and whether it is stale."""
    age = F.datediff(F.lit(now).cast("date"), F.col("modified").cast("date"))
    return files.select("path", "length", age.alias("age_days"), (age > stale_days).alias("stale"))
