"""Images in office files, titles, tags and plans."""

import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from selvage.operators import lift, names, retrieval
from selvage.sources import carve


def png(width, height, seed):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    noise = b"".join(b"\0" + bytes((seed * 31 + y * 7 + x * x) % 256 for x in range(3 * width)) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(noise, 0)) + chunk(b"IEND", b"")


def test_images_in_files(spark):
    big, other, small = png(80, 90, 1), png(70, 70, 2), png(8, 8, 3)
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("xl/media/a.png", big)
        z.writestr("xl/media/b.png", big)
        z.writestr("xl/media/c.png", small)
        z.writestr("xl/sheet.xml", b"x" * 5000)
    rows = [("x.xlsx", box.getvalue()), ("y.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"junk" + other + b"\0\0" + big + small + b"\x89PNG\r\n\x1a\ncut"), ("z", None), ("bad.zip", b"PK\x03\x04broken")]
    out = carve.embedded_images(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {(r["path"], r["width"], r["height"]) for r in out} == {("x.xlsx", 80, 90), ("y.xls", 70, 70), ("y.xls", 80, 90)} and len(out) == 3
    assert all(bytes(r["image"]) in (big, other) for r in out)


def test_kinds_and_patterns(spark):
    stats = [(0.1, 5.0, 99, 0.1, 50.0, 1.2, 0.5, 900, "fabric"), (0.9, 5.0, 3, 0.8, 90.0, 1.0, 0.2, 400, "stamp"), (0.9, 5.0, 50, 0.9, 3.0, 1.5, 0.2, 900, "line art"), (0.9, 5.0, 99, 0.5, 60.0, 0.7, 0.2, 900, "line art"), (0.9, 5.0, 99, 0.3, 60.0, 1.4, 0.5, 900, "sample photo"), (0.9, 5.0, 99, 0.3, 60.0, 1.4, 0.5, 100, "other"), (0.9, 21.0, 99, 0.3, 60.0, 1.4, 0.5, 900, "fabric"), (0.9, 20.0, 24, 0.55, 60.0, 1.4, 0.5, 900, "stamp"), (0.9, 5.0, 99, 0.62, 22.0, 1.2, 0.5, 900, "sample photo"), (0.9, 5.0, 99, 0.3, 60.0, 0.9, 0.5, 900, "other")]
    df = spark.createDataFrame(stats, "edge_bg double, ring_sd double, ncolor int, white double, sat double, aspect double, fill double, longest int, kind string")
    assert all(r["kind"] == r["k"] for r in df.select("kind", carve.kind_of_image().alias("k")).collect())
    assert [r[0] for r in df.where("aspect = 0.9").select(carve.kind_of_image(strict_photo=False)).collect()] == ["sample photo"]
    files = spark.createDataFrame([("KA1583008-42.jpg",), ("KA1583009-43.jpg",), ("KA1583009_back.jpg",), ("other.jpg",)], "name string")
    assert [tuple(r) for r in carve.suffix_patterns(files).collect()] == [("-##", 2, 2, 1.0), ("_back", 1, 1, 0.0)]
    listed = spark.createDataFrame([("p", 3, "2026-01-01"), ("q", 3, "2026-02-27")], "path string, length int, d string").withColumn("modified", F.to_timestamp("d"))
    assert {r["path"]: (r["age_days"], r["stale"]) for r in carve.freshness(listed, "2026-03-01").collect()} == {"p": (59, True), "q": (2, False)}


def test_titles_and_hex(spark):
    df = spark.createDataFrame([("【SALE】蝴蝶結抓皺網紗袖 上衣 $1,200 123 (紫藕)",), ("plain thing",), ("",)], "t string")
    parts = names.title_parts(F.col("t"), ["蝴蝶結", "網紗", "袖", "上衣", "抓皺"], ["sale"])
    got = df.select(parts.alias("p")).collect()
    assert [(r["p"]["terms"], r["p"]["colour"]) for r in got] == [(["蝴蝶結", "抓皺", "網紗", "袖", "上衣"], "紫藕"), (["plain", "thing"], None), ([], None)]
    codes = spark.createDataFrame([("use #a1B2c3 now",), ("1234567",), ("x 00ff00",)], "t string").select(names.hex_in(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in codes] == ["A1B2C3", None, "00FF00"]


def test_candidates_and_tags(spark):
    df = spark.createDataFrame([(str(n), "a" if n % 2 else "b", None if n else "x", n, f"v{n}") for n in range(100)], "sku string, colour string, rare string, number int, many string")
    assert lift.candidate_features(df, ["sku"]) == ["colour"]
    scores = spark.createDataFrame([(1, "neck", "v", 0.9), (1, "neck", "round", 0.1), (1, "heel", "flat", 0.9), (1, "heel", "high", 0.89)], "query long, attribute string, option string, similarity double")
    out = retrieval.tag_rows(scores, spark.createDataFrame([("TOP", "neck")], "category string, attribute string"), spark.createDataFrame([(1, "TOP")], "query long, category string"))
    assert {r["attribute"]: r["tag"] for r in out.collect()} == {"neck": "v", "heel": "n/a"}
    ranked = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "sku string, score double")
    assert {r["sku"] for r in retrieval.shortlist(ranked, 2).collect()} == {"a", "b", "c"} and retrieval.shortlist(ranked.where("false"), 2).count() == 0


def test_a_cascade_takes_every_tie(spark):
    """More ties with the shortlist's last than 50 times its length; the nearest is the last of them by key."""
    rows = [(n, "red ring", [1.0, 0.001 * (1200 - n)]) for n in range(1200)] + [(5000 + n, "box", [1.0, 0.0]) for n in range(300)]
    items = spark.createDataFrame(rows, "sku long, product_name string, embedding array<double>")
    got = retrieval.cascade(items, {"ring": 1.0, "red": 0.8}, [1.0, 0.0], n=10, top=3).collect()
    assert [(r["rank"], r["sku"]) for r in got] == [(1, 1199), (2, 1198), (3, 1197)]
