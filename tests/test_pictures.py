"""Mistyped codes, binary codes and geometry of pictures against brute force."""

import itertools
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from selvage.operators import beat, palettes, rasters, visual
from selvage.operators.hamming import index_of, load_index, nearest_codes, sign_code, write_index
from selvage.operators.inliers import consensus, geometric_rerank, good_matches
from selvage.operators.near_keys import LAYERS, masks, match_images, near_keys
from selvage.sources import carve


def one_off(a, b):
    """(place, turned) of codes that differ by one character or two neighbours, else None."""
    if len(a) != len(b):
        return None
    apart = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    if len(apart) == 1:
        return apart[0] + 1, False
    if len(apart) == 2 and apart[1] == apart[0] + 1 and a[apart[0]] == b[apart[1]] and a[apart[1]] == b[apart[0]]:
        return apart[0] + 1, True
    return None


def test_near_codes_are_all_pairs(spark):
    rng = random.Random(1)
    codes = ["".join(rng.choice("01A") for _ in range(rng.choice([1, 2, 5, 6]))) for _ in range(300)] + ["", None, "1:~", "1~:", "字a", "a字", "a\n", "b\n", "12:x", "12~x"]
    df = spark.createDataFrame([(c,) for c in codes * 3], "code string")  # every code comes often
    got = sorted((r["code"], r["near"], r["place"], r["turned"]) for r in near_keys(df, df, "code").collect())
    distinct = [c for c in set(codes) if c is not None]
    assert got == sorted((a, b, *one_off(a, b)) for a, b in itertools.product(distinct, distinct) if a != b and one_off(a, b))
    assert spark.range(1).select(F.size(masks(F.lit("aab")))).first()[0] == 4  # three places, one pair of different neighbours
    assert near_keys(df.where("false"), df, "code").collect() == []


def test_images_by_layers(spark):
    items = ["KA1550001", "KA1550002", "KA1550003", "KA1550004", "KA1550005", "KA1550006", "KA1550017", "KA1559999", "KA1550008", None, "KA1550001"]
    paths = [
        "x/KA1550001_front.jpg", "x/KA1550001_back.jpg", "y/KA1550002/front.jpg", "x/ka1550003.jpg", "x/ＫＡ－155 0004.jpg", "x/1550005_b.jpg",
        "x/KA1505006.jpg",  # turned: 1550006
        "x/KA1550001/KA1550008.jpg",  # the name counts before the folder
        "x/KA1550018.jpg",  # off by one from 1550017 and from 1550008, which has an image of its own
        "x/front.jpg", None,
    ]
    df = spark.createDataFrame([(s, 1) for s in items], "sku string, n int")
    got = {r["sku"]: (r["found"], r["path"], r["n_paths"]) for r in match_images(df, spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {
        "KA1550001": (LAYERS[0], "x/KA1550001_back.jpg", 2), "KA1550002": (LAYERS[1], "y/KA1550002/front.jpg", 1), "KA1550003": (LAYERS[2], "x/ka1550003.jpg", 1),
        "KA1550004": (LAYERS[3], "x/ＫＡ－155 0004.jpg", 1), "KA1550005": (LAYERS[4], "x/1550005_b.jpg", 1), "KA1550006": (LAYERS[5], "x/KA1505006.jpg", 1),
        "KA1550017": (LAYERS[5], "x/KA1550018.jpg", 1), "KA1559999": ("no image", None, 0), "KA1550008": (LAYERS[0], "x/KA1550001/KA1550008.jpg", 1),
    }


def codes_of(rng, n, words):
    base = [[rng.getrandbits(64) for _ in range(words)] for _ in range(n // 4)]
    out = []
    for _ in range(n):
        code = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 20])):
            code[rng.randrange(words)] ^= 1 << rng.randrange(64)
        out.append([c - (1 << 64) if c >> 63 else c for c in code])
    return out


@pytest.mark.parametrize("words, bits", [(1, 8), (4, 16), (2, 4)])
def test_nearest_codes_are_exact(spark, words, bits):
    rng = random.Random(words)
    codes = codes_of(rng, 120, words)
    codes += [codes[0]] * 40  # a group of copies
    rows = [(n, c) for n, c in enumerate(codes)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, code array<long>")
    asked = df.where("id % 25 = 0 or id = 130").select(F.col("id").alias("query"), "code")
    got = sorted(tuple(r) for r in nearest_codes(asked, df, 4, words, bits).collect())
    want = []
    for q in [n for n in range(len(codes)) if n % 25 == 0 or n == 130]:
        apart = sorted((sum(((a ^ b) & ((1 << 64) - 1)).bit_count() for a, b in zip(codes[q], c)), n) for n, c in enumerate(codes) if n != q)[:4]
        want += [(q, n, d, rank) for rank, (d, n) in enumerate(apart, 1)]
    assert got == sorted(want)


def test_kept_index(spark, tmp_path):
    df = spark.createDataFrame([(1, [5]), (2, [5]), (3, [-1]), (4, [4])], "id long, code array<long>")
    at = str(tmp_path / "index")
    write_index(index_of(df, 1), at, 1, 8, buckets=3)
    index = load_index(spark, at, 1, 8)
    assert index.count() == 24
    asked = df.where("id = 1").select(F.col("id").alias("query"), "code")
    assert [tuple(r) for r in nearest_codes(asked, df, 9, 1, 8, index).orderBy("rank").collect()] == [(1, 2, 0, 1), (1, 4, 1, 2), (1, 3, 62, 3)]
    with pytest.raises(ValueError, match="make it anew"):
        load_index(spark, at, 4, 8)
    with pytest.raises(ValueError):
        nearest_codes(asked, df, 1, 1, 32)
    assert spark.range(1).select(sign_code(F.array(F.lit(1.0), F.lit(-1.0), F.lit(None), F.lit(2.0)), 1)).first()[0] == [9]


def planted(rng, n, outliers):
    """n points under one homography and as many others that go anywhere."""
    h = np.array([[1.1, 0.2, 5], [-0.1, 0.9, 12], [0.0004, -0.0002, 1]])
    points = rng.uniform(0, 300, (n + outliers, 2))
    to = np.concatenate([points, np.ones((len(points), 1))], 1) @ h.T
    to = to[:, :2] / to[:, 2:]
    to[n:] = rng.uniform(0, 300, (outliers, 2))
    return np.concatenate([points, to], 1)


def test_planted_homographies_are_found():
    rng = np.random.default_rng(5)
    for seed in range(12):
        matches = planted(rng, 20, 20)
        assert 20 <= consensus(matches, seed) <= 23
        assert consensus(matches, seed) == consensus(matches.copy(), seed)
    assert consensus(rng.uniform(0, 300, (40, 4)), 1) < 12  # no geometry
    assert consensus(matches[:3], 1) == 0
    assert consensus(np.tile(matches[:1], (9, 1)), 1) == 0  # one match many times has no homography
    line = np.stack([np.arange(9.0), np.arange(9.0), np.arange(9.0), np.arange(9.0)], 1)
    assert consensus(line, 1) in (0, 9)  # points on a line
    for seed in range(60):  # points of a small grid, many of them in line or in one place
        grid = rng.integers(0, 8, (int(rng.integers(4, 14)), 4)).astype(float)
        assert 0 <= consensus(grid, seed) <= len(grid)


def test_rerank_by_geometry(spark):
    rng = np.random.default_rng(2)
    matches = planted(rng, 12, 12)
    codes = [int(c) for c in rng.integers(0, 1 << 62, 24)]
    a = [(float(x), float(y), [c]) for (x, y, _, _), c in zip(matches, codes)]
    b = [(float(x), float(y), [c ^ 1]) for (_, _, x, y), c in zip(matches, codes)]
    few = a[:5]
    points = spark.createDataFrame([(1, a), (2, b), (3, few), (4, []), (5, None)], "id long, points array<struct<x:double,y:double,code:array<long>>>")
    pairs = spark.createDataFrame([(1, n) for n in (2, 3, 4, 5, 6)] + [(2, 1)], "query long, id long")
    got = {(r["query"], r["id"]): (r["n_good"], r["n_inliers"]) for r in geometric_rerank(pairs, points, 1).collect()}
    assert got[1, 2][0] == 24 and 12 <= got[1, 2][1] <= 15 and 12 <= got[2, 1][1] <= 15
    assert got[1, 3] == got[1, 4] == got[1, 5] == got[1, 6] == (0, 0)
    tied = spark.range(1).select(good_matches(F.array(*[F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.array(F.lit(7).cast("long")).alias("code"))] * 6), F.array(*[F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.array(F.lit(7).cast("long")).alias("code"))] * 6), 1))
    assert tied.first()[0] == []  # two points as near as each other


def flooded(mask):
    """Parts of a mask by flooding."""
    rest, out = {(y, x) for y, x in zip(*np.nonzero(mask))}, []
    while rest:
        todo = [min(rest)]
        rest.discard(todo[0])
        own = []
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for near in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if near in rest:
                    rest.discard(near)
                    todo.append(near)
        ys, xs = [p[0] for p in own], [p[1] for p in own]
        out.append((len(own), min(ys), min(xs), max(ys), max(xs)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.randoms(use_true_random=False))
def test_parts_are_those_of_flooding(height, width, rng):
    mask = np.array([[rng.random() < 0.55 for _ in range(width)] for _ in range(height)])
    assert sorted(rasters.parts_of(mask)) == sorted(flooded(mask))


def test_parts_of_odd_rasters(spark):
    rows = [(1, [True, False, True, True], 2), (2, [True, True, True], 2), (3, [], 2), (4, None, 2), (5, [True], None), (6, [False], 1)]
    df = spark.createDataFrame(rows, "id int, mask array<boolean>, width int")
    got = {r["id"]: r["p"] for r in df.select("id", rasters.connected_parts("mask", "width").alias("p")).collect()}
    assert [tuple(p) for p in got[1]] == [(3, 0, 0, 1, 1)] and got[6] == [] and all(got[n] is None for n in (2, 3, 4, 5))
    zones = [("all", 0, 1, 0, 1), ("left", 0, 1, 0, 0.5), ("top", 0, 0.5, 0, 1)]
    part = F.struct(F.lit(1).alias("top"), F.lit(2).alias("bottom"), F.lit(0).alias("left"), F.lit(1).alias("right"))
    shares = spark.range(1).select(rasters.zone_shares(part, F.lit(4), F.lit(4), zones)).first()[0]
    assert [(z["zone"], z["share"]) for z in shares] == [("left", 1.0), ("all", 1.0), ("top", 0.5)]


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 40), st.integers(3, 40), st.integers(0, 1000))
def test_cells_are_direct_means(height, width, seed):
    rng = np.random.default_rng(seed)
    raster, mask = rng.uniform(0, 255, (height, width)), rng.random((height, width)) < 0.6
    for window, scale, cell, mean, cover in rasters.cell_sums(raster, mask, rasters.BANDS, (1, 2, 3), 2):
        top = int(height * rasters.BANDS[window][0])
        bottom = min(height, top + int(height * rasters.BANDS[window][1]))
        r, c = divmod(cell, scale)
        box = np.s_[top + r * (bottom - top) // scale : top + (r + 1) * (bottom - top) // scale, c * width // scale : (c + 1) * width // scale]
        own = raster[box][mask[box]]
        assert (mean is None and not len(own)) or mean == pytest.approx(own.mean())
        assert cover == pytest.approx(mask[box].mean() if mask[box].size else 0)
    assert len(rasters.BANDS) == 21


def test_panels_and_silhouettes_of_drawn_garments(spark):
    two = [[255] * 20 for _ in range(12)]
    for y in range(2, 11):
        two[y][2:8] = [40] * 6
        two[y][12:18] = [90] * 6
    flat = lambda rows: [v for r in rows for v in r]
    rows = [(1, flat(two), 20), (2, flat([r[:10] for r in two]), 10), (3, [255] * 60, 10), (4, [1, 2, 3], 2), (5, [], 2), (6, None, 2)]
    df = spark.createDataFrame(rows, "id int, p array<int>, width int")
    got = {r["id"]: r["x"] and [tuple(p) for p in r["x"]] for r in df.select("id", rasters.panels(F.col("p"), F.col("width")).alias("x")).collect()}
    assert got == {1: [(0, 10), (10, 20)], 2: [(0, 10)], 3: [(0, 10)], 4: None, 5: None, 6: None}
    shirt = np.zeros((40, 30), bool)
    shirt[:, 8:22] = True  # the body
    shirt[2:12, 2:28] = True  # short sleeves
    shirt[12:14, 1:29] = True  # and cuffs
    shirt[0:3, 13:17] = False  # a neck of 4
    vest = np.zeros((40, 30), bool)
    vest[:, 8:22] = True
    rows = [(1, [bool(v) for v in shirt.ravel()], 30), (2, [bool(v) for v in vest.ravel()], 30), (3, [False] * 60, 10), (4, None, 3)]
    df = spark.createDataFrame(rows, "id int, m array<boolean>, width int")
    got = {r["id"]: r["s"] for r in df.select("id", rasters.silhouette(F.col("m"), F.col("width")).alias("s")).collect()}
    assert got[3] is None and got[4] is None
    assert (got[1]["body"], got[1]["shoulder"], got[1]["sleeve"], got[1]["sleeve_share"], got[1]["neck"], got[1]["neck_width"]) == (14.0, 0, "short", 0.3, "round", 0.571) and got[1]["length"] == "tunic"
    assert (got[2]["sleeve"], got[2]["sleeve_share"], got[2]["length_ratio"]) == ("none", 0.0, 2.857)


def test_statistics_of_decoded_files(spark, tmp_path):
    def write(pixels, name):
        """A PNG of eight bits a channel."""
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\0" + row.tobytes() for row in pixels)
        (tmp_path / name).write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">2I5B", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))

    a = np.full((60, 40, 3), 255, np.uint8)
    a[10:50, 10:30] = (200, 30, 30)
    write(a, "garment.png")
    noise = np.random.default_rng(1).integers(0, 256, (300, 500, 3)).astype(np.uint8)
    write(noise, "cloth.png")
    (tmp_path / "broken.png").write_bytes(b"no picture")
    images = spark.read.format("image").load(f"file://{tmp_path}")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in rasters.images_with_statistics(images).withColumn("kind", carve.kind_of_image()).collect()}
    garment = got["garment.png"]
    assert (garment["white"], garment["sat"], garment["fill"], garment["aspect"], garment["edge_bg"], garment["ring_sd"], garment["ncolor"], garment["longest"]) == (1 - 1 / 3, 170.0, 1 / 3, 2.0, 1.0, 0.0, 2.0, 60.0)
    assert garment["kind"] == "stamp" and got["cloth.png"]["kind"] == "fabric" and got["cloth.png"]["longest"] == 500
    assert "broken.png" not in got or (got["broken.png"]["white"] is None and got["broken.png"]["kind"] is None)
    gray = rasters.statistics_of(np.repeat(np.arange(0, 240, dtype=np.int64).reshape(12, 20, 1), 3, 2))
    assert gray["sat"] == 0 and gray["ncolor"] == 8


def plain_palette(pixels, k=3, rounds=12, least=0.06):
    """Farthest-point seeds and k-means over every pixel, in plain Python."""
    n = len(pixels)
    mean = [max(sum(p[c] for p in pixels) / n, 1.0) for c in range(3)]
    gain = [min(max(sum(mean) / 3 / m, 0.75), 1.33) for m in mean]
    groups = {}
    for p in pixels:
        groups[tuple(p)] = groups.get(tuple(p), 0) + 1
    colours = sorted(groups)
    lab = {c: tuple(palettes.lab_of(np.array([[min(max(v * g, 0), 255) for v, g in zip(c, gain)]]))[0]) for c in colours}
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    first = max(colours, key=lambda c: (groups[c], [-v for v in c]))
    centres = [lab[first]]
    while len(centres) < k:
        best = max(colours, key=lambda c: (min(far(lab[c], m) for m in centres), [-v for v in c]))
        if min(far(lab[best], m) for m in centres) == 0:
            break
        centres.append(lab[best])
    near = lambda c: min(range(len(centres)), key=lambda n: (far(lab[c], centres[n]), n))
    for _ in range(rounds):
        own = {c: near(c) for c in colours}
        for m in range(len(centres)):
            members = [c for c in colours if own[c] == m]
            if members:
                total = sum(groups[c] for c in members)
                centres[m] = tuple(sum(lab[c][d] * groups[c] for c in members) / total for d in range(3))
    share = [0] * len(centres)
    for c in colours:
        share[near(c)] += groups[c] / n
    return [(*centres[m], share[m]) for m in sorted(range(len(centres)), key=lambda m: (-round(share[m], 12), m)) if share[m] >= least]


def test_palettes(spark):
    rng = random.Random(4)
    pictures = [[[rng.choice([10, 60, 200]) for _ in range(3)] for _ in range(60)] for _ in range(12)] + [[[9, 9, 9]] * 5, [[250, 0, 0]] * 30 + [[0, 0, 250]] * 2]
    for pixels in pictures:
        got, want = palettes.palette_of(np.array(pixels, float)), plain_palette(pixels)
        assert len(got) == len(want) and np.allclose(got, want)
    rows = [(n, *[[p[c] for p in pixels] for c in range(3)], None) for n, pixels in enumerate(pictures)]
    rows += [(100, [1], [1, 2], [1], None), (101, None, [1], [1], None), (102, [], [], [], None), (103, [9, 200], [9, 0], [9, 0], [True, False])]
    df = spark.createDataFrame(rows, "id int, r array<int>, g array<int>, b array<int>, keep array<boolean>")
    got = {r["id"]: r["p"] for r in df.select("id", palettes.palette(F.col("r"), F.col("g"), F.col("b"), F.col("keep")).alias("p")).collect()}
    assert all(np.allclose([tuple(c) for c in got[n]], plain_palette(pixels)) for n, pixels in enumerate(pictures))
    assert got[100] is None and got[101] is None and got[102] == [] and len(got[103]) == 1 and got[103][0]["w"] == 1.0


@pytest.mark.parametrize("block", [5, 64])
def test_beats_of_hot_and_odd_series(spark, block):
    """A series with a rise every seven slots, cut into many blocks; one that never rises again; rows without a slot or a key."""
    rng = random.Random(6)
    rows = [("hot", n, 5.0 if n % 7 == 3 else rng.choice([0.0, 1.0])) for n in range(-50, 300)] + [("once", 4, 2.0), ("once", None, 9.0), (None, 1, 1.0), (None, 5, 1.0), ("hot", 3, None)]
    df = spark.createDataFrame(rows, "who string, n long, v double")
    series = beat.levels(df, "who", "n", "v")
    level = {}
    for who, n, v in rows:
        if n is not None:
            level[who, n] = level.get((who, n), 0) + (v or 0)
    onset = {k: v - level.get((k[0], k[1] - 1), 0) for k, v in level.items() if v > level.get((k[0], k[1] - 1), 0)}
    got = {(r["key"], r["lag"]): r["lag_sum"] for r in beat.lag_sums(series, 2, 20, block).collect()}
    for who in ("hot", "once", None):
        assert [got[who, lag] for lag in range(2, 21)] == pytest.approx([sum(v * onset.get((who, n + lag), 0) for (w, n), v in onset.items() if w == who) for lag in range(2, 21)])
    found = {r["key"]: r for r in beat.beats(series.where("key is not null"), 2, 20, usual=8, block=block).collect()}
    assert set(found) == {"hot"} and (found["hot"]["lag"], found["hot"]["phase"]) == (7, 3)
    assert beat.beats(series.where("false"), 2, 20, usual=8).collect() == []


def test_importance_of_a_planted_feature(spark):
    """Success follows one feature; another is noise, and its drop stays within a few spreads of nothing."""
    rng = random.Random(8)
    rows = [("STAR" if (kind := rng.choice("ab")) == "a" and rng.random() < 0.95 else "POOR", f"s{n}", "S1", kind, rng.choice("xyz")) for n in range(600)]
    df = spark.createDataFrame(rows, "perf_band string, sku string, season string, telling string, noise string")
    found = {r["feature"]: r for r in visual.feature_importance(df, ["telling", "noise"], repeats=5, group=40).collect()}
    assert found["telling"]["importance"] > 0.3 and 0 < found["telling"]["spread"] < 0.15 and found["telling"]["repeats"] == 5
    assert abs(found["noise"]["importance"]) < 0.05 and found["telling"]["accuracy"] > 0.9


def test_cells_of_neighbouring_rasters_are_summed_together(spark):
    """rasters of one shape go through numpy as one stack; those of other shapes, unsound ones and nulls stand between them."""
    random = np.random.default_rng(3)
    rows = []
    for n in range(60):
        height, width = [(6, 6), (6, 6), (4, 9)][n % 7 % 3]
        a = random.integers(0, 256, height * width)
        rows.append((n, None if n == 5 else a.tolist(), [] if n == 9 else (a < 200).tolist() if n % 11 else [False] * len(a), None if n == 20 else 5 if n == 31 else width))
    stack = np.stack([np.array(r[1]).reshape(6, 6) for r in rows[:2]]).astype(float)
    keys, means, shares = rasters._cells_of(stack, stack < 200, rasters.BANDS, (2, 3), 3)
    assert means.shape == shares.shape == (2, len(keys))
    df = spark.createDataFrame(rows, "id int, p array<int>, m array<boolean>, w int").coalesce(1)
    got = {r["id"]: r["c"] for r in df.select("id", rasters.cell_signatures(F.col("p"), F.col("m"), F.col("w"), scales=(2, 3), least_side=3).alias("c")).collect()}
    for n, p, m, w in rows:
        if p is None or w is None or not m or len(p) % w:
            assert got[n] is None
            continue
        a, mask = np.array(p).reshape(-1, w), np.array(m).reshape(-1, w)
        expected = []
        for window, scale, cell, mean, cover in rasters.cell_sums(a.astype(float), mask, rasters.BANDS, (2, 3), 3):
            expected.append((window, scale, cell, mean, cover))
        assert [tuple(c) for c in got[n]] == expected
