"""Column helpers."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.functions import colour, columns
from selvage.operators.association import chi2_p


def values(spark, texts, make):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    return [r["v"] for r in sorted(df.select("n", make(F.col("t")).alias("v")).collect())]


def test_numbers_and_dates(spark):
    texts = ["22 1/2", "1/2", "36.0", "-", "1,234元", "68%", "$5", "", None, "１２", "x1", "1/0"]
    assert values(spark, texts, columns.number_of) == [22.5, 0.5, 36.0, None, 1234.0, 0.68, 5.0, None, None, 12.0, None, None]
    day = datetime.date(2026, 4, 15)
    assert values(spark, ["20260415", "20260415.0", "2026-04-15", "2026/4/15", "soon", None], columns.date_of) == [day, day, day, day, None, None]


def test_plain_text_matches_headers(spark):
    assert values(spark, ["Stock_In", "ｓｔｏｃｋ　in", "stock-in (x)"], columns.plain_text) == ["stockin", "stockin", "stockinx"]


def test_pct_rank_is_that_of_pandas(spark):
    rows = [(n % 3 if n % 11 else None, float(n * 7 % 13) if n % 5 else None, n) for n in range(90)]
    df = spark.createDataFrame(rows, "g int, x double, n int")
    got = {r["n"]: r["p"] for r in columns.pct_rank(df, ["g"], "x", "p").collect()}
    expected = pd.DataFrame(rows, columns=["g", "x", "n"]).assign(g=lambda d: d.g.fillna(-1))
    expected["p"] = expected.groupby("g")["x"].rank(pct=True)
    assert len(got) == 90
    for r in expected.itertuples():
        assert got[r.n] is None if pd.isna(r.p) else got[r.n] == pytest.approx(r.p)


def test_bins_are_those_of_qcut(spark):
    x = [float(n * n % 97) for n in range(150)]
    df = spark.createDataFrame([(1, v) for v in x], "g int, x double")
    edges = columns.quantile_edges(df, ["g"], "x", 5, 30)
    got = sorted((r["x"], r["b"]) for r in df.join(edges, "g").select("x", columns.bin_of(F.col("x"), F.col("_edges")).alias("b")).collect())
    expected = pd.qcut(pd.Series(x), 5, labels=False) + 1
    assert got == sorted(zip(x, expected))
    assert columns.quantile_edges(df.limit(10), ["g"], "x", 5, 30).count() == 0


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, 0)], "a int, b int")
    row = df.select(columns.ratio("a", "b").alias("r"), columns.first_match(F.lit("red hat"), [("hat", "h"), ("red", "r")]).alias("m"), columns.all_matches(F.lit("red hat"), [("hat", "h"), ("x", "x"), ("red", "r")]).alias("l"), columns.map_of(F.lit("k"), {"k": 3}).alias("k")).first()
    assert (row["r"], row["m"], row["l"], row["k"]) == (None, "h", ["h", "r"], 3)
    wide = columns.ensure_columns(df, T.StructType([T.StructField("b", T.IntegerType()), T.StructField("c", T.DateType())]))
    assert wide.columns == ["a", "b", "c"]


def test_chi_square_tail():
    assert chi2_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_p(14.06714, 7) == pytest.approx(0.05, abs=1e-6)
    assert chi2_p(0, 3) == 1.0 and chi2_p(1.0, 10) == pytest.approx(0.999828, abs=1e-5)


#: Fixed: published pairs of LAB colours and their CIEDE2000 difference.
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000), (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669), (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792), (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492), (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644), (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373), (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082), (90.9257, -0.5406, -0.9208, 88.6381, -0.8985, -0.7239, 1.5381),
]


def test_ciede2000_pairs(spark):
    df = spark.createDataFrame(PAIRS, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, d double")
    de = colour.delta_e_2000(*[tuple(F.col(f"{c}{n}") for c in "lab") for n in (1, 2)])
    back = colour.delta_e_2000(*[tuple(F.col(f"{c}{n}") for c in "lab") for n in (2, 1)])
    for r in df.select("d", de.alias("e"), back.alias("f")).collect():
        assert r["e"] == pytest.approx(r["d"], abs=1e-4) and r["f"] == pytest.approx(r["d"], abs=1e-4)


def test_hex_round_trip(spark):
    df = spark.createDataFrame([(f"#{n * 7919 % (1 << 24):06X}",) for n in range(200)] + [("bad",), (None,)], "h string")
    lab = colour.lab_of_hex(F.col("h"))
    rows = df.select("h", lab[0].alias("l"), lab[1].alias("a"), lab[2].alias("b"))
    rows = rows.select("h", "l", colour.hex_of_lab(F.col("l"), F.col("a"), F.col("b")).alias("back")).collect()
    assert all(r["back"] == (r["h"] if r["l"] is not None else None) for r in rows) and sum(r["l"] is None for r in rows) == 2


def test_medians_equal_sparks_own(spark):
    """Null keys, groups without a value, ties and empty tables."""
    rows = [(k, float(v) if v % 5 else None, v % 3) for n, k in enumerate(["a", "b", None]) for v in range(n, 40, n + 2)] + [("c", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y int")
    found = columns.with_medians(df.groupBy("k").agg(F.count("*").alias("n")), df, ["k"], {"x": "x", "y": "y"})
    expected = df.groupBy("k").agg(F.count("*").alias("n"), F.median("x").alias("x"), F.median("y").alias("y"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    assert columns.with_medians(df.limit(0).groupBy("k").agg(F.count("*").alias("n")), df.limit(0), ["k"], {"x": "x"}).collect() == []
