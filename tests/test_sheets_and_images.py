"""Spec sheets, surveys, signatures and palettes."""

import datetime

import pytest
from pyspark.sql import functions as F

from selvage.operators import survey, techpack, visual
from selvage.sources.files import item_code

SHEET = [
    ["Style", "KA1583008", "", "Date", "20260415"],
    ["Fabric", "", "S", "M", "L"],
    ["cotton", "Qty", "10", "80", "30"],
    ["Chest", "", "18", "19 1/2", "21"],
    ["Length", "", "-", "", "27"],
    ["Hip", "36.0", "", "", ""],
    ["繡花 bear", "", "", "", ""],
]


def cells(spark, sheets):
    rows = [(f, r, c, t) for f, sheet in sheets.items() for r, line in enumerate(sheet) for c, t in enumerate(line)]
    return spark.createDataFrame(rows, "file string, row int, col int, text string")


def test_sheets_as_cells(spark):
    df = cells(spark, {"a": SHEET, "b": [["nothing", "here"]], "c": [["Hip", "x"], ["1/2", "y"]]})
    columns = techpack.size_columns(df, ["S", "M", "L"])
    assert {(r["file"], r["size"]) for r in columns.collect()} == {("a", "S"), ("a", "M"), ("a", "L")}
    assert [tuple(r) for r in techpack.base_size(df, columns, ["qty"]).collect()] == [("a", "M", 3)]
    assert [tuple(r)[1] for r in techpack.base_size(df, columns, ["none"]).collect()] == ["M"]
    aliases = {"chest": ["chest"], "length": ["length"], "hip": ["hip"]}
    got = {(r["file"], r["measure"]): r["value"] for r in techpack.harvest(df, aliases, ["S", "M", "L"], ["qty"]).collect()}
    assert got == {("a", "chest"): 19.5, ("a", "length"): 27.0, ("a", "hip"): 36.0, ("c", "hip"): 0.5}
    wide = {r["file"]: (r["chest"], r["extract_fields"]) for r in techpack.measures_wide(techpack.harvest(df, aliases, ["S", "M", "L"], ["qty"]), ["chest", "length", "hip"]).collect()}
    assert wide == {"a": (19.5, 3), "c": (None, 1)}
    meta = {r["name"]: r for r in techpack.metadata(df, {"style": (["style"], "text"), "date": (["date"], "date"), "fabric": (["fabric"], "text")}).collect()}
    assert meta["style"]["text"] == "KA1583008" and meta["date"]["date"] == datetime.date(2026, 4, 15) and meta["fabric"]["text"] == "S"


def test_notes_and_codes(spark):
    df = cells(spark, {"a": SHEET, "b": [["繡花 bear", "繡花 bear"], ["color 42-1", "格紋"]]})
    words = {(r["keyword"], r["n"], r["n_files"]) for r in techpack.keyword_vocabulary(df, ["繡花", "格紋"]).collect()}
    assert words == {("繡花", 3, 2), ("格紋", 1, 1)}
    assert {r["keyword"]: r["share"] for r in techpack.keyword_coverage(df, ["繡花", "格紋"]).collect()} == {"繡花": 1.0, "格紋": 0.5}
    assert {r["file"]: r["craft"] for r in techpack.notes(df, {"craft": [("繡", "embroidery"), ("格", "plaid")]}).collect()} == {"a": "embroidery", "b": "embroidery、plaid"}
    assert [(r["n"], r["samples"]) for r in techpack.code_notations(df, {"dash": r"\d\d-\d"}).collect()] == [(1, "42-1")]
    export = spark.createDataFrame([("x", f"KA158300{n}42") for n in range(5)], "note string, code string")
    assert techpack.best_code_column(export, item_code) == "code" and techpack.best_code_column(export.select("note"), item_code) is None
    items = techpack.attach_colours(spark.createDataFrame([("s1",), ("s2",)], "sku string"), spark.createDataFrame([("s1", "b"), ("s1", "a"), ("s1", "b")], "style string, color string"))
    assert {r["sku"]: (r["colors"], r["n_colors"]) for r in items.collect()} == {"s1": ("a,b", 2), "s2": (None, 0)}


def test_variants_and_near_keys(spark):
    df = spark.createDataFrame([("藍/S:3；藍/M:0；藍/白/L:2",), (None,)], "t string").select(techpack.variants(F.col("t")).alias("v")).collect()
    assert [tuple(x) for x in df[0]["v"]] == [("藍", "S", 3), ("藍", "M", 0), ("藍/白", "L", 2)] and df[1]["v"] == []
    pairs = [("abcd", "abxd", True), ("abcd", "abdc", True), ("abcd", "dbca", False), ("abcd", "abcd", False), ("abc", "abcd", False), ("abcd", "xbxd", False)]
    got = spark.createDataFrame(pairs, "a string, b string, y boolean").select("y", techpack.one_off(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r["x"] == r["y"] for r in got)


def test_surveys(spark):
    df = spark.createDataFrame([("1", "喜歡；其他", ""), ("2", None, "x"), ("1", "喜歡；其他", "")], "`Q1 你的 編號` string, `Q2 原因（可複選）` string, extra string")
    rows = survey.read_export(df, {"shop": ["編號"], "reason": ["原因", "複選"], "none": ["zzz"]}, "f")
    assert rows.columns == ["shop", "reason", "none", "response_id"] and rows.select("response_id").distinct().count() == 3
    codes = rows.select(survey.codes_of(F.regexp_replace("reason", "；", ";"), {"喜歡": "LIKE"}).alias("c")).collect()
    assert [r["c"] for r in codes] == [["LIKE", "其他"], [], ["LIKE", "其他"]]
    fresh, counts = survey.append_new(rows, rows.where("shop = '2'"))
    assert counts == {"new": 2, "repeated": 1} and [r["shop"] for r in fresh.collect()] == ["1", "1"]  # two people who answered alike
    assert survey.append_new(survey.read_export(df, {"shop": ["編號"], "reason": ["原因", "複選"], "none": ["zzz"]}, "f"), rows)[1] == {"new": 0, "repeated": 3}
    placed = survey.read_export(df.withColumn("row", F.monotonically_increasing_id()), {"shop": ["編號"], "response_id": ["zzz"]}, "f", row="row")
    assert placed.columns == ["shop", "response_id"] and placed.select("response_id").distinct().count() == 3


def test_signatures_and_palettes(spark):
    a, b = [10.0, 0.0, 0.0, 20.0, 0.0, 0.0, 1.0], [13.0, 4.0, 0.0, None, 0.0, 0.0, 3.0]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    row = df.select(visual.signature_distance(F.col("a"), F.col("b"), 2, 1).alias("d"), visual.signature_distance(F.col("a"), F.col("a"), 2, 1).alias("z")).first()
    assert row["d"] == pytest.approx(5 + 0.5 * 2) and row["z"] == 0
    palettes = spark.createDataFrame([([(0.0, 0.0, 0.0, 3.0), (10.0, 0.0, 0.0, 1.0)], [(0.0, 0.0, 4.0, 1.0)])], "p array<struct<L:double,a:double,b:double,w:double>>, q array<struct<L:double,a:double,b:double,w:double>>")
    assert palettes.select(visual.palette_distance(F.col("p"), F.col("q")).alias("d")).first()["d"] == pytest.approx((3 * 4 + (116**0.5)) / 4)
    ranked = spark.createDataFrame([(1, 7, 100), (1, 8, 20), (2, 7, 30), (2, 9, 29), (3, 1, 10)], "query long, id long, count long")
    assert {r["query"]: (r["id"], r["dominant"]) for r in visual.dominant(ranked).collect()} == {1: (7, True), 2: (7, False), 3: (1, False)}


def test_stratified_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([(n % 4, float(n * 17 % 29) / 29 + 0.3 * (n % 3 == 0), n % 3 == 0) for n in range(400)], "s long, sell_through_rate double, m boolean")
    one, two = (visual.stratified_bootstrap(d, F.col("m"), ["s"], draws=300).first() for d in (df, df.repartition(7)))
    assert one == two and one["low"] < one["lift_points"] < one["high"] and 15 < one["lift_points"] < 45 and one["flipped"] == 0 and one["n_strata"] == 4


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_fields_of_sheets_need_no_join(spark):
    """a label's value is the next one along its row or column, so labels don't meet all cells of their sheet."""
    fields = {"date": (["date"], "date"), "buyer": (["buyer"], "number")}
    sheets = {"a": [["Date", "", "20260415", "1"], ["Buyer", "", "", "", "far"], ["", ""], ["7 1/2", "x"]], "b": [["Date", "Buyer"], ["20260416", "12"]]}
    found = techpack.metadata(cells(spark, sheets), fields)
    assert _joins(found) == 0
    got = {(r["file"], r["name"]): (r["text"], r["number"]) for r in found.collect()}
    assert got == {("a", "date"): ("20260415", None), ("a", "buyer"): ("7 1/2", 7.5), ("b", "date"): ("20260416", None), ("b", "buyer"): ("12", 12.0)}
    wide = spark.range(3000).select(F.lit("w").alias("file"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.when(F.col("id") % 2 == 0, "Date").otherwise("20260417").alias("text"))
    assert [r["text"] for r in techpack.metadata(wide, fields).collect()] == ["20260417"]


def test_measures_of_sheets_need_no_join(spark):
    """numbers are read once, and rows and columns are told by windows."""
    df = cells(spark, {"a": SHEET, "c": [["Hip", "x"], ["1/2", "y"]]})
    found = techpack.harvest(df, {"chest": ["chest"], "length": ["length"], "hip": ["hip"]}, ["S", "M", "L"], ["qty"])
    assert _joins(found) == 0
    assert {(r["file"], r["measure"]): r["value"] for r in found.collect()} == {("a", "chest"): 19.5, ("a", "length"): 27.0, ("a", "hip"): 36.0, ("c", "hip"): 0.5}


def test_base_sizes_need_no_join(spark):
    """the base size from one pass over the cells, as from the columns."""
    df = cells(spark, {"a": SHEET, "b": [["S", "M", "L", "XL"]], "c": [["S", "x"], ["Qty", "3"]], "d": [["S", "M"], ["Qty", "9"], ["Qty", "1"]]})
    found = techpack.base_sizes(df, ["S", "M", "L", "XL"], ["qty"])
    assert _joins(found) == 0
    same = techpack.base_size(df, techpack.size_columns(df, ["S", "M", "L", "XL"]), ["qty"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, same.collect())) == [("a", "M", 3), ("b", "M", 1), ("d", "M", 1)]
