"""Operators on small tables: rules, quirks and invariants."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from selvage.operators import association, feedback, leaderboard, lift, merge, names, performance, retrieval, sales, season, stock
from selvage.plans import adapter, registry
from selvage.sources import files, pos
from selvage.streaming import new_rows, upsert_best, windowed_best

SMALL = "/root/testdata/sf0.001"


def master(spark, n=200):
    rows = [(k, 2020 + k % 3, "A" if k % 2 else "B", float(20 + k), (k * 37 % 100) / 100, 10.0, k % 17 == 0, k % 19 == 0) for k in range(n)]
    return spark.createDataFrame(rows, "sku long, season long, category string, stock_in double, sell_through_rate double, weeks_on_sale double, is_gift boolean, is_sample boolean")


def test_grades_cover_and_audit_adds_up(spark):
    df = master(spark)
    graded = performance.grade(df)
    counts = {r["perf_band"]: r["count"] for r in graded.groupBy("perf_band").count().collect()}
    assert sum(counts.values()) == 200 and set(counts) == set(performance.BANDS)
    audit = {r["first_rule"]: r["n"] for r in performance.filter_audit(df).collect()}
    assert sum(audit.values()) == 200 and audit["kept"] == 200 - counts["EXCLUDED"]
    tied = master(spark, 40).withColumns({"sell_through_rate": F.lit(0.5), "stock_in": F.lit(99.0)})
    assert {r["perf_pct"] for r in performance.grade(tied, by=("category",)).where("perf_band <> 'EXCLUDED'").collect()} <= {round((1 + n) / 2 / n, 4) for n in range(1, 41)}


def test_many_lines_meet_their_orders_and_parts_unsorted(spark):
    items = spark.createDataFrame([(n // 3 if n % 7 else None, n % 5 if n % 11 else None, n) for n in range(60)], "l_orderkey long, l_partkey long, l_linenumber long")
    orders = spark.createDataFrame([(k, f"o{k}") for k in [*range(15), 14]], "o_orderkey long, o_name string")  # one twice, some missing
    parts = spark.createDataFrame([(k, f"p{k}") for k in range(4)], "p_partkey long, p_name string")
    few = adapter.with_orders_and_parts(items, orders, parts)
    many = adapter.with_orders_and_parts(items, orders, parts, most=5, few=10)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and few.count() > 20
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 2 and "hashpartitioning(l_orderkey" in plan and ", 12), REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["variant_stock", "derived_columns"])
def test_reports_of_many_lines_sort_none(spark, name, monkeypatch):
    want = sorted(map(tuple, registry.QUERIES[name](spark, SMALL).collect()))
    monkeypatch.setattr(adapter, "FEW_LINES", 1000)
    monkeypatch.setattr(adapter, "TASK_LINES", 500)
    got = registry.QUERIES[name](spark, SMALL)
    assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and plan.count("ShuffledHashJoin") == 2
    assert sorted(map(tuple, got.collect())) == want


def test_sums_of_nothing_and_negative_stock(spark):
    day = datetime.date(2024, 1, 1)
    base = {"sku": 1, "season": 1, "product_name": "x", "category": "c", "product_line": "p", "sub_category": "s", "color": "r", "size": 1, "designer": 1, "list_price": 5.0, "stock_in": None, "sales_qty": None, "return_qty": None, "sales_amount": None, "stock_on_hand": -3.0, "stock_on_hand_alt": None, "ship_date": day}
    types = "sku long, season long, product_name string, category string, product_line string, sub_category string, color string, size long, designer long, list_price double, stock_in double, sales_qty double, return_qty double, sales_amount double, stock_on_hand double, stock_on_hand_alt double, ship_date date"
    lines = spark.createDataFrame([tuple(base.values())], types)
    row = sales.aggregate_to_sku_season(lines, gift=F.lit(False)).first()
    assert row["stock_in"] == 0.0 and row["sell_through_rate"] is None and row["is_sample"] and row["weeks_on_sale"] == 0
    variant = sales.aggregate_to_variant(lines.withColumn("color", F.lit(None).cast("string")), ["sku", "color"]).first()
    assert variant["is_negative"] and variant["stock_on_hand"] == 0.0 and variant["color"] is None
    reported = sales.aggregate_to_sku_season(lines.withColumn("sell_through_reported", F.lit(0.7)), gift=F.lit(False)).first()
    assert reported["sell_through_rate"] == 0.7


def test_samples_and_body_parts(spark):
    df = spark.createDataFrame([("1571007樣衣", 5.0, 5.0), ("shirt", 1.0, 0.0), ("shirt", 50.0, 0.0)], "product_name string, stock_in double, sales_qty double")
    got = sales.flag_samples(df, ["樣衣", "sample"]).collect()
    assert [(r["is_sample"], r["sample_reason"], r["sample_parent_sku"]) for r in got] == [(True, "name", "KA1571007"), (True, "quantity", None), (False, None, None)]
    coded = spark.createDataFrame([("51",), ("3",), ("8",)], "category_code string")
    parts = sales.body_parts(coded, {"1": ("top", "upper"), "3": ("tee", "upper")}).collect()
    assert [(r["body_part"], r["body_half"]) for r in parts] == [("top", "upper"), ("tee", "upper"), (None, None)]


def test_seasons_go_by_order_not_by_name(spark):
    df = spark.createDataFrame([("c", 20231, 1.0), ("c", 20234, 3.0), ("c", 20242, 2.0)], "category string, season long, x double")
    got = {r["season"]: r["change"] for r in stock.drift(df, "x").collect()}
    assert got == {20231: None, 20234: 2.0, 20242: -1.0}


def test_range_plan_invariants(spark):
    cells = spark.createDataFrame([("A", 1, 10, 100.0, 0.5), ("B", 1, 30, 300.0, 0.9), ("A", 2, 5, 50.0, 0.2)], "category string, term long, n_rows long, stock_in double, mean_rate double")
    got = {(r["category"], r["term"]): r for r in season.term_gaps(cells).collect()}
    assert got["A", 1]["stock_share"] + got["B", 1]["stock_share"] == pytest.approx(1) and got["A", 1]["term_mean"] == pytest.approx(0.8)
    assert got["A", 1]["gap_points"] == pytest.approx(-30) and got["A", 1]["below"] and got["A", 2]["gap_points"] == 0


def test_feedback_rules(spark):
    rows = [(1, "STAR", "s_late|F_RISE, x_odd", "2024-01-01", "HIGH"), (1, "SLOW", "F_RISE", "2024-01-05", "LOW"), (1, "", "", "2024-02-01", "LOW"), (2, "OK", None, "2024-01-01", "LOW"), (3, "MAYBE", "S_LATE", "2024-01-01", None), (None, "OK", "", "2024-01-01", "LOW")]
    df = spark.createDataFrame(rows, "sku long, verdict string, tags string, d string, confidence string").withColumns({"reason_tag_list": feedback.tag_list(F.col("tags")), "survey_date": F.to_date("d"), "respondent": F.lit("r")})
    got = {r["sku"]: r for r in feedback.summarize(df).collect()}
    assert got[1]["fb_verdict"] == "SLOW"  # a tie goes to the later one, and the blank later still doesn't count
    assert got[1]["fb_tags"] == ["F_RISE", "S_LATE", "X_ODD"] and got[1]["fb_groups"] == ["FIT", "OTHER", "SUPPLY"] and got[1]["fb_n"] == 3
    problems = {(r["sku"], r["issues"]) for r in feedback.issues(df, ["F_RISE", "S_LATE"]).collect()}
    assert (1, "unknown tags X_ODD") in problems and (3, "unknown verdict") in problems and (None, "no sku") in problems
    graded = spark.createDataFrame([(1, "SLOW"), (2, "STAR"), (9, "SLOW"), (9, "CORE")], "sku long, perf_band string")
    out = {(r["sku"], r["perf_band"]): (r["rule"], r["agreement"], r["action"], r["priority"]) for r in feedback.diagnose(graded, feedback.summarize(df)).collect()}
    assert out == {(1, "SLOW"): (1, "AGREE", "A_REORDER", "HIGH"), (2, "STAR"): (None, "CONFLICT", "A_WATCH", "HIGH"), (9, "SLOW"): (None, "NO_FEEDBACK", "A_WATCH", "MEDIUM"), (9, "CORE"): (None, "NO_FEEDBACK", "A_WATCH", "LOW")}


def test_equal_quantiles_make_slow_win(spark):
    df = spark.createDataFrame([("c", 0.5)] * 10, "category string, sell_through_rate double")
    assert {r["actual"] for r in feedback.actual_verdict(df, ["category"]).collect()} == {"SLOW"}


def test_name_rules(spark):
    vocabulary = ["bear", "bearhead", "long", "sleeve"]
    df = spark.createDataFrame([(1, "bearhead long tee 12", "T"), (2, "long bearhead eet", "T"), (3, "plain", "T"), (4, "bearhead long zzz", "T")], "sku long, product_name string, category string")
    got = {r["sku"]: r for r in names.with_signature(df, vocabulary).collect()}
    assert got[1]["signature"] == got[2]["signature"] == "T|bearhead+long" and got[3]["signature"] == "" and got[1]["residual"] == got[2]["residual"] == "eet"
    assert got[1]["coverage"] == pytest.approx(12 / 15)
    groups = names.duplicate_groups(names.with_signature(df, vocabulary)).collect()
    assert [(r["signature"], r["n"], r["first_key"]) for r in groups] == [("T|bearhead+long", 2, 1)]
    placed = names.placements(df, ["long"], ["bear", "tee"]).collect()
    assert [r["placed"] for r in sorted(placed)] == [["long:tee"], ["long:bear"], [], ["long:"]], placed


def test_ngrams_cross_blanks_and_count_occurrences(spark):
    df = spark.createDataFrame([("ab 1 ab",), ("ab 1 ab",), ("c",), ("",), (None,)], "name string")
    assert {r["gram"]: r["n"] for r in names.ngram_counts(df, "name").collect()} == {"ab": 4}
    assert {r["gram"]: r["n"] for r in names.ngram_counts(df, "name", least=1).collect()} == {"ab": 4, "ba": 2, "aba": 2, "bab": 2, "abab": 2}


def test_dates_of_workbooks(spark):
    """Days and times by their cells' styles, in both calendars; a number without such a style stays one, and is no year."""
    from selvage.functions.columns import date_of
    from selvage.sources.excel import cells_of

    def dated(epoch):
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        cells = [("A1", 1, "45123"), ("B1", 2, "45123.5"), ("C1", 3, "0.25"), ("D1", 0, "45123"), ("E1", 4, "3"), ("F1", 1, "59"), ("G1", 1, "-4"), ("H1", 9, "7")]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://x"><workbookPr date1904="{epoch}"/><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/styles.xml", f"<styleSheet {ns}><numFmts><numFmt numFmtId=\"170\" formatCode=\"yyyy/m/d\\ hh:mm\"/><numFmt numFmtId=\"171\" formatCode='0.0\"days\"'/></numFmts><cellXfs>" + "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 170, 20, 171)) + "</cellXfs></styleSheet>")
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1">' + "".join(f'<c r="{at}" s="{s}"><v>{v}</v></c>' for at, s, v in cells) + "</row></sheetData></worksheet>")
        return [c[3] for c in cells_of(out.getvalue())]

    assert dated(0) == ["2023-07-16", "2023-07-16 12:00:00", "06:00:00", "45123", "3", "1900-02-28", "-4", "7"]
    assert dated(1)[:2] == ["2027-07-17", "2027-07-17 12:00:00"]
    got = spark.createDataFrame([("45123",), ("2023-07-16",), ("20230716",), ("20230716.0",), ("2023-07-16 12:00:00",), ("0001-01-01",), (None,)], "d string").select(date_of(F.col("d")).alias("d")).collect()
    assert [str(r["d"]) for r in got] == ["None", "2023-07-16", "2023-07-16", "2023-07-16", "2023-07-16", "None", "None"]


def test_vocabulary_drops_fragments(spark):
    df = spark.createDataFrame([(f"small{n}",) for n in range(5)] + [("mall",)] * 1 + [(f"all{n}",) for n in range(9)], "name string")
    kept = {r["gram"] for r in names.learn_vocabulary(names.ngram_counts(df, "name")).collect()}
    assert "small" in kept and "smal" not in kept and "all" in kept


def test_evaluation_and_confidence(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query long, true string")
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (2, 1, "x"), (2, 4, "b")], "query long, rank long, label string")
    row = retrieval.evaluate(truth, found).first()
    assert (row["n"], row["top_1"], row["top_5"], row["n_missed"]) == (3, pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), 1) and row["mrr"] == pytest.approx((1 + 0.25) / 3, abs=1e-6)
    pairs = spark.createDataFrame([(1, n, 0.1 + n / 10000) for n in range(99)] + [(1, 99, 0.9)] + [(2, n, n / 1000) for n in range(100)], "query long, id long, similarity double")
    assert {r["query"]: r["verdict"] for r in retrieval.confidence(pairs).collect()} == {1: "clear", 2: "no better than chance"}


def test_bootstrap_is_seeded_and_covers(spark):
    df = spark.createDataFrame([(n, "A", "hot" if n % 3 else "cold", (n * 31 % 50) / 50 + (0.1 if n % 3 else 0)) for n in range(300)], "sku long, category string, product_name string, sell_through_rate double")
    run = lambda d: {r["motif"]: tuple(r)[1:] for r in lift.bootstrap_lift(d, [("hot", "h"), ("cold", "c")], ["category"]).collect()}
    one, two = run(df), run(df.repartition(5))
    assert one == two and all(low <= mid <= high for _, mid, low, high in one.values()) and one["h"][1] > 0 > one["c"][1]


def test_q_values_grow_with_p(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "t string, p double")
    got = {r["t"]: r["q"] for r in association.benjamini_hochberg(tests, "p", ["t"]).collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.16 / 3, "c": 0.16 / 3, "d": 0.9})


def test_master_joins_keep_rows(spark):
    rows = spark.createDataFrame([("A1", "S1"), ("A2", "S1"), ("A3", "S2"), ("A4", None)], "sku string, style_code string")
    attributes = spark.createDataFrame([("A1", "red", 0.4), ("A1", "blue", 0.9)], "sku string, colour string, attribute_conf double")
    measures = spark.createDataFrame([("A1", "S1", "base", 5, 10.0), ("A1", "S1", "b", 3, 99.0), ("A9", "S2", "base", 2, None)], "sku string, style_code string, techpack_variant string, extract_fields int, chest double")
    out, audit = merge.master(rows, attributes, measures)
    got = {r["sku"]: (r["colour"], r["chest"]) for r in out.collect()}
    assert got == {"A1": ("blue", 10.0), "A2": (None, 10.0), "A3": (None, None), "A4": (None, None)}
    assert {r["step"]: (r["n_left"], r["n_matched"]) for r in audit.collect()} == {"attributes": (4, 1), "measures": (4, 3)}


def test_sheets_of_unknown_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("貨號,品名,累進,銷貨數量,定價,出貨日,其他\nKA1583008,熊棉T,\"1,200\",30,\"1,234元\",20260415,x\n合計,,9999,,,,\n,,1,,,,\nKA1365106,格紋上衣,10,68%,50,2026/4/20,y\nbad,帽子,1,1,1,,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("foo,bar\n1,2\n", encoding="utf-8")
    lines, audit = pos.load_sales(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv", "none.csv")])
    told = {r["source_file"].rsplit("/", 1)[-1]: r for r in audit.collect()}
    assert {f: r["status"] for f, r in told.items()} == {"a.csv": "OK", "b.csv": "SKIPPED", "none.csv": "ERROR"}
    assert told["a.csv"]["n_rows"] == 5 and told["a.csv"]["unmapped"] == "其他" and "ship_date<-出貨日" in told["a.csv"]["mapped"]
    got = {r["sku"]: r for r in lines.collect()}
    assert set(got) == {"KA1583008", "KA1365106"}
    assert got["KA1583008"]["stock_in"] == 1200 and got["KA1583008"]["list_price"] == 1234 and got["KA1583008"]["category"] == "TOP" and got["KA1583008"]["season"] == "KA158"
    assert got["KA1365106"]["category"] == "TOP" and got["KA1365106"]["snapshot_date"] == datetime.date(2026, 4, 20)
    part = spark.createDataFrame([("KA158",), ("KA136",)], "c string").select(pos.season_parts(F.col("c")).alias("p")).collect()
    assert [tuple(r["p"]) for r in part] == [(2026, "SS", 2), (2024, "AW", 4)]


def book(sheets):
    """A workbook's bytes: shared strings for text, plain numbers else."""
    words, parts = [], []
    for rows in sheets.values():
        lines = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, v in enumerate(row):
                if v is None:
                    continue
                at = f"{chr(65 + c)}{r}"
                if isinstance(v, str):
                    words.append(v)
                    cells.append(f'<c r="{at}" t="s"><v>{len(words) - 1}</v></c>')
                else:
                    cells.append(f'<c r="{at}"><v>{v}</v></c>')
            lines.append(f'<row r="{r}">{"".join(cells)}</row>')
        parts.append("".join(lines))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://x"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{w[:1]}</t></r><r><t>{w[1:]}</t></r><rPh><t>x</t></rPh></si>" for w in words) + "</sst>")
        for i, p in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{p}</sheetData></worksheet>")
    return out.getvalue()


def test_sheets_in_folders(spark, tmp_path):
    """The headers of the reports: 總銷 is sales and 銷量 another measure, 總存 is stock and 庫存 another; 款號 is the style."""
    head = ["貨號", "款號", "品名", "累進", "總銷", "銷量", "總存", "庫存", "銷貨額", "銷售率", "平均售價", "入庫日", "出貨日", "設計師"]
    rows = [["KA1583008", "S1", "熊 棉Ｔ", 100, 60, 55, 40, 38, 60000, "60%", 1000, 20260401, 20260415, "L"], ["合計", None, None, 9999], ["KA1583009", None, "帽T", 10, 1, 2, 9, 8, None, 0.1, None, None, None, None]]
    for folder in ("KA136", "KA158"):
        (tmp_path / folder).mkdir()
    (tmp_path / "KA158" / "stock.xlsx").write_bytes(book({"one": [head, *rows], "two": [["foo"], ["x"]], "empty": []}))
    (tmp_path / "KA136" / "2024 aw sales.csv").write_text("\ufeff貨號,總銷\nKA1360001,3\n", encoding="utf-8")
    (tmp_path / "other.csv").write_text("總銷,品號\n4,KA1360002\n", encoding="utf-8")
    (tmp_path / "2024-春夏 a+b.csv").write_text("總銷,品號\n5,KA1360003\n", encoding="utf-8")
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    (tmp_path / "~$stock.xlsx").write_bytes(b"lock")
    spark.createDataFrame([("KA1360004", 7.0)], "sku string, qty_sold double").coalesce(1).write.parquet(str(tmp_path / "pq"))
    lines, audit = pos.load_sales(spark, [str(tmp_path)])
    got = {r["sku"]: r for r in lines.collect()}
    assert set(got) == {"KA1583008", "KA1583009", "KA1360001", "KA1360002", "KA1360003", "KA1360004"}
    r = got["KA1583008"]
    assert (r["sales_qty"], r["sales_qty_alt"], r["stock_on_hand"], r["stock_on_hand_alt"], r["stock_in"], r["sales_amount"]) == (60, 55, 40, 38, 100, 60000)
    assert (r["sell_through_reported"], r["avg_selling_price"], r["style_code"], r["designer"], r["source_sheet"]) == (0.6, 1000, "S1", "L", "one")
    assert r["first_sale_date"] == datetime.date(2026, 4, 1) and r["snapshot_date"] == datetime.date(2026, 4, 15) and r["design_family"] == "熊棉T|"
    assert got["KA1583009"]["style_code"] == "KA1583009"
    assert {s: got[s]["season"] for s in got} == {"KA1583008": "KA158", "KA1583009": "KA158", "KA1360001": "KA136", "KA1360002": "KA136", "KA1360003": "2024-春夏", "KA1360004": "KA136"}
    assert [got[f"KA136000{n}"]["sales_qty"] for n in (1, 2, 3, 4)] == [3, 4, 5, 7]
    told = {(r["source_file"].rsplit("/", 1)[-1], r["source_sheet"]): (r["status"], r["n_rows"]) for r in audit.collect()}
    assert told[("stock.xlsx", "one")] == ("OK", 3) and told[("stock.xlsx", "two")] == ("SKIPPED", 0) and told[("broken.xlsx", "")] == ("ERROR", 0) and told[("other.csv", "")] == ("OK", 1)
    assert not any("~$" in f for f, _ in told)


def test_files_and_codes(spark, tmp_path):
    for name in ("KA158/KA1583008_front.jpg", "KA158/KA1583008_back.jpg", "KA136/KA1583009.jpg", "KA136/~$KA1583009.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"\xff\xd8\xff")
    got = {r["name"]: r for r in files.image_manifest(files.listing(spark, str(tmp_path))).collect()}
    assert len(got) == 3 and got["KA1583009.jpg"]["misfiled"] and not got["KA1583008_front.jpg"]["misfiled"]
    assert got["KA1583008_back.jpg"]["is_primary"] and not got["KA1583008_front.jpg"]["is_primary"]
    codes = spark.createDataFrame([("KA1583008-10-M",), ("ka1583008 42",), ("KA158",)], "t string").select(files.item_code(F.col("t")).alias("c")).collect()
    assert [tuple(r["c"]) if r["c"] else None for r in codes] == [("KA1583008", "10", "M"), ("KA1583008", "42", None), None]
    kinds = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b"\x89PNG\r\n\x1a\n"),), (bytearray(b"PK\x03\x04"),), (bytearray(b""),)], "b binary").select(files.kind_of_bytes(F.col("b")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["jpeg", "png", "zip", "unknown"]
    items, images = spark.createDataFrame([("KA1",), ("ka-1583008",), ("X1583009",)], "sku string"), spark.createDataFrame([("KA1583008", "p"), ("KA1583009", "q")], "sku string, path string")
    assert {r["sku"]: r["reason"] for r in files.unmatched(items, images).collect()} == {"KA1": "no image", "ka-1583008": "spelling", "X1583009": "digits only"}
    old, new = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert [r["k"] for r in files.new_only(new, old, "k").collect()] == [2]


def test_scores(spark):
    t = [datetime.datetime(2024, 1, 7, 17, 0, n) for n in range(4)]
    df = spark.createDataFrame([("b", "aaaa", 10, t[0]), ("b", "aaaa", 30, t[1]), ("b", "aaaa", 30, t[3]), ("b", "bbbb", 30, t[2]), ("b", "x", 50, t[0]), ("b", "cccc", 99999, t[0])], "board string, id string, score int, ts timestamp")
    day, week = leaderboard.period_keys(F.col("ts"))
    rows = leaderboard.valid(df).withColumns({"day": day, "week": week})
    got = leaderboard.leaderboard(rows, "day").collect()
    assert [(r["id"], r["score"], r["place"], r["day"]) for r in sorted(got, key=lambda r: r["place"])] == [("aaaa", 30, 1, "2024-01-08"), ("bbbb", 30, 2, "2024-01-08")]
    assert {r["week"] for r in rows.collect()} == {"2024-W02"}
    assert spark.createDataFrame([("a\x00bcdefghijklmnop ",)], "n string").select(leaderboard.clean_name(F.col("n")).alias("n")).first()["n"] == "abcdefghijkl"


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select(F.col("event_type").alias("board"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("id"), F.floor(F.col("value") * 10).cast("long").alias("score"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    events.orderBy("ts").repartitionByRange(5, "ts").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = upsert_best(stream(), "best_scores", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    got = {(r["board"], r["id"], r["score"]) for n in (0, 1) if spark.catalog.tableExists(f"best_scores_{n}") and n == (last + 1) % 2 for r in spark.table(f"best_scores_{n}").collect()}
    expected = {(r["board"], r["id"], r["score"]) for r in leaderboard.leaderboard(events.withColumn("p", F.lit("all")), "p").collect()}
    assert got == expected
    once = new_rows(stream(), "event_id", late="40 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == events.select("event_id").distinct().count()
    best = windowed_best(stream(), late="40 days").writeStream.outputMode("update").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    best.awaitTermination()
    assert spark.table("windows").count() > 0


def test_every_query_runs_and_names_are_unique(spark):
    for name in ("graded_master", "stratified_lift", "diagnosis", "cosine_topk", "leaderboard_week", "exclusion_audit"):
        df = registry.QUERIES[name](spark, SMALL)
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLES) <= set(registry.QUERIES)


def test_broadcast_and_pushdown_of_the_flagship(spark):
    plan = registry.QUERIES["leaderboard_all"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan  # columns that aren't asked for aren't read


def test_numbers_and_dates_by_shape(spark):
    """plain numbers and formats of the text's own shape first; the values stay."""
    from selvage.functions.columns import date_of, number_of

    texts = {"12": 12.0, " 3 1/2": 3.5, "-2 1/4": -1.75, "1/0": None, "１／２": 0.5, "68%": 0.68, "６８％": 0.68, "$1,234.5元": 1234.5, "XL": None, "2XL": None, "": None, None: None, "1e3": 1000.0, "a/b": None, "x%": None, "-.5": -0.5}
    got = {r["t"]: r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", number_of(F.col("t")).alias("n")).collect()}
    assert got == texts
    days = {"20240105": "2024-01-05", "20240105.0": "2024-01-05", "2024/1/5": "2024-01-05", "2024/13/5": None, "20241399": None, "2024-01-05": "2024-01-05", "2024-01-05 10:00:00": "2024-01-05", "18991231": None, "22000101": None, "45000": None, "x": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in days], "t string").select("t", date_of(F.col("t")).cast("string").alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == days
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("yyyy/M/d") <= 2 and "RLIKE" in plan


def test_importance_reads_the_graded_rows_once(spark, monkeypatch):
    """what the model is fitted on and tested with is kept, all of its rows."""
    from selvage.operators import visual

    kept, whole = [], visual.settled
    monkeypatch.setattr(visual, "settled", lambda df: kept.append(df) or whole(df))
    rows = spark.range(400).select(F.col("id").alias("sku"), F.lit(2024).alias("season"), F.when(F.col("id") % 3 == 0, "STAR").when(F.col("id") % 3 == 1, "SLOW").otherwise("EXCLUDED").alias("perf_band"), (F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 5).cast("string").alias("b"))
    out = visual.feature_importance(rows, ["a", "b"], repeats=2).collect()
    assert len(kept) == 1 and kept[0].count() == rows.where("perf_band <> 'EXCLUDED'").count()
    assert [r["feature"] for r in out] == ["a", "b"] and out[0]["accuracy"] == 1.0


def test_lines_meet_the_dates_of_their_files_where_they_are(spark):
    """the last date of a file comes to its lines; a file's lines don't go to one task."""
    from selvage.sources import pos

    sheet = spark.createDataFrame([("KA1583008", "10", "20240105", "/a/KA158.csv"), ("KA1583009", "4", "2024/1/9", "/a/KA158.csv"), ("total", "14", None, "/a/KA158.csv")], "`貨號` string, `累進` string, `出貨日` string, source_file string")
    lines = pos.clean(pos.standard(sheet))
    assert "strategy=broadcast" in lines._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["sku"], r["stock_in"], str(r["snapshot_date"])) for r in lines.collect()) == [("KA1583008", 10.0, "2024-01-09"), ("KA1583009", 4.0, "2024-01-09")]


def test_deviations_read_the_tables_once(spark):
    """after the measures are kept, no pass reads the sales lines again."""
    from selvage.plans import findings

    assert not [f for f in findings.deviation(spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]
