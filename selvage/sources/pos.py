"""Sales sheets (CSV, Parquet, Excel) with unknown headers: resolved, typed and cleaned."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.functions.columns import date_of, first_match, number_of, plain_text
from selvage.operators.stock import design_family_key
from selvage.sources import excel, files

#: Fixed: standard columns, each with the headers that mean it, the first that is there wins.
ALIASES = {
    "sku": ["貨號", "商品編號", "品號", "料號", "sku", "item_no", "itemno", "商品貨號"],
    "style_code": ["款號", "款式編號", "style", "style_no", "stylecode"],
    "product_name": ["品名", "商品名稱", "商品名", "name", "描述"],
    "designer": ["設計師", "設計", "designer"],
    "rank": ["名次", "排名", "rank"],
    "category": ["品類", "類別", "大類", "商品分類", "category", "class"],
    "sub_category": ["中類", "小類", "次分類", "sub_category"],
    "season": ["季別", "年季", "季節", "波段", "season"],
    "color": ["顏色", "色號", "色彩", "color", "colour"],
    "size": ["尺寸", "尺碼", "size"],
    "list_price": ["定價", "售價", "原價", "牌價", "list_price", "price", "零售價"],
    "avg_selling_price": ["平均售價", "實際售價", "均價", "asp"],
    "cost": ["成本", "進價", "cost"],
    "stock_in": ["累進", "進貨量", "進貨數", "入庫量", "採購數量", "訂購量", "stock_in", "qty_in"],
    "sales_qty": ["總銷", "銷售量", "銷貨數量", "出貨數", "sales_qty", "qty_sold"],
    "sales_qty_alt": ["銷量"],
    "return_qty": ["退貨量", "退貨數", "return_qty"],
    "sales_amount": ["銷貨額", "銷售金額", "銷貨金額", "營業額", "sales_amount", "amount"],
    "stock_on_hand": ["總存", "庫存量", "期末庫存", "現有庫存", "stock", "on_hand"],
    "stock_on_hand_alt": ["庫存"],
    "sell_through_reported": ["銷售率", "售罄率", "sell_through"],
    "stock_ratio_reported": ["總存佔比", "庫存佔比"],
    "first_sale_date": ["入庫日", "上市日", "首賣日", "上架日", "首次銷售日", "launch_date"],
    "ship_date": ["出貨日", "配貨日"],
    "last_sale_date": ["最後銷售日", "末次銷售日", "last_sale_date"],
    "store": ["門市", "店號", "分店", "通路", "store", "channel"],
    "region": ["區域", "地區", "region"],
}
NUMBERS = ["rank", "list_price", "avg_selling_price", "cost", "stock_in", "sales_qty", "sales_qty_alt", "return_qty", "sales_amount", "stock_on_hand", "stock_on_hand_alt", "sell_through_reported", "stock_ratio_reported"]
DATES = ["first_sale_date", "ship_date", "last_sale_date"]
TEXTS = [c for c in ALIASES if c not in NUMBERS and c not in DATES]
LINES = T.StructType([T.StructField(c, T.DoubleType() if c in NUMBERS else T.DateType() if c in DATES else T.StringType()) for c in ALIASES])
#: Fixed: words of total rows; season codes, their year and term; category digits; keywords of categories in order.
TOTAL_WORDS = "合計|小計|總計|total"
TERMS = {"7": ("SS", 1), "8": ("SS", 2), "5": ("AW", 3), "6": ("AW", 4)}
CATEGORIES = {"1": "TOP", "2": "BOTTOM_PANTS", "3": "TOP", "4": "BOTTOM_SKIRT", "6": "OUTER", "7": "DRESS", "9": "TOP", "8": "GIFT"}
NAME_RULES = [("洋裝|連身裙|長洋|禮服", "DRESS"), ("外套|大衣|風衣|夾克|斗篷|羽絨", "OUTER"), ("褲裙", "BOTTOM_SKIRT"), ("褲", "BOTTOM_PANTS"), ("裙", "BOTTOM_SKIRT"), ("包|帽子|毯|保溫|傘|杯|鍋|抱枕|手機", "ACC"), ("針織|毛衣", "TOP"), ("棉T|T恤|帽T|長版T", "TOP"), ("上衣|襯衫|背心|罩衫|衫", "TOP")]


def resolve(spark: SparkSession, headers: list[str], aliases: dict[str, list[str]] = ALIASES) -> tuple[dict[str, str], list[str]]:
    """Standard name to header, each header used once; and the headers that mean nothing."""
    words = sorted({a for names in aliases.values() for a in names} | set(headers))
    plain = {r["w"]: r["p"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", plain_text(F.col("w")).alias("p")).collect()}  # headers only
    by_plain: dict[str, str] = {}
    for c in headers:
        by_plain.setdefault(plain[c], c)
    found: dict[str, str] = {}
    for name, meant in aliases.items():
        hit = next((by_plain[plain[a]] for a in meant if plain[a] in by_plain and by_plain[plain[a]] not in found.values()), None)
        if hit:
            found[name] = hit
    return found, [c for c in headers if c not in found.values()]


def resolve_headers(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> tuple[dict[str, str], list[str]]:
    return resolve(df.sparkSession, df.columns, aliases)


def _typed(field: T.StructField, c: Column | None) -> Column:
    """A cell as text under the field's name and type; what is missing is null. "68%" is .68, "1,234元" is 1234."""
    if c is None:
        return F.lit(None).cast(field.dataType).alias(field.name)
    c = c.cast("string")
    return (number_of(c) if field.name in NUMBERS else date_of(c) if field.name in DATES else F.nullif(F.trim(c), F.lit(""))).alias(field.name)


def standard(df: DataFrame, extra: tuple[str, ...] = ("source_file", "source_sheet")) -> DataFrame:
    """df under standard names and types, with those of `extra` that it has."""
    found, _ = resolve(df.sparkSession, [c for c in df.columns if c not in extra])
    return df.select(*[_typed(f, F.col(f"`{found[f.name]}`") if f.name in found else None) for f in LINES], *[c for c in extra if c in df.columns])


def season_of(sku: Column) -> Column:
    """The season code of a sku ("KA158" of "KA1583008"), else null."""
    return F.nullif(F.regexp_extract(sku, r"(KA\d{3})", 1), F.lit(""))


def season_of_path(path: Column) -> Column:
    """The season of a file: a code in its name, else in its folder's, else a year with a term in its name (2024 AW, 2024-春夏, 2024Q1), else UNKNOWN."""
    name, folder = F.regexp_extract(path, r"([^/]+)$", 1), F.regexp_extract(path, r"^(.*)/[^/]+$", 1)
    year = F.nullif(F.upper(F.regexp_replace(F.regexp_extract(name, r"(?i)(20\d{2}\s*[-_ ]?\s*(?:SS|AW|春夏|秋冬|Q[1-4]))", 1), " ", "")), F.lit(""))
    return F.coalesce(season_of(name), season_of(folder), year, F.lit("UNKNOWN"))


def season_parts(code: Column) -> Column:
    """Struct of year, group and the place of the term in its year, by the code: its middle digits give the year, its last one the term."""
    last = F.substring(code, -1, 1)
    group = order = F.lit(None)
    for digit, (name, place) in TERMS.items():
        group, order = F.when(last == digit, name).otherwise(group), F.when(last == digit, place).otherwise(order)
    year = F.regexp_extract(code, r"KA(\d\d)\d", 1).try_cast("int") + 2011
    return F.struct(year.alias("year"), group.alias("group"), order.cast("int").alias("term_order"))


def category_of(sku: Column, name: Column) -> Column:
    """By the sku's sixth character; plaid lines (5) by their second digit; else by words in the name."""
    digit, second = F.regexp_extract(sku, r"KA\d{3}(\d)", 1), F.regexp_extract(sku, r"KA\d{3}5(\d)", 1)
    code = F.when(digit == "5", second).otherwise(digit)
    out = F.lit(None).cast("string")
    for d, c in CATEGORIES.items():
        out = F.when(code == d, c).otherwise(out)
    return F.coalesce(out, first_match(F.coalesce(name, F.lit("")), NAME_RULES, "UNKNOWN"))


def clean(lines: DataFrame, pattern: str = r"^KA\d{7}$", share: float = 0.5) -> DataFrame:
    """lines without blank and total rows; only skus of the pattern, if at least `share` of the rows have one; season and
    category filled from the sku; snapshot_date is the last date of each file."""
    rows = lines.where(F.col("sku").isNotNull() & ~F.col("sku").rlike(f"(?i){TOTAL_WORDS}"))
    fits = rows.agg(F.avg(F.col("sku").rlike(pattern).cast("double"))).first()[0]
    if fits is not None and fits >= share:
        rows = rows.where(F.col("sku").rlike(pattern))
    known = F.col("category").isin(sorted(set(CATEGORIES.values()) | {"ACC"}))
    rows = rows.withColumn("style_code", F.coalesce("style_code", "sku"))
    of_file = F.nullif(season_of_path(F.col("source_file")), F.lit("UNKNOWN"))
    rows = rows.withColumn("season", F.coalesce("season", of_file, season_of(F.col("sku")), F.lit("UNKNOWN")))
    rows = rows.withColumn("category", F.when(known, F.col("category")).otherwise(category_of(F.col("sku"), F.col("product_name"))))
    rows = rows.withColumn("design_family", design_family_key(F.col("product_name"), F.col("list_price")))
    last = rows.groupBy("source_file").agg(F.max(F.greatest("first_sale_date", "ship_date")).alias("snapshot_date"))
    return rows.join(F.broadcast(last), "source_file", "left")  # one row a file; the lines stay where they are


def _listed(spark: SparkSession, paths: list[str]) -> tuple[dict[str, list[str]], list[str]]:
    """The sheets among and below the paths, by kind, and the paths where nothing is."""
    kinds: dict[str, list[str]] = {"csv": [], "parquet": [], "xlsx": []}
    missing = []
    for path in paths:
        try:
            names = [r["path"] for r in files.listing(spark, path).select("path").collect()]  # names only
        except AnalysisException:
            missing.append(path)
            continue
        for name in sorted(names):
            kind = name.rsplit(".", 1)[-1].lower().replace("xlsm", "xlsx")
            if kind in kinds:
                kinds[kind].append(name)
    return kinds, missing


def _file() -> Column:
    """The file of a row, as listings write it."""
    plain = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return F.regexp_replace(plain, "^file:/+", "file:/")


def _first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str | None]:
    """The first line of each file."""
    text = spark.read.option("ignoreCorruptFiles", True).text(paths).select("value", _file().alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    return dict(text.groupBy("file").agg(F.min_by("value", F.struct("at", "n"))).collect())  # one row a file


def load_sales(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cleaned lines of all sheets among and below the paths, and an audit of each file and sheet: OK, SKIPPED (no sku) or ERROR (not there, or nothing readable in it), its rows, and which headers meant what.

    Files of the same headers are read in one scan, and rows are counted in one pass over all. A damaged file gives no
    rows and doesn't stop the others."""
    kinds, missing = _listed(spark, paths)
    told: list[tuple[str, str, str, str, str]] = [(p, "", "not found", "", "") for p in missing]  # file, sheet, note, mapped, unmapped
    parts: list[DataFrame] = []

    def take(rows: DataFrame, headers: list[str], sheets: list[tuple[str, str]], pick) -> None:
        found, rest = resolve(spark, headers)
        note = "" if "sku" in found else "no sku column"
        told.extend((f, s, note, ", ".join(f"{k}<-{v}" for k, v in found.items()), ", ".join(rest)) for f, s in sheets)
        if not note:
            parts.append(rows.select(*[_typed(x, pick(found[x.name]) if x.name in found else None) for x in LINES], "source_file", "source_sheet"))

    lines = _first_lines(spark, kinds["csv"]) if kinds["csv"] else {}
    alike: dict[str, list[str]] = {}
    for path, line in lines.items():
        alike.setdefault(line or "", []).append(path)
    told += [(p, "", "nothing readable", "", "") for p in kinds["csv"] if p not in lines]
    for own in alike.values():
        rows = spark.read.option("ignoreCorruptFiles", True).csv(own, header=True).withColumns({"source_file": _file(), "source_sheet": F.lit("")})
        take(rows, [c for c in rows.columns if c not in ("source_file", "source_sheet")], [(p, "") for p in own], lambda c: F.col(f"`{c}`"))
    if kinds["parquet"]:
        rows = spark.read.options(ignoreCorruptFiles=True, mergeSchema=True).parquet(*kinds["parquet"]).withColumns({"source_file": _file(), "source_sheet": F.lit("")})
        take(rows, [c for c in rows.columns if c not in ("source_file", "source_sheet")], [(p, "") for p in kinds["parquet"]], lambda c: F.col(f"`{c}`"))
    if kinds["xlsx"]:
        cells = excel.read_cells(spark, kinds["xlsx"])
        told += [(r["file"], "", r["error"], "", "") for r in cells.where("error is not null").select("file", "error").collect()]
        rows = excel.with_header(cells).withColumnsRenamed({"file": "source_file", "sheet": "source_sheet"})
        by_header: dict[tuple, list] = {}
        for r in rows.select("source_file", "source_sheet", "header").distinct().collect():  # one row a sheet
            by_header.setdefault(tuple(r["header"]), []).append((r["source_file"], r["source_sheet"]))
        for header, sheets in by_header.items():
            same = rows.where(F.col("header") == F.array(*map(F.lit, header)))
            take(same, list(header), sheets, lambda c, header=header: F.get("values", header.index(c)))
    read = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], T.StructType([*LINES, T.StructField("source_file", T.StringType()), T.StructField("source_sheet", T.StringType())]))
    audit = spark.createDataFrame(told, "source_file string, source_sheet string, note string, mapped string, unmapped string")
    audit = audit.join(read.groupBy("source_file", "source_sheet").agg(F.count("*").alias("_n")), ["source_file", "source_sheet"], "left")
    n_rows = F.coalesce("_n", F.lit(0))
    status = F.when(F.col("note") == "no sku column", "SKIPPED").when((F.col("note") == "") & (n_rows > 0), "OK").otherwise("ERROR")
    note = F.when((F.col("note") == "") & (n_rows == 0), "nothing readable").otherwise(F.col("note"))
    return clean(read), audit.select("source_file", "source_sheet", status.alias("status"), n_rows.alias("n_rows"), note.alias("note"), "mapped", "unmapped")
