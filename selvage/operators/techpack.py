"""Spec sheets as cells (file, row, column, text): measures, metadata and notes, without a loop over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.columns import date_of, map_of, number_of, plain_text


def _size(text_: Column, sizes: list[str]) -> Column:
    """The text as the name of a size (a size word or a number of two digits), else null."""
    text = F.upper(F.trim(text_))
    return F.when(text.isin([s.upper() for s in sizes]) | text.rlike(r"^\d{2}$"), text)


def _base_order(col: Column, q: Column, place: Column, n: Column) -> list[Column]:
    """What orders the sizes of a sheet: the largest quantity first, then the nearest to the middle one, then the column."""
    return [q.isNull().alias("_none"), (~F.isnan(q)).alias("_real"), (-q).alias("_less"), F.abs(place - F.floor((n + 1) / 2)).alias("_middle"), col.alias("col")]


def size_columns(cells: DataFrame, sizes: list[str], least: int = 2) -> DataFrame:
    """file, row, col, size: the first row of each file that names `least` sizes or more (size words or numbers of two digits)."""
    named = cells.select("file", "row", "col", _size(F.col("text"), sizes).alias("size")).where("size is not null")
    rows = named.groupBy("file", "row").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).groupBy("file").agg(F.min("row").alias("row"))
    return named.join(rows, ["file", "row"])


def base_size(cells: DataFrame, columns: DataFrame, quantity_labels: list[str]) -> DataFrame:
    """file, size, col: the size with the largest ordered quantity, else the middle one."""
    labels = F.array(*[F.lit(x) for x in quantity_labels])
    rows = cells.where(F.array_contains(labels, plain_text(F.col("text")))).select("file", F.col("row").alias("_row")).groupBy("file").agg(F.min("_row").alias("_row"))
    amounts = cells.join(rows, "file").where(F.col("row") == F.col("_row")).select("file", "col", number_of(F.col("text")).alias("_q"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("col"))
    sized = columns.select("file", "col", "size").withColumn("_at", place).withColumn("_n", F.count("*").over(Window.partitionBy("file"))).join(amounts, ["file", "col"], "left")
    middle = F.abs(F.col("_at") - F.floor((F.col("_n") + 1) / 2))
    best = Window.partitionBy("file").orderBy(F.desc_nulls_last("_q"), middle, "col")
    return sized.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("file", "size", "col")


def base_sizes(cells: DataFrame, sizes: list[str], quantity_labels: list[str], least: int = 2) -> DataFrame:
    """base_size() with the columns of size_columns(): the cells go through one exchange by file, and what rows and columns hold comes from windows within a file, without joins."""
    quantity = F.coalesce(plain_text(F.col("text")).isin(quantity_labels), F.lit(False))
    marked = cells.select("file", "row", "col", "text", _size(F.col("text"), sizes).alias("size"), quantity.alias("_quantity")).repartition("file")
    sheet, column = Window.partitionBy("file"), Window.partitionBy("file", "col")
    marked = marked.sortWithinPartitions("file", "row").withColumn("_named", F.count("size").over(Window.partitionBy("file", "row")))
    marked = marked.withColumns({"_sizes": F.min(F.when(F.col("size").isNotNull() & (F.col("_named") >= least), F.col("row"))).over(sheet), "_amounts": F.min(F.when(F.col("_quantity"), F.col("row"))).over(sheet)})
    told = F.when(F.col("row") == F.col("_sizes"), F.col("size"))
    few = marked.where((F.col("size").isNotNull() & (F.col("row") == F.col("_sizes"))) | (F.col("row") == F.col("_amounts")))
    few = few.select("file", "col", told.alias("size"), F.when(F.col("row") == F.col("_amounts"), number_of(F.col("text"))).alias("_q")).sortWithinPartitions("file", "col")
    sized = few.withColumn("_q", F.max("_q").over(column)).where("size is not null")
    sized = sized.withColumns({"_at": F.row_number().over(sheet.orderBy("col")), "_n": F.count("*").over(sheet)})
    best = sized.groupBy("file").agg(F.min(F.struct(*_base_order(F.col("col"), F.col("_q"), F.col("_at"), F.col("_n")), F.col("size").alias("size"))).alias("_b"))
    return best.select("file", "_b.size", "_b.col")


def _label(aliases: dict[str, list[str]]) -> Column:
    """The name whose labels hold a cell's text, else null."""
    return map_of(plain_text(F.col("text")), {word: name for name, words in aliases.items() for word in words})


def labelled(cells: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """file, row, col, measure: the cells whose text is a label of a measure."""
    return cells.select("file", "row", "col", _label(aliases).alias("measure")).where("measure is not null")


def _next(when: Column, at: str, *found: Column, along: str) -> Column:
    """The nearest cell behind a cell, along its row or its column, that `when` admits: its place and `found`."""
    behind = Window.partitionBy("file", along).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(when, F.struct(F.col(at).alias("at"), *found)), ignorenulls=True).over(behind)


def harvest(cells: DataFrame, aliases: dict[str, list[str]], sizes: list[str], quantity_labels: list[str], least: int = 2) -> DataFrame:
    """file, measure, value: under the base size in the label's row; else the first number right of the label; else the first below it.

    The cells go through one exchange by file. A file's cells are ordered twice, by rows and by columns, each from its end,
    so that the next number right of a label and below it is the last one met; the base size comes along."""
    text = F.col("text")
    marked = cells.select("file", "row", "col", number_of(text).alias("value"), _label(aliases).alias("measure"), _size(text, sizes).isNotNull().alias("_size"), F.coalesce(plain_text(text).isin(quantity_labels), F.lit(False)).alias("_quantity")).repartition("file")
    sheet, line, column = Window.partitionBy("file"), Window.partitionBy("file", "row"), Window.partitionBy("file", "col")
    number, label = F.col("value").isNotNull(), F.col("measure").isNotNull()
    across = marked.sortWithinPartitions("file", "row", F.desc("col"))
    across = across.withColumn("_right", F.when(label, _next(number, "col", F.col("value"), along="row"))).withColumn("_named", F.count_if(F.col("_size")).over(line))
    across = across.withColumns({"_sizes": F.min(F.when(F.col("_size") & (F.col("_named") >= least), F.col("row"))).over(sheet), "_amounts": F.min(F.when(F.col("_quantity"), F.col("row"))).over(sheet)})
    across = across.select("file", "row", "col", "value", "measure", "_right", (F.col("_size") & (F.col("row") == F.col("_sizes"))).alias("_sized"), (F.col("row") == F.col("_amounts")).alias("_amount"))
    down = across.sortWithinPartitions("file", "col", F.desc("row"))
    down = down.withColumn("_below", F.when(label, _next(number, "row", F.col("value"), along="col"))).withColumn("_q", F.max(F.when(F.col("_amount"), F.col("value"))).over(column))
    down = down.withColumns({"_at": F.count_if(F.col("_sized")).over(sheet.orderBy("col").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.count_if(F.col("_sized")).over(sheet)})
    down = down.withColumn("_base", F.min(F.when(F.col("_sized"), F.struct(*_base_order(F.col("col"), F.col("_q"), F.col("_at"), F.col("_n"))))).over(sheet)["col"])
    few = down.where(label | (number & (F.col("col") == F.col("_base")))).select("file", "row", "col", "value", "measure", "_right", "_below", "_base")
    few = few.withColumn("_under", F.max(F.when(F.col("col") == F.col("_base"), F.col("value"))).over(line)).where(label)
    at = lambda rank, place, value: F.struct(F.lit(rank).alias("rank"), F.col("row").alias("row"), place.cast("long").alias("at"), value.alias("value"))
    beside = F.when(F.col("_under").isNotNull() & (F.col("_base") > F.col("col")), at(0, F.col("_base"), F.col("_under")))
    offers = [beside, *[F.when(F.col(c).isNotNull(), at(n, F.col(f"{c}.at"), F.col(f"{c}.value"))) for n, c in ((1, "_right"), (2, "_below"))]]
    return few.groupBy("file", "measure").agg(F.min(F.coalesce(*offers)).alias("_o")).where("_o is not null").select("file", "measure", "_o.value")


def measures_wide(harvested: DataFrame, measures: list[str]) -> DataFrame:
    """One row for each file, a column for each measure, and how many there are."""
    wide = harvested.groupBy("file").pivot("measure", measures).agg(F.first("value"))
    return wide.withColumn("extract_fields", sum((F.col(m).isNotNull().cast("int") for m in measures), F.lit(0)))


def metadata(cells: DataFrame, labels: dict[str, tuple[list[str], str]], reach: int = 3) -> DataFrame:
    """file, name, text, number, date: the value right of a label (at most `reach` cells), or below it if there is none; typed by the label's kind (text, number, date)."""
    marked = cells.select("file", "row", "col", F.trim("text").alias("text"), _label({name: words for name, (words, _) in labels.items()}).alias("name")).repartition("file")
    label = F.col("name").isNotNull()
    value = ~label & (F.col("text") != "")
    across = marked.sortWithinPartitions("file", "row", F.desc("col")).withColumn("_right", F.when(label, _next(value, "col", F.col("text"), along="row")))
    down = across.sortWithinPartitions("file", "col", F.desc("row")).withColumn("_below", F.when(label, _next(value, "row", F.col("text"), along="col"))).where(label)
    at = lambda rank, c, own: F.when(F.col(f"{c}.at") - F.col(own) <= reach, F.struct(F.lit(rank).alias("rank"), F.col("row").alias("row"), F.col(f"{c}.at").alias("at"), F.col(f"{c}.text").alias("text")))
    best = down.groupBy("file", "name").agg(F.min(F.coalesce(at(0, "_right", "col"), at(1, "_below", "row"))).alias("_o")).where("_o is not null").select("file", "name", "_o.text")
    of = lambda kind: F.col("name").isin([n for n, (_, k) in labels.items() if k == kind])
    return best.select("file", "name", "text", F.when(of("number"), number_of(F.col("text"))).alias("number"), F.when(of("date"), date_of(F.col("text"))).alias("date"))


def keyword_vocabulary(cells: DataFrame, keywords: list[str], longest: int = 60) -> DataFrame:
    """Short texts that hold a keyword: how often, and in how many files."""
    hits = F.filter(F.array(*[F.when(F.col("text").contains(k), F.lit(k)) for k in keywords]), lambda k: k.isNotNull())
    long = cells.where(F.length("text") <= longest).select("file", F.trim("text").alias("snippet"), F.explode(hits).alias("keyword"))
    return long.groupBy("keyword", "snippet").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"))


def keyword_coverage(cells: DataFrame, keywords: list[str]) -> DataFrame:
    """For each keyword, the share of files that hold it."""
    counts = cells.agg(F.countDistinct("file").alias("_all"), *[F.countDistinct(F.when(F.col("text").contains(k), F.col("file"))).alias(f"k{n}") for n, k in enumerate(keywords)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"k{n}").alias("n_files")) for n, k in enumerate(keywords)]))
    return counts.select("_all", pairs.alias("p")).select("p.keyword", "p.n_files", F.bround(F.try_divide("p.n_files", "_all"), 6).alias("share"))


def notes(cells: DataFrame, rules: dict[str, list[tuple[str, str]]], noise: str | None = None) -> DataFrame:
    """One row for each file: for each kind of note the labels of the patterns that match, in order, joined."""
    text = F.regexp_replace("text", noise, "") if noise else F.col("text")
    rows = cells.withColumn("_t", text)
    out = []
    for kind, patterns in rules.items():
        seen = [F.when(F.max(F.col("_t").rlike(p).cast("int")) == 1, F.lit(label)) for p, label in patterns]
        out.append(F.concat_ws("、", *seen).alias(kind))
    return rows.groupBy("file").agg(*out)


def code_notations(cells: DataFrame, patterns: dict[str, str], samples: int = 12) -> DataFrame:
    """How often each notation of colour codes comes, in how many files, and some samples."""
    parts = None
    for name, pattern in patterns.items():
        hits = cells.select("file", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("hit")).withColumn("notation", F.lit(name))
        parts = hits if parts is None else parts.unionByName(hits)
    counted = parts.groupBy("notation", "hit").agg(F.count("*").alias("_n"), F.min("file").alias("_f"))
    first = counted.withColumn("_p", F.row_number().over(Window.partitionBy("notation").orderBy(F.desc("_n"), "hit"))).where(F.col("_p") <= samples)
    shown = first.groupBy("notation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "hit"))), lambda x: x["hit"]), " ").alias("samples"))
    return parts.groupBy("notation").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files")).join(shown, "notation")


def best_code_column(df: DataFrame, parse, least: int = 3) -> str | None:
    """The column with the most values that parse as codes, if there are `least`; of several the first."""
    if not df.columns:
        return None
    hits = df.agg(*[F.count(parse(F.col(f"`{c}`").cast("string"))).alias(f"c{n}") for n, c in enumerate(df.columns)]).first()
    n = max(range(len(df.columns)), key=lambda i: (hits[i], -i))
    return df.columns[n] if hits[n] >= least else None


def attach_colours(items: DataFrame, codes: DataFrame, sku: str = "sku") -> DataFrame:
    """items with the colours of their style, in order, and how many. codes: style, color."""
    by_style = codes.groupBy(F.col("style").alias(sku)).agg(F.array_join(F.array_sort(F.collect_set("color")), ",").alias("colors"), F.countDistinct("color").alias("n_colors"))
    return items.join(by_style, sku, "left").withColumn("n_colors", F.coalesce("n_colors", F.lit(0)))


def variants(text: Column) -> Column:
    """Array of colour, size and quantity of "藍/S:3；藍/白/L:2": the last stroke and the last colon part them."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "[；;]"), lambda x: F.trim(x) != "")
    one = lambda x, n: F.nullif(F.regexp_extract(F.trim(x), r"^(.*?)(?:/([^/:]*))?(?::(-?\d+))?$", n), F.lit(""))
    return F.transform(parts, lambda x: F.struct(one(x, 1).alias("color"), one(x, 2).alias("size"), one(x, 3).try_cast("int").alias("quantity")))


def one_off(a: Column, b: Column) -> Column:
    """Whether two texts of one length differ by one character or by two neighbours that changed places."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    different = F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))), lambda p: p["x"] != p["y"])
    one, two = F.get(different, 0), F.get(different, 1)
    turned = (F.size(different) == 2) & (two["i"] == one["i"] + 1) & (one["x"] == two["y"]) & (one["y"] == two["x"])
    return (F.length(a) == F.length(b)) & ((F.size(different) == 1) | F.coalesce(turned, F.lit(False)))
