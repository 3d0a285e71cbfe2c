"""Carry-over candidates, the year's plan, recipes and outfits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.columns import pct_rank, settled

#: Fixed: selling waves (code, first week, last week) and the shares of a year's styles by category used without a mix.
WAVES = [("SS-EARLY", 1, 6), ("SS-MAIN", 7, 18), ("SS-LATE", 19, 26), ("AW-EARLY", 27, 35), ("AW-MAIN", 36, 45), ("AW-LATE", 46, 52)]


def carryover_candidates(graded: DataFrame, top: int = 60) -> DataFrame:
    """Best row of each style by .5 rank(rate) + .3 rank(price kept) - .2 rank(discount), the `top` of them."""
    rows = graded.where(F.col("perf_band").isin("STAR", "CORE")).select("sku", "season", "category", "sell_through_rate", "avg_selling_price", "discount_depth")
    rows = settled(rows).withColumns({"_r": F.bround("sell_through_rate", 6), "_p": F.bround("avg_selling_price", 2), "_d": F.bround("discount_depth", 4)})
    for c in ("_r", "_p", "_d"):
        rows = pct_rank(rows, [], c, f"{c}k")
    score = F.bround(0.5 * F.coalesce("_rk", F.lit(0.0)) + 0.3 * F.coalesce("_pk", F.lit(0.0)) - 0.2 * F.coalesce("_dk", F.lit(0.0)), 6)
    best = rows.withColumn("score", score).groupBy("sku").agg(F.max_by(F.struct("season", "category", "score"), F.struct("score", -F.col("season"))).alias("b"))
    return best.select("sku", "b.*").orderBy(F.desc("score"), "sku").limit(top)


def year_plan(graded: DataFrame, styles: int = 450, new: float = 0.65) -> DataFrame:
    """Styles of each wave and category: waves by their weeks, categories by their share of styles; new and carried over."""
    mix = graded.groupBy("category").agg(F.countDistinct("sku").alias("_n"))
    mix = mix.withColumn("share", F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(0))))  # a row for each category
    waves = F.explode(F.array(*[F.struct(F.lit(code).alias("wave"), F.lit(b - a + 1).alias("weeks")) for code, a, b in WAVES]))
    out = mix.select("category", "share", waves.alias("w")).select("category", "share", "w.*")
    n = F.bround(F.lit(float(styles)) * F.col("weeks") / 52 * F.col("share"), 0)
    out = out.withColumn("n_styles", n.cast("long")).withColumn("n_new", F.bround(n * new, 0).cast("long"))
    return out.select("wave", "category", F.bround("share", 6).alias("share"), "n_styles", "n_new", (F.col("n_styles") - F.col("n_new")).alias("n_carry"))


def wave_of(week: Column) -> Column:
    """The wave of a week of the year, by its range; a 53rd week belongs to the last."""
    wave = F.lit(None).cast("string")
    for code, a, b in WAVES:
        wave = F.when(F.least(week, F.lit(52)).between(a, b), code).otherwise(wave)
    return wave


def winning_recipe(association: DataFrame, by: str = "category", top: int = 2) -> DataFrame:
    """The `top` options of each attribute that raise success most, among those with a lift over 1."""
    place = F.row_number().over(Window.partitionBy(by, "attribute").orderBy(F.desc("lift"), "option"))
    return association.where("lift > 1").withColumn("place", place.cast("long")).where(F.col("place") <= top).select(by, "attribute", "place", "option", "n", "lift")


def risk_list(association: DataFrame, below: float = 0.8) -> DataFrame:
    return association.where(F.col("lift") < below).select("category", "attribute", "option", "n", "lift")


def outfits(tops: DataFrame, bottoms: DataFrame, per_bottom: int = 3) -> DataFrame:
    """Pairs tops with bottoms in turn: bottom b gets the tops per_bottom * b + 0, 1, ... modulo their number. tops and bottoms: short lists with sku and place from 0."""
    n = max(1, tops.count())
    slots = bottoms.select(F.col("sku").alias("bottom"), "place", F.explode(F.sequence(F.lit(0), F.lit(per_bottom - 1))).alias("k"))
    slots = slots.withColumn("_at", (F.col("place") * per_bottom + F.col("k")) % n)
    return slots.join(tops.select(F.col("sku").alias("top"), F.col("place").alias("_at")), "_at").select("bottom", "k", "top")


def week_plan(graded: DataFrame, association: DataFrame, styles: int = 12, new: float = 0.65) -> DataFrame:
    """New styles of one week: categories by their share, largest first; the k-th style of a category takes the k-th best option of each attribute (or the last there is)."""
    n_new = int(round(styles * new))
    mix = graded.groupBy("category").agg(F.countDistinct("sku").alias("_n")).withColumn("_share", F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(0))))
    seats = mix.withColumn("_seats", F.greatest(F.bround(F.col("_share") * n_new, 0).cast("int"), F.lit(1)))
    slots = seats.select("category", "_share", F.explode(F.sequence(F.lit(1), F.col("_seats"))).alias("k"))
    order = Window.partitionBy(F.lit(0)).orderBy("k", F.desc("_share"), "category")  # a row for each style of a week
    slots = slots.withColumn("seq", F.row_number().over(order).cast("long")).where(F.col("seq") <= n_new)
    recipe = winning_recipe(association, top=3)
    depth = recipe.groupBy("category", "attribute").agg(F.max("place").alias("_deep"))
    chosen = slots.join(depth, "category").withColumn("place", F.least(F.col("k").cast("long"), F.col("_deep"))).join(recipe, ["category", "attribute", "place"])
    told = F.transform(F.array_sort(F.collect_list(F.struct("attribute", "option"))), lambda x: F.concat(x["attribute"], F.lit("="), x["option"]))
    designs = chosen.groupBy("seq").agg(F.array_join(told, " / ").alias("design"))
    return slots.select("seq", "category").join(designs, "seq", "left").withColumn("design", F.coalesce("design", F.lit("free")))
