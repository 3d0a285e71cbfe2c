"""Season tables: key figures, comparisons over years, terms and months, overlaps, champions, and the range plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.columns import ratio


def weighted_rate() -> Column:
    """1 - left / put in, over a group."""
    return 1 - ratio(F.sum("stock_left"), F.sum("stock_in"))


def with_stock_left(df: DataFrame) -> DataFrame:
    return df.withColumn("stock_left", F.col("stock_in") - F.col("net_sales_qty"))


def kpis(df: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    """Styles, sums, weighted and mean rate of each group."""
    out = with_stock_left(df).groupBy(*keys).agg(
        F.countDistinct("sku").alias("n_styles"),
        F.count("*").alias("n_rows"),
        F.sum("stock_in").alias("stock_in"),
        F.sum("net_sales_qty").alias("net_sales_qty"),
        F.bround(weighted_rate(), 6).alias("weighted_rate"),
        F.bround(F.avg("sell_through_rate"), 6).alias("mean_rate"),
    )
    return out.where(F.col("n_rows") >= least)


def year_over_year(seasons: DataFrame) -> DataFrame:
    """Each season against the one before it. One row for each season: the window is over the seasons only."""
    before = Window.partitionBy(F.lit(0)).orderBy("season")
    out = seasons.withColumn("previous", F.lag("season").over(before)).withColumn("_rate", F.lag("weighted_rate").over(before)).withColumn("_stock", F.lag("stock_in").over(before))
    return out.where("previous is not null").select("season", "previous", F.bround(F.col("weighted_rate") - F.col("_rate"), 6).alias("rate_change"), F.bround(ratio(F.col("stock_in") - F.col("_stock"), "_stock"), 6).alias("stock_change"))


def overlaps(lines: DataFrame, group: str = "category") -> DataFrame:
    """Days that a season's sales and the next season's, of one group, overlap."""
    spans = lines.groupBy(group, "season").agg(F.min("ship_date").alias("d0"), F.max("ship_date").alias("d1"))
    order = Window.partitionBy(group).orderBy("season")
    spans = spans.withColumns({"next_season": F.lead("season").over(order), "_d0": F.lead("d0").over(order), "_d1": F.lead("d1").over(order)})
    days = F.greatest(F.datediff(F.least("d1", "_d1"), F.greatest("d0", "_d0")), F.lit(0)).cast("long")
    return spans.where("next_season is not null").select(group, "season", "next_season", days.alias("overlap_days"))


def champions(df: DataFrame, keys: list[str], top: int, rate: float | None = None, quantity: float = 0) -> DataFrame:
    """The `top` rows of each group by rate, then quantity, among those with the rate and quantity at least."""
    rows = df.where((F.col("net_sales_qty") >= quantity) & (F.col("sell_through_rate") >= rate if rate is not None else F.lit(True)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sell_through_rate"), F.desc("net_sales_qty"), "sku", "season"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= top).select(*dict.fromkeys([*keys, "place", "sku", "season", "net_sales_qty"]), F.bround("sell_through_rate", 6).alias("sell_through_rate"))


def term_gaps(cells: DataFrame) -> DataFrame:
    """cells: category, term, n_rows, stock_in, mean_rate. Share of a term's stock, the term's mean rate weighted by rows, and the gap to it."""
    term = Window.partitionBy("term")
    mean = F.sum(F.col("mean_rate") * F.col("n_rows")).over(term) / F.sum("n_rows").over(term)
    gap = F.col("mean_rate") - mean
    return cells.select("category", "term", "n_rows", F.bround(F.col("stock_in") / F.sum("stock_in").over(term), 6).alias("stock_share"), F.bround(mean, 6).alias("term_mean"), F.bround(gap * 100, 4).alias("gap_points"), (gap < 0).alias("below"))


def term_separation(cells: DataFrame, term: int) -> DataFrame:
    """For each category, whether a term's rates lie wholly below those of the other terms, and the mean gap. cells: also by season."""
    own, rest = F.when(F.col("term") == term, F.col("mean_rate")), F.when(F.col("term") != term, F.col("mean_rate"))
    out = cells.groupBy("category").agg(F.max(own).alias("_top"), F.min(rest).alias("_low"), F.bround(F.avg(own) - F.avg(rest), 6).alias("mean_gap"), F.count(own).alias("n_term"), F.count(rest).alias("n_rest"))
    return out.withColumn("separated", F.col("_top") < F.col("_low")).drop("_top", "_low")


def shelf_window(df: DataFrame, long_weeks: float = 52) -> DataFrame:
    """Whether time on the shelf explains the rate: correlation, and the means on both sides of `long_weeks`."""
    long, short = F.col("weeks_on_sale") >= long_weeks, F.col("weeks_on_sale") < long_weeks
    out = df.groupBy("category").agg(
        F.count("*").alias("n"),
        F.bround(F.corr("weeks_on_sale", "sell_through_rate"), 4).alias("correlation"),
        F.bround(F.avg(F.when(long, F.col("sell_through_rate"))), 6).alias("mean_long"),
        F.bround(F.avg(F.when(short, F.col("sell_through_rate"))), 6).alias("mean_short"),
    )
    return out.withColumn("verdict", F.when(F.abs("correlation") < 0.3, "time does not explain it").otherwise("time matters"))


def reallocation(cells: DataFrame, term: int) -> DataFrame:
    """Units that a term's stock would have sold at the other terms' weighted rate of the category. cells: category, term, stock_in, net_sales_qty."""
    own = lambda c: F.sum(F.when(F.col("term") == term, F.col(c)).otherwise(0.0))
    rest = lambda c: F.sum(F.when(F.col("term") != term, F.col(c)).otherwise(0.0))
    out = cells.groupBy("category").agg(own("stock_in").alias("term_stock"), own("net_sales_qty").alias("term_sold"), F.bround(ratio(rest("net_sales_qty"), rest("stock_in")), 6).alias("other_rate"))
    return out.withColumn("would_sell", F.bround(F.col("term_stock") * F.col("other_rate"), 2)).withColumn("gain", F.bround(F.col("term_stock") * F.col("other_rate") - F.col("term_sold"), 2))


def consistent_categories(gaps: DataFrame) -> DataFrame:
    """For each category, in how many terms it lies above the term's mean, and its mean gap."""
    return gaps.groupBy("category").agg(F.count("*").alias("n_terms"), F.count_if(F.col("gap_points") > 0).alias("n_above"), F.bround(F.avg("gap_points"), 3).alias("mean_gap_points"))
