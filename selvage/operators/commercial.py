"""Reports by product line, price band, launch month and designer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.columns import bin_of, quantile_edges


def perf_aggs() -> list[Column]:
    """The columns that every report row has."""
    n = F.count("*")
    return [
        n.alias("n"),
        F.bround(F.median("sell_through_rate"), 4).alias("median_sell_through"),
        F.bround(F.avg((F.col("perf_band") == "STAR").cast("double")), 4).alias("star_rate"),
        F.bround(F.avg((F.col("perf_band") == "SLOW").cast("double")), 4).alias("slow_rate"),
        F.bround(F.median("list_price"), 2).alias("median_price"),
        F.sum("stock_in").alias("stock_in"),
        F.when(n >= 30, "strong").when(n >= 10, "fair").otherwise("weak").alias("evidence"),
    ]


def active(graded: DataFrame) -> DataFrame:
    return graded.where(F.col("perf_band") != "EXCLUDED")


def product_line_report(graded: DataFrame, line: str = "category", sub: str = "sub_category", least: int = 4) -> DataFrame:
    """Each line, and each part of it with `least` rows or more, in one pass over grouping sets."""
    rows = active(graded)
    level = F.when(F.grouping_id() == 0, 2).otherwise(1).cast("long")
    sets = rows.groupingSets([[F.col(line)], [F.col(line), F.col(sub)]], F.col(line), F.col(sub))
    return sets.agg(level.alias("level"), *perf_aggs()).where((F.col("level") == 1) | (F.col("n") >= least))


def price_band_report(graded: DataFrame, by: str = "category", bands: int = 5, least: int = 30) -> DataFrame:
    """Quantile bands of the price within each group."""
    rows = active(graded)
    edges = quantile_edges(rows, [by], "list_price", bands, least)
    banded = rows.join(F.broadcast(edges), by).withColumn("price_band", bin_of(F.col("list_price"), F.col("_edges")).cast("long"))  # one row for each group
    return banded.groupBy(by, "price_band").agg(F.min("list_price").alias("low"), F.max("list_price").alias("high"), *perf_aggs())


def launch_timing_report(graded: DataFrame, by: str = "category", least: int = 8) -> DataFrame:
    """Launch months of each group with `least` rows or more, ranked by their median within the group."""
    months = active(graded).withColumn("launch_month", F.month("first_sale_date").cast("long")).groupBy(by, "launch_month").agg(*perf_aggs()).where(F.col("n") >= least)
    group = Window.partitionBy(by)
    ties = F.count("*").over(Window.partitionBy(by, "median_sell_through"))
    rank = F.rank().over(group.orderBy(F.desc("median_sell_through"))) + (ties - 1) / 2
    return months.withColumn("rank_in_group", F.floor(rank).cast("long"))


def timing_impact(timing: DataFrame, by: str = "category", least: int = 3) -> DataFrame:
    """Best against worst launch month of each group."""
    key = F.struct("median_sell_through", -F.col("launch_month"))
    low = F.struct("median_sell_through", F.col("launch_month"))
    out = timing.groupBy(by).agg(
        F.count("*").alias("n_months"),
        F.max_by("launch_month", key).alias("best_month"),
        F.min_by("launch_month", low).alias("worst_month"),
        F.bround(F.max("median_sell_through") - F.min("median_sell_through"), 4).alias("spread"),
    )
    verdict = F.when(F.col("spread") >= 0.15, "strong").when(F.col("spread") >= 0.08, "visible").otherwise("weak")
    return out.where(F.col("n_months") >= least).withColumn("impact", verdict)


def designer_report(graded: DataFrame, by: str = "designer", least: int = 20, top: int = 3) -> DataFrame:
    """Designers with `least` rows or more, with their `top` categories by rows."""
    rows = active(graded)
    mix = rows.groupBy(by, "category").agg(F.count("*").alias("_n"))
    ordered = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), "category"))), 1, top)
    told = mix.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["category"], F.lit(":"), (-x["n"]).cast("string"))), " ").alias("category_mix"))
    return rows.groupBy(by).agg(*perf_aggs()).where(F.col("n") >= least).join(told, by)
