"""Relative grades within season and category, and audits of what is left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.columns import with_medians

BANDS = ["STAR", "CORE", "STEADY", "SLOW", "EXCLUDED"]
MIN_STOCK, MIN_WEEKS = 30, 4


def eligible() -> Column:
    """What may be graded: no gift, no sample, enough stock and time, and a known rate."""
    return ~F.col("is_gift") & ~F.col("is_sample") & (F.col("stock_in") >= MIN_STOCK) & (F.col("weeks_on_sale") >= MIN_WEEKS) & F.col("sell_through_rate").isNotNull()


def grade(master: DataFrame, by: tuple[str, ...] = ("season", "category"), metric: str = "sell_through_rate") -> DataFrame:
    """master with the percentile rank of the metric among eligible rows of the group, the band, and the group's sizes."""
    rows = master.withColumn("_ok", F.coalesce(eligible(), F.lit(False)))
    # ranks and sizes come from one count of rows by value
    cells = rows.groupBy(*by, "_ok", metric).agg(F.count("*").alias("_ties"))
    group, ranked = Window.partitionBy(*by), Window.partitionBy(*by, "_ok")
    before = F.sum("_ties").over(ranked.orderBy(metric).rowsBetween(Window.unboundedPreceding, -1))
    p = F.when(F.col("_ok"), (F.coalesce(before, F.lit(0)) + 1 + (F.col("_ties") - 1) / 2) / F.sum("_ties").over(ranked))
    band = F.when(p.isNull(), "EXCLUDED").when(p >= 0.8, "STAR").when(p >= 0.5, "CORE").when(p >= 0.2, "STEADY").otherwise("SLOW")
    eligible_n = F.sum(F.when(F.col("_ok"), F.col("_ties")).otherwise(0)).over(group)
    graded = cells.select(
        *[F.col(k).alias(f"_k{n}") for n, k in enumerate((*by, "_ok", metric))], F.bround(p, 4).alias("perf_pct"), band.alias("perf_band"), F.sum("_ties").over(group).alias("perf_group_n"), eligible_n.alias("perf_group_n_eligible"),
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate((*by, "_ok", metric))])
    out = rows.join(graded, same).drop("_ok", *[f"_k{n}" for n in range(len(by) + 2)])
    return out.withColumn("perf_reliable", F.col("perf_group_n") >= 10)


def summary_by_group(graded: DataFrame, by: tuple[str, ...] = ("season", "category")) -> DataFrame:
    """Styles, sums and medians of each group, and the styles of each band in columns of their own."""
    found = graded.groupBy(*by).agg(
        F.countDistinct("sku").alias("n_styles"),
        F.sum("stock_in").alias("stock_in"),
        F.sum("net_sales_qty").alias("net_sales_qty"),
        *[F.countDistinct(F.when(F.col("perf_band") == b, F.col("sku"))).alias(b.lower()) for b in BANDS],
    )
    found = with_medians(found, graded, list(by), {"median_sell_through": "sell_through_rate", "median_weeks": "weeks_on_sale"})
    return found.withColumns({m: F.bround(m, 4) for m in ("median_sell_through", "median_weeks")})


def top_and_bottom(graded: DataFrame, n: int = 20, by: str = "category") -> DataFrame:
    """The n best and the n worst of each group, ties by sku and season."""
    rows = graded.where(F.col("perf_band") != "EXCLUDED").select(by, "sku", "season", "sell_through_rate", "perf_band")
    out = None
    for side, order in (("top", F.desc("sell_through_rate")), ("bottom", F.asc("sell_through_rate"))):
        place = F.row_number().over(Window.partitionBy(by).orderBy(order, "sku", "season"))
        part = rows.withColumn("place", place.cast("long")).where(F.col("place") <= n).withColumn("side", F.lit(side))
        out = part if out is None else out.unionByName(part)
    return out


EXCLUSIONS = [("gift", "is_gift"), ("sample", "is_sample"), ("low_stock", f"stock_in < {MIN_STOCK}"), ("too_new", f"weeks_on_sale < {MIN_WEEKS}"), ("no_rate", "sell_through_rate is null")]


def exclusion_audit(master: DataFrame) -> DataFrame:
    """Rows that each rule excludes (they overlap), and their share."""
    counts = master.agg(F.count("*").alias("n_all"), *[F.count_if(F.expr(rule)).alias(name) for name, rule in EXCLUSIONS])
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name, _ in EXCLUSIONS]))
    return counts.select("n_all", pairs.alias("p")).select("p.rule", "p.n", F.bround(F.try_divide("p.n", "n_all"), 6).alias("share"))


def filter_audit(master: DataFrame) -> DataFrame:
    """Rows by the first rule that drops them, in order; what passes is "kept"."""
    first = F.lit("kept")
    for name, rule in reversed(EXCLUSIONS):
        first = F.when(F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)).otherwise(first)
    return master.groupBy(first.alias("first_rule")).agg(F.count("*").alias("n"), F.sum("stock_in").alias("stock_in"))


def filter_for_analysis(master: DataFrame, least: float = MIN_STOCK) -> DataFrame:
    """The rows that reports look at."""
    return master.where(~F.col("is_gift") & ~F.col("is_sample") & (F.col("stock_in") >= least) & F.col("sell_through_rate").isNotNull())
