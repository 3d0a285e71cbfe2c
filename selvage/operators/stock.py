"""Two stocks that ought to agree, families of one design, and drift over seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.columns import narrow_forms, ratio, with_medians


def gap(df: DataFrame, book: str = "stock_on_hand", floor: str = "stock_on_hand_alt", base: str = "stock_in", units: float = 2, share: float = 0.02) -> DataFrame:
    """floor - book; they agree within `units`, or within `share` of the base."""
    diff = F.col(floor) - F.col(book)
    agrees = (F.abs(diff) <= units) | (F.abs(diff) <= share * F.col(base))
    out = df.withColumn("gap", diff).withColumn("gap_ratio", F.bround(ratio("gap", base), 6))
    return out.withColumn("direction", F.when(diff > 0, "over").when(diff < 0, "under").otherwise("equal")).withColumn("agrees", agrees)


def gap_summary(gaps: DataFrame, by: list[str]) -> DataFrame:
    return gaps.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("agrees")).alias("n_matched"),
        F.count_if(~F.col("agrees") & (F.col("gap") > 0)).alias("n_over"),
        F.count_if(~F.col("agrees") & (F.col("gap") < 0)).alias("n_under"),
        F.sum("gap").alias("net_gap"),
        F.sum(F.abs("gap")).alias("abs_gap"),
    )


def worth_counting(gaps: DataFrame, keys: list[str], top: int = 30) -> DataFrame:
    """The `top` disagreeing rows by units."""
    return gaps.where(~F.col("agrees")).orderBy(F.desc(F.abs("gap")), *keys).limit(top)


def design_family_key(name: Column, price: Column) -> Column:
    """Name (plain forms, without white space) and list price: what skus of one design have in common. Null without a name."""
    plain = F.regexp_replace(narrow_forms(name), r"\s+", "")
    return F.when(plain != "", F.concat_ws("|", plain, F.coalesce(price.cast("string"), F.lit(""))))


def reissue_families(graded: DataFrame, family: list[str], least: float = 10) -> DataFrame:
    """Designs sold as two skus or more, in two seasons or more: best and worst, their spread, and a verdict."""
    rows = graded.where((F.col("stock_in") >= least) & F.col("sell_through_rate").isNotNull())
    out = rows.groupBy(*family).agg(
        F.countDistinct("sku").alias("n_skus"),
        F.countDistinct("season").alias("n_seasons"),
        F.array_join(F.transform(F.array_sort(F.collect_set("season")), lambda s: s.cast("string")), " ").alias("seasons"),
        F.max_by("sku", F.struct("sell_through_rate", -F.col("sku"), -F.col("season"))).alias("best_sku"),
        F.min_by("sku", F.struct("sell_through_rate", "sku", "season")).alias("worst_sku"),
        F.bround(F.max("sell_through_rate") - F.min("sell_through_rate"), 6).alias("spread"),
        F.sum("stock_in").alias("stock_in"),
    )
    out = out.where((F.col("n_skus") >= 2) & (F.col("n_seasons") >= 2))
    return out.withColumn("verdict", F.when(F.col("spread") >= 0.3, "timing or season").otherwise("design is stable"))


def drift(df: DataFrame, metric: str, by: str = "category") -> DataFrame:
    """Median of the metric for each group and season, and its change from the season before, by the seasons' order."""
    medians = with_medians(df.groupBy(by, "season").agg(F.count("*").alias("n")), df, [by, "season"], {"median": metric})
    before = F.lag("median").over(Window.partitionBy(by).orderBy("season"))
    return medians.select(by, "season", "n", F.bround("median", 6).alias("median"), F.bround(F.col("median") - before, 6).alias("change"))
