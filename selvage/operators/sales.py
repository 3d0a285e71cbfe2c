"""From sales lines to one row for each sku and season, or for each variant, with what is derived from them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvage.functions.columns import ratio

#: Attributes that all lines of a sku share; of several values the smallest is taken, whatever the order of the lines.
ATTRIBUTES = ["product_name", "category", "product_line", "sub_category", "color", "size", "designer"]
SUMS = ["stock_in", "sales_qty", "return_qty", "sales_amount", "stock_on_hand", "stock_on_hand_alt"]


def aggregate_to_sku_season(lines: DataFrame, gift: Column, sample_stock: float = 2, snapshot: date | None = None) -> DataFrame:
    """Sums, dates and rates of each sku and season. A sum without values is 0; a reported rate (sell_through_reported)
    wins over the computed one; weeks on sale count to the snapshot, by default the last date of all lines (which costs
    a pass over them)."""
    last = snapshot or lines.agg(F.max("ship_date")).first()[0]
    grouped = lines.groupBy("sku", "season").agg(
        *[F.min(c).alias(c) for c in ATTRIBUTES],
        F.median("list_price").alias("list_price"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUMS],
        F.min("ship_date").alias("first_sale_date"),
        F.max("ship_date").alias("last_sale_date"),
        F.count("*").alias("n_lines"),
        *([F.avg("sell_through_reported").alias("sell_through_reported")] if "sell_through_reported" in lines.columns else []),
    )
    net = F.col("sales_qty") - F.col("return_qty")
    computed = ratio(net, "stock_in")
    out = grouped.withColumns(
        {
            "snapshot_date": F.lit(last).cast("date"),
            "net_sales_qty": net,
            "return_rate": ratio("return_qty", "sales_qty"),
            "sell_through_rate": F.coalesce("sell_through_reported", computed) if "sell_through_reported" in grouped.columns else computed,
            "avg_selling_price": ratio("sales_amount", "sales_qty"),
        }
    )
    return out.withColumns(
        {
            "discount_depth": 1 - ratio("avg_selling_price", "list_price"),
            "weeks_on_sale": F.datediff("snapshot_date", "first_sale_date") / 7,
            "is_sample": (F.col("stock_in") <= sample_stock) & (F.col("sales_qty") <= 0),
            "is_gift": gift,
        }
    )


def aggregate_to_variant(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Sums for each variant (null keys are kept); negative stock is marked, then set to 0."""
    sums = ["stock_in", "sales_qty", "return_qty", "stock_on_hand", "stock_on_hand_alt"]
    out = lines.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums], F.max("list_price").alias("list_price"))
    return out.withColumn("is_negative", F.col("stock_on_hand") < 0).withColumn("stock_on_hand", F.greatest("stock_on_hand", F.lit(0.0)))


def flag_samples(lines: DataFrame, words: list[str], sample_stock: float = 2) -> DataFrame:
    """is_sample, sample_reason and, where the name tells it, sample_parent_sku."""
    by_name = F.lower("product_name").rlike("|".join(words))
    by_quantity = (F.col("stock_in") <= sample_stock) & (F.col("sales_qty") <= 0)
    parent = F.regexp_extract("product_name", r"(\d{7})", 1)
    reason = F.when(by_name, F.lit("name")).when(by_quantity, F.lit("quantity"))
    return lines.withColumn("sample_reason", reason).withColumn("is_sample", reason.isNotNull()).withColumn("sample_parent_sku", F.when(by_name & (parent != ""), F.concat(F.lit("KA"), parent)))


def sample_report(flagged: DataFrame) -> DataFrame:
    """Samples by season and reason: how many, how many with a style behind them, and the stock they hold."""
    return flagged.where("is_sample").groupBy("season", "sample_reason").agg(F.count("*").alias("n"), F.count("sample_parent_sku").alias("n_with_parent"), F.sum("stock_in").alias("stock_in"))


def body_parts(df: DataFrame, parts: dict[str, tuple[str, str]], code: str = "category_code") -> DataFrame:
    """body_part and body_half by the last digit of the category's code."""
    from selvage.functions.columns import map_of

    digit = F.substring(F.col(code), -1, 1)
    return df.withColumn("body_part", map_of(digit, {k: v[0] for k, v in parts.items()})).withColumn("body_half", map_of(digit, {k: v[1] for k, v in parts.items()}))
