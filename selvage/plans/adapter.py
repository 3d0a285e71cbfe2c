"""The driver's tables as sales lines, and the SQL of the same derivation for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.operators.sales import aggregate_to_sku_season

GIFT = "PROMO"
#: From so many lines on they are dealt by order, to tasks of about so many lines (few tasks, as a shuffle to more than 200 sorts what it writes).
FEW_LINES, TASK_LINES = 4_000_000, 4_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_orders_and_parts(items: DataFrame, orders: DataFrame, parts: DataFrame, most: int | None = None, few: int | None = None) -> DataFrame:
    """Lines beside their orders and parts. Of more than `few` lines no task sorts its share: Spark puts pieces of a shuffle
    together until they have 64 MB, some four million lines, and has a fixed number of them at most. Lines are dealt by order
    to as many tasks that each has about `most` (or to Spark's number, if that is more), and a task holds its orders, then
    its parts, in a hash table. The lines of one part, however many, pass through one task, which keeps none of them."""
    n = items.count()  # the files' footers tell it
    if n > (few or FEW_LINES):
        tasks = -(-n // (most or TASK_LINES))
        items, orders = items.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey").hint("shuffle_hash")
        parts = parts.hint("shuffle_hash")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).join(parts, items.l_partkey == parts.p_partkey)


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line. A line that is finished ('F') is sold; a returned one ('R') comes back; a line
    without return flag 'N' counts in the second, disagreeing stock."""
    items, orders, parts = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    sold, back = F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"
    quantity = lambda when: F.when(when, F.col("l_quantity")).otherwise(0.0)
    name = F.split("p_name", " ")
    lines = with_orders_and_parts(items, orders, parts)
    return lines.select(
        F.col("l_partkey").alias("sku"),
        F.year("o_orderdate").cast("long").alias("season"),
        F.quarter("o_orderdate").cast("long").alias("term"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("product_line"),
        F.get(name, 1).alias("sub_category"),
        F.get(name, 0).alias("color"),
        F.col("p_size").cast("long").alias("size"),
        F.col("p_retailprice").alias("list_price"),
        F.col("l_suppkey").alias("designer"),
        F.col("l_quantity").alias("stock_in"),
        quantity(sold).alias("sales_qty"),
        quantity(sold & back).alias("return_qty"),
        F.when(sold, F.col("l_extendedprice") * (1 - F.col("l_discount"))).otherwise(0.0).alias("sales_amount"),
        (F.col("l_quantity") - quantity(sold)).alias("stock_on_hand"),
        quantity(F.col("l_returnflag") != "N").alias("stock_on_hand_alt"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
    )


def snapshot(spark: SparkSession, sf_dir: str):
    """The last date of all lines, from its one column."""
    return read(spark, sf_dir, "lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).first()[0]


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each sku and season."""
    return aggregate_to_sku_season(sales_lines(spark, sf_dir), gift=F.col("category") == GIFT, snapshot=snapshot(spark, sf_dir))


LINES_SQL = """
lines AS (
  SELECT l_partkey AS sku, year(o_orderdate) AS season, quarter(o_orderdate) AS term, p_name AS product_name, p_type AS category, p_brand AS product_line,
    split_part(p_name, ' ', 2) AS sub_category, split_part(p_name, ' ', 1) AS color, CAST(p_size AS BIGINT) AS size, p_retailprice AS list_price, l_suppkey AS designer,
    l_quantity AS stock_in,
    CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END AS sales_qty,
    CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN l_quantity ELSE 0 END AS return_qty,
    CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) ELSE 0 END AS sales_amount,
    CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_quantity END AS stock_on_hand,
    CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END AS stock_on_hand_alt,
    CAST(l_shipdate AS DATE) AS ship_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

MASTER_SQL = (
    LINES_SQL
    + """,
sums AS (
  SELECT sku, season, min(product_name) AS product_name, min(category) AS category, min(product_line) AS product_line, min(sub_category) AS sub_category, min(color) AS color,
    min(size) AS size, median(list_price) AS list_price, min(designer) AS designer,
    sum(stock_in) AS stock_in, sum(sales_qty) AS sales_qty, sum(return_qty) AS return_qty, sum(sales_amount) AS sales_amount, sum(stock_on_hand) AS stock_on_hand,
    sum(stock_on_hand_alt) AS stock_on_hand_alt, min(ship_date) AS first_sale_date, max(ship_date) AS last_sale_date, count(*) AS n_lines
  FROM lines GROUP BY sku, season
), snap AS (SELECT max(ship_date) AS snapshot_date FROM lines
), master AS (
  SELECT *, sales_qty - return_qty AS net_sales_qty, return_qty / nullif(sales_qty, 0) AS return_rate, (sales_qty - return_qty) / nullif(stock_in, 0) AS sell_through_rate,
    sales_amount / nullif(sales_qty, 0) AS avg_selling_price, 1 - sales_amount / nullif(sales_qty, 0) / nullif(list_price, 0) AS discount_depth,
    CAST(date_diff('day', first_sale_date, snapshot_date) AS DOUBLE) / 7 AS weeks_on_sale,
    (stock_in <= 2 AND sales_qty <= 0) AS is_sample, category = 'PROMO' AS is_gift
  FROM sums, snap
)"""
)

#: Eligible rows in bands: STAR from .8, CORE from .5, STEADY from .2, SLOW below.
GRADED_SQL = (
    MASTER_SQL
    + """,
eligible AS (
  SELECT *, (NOT is_gift AND NOT is_sample AND stock_in >= 30 AND weeks_on_sale >= 4 AND sell_through_rate IS NOT NULL) AS ok FROM master
), ranked AS (
  SELECT *, CASE WHEN ok THEN (rank() OVER (PARTITION BY season, category, ok ORDER BY sell_through_rate)
      + (count(*) OVER (PARTITION BY season, category, ok, sell_through_rate) - 1) / 2.0) / count(*) OVER (PARTITION BY season, category, ok) END AS pct
  FROM eligible
), graded AS (
  SELECT *, CASE WHEN pct IS NULL THEN 'EXCLUDED' WHEN pct >= 0.8 THEN 'STAR' WHEN pct >= 0.5 THEN 'CORE' WHEN pct >= 0.2 THEN 'STEADY' ELSE 'SLOW' END AS perf_band,
    count(*) OVER (PARTITION BY season, category) AS perf_group_n, count(*) FILTER (WHERE ok) OVER (PARTITION BY season, category) AS perf_group_n_eligible
  FROM ranked
)"""
)
