"""Files made of order lines whose numbers hold the digits of the sku that is hunted."""

import duckdb

from selvage.plans import registry


def test_order_numbers_are_no_skus(spark, tmp_path):
    # the order's number is the sku's digits, begins with them, ends with them, or makes them with its line's number
    at = f"{tmp_path}/lineitem.parquet"
    rows = [(1580008, 1, 1), (15800081, 2, 2), (21580008, 3, 3), (158000, 8, 4), (7, 1, 8), (12, 2, 108), (13, 3, 88), (14, 4, 208), (15, 5, 308), (16, 6, 408)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long").coalesce(1).write.parquet(at)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/*.parquet'")
    assert sorted(tuple(r) for r in registry.QUERIES["file_hunt"](spark, str(tmp_path)).collect()) == sorted(base.execute(registry.ORACLES["file_hunt"]).fetchall())
