"""The same leaderboard and incremental loads as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def new_rows(stream: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows whose key wasn't seen within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_best(stream: DataFrame, ts: str = "ts", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Best score of each board and id in each window of time."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("period"), "board", "id").agg(F.max("score").alias("score"))


def upsert_best(stream: DataFrame, table: str, checkpoint: str, keep: int = 100) -> DataStreamWriter:
    """Keeps the table of each board's best scores up to date: every micro-batch is merged with what the table holds.

    Two tables are written in turn (`table`_0 and `table`_1), so that a batch that is repeated after a failure reads
    what it read before."""

    def merge(batch: DataFrame, number: int) -> None:
        from selvage.operators.leaderboard import leaderboard

        spark, old, new = batch.sparkSession, f"{table}_{number % 2}", f"{table}_{(number + 1) % 2}"
        rows = batch.select("board", "id", "score", "ts")
        if number and spark.catalog.tableExists(old):
            rows = rows.unionByName(spark.table(old).select("board", "id", "score", "ts"))
        best = leaderboard(rows.withColumn("period", F.lit("all")), "period", keep)
        best.write.mode("overwrite").saveAsTable(new)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
