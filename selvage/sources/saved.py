"""What is kept between runs: the master with its audit, feedback with its edits, and an index that moves between machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from selvage.operators.feedback import tag_list

#: Fixed: the columns of a feedback file.
FEEDBACK = ["record_id", "sku", "survey_date", "store", "respondent", "verdict", "confidence", "reason_tags", "reason_text", "suggested_action"]
INDEX_VERSION = 2


def save_master(master: DataFrame, audit: DataFrame, folder: str, by: str | None = "season") -> None:
    """The master as Parquet, a folder for each season (so that a season's report reads its own), and the audit as CSV."""
    writer = master.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/master")
    audit.write.mode("overwrite").option("header", True).csv(f"{folder}/audit")


def load_master(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/master"), spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/audit")


def read_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a folder of feedback files (CSV under any order of columns, all text), with dates and the list of tags; rows without a sku are left out."""
    rows = spark.read.option("header", True).csv(folder)
    rows = rows.select(*[(F.trim(F.col(c)) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in FEEDBACK])
    return rows.where("sku <> ''").withColumn("survey_date", F.to_date(F.try_to_timestamp("survey_date"))).withColumn("reason_tag_list", tag_list(F.col("reason_tags")))


def append_feedback(rows: DataFrame, folder: str, today: str) -> None:
    """Adds rows to the folder, as a file of their own, so nothing that is there is read or written. A missing date is today's; a row without a sku is an error."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit(today if c == "survey_date" else "")).alias(c) if c in rows.columns else F.lit(today if c == "survey_date" else "").alias(c) for c in FEEDBACK]
    made = rows.select(*names).withColumn("survey_date", F.when(F.col("survey_date") == "", today).otherwise(F.col("survey_date")))
    made = made.withColumn("sku", F.when(F.trim("sku") == "", F.raise_error(F.lit("a row of feedback has no sku"))).otherwise(F.col("sku")))
    made.write.mode("append").option("header", True).csv(folder)


def edited(feedback: DataFrame, edits: DataFrame, key: str = "record_id", at: str = "edited_at", gone: str = "deleted") -> DataFrame:
    """feedback after edits (key, time, whether it is deleted, and new values, null where a column stays): a record's edits apply one after another, a deletion ends it."""
    columns = [c for c in edits.columns if c not in (key, at, gone)]
    # of each column the last value that was set
    last = edits.groupBy(key).agg(F.max(gone).alias("_gone"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"_{c}") for c in columns])
    out = feedback.join(last, key, "left").where(~F.coalesce("_gone", F.lit(False)))
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in feedback.columns])


def export_index(rows: DataFrame, folder: str, version: int = INDEX_VERSION) -> None:
    """An index of signatures or vectors (any columns) with the version of what made them."""
    rows.withColumn("_version", F.lit(version)).write.mode("overwrite").parquet(folder)


def load_index(spark: SparkSession, folder: str, version: int = INDEX_VERSION) -> DataFrame:
    """The index, if it was made by the version that asks; else an error that names both."""
    rows = spark.read.parquet(folder)
    made = rows.select("_version").distinct().limit(2).collect()
    if [r["_version"] for r in made] != [version]:
        raise ValueError(f"the index is of version {sorted(r['_version'] for r in made)}, not {version}: make it anew")
    return rows.drop("_version")


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_place = 1").drop("_place")
