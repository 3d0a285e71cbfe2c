"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
WORD_BYTES = rb"[^\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir if the session has it, else one beside the warehouse, unless that is a disk of the driver's own on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
        if not spark.sparkContext.master.startswith("local") and at.startswith(("/", "file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there and survives lost executors. by: a column of few values that has a folder for each."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.selvage_path = path
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """What is planned and run inside sends texts to Python a few at a time: a batch of the default 10,000 rows takes tens of MB beside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Deletes a table that written() made and that nothing reads any more."""
    path = getattr(df, "selvage_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def spread_join(rows: DataFrame, other: DataFrame, on: list[str], counts: DataFrame, by: list[str], how: str = "inner", share: int = 1000, salts: int = 64, most: int = 4_000_000) -> DataFrame:
    """rows joined with other (few rows a key) where one key may hold a large part of rows.

    counts: `on` and _n, how many rows a key has, or about so many (keys with few may be absent). A key of more than a
    `share`th of their sum, or of more than `most` rows, is dealt to `salts` tasks, or to as many that each has about `most`
    rows, by a hash of the columns `by`; the rows of `other` for such keys go to each of these tasks. There are at most
    `share` keys of the first kind and a `most`th of the rows of the second (25,000 of 1e11)."""
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()  # two numbers
    bound = min(max((total or 0) / share, salts), most)
    if not total or largest <= bound:
        return rows.join(other, on, how)
    keys = counts.where(F.col("_n") > bound).select(*on, F.greatest(F.lit(salts), F.ceil(F.col("_n") / most)).cast("long").alias("_hot"))
    found = keys.collect()  # as many as the docstring says
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, keys.schema))
    dealt = rows.join(hot, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_hot")), F.lit(0).cast("long"))).drop("_hot")
    places = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.col("_hot") - 1)).otherwise(F.array(F.lit(0).cast("long")))
    spread = other.join(hot, on, "left").withColumn("_salt", F.explode(places)).drop("_hot")
    return dealt.join(spread, [*on, "_salt"], how).drop("_salt")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def aside(df: DataFrame, but: tuple[str, ...] = ()) -> tuple[list[Column], list[Column]]:
    """Selections that put df's columns (without those in `but`) under names that no operator uses, and back."""
    kept = [(f"_u{n}_", c) for n, c in enumerate(df.columns) if c not in but]
    return [F.col(f"`{c}`").alias(u) for u, c in kept], [F.col(u).alias(c) for u, c in kept]
