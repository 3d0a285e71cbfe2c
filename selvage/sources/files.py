"""Listings of files by name, and appends that leave out what is there."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.operators.merge import one_per


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name, folder, length, modified of the files below a folder, without temporary and hidden ones. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = files.select("path", name.alias("name"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "length", F.col("modificationTime").alias("modified"))
    return files.where(~F.col("name").rlike(r"^(\.|__|~\$)") & ~F.col("folder").rlike(r"^(\.|__|tmp$)"))


def image_manifest(files: DataFrame) -> DataFrame:
    """sku, view, season, whether the file lies in another season's folder, and the one primary image of each sku."""
    sku = F.nullif(F.regexp_extract("name", r"(KA\d{7})", 1), F.lit(""))
    view = F.regexp_extract("name", r"KA\d{7}[_-]?([^.]*)\.", 1)
    rows = files.withColumns({"sku": sku, "view": view}).where("sku is not null").withColumn("season_code", F.substring("sku", 1, 5))
    folder = F.nullif(F.regexp_extract("folder", r"(KA\d{3})", 1), F.lit(""))
    rows = rows.withColumn("misfiled", F.coalesce(folder != F.col("season_code"), F.lit(False)))
    first = one_per(rows, ["sku"], F.asc("view"), F.asc("path")).select("path", F.lit(True).alias("is_primary"))
    return rows.join(first, "path", "left").withColumn("is_primary", F.coalesce("is_primary", F.lit(False)))


def reference_images(files: DataFrame, cap: int = 6) -> DataFrame:
    """files: sku, path, source_rank, length. The best `cap` of each sku: better sources first, then larger files, each path once."""
    from pyspark.sql import Window

    rows = files.groupBy("sku", "path").agg(F.min("source_rank").alias("source_rank"), F.max("length").alias("length"))
    place = F.row_number().over(Window.partitionBy("sku").orderBy("source_rank", F.desc("length"), "path"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= cap)


def item_code(text: Column) -> Column:
    """Struct of style, colour and size of a full item code, separators aside; null if it isn't one."""
    plain = F.regexp_replace(F.upper(text), r"[\s_\-./]", "")
    part = lambda n: F.nullif(F.regexp_extract(plain, r"^(KA\d{7})(\d{2})([A-Z0-9]{0,4})$", n), F.lit(""))
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("style"), part(2).alias("color"), part(3).alias("size")))


def kind_of_bytes(content: Column) -> Column:
    """The format of a file by its first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0A1B11AE1"), "ole").when(head.startswith("25504446"), "pdf").otherwise("unknown")
    )


def new_only(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't there yet, one for each key."""
    return rows.dropDuplicates([key]).join(there.select(key), key, "left_anti")


def unmatched(items: DataFrame, images: DataFrame) -> DataFrame:
    """items (sku) without an image (sku, path), with the first reason that fits: a name that differs in case or signs, the digits only, or none."""
    plain = lambda c: F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    digits = lambda c: F.regexp_extract(c, r"(\d{7})", 1)
    rest = items.select("sku").distinct().join(images.select("sku"), "sku", "left_anti")
    strict = images.select(plain(F.col("sku")).alias("_k1"), F.lit(1).alias("_1")).distinct()
    loose = images.select(digits(F.col("sku")).alias("_k2"), F.lit(1).alias("_2")).where("_k2 <> ''").distinct()
    out = rest.withColumns({"_k1": plain(F.col("sku")), "_k2": digits(F.col("sku"))}).join(strict, "_k1", "left").join(loose, "_k2", "left")
    reason = F.when(F.col("_1").isNotNull(), "spelling").when(F.col("_2").isNotNull(), "digits only").otherwise("no image")
    return out.select("sku", reason.alias("reason"))


def hunt(listed: DataFrame, sku: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "webp", "bmp"), others: tuple[str, ...] = ("psd", "ai", "tif", "tiff", "heic", "gif")) -> DataFrame:
    """Every file whose path holds the sku, or its seven digits, whatever signs are between; and why the rules would or wouldn't take it."""
    plain = lambda c: F.regexp_replace(F.upper(c), r"[^A-Z0-9]", "")
    wanted, digits = re.sub(r"[^A-Z0-9]", "", sku.upper()), re.search(r"\d{7}", sku)
    full = plain(F.col("path"))
    rows = listed.where(full.contains(wanted) | (full.contains(digits[0]) if digits else F.lit(False)))
    extension = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    taken, in_name, in_folder = extension.isin(*extensions), F.upper("name").contains(sku.upper()), F.upper(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).contains(sku.upper())
    why = (
        F.when(taken & F.col("name").contains(sku.upper()) & F.col("name").rlike(r"KA\d{7}"), "taken")
        .when(~taken & extension.isin(*others), "picture of a format that isn't taken").when(~taken, "no picture").when(in_name, "spelling of the name").when(in_folder, "in the folder's name").otherwise("digits only")
    )
    return rows.select("path", "name", extension.alias("extension"), why.alias("why"))


def name_diagnosis(listed: DataFrame, bare: float = 0.9, like_code: float = 0.8) -> DataFrame:
    """Whether file names tell colours: files with a sku, the share with nothing after it, files whose ending looks like a two-digit code, files for each sku, and the finding."""
    rows = listed.where(F.col("name").rlike(r"KA\d{7}")).select(F.regexp_extract("name", r"(KA\d{7})", 1).alias("sku"), F.regexp_extract("name", r"KA\d{7}([^.]*)", 1).alias("suffix"))
    two = F.regexp_extract("suffix", r"(?:^|\D)(\d{2})(?:\D|$)", 1).try_cast("int")
    kinds = rows.withColumn("pattern", F.regexp_replace("suffix", r"\d", "#")).groupBy("pattern").agg(F.count("*").alias("n"), F.avg(F.coalesce(two.between(10, 92), F.lit(False)).cast("double")).alias("share"))
    found = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum(F.when(F.col("pattern") == "", F.col("n"))), F.lit(0)).alias("n_bare"), F.coalesce(F.sum(F.when(F.col("share") >= like_code, F.col("n"))), F.lit(0)).alias("n_like_code"))
    out = found.join(rows.agg(F.countDistinct("sku").alias("n_skus")))  # one row beside one row
    finding = F.when(F.col("n_files") == 0, "no file has a sku").when(F.col("n_bare") >= bare * F.col("n_files"), "names end with the style").when(F.col("n_like_code") > 0, "some names end with a colour code").otherwise("names end with something else")
    return out.select("n_files", "n_skus", "n_bare", "n_like_code", F.bround(F.try_divide("n_files", "n_skus"), 4).alias("files_per_sku"), finding.alias("finding"))
