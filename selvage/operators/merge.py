"""The master table: sales beside attributes, measures and feedback, with an audit of each join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.columns import ratio


def one_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def master(sales: DataFrame, attributes: DataFrame | None = None, measures: DataFrame | None = None, feedback: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """sales with the others' columns, each joined many to one: attributes on sku; measures on sku, with what is null then
    taken from the style's measures; feedback on sku. The audit has a row for each join: rows, matched, share."""
    out, audits = sales, []

    def audit(step: str, flag: str) -> None:
        audits.append(out.agg(F.lit(step).alias("step"), F.count("*").alias("n_left"), F.count(flag).alias("n_matched")).withColumn("share", F.bround(ratio("n_matched", "n_left"), 6)))

    if attributes is not None:
        out = out.join(one_per(attributes, ["sku"], F.desc("attribute_conf")).withColumn("_a", F.lit(1)), "sku", "left")
        audit("attributes", "_a")
    if measures is not None:
        names = [c for c in measures.columns if c not in ("sku", "style_code", "techpack_variant", "extract_fields")]
        best = [F.desc("extract_fields"), F.desc(F.col("techpack_variant") == "base"), F.asc("sku")]
        by_sku = one_per(measures, ["sku"], *best).select("sku", *names, F.lit(1).alias("_m"))
        by_style = one_per(measures.where("style_code is not null"), ["style_code"], *best).select("style_code", *[F.col(c).alias(f"_s_{c}") for c in names], F.lit(1).alias("_s"))
        out = out.join(by_sku, "sku", "left").join(by_style, "style_code", "left")
        out = out.withColumns({c: F.coalesce(c, f"_s_{c}") for c in names}).withColumn("_m", F.coalesce("_m", "_s")).drop("_s", *[f"_s_{c}" for c in names])
        audit("measures", "_m")
    if feedback is not None:
        out = out.join(feedback.withColumn("_f", F.lit(1)), "sku", "left")
        audit("feedback", "_f")
    report = None
    for a in audits:
        report = a if report is None else report.unionByName(a)
    return out.drop("_a", "_m", "_f"), report


def derived_ratios(df: DataFrame, formulas: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratios of measures to 4 places, null over 0."""
    return df.withColumns({name: F.bround(ratio(a, b), 4) for name, (a, b) in formulas.items()})


def in_centimetres(df: DataFrame, measures: list[str]) -> DataFrame:
    return df.withColumns({f"{m}_cm": F.bround(F.col(m) * 2.54, 1) for m in measures})


def coverage(df: DataFrame, measures: list[str]) -> DataFrame:
    """How many rows have each measure."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(m).alias(m) for m in measures])
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in measures]))
    return counts.select("_n", pairs.alias("p")).select("p.measure", "p.n", F.bround(ratio("p.n", "_n"), 6).alias("share"))


def fill_images(master: DataFrame, images: DataFrame) -> DataFrame:
    """image_path where it is missing, from the best of the style's images: rank of its kind, then size; and where it came from."""
    best = one_per(images, ["sku"], F.asc("kind_rank"), F.desc("bytes"), F.asc("image_path")).select("sku", F.col("image_path").alias("_path"))
    out = master.join(best, "sku", "left")
    source = F.when(F.col("image_path").isNotNull(), "catalogue").when(F.col("_path").isNotNull(), "techpack").otherwise("none")
    return out.withColumn("image_source", source).withColumn("image_path", F.coalesce("image_path", "_path")).drop("_path")
