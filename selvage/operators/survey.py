"""Survey exports: headers by hints, choices as codes, appends without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.columns import map_of


def match_headers(columns: list[str], hints: dict[str, list[str]]) -> tuple[dict[str, str], list[str]]:
    """Field to the first header that holds all its hint words; and the headers left over."""
    found: dict[str, str] = {}
    for field, words in hints.items():
        hit = next((c for c in columns if c not in found.values() and all(w.lower() in c.lower() for w in words)), None)
        if hit:
            found[field] = hit
    return found, [c for c in columns if c not in found.values()]


def read_export(df: DataFrame, hints: dict[str, list[str]], file: str, row: str | None = None) -> DataFrame:
    """The export under its field names, all text.

    A response without an id gets one of the file and the row's place there (`row`, as read_cells tells it), or, where the
    place isn't known, of its content and of how many alike come before it: people who answered alike stay several, and
    the same file read again gives the same ids."""
    found, _ = match_headers(df.columns, hints)
    out = df.select(*[(F.nullif(F.trim(F.col(f"`{found[f]}`").cast("string")), F.lit("")) if f in found else F.lit(None).cast("string")).alias(f) for f in hints])
    content = F.sha1(F.to_json(F.struct(*hints)))
    if row:
        made = F.col(f"`{row}`").cast("string")
        out = df.select(made.alias("_made"), *[(F.nullif(F.trim(F.col(f"`{found[f]}`").cast("string")), F.lit("")) if f in found else F.lit(None).cast("string")).alias(f) for f in hints])
    else:
        # rows of one content are alike, so their order doesn't matter
        alike = F.row_number().over(Window.partitionBy("_content").orderBy("_content"))
        out = out.withColumn("_content", content).withColumn("_made", F.concat_ws("-", "_content", alike.cast("string")))
    made = F.concat(F.lit(f"{file}-"), "_made")
    return out.withColumn("response_id", F.coalesce("response_id", made) if "response_id" in hints else made).drop("_content", "_made")


def codes_of(value: Column, codes: dict[str, str]) -> Column:
    """Choices (between ; , 、 or |) as codes; unknown ones stay as they are."""
    words = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"[;,、|]"), lambda w: F.trim(w)), lambda w: w != "")
    return F.transform(words, lambda w: F.coalesce(map_of(w, codes), w))


def append_new(rows: DataFrame, there: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Responses that aren't there yet, and how many are new and how many repeat."""
    fresh = rows.dropDuplicates(["response_id"]).join(there.select("response_id"), "response_id", "left_anti")
    new = fresh.count()
    return fresh, {"new": new, "repeated": rows.count() - new}
