"""Scores by period, quiz tallies and game grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST, KEEP = 13333, 100


def clean_name(name: Column) -> Column:
    """Without control characters, at most 12 characters, trimmed."""
    return F.trim(F.substring(F.regexp_replace(name, r"[\x00-\x1F\x7F]", ""), 1, 12))


def valid(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("score").between(0, MOST) & F.col("id").rlike("^[a-z0-9]{4,16}$"))


def period_keys(ts: Column, hours: int = 8) -> tuple[Column, Column]:
    """Day and ISO week of a time zone that many hours ahead."""
    local = ts + F.make_interval(hours=F.lit(hours))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), local).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(local).cast("string"), 2, "0"))
    return F.date_format(local, "yyyy-MM-dd"), week


def leaderboard(scores: DataFrame, period: str, keep: int = KEEP) -> DataFrame:
    """Each period's best score of each id, by score and then time, the first `keep`. scores: board, id, score, ts and the period."""
    best = scores.groupBy("board", period, "id").agg(F.max("score").alias("score"), F.min_by("ts", F.struct(-F.col("score"), "ts")).alias("ts"))
    place = F.row_number().over(Window.partitionBy("board", period).orderBy(F.desc("score"), "ts", "id"))
    return best.withColumn("place", place.cast("long")).where(F.col("place") <= keep)


def quiz_tally(answers: DataFrame) -> DataFrame:
    """answers: id, question, choice. The choice given most often (of several, the one given first), how often, and the runner-up."""
    counts = answers.groupBy("id", "choice").agg(F.count("*").alias("n"), F.min("question").alias("_first"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("_first").alias("f"), "choice")))
    out = counts.groupBy("id").agg(ordered.alias("_o"), F.sum("n").alias("n_answers"))
    return out.select("id", "n_answers", F.get("_o", 0)["choice"].alias("first"), (-F.get("_o", 0)["n"]).alias("n_first"), F.coalesce(F.get("_o", 1)["choice"], F.lit("-")).alias("second"))


def beat_grades(beats: DataFrame) -> DataFrame:
    """beats: id, beat, match (0 to 1), late (seconds). Each beat's best match less its lateness, graded; the total scaled to MOST, and stars."""
    value = F.greatest(F.col("match") * (1 - F.least(F.col("late") / 2, F.lit(0.5))), F.lit(0.0))
    best = beats.groupBy("id", "beat").agg(F.max(value).alias("v"))
    grade = F.when(F.col("v") >= 0.9, 1.0).when(F.col("v") >= 0.7, 0.75).when(F.col("v") >= 0.5, 0.5).otherwise(0.0)
    out = best.groupBy("id").agg(F.count("*").alias("n_beats"), F.bround(F.avg(grade) * MOST, 0).cast("long").alias("score"))
    return out.withColumn("stars", F.size(F.filter(F.array(*[F.lit(s) for s in (3000, 6000, 9000, 11000, 12500)]), lambda s: s <= F.col("score"))).cast("long"))
