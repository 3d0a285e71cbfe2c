"""What a feature adds, compared within strata, and how sure that is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.columns import all_matches, quantiles, ratio, unpivoted


def _cells(long: DataFrame, strata: list[str], keys: list[str], metric: str, totals: DataFrame) -> DataFrame:
    """Sums of each stratum and feature, beside those of the rest of the stratum."""
    cells = long.groupBy(*strata, *keys).agg(F.count("*").alias("_n"), F.sum(metric).alias("_y"))
    return cells.join(totals, strata).withColumn("_out_n", F.col("_all_n") - F.col("_n")).withColumn("_d", ratio("_y", "_n") - ratio(F.col("_all_y") - F.col("_y"), "_out_n"))


def _totals(df: DataFrame, strata: list[str], metric: str) -> DataFrame:
    return df.groupBy(*strata).agg(F.count("*").alias("_all_n"), F.sum(metric).alias("_all_y"))


def stratified_lift(df: DataFrame, features: list[str], strata: list[str], metric: str = "sell_through_rate", least_cell: int = 6, least_stratum: int = 12, least_strata: int = 3) -> DataFrame:
    """Mean inside less mean outside, by stratum, pooled with the inside counts; how many strata point the same way."""
    rows = df.where(F.col(metric).isNotNull())
    long = unpivoted(rows.select(*strata, metric, *features), [*strata, metric], features, "feature", "value").where("value is not null")
    cells = _cells(long, strata, ["feature", "value"], metric, _totals(rows, strata, metric))
    cells = cells.where((F.col("_n") >= least_cell) & (F.col("_out_n") >= least_cell) & (F.col("_all_n") >= least_stratum))
    pooled = Window.partitionBy("feature", "value")
    effect = F.sum(F.col("_d") * F.col("_n")).over(pooled) / F.sum("_n").over(pooled)
    cells = cells.withColumn("_effect", effect)
    out = cells.groupBy("feature", "value").agg(
        F.sum("_n").alias("n"),
        F.count("*").alias("n_strata"),
        F.bround(F.first("_effect") * 100, 5).alias("effect_points"),
        F.bround(F.avg((F.signum("_d") == F.signum("_effect")).cast("double")), 6).alias("consistency"),
    )
    return out.where(F.col("n_strata") >= least_strata).withColumn("evidence", F.when(F.col("n") >= 30, "strong").when(F.col("n") >= 12, "fair").otherwise("weak"))


def robust_findings(lift: DataFrame, consistency: float = 0.7, strata: int = 3, points: float = 4.0, n: int = 12) -> DataFrame:
    return lift.where((F.col("consistency") >= consistency) & (F.col("n_strata") >= strata) & (F.abs("effect_points") >= points) & (F.col("n") >= n))


def combo_lift(df: DataFrame, features: list[str], strata: list[str], metric: str = "sell_through_rate", inside: int = 3, outside: int = 6, least_strata: int = 2, least: int = 12, top: int = 40) -> DataFrame:
    """Pairs of feature values: pooled effect, what the two would add on their own, and the interaction."""
    rows = df.where(F.col(metric).isNotNull())
    totals = _totals(rows, strata, metric)
    values = [F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in features]
    pairs = F.array(*[F.struct(values[i].alias("a"), values[j].alias("b")) for i in range(len(values)) for j in range(i + 1, len(values))])
    long = rows.select(*strata, metric, F.explode(pairs).alias("p")).select(*strata, metric, F.col("p.a.f").alias("feature_a"), F.col("p.a.v").alias("value_a"), F.col("p.b.f").alias("feature_b"), F.col("p.b.v").alias("value_b"))
    keys = ["feature_a", "value_a", "feature_b", "value_b"]
    cells = _cells(long.where("value_a is not null and value_b is not null"), strata, keys, metric, totals).where((F.col("_n") >= inside) & (F.col("_out_n") >= outside))
    out = cells.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("n_strata"), (F.sum(F.col("_d") * F.col("_n")) / F.sum("_n")).alias("_e")).where((F.col("n_strata") >= least_strata) & (F.col("n") >= least))
    solo = stratified_lift(df, features, strata, metric, least_strata=1)
    for side in ("a", "b"):
        own = solo.select(F.col("feature").alias(f"feature_{side}"), F.col("value").alias(f"value_{side}"), F.col("effect_points").alias(f"_{side}"))
        out = out.join(own, [f"feature_{side}", f"value_{side}"], "left")
    out = out.withColumn("effect_points", F.bround(F.col("_e") * 100, 5)).withColumn("expected_points", F.bround(F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0)), 5))
    out = out.withColumn("interaction", F.bround(F.col("effect_points") - F.col("expected_points"), 4)).drop("_e", "_a", "_b")
    return out.orderBy(F.desc("effect_points"), *keys).limit(top)


def bestseller_shares(df: DataFrame, features: list[str], strata: list[str], metric: str = "sell_through_rate", high: float = 0.75, low: float = 0.25, least: int = 4) -> DataFrame:
    """Share of each feature value among the best and the worst quarter of its stratum, and their ratio."""
    rows = df.where(F.col(metric).isNotNull())
    edges = quantiles(rows, strata, metric, [low, high]).select(*strata, F.get("_edges", 0).alias("_lo"), F.get("_edges", 1).alias("_hi"))
    marked = rows.join(edges, strata).withColumn("_top", F.col(metric) >= F.col("_hi")).withColumn("_bottom", F.col(metric) <= F.col("_lo"))
    sums = marked.agg(F.count_if("_top").alias("t"), F.count_if("_bottom").alias("b")).first()  # two numbers
    long = unpivoted(marked.select("_top", "_bottom", *features), ["_top", "_bottom"], features, "feature", "value").where("value is not null")
    out = long.groupBy("feature", "value").agg(F.count_if("_top").alias("n_high"), F.count_if("_bottom").alias("n_low")).where(F.col("n_high") >= least)
    hi, lo = F.col("n_high") / F.lit(max(1, sums["t"])), F.col("n_low") / F.lit(max(1, sums["b"]))
    return out.withColumns({"share_high": F.bround(hi, 6), "share_low": F.bround(lo, 6), "ratio": F.bround((hi + 0.01) / (lo + 0.01), 5)})


def season_blueprint(df: DataFrame, features: list[str], findings: DataFrame, term: int, metric: str = "sell_through_rate", top: int = 12) -> DataFrame:
    """For findings' feature values: their share of a term's rows, their mean rate, and an advice."""
    rows = df.where(F.col("term") == term)
    long = unpivoted(rows.select(metric, *features), [metric], features, "feature", "value").where("value is not null")
    n_all = rows.count()
    cells = long.groupBy("feature", "value").agg(F.count("*").alias("n_term"), F.bround(F.avg(metric), 6).alias("mean_rate"))
    out = findings.select("feature", "value", "effect_points").join(cells, ["feature", "value"]).withColumn("share", F.bround(F.col("n_term") / F.lit(max(1, n_all)), 6))
    up = F.col("effect_points") > 0
    advice = F.when(up & (F.col("share") < 0.05), "try a few").when(up & (F.col("share") < 0.2), "increase").when(up, "keep").otherwise("reduce")
    return out.withColumn("advice", advice).orderBy(F.desc("effect_points"), "feature", "value").limit(top)


def part_baseline(df: DataFrame, part: list[str], metric: str = "sell_through_rate") -> DataFrame:
    return df.where(F.col(metric).isNotNull()).groupBy(*part).agg(F.avg(metric).alias("_base"))


def motif_breakdown(df: DataFrame, rules: list[tuple[str, str]], part: list[str], by: list[str] | None = None, name: str = "product_name", metric: str = "sell_through_rate", least: int = 6) -> DataFrame:
    """Overlapping groups of names by pattern: mean of (metric - the part's baseline) in points, counts and rates."""
    rows = df.where(F.col(metric).isNotNull()).join(F.broadcast(part_baseline(df, part, metric)), part)  # a row for each part
    long = rows.withColumn("motif", F.explode(all_matches(F.col(name), rules)))
    out = long.groupBy("motif", *(by or [])).agg(
        F.count("*").alias("n"),
        F.bround(F.avg(F.col(metric) - F.col("_base")) * 100, 5).alias("lift_points"),
        F.bround(F.avg(metric), 6).alias("mean_rate"),
        F.min("sku").alias("example"),
    )
    return out.where(F.col("n") >= least)


def cross_lift(df: DataFrame, a: str, b: str, part: list[str], name: str = "product_name", metric: str = "sell_through_rate") -> DataFrame:
    """Two patterns against each other: one row with the lifts of both, either and neither, and the interaction."""
    rows = df.where(F.col(metric).isNotNull()).join(F.broadcast(part_baseline(df, part, metric)), part)
    has_a, has_b, lift = F.col(name).rlike(a), F.col(name).rlike(b), (F.col(metric) - F.col("_base")) * 100
    cell = lambda when: F.avg(F.when(when, lift))
    out = rows.agg(
        F.count_if(has_a & has_b).alias("n_both"), F.bround(cell(has_a & has_b), 5).alias("both"), F.bround(cell(has_a & ~has_b), 5).alias("only_a"), F.bround(cell(~has_a & has_b), 5).alias("only_b"), F.bround(cell(~has_a & ~has_b), 5).alias("neither"),
    )
    return out.withColumn("interaction", F.bround(F.col("both") - F.col("only_a") - F.col("only_b") + F.col("neither"), 4))


def bootstrap_lift(df: DataFrame, rules: list[tuple[str, str]], part: list[str], name: str = "product_name", metric: str = "sell_through_rate", least: int = 6, draws: int = 3000, seed: int = 20260901) -> DataFrame:
    """The lift of each motif with a percentile interval of 95 % over resamples.

    A group enters as counts of its distinct differences, rounded to 6 places, so what a task holds is bounded by the
    values and not by the rows; resampling draws multinomial counts."""
    rows = df.where(F.col(metric).isNotNull()).join(F.broadcast(part_baseline(df, part, metric)), part)
    long = rows.select(F.explode(all_matches(F.col(name), rules)).alias("motif"), F.bround(F.col(metric) - F.col("_base"), 6).alias("d"))
    counted = long.groupBy("motif", "d").agg(F.count("*").alias("n"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("d", ignore_index=True)
        n, d = frame["n"].to_numpy(np.int64), frame["d"].to_numpy()
        total = int(n.sum())
        if total < least:
            return pd.DataFrame({"motif": [], "n": [], "lift_points": [], "low": [], "high": []})
        random = np.random.default_rng(seed)
        means = np.array([random.multinomial(total, n / total) @ d / total for _ in range(draws)]) * 100
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({"motif": [frame["motif"][0]], "n": [total], "lift_points": [float(n @ d / total * 100)], "low": [low], "high": [high]})

    return counted.groupBy("motif").applyInPandas(work, "motif string, n long, lift_points double, low double, high double")


def evidence_of(n: Column) -> Column:
    """How far a group of n rows can be relied on."""
    return F.when(n >= 30, "enough").when(n >= 12, "weak").otherwise("very weak")


def candidate_features(df: DataFrame, leave_out: list[str], least: int = 2, most: int = 40, filled: float = 0.05) -> list[str]:
    """Text columns with `least` to `most` distinct values that are filled in at least that share of the rows. One row of counts decides."""
    names = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name not in leave_out and not f.name.endswith(("_path", "_conf", "_id"))]
    if not names:
        return []
    row = df.agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(names)], *[F.count(c).alias(f"f{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if least <= row[f"d{i}"] <= most and row[f"f{i}"] >= filled * row["n"]]
