"""Association of attributes and measures with success, corrected for the number of comparisons."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.functions.columns import bin_of, pct_rank, quantile_edges, ratio, unpivoted


def _upper_gamma(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x): a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = i * (a - i)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_p(chi2: float, dof: float) -> float:
    """Chance of a chi-square of at least this much."""
    return _upper_gamma(dof / 2, chi2 / 2)


@F.pandas_udf(T.DoubleType())
def chi2_p_value(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_p(x, k) if k > 0 else None for x, k in zip(chi2, dof)], dtype="float64")


def attribute_association(graded: DataFrame, attributes: list[str], by: str = "category", wins: tuple[str, ...] = ("STAR", "CORE"), least_cell: int = 5, skip: tuple[str, ...] = ("n/a", "uncertain")) -> DataFrame:
    """One row for each group, attribute and option with least_cell rows or more: success rate, lift over the group's base
    rate, and, for the whole attribute with two such options or more, chi-square, its degrees of freedom and Cramér's V."""
    rows = graded.where(F.col("perf_band") != "EXCLUDED").withColumn("_win", F.col("perf_band").isin(*wins).cast("long"))
    base = rows.groupBy(by).agg(F.avg(F.col("_win").cast("double")).alias("base_rate"))
    long = unpivoted(rows.select(by, "_win", "sell_through_rate", *attributes), [by, "_win", "sell_through_rate"], attributes, "attribute", "option")
    long = long.where(F.col("option").isNotNull() & ~F.col("option").isin(*skip))
    cells = long.groupBy(by, "attribute", "option").agg(F.count("*").alias("n"), F.sum("_win").alias("n_win"), F.median("sell_through_rate").alias("_median")).where(F.col("n") >= least_cell)
    table = Window.partitionBy(by, "attribute")
    total, won = F.sum("n").over(table), F.sum("n_win").over(table)
    expected_win, expected_not = F.col("n") * won / total, F.col("n") * (total - won) / total
    part = ratio(F.pow(F.col("n_win") - expected_win, 2), expected_win) + ratio(F.pow(F.col("n") - F.col("n_win") - expected_not, 2), expected_not)
    cells = cells.withColumns({"_part": part, "n_options": F.count("*").over(table), "_total": total, "_won": won})
    cells = cells.where((F.col("n_options") >= 2) & (F.col("_won") > 0) & (F.col("_won") < F.col("_total")))
    chi2 = F.sum("_part").over(table)
    cells = cells.withColumn("chi2", chi2).withColumn("cramers_v", F.sqrt(F.col("chi2") / F.col("_total"))).withColumn("dof", F.col("n_options") - 1)
    out = cells.join(F.broadcast(base), by)  # one row for each group
    rate = F.col("n_win") / F.col("n")
    return out.select(
        by, "attribute", "option", "n", "n_win", F.bround(rate, 6).alias("success_rate"), F.bround(rate / F.col("base_rate"), 6).alias("lift"), F.bround("_median", 6).alias("median_rate"),
        F.bround("chi2", 6).alias("chi2"), "dof", F.bround("cramers_v", 6).alias("cramers_v"), "n_options",
    )


def with_q_values(association: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """p of each table and Benjamini and Hochberg's q over all tables (there are groups times attributes of them), and whether q is below alpha."""
    tables = association.groupBy(*keys).agg(F.first("chi2").alias("_chi2"), F.first("dof").alias("_dof")).withColumn("p", chi2_p_value(F.col("_chi2"), F.col("_dof").cast("double")))
    return association.join(benjamini_hochberg(tables, "p", keys).select(*keys, "p", "q"), keys).withColumn("significant", F.col("q") < alpha)


def benjamini_hochberg(tests: DataFrame, p: str, order: list[str]) -> DataFrame:
    """tests with q. The window runs over tests, not over data."""
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(p, *order))
    raw = F.col(p) * F.count("*").over(everything) / F.col("_place")
    from_here = everything.orderBy("_place").rowsBetween(0, Window.unboundedFollowing)
    return tests.withColumn("_place", place).withColumn("_raw", raw).withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(from_here))).drop("_place", "_raw")


def top_findings(association: DataFrame, by: str = "category", least: int = 10, top: int = 15) -> DataFrame:
    """The `top` options of each group by |lift - 1| * V."""
    effect = F.bround(F.abs(F.col("lift") - 1) * F.col("cramers_v"), 6)
    rows = association.where(F.col("n") >= least).withColumn("effect", effect)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("effect"), "attribute", "option"))
    told = F.concat_ws(" ", F.col("attribute"), F.lit("="), F.col("option"), F.when(F.col("lift") >= 1, F.lit("raises")).otherwise(F.lit("lowers")), F.lit("success"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= top).select(by, "place", "attribute", "option", "n", "lift", "effect", told.alias("sentence"))


def spearman(graded: DataFrame, metrics: list[str], by: str = "category", target: str = "sell_through_rate", least: int = 15) -> DataFrame:
    """Spearman's rho of each measure with the target within each group, and the medians of the best and the worst band."""
    rows = graded.where(F.col("perf_band") != "EXCLUDED")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = rows.select(by, "perf_band", F.col(target).alias("_y"), pairs.alias("_p")).select(by, "perf_band", "_y", "_p.*").where("value is not null and _y is not null")
    ranked = pct_rank(pct_rank(long, [by, "metric"], "value", "_rx"), [by, "metric"], "_y", "_ry")
    out = ranked.groupBy(by, "metric").agg(
        F.count("*").alias("n"),
        F.bround(F.corr("_rx", "_ry"), 6).alias("rho"),
        F.bround(F.median(F.when(F.col("perf_band") == "STAR", F.col("value"))), 6).alias("median_star"),
        F.bround(F.median(F.when(F.col("perf_band") == "SLOW", F.col("value"))), 6).alias("median_slow"),
    )
    return out.where(F.col("n") >= least).withColumn("direction", F.when(F.col("rho") > 0, "more is better").when(F.col("rho") < 0, "less is better").otherwise("flat"))


def sweet_spot(graded: DataFrame, metrics: list[str], by: str = "category", bins: int = 5, least: int = 30) -> DataFrame:
    """Quantile bins of each measure within each group: edges, median rate, shares of the best and the worst band, and the winning bin."""
    rows = graded.where(F.col("perf_band") != "EXCLUDED")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = rows.select(by, "perf_band", "sell_through_rate", pairs.alias("_p")).select(by, "perf_band", "sell_through_rate", "_p.*").where("value is not null")
    edges = quantile_edges(long, [by, "metric"], "value", bins, least)
    binned = long.join(F.broadcast(edges.drop("_n")), [by, "metric"]).withColumn("bin", bin_of(F.col("value"), F.col("_edges")).cast("long"))  # a row for each group and measure
    out = binned.groupBy(by, "metric", "bin").agg(
        F.count("*").alias("n"),
        F.bround(F.get(F.first("_edges"), F.first("bin").cast("int") - 1), 6).alias("low"),
        F.bround(F.get(F.first("_edges"), F.first("bin").cast("int")), 6).alias("high"),
        F.bround(F.median("sell_through_rate"), 6).alias("median_rate"),
        F.bround(F.avg((F.col("perf_band") == "STAR").cast("double")), 6).alias("star_rate"),
        F.bround(F.avg((F.col("perf_band") == "SLOW").cast("double")), 6).alias("slow_rate"),
    )
    return out.withColumn("is_best", F.col("median_rate") == F.max("median_rate").over(Window.partitionBy(by, "metric")))


def sweet_spot_targets(spots: DataFrame, by: str = "category") -> DataFrame:
    """The winning bin of each group and measure: its range and its middle; of several the lowest."""
    best = spots.where("is_best").groupBy(by, "metric").agg(F.min_by(F.struct("low", "high", "median_rate"), "bin").alias("b")).select(by, "metric", "b.*")
    return best.withColumn("middle", F.bround((F.col("low") + F.col("high")) / 2, 6))


def deviations(candidates: DataFrame, targets: DataFrame, metrics: list[str], by: str = "category") -> DataFrame:
    """For each candidate and measure, whether it lies in the target range, and by how much it misses it."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = candidates.select("sku", "season", by, pairs.alias("_p")).select("sku", "season", by, "_p.*").where("value is not null")
    out = long.join(F.broadcast(targets), [by, "metric"])  # a row for each group and measure
    miss = F.when(F.col("value") < F.col("low"), F.col("value") - F.col("low")).when(F.col("value") > F.col("high"), F.col("value") - F.col("high")).otherwise(0.0)
    return out.select("sku", "season", by, "metric", F.bround("value", 6).alias("value"), F.when(miss == 0, "IN").otherwise("OUT").alias("verdict"), F.bround(miss, 5).alias("gap"))
