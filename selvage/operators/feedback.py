"""Feedback from shops: checks, summaries, what it says about the grades, and how well its authors forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.columns import map_of, pct_rank, quantiles, settled

#: Fixed: the groups of reason codes by their prefix, in the order in which they are asked for.
TAG_GROUPS = {"P": "PRODUCT", "F": "FIT", "PR": "PRICE", "S": "SUPPLY", "C": "CHANNEL", "M": "MARKET"}
VERDICTS = ["STAR", "OK", "SLOW", "MIXED"]
#: Fixed: rules (number, band, tags of which any counts, conclusion, action); the first that fits wins.
RULES = [
    (1, "SLOW", ["S_OOS_HOT", "S_SIZE_BROKEN", "S_LATE"], "not slow: a supply problem", "A_REORDER"),
    (2, "SLOW", ["F_TOO_TIGHT", "F_TOO_LOOSE", "F_SHOULDER", "F_WAIST_POS", "F_BODY_LEN", "F_NECK_OPEN", "F_RISE"], "slow: revise the fit", "A_REVISE_FIT"),
    (3, "SLOW", ["PR_TOO_HIGH", "PR_COMPETITOR", "PR_LOOK_CHEAP", "PR_DISCOUNT_ONLY"], "slow: review cost and price", "A_REPRICE"),
    (4, "SLOW", ["C_DISPLAY_BAD", "C_STAFF_NOPUSH", "C_EC_PHOTO", "C_STORE_MISMATCH"], "not slow: it wasn't seen", "A_RE_MERCH"),
    (5, "STAR", ["PR_DISCOUNT_ONLY"], "star by discount only: check the margin", "A_REPRICE"),
    (6, "STAR", ["S_QC"], "star at risk: settle quality first", "A_WATCH"),
]
#: Fixed: the action for the group that most reasons name.
GROUP_ACTIONS = {"FIT": "A_REVISE_FIT", "PRODUCT": "A_REVISE_FABRIC", "PRICE": "A_REPRICE", "SUPPLY": "A_REORDER", "CHANNEL": "A_RE_MERCH", "MARKET": "A_WATCH"}
#: Fixed: the chance of being right that a stated confidence claims.
CLAIMED = {"HIGH": 0.85, "MEDIUM": 0.65, "LOW": 0.50}


def tag_list(tags: Column) -> Column:
    """Codes between bars or commas, upper case, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), "[|,]"), lambda t: F.upper(F.trim(t))), lambda t: t != "")


def group_of(tag: Column) -> Column:
    prefix = F.regexp_extract(tag, "^([A-Z]+)_", 1)
    out = F.lit("OTHER")
    for p, name in TAG_GROUPS.items():
        out = F.when(prefix == p, name).otherwise(out)
    return out


def issues(feedback: DataFrame, allowed: list[str]) -> DataFrame:
    """Rows with an unknown verdict, unknown tags or no sku, and what is wrong with each."""
    unknown = F.array_except("reason_tag_list", F.array(*[F.lit(t) for t in allowed]))
    wrong = F.concat_ws(
        "; ",
        F.when(F.coalesce(F.col("sku").cast("string"), F.lit("")) == "", "no sku"),
        F.when(~F.coalesce(F.col("verdict").isin(VERDICTS), F.lit(False)), "unknown verdict"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown tags "), F.array_join(F.array_sort(unknown), ","))),
    )
    return feedback.withColumn("issues", wrong).where("issues <> ''")


def summarize(feedback: DataFrame) -> DataFrame:
    """For each sku: rows, the verdict most give (of several, the one given last), tags and groups in order."""
    rows = feedback.where("sku is not null")
    votes = rows.where("verdict is not null and verdict <> ''").groupBy("sku", "verdict").agg(F.count("*").alias("_n"), F.max("survey_date").alias("_last"))
    verdict = votes.groupBy("sku").agg(F.max_by("verdict", F.struct("_n", "_last", "verdict")).alias("fb_verdict"))
    tags = rows.select("sku", F.explode("reason_tag_list").alias("tag")).groupBy("sku").agg(F.array_sort(F.collect_set("tag")).alias("fb_tags"), F.array_sort(F.collect_set(group_of(F.col("tag")))).alias("fb_groups"))
    counts = rows.groupBy("sku").agg(F.count("*").alias("fb_n"), F.max("survey_date").alias("fb_last"))
    return counts.join(verdict, "sku", "left").join(tags, "sku", "left")


def action_of(tags: Column) -> Column:
    """The action for the group that most tags name; of several the one named first; to watch where that is none of GROUP_ACTIONS."""
    groups = F.transform(tags, group_of)
    counted = F.transform(F.array_distinct(groups), lambda g: F.struct(F.size(F.filter(groups, lambda x: x == g)), -F.array_position(groups, g), g.alias("group")))
    return F.coalesce(map_of(F.array_max(counted)["group"], GROUP_ACTIONS), F.lit("A_WATCH"))


def diagnose(graded: DataFrame, summary: DataFrame) -> DataFrame:
    """The first rule that band and tags meet, whether feedback and grade agree, and what to do, with what priority."""
    rows = graded.join(summary, "sku", "left")
    tags, band = F.coalesce("fb_tags", F.array().cast("array<string>")), F.col("perf_band")
    hit = lambda n: F.lit(None) if n is None else n
    rule = conclusion = action = hit(None)
    for number, of_band, of_tags, says, then in reversed(RULES):
        fits = (band == of_band) & F.arrays_overlap(tags, F.array(*[F.lit(t) for t in of_tags]))
        rule, conclusion, action = F.when(fits, number).otherwise(rule), F.when(fits, says).otherwise(conclusion), F.when(fits, then).otherwise(action)
    expected = F.when(band == "STAR", "STAR").when(band.isin("CORE", "STEADY"), "OK").when(band == "SLOW", "SLOW")
    said = F.col("fb_verdict")
    agreement = F.when(said.isNull(), "NO_FEEDBACK").when(said == "MIXED", "MIXED").when(F.coalesce(expected == said, F.lit(False)), "AGREE").otherwise("CONFLICT")
    rows = rows.withColumns({"rule": rule.cast("long"), "agreement": agreement})
    ruled, conflict, silent = F.col("rule").isNotNull(), F.col("agreement") == "CONFLICT", (F.col("agreement") == "NO_FEEDBACK") & band.isin("SLOW", "STAR")
    return rows.withColumns(
        {
            "diagnosis": F.when(ruled, conclusion).when(conflict, "grade and feedback conflict").when(silent, "feedback is missing").when(band == "STAR", "star, agreed").when(band == "SLOW", "slow, agreed").otherwise("as expected"),
            "action": F.when(ruled, action).when(conflict | silent, "A_WATCH").when(band == "STAR", "A_CARRYOVER").when(band == "SLOW", action_of(tags)).otherwise("A_WATCH"),
            "priority": F.when(ruled | conflict, "HIGH").when(silent | (band == "SLOW"), "MEDIUM").otherwise("LOW"),
        }
    )


def diagnosis_summary(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.groupBy("category").agg(
        F.count("*").alias("n"),
        F.count("fb_verdict").alias("n_feedback"),
        F.count_if(F.col("agreement") == "CONFLICT").alias("n_conflict"),
        F.count_if(F.col("rule").isin(1, 4)).alias("n_false_slow"),
        F.count_if(F.col("rule").isin(2, 3)).alias("n_true_slow"),
        F.count_if(F.col("priority") == "HIGH").alias("n_high"),
    )


def top_actions(diagnosed: DataFrame, top: int = 5) -> DataFrame:
    """The commonest actions."""
    return diagnosed.groupBy("action").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "action").limit(top)


def attribution(diagnosed: DataFrame, attributes: list[str], least: int = 4, top: int = 3, lift: float = 1.2, share: float = 0.05) -> DataFrame:
    """For each tag of `least` rows or more: the options that are more common among its rows than among all, by share."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("option")) for a in attributes]))
    base = diagnosed.select(pairs.alias("p")).select("p.*").groupBy("attribute", "option").agg(F.count("*").alias("_n"))
    total = Window.partitionBy("attribute")
    base = base.withColumn("_base", F.col("_n") / F.sum("_n").over(total)).drop("_n")
    long = diagnosed.select(F.explode("fb_tags").alias("tag"), *attributes).select("tag", pairs.alias("p")).select("tag", "p.*")
    cells = long.groupBy("tag", "attribute", "option").agg(F.count("*").alias("n"))
    of_tag = Window.partitionBy("tag", "attribute")
    cells = cells.withColumn("_all", F.sum("n").over(of_tag)).where(F.col("_all") >= least).join(base, ["attribute", "option"])
    cells = cells.withColumn("share", F.col("n") / F.col("_all")).withColumn("lift", F.col("share") / F.col("_base"))
    place = F.row_number().over(of_tag.orderBy(F.desc("share"), "option"))
    out = cells.withColumn("place", place.cast("long")).where((F.col("place") <= top) & (F.col("lift") >= lift) & (F.col("share") >= share))
    return out.select("tag", "attribute", "option", "place", "n", F.bround("share", 6).alias("share"), F.bround("lift", 5).alias("lift"))


def coverage_gap(diagnosed: DataFrame, top: int = 50) -> DataFrame:
    """Best and worst rows without feedback, by impact: .6 of the stock's rank and .4 of the sales' among them."""
    rows = diagnosed.where((F.col("agreement") == "NO_FEEDBACK") & F.col("perf_band").isin("STAR", "SLOW"))
    rows = settled(rows.select("sku", "season", "perf_band", "stock_in", F.bround("sales_amount", 0).alias("_amount")))
    ranked = pct_rank(pct_rank(rows, [], "stock_in", "_a"), [], "_amount", "_b")
    impact = F.bround(0.6 * F.col("_a") + 0.4 * F.col("_b"), 6)
    return ranked.select("sku", "season", "perf_band", "stock_in", impact.alias("impact")).orderBy(F.desc("impact"), "sku", "season").limit(top)


def actual_verdict(outcomes: DataFrame, by: list[str], rate: str = "sell_through_rate") -> DataFrame:
    """STAR from the group's 70 % quantile, SLOW up to its 30 % quantile (which wins where both are equal), else OK."""
    edges = quantiles(outcomes, by, rate, [0.3, 0.7]).select(*by, F.get("_edges", 0).alias("_lo"), F.get("_edges", 1).alias("_hi"))
    x = F.col(rate)
    return outcomes.join(edges, by).withColumn("actual", F.when(x <= F.col("_lo"), "SLOW").when(x >= F.col("_hi"), "STAR").otherwise("OK")).drop("_hi", "_lo")


def scored(feedback: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Feedback beside outcomes of its sku: right, reversed, the claimed chance, and its Brier score."""
    rows = feedback.join(outcomes.select("sku", "season", "actual"), "sku")
    claimed = F.lit(None).cast("double")
    for name, p in CLAIMED.items():
        claimed = F.when(F.col("confidence") == name, p).otherwise(claimed)
    right = F.col("verdict") == F.col("actual")
    turned = ((F.col("verdict") == "STAR") & (F.col("actual") == "SLOW")) | ((F.col("verdict") == "SLOW") & (F.col("actual") == "STAR"))
    return rows.withColumns({"correct": right, "reversed": turned, "claimed": claimed}).withColumn("brier", F.pow(F.col("claimed") - F.col("correct").cast("double"), 2))


def _accuracy(when: Column | None = None) -> Column:
    right = F.col("correct").cast("double")
    return F.bround(F.avg(right if when is None else F.when(when, right)), 6)


def by_respondent(rows: DataFrame, least: int = 12, half: int = 5) -> DataFrame:
    high = F.col("confidence") == "HIGH"
    return rows.groupBy("respondent").agg(
        F.count("*").alias("n"),
        F.when(F.count("*") >= least, _accuracy()).alias("accuracy"),
        F.bround(F.avg("brier"), 6).alias("brier"),
        F.count_if("reversed").alias("n_reversed"),
        F.when(F.count_if(high) >= half, _accuracy(high)).alias("accuracy_high"),
        F.when(F.count_if(~high) >= half, _accuracy(~high)).alias("accuracy_rest"),
    )


def by_confidence(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("confidence").agg(F.count("*").alias("n"), F.first("claimed").alias("claimed"), _accuracy().alias("accuracy"), F.bround(F.avg("brier"), 6).alias("brier"))
    return out.withColumn("overconfidence", F.bround(F.col("claimed") - F.col("accuracy"), 5))


def by_tag(rows: DataFrame, least: int = 8) -> DataFrame:
    long = rows.select("correct", F.explode("reason_tag_list").alias("tag"))
    return long.groupBy("tag").agg(F.count("*").alias("n"), _accuracy().alias("accuracy")).where(F.col("n") >= least)


def calibration_summary(rows: DataFrame) -> DataFrame:
    """Accuracy and Brier score overall, beside the accuracy of always saying OK."""
    return rows.agg(
        F.count("*").alias("n"), F.countDistinct("respondent").alias("n_respondents"), F.countDistinct("sku").alias("n_skus"), _accuracy().alias("accuracy"), F.bround(F.avg("brier"), 6).alias("brier"),
        F.bround(F.avg((F.col("actual") == "OK").cast("double")), 6).alias("always_ok"),
    )
