"""Queries on feedback, forecasts and plans, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from selvage.operators import feedback, planning

from .adapter import GRADED_SQL, MASTER_SQL, read
from .findings import ASSOCIATION_SQL, _association
from .sales_reports import ANALYSED, analysed, graded

QUERIES, ORACLES = {}, {}

#: The stand-in's tags, of which a row has those at k % 12 and (k / 12) % 12.
TAGS = ["S_OOS_HOT", "F_TOO_TIGHT", "PR_TOO_HIGH", "C_DISPLAY_BAD", "PR_DISCOUNT_ONLY", "S_QC", "P_COLOR_GOOD", "F_FIT_GOOD", "PR_WORTH", "C_STAFF_PUSH", "M_TREND_HIT", "X_UNKNOWN"]
VERDICT = {"purchase": "STAR", "signup": "STAR", "click": "OK", "view": "OK", "error": "SLOW"}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def feedback_rows(spark, sf_dir):
    """Events as feedback: the person is the user, the style is the event's number modulo the number of parts."""
    n = read(spark, sf_dir, "part").count()
    events = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.array(*[F.lit(t) for t in TAGS])
    verdict = F.lit(None).cast("string")
    for kind, says in VERDICT.items():
        verdict = F.when(F.col("event_type") == kind, says).otherwise(verdict)
    text = F.concat_ws("|", F.element_at(tags, k % 12 + 1), F.element_at(tags, (F.floor(k / 12) % 12 + 1).cast("int")))
    return events.select(
        "event_id", (F.col("event_id") % n).alias("sku"), F.col("user_id").alias("respondent"), verdict.alias("verdict"), F.array_distinct(feedback.tag_list(text)).alias("reason_tag_list"),
        F.col("ts").cast("date").alias("survey_date"), F.when(F.col("value") >= 70, "HIGH").when(F.col("value") >= 30, "MEDIUM").otherwise("LOW").alias("confidence"),
    )


FEEDBACK_SQL = """fb0 AS (SELECT *, CAST(props ->> '$.k' AS BIGINT) AS k FROM events), fb AS (
  SELECT event_id, event_id % (SELECT count(*) FROM part) AS sku, user_id AS respondent, CASE event_type WHEN 'purchase' THEN 'STAR' WHEN 'signup' THEN 'STAR' WHEN 'click' THEN 'OK' WHEN 'view' THEN 'OK' WHEN 'error' THEN 'SLOW' END AS verdict,
    list_distinct([t[k % 12 + 1], t[(k // 12) % 12 + 1]]) AS tags, CAST(ts AS DATE) AS survey_date, CASE WHEN value >= 70 THEN 'HIGH' WHEN value >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM fb0, (SELECT ['S_OOS_HOT','F_TOO_TIGHT','PR_TOO_HIGH','C_DISPLAY_BAD','PR_DISCOUNT_ONLY','S_QC','P_COLOR_GOOD','F_FIT_GOOD','PR_WORTH','C_STAFF_PUSH','M_TREND_HIT','X_UNKNOWN'] AS t)
), grp AS (SELECT * FROM (VALUES ('P', 'PRODUCT'), ('F', 'FIT'), ('PR', 'PRICE'), ('S', 'SUPPLY'), ('C', 'CHANNEL'), ('M', 'MARKET'), ('X', 'OTHER')) AS v(prefix, g)),
ft AS (SELECT sku, unnest(tags) AS tag FROM fb),
tags AS (SELECT sku, list_sort(list_distinct(list(tag))) AS fb_tags, list_sort(list_distinct(list(g))) AS fb_groups FROM ft JOIN grp ON prefix = regexp_extract(tag, '^([A-Z]+)_', 1) GROUP BY sku),
votes AS (SELECT sku, verdict, count(*) AS n, max(survey_date) AS last FROM fb WHERE verdict IS NOT NULL GROUP BY ALL),
verdicts AS (SELECT sku, verdict AS fb_verdict FROM votes QUALIFY row_number() OVER (PARTITION BY sku ORDER BY n DESC, last DESC, verdict DESC) = 1),
fsum AS (SELECT sku, count(*) AS fb_n, max(survey_date) AS fb_last FROM fb GROUP BY sku),
summary AS (SELECT * FROM fsum LEFT JOIN verdicts USING (sku) LEFT JOIN tags USING (sku))"""


@query(f"WITH {FEEDBACK_SQL} SELECT sku, fb_n, fb_last, fb_verdict, array_to_string(fb_tags, '|') AS fb_tags, array_to_string(fb_groups, '|') AS fb_groups FROM summary")
def feedback_summary(spark, sf_dir):
    return feedback.summarize(feedback_rows(spark, sf_dir)).withColumns({"fb_tags": F.array_join("fb_tags", "|"), "fb_groups": F.array_join("fb_groups", "|")})


@query(f"WITH {FEEDBACK_SQL} SELECT event_id, sku, 'unknown tags X_UNKNOWN' AS issues FROM fb WHERE list_contains(tags, 'X_UNKNOWN')")
def feedback_issues(spark, sf_dir):
    return feedback.issues(feedback_rows(spark, sf_dir), TAGS[:-1]).select("event_id", "sku", "issues")


BY_GROUP = "CASE list_sort(list_transform(list_distinct(gl), lambda g: {'n': -len(list_filter(gl, lambda x: x = g)), 'p': list_position(gl, g), 'g': g}))[1].g WHEN 'FIT' THEN 'A_REVISE_FIT' WHEN 'PRODUCT' THEN 'A_REVISE_FABRIC' WHEN 'PRICE' THEN 'A_REPRICE' WHEN 'SUPPLY' THEN 'A_REORDER' WHEN 'CHANNEL' THEN 'A_RE_MERCH' ELSE 'A_WATCH' END"
DIAGNOSED_SQL = GRADED_SQL + ", " + FEEDBACK_SQL + f""", g0 AS (SELECT graded.*, fb_n, fb_verdict, coalesce(fb_tags, []) AS t FROM graded LEFT JOIN summary USING (sku)),
  g1 AS (SELECT *, CASE WHEN perf_band = 'SLOW' AND list_has_any(t, ['S_OOS_HOT','S_SIZE_BROKEN','S_LATE']) THEN 1 WHEN perf_band = 'SLOW' AND list_has_any(t, ['F_TOO_TIGHT','F_TOO_LOOSE','F_SHOULDER','F_WAIST_POS','F_BODY_LEN','F_NECK_OPEN','F_RISE']) THEN 2
      WHEN perf_band = 'SLOW' AND list_has_any(t, ['PR_TOO_HIGH','PR_COMPETITOR','PR_LOOK_CHEAP','PR_DISCOUNT_ONLY']) THEN 3 WHEN perf_band = 'SLOW' AND list_has_any(t, ['C_DISPLAY_BAD','C_STAFF_NOPUSH','C_EC_PHOTO','C_STORE_MISMATCH']) THEN 4
      WHEN perf_band = 'STAR' AND list_has_any(t, ['PR_DISCOUNT_ONLY']) THEN 5 WHEN perf_band = 'STAR' AND list_has_any(t, ['S_QC']) THEN 6 END AS rule,
    CASE WHEN fb_verdict IS NULL THEN 'NO_FEEDBACK' WHEN fb_verdict = 'MIXED' THEN 'MIXED' WHEN fb_verdict = CASE WHEN perf_band = 'STAR' THEN 'STAR' WHEN perf_band IN ('CORE', 'STEADY') THEN 'OK' WHEN perf_band = 'SLOW' THEN 'SLOW' END THEN 'AGREE' ELSE 'CONFLICT' END AS agreement,
    list_transform(t, lambda x: CASE regexp_extract(x, '^([A-Z]+)_', 1) WHEN 'P' THEN 'PRODUCT' WHEN 'F' THEN 'FIT' WHEN 'PR' THEN 'PRICE' WHEN 'S' THEN 'SUPPLY' WHEN 'C' THEN 'CHANNEL' WHEN 'M' THEN 'MARKET' ELSE 'OTHER' END) AS gl FROM g0),
  diagnosed AS (SELECT *, agreement = 'NO_FEEDBACK' AND perf_band IN ('SLOW', 'STAR') AS silent,
    CASE WHEN rule IS NOT NULL THEN (['not slow: a supply problem', 'slow: revise the fit', 'slow: review cost and price', 'not slow: it wasn''t seen', 'star by discount only: check the margin', 'star at risk: settle quality first'])[rule]
      WHEN agreement = 'CONFLICT' THEN 'grade and feedback conflict' WHEN agreement = 'NO_FEEDBACK' AND perf_band IN ('SLOW', 'STAR') THEN 'feedback is missing' WHEN perf_band = 'STAR' THEN 'star, agreed' WHEN perf_band = 'SLOW' THEN 'slow, agreed' ELSE 'as expected' END AS diagnosis,
    CASE WHEN rule IS NOT NULL THEN (['A_REORDER', 'A_REVISE_FIT', 'A_REPRICE', 'A_RE_MERCH', 'A_REPRICE', 'A_WATCH'])[rule] WHEN agreement = 'CONFLICT' OR (agreement = 'NO_FEEDBACK' AND perf_band IN ('SLOW', 'STAR')) THEN 'A_WATCH' WHEN perf_band = 'STAR' THEN 'A_CARRYOVER' WHEN perf_band = 'SLOW' THEN {BY_GROUP} ELSE 'A_WATCH' END AS action,
    CASE WHEN rule IS NOT NULL OR agreement = 'CONFLICT' THEN 'HIGH' WHEN (agreement = 'NO_FEEDBACK' AND perf_band IN ('SLOW', 'STAR')) OR perf_band = 'SLOW' THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM g1)"""


def diagnosed(spark, sf_dir):
    return feedback.diagnose(graded(spark, sf_dir), feedback.summarize(feedback_rows(spark, sf_dir)))


@query(f"WITH {DIAGNOSED_SQL} SELECT sku, season, perf_band, coalesce(fb_verdict, '-') AS fb_verdict, coalesce(rule, 0) AS rule, agreement, diagnosis, action, priority FROM diagnosed")
def diagnosis(spark, sf_dir):
    return diagnosed(spark, sf_dir).select("sku", "season", "perf_band", F.coalesce("fb_verdict", F.lit("-")).alias("fb_verdict"), F.coalesce("rule", F.lit(0)).cast("long").alias("rule"), "agreement", "diagnosis", "action", "priority")


@query(f"WITH {DIAGNOSED_SQL} SELECT category, count(*) AS n, count(fb_verdict) AS n_feedback, count(*) FILTER (WHERE agreement = 'CONFLICT') AS n_conflict, count(*) FILTER (WHERE rule IN (1, 4)) AS n_false_slow, count(*) FILTER (WHERE rule IN (2, 3)) AS n_true_slow, count(*) FILTER (WHERE priority = 'HIGH') AS n_high FROM diagnosed GROUP BY category")
def diagnosis_summary(spark, sf_dir):
    return feedback.diagnosis_summary(diagnosed(spark, sf_dir))


@query(f"""WITH {DIAGNOSED_SQL}, p AS (SELECT 'color' AS attribute, color AS option, t FROM diagnosed UNION ALL SELECT 'sub_category', sub_category, t FROM diagnosed UNION ALL SELECT 'product_line', product_line, t FROM diagnosed),
  b AS (SELECT attribute, option, count(*) / sum(count(*)) OVER (PARTITION BY attribute) AS base FROM p GROUP BY attribute, option),
  c AS (SELECT tag, attribute, option, count(*) AS n FROM (SELECT attribute, option, unnest(t) AS tag FROM p) GROUP BY ALL),
  d AS (SELECT *, CAST(sum(n) OVER (PARTITION BY tag, attribute) AS DOUBLE) AS total FROM c), e AS (SELECT d.*, n / total AS share, n / total / base AS lift FROM d JOIN b USING (attribute, option) WHERE total >= 4),
  o AS (SELECT *, row_number() OVER (PARTITION BY tag, attribute ORDER BY share DESC, option) AS place FROM e)
  SELECT tag, attribute, option, place, n, round_even(share, 6) AS share, round_even(lift, 5) AS lift FROM o WHERE place <= 3 AND lift >= 1.05 AND share >= 0.05""")
def attribution(spark, sf_dir):
    return feedback.attribution(diagnosed(spark, sf_dir), ["color", "sub_category", "product_line"], lift=1.05)


@query(f"""WITH {DIAGNOSED_SQL}, r AS (SELECT sku, season, perf_band, stock_in, round_even(sales_amount, 0) AS amount FROM diagnosed WHERE agreement = 'NO_FEEDBACK' AND perf_band IN ('STAR', 'SLOW')),
  k AS (SELECT *, (rank() OVER (ORDER BY stock_in) + (count(*) OVER (PARTITION BY stock_in) - 1) / 2.0) / count(*) OVER () AS a, (rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0) / count(*) OVER () AS b FROM r)
  SELECT sku, season, perf_band, stock_in, round_even(0.6 * a + 0.4 * b, 6) AS impact FROM k ORDER BY impact DESC, sku, season LIMIT 50""")
def coverage_gap(spark, sf_dir):
    rows = feedback.diagnose(graded(spark, sf_dir), feedback.summarize(feedback_rows(spark, sf_dir).where("verdict = 'SLOW'")))
    return feedback.coverage_gap(rows)


ORACLES["coverage_gap"] = ORACLES["coverage_gap"].replace("FROM fb0, (SELECT [", "FROM fb0, (SELECT [", 1).replace("summary AS (SELECT * FROM fsum LEFT JOIN", "summary AS (SELECT * FROM fsum LEFT JOIN").replace("FROM events)", "FROM events WHERE event_type = 'error')")

SCORED_SQL = ANALYSED + ", " + FEEDBACK_SQL + """, e AS (SELECT category, season, quantile_cont(sell_through_rate, 0.7) AS hi, quantile_cont(sell_through_rate, 0.3) AS lo FROM analysed GROUP BY ALL),
  actual AS (SELECT sku, season, CASE WHEN sell_through_rate <= lo THEN 'SLOW' WHEN sell_through_rate >= hi THEN 'STAR' ELSE 'OK' END AS actual FROM analysed JOIN e USING (category, season)),
  scored AS (SELECT fb.*, actual, verdict = actual AS correct, (verdict = 'STAR' AND actual = 'SLOW') OR (verdict = 'SLOW' AND actual = 'STAR') AS turned, CASE confidence WHEN 'HIGH' THEN 0.85 WHEN 'MEDIUM' THEN 0.65 WHEN 'LOW' THEN 0.50 END::DOUBLE AS claimed FROM fb JOIN actual USING (sku)),
  s AS (SELECT *, pow(claimed - CAST(correct AS INT), 2) AS brier, CAST(CAST(correct AS INT) AS DOUBLE) AS c FROM scored)"""


def scored(spark, sf_dir):
    return feedback.scored(feedback_rows(spark, sf_dir), feedback.actual_verdict(analysed(spark, sf_dir), ["category", "season"]))


@query(f"""WITH {SCORED_SQL} SELECT respondent, count(*) AS n, CASE WHEN count(*) >= 12 THEN round_even(avg(c), 6) END AS accuracy, round_even(avg(brier), 6) AS brier, count(*) FILTER (WHERE turned) AS n_reversed,
  CASE WHEN count(*) FILTER (WHERE confidence = 'HIGH') >= 5 THEN round_even(avg(c) FILTER (WHERE confidence = 'HIGH'), 6) END AS accuracy_high, CASE WHEN count(*) FILTER (WHERE confidence <> 'HIGH') >= 5 THEN round_even(avg(c) FILTER (WHERE confidence <> 'HIGH'), 6) END AS accuracy_rest FROM s GROUP BY respondent""")
def calibration_person(spark, sf_dir):
    return feedback.by_respondent(scored(spark, sf_dir))


@query(f"WITH {SCORED_SQL} SELECT confidence, count(*) AS n, any_value(claimed) AS claimed, round_even(avg(c), 6) AS accuracy, round_even(avg(brier), 6) AS brier, round_even(any_value(claimed) - round_even(avg(c), 6), 5) AS overconfidence FROM s GROUP BY confidence")
def calibration_confidence(spark, sf_dir):
    return feedback.by_confidence(scored(spark, sf_dir))


@query(f"WITH {SCORED_SQL} SELECT tag, count(*) AS n, round_even(avg(c), 6) AS accuracy FROM (SELECT c, unnest(tags) AS tag FROM s) GROUP BY tag HAVING count(*) >= 8")
def calibration_tag(spark, sf_dir):
    return feedback.by_tag(scored(spark, sf_dir))


@query(f"WITH {SCORED_SQL} SELECT count(*) AS n, count(DISTINCT respondent) AS n_respondents, count(DISTINCT sku) AS n_skus, round_even(avg(c), 6) AS accuracy, round_even(avg(brier), 6) AS brier, round_even(avg(CASE WHEN actual = 'OK' THEN 1.0 ELSE 0.0 END), 6) AS always_ok FROM s")
def calibration_summary(spark, sf_dir):
    return feedback.calibration_summary(scored(spark, sf_dir))


RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0) / count(*) OVER ()"


@query(f"""WITH {GRADED_SQL}, r AS (SELECT sku, season, category, round_even(sell_through_rate, 6) AS r, round_even(avg_selling_price, 2) AS p, round_even(discount_depth, 4) AS d FROM graded WHERE perf_band IN ('STAR', 'CORE')),
  k AS (SELECT *, round_even(0.5 * {RANK.format('r')} + 0.3 * {RANK.format('p')} - 0.2 * {RANK.format('d')}, 6) AS score FROM r)
  SELECT sku, season, category, score FROM k QUALIFY row_number() OVER (PARTITION BY sku ORDER BY score DESC, season) = 1 ORDER BY score DESC, sku LIMIT 60""")
def carryover(spark, sf_dir):
    return planning.carryover_candidates(graded(spark, sf_dir))


@query(f"""WITH {MASTER_SQL}, m AS (SELECT category, count(DISTINCT sku) AS n FROM master GROUP BY category), x AS (SELECT category, n / sum(n) OVER () AS share FROM m),
  w AS (SELECT * FROM (VALUES ('SS-EARLY', 6), ('SS-MAIN', 12), ('SS-LATE', 8), ('AW-EARLY', 9), ('AW-MAIN', 10), ('AW-LATE', 7)) AS v(wave, weeks)),
  y AS (SELECT wave, category, share, CAST(round_even(CAST(450 AS DOUBLE) * weeks / 52 * share, 0) AS BIGINT) AS n_styles FROM x, w), z AS (SELECT *, CAST(round_even(CAST(n_styles AS DOUBLE) * 0.65::DOUBLE, 0) AS BIGINT) AS n_new FROM y)
  SELECT wave, category, round_even(share, 6) AS share, n_styles, n_new, n_styles - n_new AS n_carry FROM z""")
def plan_year(spark, sf_dir):
    return planning.year_plan(graded(spark, sf_dir))


@query(f"WITH {ASSOCIATION_SQL}, o AS (SELECT category, attribute, option, n, lift, row_number() OVER (PARTITION BY category, attribute ORDER BY lift DESC, option) AS place FROM association WHERE lift > 1) SELECT * FROM o WHERE place <= 2")
def winning_recipe(spark, sf_dir):
    return planning.winning_recipe(_association(spark, sf_dir))


@query(f"WITH {ASSOCIATION_SQL} SELECT category, attribute, option, n, lift FROM association WHERE lift < 0.95")
def risk_list(spark, sf_dir):
    return planning.risk_list(_association(spark, sf_dir), below=0.95)


@query("""WITH t AS (SELECT p_partkey AS sku, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place FROM part WHERE p_type = 'SMALL' ORDER BY p_retailprice DESC, p_partkey LIMIT 20),
  b AS (SELECT p_partkey AS sku, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place FROM part WHERE p_type = 'LARGE' ORDER BY p_retailprice DESC, p_partkey LIMIT 8)
  SELECT b.sku AS bottom, k, t.sku AS top FROM b, (SELECT unnest([0, 1, 2]) AS k), t WHERE t.place = (b.place * 3 + k) % 20""")
def outfits(spark, sf_dir):
    parts = read(spark, sf_dir, "part")

    def best(kind, n):
        rows = parts.where(F.col("p_type") == kind).orderBy(F.desc("p_retailprice"), "p_partkey").limit(n)  # a top-k list
        return rows.select(F.col("p_partkey").alias("sku"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("p_retailprice"), "p_partkey")) - 1).alias("place"))

    return planning.outfits(best("SMALL", 20), best("LARGE", 8))
