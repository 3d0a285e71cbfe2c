"""Queries on association, lifts and motifs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from selvage.functions.columns import settled
from selvage.operators import association, lift

from .adapter import GRADED_SQL
from .sales_reports import TERMS_SQL, graded, terms

QUERIES, ORACLES = {}, {}

ATTRIBUTES = ["color", "sub_category", "product_line"]
METRICS = ["list_price", "size", "discount_depth"]
MOTIFS = [("hot|red|large", "warm"), ("blue|cold|small", "cool"), ("ring|bolt", "metal"), ("anvil|case|box", "solid")]


def _measured(spark, sf_dir):
    """The graded rows' measures, computed once: edges, bins, ranks and candidates are passes over these few columns."""
    return settled(graded(spark, sf_dir).where("perf_band <> 'EXCLUDED'").select("sku", "season", "category", "perf_band", "sell_through_rate", *METRICS))


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


ASSOCIATION_SQL = GRADED_SQL + """, r AS (SELECT *, CASE WHEN perf_band IN ('STAR', 'CORE') THEN 1 ELSE 0 END AS win FROM graded WHERE perf_band <> 'EXCLUDED'),
  base AS (SELECT category, avg(CAST(win AS DOUBLE)) AS base_rate FROM r GROUP BY category),
  l AS (SELECT category, win, sell_through_rate, 'color' AS attribute, color AS option FROM r UNION ALL SELECT category, win, sell_through_rate, 'sub_category', sub_category FROM r UNION ALL SELECT category, win, sell_through_rate, 'product_line', product_line FROM r),
  c AS (SELECT category, attribute, option, count(*) AS n, CAST(sum(win) AS BIGINT) AS n_win, median(sell_through_rate) AS med FROM l WHERE option IS NOT NULL AND option NOT IN ('n/a', 'uncertain') GROUP BY ALL HAVING count(*) >= 5),
  t AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS total, CAST(sum(n_win) OVER w AS DOUBLE) AS won, count(*) OVER w AS n_options FROM c WINDOW w AS (PARTITION BY category, attribute)),
  x AS (SELECT *, pow(n_win - n * won / total, 2) / nullif(n * won / total, 0) + pow(n - n_win - n * (total - won) / total, 2) / nullif(n * (total - won) / total, 0) AS part FROM t WHERE n_options >= 2 AND won > 0 AND won < total),
  association AS (SELECT category, attribute, option, n, n_win, round_even(CAST(n_win AS DOUBLE) / n, 6) AS success_rate, round_even(CAST(n_win AS DOUBLE) / n / base_rate, 6) AS lift, round_even(med, 6) AS median_rate,
    round_even(sum(part) OVER w, 6) AS chi2, n_options - 1 AS dof, round_even(sqrt(sum(part) OVER w / total), 6) AS cramers_v, n_options FROM x JOIN base USING (category) WINDOW w AS (PARTITION BY category, attribute))"""


def _association(spark, sf_dir):
    return association.attribute_association(graded(spark, sf_dir), ATTRIBUTES)


@query(f"WITH {ASSOCIATION_SQL} SELECT * FROM association")
def attribute_association(spark, sf_dir):
    return _association(spark, sf_dir)


#: The chi-square tail as 1 less the series of the lower incomplete gamma function.
TAIL_SQL = "1 - coalesce(list_sum(list_transform(range(0, 400), lambda i: exp((dof / 2 + i) * ln(greatest(chi2, 1e-300) / 2) - chi2 / 2 - lgamma(dof / 2 + i + 1)))), 0)"


@query(f"""WITH {ASSOCIATION_SQL}, tt AS (SELECT category, attribute, max(chi2) AS chi2, CAST(max(dof) AS DOUBLE) AS dof FROM association GROUP BY ALL), p AS (SELECT category, attribute, {TAIL_SQL} AS p FROM tt),
  n AS (SELECT *, row_number() OVER (ORDER BY p, category, attribute) AS place, count(*) OVER () AS m FROM p), q AS (SELECT *, least(1, min(p * m / place) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM n)
  SELECT category, attribute, option, n, lift, round_even(p, 7) AS p, round_even(q, 7) AS q, q < 0.05 AS significant FROM association a JOIN q USING (category, attribute)""".replace("option, n, lift", "option, a.n, lift"))
def association_q_values(spark, sf_dir):
    found = association.with_q_values(_association(spark, sf_dir), ["category", "attribute"])
    return found.select("category", "attribute", "option", "n", "lift", F.bround("p", 7).alias("p"), F.bround("q", 7).alias("q"), "significant")


@query(f"""WITH {ASSOCIATION_SQL}, tt AS (SELECT category, attribute, 1 / (1 + max(chi2)) AS p FROM association GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (ORDER BY p, category, attribute) AS place, count(*) OVER () AS m FROM tt)
  SELECT category, attribute, round_even(p, 6) AS p, round_even(least(1, min(p * m / place) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM n""")
def bh_correction(spark, sf_dir):
    """Benjamini and Hochberg's correction on a monotone stand-in for p, which SQL can compute too."""
    tests = _association(spark, sf_dir).groupBy("category", "attribute").agg((1 / (1 + F.max("chi2"))).alias("p"))
    return association.benjamini_hochberg(tests, "p", ["category", "attribute"]).select("category", "attribute", F.bround("p", 6).alias("p"), F.bround("q", 6).alias("q"))


@query(f"""WITH {ASSOCIATION_SQL}, e AS (SELECT *, round_even(abs(lift - 1) * cramers_v, 6) AS effect FROM association WHERE n >= 10), o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY effect DESC, attribute, option) AS place FROM e)
  SELECT category, place, attribute, option, n, lift, effect, attribute || ' = ' || option || CASE WHEN lift >= 1 THEN ' raises' ELSE ' lowers' END || ' success' AS sentence FROM o WHERE place <= 15""")
def top_findings(spark, sf_dir):
    return association.top_findings(_association(spark, sf_dir))


LONG_SQL = GRADED_SQL + """, r AS (SELECT * FROM graded WHERE perf_band <> 'EXCLUDED'),
  l AS (SELECT sku, season, category, perf_band, sell_through_rate AS y, 'list_price' AS metric, list_price AS value FROM r UNION ALL SELECT sku, season, category, perf_band, sell_through_rate, 'size', CAST(size AS DOUBLE) FROM r
    UNION ALL SELECT sku, season, category, perf_band, sell_through_rate, 'discount_depth', discount_depth FROM r), v AS (SELECT * FROM l WHERE value IS NOT NULL)"""


@query(f"""WITH {LONG_SQL}, k AS (SELECT *, rank() OVER (PARTITION BY category, metric ORDER BY value) + (count(*) OVER (PARTITION BY category, metric, value) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY category, metric ORDER BY y) + (count(*) OVER (PARTITION BY category, metric, y) - 1) / 2.0 AS ry FROM v),
  s AS (SELECT category, metric, count(*) AS n, round_even(corr(rx, ry), 6) AS rho, round_even(median(value) FILTER (WHERE perf_band = 'STAR'), 6) AS median_star, round_even(median(value) FILTER (WHERE perf_band = 'SLOW'), 6) AS median_slow FROM k GROUP BY ALL HAVING count(*) >= 15)
  SELECT *, CASE WHEN rho > 0 THEN 'more is better' WHEN rho < 0 THEN 'less is better' ELSE 'flat' END AS direction FROM s""")
def spearman(spark, sf_dir):
    return association.spearman(_measured(spark, sf_dir), METRICS)


SPOTS_SQL = LONG_SQL + """, e AS (SELECT category, metric, list_sort(list_distinct(quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS q FROM v GROUP BY ALL HAVING count(*) >= 30),
  b AS (SELECT v.*, q, len(list_filter(q[2:len(q) - 1], lambda x: x < value)) + 1 AS bin FROM v JOIN e USING (category, metric)),
  g AS (SELECT category, metric, bin, count(*) AS n, round_even(any_value(q[bin]), 6) AS low, round_even(any_value(q[bin + 1]), 6) AS high, round_even(median(y), 6) AS median_rate,
    round_even(avg(CASE WHEN perf_band = 'STAR' THEN 1.0 ELSE 0.0 END), 6) AS star_rate, round_even(avg(CASE WHEN perf_band = 'SLOW' THEN 1.0 ELSE 0.0 END), 6) AS slow_rate FROM b GROUP BY ALL),
  spots AS (SELECT *, median_rate = max(median_rate) OVER (PARTITION BY category, metric) AS is_best FROM g),
  targets AS (SELECT *, round_even((low + high) / 2, 6) AS middle FROM (SELECT category, metric, arg_min(low, bin) AS low, arg_min(high, bin) AS high, arg_min(median_rate, bin) AS median_rate FROM spots WHERE is_best GROUP BY ALL))"""


@query(f"WITH {SPOTS_SQL} SELECT * FROM spots")
def sweet_spot(spark, sf_dir):
    return association.sweet_spot(_measured(spark, sf_dir), METRICS)


@query(f"WITH {SPOTS_SQL} SELECT * FROM targets")
def sweet_spot_targets(spark, sf_dir):
    return association.sweet_spot_targets(association.sweet_spot(_measured(spark, sf_dir), METRICS))


@query(f"""WITH {SPOTS_SQL}, c AS (SELECT sku, season, category, metric, value FROM v JOIN (SELECT max(season) AS season FROM r) USING (season)),
  d AS (SELECT c.*, low, high, CASE WHEN value < low THEN value - low WHEN value > high THEN value - high ELSE 0 END AS gap FROM c JOIN targets USING (category, metric))
  SELECT sku, season, category, metric, round_even(value, 6) AS value, CASE WHEN gap = 0 THEN 'IN' ELSE 'OUT' END AS verdict, round_even(gap, 5) AS gap FROM d""")
def deviation(spark, sf_dir):
    rows = _measured(spark, sf_dir)
    last = rows.agg(F.max("season")).first()[0]
    candidates = rows.where(F.col("season") == last)
    return association.deviations(candidates, association.sweet_spot_targets(association.sweet_spot(rows, METRICS)), METRICS)


FEATURES = ["color", "sub_category", "product_line"]
STRATA = ["category", "term"]
LIFT_SQL = TERMS_SQL + """, tot AS (SELECT category, term, count(*) AS all_n, sum(sell_through_rate) AS all_y FROM terms GROUP BY ALL),
  l AS (SELECT category, term, sell_through_rate AS y, 'color' AS feature, color AS value FROM terms UNION ALL SELECT category, term, sell_through_rate, 'sub_category', sub_category FROM terms UNION ALL SELECT category, term, sell_through_rate, 'product_line', product_line FROM terms),
  c AS (SELECT category, term, feature, value, count(*) AS n, sum(y) AS y FROM l WHERE value IS NOT NULL GROUP BY ALL),
  d AS (SELECT c.*, all_n, y / n - (all_y - y) / nullif(all_n - n, 0) AS d FROM c JOIN tot USING (category, term) WHERE n >= 6 AND all_n - n >= 6 AND all_n >= 12),
  e AS (SELECT *, sum(d * n) OVER (PARTITION BY feature, value) / sum(n) OVER (PARTITION BY feature, value) AS effect FROM d),
  solo AS (SELECT feature, value, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_strata, round_even(any_value(effect) * 100, 5) AS effect_points, round_even(avg(CASE WHEN sign(d) = sign(effect) THEN 1.0 ELSE 0.0 END), 6) AS consistency FROM e GROUP BY ALL),
  lift AS (SELECT *, CASE WHEN n >= 30 THEN 'strong' WHEN n >= 12 THEN 'fair' ELSE 'weak' END AS evidence FROM solo WHERE n_strata >= 3)"""


@query(f"WITH {LIFT_SQL} SELECT * FROM lift")
def stratified_lift(spark, sf_dir):
    return lift.stratified_lift(terms(spark, sf_dir), FEATURES, STRATA)


@query(f"WITH {LIFT_SQL} SELECT * FROM lift WHERE consistency >= 0.6 AND n_strata >= 3 AND abs(effect_points) >= 0.2 AND n >= 12")
def robust_findings(spark, sf_dir):
    return lift.robust_findings(lift.stratified_lift(terms(spark, sf_dir), FEATURES, STRATA), consistency=0.6, points=0.2)


@query(f"""WITH {LIFT_SQL}, p AS (SELECT category, term, sell_through_rate AS y, 'color' AS feature_a, color AS value_a, 'sub_category' AS feature_b, sub_category AS value_b FROM terms UNION ALL SELECT category, term, sell_through_rate, 'color', color, 'product_line', product_line FROM terms
    UNION ALL SELECT category, term, sell_through_rate, 'sub_category', sub_category, 'product_line', product_line FROM terms),
  pc AS (SELECT category, term, feature_a, value_a, feature_b, value_b, count(*) AS n, sum(y) AS y FROM p WHERE value_a IS NOT NULL AND value_b IS NOT NULL GROUP BY ALL),
  pd AS (SELECT pc.*, y / n - (all_y - y) / nullif(all_n - n, 0) AS d FROM pc JOIN tot USING (category, term) WHERE n >= 3 AND all_n - n >= 6),
  pe AS (SELECT feature_a, value_a, feature_b, value_b, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_strata, round_even(sum(d * n) / sum(n) * 100, 5) AS effect_points FROM pd GROUP BY ALL HAVING count(*) >= 2 AND sum(n) >= 12),
  pf AS (SELECT pe.*, round_even(coalesce(a.effect_points, 0) + coalesce(b.effect_points, 0), 5) AS expected_points FROM pe LEFT JOIN solo a ON a.feature = feature_a AND a.value = value_a LEFT JOIN solo b ON b.feature = feature_b AND b.value = value_b)
  SELECT *, round_even(effect_points - expected_points, 4) AS interaction FROM pf ORDER BY effect_points DESC, feature_a, value_a, feature_b, value_b LIMIT 40""")
def combo_lift(spark, sf_dir):
    return lift.combo_lift(terms(spark, sf_dir), FEATURES, STRATA)


@query(f"""WITH {TERMS_SQL}, e AS (SELECT category, term, quantile_cont(sell_through_rate, 0.75) AS hi, quantile_cont(sell_through_rate, 0.25) AS lo FROM terms GROUP BY ALL),
  m AS (SELECT terms.*, sell_through_rate >= hi AS is_top, sell_through_rate <= lo AS is_bottom FROM terms JOIN e USING (category, term)), s AS (SELECT count(*) FILTER (WHERE is_top) AS t, count(*) FILTER (WHERE is_bottom) AS b FROM m),
  l AS (SELECT is_top, is_bottom, 'color' AS feature, color AS value FROM m UNION ALL SELECT is_top, is_bottom, 'sub_category', sub_category FROM m UNION ALL SELECT is_top, is_bottom, 'product_line', product_line FROM m),
  c AS (SELECT feature, value, count(*) FILTER (WHERE is_top) AS n_high, count(*) FILTER (WHERE is_bottom) AS n_low FROM l WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (WHERE is_top) >= 4)
  SELECT feature, value, n_high, n_low, round_even(n_high / t, 6) AS share_high, round_even(n_low / b, 6) AS share_low, round_even((n_high / t + 0.01) / (n_low / b + 0.01), 5) AS ratio FROM c, s""")
def bestseller_shares(spark, sf_dir):
    return lift.bestseller_shares(terms(spark, sf_dir), FEATURES, STRATA)


@query(f"""WITH {LIFT_SQL}, rt AS (SELECT * FROM terms WHERE term = 3), lt AS (SELECT sell_through_rate AS y, 'color' AS feature, color AS value FROM rt UNION ALL SELECT sell_through_rate, 'sub_category', sub_category FROM rt UNION ALL SELECT sell_through_rate, 'product_line', product_line FROM rt),
  ct AS (SELECT feature, value, count(*) AS n_term, round_even(avg(y), 6) AS mean_rate FROM lt WHERE value IS NOT NULL GROUP BY ALL), j AS (SELECT feature, value, effect_points, n_term, mean_rate, round_even(n_term / (SELECT count(*) FROM rt), 6) AS share FROM lift JOIN ct USING (feature, value))
  SELECT *, CASE WHEN effect_points > 0 AND share < 0.05 THEN 'try a few' WHEN effect_points > 0 AND share < 0.2 THEN 'increase' WHEN effect_points > 0 THEN 'keep' ELSE 'reduce' END AS advice FROM j ORDER BY effect_points DESC, feature, value LIMIT 12""")
def season_blueprint(spark, sf_dir):
    rows = terms(spark, sf_dir)
    return lift.season_blueprint(rows, FEATURES, lift.stratified_lift(rows, FEATURES, STRATA), 3)


MOTIF_SQL = TERMS_SQL + """, base AS (SELECT category, avg(sell_through_rate) AS base FROM terms GROUP BY category), based AS (SELECT terms.*, (sell_through_rate - base) AS d FROM terms JOIN base USING (category)),
  motifs AS (SELECT * FROM (VALUES ('hot|red|large', 'warm'), ('blue|cold|small', 'cool'), ('ring|bolt', 'metal'), ('anvil|case|box', 'solid')) AS v(pattern, motif))"""


@query(f"WITH {MOTIF_SQL} SELECT motif, count(*) AS n, round_even(avg(d) * 100, 5) AS lift_points, round_even(avg(sell_through_rate), 6) AS mean_rate, min(sku) AS example FROM based JOIN motifs ON regexp_matches(product_name, pattern) GROUP BY motif HAVING count(*) >= 6")
def motif_breakdown(spark, sf_dir):
    return lift.motif_breakdown(terms(spark, sf_dir), MOTIFS, ["category"])


@query(f"WITH {MOTIF_SQL} SELECT motif, term, count(*) AS n, round_even(avg(d) * 100, 5) AS lift_points, round_even(avg(sell_through_rate), 6) AS mean_rate, min(sku) AS example FROM based JOIN motifs ON regexp_matches(product_name, pattern) GROUP BY ALL HAVING count(*) >= 5")
def motif_by_term(spark, sf_dir):
    return lift.motif_breakdown(terms(spark, sf_dir), MOTIFS, ["category"], by=["term"], least=5)


@query(f"""WITH {TERMS_SQL}, base AS (SELECT category, term, avg(sell_through_rate) AS base FROM terms GROUP BY ALL), based AS (SELECT terms.*, (sell_through_rate - base) AS d FROM terms JOIN base USING (category, term)),
  motifs AS (SELECT * FROM (VALUES ('hot|red|large', 'warm'), ('blue|cold|small', 'cool'), ('ring|bolt', 'metal'), ('anvil|case|box', 'solid')) AS v(pattern, motif))
  SELECT motif, term, count(*) AS n, round_even(avg(d) * 100, 5) AS lift_points, round_even(avg(sell_through_rate), 6) AS mean_rate, min(sku) AS example FROM based JOIN motifs ON regexp_matches(product_name, pattern) GROUP BY ALL HAVING count(*) >= 6""")
def season_motif_grid(spark, sf_dir):
    return lift.motif_breakdown(terms(spark, sf_dir), MOTIFS, ["category", "term"], by=["term"])


@query(f"""WITH {MOTIF_SQL}, c AS (SELECT regexp_matches(product_name, 'hot|red|large') AS a, regexp_matches(product_name, 'ring|bolt') AS b, d * 100 AS d FROM based),
  x AS (SELECT count(*) FILTER (WHERE a AND b) AS n_both, round_even(avg(d) FILTER (WHERE a AND b), 5) AS "both", round_even(avg(d) FILTER (WHERE a AND NOT b), 5) AS only_a, round_even(avg(d) FILTER (WHERE NOT a AND b), 5) AS only_b, round_even(avg(d) FILTER (WHERE NOT a AND NOT b), 5) AS neither FROM c)
  SELECT *, round_even("both" - only_a - only_b + neither, 4) AS interaction FROM x""")
def cross_lift(spark, sf_dir):
    return lift.cross_lift(terms(spark, sf_dir), MOTIFS[0][0], MOTIFS[2][0], ["category"])


@query("")
def motif_intervals(spark, sf_dir):
    return lift.bootstrap_lift(terms(spark, sf_dir), MOTIFS, ["category"])
