"""Queries on grades, commercial reports, seasons, the range plan and stock, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from selvage.operators import commercial, performance, sales, season, stock

from .adapter import GRADED_SQL, LINES_SQL, MASTER_SQL, master, sales_lines, snapshot

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def graded(spark, sf_dir):
    return performance.grade(master(spark, sf_dir))


PERF = """count(*) AS n, round_even(median(sell_through_rate), 4) AS median_sell_through, round_even(avg(CASE WHEN perf_band = 'STAR' THEN 1.0 ELSE 0.0 END), 4) AS star_rate,
  round_even(avg(CASE WHEN perf_band = 'SLOW' THEN 1.0 ELSE 0.0 END), 4) AS slow_rate, round_even(median(list_price), 2) AS median_price, sum(stock_in) AS stock_in,
  CASE WHEN count(*) >= 30 THEN 'strong' WHEN count(*) >= 10 THEN 'fair' ELSE 'weak' END AS evidence"""
ACTIVE = GRADED_SQL + ", active AS (SELECT * FROM graded WHERE perf_band <> 'EXCLUDED')"
ANALYSED = MASTER_SQL + ", analysed AS (SELECT *, stock_in - net_sales_qty AS stock_left FROM master WHERE NOT is_gift AND NOT is_sample AND stock_in >= 30 AND sell_through_rate IS NOT NULL)"
KPIS = """count(DISTINCT sku) AS n_styles, count(*) AS n_rows, sum(stock_in) AS stock_in, sum(net_sales_qty) AS net_sales_qty,
  round_even(1 - sum(stock_left) / nullif(sum(stock_in), 0), 6) AS weighted_rate, round_even(avg(sell_through_rate), 6) AS mean_rate"""


@query(f"WITH {GRADED_SQL} SELECT sku, season, category, stock_in, net_sales_qty, round_even(sell_through_rate, 6) AS sell_through_rate, round_even(pct, 4) AS perf_pct, perf_band, perf_group_n, perf_group_n_eligible, perf_group_n >= 10 AS perf_reliable FROM graded")
def graded_master(spark, sf_dir):
    out = graded(spark, sf_dir)
    return out.select("sku", "season", "category", "stock_in", "net_sales_qty", F.bround("sell_through_rate", 6).alias("sell_through_rate"), "perf_pct", "perf_band", "perf_group_n", "perf_group_n_eligible", "perf_reliable")


@query(f"""WITH {MASTER_SQL} SELECT sku, season, product_name, category, designer, list_price, stock_in, sales_qty, return_qty, round_even(sales_amount, 4) AS sales_amount, stock_on_hand,
  first_sale_date, last_sale_date, round_even(return_rate, 6) AS return_rate, round_even(avg_selling_price, 6) AS avg_selling_price, round_even(discount_depth, 6) AS discount_depth, round_even(weeks_on_sale, 6) AS weeks_on_sale, is_sample, is_gift FROM master""")
def sku_season_master(spark, sf_dir):
    r = lambda c, n: F.bround(c, n).alias(c)
    return master(spark, sf_dir).select(
        "sku", "season", "product_name", "category", "designer", "list_price", "stock_in", "sales_qty", "return_qty", r("sales_amount", 4), "stock_on_hand",
        "first_sale_date", "last_sale_date", r("return_rate", 6), r("avg_selling_price", 6), r("discount_depth", 6), r("weeks_on_sale", 6), "is_sample", "is_gift",
    )


@query(f"""WITH {GRADED_SQL} SELECT season, category, count(DISTINCT sku) AS n_styles, sum(stock_in) AS stock_in, sum(net_sales_qty) AS net_sales_qty, round_even(median(sell_through_rate), 4) AS median_sell_through,
  round_even(median(weeks_on_sale), 4) AS median_weeks, {", ".join(f"count(DISTINCT CASE WHEN perf_band = '{b}' THEN sku END) AS {b.lower()}" for b in performance.BANDS)} FROM graded GROUP BY season, category""")
def performance_summary(spark, sf_dir):
    return performance.summary_by_group(graded(spark, sf_dir))


@query(f"""WITH {GRADED_SQL}, r AS (SELECT category, sku, season, sell_through_rate, perf_band FROM graded WHERE perf_band <> 'EXCLUDED'),
  t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sell_through_rate DESC, sku, season) AS place, 'top' AS side FROM r),
  b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sell_through_rate, sku, season) AS place, 'bottom' AS side FROM r)
  SELECT * REPLACE (round_even(sell_through_rate, 6) AS sell_through_rate) FROM (SELECT * FROM t WHERE place <= 20 UNION ALL SELECT * FROM b WHERE place <= 20)""")
def top_bottom(spark, sf_dir):
    return performance.top_and_bottom(graded(spark, sf_dir)).withColumn("sell_through_rate", F.bround("sell_through_rate", 6))


@query(f"""WITH {MASTER_SQL}, c AS (SELECT count(*) AS n_all, count(*) FILTER (WHERE is_gift) AS gift, count(*) FILTER (WHERE is_sample) AS sample, count(*) FILTER (WHERE stock_in < 30) AS low_stock,
  count(*) FILTER (WHERE weeks_on_sale < 4) AS too_new, count(*) FILTER (WHERE sell_through_rate IS NULL) AS no_rate FROM master), u AS (UNPIVOT c ON gift, sample, low_stock, too_new, no_rate INTO NAME rule VALUE n)
  SELECT rule, n, round_even(n / nullif(n_all, 0), 6) AS share FROM u""")
def exclusion_audit(spark, sf_dir):
    return performance.exclusion_audit(master(spark, sf_dir))


@query(f"""WITH {MASTER_SQL} SELECT CASE WHEN is_gift THEN 'gift' WHEN is_sample THEN 'sample' WHEN stock_in < 30 THEN 'low_stock' WHEN weeks_on_sale < 4 THEN 'too_new' WHEN sell_through_rate IS NULL THEN 'no_rate' ELSE 'kept' END AS first_rule,
  count(*) AS n, sum(stock_in) AS stock_in FROM master GROUP BY 1""")
def filter_audit(spark, sf_dir):
    return performance.filter_audit(master(spark, sf_dir))


@query(f"""WITH {ACTIVE} SELECT category, sub_category, CASE WHEN grouping(sub_category) = 0 THEN 2 ELSE 1 END AS level, {PERF} FROM active GROUP BY GROUPING SETS ((category), (category, sub_category)) HAVING grouping(sub_category) = 1 OR count(*) >= 4""")
def product_line(spark, sf_dir):
    return commercial.product_line_report(graded(spark, sf_dir))


@query(f"""WITH {ACTIVE}, e AS (SELECT category, list_distinct(quantile_cont(list_price, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS q FROM active GROUP BY category HAVING count(*) >= 30),
  s AS (SELECT category, list_sort(q) AS q FROM e),
  b AS (SELECT active.*, len(list_filter(q[2:len(q) - 1], lambda x: x < list_price)) + 1 AS price_band FROM active JOIN s USING (category))
  SELECT category, price_band, min(list_price) AS low, max(list_price) AS high, {PERF} FROM b GROUP BY category, price_band""")
def price_bands(spark, sf_dir):
    return commercial.price_band_report(graded(spark, sf_dir))


LAUNCH = f""", m AS (SELECT category, month(first_sale_date) AS launch_month, {PERF} FROM active GROUP BY 1, 2 HAVING count(*) >= 8),
  l AS (SELECT *, CAST(floor(rank() OVER (PARTITION BY category ORDER BY median_sell_through DESC) + (count(*) OVER (PARTITION BY category, median_sell_through) - 1) / 2.0) AS BIGINT) AS rank_in_group FROM m)"""


@query(f"WITH {ACTIVE} {LAUNCH} SELECT * FROM l")
def launch_timing(spark, sf_dir):
    return commercial.launch_timing_report(graded(spark, sf_dir))


@query(f"""WITH {ACTIVE} {LAUNCH}, i AS (SELECT category, count(*) AS n_months, arg_max(launch_month, (median_sell_through, -launch_month)) AS best_month, arg_min(launch_month, (median_sell_through, launch_month)) AS worst_month,
  round_even(max(median_sell_through) - min(median_sell_through), 4) AS spread FROM l GROUP BY category HAVING count(*) >= 3)
  SELECT *, CASE WHEN spread >= 0.15 THEN 'strong' WHEN spread >= 0.08 THEN 'visible' ELSE 'weak' END AS impact FROM i""")
def timing_impact(spark, sf_dir):
    return commercial.timing_impact(commercial.launch_timing_report(graded(spark, sf_dir)))


@query(f"""WITH {ACTIVE}, c AS (SELECT designer, category, count(*) AS n FROM active GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY designer ORDER BY n DESC, category) AS place FROM c),
  x AS (SELECT designer, string_agg(category || ':' || n, ' ' ORDER BY place) AS category_mix FROM o WHERE place <= 3 GROUP BY designer)
  SELECT designer, {PERF}, any_value(category_mix) AS category_mix FROM active JOIN x USING (designer) GROUP BY designer HAVING count(*) >= 20""")
def designer_report(spark, sf_dir):
    return commercial.designer_report(graded(spark, sf_dir))


def analysed(spark, sf_dir):
    return performance.filter_for_analysis(master(spark, sf_dir))


@query(f"WITH {ANALYSED} SELECT season, {KPIS} FROM analysed GROUP BY season")
def season_kpis(spark, sf_dir):
    return season.kpis(analysed(spark, sf_dir), ["season"])


@query(f"""WITH {ANALYSED}, k AS (SELECT season, {KPIS} FROM analysed GROUP BY season)
  SELECT * FROM (SELECT season, lag(season) OVER w AS previous, round_even(weighted_rate - lag(weighted_rate) OVER w, 6) AS rate_change, round_even((stock_in - lag(stock_in) OVER w) / nullif(lag(stock_in) OVER w, 0), 6) AS stock_change FROM k WINDOW w AS (ORDER BY season)) WHERE previous IS NOT NULL""")
def season_changes(spark, sf_dir):
    return season.year_over_year(season.kpis(analysed(spark, sf_dir), ["season"]))


def terms(spark, sf_dir):
    """Master by sku and term of the year."""
    lines = sales_lines(spark, sf_dir).withColumn("season", F.col("season") * 10 + F.col("term"))
    rows = sales.aggregate_to_sku_season(lines, gift=F.col("category") == "PROMO", snapshot=snapshot(spark, sf_dir))
    return rows.where(~F.col("is_gift") & ~F.col("is_sample") & F.col("sell_through_rate").isNotNull()).withColumn("term", F.col("season") % 10).withColumn("year", F.floor(F.col("season") / 10))


TERMS_SQL = MASTER_SQL.replace("SELECT sku, season, min(product_name)", "SELECT sku, season * 10 + term AS season, min(product_name)").replace("FROM lines GROUP BY sku, season\n", "FROM lines GROUP BY sku, season * 10 + term\n") + """, terms AS (
  SELECT *, season % 10 AS term, CAST(floor(season / 10) AS BIGINT) AS year, stock_in - net_sales_qty AS stock_left FROM master WHERE NOT is_gift AND NOT is_sample AND sell_through_rate IS NOT NULL)"""


@query(f"WITH {TERMS_SQL} SELECT term, {KPIS} FROM terms GROUP BY term")
def term_stats(spark, sf_dir):
    return season.kpis(terms(spark, sf_dir), ["term"])


@query(f"WITH {TERMS_SQL} SELECT category, year, {KPIS} FROM terms GROUP BY category, year")
def category_year(spark, sf_dir):
    return season.kpis(terms(spark, sf_dir), ["category", "year"])


@query(f"WITH {TERMS_SQL} SELECT category, term, {KPIS} FROM terms GROUP BY category, term HAVING count(*) >= 6")
def category_term(spark, sf_dir):
    return season.kpis(terms(spark, sf_dir), ["category", "term"], 6)


@query(f"WITH {ANALYSED} SELECT month(first_sale_date) AS month, season, {KPIS} FROM analysed GROUP BY 1, 2 HAVING count(*) >= 6")
def month_year(spark, sf_dir):
    return season.kpis(analysed(spark, sf_dir).withColumn("month", F.month("first_sale_date").cast("long")), ["month", "season"], 6)


@query(f"""WITH {LINES_SQL}, s AS (SELECT category, season, min(ship_date) AS d0, max(ship_date) AS d1 FROM lines GROUP BY ALL),
  n AS (SELECT *, lead(season) OVER w AS next_season, lead(d0) OVER w AS e0, lead(d1) OVER w AS e1 FROM s WINDOW w AS (PARTITION BY category ORDER BY season))
  SELECT category, season, next_season, greatest(date_diff('day', greatest(d0, e0), least(d1, e1)), 0) AS overlap_days FROM n WHERE next_season IS NOT NULL""")
def season_overlaps(spark, sf_dir):
    return season.overlaps(sales_lines(spark, sf_dir))


@query(f"""WITH {ANALYSED}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sell_through_rate DESC, net_sales_qty DESC, sku, season) AS place FROM analysed WHERE net_sales_qty >= 100 AND sell_through_rate >= 0.5)
  SELECT category, place, sku, season, net_sales_qty, round_even(sell_through_rate, 6) AS sell_through_rate FROM r WHERE place <= 10""")
def champions(spark, sf_dir):
    return season.champions(analysed(spark, sf_dir), ["category"], 10, rate=0.5, quantity=100)


@query(f"""WITH {ANALYSED}, r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY sell_through_rate DESC, net_sales_qty DESC, sku, season) AS place FROM analysed WHERE net_sales_qty >= 0)
  SELECT season, place, sku, net_sales_qty, round_even(sell_through_rate, 6) AS sell_through_rate FROM r WHERE place <= 15""")
def top_year(spark, sf_dir):
    return season.champions(analysed(spark, sf_dir), ["season"], 15)


GAPS_SQL = f""", cells AS (SELECT category, term, {KPIS} FROM terms GROUP BY category, term HAVING count(*) >= 6),
  g AS (SELECT category, term, n_rows, round_even(stock_in / sum(stock_in) OVER w, 6) AS stock_share, sum(mean_rate * n_rows) OVER w / sum(n_rows) OVER w AS m, mean_rate FROM cells WINDOW w AS (PARTITION BY term)),
  gaps AS (SELECT category, term, n_rows, stock_share, round_even(m, 6) AS term_mean, round_even((mean_rate - m) * 100, 4) AS gap_points, mean_rate - m < 0 AS below FROM g)"""


@query(f"WITH {TERMS_SQL} {GAPS_SQL} SELECT * FROM gaps")
def rangeplan_gaps(spark, sf_dir):
    return season.term_gaps(season.kpis(terms(spark, sf_dir), ["category", "term"], 6))


@query(f"""WITH {TERMS_SQL}, cells AS (SELECT category, year, term, {KPIS} FROM terms GROUP BY ALL), t AS (SELECT category, max(mean_rate) FILTER (WHERE term = 3) AS hi, min(mean_rate) FILTER (WHERE term <> 3) AS lo,
  round_even(avg(mean_rate) FILTER (WHERE term = 3) - avg(mean_rate) FILTER (WHERE term <> 3), 6) AS mean_gap, count(*) FILTER (WHERE term = 3) AS n_term, count(*) FILTER (WHERE term <> 3) AS n_rest FROM cells GROUP BY category)
  SELECT category, mean_gap, n_term, n_rest, hi < lo AS separated FROM t""")
def term_separation(spark, sf_dir):
    return season.term_separation(season.kpis(terms(spark, sf_dir), ["category", "year", "term"]), 3)


@query(f"""WITH {ANALYSED}, s AS (SELECT category, count(*) AS n, round_even(corr(weeks_on_sale, sell_through_rate), 4) AS correlation, round_even(avg(sell_through_rate) FILTER (WHERE weeks_on_sale >= 52), 6) AS mean_long,
  round_even(avg(sell_through_rate) FILTER (WHERE weeks_on_sale < 52), 6) AS mean_short FROM analysed GROUP BY category) SELECT *, CASE WHEN abs(correlation) < 0.3 THEN 'time does not explain it' ELSE 'time matters' END AS verdict FROM s""")
def shelf_window(spark, sf_dir):
    return season.shelf_window(analysed(spark, sf_dir))


@query(f"""WITH {TERMS_SQL}, c AS (SELECT category, sum(CASE WHEN term = 3 THEN stock_in ELSE 0 END) AS term_stock, sum(CASE WHEN term = 3 THEN net_sales_qty ELSE 0 END) AS term_sold,
  round_even(sum(CASE WHEN term <> 3 THEN net_sales_qty ELSE 0 END) / nullif(sum(CASE WHEN term <> 3 THEN stock_in ELSE 0 END), 0), 6) AS other_rate FROM terms GROUP BY category)
  SELECT *, round_even(term_stock * other_rate, 2) AS would_sell, round_even(term_stock * other_rate - term_sold, 2) AS gain FROM c""")
def reallocation(spark, sf_dir):
    cells = season.kpis(terms(spark, sf_dir), ["category", "term"])
    return season.reallocation(cells, 3)


@query(f"WITH {TERMS_SQL} {GAPS_SQL} SELECT category, count(*) AS n_terms, count(*) FILTER (WHERE gap_points > 0) AS n_above, round_even(avg(gap_points), 3) AS mean_gap_points FROM gaps GROUP BY category")
def consistent_categories(spark, sf_dir):
    return season.consistent_categories(season.term_gaps(season.kpis(terms(spark, sf_dir), ["category", "term"], 6)))


STOCK_GAP = ", g AS (SELECT *, stock_on_hand_alt - stock_on_hand AS gap FROM master), s AS (SELECT *, round_even(gap / nullif(stock_in, 0), 6) AS gap_ratio, CASE WHEN gap > 0 THEN 'over' WHEN gap < 0 THEN 'under' ELSE 'equal' END AS direction, (abs(gap) <= 2 OR abs(gap) <= 0.02 * stock_in) AS agrees FROM g)"


@query(f"WITH {MASTER_SQL} {STOCK_GAP} SELECT sku, season, stock_on_hand, stock_on_hand_alt, gap, gap_ratio, direction, agrees FROM s")
def stock_gap(spark, sf_dir):
    return stock.gap(master(spark, sf_dir)).select("sku", "season", "stock_on_hand", "stock_on_hand_alt", "gap", "gap_ratio", "direction", "agrees")


@query(f"WITH {MASTER_SQL} {STOCK_GAP} SELECT category, season, count(*) AS n, count(*) FILTER (WHERE agrees) AS n_matched, count(*) FILTER (WHERE NOT agrees AND gap > 0) AS n_over, count(*) FILTER (WHERE NOT agrees AND gap < 0) AS n_under, sum(gap) AS net_gap, sum(abs(gap)) AS abs_gap FROM s GROUP BY ALL")
def stock_gap_summary(spark, sf_dir):
    return stock.gap_summary(stock.gap(master(spark, sf_dir)), ["category", "season"])


@query(f"WITH {MASTER_SQL} {STOCK_GAP} SELECT sku, season, gap, direction FROM s WHERE NOT agrees ORDER BY abs(gap) DESC, sku, season LIMIT 30")
def worth_counting(spark, sf_dir):
    return stock.worth_counting(stock.gap(master(spark, sf_dir)), ["sku", "season"]).select("sku", "season", "gap", "direction")


@query(f"""WITH {LINES_SQL} SELECT sku, color, size, sum(stock_in) AS stock_in, sum(sales_qty) AS sales_qty, sum(return_qty) AS return_qty, greatest(sum(stock_on_hand), 0) AS stock_on_hand, sum(stock_on_hand_alt) AS stock_on_hand_alt,
  max(list_price) AS list_price, sum(stock_on_hand) < 0 AS is_negative FROM lines GROUP BY sku, color, size""")
def variant_stock(spark, sf_dir):
    return sales.aggregate_to_variant(sales_lines(spark, sf_dir), ["sku", "color", "size"])


@query(f"""WITH {GRADED_SQL}, f AS (SELECT product_name, category, count(DISTINCT sku) AS n_skus, count(DISTINCT season) AS n_seasons, string_agg(DISTINCT CAST(season AS VARCHAR), ' ' ORDER BY CAST(season AS VARCHAR)) AS seasons,
  arg_max(sku, (sell_through_rate, -sku, -season)) AS best_sku, arg_min(sku, (sell_through_rate, sku, season)) AS worst_sku, round_even(max(sell_through_rate) - min(sell_through_rate), 6) AS spread, sum(stock_in) AS stock_in
  FROM graded WHERE stock_in >= 10 AND sell_through_rate IS NOT NULL GROUP BY product_name, category)
  SELECT *, CASE WHEN spread >= 0.3 THEN 'timing or season' ELSE 'design is stable' END AS verdict FROM f WHERE n_skus >= 2 AND n_seasons >= 2""")
def reissue_families(spark, sf_dir):
    return stock.reissue_families(graded(spark, sf_dir), ["product_name", "category"])


@query(f"""WITH {MASTER_SQL}, m AS (SELECT category, season, count(*) AS n, median(discount_depth) AS x FROM master GROUP BY ALL)
  SELECT category, season, n, round_even(x, 6) AS median, round_even(x - lag(x) OVER (PARTITION BY category ORDER BY season), 6) AS change FROM m""")
def drift(spark, sf_dir):
    return stock.drift(master(spark, sf_dir), "discount_depth")
