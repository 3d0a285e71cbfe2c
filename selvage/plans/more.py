"""Queries on listings, plans by week, images' labels and blocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from selvage.functions.columns import first_match, ratio
from selvage.operators import merge, planning, visual

from .adapter import GRADED_SQL, LINES_SQL, MASTER_SQL, master, read, sales_lines
from .sales_reports import TERMS_SQL, graded, terms
from .search import NEAREST_SQL, PALETTE, PLACED_SQL, swatches, vectors

QUERIES, ORACLES = {}, {}

#: Groups of the listing, the first that matches a name holds it.
GROUPS = [("ring|bolt", "metal"), ("hot|red", "warm"), ("blue|cold", "cool")]


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {MASTER_SQL}, g AS (SELECT *, CASE WHEN regexp_matches(product_name, 'ring|bolt') THEN 'metal' WHEN regexp_matches(product_name, 'hot|red') THEN 'warm' WHEN regexp_matches(product_name, 'blue|cold') THEN 'cool' ELSE 'other' END AS name_group FROM master)
  SELECT coalesce(category, 'ALL') AS series, coalesce(name_group, 'ALL') AS name_group, count(*) AS n, sum(stock_in) AS stock_in, sum(net_sales_qty) AS net_sales_qty, sum(return_qty) AS return_qty, sum(stock_on_hand) AS stock_on_hand, round_even(sum(net_sales_qty) / nullif(sum(stock_in), 0), 6) AS rate FROM g GROUP BY ROLLUP (category, name_group)""")
def inventory_groups(spark, sf_dir):
    """Series and exclusive groups of names with subtotals and the total, in one pass."""
    rows = master(spark, sf_dir).withColumn("name_group", first_match(F.col("product_name"), GROUPS, "other"))
    out = rows.rollup("category", "name_group").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("stock_in", "net_sales_qty", "return_qty", "stock_on_hand")], F.bround(ratio(F.sum("net_sales_qty"), F.sum("stock_in")), 6).alias("rate"))
    return out.select(F.coalesce("category", F.lit("ALL")).alias("series"), F.coalesce("name_group", F.lit("ALL")).alias("name_group"), "n", "stock_in", "net_sales_qty", "return_qty", "stock_on_hand", "rate")


@query(f"WITH {MASTER_SQL} SELECT CASE WHEN sell_through_rate >= 0.95 THEN 'A' WHEN sell_through_rate >= 0.8 THEN 'B' WHEN sell_through_rate >= 0.5 THEN 'C' WHEN sell_through_rate >= 0.3 THEN 'D' ELSE 'E' END AS rate_band, count(*) AS n, sum(stock_in) AS stock_in FROM master WHERE sell_through_rate IS NOT NULL GROUP BY 1")
def rate_bands(spark, sf_dir):
    x = F.col("sell_through_rate")
    band = F.when(x >= 0.95, "A").when(x >= 0.8, "B").when(x >= 0.5, "C").when(x >= 0.3, "D").otherwise("E")
    return master(spark, sf_dir).where(x.isNotNull()).groupBy(band.alias("rate_band")).agg(F.count("*").alias("n"), F.sum("stock_in").alias("stock_in"))


@query(f"WITH {GRADED_SQL} SELECT sku, season, product_name, category, perf_band, stock_in FROM graded WHERE perf_band = 'STAR' AND contains(lower(product_name), 'ring') ORDER BY stock_in DESC, sku, season LIMIT 200")
def style_list(spark, sf_dir):
    """The dashboard's filtered list: a band, part of a name, at most 200 rows."""
    rows = graded(spark, sf_dir).where((F.col("perf_band") == "STAR") & F.lower("product_name").contains("ring"))
    return rows.orderBy(F.desc("stock_in"), "sku", "season").limit(200).select("sku", "season", "product_name", "category", "perf_band", "stock_in")


@query(f"""WITH {GRADED_SQL} SELECT count(DISTINCT sku) AS n_styles, count(DISTINCT season) AS n_seasons, sum(stock_in) AS stock_in, round_even(sum(net_sales_qty) / sum(stock_in), 6) AS rate, count(*) FILTER (WHERE perf_band = 'STAR') AS star, count(*) FILTER (WHERE perf_band = 'CORE') AS core,
  count(*) FILTER (WHERE perf_band = 'STEADY') AS steady, count(*) FILTER (WHERE perf_band = 'SLOW') AS slow, count(*) FILTER (WHERE perf_band = 'EXCLUDED') AS excluded FROM graded""")
def dashboard(spark, sf_dir):
    bands = [F.count_if(F.col("perf_band") == b).alias(b.lower()) for b in ("STAR", "CORE", "STEADY", "SLOW", "EXCLUDED")]
    return graded(spark, sf_dir).agg(F.countDistinct("sku").alias("n_styles"), F.countDistinct("season").alias("n_seasons"), F.sum("stock_in").alias("stock_in"), F.bround(ratio(F.sum("net_sales_qty"), F.sum("stock_in")), 6).alias("rate"), *bands)


@query(f"""WITH {LINES_SQL}, f AS (SELECT sku, min(ship_date) AS first_date FROM lines GROUP BY sku), d AS (SELECT max(ship_date) AS last FROM lines), a AS (SELECT sku, first_date, CAST(floor(date_diff('day', first_date, last) / 7.0) AS BIGINT) + 1 AS weeks_ago FROM f, d),
  w AS (SELECT weeks_ago, sum(count(*)) OVER (ORDER BY weeks_ago) AS n FROM a GROUP BY weeks_ago) SELECT sku, first_date, weeks_ago FROM a WHERE weeks_ago <= greatest(4, (SELECT min(weeks_ago) FROM w WHERE n >= 10))""")
def new_arrivals(spark, sf_dir):
    """Styles first sold in the last 4 weeks, or in as many as it takes to have 10."""
    from pyspark.sql import Window

    lines = sales_lines(spark, sf_dir)
    last = lines.agg(F.max("ship_date")).first()[0]
    first = lines.groupBy("sku").agg(F.min("ship_date").alias("first_date")).withColumn("weeks_ago", (F.floor(F.datediff(F.lit(last), "first_date") / 7) + 1).cast("long"))
    weeks = first.groupBy("weeks_ago").count().withColumn("n", F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("weeks_ago")))  # a row for each week
    enough = weeks.where("n >= 10").agg(F.min("weeks_ago")).first()[0]
    return first.where(F.col("weeks_ago") <= max(4, enough or 0))


@query("SELECT w AS week, count(*) AS n_lines, sum(l_quantity) AS quantity, CASE WHEN w <= 6 THEN 'SS-EARLY' WHEN w <= 18 THEN 'SS-MAIN' WHEN w <= 26 THEN 'SS-LATE' WHEN w <= 35 THEN 'AW-EARLY' WHEN w <= 45 THEN 'AW-MAIN' ELSE 'AW-LATE' END AS wave FROM (SELECT CAST(weekofyear(l_shipdate) AS BIGINT) AS w, l_quantity FROM lineitem WHERE l_shipdate IS NOT NULL) GROUP BY w")
def plan_weeks(spark, sf_dir):
    """Lines and pieces shipped in each week of the year, and its wave."""
    weeks = read(spark, sf_dir, "lineitem").where("l_shipdate is not null").groupBy(F.weekofyear("l_shipdate").cast("long").alias("week"))
    return weeks.agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity")).withColumn("wave", planning.wave_of(F.col("week")))


@query(f"WITH {MASTER_SQL}, c AS (SELECT count(*) AS n_all, count(return_rate) AS return_rate, count(avg_selling_price) AS avg_selling_price, count(discount_depth) AS discount_depth FROM master), u AS (UNPIVOT c ON return_rate, avg_selling_price, discount_depth INTO NAME measure VALUE n) SELECT measure, n, round_even(n / n_all, 6) AS share FROM u")
def measure_coverage(spark, sf_dir):
    return merge.coverage(master(spark, sf_dir), ["return_rate", "avg_selling_price", "discount_depth"])


@query(f"""WITH {MASTER_SQL}, m AS (SELECT season, CASE WHEN sell_through_rate IS NULL THEN 'no rate' WHEN return_rate IS NULL THEN 'nothing sold' WHEN avg_selling_price < list_price * 0.5 THEN 'price' END AS reason FROM master),
  r AS (SELECT season, reason, count(*) AS n FROM m WHERE reason IS NOT NULL GROUP BY ALL), t AS (SELECT season, arg_max(reason, (n, reason)) AS top_reason FROM r GROUP BY season)
  SELECT season, count(*) AS n, count(reason) AS n_missing, round_even(count(reason) / count(*), 6) AS share, any_value(top_reason) AS top_reason FROM m LEFT JOIN t USING (season) GROUP BY season""")
def missing_by_season(spark, sf_dir):
    """Rows with a fault in each season, and the commonest one."""
    reason = F.when(F.col("sell_through_rate").isNull(), "no rate").when(F.col("return_rate").isNull(), "nothing sold").when(F.col("avg_selling_price") < F.col("list_price") * 0.5, "price")
    rows = master(spark, sf_dir).select("season", reason.alias("reason"))
    counts = rows.groupBy("season", "reason").agg(F.count("*").alias("n"))
    known = F.col("reason").isNotNull()
    out = counts.groupBy("season").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_missing"), F.max_by(F.when(known, F.col("reason")), F.when(known, F.struct("n", "reason"))).alias("top_reason"))
    return out.select("season", "n", "n_missing", F.bround(ratio("n_missing", "n"), 6).alias("share"), "top_reason")


def matched_colours(spark, sf_dir):
    """Swatches with the code of their label's number as declared, and the nearest code as matched."""
    from selvage.functions import colour

    lightness, a, b = colour.lab_of_hex(F.col("hex"))
    near = colour.nearest_codes(swatches(spark, sf_dir).select("id", lightness.alias("L"), a.alias("a"), b.alias("b")), PALETTE, "id", top=1)
    declared = F.get(F.array(*[F.lit(code) for code, *_ in PALETTE]), F.col("label").cast("int"))
    return near.join(vectors(spark, sf_dir).select("id", "label"), "id").select(F.floor(F.col("id") / 5).alias("style"), declared.alias("declared"), F.col("code").alias("matched"), "delta_e")


DECLARED_SQL = NEAREST_SQL + """, d AS (SELECT id // 5 AS style, (['10', '19', '20', '30', '40', '50', '60', '70', '80', '90'])[CAST(label AS INT) + 1] AS declared, code AS matched, delta_e FROM nearest JOIN (SELECT vec_id AS id, label FROM embeddings) USING (id) WHERE place = 1)"""


@query(f"""WITH {DECLARED_SQL} SELECT count(*) AS n, round_even(avg(CASE WHEN declared = matched THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS exact, round_even(avg(CASE WHEN left(declared, 1) = left(matched, 1) THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS family, round_even(median(delta_e), 6) AS median_delta_e, round_even(quantile_cont(delta_e, 0.9), 6) AS p90_delta_e, count(DISTINCT (declared, matched)) AS n_pairs FROM d""")
def colour_accuracy(spark, sf_dir):
    return visual.colour_accuracy(matched_colours(spark, sf_dir))


@query(f"""WITH {DECLARED_SQL}, s AS (SELECT style, declared, median(delta_e) AS d, avg(CASE WHEN declared = matched THEN 1.0 ELSE 0.0 END::DOUBLE) AS a FROM d GROUP BY ALL) SELECT declared, count(*) AS n_styles, round_even(median(d), 6) AS delta_e, round_even(avg(a), 6) AS accuracy, count(*) >= 8 AS calibratable FROM s GROUP BY declared""")
def colour_per_code(spark, sf_dir):
    return visual.per_code(matched_colours(spark, sf_dir))


@query("""WITH t AS (SELECT p_type AS value, p_size / 50.0::DOUBLE AS conf, CASE WHEN p_size / 50.0 < 0.28 THEN 'uncertain' ELSE p_type END AS tag FROM part) SELECT 'type' AS attribute, count(*) AS n, round_even(avg(CASE WHEN tag = 'uncertain' THEN 1.0 ELSE 0.0 END), 6) AS uncertain, round_even(avg(conf), 6) AS mean_conf, count(DISTINCT CASE WHEN tag <> 'uncertain' THEN tag END) AS n_values FROM t""")
def attribute_coverage(spark, sf_dir):
    conf = F.col("p_size") / F.lit(50.0)
    tags = read(spark, sf_dir, "part").select(F.when(conf < 0.28, "uncertain").otherwise(F.col("p_type")).alias("type"), conf.alias("type__conf"))
    return visual.attribute_coverage(tags, ["type"])


@query("""WITH r AS (SELECT CASE WHEN contains(p_name, 'small') THEN 'small' WHEN contains(p_name, 'large') THEN 'large' END AS stated, CASE WHEN p_size <= 25 THEN 'small' ELSE 'large' END AS measured FROM part), k AS (SELECT stated, count(*) AS n, count(*) FILTER (WHERE stated = measured) AS hit FROM r WHERE stated IS NOT NULL GROUP BY stated),
  s AS (SELECT CAST(sum(n) AS BIGINT) AS n, round_even(sum(hit) / sum(n), 6) AS accuracy, round_even(max(n) / sum(n), 6) AS baseline FROM k) SELECT *, n >= 20 AND accuracy >= 0.7 AND accuracy >= baseline + 0.1 AS trusted FROM s""")
def label_agreement(spark, sf_dir):
    name = F.col("p_name")
    rows = read(spark, sf_dir, "part").select(F.when(name.contains("small"), "small").when(name.contains("large"), "large").alias("stated"), F.when(F.col("p_size") <= 25, "small").otherwise("large").alias("measured"))
    return visual.label_agreement(rows, "stated", "measured")


SIGNATURES_SQL = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT q.id AS query, n.id, 0 AS win, q.e AS q, n.e AS e FROM v q, v n WHERE q.id % 50 = 0),
  d AS (SELECT query, id, list_avg(list_transform(range(0, 18), lambda c: sqrt(pow(q[c * 3 + 1] - e[c * 3 + 1], 2) + pow(q[c * 3 + 2] - e[c * 3 + 2], 2) + pow(q[c * 3 + 3] - e[c * 3 + 3], 2)))) + 0.5::DOUBLE * list_avg(list_transform(range(55, 64), lambda i: abs(q[i] - e[i]))) AS x FROM p),
  r AS (SELECT query, id, round_even(x, 5) AS distance FROM d)"""


@query(f"WITH {SIGNATURES_SQL} SELECT query, id, distance, 0 AS window, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS place FROM r QUALIFY place <= 10".replace("0 AS window", 'CAST(0 AS BIGINT) AS "window"'))
def signature_search(spark, sf_dir):
    """The embeddings as signatures of 18 cells and 9 spreads; every row whose id is divisible by 50 asks."""
    rows = vectors(spark, sf_dir).select("id", F.col("embedding").cast("array<double>").alias("signature"))
    asked = rows.where(F.col("id") % 50 == 0).select(F.col("id").alias("query"), F.lit(0).cast("long").alias("window"), F.col("signature").alias("q"))
    return visual.nearest_signatures(asked, rows, 18, 9)


@query("")
def design_blocks(spark, sf_dir):
    return visual.blocks(vectors(spark, sf_dir))


@query("")
def design_block_summary(spark, sf_dir):
    return visual.block_summary(visual.blocks(vectors(spark, sf_dir)))


@query("")
def feature_importance(spark, sf_dir):
    return visual.feature_importance(graded(spark, sf_dir), ["color", "sub_category", "product_line", "size"])


@query("")
def stratified_interval(spark, sf_dir):
    return visual.stratified_bootstrap(terms(spark, sf_dir), F.col("product_name").rlike("ring|bolt"), ["category", "term"])


@query(f"WITH {TERMS_SQL} SELECT sku, min(season) AS first_season, max(season) AS last_season, count(*) AS n_terms FROM terms GROUP BY sku")
def style_spans(spark, sf_dir):
    return terms(spark, sf_dir).groupBy("sku").agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.count("*").alias("n_terms"))


@query("""WITH t AS (SELECT doc_id AS id, text FROM documents) SELECT id, nullif(upper(regexp_extract(text, '(^|[^0-9A-Za-z])#?([0-9A-Fa-f]{6})([^0-9A-Za-z]|$)', 2)), '') AS hex FROM t WHERE regexp_matches(text, '(^|[^0-9A-Za-z])#?([0-9A-Fa-f]{6})([^0-9A-Za-z]|$)')""")
def hex_codes(spark, sf_dir):
    """The first six-digit colour in each document that has one."""
    from selvage.operators import names

    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), names.hex_in(F.col("text")).alias("hex")).where("hex is not null")


@query("""WITH w AS (SELECT p_partkey AS sku, string_split(p_name, ' ') AS ws FROM part) SELECT sku, array_to_string(list_filter(ws, lambda x: x IN ('hot', 'ring', 'red', 'box')), ' ') AS terms FROM w WHERE len(list_filter(ws, lambda x: x IN ('hot', 'ring', 'red', 'box'))) = len(ws)""")
def title_terms(spark, sf_dir):
    """Names of which every word is a term, read as titles."""
    from selvage.operators import names

    words = ["hot", "ring", "red", "box"]
    parts = names.title_parts(F.col("p_name"), words, ["sale"])
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), parts["terms"].alias("t"))
    whole = F.forall("t", lambda x: x.isin(words))
    return rows.where(whole & (F.size("t") > 0)).select("sku", F.array_join("t", " ").alias("terms"))


@query("""WITH e AS (SELECT p_partkey AS sku, p_name AS product_name, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM part JOIN embeddings ON p_partkey = vec_id), q AS (SELECT v AS q FROM e ORDER BY sku LIMIT 1),
  c AS (SELECT count(*) AS n, count(*) FILTER (WHERE contains(product_name, 'ring')) AS a, count(*) FILTER (WHERE contains(product_name, 'red')) AS b FROM e),
  s AS (SELECT e.*, round_even(CASE WHEN contains(product_name, 'ring') THEN ln((n + 1) / (a + 1)) ELSE 0 END + CASE WHEN contains(product_name, 'red') THEN ln((n + 1) / (b + 1)) * 0.8::DOUBLE ELSE 0 END, 6) AS score FROM e, c),
  l AS (SELECT * FROM s WHERE score >= (SELECT min(score) FROM (SELECT score FROM s ORDER BY score DESC LIMIT 10))),
  d AS (SELECT sku, product_name, score, round_even(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 6) AS similarity FROM l, q),
  r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, sku) AS rank, similarity - lead(similarity) OVER (ORDER BY similarity DESC, sku) AS lead FROM d) SELECT rank, sku, product_name, score, similarity, (rank = 1 AND lead >= 0.02) AS stands_out FROM r WHERE rank <= 15""")
def search_cascade(spark, sf_dir):
    """Words, then vectors among those found: the first item asks for what is like it."""
    from selvage.operators import retrieval

    items = read(spark, sf_dir, "part").join(read(spark, sf_dir, "embeddings"), F.col("p_partkey") == F.col("vec_id")).select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("product_name"), "embedding")
    asked = items.orderBy("sku").first()["embedding"]
    return retrieval.cascade(items, {"ring": 1.0, "red": 0.8}, asked, n=10)


@query("")
def week_plan(spark, sf_dir):
    from .findings import _association

    return planning.week_plan(graded(spark, sf_dir), _association(spark, sf_dir))


@query(f"WITH {PLACED_SQL} SELECT placement, count(*) AS n FROM placed GROUP BY placement")
def placement_counts(spark, sf_dir):
    from selvage.operators import names

    items = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("product_name"))
    return names.placement_counts(names.placements(items, ["ring", "box"], ["hot", "red", "large"]))
