"""Queries on spec sheets, survey exports, cleaned sales lines and tags of attributes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from selvage.operators import lift, retrieval, survey, techpack
from selvage.sources import carve, pos, saved

from .adapter import read
from .search import PAIRS_SQL, per_label

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


SIZES = ["XS", "S", "M", "L", "XL", "2XL", "3XL"]
QUANTITY = ["數量", "qty"]
MEASURES = {"chest": ["胸圍", "chest"], "length": ["衣長", "length"], "hip": ["臀圍", "hip"]}
FIELDS = {"ordered": (["orderdate"], "date"), "buyer": (["buyer"], "number"), "state": (["state"], "text")}


def _sheets(spark, sf_dir):
    """Orders as spec sheets: sizes over their ordered quantities; a measure under the sizes, with blanks; one that stands
    right of its label or below it; and fields right of their labels, below them, or too far away to be right of them."""
    orders = read(spark, sf_dir, "orders")
    lines = read(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    cell = lambda row, col, text: F.struct(F.lit(row).alias("row"), col.cast("int").alias("col"), text.alias("text"))
    at = F.col("l_linenumber") + 1
    chest = F.when(F.col("d") > 0.02, F.concat(F.round(F.col("d") * 100).cast("int").cast("string"), F.lit(" 1/2")))
    inner = lines.select(
        F.col("l_orderkey").alias("file"),
        F.explode(F.array(cell(1, at, F.get(F.array(*[F.lit(s) for s in SIZES]), F.col("l_linenumber") - 1)), cell(2, at, F.col("q").cast("int").cast("string")), cell(3, at, chest))).alias("c"),
    )
    one = lambda row, col, text: cell(row, F.lit(col), text)
    heads = orders.join(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    outer = heads.select(
        F.col("o_orderkey").alias("file"),
        F.explode(F.array(
            one(2, 1, F.lit("數量 ")), one(3, 1, F.lit("胸 圍")), one(4, 1, F.lit("衣長")), one(5, 1, F.col("o_totalprice").cast("string")),
            one(4, 12, F.when(F.col("o_custkey") % 3 == 0, (10 + F.col("o_custkey") % 90).cast("string"))),
            one(6, 9, F.lit("Order-Date")), one(6, 11, F.date_format("o_orderdate", "yyyyMMdd")), one(7, 9, F.lit("Buyer")), one(8, 9, F.col("o_custkey").cast("string")),
            one(9, 9, F.lit("STATE")), one(9, 13, F.lit("far away")), one(12, 9, F.concat(F.lit(" "), F.col("o_orderstatus"))),
        )).alias("c"),
    )
    return inner.unionByName(outer).select("file", "c.*").where("text is not null")


SHEETS_SQL = """l AS (SELECT l_orderkey AS f, l_linenumber AS n, CAST(sum(l_quantity) AS INT) AS q, max(l_discount) AS d FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL),
  p AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n) AS place, count(*) OVER (PARTITION BY f) AS k FROM l),
  b AS (SELECT f, n AS base FROM p WHERE k >= 2 QUALIFY row_number() OVER (PARTITION BY f ORDER BY q DESC, abs(place - (k + 1) // 2), n) = 1)"""


@query(f"WITH {SHEETS_SQL} SELECT f AS file, ['XS', 'S', 'M', 'L', 'XL', '2XL', '3XL'][base] AS size, CAST(base + 1 AS INT) AS col FROM b")
def spec_base_size(spark, sf_dir):
    """The size of each sheet that is ordered most; sheets of one size name none."""
    return techpack.base_sizes(_sheets(spark, sf_dir), SIZES, QUANTITY)


@query(f"""WITH {SHEETS_SQL}, c AS (SELECT p.f, arg_min(CAST(round(d * 100) AS INT) + 0.5, CASE WHEN n = base THEN 0 ELSE n END) AS chest FROM p LEFT JOIN b USING (f) WHERE d > 0.02 GROUP BY p.f),
  m AS (SELECT o_orderkey AS file, CAST(coalesce(chest, o_totalprice) AS DOUBLE) AS chest, CASE WHEN o_custkey % 3 = 0 THEN CAST(10 + o_custkey % 90 AS DOUBLE) ELSE o_totalprice END AS length FROM orders LEFT JOIN c ON f = o_orderkey WHERE o_orderkey IN (SELECT f FROM l))
  SELECT *, CAST(NULL AS DOUBLE) AS hip, 2 AS extract_fields FROM m""")
def spec_measures(spark, sf_dir):
    """Measures at the base size, else the first right of the label, else the first below it; one row for each sheet."""
    return techpack.measures_wide(techpack.harvest(_sheets(spark, sf_dir), MEASURES, SIZES, QUANTITY), list(MEASURES))


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
  SELECT o_orderkey AS file, 'ordered' AS name, strftime(o_orderdate, '%Y%m%d') AS text, CAST(NULL AS DOUBLE) AS number, CAST(o_orderdate AS DATE) AS date FROM o
  UNION ALL SELECT o_orderkey, 'buyer', CAST(o_custkey AS VARCHAR), CAST(o_custkey AS DOUBLE), NULL FROM o UNION ALL SELECT o_orderkey, 'state', o_orderstatus, NULL, NULL FROM o""")
def spec_metadata(spark, sf_dir):
    """Fields of each sheet right of their labels or below them, typed."""
    return techpack.metadata(_sheets(spark, sf_dir), FIELDS)


@query("""WITH c AS (SELECT doc_id AS file, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents), k AS (SELECT unnest(['the', 'der', 'les', 'http']) AS keyword)
  SELECT keyword, trim(text) AS snippet, count(*) AS n, count(DISTINCT file) AS n_files FROM c JOIN k ON contains(text, keyword) WHERE length(text) <= 60 GROUP BY ALL""")
def keyword_snippets(spark, sf_dir):
    cells = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("text"))
    return techpack.keyword_vocabulary(cells, ["the", "der", "les", "http"])


@query("""WITH r AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'R' || event_id END AS id, CAST(user_id AS VARCHAR) AS shop, CASE WHEN event_id % 4 > 0 THEN event_type END AS reason FROM events),
  j AS (SELECT *, sha1('{"shop":"' || shop || '"' || coalesce(',"reason":"' || reason || '"', '') || '}') AS h FROM r WHERE id IS NULL)
  SELECT id AS response_id, shop, reason FROM r WHERE id IS NOT NULL UNION ALL SELECT 'autumn-' || h || '-' || row_number() OVER (PARTITION BY h), shop, reason FROM j""")
def survey_responses(spark, sf_dir):
    """Events as a survey's export: some rows carry an id, of the others those that are alike stay several."""
    k = F.col("event_id")
    export = read(spark, sf_dir, "events").select(
        F.when(k % 3 == 0, F.concat(F.lit(" R"), k.cast("string"))).alias("回覆 編號"), F.col("user_id").alias("門市編號 (必填)"), F.when(k % 4 > 0, F.concat("event_type", F.lit(" "))).otherwise("  ").alias("原因（複選）"), F.col("value").alias("其他")
    )
    return survey.read_export(export, {"response_id": ["回覆"], "shop": ["門市", "編號"], "reason": ["原因", "複選"]}, "autumn")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_events(spark, sf_dir):
    return saved.latest(read(spark, sf_dir, "events"), ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


@query(f"""WITH {PAIRS_SQL}, b AS (SELECT query, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS attribute, label, max(similarity) AS s FROM pairs GROUP BY ALL), w AS (SELECT *, exp(10 * (s - max(s) OVER (PARTITION BY query, attribute))) AS w FROM b), p AS (SELECT *, w / sum(w) OVER (PARTITION BY query, attribute) AS p FROM w),
  o AS (SELECT *, row_number() OVER (PARTITION BY query, attribute ORDER BY p DESC, label DESC) AS r FROM p), t AS (SELECT query, attribute, max(label) FILTER (WHERE r = 1) AS best, max(p) FILTER (WHERE r = 1) AS c, max(p) FILTER (WHERE r = 1) - coalesce(max(p) FILTER (WHERE r = 2), 0) AS m FROM o GROUP BY ALL),
  a AS (SELECT *, query % 3 AS category, query % 3 = 2 OR (query % 3 = 0) = (attribute = 'even') AS applies FROM t)
  SELECT query, category, attribute, CASE WHEN NOT applies THEN 'n/a' WHEN c < 0.28 OR m < 0.05 THEN 'uncertain' ELSE CAST(best AS VARCHAR) END AS tag, CASE WHEN applies THEN round_even(c, 5) END AS conf FROM a""")
def attribute_tags(spark, sf_dir):
    """Tags of two attributes for each query; one category has the first, one the second, one both."""
    scores = per_label(spark, sf_dir).select("query", F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("attribute"), F.col("label").alias("option"), "similarity")
    applies = spark.createDataFrame([(0, "even"), (1, "odd"), (2, "even"), (2, "odd")], "category long, attribute string")
    declared = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), (F.col("vec_id") % 3).alias("category"))
    return retrieval.tag_rows(scores, applies, declared, scale=10.0)


@query("""WITH c AS (SELECT unnest([{'f': 'lang', 'v': lang}, {'f': 'source', 'v': source}, {'f': 'text', 'v': text}]) AS u FROM documents)
  SELECT u.f AS feature FROM c GROUP BY u.f HAVING count(DISTINCT u.v) BETWEEN 2 AND 40 AND count(u.v) >= 0.05 * count(*)""")
def text_features(spark, sf_dir):
    """Which text columns of the documents can be features."""
    found = lift.candidate_features(read(spark, sf_dir, "documents"), ["url"])
    return spark.createDataFrame([(c,) for c in found], "feature string")


@query("""WITH f AS (SELECT l_orderkey % 5 AS k, lpad(CAST(l_partkey % 10000000 AS VARCHAR), 7, '0') AS code, CAST(l_quantity AS INT) AS q, l_linenumber AS n FROM lineitem),
  g AS (SELECT CASE k WHEN 0 THEN 'KA' || code || '_' || q || '.jpg' WHEN 1 THEN 'KA' || code || '.jpg' WHEN 2 THEN 'KA' || code || '-' || q || '-' || n || '.png' WHEN 3 THEN 'front' || q || '.jpg' ELSE 'KA' || code || q || n || '.jpg' END AS name FROM f),
  s AS (SELECT regexp_extract(name, 'KA[0-9]{7}([^.]*)', 1) AS suffix FROM g WHERE regexp_matches(name, 'KA[0-9]{7}')), t AS (SELECT suffix, regexp_replace(suffix, '[0-9]', '#', 'g') AS pattern, TRY_CAST(regexp_extract(suffix, '(?:^|[^0-9])([0-9]{2})(?:[^0-9]|$)', 1) AS INT) AS two FROM s)
  SELECT pattern, count(*) AS n, count(DISTINCT suffix) AS n_distinct, round_even(avg(CASE WHEN two BETWEEN 10 AND 92 THEN 1.0::DOUBLE ELSE 0 END), 6) AS could_be_colour FROM t GROUP BY pattern ORDER BY n DESC, pattern LIMIT 30""")
def suffix_patterns(spark, sf_dir):
    """What stands after the sku in the names of files."""
    k, q = F.col("l_orderkey") % 5, F.col("l_quantity").cast("int")
    code = F.concat(F.lit("KA"), F.lpad((F.col("l_partkey") % 10_000_000).cast("string"), 7, "0"))
    name = (
        F.when(k == 0, F.concat(code, F.lit("_"), q, F.lit(".jpg"))).when(k == 1, F.concat(code, F.lit(".jpg"))).when(k == 2, F.concat(code, F.lit("-"), q, F.lit("-"), F.col("l_linenumber"), F.lit(".png")))
        .when(k == 3, F.concat(F.lit("front"), q, F.lit(".jpg"))).otherwise(F.concat(code, q, F.col("l_linenumber"), F.lit(".jpg")))
    )
    return carve.suffix_patterns(read(spark, sf_dir, "lineitem").select(name.alias("name")))


@query("""WITH c AS (SELECT 'KA' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS code FROM part) SELECT CAST(substr(code, 3, 2) AS INT) + 2011 AS year, CASE WHEN substr(code, 5) IN ('7', '8') THEN 'SS' WHEN substr(code, 5) IN ('5', '6') THEN 'AW' END AS term_group,
  CASE substr(code, 5) WHEN '7' THEN 1 WHEN '8' THEN 2 WHEN '5' THEN 3 WHEN '6' THEN 4 END AS term_order, count(*) AS n FROM c GROUP BY ALL""")
def season_codes(spark, sf_dir):
    code = F.concat(F.lit("KA"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))
    rows = read(spark, sf_dir, "part").select(pos.season_parts(code).alias("s"))
    return rows.groupBy(F.col("s.year").alias("year"), F.col("s.group").alias("term_group"), F.col("s.term_order").alias("term_order")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE 'KA' || lpad(CAST((l_partkey * 7919 + l_suppkey * 104729) % 10000000 AS VARCHAR), 7, '0') END AS sku, l_suppkey % 5 AS f, l_quantity AS q, CAST(l_shipdate AS DATE) AS d FROM lineitem),
  c AS (SELECT *, CASE WHEN f = 0 THEN '2023春夏' WHEN f = 1 THEN 'KA158' ELSE substr(sku, 1, 5) END AS season, CASE WHEN substr(sku, 6, 1) = '5' THEN substr(sku, 7, 1) ELSE substr(sku, 6, 1) END AS digit, max(d) OVER (PARTITION BY f) AS snapshot_date FROM s WHERE sku IS NOT NULL)
  SELECT season, CASE WHEN digit IN ('1', '3', '9') THEN 'TOP' ELSE coalesce(map {'2': 'BOTTOM_PANTS', '4': 'BOTTOM_SKIRT', '6': 'OUTER', '7': 'DRESS', '8': 'GIFT'}[digit], 'DRESS') END AS category, count(*) AS n, count(DISTINCT sku) AS n_skus, sum(q) AS stock_in, max(snapshot_date) AS snapshot_date FROM c GROUP BY ALL""")
def cleaned_sales(spark, sf_dir):
    """Sheets of five files with rows of totals and blanks: seasons from the file, else the sku; categories from the sku, else the name."""
    n, f = F.col("l_linenumber"), F.col("l_suppkey") % 5
    sku = F.concat(F.lit("KA"), F.lpad(((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 10_000_000).cast("string"), 7, "0"))
    sheet = read(spark, sf_dir, "lineitem").select(
        F.when(n < 7, sku).when(F.col("l_orderkey") % 2 == 0, "總計 Total").alias("貨號"), F.lit("長洋").alias("品名"), F.col("l_quantity").cast("string").alias("累進"), F.date_format("l_shipdate", "yyyyMMdd").alias("出貨日"),
        F.when(f == 0, "/sheets/2023春夏.csv").when(f == 1, "/sheets/KA158/list.csv").otherwise(F.concat(F.lit("/sheets/list"), f, F.lit(".csv"))).alias("source_file"), F.lit("a").alias("source_sheet"),
    )
    lines = pos.clean(pos.standard(sheet))
    return lines.groupBy("season", "category").agg(F.count("*").alias("n"), F.countDistinct("sku").alias("n_skus"), F.sum("stock_in").alias("stock_in"), F.max("snapshot_date").alias("snapshot_date"))
