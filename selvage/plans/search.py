"""Queries on vectors, names, colours and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from selvage.functions import colour
from selvage.functions.columns import let
from selvage.operators import leaderboard as boards
from selvage.operators import names, retrieval

from .adapter import GRADED_SQL, read
from .sales_reports import graded

QUERIES, ORACLES = {}, {}

#: Every row whose id is divisible by this is a query, against all rows.
EVERY = 50
TERMS = {"hot": 1.0, "ring": 0.9, "red": 0.8, "large": 0.7, "widget": 0.6}
VOCABULARY = ["hot", "cold", "red", "blue", "small", "large", "ring", "bolt", "anvil", "widget", "plate", "box", "case"]


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("label"))


def asked(rows):
    return rows.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query"), F.col("embedding").alias("q"))


PAIRS_SQL = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CAST(label AS BIGINT) AS label FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v),
  pairs AS (SELECT q.id AS query, n.id, n.label, round_even(list_dot_product(q.e, n.e) / nullif(q.n * n.n, 0), 6) AS similarity FROM n q JOIN n ON q.id <> n.id WHERE q.id % 50 = 0)"""


def per_label(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return retrieval.best_of_each(asked(rows), rows, "label")


@query(f"WITH {PAIRS_SQL} SELECT query, id, label, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM pairs QUALIFY rank <= 10")
def cosine_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return retrieval.nearest(asked(rows), rows, 10)


@query(f"""WITH {PAIRS_SQL}, a AS (SELECT *, label = query % 10 AS fits FROM pairs), b AS (SELECT *, count(*) FILTER (WHERE fits) OVER (PARTITION BY query) AS k FROM a)
  SELECT query, id, label, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM b WHERE fits OR k < 5 QUALIFY rank <= 10""")
def narrowed_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return retrieval.nearest(asked(rows).withColumn("want", F.col("query") % 10), rows, 10, narrow=("want", "label"))


@query("""WITH v AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT id, label, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v),
  m AS (SELECT i, avg(x) AS m FROM u GROUP BY i), c AS (SELECT id, any_value(label) AS label, list(x - m ORDER BY i) AS e FROM u JOIN m USING (i) GROUP BY id), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM c),
  pairs AS (SELECT q.id AS query, n.id, n.label, round_even(list_dot_product(q.e, n.e) / nullif(q.n * n.n, 0), 6) AS similarity FROM n q JOIN n ON q.id <> n.id WHERE q.id % 50 = 0)
  SELECT query, id, label, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM pairs QUALIFY rank <= 10""")
def centred_topk(spark, sf_dir):
    rows = retrieval.centred(vectors(spark, sf_dir))
    return retrieval.nearest(asked(rows), rows, 10, unit=True)


@query(f"WITH {PAIRS_SQL}, m AS (SELECT query, label, max(similarity) AS similarity, arg_max(id, (similarity, -id)) AS id FROM pairs GROUP BY ALL) SELECT * FROM m")
def best_per_label(spark, sf_dir):
    return per_label(spark, sf_dir)


@query(f"""WITH {PAIRS_SQL}, r AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM pairs QUALIFY rank <= 10), t AS (SELECT id AS query, label AS truth FROM v WHERE id % 50 = 0),
  f AS (SELECT t.query, min(rank) FILTER (WHERE label = truth) AS rank FROM t LEFT JOIN r USING (query) GROUP BY t.query)
  SELECT count(*) AS n, round_even(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top_1, round_even(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top_5, round_even(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS top_10,
    round_even(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) FILTER (WHERE rank IS NULL) AS n_missed FROM f""")
def retrieval_eval(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    truth = rows.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query"), F.col("label").alias("true"))
    return retrieval.evaluate(truth, retrieval.nearest(asked(rows), rows, 10))


@query(f"""WITH {PAIRS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC) AS r FROM pairs),
  s AS (SELECT query, count(*) AS n, max(similarity) AS top, max(similarity) FILTER (WHERE r = 2) AS second, avg(similarity) AS m, stddev_pop(similarity) AS sd FROM o GROUP BY query),
  t AS (SELECT query, n, top, second, round_even((top - m) / nullif(sd, 0), 4) AS z, round_even(sqrt(2 * ln(greatest(n, 2))), 4) AS by_chance, round_even(top - second, 6) AS lead FROM s)
  SELECT *, CASE WHEN z < by_chance THEN 'no better than chance' WHEN lead < 0.02 THEN 'ambiguous' ELSE 'clear' END AS verdict FROM t""")
def search_confidence(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return retrieval.confidence_of(asked(rows), rows)


@query(f"""WITH {PAIRS_SQL}, b AS (SELECT query, label, max(similarity) AS s FROM pairs GROUP BY ALL), w AS (SELECT *, exp(10 * (s - max(s) OVER (PARTITION BY query))) AS w FROM b), p AS (SELECT *, w / sum(w) OVER (PARTITION BY query) AS p FROM w),
  o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY p DESC, label DESC) AS r FROM p), t AS (SELECT query, max(label) FILTER (WHERE r = 1) AS best, max(p) FILTER (WHERE r = 1) AS c, max(p) FILTER (WHERE r = 1) - coalesce(max(p) FILTER (WHERE r = 2), 0) AS m FROM o GROUP BY query)
  SELECT query, CASE WHEN c < 0.28 OR m < 0.05 THEN 'uncertain' ELSE CAST(best AS VARCHAR) END AS tag, round_even(c, 5) AS conf, round_even(m, 5) AS margin FROM t""")
def softmax_tags(spark, sf_dir):
    return retrieval.softmax_tags(per_label(spark, sf_dir), "label", scale=10.0)


@query("""WITH t AS (SELECT * FROM (VALUES ('hot', 1.0::DOUBLE), ('ring', 0.9::DOUBLE), ('red', 0.8::DOUBLE), ('large', 0.7::DOUBLE), ('widget', 0.6::DOUBLE)) AS v(term, conf)),
  c AS (SELECT term, conf, count(*) AS n, count(*) FILTER (WHERE contains(p_name, term)) AS k FROM part, t GROUP BY term, conf), d AS (SELECT term, ln((n + 1) / (k + 1)) * conf AS w FROM c),
  s AS (SELECT p_partkey AS sku, p_name AS product_name, sum(CASE WHEN contains(p_name, term) THEN w ELSE 0 END) - max(CASE WHEN contains(p_name, 'cold') THEN 1.6::DOUBLE ELSE 0 END) AS x FROM part, d GROUP BY 1, 2)
  SELECT sku, product_name, round_even(x, 6) AS score FROM s ORDER BY score DESC, sku LIMIT 20""")
def idf_rank(spark, sf_dir):
    items = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("product_name"))
    return retrieval.idf_rank(items, TERMS, without=("cold",))


@query("""SELECT term, count(*) AS n_names FROM part, (SELECT unnest(['hot','cold','red','blue','small','large','ring','bolt','anvil','widget','plate','box','case']) AS term) WHERE contains(p_name, term) GROUP BY term HAVING count(*) >= 4 ORDER BY n_names, term LIMIT 90""")
def vocabulary_frequency(spark, sf_dir):
    return names.vocabulary_frequency(read(spark, sf_dir, "part").select(F.col("p_name").alias("product_name")), VOCABULARY)


NGRAMS_SQL = """x AS (SELECT regexp_replace(p_name, '[\\s\\d]+', '', 'g') AS s FROM part), l AS (SELECT s, unnest([2, 3, 4, 5]) AS n FROM x), i AS (SELECT s, n, unnest(range(1, length(s) - n + 2)) AS i FROM l WHERE length(s) >= n),
  grams AS (SELECT substring(s, i, n) AS gram, count(*) AS n FROM i GROUP BY 1 HAVING count(*) >= 3)"""


@query(f"WITH {NGRAMS_SQL} SELECT * FROM grams")
def ngram_counts(spark, sf_dir):
    return names.ngram_counts(read(spark, sf_dir, "part"), "p_name")


def _level(n: int, above: str) -> str:
    return f"""l{n} AS (SELECT g.* FROM grams g WHERE length(gram) = {n} AND NOT EXISTS (SELECT 1 FROM {above} a WHERE length(a.gram) > {n} AND contains(a.gram, g.gram) AND a.n >= 0.8 * g.n)), a{n} AS (SELECT * FROM {above} UNION ALL SELECT * FROM l{n})"""


@query(f"WITH {NGRAMS_SQL}, a5 AS (SELECT * FROM grams WHERE length(gram) = 5), {_level(4, 'a5')}, {_level(3, 'a4')}, {_level(2, 'a3')} SELECT * FROM a2")
def ngram_vocabulary(spark, sf_dir):
    return names.learn_vocabulary(names.ngram_counts(read(spark, sf_dir, "part"), "p_name"))


SIGNED_SQL = """f AS (SELECT p_partkey AS sku, p_name, p_type, list_sort(list_distinct(regexp_extract_all(p_name, '(widget|anvil|large|plate|small|blue|bolt|case|cold|ring|box|hot|red)', 1))) AS fs FROM part),
  s AS (SELECT *, coalesce(list_sum(list_transform(fs, lambda t: length(t))), 0) / greatest(length(regexp_replace(p_name, '[0-9 ]', '', 'g')), 1) AS cov FROM f)"""


@query(f"WITH {SIGNED_SQL} SELECT sku, array_to_string(fs, '+') AS features, round_even(cov, 6) AS coverage, CASE WHEN len(fs) > 0 THEN p_type || '|' || array_to_string(fs, '+') ELSE '' END AS signature FROM s")
def name_signature(spark, sf_dir):
    return _signed(spark, sf_dir).select("sku", F.array_join("features", "+").alias("features"), "coverage", "signature")


def _signed(spark, sf_dir):
    items = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"))
    return names.with_signature(items, VOCABULARY)


@query("")
def duplicate_groups(spark, sf_dir):
    return names.duplicate_groups(_signed(spark, sf_dir))


@query(f"""WITH {GRADED_SQL}, f AS (SELECT product_name, category, count(DISTINCT season) AS n_seasons, count(*) AS n, arg_min(sell_through_rate, (season, sku)) AS a, arg_max(sell_through_rate, (season, sku)) AS b, min(sell_through_rate) AS lo FROM graded WHERE sell_through_rate IS NOT NULL GROUP BY ALL)
  SELECT product_name, category, n_seasons, n, round_even(b - a, 6) AS change, CASE WHEN n_seasons < 2 THEN 'same season' WHEN b - a <= -0.1 THEN 'declining' WHEN lo >= 0.6 THEN 'always good' ELSE 'no trend' END AS verdict FROM f""")
def family_verdicts(spark, sf_dir):
    return names.family_verdict(graded(spark, sf_dir), ["product_name", "category"])


#: For each place word its feature at most 2 characters off, the nearest and then the first; no word comes twice in these names.
PLACED_SQL = """n AS (SELECT p_partkey AS sku, p_name AS t FROM part), pl AS (SELECT * FROM (VALUES (1, 'ring'), (2, 'box')) AS v(k, place)), ft AS (SELECT * FROM (VALUES ('hot'), ('red'), ('large')) AS v(feature)),
  m AS (SELECT sku, t, k, place, instr(t, place) AS s, instr(t, place) + length(place) AS e FROM n, pl WHERE contains(t, place)),
  f AS (SELECT sku, k, feature, greatest(instr(t, feature) - e, s - instr(t, feature) - length(feature), 0) AS gap, instr(t, feature) AS spot FROM m, ft WHERE contains(t, feature)),
  b AS (SELECT sku, k, feature FROM f WHERE gap <= 2 QUALIFY row_number() OVER (PARTITION BY sku, k ORDER BY gap, spot, feature) = 1), placed AS (SELECT m.sku, m.k, place || ':' || coalesce(feature, '') AS placement FROM m LEFT JOIN b ON m.sku = b.sku AND m.k = b.k)"""


@query(f"WITH {PLACED_SQL} SELECT n.sku, any_value(t) AS product_name, coalesce(string_agg(placement, ' ' ORDER BY k), '') AS placed FROM n LEFT JOIN placed ON n.sku = placed.sku GROUP BY n.sku")
def placements(spark, sf_dir):
    items = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("product_name"))
    return names.placements(items, ["ring", "box"], ["hot", "red", "large"]).withColumn("placed", F.array_join("placed", " "))


#: Fixed: a palette of codes in LAB.
PALETTE = [("10", 95, 0, 2), ("19", 15, 0, 0), ("20", 85, 2, 15), ("30", 50, 60, 40), ("40", 70, 20, 60), ("50", 88, -5, 75), ("60", 55, -45, 35), ("70", 45, 10, -50), ("80", 40, 45, -40), ("90", 60, 40, 5)]


def swatches(spark, sf_dir):
    """Vectors as colours: their first three numbers as hexadecimal red, green and blue."""
    byte = lambda n: F.lpad(F.hex(F.pmod(F.floor(F.abs(F.col("embedding")[n].cast("double")) * 1000), F.lit(256)).cast("long")), 2, "0")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("#"), byte(0), byte(1), byte(2)).alias("hex"))


SWATCH_SQL = """b AS (SELECT vec_id AS id, list_transform([embedding[1], embedding[2], embedding[3]], lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256) AS c FROM embeddings),
  l AS (SELECT id, '#' || lpad(upper(to_hex(c[1])), 2, '0') || lpad(upper(to_hex(c[2])), 2, '0') || lpad(upper(to_hex(c[3])), 2, '0') AS hex, list_transform(c, lambda v: CASE WHEN v / 255 <= 0.04045::DOUBLE THEN v / 255 / 12.92::DOUBLE ELSE pow((v / 255 + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END) AS r FROM b),
  x AS (SELECT id, hex, [(0.4124564::DOUBLE * r[1] + 0.3575761::DOUBLE * r[2] + 0.1804375::DOUBLE * r[3]) / 0.95047::DOUBLE, 0.2126729::DOUBLE * r[1] + 0.7151522::DOUBLE * r[2] + 0.0721750::DOUBLE * r[3], (0.0193339::DOUBLE * r[1] + 0.1191920::DOUBLE * r[2] + 0.9503041::DOUBLE * r[3]) / 1.08883::DOUBLE] AS t FROM l),
  f AS (SELECT id, hex, list_transform(t, lambda v: CASE WHEN v > 216.0::DOUBLE / 24389 THEN cbrt(v) ELSE (24389.0::DOUBLE / 27 * v + 16) / 116 END) AS f FROM x), lab AS (SELECT id, hex, 116 * f[2] - 16 AS l, 500 * (f[1] - f[2]) AS a, 200 * (f[2] - f[3]) AS b FROM f)"""


@query(f"WITH {SWATCH_SQL} SELECT id, hex, round_even(l, 4) AS l, round_even(a, 4) AS a, round_even(b, 4) AS b FROM lab")
def colour_lab(spark, sf_dir):
    lightness, a, b = colour.lab_of_hex(F.col("hex"))
    return swatches(spark, sf_dir).select("id", "hex", F.bround(lightness, 4).alias("l"), F.bround(a, 4).alias("a"), F.bround(b, 4).alias("b"))


@query(f"""WITH {SWATCH_SQL}, h AS (SELECT *, sqrt(a * a + b * b) AS c, CASE WHEN a = 0 AND b = 0 THEN 0 WHEN degrees(atan2(b, a)) < 0 THEN degrees(atan2(b, a)) + 360 ELSE degrees(atan2(b, a)) END AS h FROM lab)
  SELECT CASE WHEN c < 12 THEN CASE WHEN l < 25 THEN 'black' WHEN l < 75 THEN 'grey' ELSE 'white' END WHEN h >= 30 AND h < 90 AND l < 50 THEN 'brown' WHEN h < 20 OR h >= 340 THEN 'pink red' WHEN h < 50 THEN 'red orange' WHEN h < 75 THEN 'orange' WHEN h < 105 THEN 'yellow'
    WHEN h < 170 THEN 'green' WHEN h < 225 THEN 'teal' WHEN h < 290 THEN 'blue' ELSE 'purple' END AS family, count(*) AS n FROM h GROUP BY 1""")
def colour_families(spark, sf_dir):
    lightness, a, b = colour.lab_of_hex(F.col("hex"))
    family = let(lambda v: colour.family_of(v["l"], v["a"], v["b"]), l=lightness, a=a, b=b)
    return swatches(spark, sf_dir).groupBy(family.alias("family")).agg(F.count("*").alias("n"))


HUE_SQL = "CASE WHEN {0} = 0 AND {1} = 0 THEN 0 WHEN degrees(atan2({1}, {0})) < 0 THEN degrees(atan2({1}, {0})) + 360 ELSE degrees(atan2({1}, {0})) END"
PALETTE_ROWS = ", ".join(f"('{code}', {l}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for code, l, a, b in PALETTE)
#: CIEDE2000 of each swatch and code, step by step, and the codes by distance.
NEAREST_SQL = SWATCH_SQL + f""", pal AS (SELECT * FROM (VALUES {PALETTE_ROWS}) AS t(code, l2, a2, b2)), e0 AS (SELECT id, code, l AS l1, lab.a AS a1, lab.b AS b1, l2, a2, b2, pow((sqrt(lab.a * lab.a + lab.b * lab.b) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) AS c7 FROM lab, pal),
  e1 AS (SELECT *, a1 * (1 + 0.5::DOUBLE * (1 - sqrt(c7 / (c7 + pow(25::DOUBLE, 7))))) AS p1, a2 * (1 + 0.5::DOUBLE * (1 - sqrt(c7 / (c7 + pow(25::DOUBLE, 7))))) AS p2 FROM e0),
  e2 AS (SELECT *, sqrt(p1 * p1 + b1 * b1) AS c1, sqrt(p2 * p2 + b2 * b2) AS c2, {HUE_SQL.format("p1", "b1")} AS h1, {HUE_SQL.format("p2", "b2")} AS h2 FROM e1),
  e3 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS turn, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS h, (c1 + c2) / 2 AS c, pow((l1 + l2) / 2 - 50, 2) AS low FROM e2),
  e4 AS (SELECT *, 1 - 0.17::DOUBLE * cos(radians(h - 30)) + 0.24::DOUBLE * cos(radians(2 * h)) + 0.32::DOUBLE * cos(radians(3 * h + 6)) - 0.20::DOUBLE * cos(radians(4 * h - 63)) AS t, -2 * sqrt(pow(c, 7) / (pow(c, 7) + pow(25::DOUBLE, 7))) * sin(radians(60 * exp(-pow((h - 275) / 25, 2)))) AS r FROM e3),
  e5 AS (SELECT *, (l2 - l1) / (1 + 0.015::DOUBLE * low / sqrt(20 + low)) AS dl, (c2 - c1) / (1 + 0.045::DOUBLE * c) AS dc, 2 * sqrt(c1 * c2) * sin(radians(turn / 2)) / (1 + 0.015::DOUBLE * c * t) AS dh FROM e4),
  near AS (SELECT id, code, round_even(sqrt(dl * dl + dc * dc + dh * dh + r * dc * dh), 4) AS delta_e FROM e5), nearest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delta_e, code) AS place FROM near)"""


@query(f"""WITH {NEAREST_SQL} SELECT id, place, code, delta_e, CASE WHEN delta_e < 1 THEN 'same' WHEN delta_e < 2 THEN 'very close' WHEN delta_e < 3.5 THEN 'close' WHEN delta_e < 5 THEN 'visible' ELSE 'different' END AS verdict FROM nearest WHERE place <= 3""")
def colour_codes(spark, sf_dir):
    lightness, a, b = colour.lab_of_hex(F.col("hex"))
    return colour.nearest_codes(swatches(spark, sf_dir).select("id", lightness.alias("L"), a.alias("a"), b.alias("b")), PALETTE, "id")


def scores(spark, sf_dir):
    day, week = boards.period_keys(F.col("ts"))
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("board"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("id"), F.floor(F.col("value") * 100).cast("long").alias("score"), "ts", day.alias("day"), week.alias("week"), F.lit("all").alias("ever"))
    return boards.valid(rows)


SCORES_SQL = """e AS (SELECT event_type AS board, 'user' || user_id AS id, CAST(floor(value * 100) AS BIGINT) AS score, ts, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day,
    isoyear(ts + INTERVAL 8 HOUR) || '-W' || lpad(CAST(week(ts + INTERVAL 8 HOUR) AS VARCHAR), 2, '0') AS week, 'all' AS ever FROM events), s AS (SELECT * FROM e WHERE score BETWEEN 0 AND 13333 AND regexp_full_match(id, '[a-z0-9]{4,16}'))"""


def _board_sql(period: str) -> str:
    return f"""WITH {SCORES_SQL}, b AS (SELECT board, {period}, id, max(score) AS score, arg_min(ts, (-score, ts)) AS ts FROM s GROUP BY ALL)
  SELECT board, {period}, id, score, ts, row_number() OVER (PARTITION BY board, {period} ORDER BY score DESC, ts, id) AS place FROM b QUALIFY place <= 100"""


@query(_board_sql("day"))
def leaderboard_day(spark, sf_dir):
    return boards.leaderboard(scores(spark, sf_dir), "day")


@query(_board_sql("week"))
def leaderboard_week(spark, sf_dir):
    return boards.leaderboard(scores(spark, sf_dir), "week")


@query(_board_sql("ever"))
def leaderboard_all(spark, sf_dir):
    return boards.leaderboard(scores(spark, sf_dir), "ever")


@query("""WITH a AS (SELECT user_id AS id, event_id AS question, event_type AS choice FROM events), c AS (SELECT id, choice, count(*) AS n, min(question) AS f FROM a GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, f, choice) AS r FROM c)
  SELECT id, CAST(sum(n) AS BIGINT) AS n_answers, max(choice) FILTER (WHERE r = 1) AS first, max(n) FILTER (WHERE r = 1) AS n_first, coalesce(max(choice) FILTER (WHERE r = 2), '-') AS second FROM o GROUP BY id""")
def quiz_tally(spark, sf_dir):
    return boards.quiz_tally(read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("question"), F.col("event_type").alias("choice")))


@query("""WITH b AS (SELECT user_id AS id, event_id % 40 AS beat, least(value / 100, 1) AS m, (event_id % 7) / 10::DOUBLE AS late FROM events), v AS (SELECT id, beat, max(greatest(m * (1 - least(late / 2, 0.5)), 0)) AS v FROM b GROUP BY ALL),
  s AS (SELECT id, count(*) AS n_beats, CAST(round_even(avg(CASE WHEN v >= 0.9 THEN 1.0 WHEN v >= 0.7 THEN 0.75 WHEN v >= 0.5 THEN 0.5 ELSE 0.0 END::DOUBLE) * 13333, 0) AS BIGINT) AS score FROM v GROUP BY id)
  SELECT *, (score >= 3000)::BIGINT + (score >= 6000)::BIGINT + (score >= 9000)::BIGINT + (score >= 11000)::BIGINT + (score >= 12500)::BIGINT AS stars FROM s""")
def beat_grades(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    beats = events.select(F.col("user_id").alias("id"), (F.col("event_id") % 40).alias("beat"), F.least(F.col("value") / 100, F.lit(1.0)).alias("match"), ((F.col("event_id") % 7) / F.lit(10.0)).alias("late"))
    return boards.beat_grades(beats)
