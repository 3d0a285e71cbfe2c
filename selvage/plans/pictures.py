"""Queries on pictures, with their SQL: images of mistyped codes, binary codes, geometry, and the 8 x 8 rasters that the vectors are read as."""

from __future__ import annotations

from pyspark.sql import functions as F

from selvage.functions import colour
from selvage.functions.columns import let, settled
from selvage.operators import beat, hamming, inliers, near_keys, palettes, rasters, retrieval, visual
from selvage.sources import carve, files

from .adapter import read
from .search import EVERY, SWATCH_SQL, TERMS, swatches

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


TERM_SCORES_SQL = f"""t AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {c}::DOUBLE)" for t, c in TERMS.items())}) v(term, conf)), c AS (SELECT term, conf, count(*) AS n, count(*) FILTER (WHERE contains(p_name, term)) AS k FROM part, t GROUP BY term, conf),
  s AS (SELECT p_partkey AS sku, round_even(sum(CASE WHEN contains(p_name, term) THEN ln((n + 1) / (k + 1)) * conf ELSE 0 END), 6) AS score FROM part, c GROUP BY 1)"""


# --- codes -----------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT DISTINCT lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR), 7, '0') AS code FROM part WHERE p_retailprice IS NOT NULL),
  p AS (SELECT a.code, b.code AS near, hamming(a.code, b.code) AS apart FROM c a JOIN c b ON a.code <> b.code AND length(a.code) = length(b.code))
  SELECT code, near, CAST(list_position(list_transform(range(1, length(code) + 1), lambda i: code[i] <> near[i]), true) AS INT) AS place, apart = 2 AS turned FROM p
  WHERE apart = 1 OR (apart = 2 AND damerau_levenshtein(code, near) = 1)""")
def near_codes(spark, sf_dir):
    """Prices in cents as codes of seven digits: all pairs with one wrong digit or two neighbours turned."""
    cents = F.lpad(F.round(F.col("p_retailprice") * 100).cast("long").cast("string"), 7, "0")
    codes = read(spark, sf_dir, "part").where("p_retailprice is not null").select(cents.alias("code"))
    return near_keys.near_keys(codes, codes, "code")


#: Where a part's image lies and what it is called, by its number's and its size's remainders.
PATHS_SQL = """CASE p_size % 7 WHEN 0 THEN p_brand || '/' || sku || '_front.jpg' WHEN 1 THEN p_brand || '/' || sku || '/front.jpg' WHEN 2 THEN p_brand || '/' || lower(sku) || '.jpg'
    WHEN 3 THEN p_brand || '/KA-' || substr(sku, 3, 4) || ' ' || substr(sku, 7) || '.JPG' WHEN 4 THEN p_brand || '/' || substr(sku, 3) || '_b.jpg'
    WHEN 5 THEN p_brand || '/KA' || CASE WHEN p_partkey % 2 = 0 THEN '9' || substr(sku, 4) ELSE substr(sku, 4, 1) || substr(sku, 3, 1) || substr(sku, 5) END || '.jpg' ELSE p_brand || '/' || p_name || '.jpg' END"""


@query(f"""WITH s AS (SELECT *, 'KA' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS sku FROM part), i AS (SELECT DISTINCT {PATHS_SQL} AS path FROM s),
  n AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '^(.*)/', 1) AS folders, regexp_replace(upper(regexp_extract(path, '([^/]*)$', 1)), '[^A-Z0-9]', '', 'g') AS plain FROM i WHERE path IS NOT NULL),
  d AS (SELECT path, unnest(list_filter(regexp_extract_all(plain, '\\d+'), lambda x: length(x) = 7)) AS number FROM n),
  sk AS (SELECT DISTINCT sku FROM s WHERE sku IS NOT NULL), orphan AS (SELECT * FROM d WHERE 'KA' || number NOT IN (SELECT sku FROM sk)),
  x AS (SELECT sku, 0 AS layer, path FROM sk JOIN n ON contains(name, sku) UNION ALL SELECT sku, 1, path FROM sk JOIN n ON contains(folders, sku) AND NOT regexp_matches(name, 'KA\\d{{7}}')
    UNION ALL SELECT sku, 2, path FROM sk JOIN n ON contains(upper(name), sku) UNION ALL SELECT sku, 3, path FROM sk JOIN n ON contains(plain, sku) UNION ALL SELECT sku, 4, path FROM sk JOIN d ON substr(sku, 3) = number
    UNION ALL SELECT sku, 5, path FROM sk JOIN orphan ON hamming(substr(sku, 3), number) = 1 OR (hamming(substr(sku, 3), number) = 2 AND damerau_levenshtein(substr(sku, 3), number) = 1)),
  b AS (SELECT sku, min(layer) AS layer, arg_min(path, (layer, path)) AS path FROM x GROUP BY sku)
  SELECT sk.sku, coalesce(['file name', 'folder name', 'case', 'signs or wide letters', 'digits only', 'one character off'][layer + 1], 'no image') AS found, path FROM sk LEFT JOIN b USING (sku)""")
def images_by_layer(spark, sf_dir):
    """Images of every part, and of parts without one the reason: paths are made of the parts' numbers, names and brands."""
    parts = read(spark, sf_dir, "part").withColumn("sku", F.concat(F.lit("KA"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")))
    found = near_keys.match_images(parts, parts.select(F.expr(PATHS_SQL).alias("path")))
    return found.select("sku", "found", "path")


@query(f"""WITH s AS (SELECT *, 'KA' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS sku FROM part), i AS (SELECT DISTINCT {PATHS_SQL} AS path FROM s),
  n AS (SELECT path, regexp_extract(path, '([^/]+)$', 1) AS name, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS folder FROM i WHERE path IS NOT NULL),
  m AS (SELECT path, regexp_extract(name, '(KA[0-9]{{7}})', 1) AS sku, regexp_extract(name, 'KA[0-9]{{7}}[_-]?([^.]*)\\.', 1) AS view, folder FROM n WHERE regexp_matches(name, 'KA[0-9]{{7}}'))
  SELECT path, sku, view, substr(sku, 1, 5) AS season_code, regexp_extract(folder, '(KA[0-9]{{3}})', 1) NOT IN ('', substr(sku, 1, 5)) AS misfiled, row_number() OVER (PARTITION BY sku ORDER BY view, path) = 1 AS is_primary FROM m""")
def image_manifest(spark, sf_dir):
    """Sku, view and season of the parts' images by their names, and each sku's one primary image."""
    parts = read(spark, sf_dir, "part").withColumn("sku", F.concat(F.lit("KA"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")))
    listed = parts.select(F.expr(PATHS_SQL).alias("path")).distinct()
    listed = listed.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))
    return files.image_manifest(listed).select("path", "sku", "view", "season_code", "misfiled", "is_primary")


@query("SELECT p_brand AS brand, count(*) AS n, CASE WHEN count(*) > 1 THEN round_even(0.01::DOUBLE * sqrt(2 * ln(count(*))), 6) ELSE 0 END AS penalty FROM part GROUP BY 1")
def reference_penalties(spark, sf_dir):
    """What the best of a brand's parts gains by their number alone."""
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    return rows.withColumn("penalty", F.bround(retrieval.reference_penalty(F.col("n")), 6))


@query(f"""WITH {TERM_SCORES_SQL} SELECT sku, score FROM s WHERE score >= (SELECT min(score) FROM (SELECT score FROM s ORDER BY score DESC LIMIT 40))""")
def word_shortlist(spark, sf_dir):
    """The forty parts that words score best, with all that tie with the last."""
    items = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("product_name"))
    return retrieval.shortlist(retrieval.idf_scores(items, TERMS), 40).select("sku", "score")


@query(f"""WITH {SWATCH_SQL} SELECT id, hex FROM l""")
def hex_round_trip(spark, sf_dir):
    """Colours to LAB and back: each is itself again."""
    rows = swatches(spark, sf_dir)
    lightness, a, b = colour.lab_of_hex(F.col("hex"))
    return rows.select("id", let(lambda v: colour.hex_of_lab(v.lightness, v.a, v.b), lightness=lightness, a=a, b=b).alias("hex"))


# --- binary codes and geometry ---------------------------------------------------------------------------------------

CODES_SQL = """c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS s, embedding AS e FROM embeddings),
  near AS (SELECT q.id AS query, c.id, len(list_filter(range(1, 65), lambda i: coalesce(q.s[i], false) <> coalesce(c.s[i], false))) AS distance FROM c q JOIN c ON q.id <> c.id WHERE q.id % 50 = 0),
  top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM near QUALIFY rank <= 5)"""


def nearest(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding"), 1).alias("code"))
    asked = rows.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query"), "code")
    return hamming.nearest_codes(asked, rows, 5, words=1)


@query(f"WITH {CODES_SQL} SELECT query, id, distance, rank FROM top")
def hamming_topk(spark, sf_dir):
    """The five nearest sign codes of every fiftieth vector."""
    return nearest(spark, sf_dir)


def raster_points(vector):
    """A raster's 64 pixels as points, each with a code of which of the others, in turn from it, are larger."""
    larger = lambda n: lambda s, j: s.bitwiseOR(F.call_function("shiftleft", (F.get(vector, (n + j + 1) % 64) > F.get(vector, n)).cast("int").cast("long"), j))
    code = lambda n: F.array(F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("long"), larger(n)))
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda n: F.struct((n % 8).alias("x"), F.floor(n / 8).alias("y"), code(n).alias("code")))


def reranked(spark, sf_dir):
    near = settled(nearest(spark, sf_dir).select("query", "id"))
    # points are drawn of the rows that are in a pair, and by all tasks, however few splits the file has
    met = near.select(F.explode(F.array("query", "id")).alias("vec_id")).distinct()
    rows = read(spark, sf_dir, "embeddings").join(met, "vec_id", "left_semi").repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")
    points = settled(rows.select(F.col("vec_id").alias("id"), raster_points(F.col("embedding")).alias("points")))
    return inliers.geometric_rerank(near, points, words=1, tolerance=0.5)


@query(f"""WITH {CODES_SQL}, d AS (SELECT id, i, array_to_string(list_transform(range(1, 64), lambda j: CASE WHEN e[(i + j) % 64 + 1] > e[i + 1] THEN '1' ELSE '0' END), '') AS code FROM c, range(64) t(i)),
  m AS (SELECT t.query, t.id, a.i, list_sort(list(hamming(a.code, b.code))) AS apart FROM top t JOIN d a ON a.id = t.query JOIN d b ON b.id = t.id GROUP BY ALL)
  SELECT query, id, count(*) FILTER (WHERE apart[1] * 100 < apart[2] * 78) AS n_good FROM m GROUP BY ALL""")
def ratio_matches(spark, sf_dir):
    """How many points of a query have one clearly nearest point in each of its five nearest vectors."""
    return reranked(spark, sf_dir).select("query", "id", "n_good")


@query("")
def geometric_inliers(spark, sf_dir):
    """The same with the matches that one homography agrees with, to half a pixel."""
    return reranked(spark, sf_dir)


# --- rasters ---------------------------------------------------------------------------------------------------------

#: Where things are on a raster: name, top, bottom, left, right.
ZONES = [("collar", 0.0, 0.25, 0.25, 0.75), ("chest", 0.25, 0.5, 0.0, 1.0), ("waist", 0.5, 0.75, 0.0, 1.0), ("pocket", 0.5, 0.75, 0.0, 0.5), ("hem", 0.75, 1.0, 0.0, 1.0)]

#: The vectors' 64 numbers as pixels of 0 to 255.
PIXELS_SQL = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(least(greatest(CAST(x AS DOUBLE) * 800 + 128, 0), 255)) AS INT)) AS p FROM embeddings WHERE len(embedding) = 64), px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, p[i + 1] AS v FROM e, range(64) t(i))"


def grey(vector):
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * 800 + 128, F.lit(0.0)), F.lit(255.0))).cast("int"))


def drawn(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    return rows.select("vec_id", grey(F.col("embedding")).alias("p"), F.lit(8).alias("width"))


@query(f"""WITH RECURSIVE {PIXELS_SQL}, m AS (SELECT vec_id, median(v) AS m FROM px GROUP BY 1), d AS (SELECT vec_id, y, x, abs(v - m) AS d FROM px JOIN m USING (vec_id)),
  s AS (SELECT vec_id, coalesce(nullif(median(d), 0), 1) AS s FROM d GROUP BY 1), k AS (SELECT vec_id, y, x FROM d JOIN s USING (vec_id) WHERE d > greatest(45, 1.5 * s)),
  f AS (SELECT vec_id, y * 8 + x AS start, y, x FROM k UNION SELECT f.vec_id, f.start, k.y, k.x FROM f JOIN k ON k.vec_id = f.vec_id AND abs(k.y - f.y) + abs(k.x - f.x) = 1),
  c AS (SELECT vec_id, y, x, min(start) AS label FROM f GROUP BY ALL), b AS (SELECT vec_id, label, count(*) AS area, min(y) AS top, min(x) AS "left", max(y) AS bottom, max(x) AS "right" FROM c GROUP BY ALL HAVING count(*) >= 64 * 0.04),
  z AS (SELECT b.*, q.n, name, round_even(greatest(0, least((bottom + 1) / 8, zb) - greatest(top / 8, zt)) * greatest(0, least(("right" + 1) / 8, zr) - greatest("left" / 8, zl)) / ((bottom + 1 - top) * ("right" + 1 - "left") / 64), 3) AS share, (zb - zt) * (zr - zl) AS size
    FROM b, (VALUES {", ".join(f"({k}, '{n}', {t}::DOUBLE, {b}::DOUBLE, {x}::DOUBLE, {y}::DOUBLE)" for k, (n, t, b, x, y) in enumerate(ZONES))}) q(n, name, zt, zb, zl, zr))
  SELECT vec_id, area, top, "left", bottom, "right", max(share) FILTER (WHERE share > 0) AS share, arg_min(name, (-share, size, n)) FILTER (WHERE share > 0) AS zone FROM z GROUP BY vec_id, label, area, top, "left", bottom, "right\"""")
def decorations(spark, sf_dir):
    """Connected parts of a raster that stand out, with the zone that holds most of each."""
    found = rasters.decorations(drawn(spark, sf_dir), "p", "width", times=1.5, share=0.04)
    part = F.struct("top", "left", "bottom", "right")
    zone = F.get(rasters.zone_shares(part, F.col("width"), F.col("width"), ZONES), F.lit(0))
    return found.select("vec_id", "area", "top", "left", "bottom", "right", zone["share"].alias("share"), zone["zone"].alias("zone"))


@query(f"""WITH {PIXELS_SQL}, w AS (SELECT * FROM (VALUES {", ".join(f"({n}, {t}::DOUBLE, {h}::DOUBLE)" for n, (t, h) in enumerate(rasters.BANDS))}) b(win, t, h)),
  r AS (SELECT win, CAST(floor(8 * t) AS INT) AS top, least(8, CAST(floor(8 * t) AS INT) + CAST(floor(8 * h) AS INT)) AS bottom FROM w), c AS (SELECT win, s, top + i * (bottom - top) // s AS y1, top + (i + 1) * (bottom - top) // s AS y2, j * 8 // s AS x1, (j + 1) * 8 // s AS x2, i * s + j AS cell
    FROM r, (VALUES (2), (3)) q(s), range(3) a(i), range(3) b(j) WHERE bottom - top >= 3 AND i < s AND j < s)
  SELECT vec_id, win AS "window", s AS scale, cell, round_even(avg(v) FILTER (WHERE v < 230), 6) AS mean, round_even(count(*) FILTER (WHERE v < 230) / count(*), 6) AS cover FROM c JOIN px ON y >= y1 AND y < y2 AND x >= x1 AND x < x2 GROUP BY ALL""")
def window_cells(spark, sf_dir):
    """Mean of the pixels that aren't white in every cell of every band and scale."""
    rows = drawn(spark, sf_dir)
    cells = rasters.cell_signatures(F.col("p"), F.transform("p", lambda v: v < 230), F.col("width"), scales=(2, 3), least_side=3)
    found = rows.select("vec_id", F.explode(cells).alias("c")).select("vec_id", "c.*")
    return found.select("vec_id", "window", "scale", "cell", F.bround("mean", 6).alias("mean"), F.bround("cover", 6).alias("cover"))


@query(f"""WITH {PIXELS_SQL}, g AS (SELECT vec_id, median(v) AS bg FROM px WHERE y < 2 AND (x < 2 OR x > 5) GROUP BY 1), f AS (SELECT vec_id, x, abs(median(v) - any_value(bg)) <= 40 AS blank FROM px JOIN g USING (vec_id) GROUP BY ALL),
  i AS (SELECT *, x - row_number() OVER (PARTITION BY vec_id, blank ORDER BY x) AS island FROM f), gaps AS (SELECT vec_id, min(x) AS a, max(x) + 1 AS b FROM i WHERE blank GROUP BY vec_id, island),
  cuts AS (SELECT vec_id, (a + b) // 2 AS cut FROM gaps WHERE a > 0 AND b < 8 UNION ALL SELECT vec_id, 0 FROM e UNION ALL SELECT vec_id, 8 FROM e), p AS (SELECT vec_id, cut AS "start", lead(cut) OVER (PARTITION BY vec_id ORDER BY cut) AS "end" FROM cuts),
  k AS (SELECT p.vec_id, "start", "end" FROM p JOIN f ON f.vec_id = p.vec_id AND x >= "start" AND x < "end" WHERE "end" IS NOT NULL GROUP BY ALL HAVING "end" - "start" >= 8 * 0.08 AND count(*) FILTER (WHERE blank) <= 0.95 * ("end" - "start")),
  n AS (SELECT vec_id, count(*) AS n FROM k GROUP BY 1)
  SELECT k.vec_id, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end" FROM k JOIN n USING (vec_id) WHERE n >= 2 UNION ALL SELECT e.vec_id, 0, 8 FROM e LEFT JOIN n USING (vec_id) WHERE coalesce(n, 0) < 2""")
def raster_panels(spark, sf_dir):
    """Rasters cut at runs of columns in the background's colour."""
    return drawn(spark, sf_dir).select("vec_id", F.explode(rasters.panels(F.col("p"), F.col("width"), tolerance=40, least_gap=1)).alias("panel")).select("vec_id", "panel.*")


@query(f"""WITH {PIXELS_SQL}, r AS (SELECT vec_id, y, count(*) FILTER (WHERE v < 160) AS k, count(*) FILTER (WHERE NOT v < 160 AND x >= 1 AND x < 6) AS holes FROM px GROUP BY ALL), w AS (SELECT vec_id, y, holes, CASE WHEN k >= 3 THEN k ELSE 0 END AS k FROM r),
  b AS (SELECT vec_id, coalesce(quantile_cont(k, 0.2) FILTER (WHERE y >= 4 AND y < 7 AND k > 0), quantile_cont(k, 0.5) FILTER (WHERE k > 0)) AS body FROM w GROUP BY 1),
  s AS (SELECT w.vec_id, any_value(body) AS body, coalesce(min(y) FILTER (WHERE k >= body * 0.7), 0) AS shoulder, max(k) FILTER (WHERE y < 6) AS peak, arg_min(y, (-k, y)) FILTER (WHERE y < 6) AS cuff FROM w JOIN b USING (vec_id) WHERE body > 0 GROUP BY 1),
  l AS (SELECT *, least(8, greatest(shoulder + 1, 2)) AS lim FROM s), n AS (SELECT l.vec_id, min(y) FILTER (WHERE k > 0 AND holes = 0) AS closed FROM l JOIN w ON w.vec_id = l.vec_id AND y < lim GROUP BY 1),
  g AS (SELECT l.vec_id, body, shoulder, peak, cuff, lim, closed, max(holes) FILTER (WHERE k > 0 AND y < coalesce(closed, 99)) AS gap FROM l JOIN n USING (vec_id) JOIN w ON w.vec_id = l.vec_id AND y < lim GROUP BY ALL),
  t AS (SELECT vec_id, round_even(body, 3) AS body, shoulder, round_even(depth / body, 3) AS neck_depth, round_even(coalesce(gap, 0) / body, 3) AS neck_width, CASE WHEN peak <= body * 1.06 THEN 0.0 ELSE round_even(greatest(0, (cuff - shoulder) / 8), 3) END AS sleeve_share, peak <= body * 1.06 AS bare, round_even((8 - shoulder) / body, 3) AS length_ratio FROM (SELECT *, coalesce(closed, lim) AS depth FROM g))
  SELECT vec_id, body, shoulder, neck_depth, neck_width, CASE WHEN neck_width < 0.15 THEN 'high' WHEN neck_depth >= 0.26 THEN CASE WHEN neck_width < 0.62 THEN 'deep' ELSE 'open' END WHEN neck_depth <= 0.09 AND neck_width >= 0.62 THEN 'boat' WHEN neck_width >= 0.62 THEN 'wide' ELSE 'round' END AS neck,
    CAST(sleeve_share AS DOUBLE) AS sleeve_share, CASE WHEN bare OR sleeve_share <= 0.06 THEN 'none' WHEN sleeve_share <= 0.16 THEN 'cap' WHEN sleeve_share <= 0.34 THEN 'short' WHEN sleeve_share <= 0.55 THEN 'middle' ELSE 'long' END AS sleeve,
    length_ratio, CASE WHEN length_ratio < 1.02 THEN 'short' WHEN length_ratio < 1.45 THEN 'regular' WHEN length_ratio < 1.85 THEN 'long' ELSE 'tunic' END AS length FROM t""")
def raster_silhouettes(spark, sf_dir):
    """Neckline, sleeve and length by the widths of rows."""
    rows = drawn(spark, sf_dir).select("vec_id", rasters.silhouette(F.transform("p", lambda v: v < 160), F.col("width")).alias("s"))
    return rows.where("s is not null").select("vec_id", "s.*")


def channels(rows):
    """The raster and itself moved by 21 and 42 pixels as red, green and blue."""
    moved = lambda n: F.concat(F.slice("p", n + 1, 64 - n), F.slice("p", 1, n)) if n else F.col("p")
    return [moved(n) for n in (0, 21, 42)]


COLOURS_SQL = f"{PIXELS_SQL}, c AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, p[i + 1] AS r, p[(i + 21) % 64 + 1] AS g, p[(i + 42) % 64 + 1] AS b FROM e, range(64) t(i))"


@query(f"""WITH {COLOURS_SQL}, edge AS (SELECT c.* FROM c WHERE y < 3 UNION ALL SELECT * FROM c WHERE y > 4 UNION ALL SELECT * FROM c WHERE x < 3 UNION ALL SELECT * FROM c WHERE x > 4),
  m AS (SELECT vec_id, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM edge GROUP BY 1), o AS (SELECT vec_id, greatest(abs(r - mr), abs(g - mg), abs(b - mb)) AS off FROM edge JOIN m USING (vec_id)),
  k AS (SELECT vec_id, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM c GROUP BY 1), j AS (SELECT vec_id, y, x, greatest(abs(r - mr), abs(g - mg), abs(b - mb)) > 26 AS far FROM c JOIN k USING (vec_id)),
  rr AS (SELECT vec_id, count(*) AS n, min(y) AS a, max(y) AS b FROM (SELECT vec_id, y FROM j GROUP BY ALL HAVING avg(far::INT) > 0.06) GROUP BY 1), cc AS (SELECT vec_id, count(*) AS n, min(x) AS a, max(x) AS b FROM (SELECT vec_id, x FROM j GROUP BY ALL HAVING avg(far::INT) > 0.06) GROUP BY 1),
  bx AS (SELECT e.vec_id, CASE WHEN coalesce(rr.n, 0) < 0.8 OR coalesce(cc.n, 0) < 0.8 THEN 8 ELSE rr.b - rr.a + 1 END AS tall, CASE WHEN coalesce(rr.n, 0) < 0.8 OR coalesce(cc.n, 0) < 0.8 THEN 8 ELSE cc.b - cc.a + 1 END AS wide FROM e LEFT JOIN rr USING (vec_id) LEFT JOIN cc USING (vec_id)),
  s AS (SELECT vec_id, avg((least(r, g, b) >= 230)::INT) AS white, coalesce(quantile_cont(greatest(r, g, b) - least(r, g, b), 0.75) FILTER (WHERE least(r, g, b) < 230), 0) AS sat, count(DISTINCT (r // 32) * 64 + (g // 32) * 8 + b // 32) AS ncolor FROM c GROUP BY 1),
  t AS (SELECT vec_id, avg((off <= 55)::INT) AS edge_bg, median(off) AS ring_sd FROM o GROUP BY 1)
  SELECT vec_id, round_even(white, 6) AS white, round_even(sat, 6) AS sat, round_even(tall * wide / 64, 6) AS fill, round_even(tall / wide, 6) AS aspect, round_even(edge_bg, 6) AS edge_bg, round_even(ring_sd, 6) AS ring_sd, CAST(ncolor AS DOUBLE) AS ncolor, 8.0::DOUBLE AS longest,
    CASE WHEN edge_bg < 0.7 OR ring_sd > 20 THEN 'fabric' WHEN ncolor <= 24 AND white >= 0.55 THEN 'stamp' WHEN white >= 0.62 AND sat < 22 THEN 'line art' WHEN white >= 0.45 AND tall / wide < 1 THEN 'line art' ELSE 'other' END AS kind
  FROM s JOIN t USING (vec_id) JOIN bx USING (vec_id)""")
def raster_kinds(spark, sf_dir):
    """Statistics of rasters of three channels, and the kind that they tell."""
    rows = drawn(spark, sf_dir)
    red, green, blue = channels(rows)
    found = rows.select("vec_id", rasters.raster_statistics(red, green, blue, F.col("width")).alias("s")).select("vec_id", "s.*")
    names = [c for c in found.columns if c != "vec_id"]
    return found.select("vec_id", *[F.bround(c, 6).alias(c) for c in names], carve.kind_of_image().alias("kind"))


@query("")
def raster_palettes(spark, sf_dir):
    """Main colours of every raster, and how far they are from those of the next vector of the same label."""
    rows = drawn(spark, sf_dir)
    red, green, blue = channels(rows)
    own = settled(rows.select("vec_id", palettes.palette(red, green, blue).alias("palette")))
    other = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("palette").alias("_next"))
    joined = own.join(other, "vec_id", "left").withColumn("to_next", F.bround(visual.palette_distance(F.col("palette"), F.col("_next")), 6))
    return joined.select("vec_id", "to_next", F.posexplode("palette").alias("place", "c")).select("vec_id", "place", *[F.bround(F.col(f"c.{x}"), 6).alias(x) for x in ("L", "a", "b", "w")], "to_next")


# --- beat ------------------------------------------------------------------------------------------------------------

HOURS_SQL = """h AS (SELECT user_id AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, count(*) AS level FROM events GROUP BY ALL), o AS (SELECT a.key, a.slot, a.level - coalesce(b.level, 0) AS onset FROM h a LEFT JOIN h b ON b.key IS NOT DISTINCT FROM a.key AND b.slot = a.slot - 1 WHERE a.level > coalesce(b.level, 0)),
  lags AS (SELECT a.key, b.slot - a.slot AS lag, sum(a.onset * b.onset) AS lag_sum FROM o a JOIN o b ON a.key = b.key AND b.slot - a.slot BETWEEN 4 AND 72 GROUP BY ALL)"""


def hourly(spark, sf_dir):
    events = read(spark, sf_dir, "events").where("user_id is not null")
    return beat.levels(events.select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("hour"), F.lit(1).alias("n")), "user_id", "hour", "n")


@query(f"WITH {HOURS_SQL} SELECT key AS user_id, lag, CAST(lag_sum AS DOUBLE) AS lag_sum FROM lags WHERE lag_sum > 0")
def beat_lags(spark, sf_dir):
    """How often a user's hours of more events are followed by such hours, by the hours between."""
    return beat.lag_sums(hourly(spark, sf_dir), 4, 72, block=128).where("lag_sum > 0").select(F.col("key").alias("user_id"), "lag", "lag_sum")


@query(f"""WITH {HOURS_SQL}, s AS (SELECT *, round_even(lag_sum * exp(-0.5 * power(log2(lag / 24) / 0.45, 2)), 6) AS score FROM lags), b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, lag) = 1),
  p AS (SELECT o.key, slot % lag AS phase, sum(onset) AS phase_sum FROM o JOIN b USING (key) GROUP BY o.key, slot % lag QUALIFY row_number() OVER (PARTITION BY o.key ORDER BY phase_sum DESC, phase) = 1)
  SELECT key AS user_id, lag, CAST(lag_sum AS DOUBLE) AS lag_sum, score, phase, CAST(phase_sum AS DOUBLE) AS phase_sum FROM b JOIN p USING (key)""")
def user_beats(spark, sf_dir):
    """Each user's interval of hours, near a day if there is no better one, and where in it the events rise."""
    return beat.beats(hourly(spark, sf_dir), 4, 72, usual=24, block=128).withColumnRenamed("key", "user_id")
