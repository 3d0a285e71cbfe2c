"""The registered queries of this package and the SQL that some of them are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, written


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_forest import near_duplicates

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


#: A sequence's limits beside 4096 tokens, and which tokens bear loss.
PACKING = {"loss": "last line", "max_segments": 32, "max_loss": 1536}


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = pack_documents(docs, _tokenizer("word_bpe_49k.json"), end=2, **PACKING)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"), "offset", "segments", "loss_tokens", "sequence_tokens", "sequence_segments", "sequence_loss")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, _tokenizer("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op4_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity import judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


#: Fixed: the contract's rules (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .host_reputation import judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, table(spark, sf_dir, "labels"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad", F.round("bad_rate", 9).alias("bad_rate"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses_of

    responses = responses_of(table(spark, sf_dir, "pages").select("page_id", "url", "html"), date="2024-01-01T00:00:00Z")
    records = derivatives(responses, keep=["page_id"])
    return records.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", F.to_json("headers").alias("headers"), F.decode("block", "utf-8").alias("block"), "block_digest", "payload_digest")


#: Shares of expected tokens that op6 mixes to.
DOMAIN_TARGETS = {"high": 0.85, "low": 0.1, "toxic": 0.05}


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    domain = F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("quality") == 1, F.lit("high")).when(F.col("quality") == 0, F.lit("low"))
    weights = train(docs, table(spark, sf_dir, "labels"), domain, list(DOMAIN_TARGETS))
    mixed = mix(docs, weights, DOMAIN_TARGETS, _tokenizer("word_bpe_49k.json"), carry=["doc_id"])
    return mixed.select("doc_id", "n_tokens", F.round(F.col("posterior")[0], 6).alias("p_high"), F.round(F.col("posterior")[1], 6).alias("p_low"), F.round(F.col("posterior")[2], 6).alias("p_toxic"), F.round("rate", 6).alias("rate"), "copies", F.round(F.array_max(F.transform("gap", lambda g: F.abs(g))), 6).alias("worst_gap"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import edit_pairs

    pairs = edit_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    machine = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = score_toxicity(docs, machine, to="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_shared_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_span_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align, pair_counts, with_counts

    aligned = align(table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    kept = written(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "links"), "aligned")
    return with_counts(kept, pair_counts(kept)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_transducer_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexicon import build_lexicon, encode

    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("word_bpe_49k.json")
    encoded = encode(docs, path, build_lexicon(docs, path))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors

    found = cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, rounds=10, dims=64, scale=1024, seed="3:")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, i, arr[i] AS line FROM (SELECT doc_id, arr, unnest(range(1, len(arr) + 1)) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS arr FROM documents))
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, (f.key IS NOT NULL AND k.doc_id <> f.holder) AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_vector_packing": op2_vector_packing,
    "op3_token_counts": op3_token_counts,
    "op4_perplexity_rules": op4_perplexity_rules,
    "op5_host_reputation": op5_host_reputation,
    "op6_soft_mixing": op6_soft_mixing,
    "op7_order_minhash": op7_order_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_line_dedup": op10_line_dedup,
    "op11_span_alignment": op11_span_alignment,
    "op12_transducer_lexicon": op12_transducer_lexicon,
    "op13_bisector_clusters": op13_bisector_clusters,
}

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

OP5_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), k AS (
  SELECT doc_id AS page_id, max(CAST(toxic = 1 OR quality = 0 AS INT)) AS bad FROM labels WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY 1
), parts AS (
  SELECT host, string_split(host, '.') AS a FROM (SELECT DISTINCT host FROM p)
), names AS (
  SELECT host, coalesce(a[-1], '') AS l1, coalesce(a[-2], '') AS l2, coalesce(a[-3], '') AS l3 FROM parts
), reg AS (
  SELECT host,
    CASE WHEN d THEN l2 || '.' || l1 ELSE l1 END AS suffix,
    CASE WHEN d THEN l3 || '.' || l2 || '.' || l1 WHEN l2 <> '' THEN l2 || '.' || l1 ELSE l1 END AS domain
  FROM (SELECT *, (length(l1) = 2 AND l2 IN ('ac','co','com','edu','gov','net','org') AND l3 <> '') AS d FROM names)
), h AS (
  SELECT p.host, suffix, domain, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM (SELECT DISTINCT page_id, host FROM p) p LEFT JOIN k USING (page_id) JOIN reg USING (host) GROUP BY ALL
), d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL
), tot AS (SELECT coalesce(sum(bad), 0) AS tb, coalesce(sum(n), 0) AS tn FROM s
), s1 AS (SELECT s.*, (tb - bad + coalesce(tb / nullif(tn, 0), 0)) / (tn - n + 1) AS above FROM s, tot
), sw AS (
  SELECT (sum(n * pow(bad / n - above, 2)) - sum(above * (1 - above))) / greatest(sum(n) - count(*), 1) AS b, sum(n * above * (1 - above)) / sum(n) AS m FROM s1 WHERE n > 0
), s2 AS (
  SELECT s1.*, w, (bad + w * above) / (n + w) AS rate FROM s1, (SELECT CASE WHEN b > 0 THEN least(greatest(m / b - 1, 1.0), 1e4) ELSE 1e4 END AS w FROM sw)
), d1 AS (SELECT d.*, (s2.bad - d.bad + s2.w * s2.above) / (s2.n - d.n + s2.w) AS above FROM d JOIN s2 USING (suffix)
), dw AS (
  SELECT (sum(n * pow(bad / n - above, 2)) - sum(above * (1 - above))) / greatest(sum(n) - count(*), 1) AS b, sum(n * above * (1 - above)) / sum(n) AS m FROM d1 WHERE n > 0
), d2 AS (
  SELECT d1.*, w, (bad + w * above) / (n + w) AS rate FROM d1, (SELECT CASE WHEN b > 0 THEN least(greatest(m / b - 1, 1.0), 1e4) ELSE 1e4 END AS w FROM dw)
), h1 AS (SELECT h.*, (d2.bad - h.bad + d2.w * d2.above) / (d2.n - h.n + d2.w) AS above FROM h JOIN d2 USING (domain)
), hw AS (
  SELECT (sum(n * pow(bad / n - above, 2)) - sum(above * (1 - above))) / greatest(sum(n) - count(*), 1) AS b, sum(n * above * (1 - above)) / sum(n) AS m FROM h1 WHERE n > 0
), h2 AS (
  SELECT h1.*, w, (bad + w * above) / (n + w) AS rate FROM h1, (SELECT CASE WHEN b > 0 THEN least(greatest(m / b - 1, 1.0), 1e4) ELSE 1e4 END AS w FROM hw)
), r AS (
  SELECT host, CAST(n AS BIGINT) AS n_labelled, CAST(bad AS BIGINT) AS n_bad, rate, greatest(rate - 1.645 * sqrt(rate * (1 - rate) / (n + w + 1)), 0) AS lower FROM h2
), j AS (
  SELECT p.page_id, p.host, p.path, r.n_labelled, r.n_bad, r.rate, r.lower,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p LEFT JOIN r USING (host)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  n_labelled, n_bad, round(rate, 9) AS bad_rate
FROM j
"""


def _op13_sql(rounds: int = 10) -> str:
    """All distances to all centroids, one step of the query for each round."""
    nearest = """SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.r, m.c, sum(pow(v.x - m.x, 2)::HUGEINT) AS d FROM v JOIN m{n} m USING (i) GROUP BY ALL) GROUP BY r"""
    steps = [f"""a{n} AS MATERIALIZED ({nearest.format(n=n)}
), m{n + 1} AS MATERIALIZED (
  SELECT m.c, m.i, coalesce(f.x, m.x) AS x FROM m{n} m LEFT JOIN (
    SELECT a.c, v.i, floor(sum(v.x) / count(*))::BIGINT AS x FROM v JOIN a{n} a USING (r) GROUP BY ALL) f ON f.c = m.c AND f.i = m.i
)""" for n in range(rounds)]
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id), z) AS r, z FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS z FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)
), v AS MATERIALIZED (SELECT r, unnest(z) AS x, unnest(range(64)) AS i FROM k
), m0 AS MATERIALIZED (SELECT r - 1 AS c, i, x FROM v WHERE r <= 8
), {", ".join(steps)}, z AS MATERIALIZED ({nearest.format(n=rounds)}
), s AS (SELECT c, sum(d)::BIGINT AS own FROM z GROUP BY c
), h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS digest FROM m{rounds} GROUP BY c)
SELECT k.vec_id, z.c::INT AS cluster, z.d::BIGINT AS distance, s.own AS cluster_inertia, (SELECT sum(own) FROM s)::BIGINT AS inertia, h.digest AS centroid_sha256
FROM k JOIN z USING (r) JOIN s ON s.c = z.c JOIN h ON h.c = z.c
"""


ORACLES = {"op1_minhash_forest": OP1_SQL, "op5_host_reputation": OP5_SQL, "op10_line_dedup": OP10_SQL, "op13_bisector_clusters": _op13_sql()}
