"""Vector search, its evaluation and confidence, and zero-shot tags."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.columns import dot, settled

from . import grid


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def centred(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors less the mean of all, of length 1. The mean is one row."""
    mean = vectors.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = [r["m"] for r in mean.orderBy("i").collect()]  # as many numbers as a vector has
    shifted = F.zip_with(F.col(vector), F.array(*[F.lit(m) for m in mean]), lambda x, m: x.cast("double") - m)
    out = vectors.withColumn(vector, shifted).withColumn("_n", norm(F.col(vector)))
    return out.withColumn(vector, F.when(F.col("_n") > 0, F.transform(vector, lambda x: x / F.col("_n"))).otherwise(F.col(vector))).drop("_n")


def _similar(queries: pa.Table, rows: pa.Table, unit: bool) -> Iterator[tuple[slice, np.ndarray]]:
    """A run of queries and the places of their similarities with all rows: q and embedding, with products summed in order."""
    (q, q_kind), (v, v_kind) = grid.matrix(queries["q"]), grid.matrix(rows["embedding"])
    width = min(q.shape[1], v.shape[1])  # where lengths differ nothing is compared
    across = np.ascontiguousarray(v.T)
    lengths = []
    for x in (q, v):
        total = np.zeros(len(x))
        for j in range(x.shape[1]):
            total += x[:, j] * x[:, j]
        lengths.append(np.sqrt(total))
    for tile in grid.tiles(len(q), len(v)):
        part, known = np.zeros((tile.stop - tile.start, len(v))), (q_kind[tile, None] == v_kind) & (q_kind[tile, None] >= 0)
        product = np.empty_like(part)
        for j in range(width):
            np.multiply(q[tile, j, None], across[j], out=product)
            part += product
        if not unit:
            both = lengths[0][tile, None] * lengths[1]
            known &= both != 0
            with np.errstate(all="ignore"):
                part /= both
        part = grid.rounded(part, 6)
        part[np.isnan(part)] = grid.FIRST
        part[~known] = grid.MISSING
        part[~grid.differ(queries, rows, tile)] = grid.OUT
        yield tile, part


def _columns(vectors: DataFrame) -> list[str]:
    return [c for c in vectors.columns if c not in ("id", "embedding")]


def _types(vectors: DataFrame, *names: str) -> str:
    return ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in names)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, unit: bool = False, narrow: tuple[str, str] | None = None, least: int = 5) -> DataFrame:
    """query, id, vectors' other columns, similarity and rank of the k most similar vectors of every query (query, q) but itself.

    narrow: a column of the queries and one of the vectors that are to be equal, where `least` vectors or more are left so."""
    others = _columns(vectors)

    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        fits = None if narrow is None else (asked[narrow[0]].to_numpy(), rows[narrow[1]].to_numpy(), asked[narrow[0]].is_valid().to_numpy(), rows[narrow[1]].is_valid().to_numpy())
        for tile, value in _similar(asked, rows, unit):
            r, c = grid.best(value, k)
            if fits is not None:
                same = (fits[0][tile, None] == fits[1]) & fits[2][tile, None] & fits[3]
                r2, c2 = grid.best(np.where(same, value, grid.OUT), max(k, least))
                r, c = np.unique(np.array([np.append(r, r2), np.append(c, c2)]), axis=1)
                found.append((tile.start + r, c, value[r, c], same[r, c]))
            else:
                found.append((tile.start + r, c, value[r, c], np.ones(len(r), bool)))
        r, c, value, same = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        rows = rows.take(c)
        return pa.table({"query": asked["query"].take(r), "id": rows["id"], **{x: rows[x] for x in others}, "similarity": grid.told(value), "_fits": pa.array(same)})

    pairs = grid.in_blocks(queries, vectors, work, f"query {queries.schema['query'].dataType.simpleString()}, {_types(vectors, 'id', *others)}, similarity double, _fits boolean")
    if narrow is None:
        return top_k(pairs.drop("_fits"), k)
    return top_k(settled(pairs), k, F.col("_fits"), least).drop("_fits")


def best_of_each(queries: DataFrame, vectors: DataFrame, label: str, unit: bool = False) -> DataFrame:
    """query, label, similarity and id: what best_per_sku gives for all pairs of queries (query, q) and vectors."""

    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        names = rows[label].combine_chunks().dictionary_encode(null_encoding="encode")
        names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
        of = names.indices.to_numpy(zero_copy_only=False)
        rows = rows.take(np.argsort(of, kind="stable"))  # within a label still by id
        of = np.sort(of, kind="stable")
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        sizes, found = np.diff(np.append(starts, len(of))), []
        for tile, value in _similar(asked, rows, unit) if len(of) else ():
            most = np.maximum.reduceat(value, starts, axis=1)
            r, c = np.nonzero((value == np.repeat(most, sizes, axis=1)) & (value > grid.OUT))
            first = np.append(True, (r[1:] != r[:-1]) | (of[c[1:]] != of[c[:-1]])) if len(r) else np.zeros(0, bool)
            r, c = r[first], c[first]
            found.append((tile.start + r, c, value[r, c]))
        r, c, value = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": asked["query"].take(r), label: rows[label].take(c), "id": rows["id"].take(c), "similarity": grid.told(value)})

    pairs = grid.in_blocks(queries, vectors.select("id", "embedding", label), work, f"query {queries.schema['query'].dataType.simpleString()}, {_types(vectors, label, 'id')}, similarity double")
    return best_per_sku(pairs, label)


def confidence_of(queries: DataFrame, vectors: DataFrame, unit: bool = False) -> DataFrame:
    """What confidence() gives for all pairs of queries (query, q) and vectors: blocks give counts, means and squares about them, and their two best."""

    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        for tile, value in _similar(asked, rows, unit):
            admitted, known = value > grid.OUT, value > grid.MISSING
            n, m = admitted.sum(1), known.sum(1)
            plain = np.where(value == grid.FIRST, np.nan, value)
            base = plain[np.arange(len(value)), known.argmax(1)] if value.shape[1] else np.zeros(len(value))
            with np.errstate(all="ignore"):
                off = np.where(known, plain - base[:, None], 0.0)
                mean = off.sum(1) / np.maximum(m, 1)
                square = (np.where(known, off - mean[:, None], 0.0) ** 2).sum(1)
            r, c = grid.best(value, 2)
            two = np.full((len(value), 2), grid.MISSING)
            two[r, np.arange(len(r)) - np.searchsorted(r, r, side="left")] = value[r, c]
            found.append((np.arange(tile.start, tile.stop), n, m, base + mean, square, two))
        if not found:
            found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0), np.zeros(0), np.zeros((0, 2)))]
        r, n, m, mean, square, two = (np.concatenate(x) for x in zip(*found))
        keep = n > 0
        none = m[keep] == 0
        return pa.table({
            "query": asked["query"].take(r[keep]), "_n": pa.array(n[keep], pa.int64()), "_m": pa.array(m[keep], pa.int64()), "_mean": pa.array(mean[keep], pa.float64(), mask=none), "_square": pa.array(square[keep], pa.float64(), mask=none),
            "_top": grid.told(two[keep, 0]), "_next": grid.told(two[keep, 1]),
        })

    parts = grid.in_blocks(queries, vectors.select("id", "embedding"), work, f"query {queries.schema['query'].dataType.simpleString()}, _n long, _m long, _mean double, _square double, _top double, _next double")
    parts = parts.withColumn("_base", F.min("_mean").over(Window.partitionBy("query")))  # a row for each block
    off = F.col("_mean") - F.col("_base")
    two = F.slice(F.sort_array(F.flatten(F.collect_list(F.filter(F.array("_top", "_next"), lambda x: x.isNotNull()))), asc=False), 1, 2)
    found = parts.groupBy("query").agg(F.sum("_n").alias("n"), two.alias("_two"), F.max("_base").alias("_base"), F.sum("_m").alias("_m"), F.sum(F.col("_m") * off).alias("_off"), F.sum(F.col("_square") + F.col("_m") * off * off).alias("_square"))
    by = F.try_divide("_off", "_m")
    found = found.withColumns({"top": F.get("_two", 0), "second": F.get("_two", 1), "_mean": F.col("_base") + by, "_sd": F.sqrt(F.greatest(F.try_divide(F.col("_square") - F.col("_m") * by * by, F.col("_m")), F.lit(0.0)))})
    return _verdicts(found.select("query", "n", "top", "_mean", "_sd", "second"))


def top_k(pairs: DataFrame, k: int, narrow: Column | None = None, least: int = 5) -> DataFrame:
    """The k most similar of each query; narrowed only where `least` candidates are left.

    Each task keeps its own best of a query before rows are shuffled, as the rank has a limit."""

    def best(rows: DataFrame, most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
        return rows.withColumn("_place", place).where(F.col("_place") <= most).withColumn("rank", F.col("_place").cast("long")).drop("_place")

    if narrow is None:
        return best(pairs, k)
    fitting = best(pairs.where(narrow), max(k, least))
    enough = fitting.groupBy("query").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("query")
    return fitting.where(F.col("rank") <= k).join(enough, "query", "left_semi").unionByName(best(pairs, k).join(enough, "query", "left_anti"))


def best_per_sku(pairs: DataFrame, sku: str = "sku") -> DataFrame:
    """For each query and sku its most similar vector, over all crops and images."""
    return pairs.groupBy("query", sku).agg(F.max("similarity").alias("similarity"), F.max_by("id", F.struct("similarity", -F.col("id"))).alias("id"))


def evaluate(truth: DataFrame, predictions: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Top-k hit rates and mean reciprocal rank. truth: query, true; predictions: query, rank, label. A query without a hit counts as a miss."""
    first = truth.join(predictions, "query", "left").groupBy("query").agg(F.min(F.when(F.col("label") == F.col("true"), F.col("rank"))).alias("_rank"))
    hits = [F.bround(F.avg(F.coalesce((F.col("_rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"top_{k}") for k in ks]
    return first.agg(F.count("*").alias("n"), *hits, F.bround(F.avg(F.coalesce(1 / F.col("_rank"), F.lit(0.0))), 6).alias("mrr"), F.count_if(F.col("_rank").isNull()).alias("n_missed"))


def confidence(pairs: DataFrame) -> DataFrame:
    """How far each query's best stands out: its z score against what the best of n would reach by chance, and its lead."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity")))
    second = pairs.select("query", "similarity").withColumn("_place", place).where(F.col("_place") <= 2).where(F.col("_place") == 2).select("query", F.col("similarity").alias("second"))
    out = pairs.groupBy("query").agg(F.count("*").alias("n"), F.max("similarity").alias("top"), F.avg("similarity").alias("_mean"), F.stddev_pop("similarity").alias("_sd"))
    return _verdicts(out.join(second, "query", "left"))


def _verdicts(out: DataFrame) -> DataFrame:
    """out: query, n, top, second, _mean, _sd."""
    z = F.try_divide(F.col("top") - F.col("_mean"), F.col("_sd"))
    chance = F.sqrt(2 * F.log(F.greatest(F.col("n"), F.lit(2)).cast("double")))
    out = out.withColumns({"z": F.bround(z, 4), "by_chance": F.bround(chance, 4), "lead": F.bround(F.col("top") - F.col("second"), 6)})
    verdict = F.when(F.col("z") < F.col("by_chance"), "no better than chance").when(F.col("lead") < 0.02, "ambiguous").otherwise("clear")
    return out.withColumn("verdict", verdict).drop("_mean", "_sd")


def softmax_tags(scores: DataFrame, option: str, scale: float = 100.0, least: float = 0.28, margin: float = 0.05) -> DataFrame:
    """scores: query, option, similarity. The most likely option, its share and its lead; below either limit "uncertain"."""
    best = scores.groupBy("query", option).agg(F.max("similarity").alias("_s"))
    query = Window.partitionBy("query")
    weight = F.exp(scale * (F.col("_s") - F.max("_s").over(query)))
    shares = best.withColumn("_w", weight).withColumn("_p", F.col("_w") / F.sum("_w").over(query))
    ordered = F.sort_array(F.collect_list(F.struct("_p", F.col(option).alias("o"))), asc=False)
    out = shares.groupBy("query").agg(ordered.alias("_o"))
    p, second = F.get("_o", 0)["_p"], F.coalesce(F.get("_o", 1)["_p"], F.lit(0.0))
    out = out.select("query", F.get("_o", 0)["o"].alias("_best"), p.alias("_p"), (p - second).alias("_m"))
    tag = F.when((F.col("_p") < least) | (F.col("_m") < margin), "uncertain").otherwise(F.col("_best").cast("string"))
    return out.select("query", tag.alias("tag"), F.bround("_p", 5).alias("conf"), F.bround("_m", 5).alias("margin"))


def reference_penalty(n: Column, per_ref: float = 0.01) -> Column:
    """What the best of n references gains by their number alone."""
    return F.when(n > 1, per_ref * F.sqrt(2 * F.log(n.cast("double")))).otherwise(0.0)


def idf_scores(items: DataFrame, terms: dict[str, float], name: str = "product_name", without: tuple[str, ...] = (), penalty: float = 1.6) -> DataFrame:
    """All items with score: the sum over terms in their name of ln((N + 1) / (df + 1)) * confidence, less `penalty` for each word to avoid."""
    has = {t: F.col(name).contains(t) for t in terms}
    counts = items.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"d{i}") for i, c in enumerate(has.values())]).first()  # one number for each term
    score = F.lit(0.0)
    for i, (t, c) in enumerate(has.items()):
        score = score + F.when(c, math.log((counts["n"] + 1) / (counts[f"d{i}"] + 1)) * terms[t]).otherwise(0.0)
    for t in without:
        score = score - F.when(F.col(name).contains(t), penalty).otherwise(0.0)
    return items.withColumn("score", F.bround(score, 6))


def idf_rank(items: DataFrame, terms: dict[str, float], name: str = "product_name", key: str = "sku", without: tuple[str, ...] = (), top: int = 20, penalty: float = 1.6) -> DataFrame:
    """The `top` items of the highest scores by their terms."""
    return idf_scores(items, terms, name, without, penalty).select(key, name, "score").orderBy(F.desc("score"), key).limit(top)


def shortlist(ranked: DataFrame, n: int, score: str = "score", key: str = "sku") -> DataFrame:
    """The first n by score and all that tie with the last of them."""
    edge = ranked.select(score).orderBy(F.desc(score)).limit(n).agg(F.min(score)).first()[0]
    return ranked.where(F.col(score) >= edge) if edge is not None else ranked.where("false")


def cascade(items: DataFrame, terms: dict[str, float], query: list[float], n: int = 40, top: int = 15, key: str = "sku", narrow: Column | None = None, apart: Column | None = None, most_apart: float | None = None) -> DataFrame:
    """Items found by words first and by their vector among those: the shortlist by terms (with ties), then the nearest to the query's vector; whether the best stands out.

    narrow: items to look among (a season, a category). apart: how far an item's colours or cells are from the query's;
    of the items that words list, those that are `most_apart` or more away, or of unknown distance, go before vectors."""
    listed = shortlist(idf_scores(items if narrow is None else items.where(narrow), terms), n)
    if apart is not None:
        listed = listed.where(apart < most_apart if most_apart is not None else apart.isNotNull())
    q = F.array(*[F.lit(float(x)) for x in query])
    near = listed.withColumn("similarity", F.bround(F.try_divide(dot(q, F.col("embedding")), norm(q) * norm(F.col("embedding"))), 6))
    near = near.select(key, "product_name", "score", "similarity").orderBy(F.desc("similarity"), key).limit(max(top, 1) + 1)  # the last only for the first's lead
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), key)  # at most top + 1 rows
    out = near.withColumns({"rank": F.row_number().over(order).cast("long"), "_lead": F.col("similarity") - F.lead("similarity").over(order)})
    out = out.withColumn("stands_out", (F.col("rank") == 1) & (F.col("_lead") >= 0.02))
    return out.where(F.col("rank") <= top).select("rank", key, "product_name", "score", "similarity", "stands_out")


def tag_rows(scores: DataFrame, applies: DataFrame, declared: DataFrame, **limits) -> DataFrame:
    """scores: query, attribute, option, similarity; applies: category, attribute; declared: query, category. Tags of the attributes that apply to the category; "n/a" for the others."""
    tagged = softmax_tags(scores.withColumn("query", F.struct("query", "attribute")), "option", **limits).select("query.*", "tag", "conf", "margin")
    rows = tagged.join(declared, "query").join(F.broadcast(applies.withColumn("_on", F.lit(True))), ["category", "attribute"], "left")
    on = F.coalesce("_on", F.lit(False))
    return rows.select("query", "category", "attribute", F.when(on, F.col("tag")).otherwise("n/a").alias("tag"), F.when(on, F.col("conf")).alias("conf"))
