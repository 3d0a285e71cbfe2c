"""Signatures, palettes and labels of images as arrays; blocks of like designs; a model's most useful features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.columns import dot, quantiles, ratio, settled, with_medians

from . import grid


def signature_distance(a: Column, b: Column, cells: int, spreads: int, weight: float = 0.5) -> Column:
    """Mean distance over the LAB cells that both have, and `weight` times the mean difference of the spreads. Signatures: 3 numbers a cell (null if missing), then the spreads."""
    numbers = F.sequence(F.lit(0), F.lit(cells - 1))
    apart = F.transform(numbers, lambda n: F.sqrt(sum((F.pow(F.get(a, n * 3 + k) - F.get(b, n * 3 + k), 2) for k in range(3)), F.lit(0.0))))
    known = F.filter(apart, lambda d: d.isNotNull() & ~F.isnan(d))
    mean = ratio(F.aggregate(known, F.lit(0.0), lambda s, d: s + d), F.size(known))
    tail = F.transform(F.sequence(F.lit(3 * cells), F.lit(3 * cells + spreads - 1)), lambda n: F.abs(F.get(a, n) - F.get(b, n)))
    tail = F.filter(tail, lambda d: d.isNotNull() & ~F.isnan(d))
    return mean + weight * F.coalesce(ratio(F.aggregate(tail, F.lit(0.0), lambda s, d: s + d), F.size(tail)), F.lit(0.0))


def _apart(a: np.ndarray, b: np.ndarray, cells: int, spreads: int, weight: float) -> np.ndarray:
    """signature_distance of each row of a and column of b (a number in each row), nan where nothing is known."""
    shape = len(a), b.shape[1]
    gappy = bool(np.isnan(a).any() or np.isnan(b).any())

    def mean_of(terms, count: int) -> np.ndarray:
        total, known = np.zeros(shape), np.zeros(shape)
        for term in terms:
            if gappy:
                there = ~np.isnan(term)
                known += there
                term = np.where(there, term, 0.0)
            total += term
        with np.errstate(all="ignore"):
            return np.where(known > 0, total / known, np.nan) if gappy else total / count if count else np.full(shape, np.nan)

    def gap(j: int) -> np.ndarray:
        return a[:, j, None] - b[j]

    def cell(n: int) -> np.ndarray:
        out = np.zeros(shape)
        for j in range(3 * n, 3 * n + 3):
            d = gap(j)
            d *= d
            out += d
        return np.sqrt(out, out=out)

    mean = mean_of((cell(n) for n in range(cells)), cells)
    tail = mean_of((np.abs(gap(j)) for j in range(3 * cells, 3 * cells + spreads)), spreads)
    return mean + weight * np.where(np.isnan(tail), 0.0, tail)


def nearest_signatures(windows: DataFrame, library: DataFrame, cells: int, spreads: int, top: int = 10, weight: float = 0.5) -> DataFrame:
    """windows: query, window, q (a stated set); library: id, signature. The nearest of each query by its best window, the first of equals."""
    width = 3 * cells + spreads

    def numbers(column) -> np.ndarray:
        found, _ = grid.matrix(column, np.nan)
        return np.pad(found, ((0, 0), (0, max(0, width - found.shape[1]))), constant_values=np.nan)[:, :width]

    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        asked = asked.sort_by([("query", "ascending"), ("window", "ascending")])
        a, b = numbers(asked["q"]), np.ascontiguousarray(numbers(rows["signature"]).T)
        names = asked["query"].combine_chunks().dictionary_encode(null_encoding="encode")
        names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
        of = names.indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        ends, found = np.append(starts[1:], len(of)), []
        most = int((ends - starts).max(initial=1))
        for tile in grid.tiles(len(starts), b.shape[1] * most):
            first, last = starts[tile][0], ends[tile][-1]
            apart = grid.rounded(_apart(a[first:last], b, cells, spreads, weight), 5)
            value = np.where(np.isnan(apart), grid.OUT, -apart)
            least = np.maximum.reduceat(value, starts[tile] - first, axis=0)
            r, c = grid.best(least, top)
            near = least[r, c]
            at = starts[tile][r]
            for _ in range(most - 1):  # on to the first window that is as near
                at = at + (value[at - first, c] < near)
            found.append((at, c, -near))
        r, c, apart = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": asked["query"].take(r), "id": rows["id"].take(c), "distance": pa.array(apart, pa.float64()), "window": asked["window"].take(r)})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    best = grid.in_blocks(windows, library.select("id", "signature"), work, f"query {kind(windows, 'query')}, id {kind(library, 'id')}, distance double, window {kind(windows, 'window')}")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return best.withColumn("_place", place).where(F.col("_place") <= top).withColumn("place", F.col("_place").cast("long")).drop("_place")


def compare_cells(a: Column, b: Column) -> Column:
    """Two pictures' cells (arrays of structs cell, code, pattern) side by side: how many both have, how many agree in colour and in pattern, the shares, and the cells one by one."""
    other = F.map_from_entries(F.transform(b, lambda y: F.struct(y["cell"], y)))
    both = F.filter(F.transform(a, lambda x: F.struct(x["cell"].alias("cell"), x.alias("a"), F.try_element_at(other, x["cell"]).alias("b"))), lambda z: z["b"].isNotNull())
    rows = F.transform(
        both,
        lambda z: F.struct(
            z["cell"].alias("cell"), z["a"]["code"].alias("code_a"), z["b"]["code"].alias("code_b"), F.coalesce(z["a"]["code"] == z["b"]["code"], F.lit(False)).alias("same_colour"),
            z["a"]["pattern"].alias("pattern_a"), z["b"]["pattern"].alias("pattern_b"), z["a"]["pattern"].eqNullSafe(z["b"]["pattern"]).alias("same_pattern"),
        ),
    )
    n, colour, pattern = F.size(rows), F.size(F.filter(rows, lambda r: r["same_colour"])), F.size(F.filter(rows, lambda r: r["same_pattern"]))
    share = lambda k: F.bround(F.coalesce(F.try_divide(k, n), F.lit(0.0)), 3)
    return F.struct(n.alias("n_cells"), colour.alias("n_colour"), pattern.alias("n_pattern"), share(colour).alias("colour_share"), share(pattern).alias("pattern_share"), rows.alias("cells"))


def _entries(column: pa.ChunkedArray) -> tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]:
    """Of arrays of structs: the structs, the row and the place of each, and each array's length, -1 for null."""
    arrays = column.combine_chunks()
    arrays = pa.concat_arrays(arrays.chunks) if isinstance(arrays, pa.ChunkedArray) else arrays
    length = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    return arrays.flatten(), row, place, np.where(arrays.is_null().to_numpy(zero_copy_only=False), -1, length)


def compared_cells(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query, id and compare_cells' counts and shares of every query (query, q) and every row (id, cells) but itself. No cell comes twice in a picture."""

    def number(one: pa.Array, two: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        both = pa.concat_arrays([one, two]).dictionary_encode(null_encoding="mask")
        codes = both.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        return codes[: len(one)], codes[len(one) :], len(both.dictionary)

    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        (a, ra, pa_, na), (b, rb, _, nb) = _entries(asked["q"]), _entries(rows["cells"])
        cell, other, n_cells = number(pc.struct_field(a, "cell"), pc.struct_field(b, "cell"))
        named = other >= 0
        if len(np.unique(rb[named] * max(n_cells, 1) + other[named])) < named.sum():
            raise ValueError("a picture has a cell twice")
        held = {}
        for c in ("code", "pattern"):
            one, two, _ = number(pc.struct_field(a, c), pc.struct_field(b, c))
            mine = np.full((len(na), int(na.max(initial=0))), -9, np.int32)
            mine[ra, pa_] = one
            theirs = np.full((n_cells + 1, len(nb)), -8, np.int32)  # the last row is for no cell
            theirs[other[named], rb[named]] = two[named]
            held[c] = mine, theirs
        which = np.full((len(na), int(na.max(initial=0))), n_cells)
        which[ra, pa_] = np.where(cell >= 0, cell, n_cells)
        found = []
        for tile in grid.tiles(len(na), len(nb)):
            n, colour, pattern = (np.zeros((tile.stop - tile.start, len(nb)), np.int16) for _ in range(3))
            for i in range(which.shape[1]):
                at = which[tile, i]
                one, two = held["code"][0][tile, i, None], held["code"][1][at]
                there = two != -8
                n += there
                colour += (one == two) & (two >= 0)
                pattern += (held["pattern"][0][tile, i, None] == held["pattern"][1][at]) & there
            r, c = np.nonzero(grid.differ(asked, rows, tile))
            found.append((tile.start + r, c, *(x[r, c].astype(np.int64) for x in (n, colour, pattern))))
        r, c, n, colour, pattern = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
        most = int(n.max(initial=0)) + 1
        with np.errstate(all="ignore"):
            shares = grid.rounded(np.nan_to_num(np.arange(most) / np.arange(most)[:, None], posinf=0.0), 3)  # of each n and each count
        none = na[r] < 0
        counts = {x: pa.array(v, pa.int64(), mask=none) for x, v in (("n_cells", n), ("n_colour", colour), ("n_pattern", pattern))}
        return pa.table({"query": asked["query"].take(r), "id": rows["id"].take(c), **counts, "colour_share": shares[n, colour], "pattern_share": shares[n, pattern]})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return grid.in_blocks(queries, rows, work, f"query {kind(queries, 'query')}, id {kind(rows, 'id')}, n_cells long, n_colour long, n_pattern long, colour_share double, pattern_share double", most_queries=500, most_rows=2000)


def dominant(ranked: DataFrame, times: float = 4.0, least: float = 25.0) -> DataFrame:
    """Whether the best count of each query is `times` the next one's and at least `least`. ranked: query, id, count."""
    order = Window.partitionBy("query").orderBy(F.desc("count"), "id")
    rows = ranked.withColumn("_p", F.row_number().over(order)).withColumn("_next", F.lead("count").over(order)).where("_p = 1")
    return rows.select("query", "id", "count", ((F.col("count") >= least) & (F.col("count") >= times * F.coalesce("_next", F.lit(0)))).alias("dominant"))


def palette_distance(a: Column, b: Column) -> Column:
    """Mean distance of the colours of a (structs L, a, b, w), by weight, to the nearest one of b."""
    near = lambda x: F.array_min(F.transform(b, lambda y: F.sqrt(F.pow(x["L"] - y["L"], 2) + F.pow(x["a"] - y["a"], 2) + F.pow(x["b"] - y["b"], 2))))
    return ratio(F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"] * near(x)), F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"]))


def palette_distances(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query, id and palette_distance, to six places, of every query (query, q) and every row (id, p) but itself."""

    def parts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """L, a, b and w of each place of each palette, what is null there, and the palettes' lengths (-1: null)."""
        found, row, place, n = _entries(column)
        numbers, null = np.full((4, len(n), int(n.max(initial=0))), np.nan), np.ones((4, len(n), int(n.max(initial=0))), bool)
        for k, c in enumerate(("L", "a", "b", "w")):
            own = pc.struct_field(found, c)
            numbers[k, row, place] = own.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            null[k, row, place] = own.is_null().to_numpy(zero_copy_only=False)
        return numbers, null, n

    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        (a, a_null, na), (b, b_null, nb) = parts(asked["q"]), parts(rows["p"])
        b = np.ascontiguousarray(np.swapaxes(b, 1, 2))
        unplaced = b_null[:3].any(0).T  # places of b that have no distance
        empty = unplaced.all(0) | (nb < 0) if len(unplaced) else np.ones(len(nb), bool)
        gappy, found = bool(unplaced.any()), []
        for tile in grid.tiles(len(na), len(nb)):
            shape = tile.stop - tile.start, len(nb)
            total, weight, null = np.zeros(shape), np.zeros((shape[0], 1)), np.repeat(na[tile, None] < 0, shape[1], axis=1)
            for i in range(a.shape[2]):
                near, there = np.full(shape, np.nan), i < na[tile, None]
                for j in range(len(unplaced)):
                    d = np.zeros(shape)
                    for k in range(3):
                        gap = a[k, tile, i, None] - b[k, j]
                        gap *= gap
                        d = gap if k == 0 else d + gap
                    np.sqrt(d, out=d)
                    if gappy:
                        d[:, unplaced[j]] = np.nan
                    near = d if j == 0 else np.fmin(near, d)
                w = a[3, tile, i, None]
                total = np.where(there, total + w * near, total)
                weight = np.where(there, weight + w, weight)
                null |= there & (a_null[:, tile, i].any(0)[:, None] | empty)
            null |= weight == 0
            with np.errstate(all="ignore"):
                value = grid.rounded(total / weight, 6)
            r, c = np.nonzero(grid.differ(asked, rows, tile))
            found.append((tile.start + r, c, value[r, c], null[r, c]))
        r, c, value, null = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        return pa.table({"query": asked["query"].take(r), "id": rows["id"].take(c), "distance": pa.array(value, pa.float64(), mask=null)})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return grid.in_blocks(queries, rows, work, f"query {kind(queries, 'query')}, id {kind(rows, 'id')}, distance double", most_queries=500, most_rows=2000)


def colour_accuracy(measured: DataFrame) -> DataFrame:
    """measured: style, declared, matched, delta_e. Exact and family (first digit) accuracy, and how far off."""
    measured = settled(measured)
    off = quantiles(measured, [], "delta_e", [0.5, 0.9]).select(F.bround(F.col("_edges")[0], 6).alias("median_delta_e"), F.bround(F.col("_edges")[1], 6).alias("p90_delta_e"))
    found = measured.agg(
        F.count("*").alias("n"),
        F.bround(F.avg((F.col("declared") == F.col("matched")).cast("double")), 6).alias("exact"),
        F.bround(F.avg((F.substring("declared", 1, 1) == F.substring("matched", 1, 1)).cast("double")), 6).alias("family"),
        F.countDistinct("declared", "matched").alias("n_pairs"),
    )
    return found.join(F.broadcast(off), F.lit(True), "left")  # one row beside one row


def per_code(measured: DataFrame, least: int = 8) -> DataFrame:
    """Each declared code: median over styles of the styles' medians, accuracy, and whether it can be calibrated."""
    styles = measured.groupBy("style", "declared").agg(F.avg((F.col("declared") == F.col("matched")).cast("double")).alias("_a"))
    styles = with_medians(styles, measured, ["style", "declared"], {"_d": "delta_e"})
    codes = styles.groupBy("declared").agg(F.count("*").alias("n_styles"), F.bround(F.avg("_a"), 6).alias("accuracy"), (F.count("*") >= least).alias("calibratable"))
    return with_medians(codes, styles, ["declared"], {"delta_e": "_d"}).withColumn("delta_e", F.bround("delta_e", 6))


def attribute_coverage(tags: DataFrame, attributes: list[str]) -> DataFrame:
    """tags: <attribute> and <attribute>__conf. For each attribute: rows it applies to, share that is uncertain, mean confidence, distinct values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value"), F.col(f"{a}__conf").alias("conf")) for a in attributes]))
    long = tags.select(pairs.alias("p")).select("p.*").where("value is not null and value <> 'n/a'")
    certain = F.when(F.col("value") != "uncertain", F.col("value"))
    return long.groupBy("attribute").agg(F.count("*").alias("n"), F.bround(F.avg((F.col("value") == "uncertain").cast("double")), 6).alias("uncertain"), F.bround(F.avg("conf"), 6).alias("mean_conf"), F.countDistinct(certain).alias("n_values"))


def label_agreement(rows: DataFrame, stated: str, measured: str, least: int = 20, good: float = 0.70, margin: float = 0.10) -> DataFrame:
    """Accuracy of a measured label against what the name states, the accuracy of always saying the commonest, and whether to trust it."""
    known = rows.where(F.col(stated).isNotNull() & F.col(measured).isNotNull())
    cells = known.groupBy(F.col(stated).alias("_s")).agg(F.count("*").alias("_n"), F.count_if(F.col(stated) == F.col(measured)).alias("_hit"))
    out = cells.agg(F.sum("_n").alias("n"), F.bround(F.sum("_hit") / F.sum("_n"), 6).alias("accuracy"), F.bround(F.max("_n") / F.sum("_n"), 6).alias("baseline"))
    return out.withColumn("trusted", (F.col("n") >= least) & (F.col("accuracy") >= good) & (F.col("accuracy") >= F.col("baseline") + margin))


def measured_lift(measured: DataFrame, master: DataFrame, attribute: str, stated: str, part: list[str], metric: str = "sell_through_rate", least: int = 6, **gate) -> DataFrame:
    """Sales by a measured attribute (measured: sku, attribute), where the measure agrees with what names state (a column of master): mean of (metric - the part's baseline) in points of each value.

    Where it agrees too seldom no lift is told, only counts."""
    rows = master.join(measured.select("sku", attribute), "sku").where(F.col(metric).isNotNull())
    trust = label_agreement(rows, stated, attribute, **gate).select("trusted", F.col("accuracy").alias("agreement"))
    base = master.where(F.col(metric).isNotNull()).groupBy(*part).agg(F.avg(metric).alias("_base"))
    known = rows.where(F.col(attribute).isNotNull()).join(base, part)
    out = known.groupBy(F.col(attribute).alias("value")).agg(F.count("*").alias("n"), F.avg(F.col(metric) - F.col("_base")).alias("_lift"), F.avg(metric).alias("_mean")).where(F.col("n") >= least)
    out = out.join(F.broadcast(trust))  # one row
    told = lambda c, places: F.when(F.col("trusted"), F.bround(c, places))
    return out.select("value", "n", "agreement", "trusted", told(F.col("_lift") * 100, 5).alias("lift_points"), told(F.col("_mean"), 6).alias("mean_rate"))


def blocks(vectors: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """id, block, distance to its centre, and whether it is the block's representative. k: a fifteenth of the rows, from 4 to 40."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=k or int(min(40, max(4, rows.count() // 15))), seed=seed, initSteps=2).fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])  # at most 40
    own = F.get(centres, F.col("block"))
    gap = F.zip_with(vector_to_array("features"), own, lambda x, y: x - y)
    out = model.transform(rows).withColumnRenamed("prediction", "block").withColumn("distance", F.sqrt(dot(gap, gap)))
    nearest = out.groupBy("block").agg(F.min_by("id", F.struct("distance", "id")).alias("_rep"))
    return out.join(F.broadcast(nearest), "block").select("id", "label", F.col("block").cast("long").alias("block"), F.bround("distance", 6).alias("distance"), (F.col("id") == F.col("_rep")).alias("is_representative"))


def block_summary(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy("block").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set("label")), lambda x: x.cast("string")), " ").alias("labels"), F.min(F.when(F.col("is_representative"), F.col("id"))).alias("representative"), F.bround(F.avg("distance"), 5).alias("mean_distance"))


def feature_importance(graded: DataFrame, features: list[str], seed: int = 42, repeats: int = 12, group: int = 10_000) -> DataFrame:
    """How useful each feature is to a boosted model of success: accuracy on held-out rows, and by how much it drops, on average and in spread, over `repeats` permutations of the feature among them.

    All permutations are scored in one pass over a long table (repeat, feature, row). A permutation deals the rows to groups
    of about `group` by a hash of its own and moves each group's values on by one in the order of another hash, the last
    to the first, so no task orders all rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = graded.where(F.col("perf_band") != "EXCLUDED").select((F.col("perf_band").isin("STAR", "CORE")).cast("double").alias("label"), "sku", "season", *[F.coalesce(F.col(f).cast("string"), F.lit("?")).alias(f) for f in features])
    rows = settled(rows)  # the indexes, the bins, the trees and the held-out rows are passes over these few columns, not over what they come from
    held = F.pmod(F.xxhash64("sku", "season", F.lit(seed)), F.lit(4)) == 0
    indexed = [f"{f}_i" for f in features]
    stages = [StringIndexer(inputCols=features, outputCols=indexed, handleInvalid="keep"), VectorAssembler(inputCols=indexed, outputCol="features"), GBTClassifier(maxIter=10, maxDepth=3, maxBins=512, seed=seed)]
    model = Pipeline(stages=stages).fit(rows.where(~held))
    tested = rows.where(held)
    groups = max(1, -(-tested.count() // group))
    again = tested.withColumn("_repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    again = again.withColumn("_group", F.pmod(F.xxhash64("sku", "season", "_repeat", F.lit(seed)), F.lit(groups)))
    own = Window.partitionBy("_repeat", "_group")
    order = own.orderBy(F.xxhash64("_repeat", "season", "sku", F.lit(seed + 1)), "sku", "season")
    values = F.struct(*features)
    moved = F.coalesce(F.lag(values).over(order), F.last(values).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    again = again.withColumn("_moved", moved)
    changed = [F.struct(F.lit(f).alias("feature"), *[(F.col(f"_moved.{g}") if g == f else F.col(g)).alias(g) for g in features]) for f in features]
    long = again.select("label", "_repeat", F.explode(F.array(*changed)).alias("_c")).select("label", "_repeat", F.col("_c.feature").alias("feature"), *[F.col(f"_c.{g}").alias(g) for g in features])
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    base = model.transform(tested).agg(right).first()[0]  # one number
    drops = model.transform(long).groupBy("feature", "_repeat").agg((F.lit(base) - right).alias("drop"))
    out = drops.groupBy("feature").agg(F.lit(base).alias("accuracy"), F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("spread"), F.count("*").alias("repeats"))
    return out.orderBy(F.desc("importance"), "feature")


def stratified_bootstrap(df: DataFrame, mask: Column, strata: list[str], metric: str = "sell_through_rate", least_cell: int = 6, draws: int = 2000, seed: int = 20260901) -> DataFrame:
    """Pooled lift of the marked rows over the others of their stratum, in points, with a percentile interval and the share of draws of the other sign.

    A stratum enters as counts of its distinct values (to 4 places) on both sides; resampling draws multinomial counts."""
    rows = df.where(F.col(metric).isNotNull()).withColumns({"_in": F.coalesce(mask, F.lit(False)), "_v": F.bround(metric, 4), "_s": F.concat_ws("|", *strata)})
    sizes = rows.groupBy("_s").agg(F.count_if("_in").alias("_a"), F.count_if(~F.col("_in")).alias("_b")).where((F.col("_a") >= least_cell) & (F.col("_b") >= least_cell))
    counted = rows.join(sizes.select("_s"), "_s", "left_semi").groupBy("_s", "_in", "_v").agg(F.count("*").alias("n"))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["_s"].iloc[0]
        random = np.random.default_rng([seed, *name.encode()])
        sides = []
        for side in (True, False):
            own = frame[frame["_in"] == side].sort_values("_v")
            n, v = own["n"].to_numpy(np.int64), own["_v"].to_numpy()
            sides.append((int(n.sum()), n @ v / n.sum(), np.array([random.multinomial(int(n.sum()), n / n.sum()) @ v for _ in range(draws)]) / n.sum()))
        (n, mean, means), (_, other, others) = sides
        return pd.DataFrame({"draw": np.arange(-1, draws), "n": n, "y": np.append(mean - other, means - others) * n})

    drawn = counted.groupBy("_s").applyInPandas(draw, "draw long, n long, y double")
    pooled = drawn.groupBy("draw").agg(F.sum("n").alias("n"), F.count("*").alias("n_strata"), (F.sum("y") / F.sum("n") * 100).alias("e"))
    point = F.max(F.when(F.col("draw") == -1, F.col("e")))
    resampled = F.when(F.col("draw") >= 0, F.col("e"))
    out = pooled.agg(F.max("n").alias("n"), F.max("n_strata").alias("n_strata"), point.alias("lift_points"), F.percentile(resampled, F.lit(0.025)).alias("low"), F.percentile(resampled, F.lit(0.975)).alias("high"), F.avg((resampled < 0).cast("double")).alias("_neg"))
    return out.withColumn("flipped", F.when(F.col("lift_points") >= 0, F.col("_neg")).otherwise(1 - F.col("_neg"))).drop("_neg")
