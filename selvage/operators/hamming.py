"""Exact nearest binary codes by multi-index hashing.

A code is a row of 64-bit words. It is cut into chunks of `bits` bits; codes that differ in at most r bits differ in some
chunk in at most r / chunks of them. So the index has a row for each chunk of each distinct code, and a search looks up
each chunk of its code with 0, then 1, then 2 ... bits turned. After the ring of t turned bits every code within
(t + 1) * chunks - 1 bits has been met; a query is done when it has its k neighbours within that radius, and the others go
on. A pair is taken at the chunk with the fewest turned bits, the first of equals, so none comes twice and nothing needs to
be made distinct. With all bits of a chunk turned every code has been met, so the result is exact for any data.

Equal codes are one row of the index with their smallest id and their number: a hundred million copies cost one.

An index pays where it is kept, is asked by few and has neighbours that are near. For a stated set of queries that grows
with the rows, what rings meet grows with the square of the rows and is joined row by row; without a kept index the
distances are counted in a grid of blocks instead, which is exact as well.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from selvage.functions.columns import settled

from . import grid

INDEX_VERSION = 1


def sign_code(vector: Column, words: int) -> Column:
    """A bit for each component, set if it is positive, in `words` words of 64 bits; a missing one is unset."""
    bit = lambda w: lambda s, n: s.bitwiseOR(F.call_function("shiftleft", F.when(F.get(vector, n + 64 * w) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")), n))
    numbers = F.sequence(F.lit(0), F.lit(63))
    return F.when(vector.isNotNull(), F.array(*[F.aggregate(numbers, F.lit(0).cast("long"), bit(w)) for w in range(words)]))


def chunks(code: Column, words: int, bits: int) -> Column:
    """The code's chunks of `bits` bits, a divisor of 64, as longs."""
    mask = F.lit((1 << bits) - 1).cast("long")
    return F.array(*[F.shiftrightunsigned(F.get(code, F.lit(w)), at).bitwiseAND(mask) for w in range(words) for at in range(0, 64, bits)])


def turned(a: Column, b: Column, words: int, bits: int) -> Column:
    """In how many bits each chunk differs."""
    return F.zip_with(chunks(a, words, bits), chunks(b, words, bits), lambda x, y: F.bit_count(x.bitwiseXOR(y)))


def hamming(a: Column, b: Column, words: int) -> Column:
    """In how many bits two codes differ."""
    return reduce(lambda s, x: s + x, [F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))) for w in range(words)])


def index_of(rows: DataFrame, words: int, bits: int = 8) -> DataFrame:
    """chunk, value, code, first_id and n of the distinct codes. rows: id, code (array<long>); null codes are left out."""
    distinct = rows.where("code is not null").groupBy("code").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return distinct.select(F.posexplode(chunks(F.col("code"), words, bits)).alias("chunk", "value"), "code", "first_id", "n")


def write_index(index: DataFrame, folder: str, words: int, bits: int, buckets: int = 64) -> None:
    """The index as Parquet: a folder for each chunk, and within it files by range of values, sorted, so that a lookup reads the row groups that may hold it. The version and the form of the codes are columns."""
    placed = index.withColumns({"_version": F.lit(INDEX_VERSION), "_words": F.lit(words), "_bits": F.lit(bits)})
    placed.repartitionByRange(buckets, "chunk", "value").sortWithinPartitions("chunk", "value").write.partitionBy("chunk").mode("overwrite").parquet(folder)


def load_index(spark: SparkSession, folder: str, words: int, bits: int) -> DataFrame:
    """An index that this version made for codes of this form; else an error that tells what it is."""
    rows = spark.read.parquet(folder)
    made = {tuple(r) for r in rows.select("_version", "_words", "_bits").distinct().limit(2).collect()}
    if made and made != {(INDEX_VERSION, words, bits)}:
        raise ValueError(f"the index has (version, words, bits) {sorted(made)}, not {(INDEX_VERSION, words, bits)}: make it anew")
    return rows.drop("_version", "_words", "_bits")


def _scanned(queries: DataFrame, rows: DataFrame, k: int, words: int) -> DataFrame:
    """nearest_codes by counting all distances, block by block."""

    def numbers(column) -> np.ndarray:
        arrays = column.combine_chunks()
        arrays = pa.concat_arrays(arrays.chunks) if isinstance(arrays, pa.ChunkedArray) else arrays
        return arrays.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, words)

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        a, b = numbers(asked["code"]), np.ascontiguousarray(numbers(held["code"]).T)
        found = []
        for tile in grid.tiles(len(a), b.shape[1]):
            apart = sum(np.bitwise_count(a[tile, w, None] ^ b[w]).astype(np.float32) for w in range(words))
            r, c = grid.best(np.where(grid.differ(asked, held, tile), -apart, np.float32(grid.OUT)), k)
            found.append((tile.start + r, c, apart[r, c].astype(np.int64)))
        r, c, apart = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"query": asked["query"].take(r), "id": held["id"].take(c), "distance": apart})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    whole = lambda df, c: df.where(F.size("code") >= words).select(c, F.slice("code", 1, words).alias("code"))
    queries, rows = whole(queries, "query"), whole(rows, "id")
    near = grid.in_blocks(queries, rows, work, f"query {kind(queries, 'query')}, id {kind(rows, 'id')}, distance long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def nearest_codes(queries: DataFrame, rows: DataFrame, k: int, words: int, bits: int = 8, index: DataFrame | None = None) -> DataFrame:
    """query, id, distance, rank: the k nearest rows of each query but itself, the smaller id first of equally near ones.

    queries: query, code (a stated set); rows: id, code; index: what index_of gives for rows, if it is kept; without it all
    rows are scanned. Fewer than k rows give as many. Each ring's candidates are cut to the k + 1 nearest codes of a query before the next."""
    if bits not in (1, 2, 4, 8, 16):
        raise ValueError("chunks have 1, 2, 4, 8 or 16 bits")
    if index is None:
        return _scanned(queries, rows, k, words)
    n_chunks = 64 * words // bits
    open_ = queries.where("code is not null").select("query", F.col("code").alias("_q"))
    best = Window.partitionBy("query").orderBy("distance", "first_id")
    found, done = None, None
    for ring in range(bits + 1):
        masks = F.array(*[F.lit(m).cast("long") for m in range(1 << bits) if m.bit_count() == ring])
        probes = open_.select("query", "_q", F.posexplode(chunks(F.col("_q"), words, bits)).alias("chunk", "_v"))
        probes = probes.select("query", "_q", "chunk", F.explode(F.transform(masks, lambda m: F.col("_v").bitwiseXOR(m))).alias("value"))
        met = probes.join(index, ["chunk", "value"]).withColumn("_t", turned(F.col("_q"), F.col("code"), words, bits))
        first = (F.array_min("_t") == ring) & (F.array_position("_t", F.lit(ring)) == F.col("chunk") + 1)
        new = met.where(first).select("query", "_q", "code", "first_id", "n", hamming(F.col("_q"), F.col("code"), words).alias("distance"))
        both = found.unionByName(new) if found is not None else new
        both = settled(both.withColumn("_p", F.row_number().over(best)).where(F.col("_p") <= k + 1).drop("_p"))
        sure = both.where(F.col("distance") <= (ring + 1) * n_chunks - 1).groupBy("query").agg(F.sum("n").alias("_n"))
        over = sure.where(F.col("_n") >= k + 1).select("query")  # with the query itself
        if ring == bits:
            done = both if done is None else done.unionByName(both)
            break
        ready = both.join(over, "query", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        found, open_ = both.join(over, "query", "left_anti"), settled(open_.join(over, "query", "left_anti"))
        if open_.isEmpty():
            break
    own = Window.partitionBy("code").orderBy("id")
    members = rows.where("code is not null").withColumn("_p", F.row_number().over(own)).where(F.col("_p") <= k + 1).select("id", "code")
    pairs = done.select("query", "code", "distance").join(members, "code").where(F.col("id") != F.col("query"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return pairs.select("query", "id", F.col("distance").cast("long").alias("distance"), rank.cast("long").alias("rank")).where(F.col("rank") <= k)
