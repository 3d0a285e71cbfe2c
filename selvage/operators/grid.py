"""A stated set of queries against all rows, in a grid of blocks.

Queries and rows are dealt to blocks by a hash, and each block of queries meets each block of rows once, in a task of its
own choosing. A block has a bounded number of rows, so a task's memory doesn't grow with the tables, nothing goes through
the driver, and small tables of much work are still spread over all cores. Within a cell of the grid numpy does the
arithmetic of all pairs, in the order of Spark's own expressions, and gives what is asked of them (the best of each query,
or every pair); what cells give is merged by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In an order of values, the place of a missing one (after all others), of a pair that isn't admitted, and of NaN (before all others).
MISSING, OUT, FIRST = -1e300, -np.inf, np.inf


def in_blocks(queries: DataFrame, rows: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, most_queries: int = 2000, most_rows: int = 16_000, by: str = "query") -> DataFrame:
    """work(block of queries, block of rows) over the grid. All queries of one `by` are in the same block; rows have an id.

    most_queries, most_rows: what a block has, about; blocks of rows are smaller while there are fewer than four for each core."""
    n, m = queries.count(), rows.count()
    across = max(1, -(-n // most_queries))
    down = max(1, -(-m // most_rows), min(-(-m // 1000), 4 * rows.sparkSession.sparkContext.defaultParallelism // across))
    part = lambda among, *columns: F.pmod(F.xxhash64(*columns), F.lit(among))
    every = lambda among: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(among - 1).cast("long")))
    asked = queries.withColumn("_across", part(across, by)).withColumn("_down", every(down))
    held = rows.withColumn("_down", part(down, *rows.columns)).withColumn("_across", every(across))
    cell = (F.col("_down") * across + F.col("_across")).alias("_cell")
    asked, held = (df.select("*", cell).drop("_across", "_down").repartition(across * down, "_cell") for df in (asked, held))

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.drop_columns(["_cell"])
        return work(one.drop_columns(["_cell"]), two.take(pc.sort_indices(two, [("id", "ascending")], null_placement="at_start")))

    return asked.groupBy("_cell").cogroup(held.groupBy("_cell")).applyInArrow(meet, schema)


def tiles(n: int, m: int, pairs: int = 1 << 16) -> Iterator[slice]:
    """n queries in runs that make about `pairs` pairs with m rows."""
    step = max(1, pairs // max(m, 1))
    return (slice(at, min(n, at + step)) for at in range(0, n, step))


def matrix(column: pa.ChunkedArray, empty: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of numbers as the rows of one matrix, with `empty` for what isn't there; and each array's length, -1 if it or one of its numbers is null."""
    arrays = column.combine_chunks()
    arrays = pa.concat_arrays(arrays.chunks) if isinstance(arrays, pa.ChunkedArray) else arrays
    length = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = arrays.flatten()
    out = np.full((len(arrays), int(length.max(initial=0))), empty)
    out[np.arange(out.shape[1]) < length[:, None]] = flat.cast(pa.float64()).fill_null(empty).to_numpy(zero_copy_only=False)
    kind = length.copy()
    kind[np.repeat(np.arange(len(length)), length)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    kind[arrays.is_null().to_numpy(zero_copy_only=False)] = -1
    return out, kind


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """x as Spark's bround gives it: its shortest decimal form rounded half even."""
    y = x * 10.0**places
    with np.errstate(invalid="ignore"):
        whole = np.abs(y) < 2.0**52
        out = np.where(whole, np.rint(y) / 10.0**places, x)
        doubtful = whole & (np.abs(y - np.floor(y) - 0.5) <= 1e-9 + np.abs(y) * 1e-15)
    if doubtful.any():
        values, at = np.unique(x[doubtful], return_inverse=True)
        exact = [float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN)) for v in values.tolist()]
        out[doubtful] = np.array(exact)[at.ravel()]
    return out


def differ(queries: pa.Table, rows: pa.Table, tile: slice) -> np.ndarray:
    """Which rows aren't the query itself; those without id are none's."""
    ids = rows["id"].to_numpy()
    own = queries["query"].to_numpy()[tile]
    return (own[:, None] != ids) & ~rows["id"].is_null().to_numpy()


def best(value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row of values, the first column of equals; none that is OUT."""
    n, m = value.shape
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if m > k:
        at_least = value >= np.partition(value, m - k, axis=1)[:, m - k, None]
        r, c = np.nonzero(at_least & (value > OUT))
    else:
        r, c = np.nonzero(value > OUT)
    order = np.lexsort((c, -value[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r, side="left")
    keep = np.arange(len(r)) - first < k
    return r[keep], c[keep]


def told(value: np.ndarray) -> pa.Array:
    """Places in an order as the values they stand for."""
    return pa.array(np.where(value == FIRST, np.nan, value), pa.float64(), mask=value == MISSING)
