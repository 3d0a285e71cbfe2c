"""Clustering of vectors around integer centroids, by tournaments of bisectors.

Vectors become integers, floor(scale * component), so that every sum, distance and comparison is exact and no order of
rows changes a result. Between two centroids i < j lies the hyperplane of points as near to one as to the other: with the
normal 2 (c_j - c_i) and the threshold |c_j|^2 - |c_i|^2, a vector x is nearer to j where normal . x - threshold > 0, and a
zero is a tie, which the smaller number wins. Normals and thresholds of all pairs are computed once a round. Each vector
then plays k - 1 games: its best centroid so far meets the next one, and the sign of one linear form tells who goes on.
Only the winner's distance is computed, at the end.

A task adds up the vectors of each centroid and hands on one row for each centroid and component; Spark adds those, and
the driver takes k times d sums a round, however many vectors there are. The integer vectors are written once to the
shared folder, so a lost executor repeats only its part of the round it was in.

Defined cases: a vector that is null, of another length, or has a null or a non-finite component is left out. Repeated
rows count each; of equal ids the smaller vector comes first among the initial centroids; a null id is hashed as an
empty one. Fewer vectors than k give as many centroids; no vectors give no rows. Numbers are 64 bits wide where that is
exact and Python's own where it isn't; a component beyond a long is held at its bound, and a distance or a sum of
distances beyond a long is null. Columns other than the id and the vector pass through aside of the output's names.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, written

_LONG = 1 << 63


def integers(vector: Column, dims: int, scale: int) -> Column:
    """The components as array<long>, or null for what isn't a vector of `dims` finite numbers."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    bound = float(_LONG - 1024)
    return F.when((F.size(x) == dims) & finite, F.transform(x, lambda v: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), v * F.lit(float(scale)))))))


def _kind(bound: int):
    """The numbers in which values up to `bound` are exact: doubles, which multiply fastest, longs, or Python's own."""
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def _most(x: np.ndarray) -> int:
    return max((-int(x.min()), int(x.max()))) if x.size else 0


class Bisectors:
    """Normals and thresholds of all pairs of some integer centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, object)
        k = len(centroids)
        squares = [int(sum(v * v for v in c)) for c in centroids]
        self.normals = {(i, j): 2 * (self.centroids[j] - self.centroids[i]) for i in range(k) for j in range(i + 1, k)}
        self.thresholds = {(i, j): squares[j] - squares[i] for i, j in self.normals}
        self.most_normal = max((_most(n) for n in self.normals.values()), default=0)
        self.most_threshold = max((abs(t) for t in self.thresholds.values()), default=0)

    def winners(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row of x (longs); of equally near ones the smallest."""
        best = np.zeros(len(x), np.int64)
        kind = _kind(x.shape[1] * self.most_normal * _most(x) + self.most_threshold) if len(x) else object
        rows = x.astype(kind)
        for j in range(1, len(self.centroids)):
            for i in np.unique(best).tolist():  # those that are still best of someone
                own = np.flatnonzero(best == i)
                sign = rows[own] @ self.normals[i, j].astype(kind) - kind(self.thresholds[i, j]) if kind is not object else rows[own] @ self.normals[i, j] - self.thresholds[i, j]
                best[own[sign > 0]] = j
        return best

    def distances(self, x: np.ndarray, to: np.ndarray) -> list[int]:
        """Exact squared distances of the rows of x to the centroids `to`."""
        span = _most(x) + _most(self.centroids)
        kind = np.int64 if x.shape[1] * span * span < 1 << 62 else object
        gap = x.astype(kind) - self.centroids[to].astype(kind)
        return [int(v) for v in (gap * gap).sum(1)]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(vectors: DataFrame, bisectors: Bisectors, dims: int) -> dict[int, tuple[int, list[int]]]:
    """How many vectors each centroid has, and their sum."""

    def work(batches):
        counts, totals = [0] * len(bisectors.centroids), {}
        for batch in batches:
            x = _matrix(batch.column("_v"), dims)
            if not len(x):
                continue
            best = bisectors.winners(x)
            kind = np.int64 if len(x) * _most(x) < 1 << 62 else object
            for c in np.unique(best).tolist():
                own = x[best == c].astype(kind)
                counts[c] += len(own)
                totals[c] = [a + int(b) for a, b in zip(totals.get(c, [0] * dims), own.sum(0))]
        for c, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([counts[c]] * dims, pa.int64()), pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))],
                names=["cluster", "pos", "n", "total"],
            )

    parts = vectors.select("_v").mapInArrow(work, "cluster int, pos int, n long, total decimal(38,0)")
    found = parts.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # k times d rows
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found:
        out.setdefault(r["cluster"], (r["n"], [0] * dims))[1][r["pos"]] = int(r["total"])
    return out


def cluster_vectors(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding", seed: str = "3:") -> DataFrame:
    """df's rows with a proper vector, and cluster, distance, cluster_inertia, inertia and centroid (array<long>).

    The initial centroids are the k vectors with the smallest sha256 of seed and id. Each of `rounds` rounds assigns all
    vectors and moves every centroid that has any to the floor of their mean; then they are assigned once more."""
    names = ("cluster", "distance", "cluster_inertia", "inertia", "centroid")
    kept = [c for c in df.columns if c not in names]
    aside = [F.col(f"`{c}`").alias(f"_u{n}_") for n, c in enumerate(kept)]
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    vectors = written(df.select(*aside, hashed.alias("_h"), integers(F.col(f"`{vector}`"), dims, scale).alias("_v")).where("_v is not null"), "vectors")
    centroids = [list(r["_v"]) for r in vectors.orderBy("_h", "_v").select("_v").limit(k).collect()]
    for _ in range(rounds):
        found = _sums(vectors, Bisectors(centroids), dims) if centroids else {}
        centroids = [[v // found[c][0] for v in found[c][1]] if c in found else old for c, old in enumerate(centroids)]
    bisectors = Bisectors(centroids)

    def work(batches):
        for batch in batches:
            x = _matrix(batch.column("_v"), dims)
            best = bisectors.winners(x) if len(x) else np.zeros(0, np.int64)
            far = bisectors.distances(x, best) if len(x) else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.int32()), pa.array([Decimal(v) for v in far], pa.decimal128(38, 0))], names=[*batch.schema.names[:-1], "cluster", "_far"])

    rows = vectors.drop("_h")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    assigned = written(rows.mapInArrow(work, f"{schema}, cluster int, _far decimal(38,0)"), "assigned")
    discard(vectors)
    sums = {r["cluster"]: int(r["far"]) for r in assigned.groupBy("cluster").agg(F.sum("_far").alias("far")).collect()}  # k rows
    whole = sum(sums.values())
    told = [(c, Decimal(s), Decimal(whole), [int(v) for v in centroids[c]]) for c, s in sums.items()]
    of_cluster = df.sparkSession.createDataFrame(told, "cluster int, _own decimal(38,0), _all decimal(38,0), centroid array<long>")
    joined = assigned.join(F.broadcast(of_cluster), "cluster")  # k rows
    long = lambda c: F.col(c).try_cast("long")
    return joined.select(*[F.col(f"_u{n}_").alias(c) for n, c in enumerate(kept)], "cluster", long("_far").alias("distance"), long("_own").alias("cluster_inertia"), long("_all").alias("inertia"), "centroid")
