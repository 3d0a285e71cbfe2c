"""The beat of ordered series: where they rise, at which interval they rise again, and from where on.

A series is a level for each of evenly spaced slots (0 where there is no row). Its onset at a slot is by how much it rises
there. The interval is the lag at which onsets most often meet later onsets, weighted towards a usual one; the phase is
where onsets lie within that interval. A series is cut into blocks of slots, and each block also gets the slot before it
and as many after it as the longest lag, so a block tells its part of every lag's sum by itself; the parts are then added.
So a series of any length, and one that holds most of the rows, is worked on by many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def levels(rows: DataFrame, key: str, slot: str, level: str) -> DataFrame:
    """key, slot, level: one row for each slot that has any, levels of a slot added. Rows without a slot are left out."""
    return rows.where(F.col(slot).isNotNull()).groupBy(F.col(key).alias("key"), F.col(slot).cast("long").alias("slot")).agg(F.sum(F.coalesce(F.col(level), F.lit(0))).cast("double").alias("level"))


def lag_sums(series: DataFrame, shortest: int, longest: int, block: int = 4096) -> DataFrame:
    """key, lag, lag_sum (the sum of onset times onset `lag` slots later) for each lag from `shortest` to `longest`. series: key, slot, level, a row a slot."""
    first, last = F.floor((F.col("slot") - longest) / block), F.floor((F.col("slot") + 1) / block)
    dealt = series.withColumn("_block", F.explode(F.sequence(first, last)))

    # a block has at most block + longest + 1 slots, and many blocks go through Python together
    held = dealt.groupBy("key", "_block").agg(F.collect_list(F.struct("slot", "level")).alias("_s"))

    def work(batches):
        lags = np.arange(shortest, longest + 1)
        for whole in batches:
            for start in range(0, len(whole), 2000):
                batch = whole.slice(start, 2000)
                found = batch.column("_s")
                size = found.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(batch)), size)
                inner = found.flatten()
                at = pc.struct_field(inner, "slot").to_numpy(zero_copy_only=False) - (batch.column("_block").to_numpy(zero_copy_only=False)[row] * block - 1)
                inside = (at >= 0) & (at < block + longest + 1)
                dense = np.zeros((len(batch), block + longest + 1))
                dense[row[inside], at[inside]] = pc.struct_field(inner, "level").to_numpy(zero_copy_only=False)[inside]
                onset = np.maximum(np.diff(dense, axis=1), 0)
                part = np.stack([np.einsum("ij,ij->i", onset[:, :block], onset[:, n : n + block]) for n in lags.tolist()], 1)
                own = pa.array(np.repeat(np.arange(len(batch)), len(lags)))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(own), pa.array(np.tile(lags, len(batch))), pa.array(part.ravel())], names=["key", "lag", "part"])

    kind = series.schema["key"].dataType.simpleString()
    parts = held.mapInArrow(work, f"key {kind}, lag long, part double")
    return parts.groupBy("key", "lag").agg(F.sum("part").alias("lag_sum"))


def onsets(series: DataFrame) -> DataFrame:
    """key, slot, onset where it is over 0. A slot meets the one before it by key and number, so no series is ordered in one task."""
    before = series.select("key", (F.col("slot") + 1).alias("slot"), F.col("level").alias("_before"))
    rise = F.col("level") - F.coalesce("_before", F.lit(0.0))
    return series.join(before, ["key", "slot"], "left").select("key", "slot", rise.alias("onset")).where("onset > 0")


def beats(series: DataFrame, shortest: int, longest: int, usual: float, width: float = 0.45, block: int = 4096) -> DataFrame:
    """key, lag, lag_sum, score, phase and phase_sum: the interval with the best score (its sum, weighted by how many doublings it is from the usual one, on a bell of `width`; the shortest of equals) and the phase within it with the most onset (the first of equals). A series that never rises twice has no row."""
    away = F.log2(F.col("lag") / F.lit(float(usual))) / F.lit(float(width))
    scored = lag_sums(series, shortest, longest, block).withColumn("score", F.bround(F.col("lag_sum") * F.exp(-0.5 * away * away), 6)).where("score > 0")
    best = scored.groupBy("key").agg(F.max_by(F.struct("lag", "lag_sum", "score"), F.struct("score", -F.col("lag"))).alias("_b")).select("key", "_b.*")
    phases = onsets(series).join(best.select("key", "lag"), "key").groupBy("key", F.pmod("slot", "lag").alias("phase")).agg(F.sum("onset").alias("phase_sum"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("phase_sum"), "phase"))
    return best.join(phases.withColumn("_p", place).where("_p = 1").drop("_p"), "key")
