"""Lines that many documents share, found with levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by hash, with the number of documents that hold the line and the
largest document that does. Batches come in descending order of document id. Each new batch merge-anti-joins the runs:
hashes that no run has are new, and this batch has their holder; of the others only the count goes up. Then the batch's
own run is added; when a level has `fanout` runs, they are compacted to one run of the next level.

Runs in a folder of the caller's outlive the session: the next call opens them, meets its lines with those of all earlier
batches, and adds its own. A manifest, written last, tells which runs and batches are there, so a call that was lost
leaves the runs as they were, and a batch that comes again under its name isn't counted twice. Earlier batches may hold
smaller documents then; the document that keeps a line is the largest that any batch so far holds it in.

Defined cases: null and empty text is one empty line; a null id counts as a document smaller than all others; rows
with one id are one document (all of the holder's rows keep the line); other columns pass through unchanged, whatever
their names; an empty table gives an empty table. Texts may be of any length: the positions to drop are kept per
document, and texts are cut in one pass.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BLANKS, aside, discard, lower_ascii, parts, shared_dir, spread_join, written

_HASH = ["_h1", "_h2"]
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Levels of runs, each a bucketed table: in the shared folder, where they end with close(), or in `folder`, which
    all executors reach and where they stay for the next LineRuns of that folder. One writer at a time."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None, folder: str | None = None):
        self.spark, self.fanout, self.folder = spark, fanout, folder
        self.at = folder.rstrip("/") if folder else shared_dir(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.batches: list[str] = []
        self.version = 0
        if folder:
            self._open()

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.at, name)

    def _open(self) -> None:
        """What the newest manifest names; its runs become tables of this session."""
        fs = self._files()
        fs.mkdirs(self._path("."))
        names = [s.getPath().getName() for s in fs.listStatus(self._path("."))]
        told = sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not told:
            return
        stream = fs.open(self._path(told[-1]))
        try:
            found = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        self.version, self.buckets, self.levels, self.batches = (found[k] for k in ("version", "buckets", "levels", "batches"))
        for run in self.runs():
            by = ", ".join(_HASH)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {run} (_h1 BIGINT, _h2 BIGINT, n_docs BIGINT, holder BIGINT) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.at}/{run}'")

    def _tell(self) -> None:
        """A new manifest under its own number: whole or not there."""
        self.version += 1
        fs, name = self._files(), f"manifest-{self.version:09d}.json"
        out = fs.create(self._path(f".{name}"), True)
        try:
            out.write(bytearray(json.dumps({"version": self.version, "buckets": self.buckets, "levels": self.levels, "batches": self.batches}).encode()))
        finally:
            out.close()
        if not fs.rename(self._path(f".{name}"), self._path(name)):
            raise RuntimeError(f"{name} is there: another writer adds to these runs")
        if self.version > 2:  # the one before stays
            fs.delete(self._path(f"manifest-{self.version - 2:09d}.json"), False)

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, entries: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = entries.repartition(self.buckets, *_HASH)
        dealt.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", f"{self.at}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        gone = self.spark.range(0)
        gone.selvage_path = f"{self.at}/{name}"
        discard(gone)

    @staticmethod
    def merged(entries: DataFrame) -> DataFrame:
        return entries.groupBy(*_HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    def entries(self, runs: list[str]) -> DataFrame:
        """The rows of these runs. Read as plain files: a union of bucketed tables would claim to be dealt by hash even where the scan isn't."""
        return self.spark.read.schema("_h1 long, _h2 long, n_docs long, holder long").parquet(*[f"{self.at}/{run}" for run in runs])

    def add(self, batch: DataFrame, name: str | None = None) -> None:
        """batch: _h1, _h2, n_docs, holder, one row for each hash.

        Without a folder the batch's documents precede those of earlier batches, so a hash that is there keeps its holder;
        with one they may be any, and the larger holder wins. A batch of a name that was added isn't added again."""
        if name is not None and name in self.batches:
            return
        fresh = batch
        for run in self.runs():
            fresh = fresh.join(self.spark.table(run).where("holder is not null").select(*_HASH).hint("merge"), _HASH, "left_anti")
        if self.runs():
            seen = batch.select(*_HASH, "n_docs", F.col("holder") if self.folder else F.lit(None).cast("long").alias("holder"))
            batch = self.merged(seen.unionByName(fresh.withColumn("n_docs", F.lit(0).cast("long"))))
        self._write(batch, 0)
        level, past = 0, []
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self.merged(self.entries(old)), level + 1)
            past += old
            level += 1
        if name is not None:
            self.batches.append(name)
        if self.folder:
            self._tell()
        for run in past:
            self._drop(run)

    def close(self) -> None:
        """Without a folder the runs end; with one, only this session's tables of them."""
        for run in self.runs():
            if self.folder:
                self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            else:
                self._drop(run)
        self.levels = []


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, drop: pd.Series) -> pd.Series:
    """The texts without the lines at the given places."""

    def cut(t, places):
        if t is None or places is None:
            return None
        gone = set(places.tolist())
        return "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)

    return pd.Series([cut(t, p) for t, p in zip(text, drop)], dtype=object)


def drop_shared_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 3, folder: str | None = None, name: str | None = None) -> DataFrame:
    """df with the text less the lines whose key has min_chars code points or more and is in min_docs documents or more,
    but for the largest document that holds it; adds n_lines (before) and n_dropped, replacing columns of these names.

    folder: df is one batch, called `name`, of those whose runs are kept there (a document is in one batch only). Its lines
    count together with those of all batches so far; what earlier batches were given back stays as it was."""
    if folder and name is None:
        raise ValueError("a batch of runs that are kept needs a name")
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_d"), F.col(text).alias("_t"))
    edges = []
    if batches > 1 and not folder:
        edges = rows.agg(F.percentile_approx("_d", [n / batches for n in range(1, batches)], 10_000)).first()[0] or []
    edges = sorted(set(edges), reverse=True)
    batch = sum((F.when(F.col("_d") <= e, 1).otherwise(0) for e in edges), F.lit(0))
    cut = rows.select("_d", F.xxhash64("_t").alias("_r"), F.posexplode(F.split(F.coalesce("_t", F.lit("")), "\n", -1)).alias("_pos", "_line"))
    keyed = cut.where(F.length("_line") >= min_chars).withColumn("_key", line_key(F.col("_line"))).where(F.length("_key") >= min_chars)
    lines = written(keyed.select(batch.alias("_batch"), "_d", "_r", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64("_key", F.lit(1)).alias("_h2")), "lines")

    runs = LineRuns(spark, fanout, parts(df), folder)
    try:
        for n in range(len(edges) + 1):
            own = lines.where(F.col("_batch") == n).select("_d", *_HASH).distinct()
            runs.add(own.groupBy(*_HASH).agg(F.count("*").alias("n_docs"), F.max("_d").alias("holder")), name)
        frequent = written(runs.merged(runs.entries(runs.runs())).where(F.col("n_docs") >= min_docs), "frequent")
    finally:
        runs.close()
    # a very common line's rows are dealt to many tasks
    counts = frequent.select(*_HASH, F.col("n_docs").alias("_n"))
    gone = spread_join(lines.select("_d", "_r", "_pos", *_HASH), frequent.select(*_HASH, "holder"), _HASH, counts, ["_d", "_r", "_pos"]).where(F.col("_d") != F.col("holder"))
    drops = gone.groupBy("_d", "_r").agg(F.collect_set("_pos").alias("_drop"))
    put, back = aside(df, ("n_lines", "n_dropped"))
    docs = df.select(*put, F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_d"), F.xxhash64(text).alias("_r"))
    own = f"_u{df.columns.index(text)}_"  # the text's name while it is aside
    out = docs.join(drops, ["_d", "_r"], "left")
    short = F.when(F.col("_drop").isNotNull(), _without(F.when(F.col("_drop").isNotNull(), F.col(own)), F.col("_drop"))).otherwise(F.col(own))
    whole = F.coalesce(F.col(own), F.lit(""))
    n_lines = (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long")
    out = out.withColumn("_n", n_lines).withColumn("_gone", F.coalesce(F.size("_drop"), F.lit(0)).cast("long")).withColumn(own, short)
    return out.select(*back, F.col("_n").alias("n_lines"), F.col("_gone").alias("n_dropped"))
