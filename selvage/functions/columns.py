"""Column helpers that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: full-width forms of ASCII and their plain ones; the ideographic space.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + chr(0x3000)
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def missing(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def narrow_forms(c: Column) -> Column:
    """Full-width forms of ASCII as plain ones."""
    return F.translate(c, _WIDE, _PLAIN)


def plain_text(c: Column) -> Column:
    """Full-width forms as plain ones, lower case, no white space, underscores, hyphens or slashes: for matching headers and names."""
    return F.regexp_replace(F.lower(F.translate(c, _WIDE, _PLAIN)), r"[\s_\-/\\.()]+", "")


def number_of(c: Column) -> Column:
    """A measure as text ("22 1/2", "1/2", "36.0", "1,234元", "68%") as a double, else null. A percentage is scaled.

    Only what has a number's shape is cast: a cast that fails costs many times one that fits."""
    text = F.trim(F.regexp_replace(F.translate(c, _WIDE, _PLAIN), r"[,$元\s]+$|^[$\s]+|,", ""))

    def stroke(v):
        mixed, part = r"^(-?\d+)\s+(\d+)/(\d+)$", r"^(\d+)/(\d+)$"
        get = lambda pattern, n: F.regexp_extract(v.text, pattern, n).try_cast("double")
        return F.when(v.text.rlike(mixed), get(mixed, 1) + F.try_divide(get(mixed, 2), get(mixed, 3))).when(v.text.rlike(part), F.try_divide(get(part, 1), get(part, 2)))

    plain = text.try_cast("double")
    percent = F.when(text.endswith("%"), F.regexp_replace(text, "%$", "").try_cast("double") / 100).otherwise(plain)
    return (
        F.when(c.rlike(r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)\s*$"), c.try_cast("double"))
        .when(c.rlike("[/／]"), let(stroke, text=text))
        .when(c.rlike("[%％]"), percent)
        .when(c.rlike("(?i)nan|inf|0x|[Ａ-Ｚａ-ｚ]"), plain)  # names of numbers, or what only plain forms tell
        .when(c.rlike("[0-9０-９]") & ~c.rlike("[G-Zg-z]"), plain)
    )


def date_of(c: Column) -> Column:
    """yyyymmdd (also as a number) or a date as text, from 1900 to 2199; else null. So a bare number of five digits, as a workbook stores days, is no year.

    A format is tried only on texts of its shape: one that fails costs as much as many that fit."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    other = F.try_to_timestamp(text).cast("date")
    other = F.when(F.year(other).between(1900, 2199), other)
    as_ = lambda form: F.coalesce(F.try_to_timestamp(text, F.lit(form)).cast("date"), other)
    return F.when(text.rlike(r"^(?:19|20|21)\d{6}$"), as_("yyyyMMdd")).when(text.rlike(r"^(?:19|20|21)\d\d/\d+/\d+$"), as_("yyyy/M/d")).otherwise(other)


def first_match(value: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule (pattern, label) that matches."""
    return reduce(lambda out, rule: F.when(value.rlike(rule[0]), F.lit(rule[1])).otherwise(out), reversed(rules), F.lit(otherwise))


def all_matches(value: Column, rules: list[tuple[str, str]]) -> Column:
    """The labels of all rules that match, in order."""
    return F.filter(F.array(*[F.when(value.rlike(p), F.lit(label)) for p, label in rules]), lambda x: x.isNotNull())


def map_of(c: Column, names: dict) -> Column:
    """The name of a value, else null."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), c)


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of the schema that it lacks, as typed nulls."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in have])


def settled(df: DataFrame) -> DataFrame:
    """df computed once, in the checkpoint folder that the cluster names (or, where it names none, one beside the warehouse): what reads it several times doesn't compute it again, nor when executors are lost."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        if not spark.sparkContext.master.startswith("local") and folder.startswith(("/", "file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def ordered_counts(df: DataFrame, keys: list[str], metric: str, parts: int = 64) -> DataFrame:
    """keys, _value, _ties (rows of it), _before (rows of smaller values) and _all (rows) of the values of each key.

    Rows are counted by value first, and only the distinct values are ordered, so a group may hold any number of rows.
    Without keys the values are dealt to `parts` ranges by approximate quantiles, which only decide who orders what."""
    counts = df.groupBy(*keys, F.col(metric).alias("_value")).agg(F.count("*").alias("_ties"))
    if keys:
        group = Window.partitionBy(*keys)
        before = F.sum("_ties").over(group.orderBy("_value").rowsBetween(Window.unboundedPreceding, -1))
        return counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_all": F.sum("_ties").over(group)})
    counts = settled(counts)
    edges = counts.agg(F.percentile_approx("_value", [n / parts for n in range(1, parts)], 1000)).first()[0] or []
    edges = F.array(*[F.lit(e) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    counts = counts.withColumn("_part", F.size(F.filter(edges, lambda e: e < F.col("_value"))))
    every = Window.orderBy("_part")  # at most `parts` rows
    offsets = counts.groupBy("_part").agg(F.sum("_ties").alias("_n"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    within = Window.partitionBy("_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_in", F.coalesce(F.sum("_ties").over(within), F.lit(0))).join(F.broadcast(offsets), "_part")
    return counts.select("_value", "_ties", (F.col("_from") + F.col("_in")).alias("_before"), "_all")


def pct_rank(df: DataFrame, keys: list[str], metric: str, to: str, where: Column | None = None) -> DataFrame:
    """df with `to`: (rank + (ties - 1) / 2) / rows among the rows of the same keys that `where` admits and whose metric isn't null."""
    admitted = (where if where is not None else F.lit(True)) & F.col(metric).isNotNull()
    counts = ordered_counts(df.where(admitted), keys, metric)
    rank = (F.col("_before") + 1 + (F.col("_ties") - 1) / 2) / F.col("_all")
    ranks = counts.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "_value", rank.alias(to))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)], admitted & (F.col(metric) == F.col("_value")))
    return df.join(ranks, same, "left").drop("_value", *[f"_k{n}" for n in range(len(keys))])


def quantiles(df: DataFrame, keys: list[str], metric: str, shares: list[float]) -> DataFrame:
    """keys, _edges (the exact quantiles, between two values in proportion) and _n (rows) of the metric, nulls left out; no group is held in memory."""
    counts = ordered_counts(df.where(F.col(metric).isNotNull()), keys, metric)
    end = F.col("_before") + F.col("_ties")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_before") <= place) & (place < end), F.col("_value")))

    def quantile(share: float) -> Column:
        place = (F.col("_all") - 1) * F.lit(float(share))
        low, high = F.floor(place), F.ceil(place)
        return F.struct(at(low).alias("low"), at(high).alias("high"), F.max(place - low).alias("over"))

    found = counts.groupBy(*keys).agg(F.array(*[quantile(s) for s in shares]).alias("_q"), F.max("_all").alias("_n"))
    between = F.transform("_q", lambda q: F.when((q["over"] == 0) | (q["low"] == q["high"]), q["low"]).otherwise(q["low"] * (1 - q["over"]) + q["high"] * q["over"]))
    return found.select(*keys, between.alias("_edges"), "_n")


def with_medians(found: DataFrame, df: DataFrame, keys: list[str], metrics: dict[str, str]) -> DataFrame:
    """found (one row for each of df's keys) with the exact medians of df's metrics, as columns named by `metrics`' keys; null where a group has no value. All metrics go through one exchange, and no group is held in memory."""
    pairs = F.explode(F.array(*[F.struct(F.lit(to).alias("_name"), F.col(m).cast("double").alias("_metric")) for to, m in metrics.items()]))
    long = df.select(*keys, pairs.alias("_pair")).select(*keys, "_pair.*")
    middle = quantiles(long, [*keys, "_name"], "_metric", [0.5])
    wide = middle.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).agg(*[F.max(F.when(F.col("_name") == to, F.col("_edges")[0])).alias(to) for to in metrics])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
    return found.join(wide, same, "left").drop(*[f"_k{n}" for n in range(len(keys))])


def quantile_edges(df: DataFrame, keys: list[str], metric: str, bins: int, least: int) -> DataFrame:
    """keys, _edges (distinct, ascending), _n for groups of `least` rows or more."""
    edges = quantiles(df, keys, metric, [n / bins for n in range(bins + 1)])
    return edges.where(F.col("_n") >= least).withColumn("_edges", F.array_distinct("_edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Number of the right-closed bin, from 1; the lowest edge belongs to the first."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e < value)) + 1


def unpivoted(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row for each of the columns: its name and its value as text."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in columns]))
    return df.select(*ids, pairs.alias("_pair")).select(*ids, "_pair.*")


def let(body, **values: Column) -> Column:
    """body(struct of the values), with each value computed once."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
