"""The grid of blocks against Spark's own expressions over all pairs, on odd rows too, and the plans of the queries that use it."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from selvage.functions.columns import dot
from selvage.operators import grid, hamming, retrieval, visual
from selvage.plans import registry

NAN = float("nan")


def rows_of(df):
    fix = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    columns = sorted(df.columns)
    return sorted((tuple(fix(r[c]) for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def vectors(spark):
    random.seed(5)
    rows = [(n, [random.choice([-1.0, 0.0, 0.5, 0.1, 3.0]) for _ in range(3)] if n % 2 else [random.gauss(0, 1) for _ in range(3)], n % 3 if n % 11 else None) for n in range(2300)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0, 0.0, 0.0], 1), (3003, [1.0, None, 2.0], 2), (3004, [1.0, NAN, 2.0], 2), (3005, [1.0, 2.0], 0), (None, [1.0, 1.0, 1.0], 0), (3010, [1.0, 1.0, 1.0], None)]
    rows += [(4000 + n, [0.3, 0.2, 0.1], 0) for n in range(40)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, label long").repartition(3)


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("id % 250 = 0 or id between 3000 and 3010").select(F.col("id").alias("query"), F.col("embedding").alias("q"), (F.col("id") % 3).alias("want"))


@pytest.fixture(scope="module")
def pairs(vectors, asked):
    norm = lambda v: F.sqrt(dot(v, v))
    met = asked.crossJoin(vectors).where("id <> query")
    return met.withColumn("similarity", F.bround(F.try_divide(dot(F.col("q"), F.col("embedding")), norm(F.col("q")) * norm(F.col("embedding"))), 6)).drop("q", "embedding").cache()


def test_nearest_of_blocks(vectors, asked, pairs):
    assert rows_of(retrieval.nearest(asked, vectors, 7)) == rows_of(retrieval.top_k(pairs.drop("want"), 7))
    got = retrieval.nearest(asked, vectors, 4, narrow=("want", "label"))
    assert rows_of(got) == rows_of(retrieval.top_k(pairs, 4, F.col("label") == F.col("want")).drop("want"))
    assert rows_of(retrieval.best_of_each(asked, vectors, "label")) == rows_of(retrieval.best_per_sku(pairs, "label"))
    assert retrieval.nearest(asked, vectors.where("false"), 7).count() == 0 and retrieval.nearest(asked.where("false"), vectors, 7).count() == 0


def test_confidence_of_blocks(vectors, asked, pairs):
    whole = vectors.where("id is null or id <> 3004")
    assert rows_of(retrieval.confidence_of(asked.where("query <> 3004"), whole)) == rows_of(retrieval.confidence(pairs.where("query <> 3004 and id <> 3004")))


def test_pictures_of_blocks(spark):
    random.seed(6)
    number = lambda: random.choice([None, NAN, 0.1, 0.25, 1.0, 7.0, 2.0])
    rows = [(n, None if n % 17 == 3 else [number() for _ in range(random.choice([9, 9, 4]))]) for n in range(1200)] + [(None, [1.0] * 9)]
    library = spark.createDataFrame(rows, "id long, signature array<double>")
    windows = library.where("id % 100 < 2").select(F.floor(F.col("id") / 100).alias("query"), (F.col("id") % 2).alias("window"), F.col("signature").alias("q"))
    apart = F.bround(visual.signature_distance(F.col("q"), F.col("signature"), 2, 3), 5)
    plain = windows.crossJoin(library).withColumn("distance", apart).where("distance is not null").groupBy("query", "id").agg(F.min(F.struct("distance", "window")).alias("b")).select("query", "id", "b.*")
    got = visual.nearest_signatures(windows, library, 2, 3, top=2000)
    assert rows_of(got.drop("place")) == rows_of(plain)

    cells = [(n, None if n % 17 == 3 else [(c, random.choice(["a", "b", None]), random.choice(["x", None])) for c in random.sample(range(6), random.randint(0, 6))]) for n in range(60)]
    df = spark.createDataFrame(cells, "id long, cells array<struct<cell: int, code: string, pattern: string>>")
    asked = df.where("id % 4 = 3").select(F.col("id").alias("query"), F.col("cells").alias("q"))
    plain = asked.crossJoin(df).where("id <> query").select("query", "id", visual.compare_cells(F.col("q"), F.col("cells")).alias("c")).select("query", "id", "c.n_cells", "c.n_colour", "c.n_pattern", "c.colour_share", "c.pattern_share")
    assert rows_of(visual.compared_cells(asked, df)) == rows_of(plain)

    some = lambda: tuple(random.choice([1.0, 2.5, 7.0, 3.0, None, NAN]) if random.random() < 0.2 else random.random() for _ in range(3))
    palettes = [(n, None if n % 17 == 3 else [(*some(), random.choice([0.0, 1.0, 2.0, 3.0, None]) if n % 5 == 0 else 2.0) for _ in range(random.randint(0, 3))]) for n in range(60)]
    df = spark.createDataFrame(palettes, "id long, p array<struct<L: double, a: double, b: double, w: double>>")
    asked = df.where("id % 4 = 3").select(F.col("id").alias("query"), F.col("p").alias("q"))
    plain = asked.crossJoin(df).where("id <> query").select("query", "id", F.bround(visual.palette_distance(F.col("q"), F.col("p")), 6).alias("distance"))
    assert rows_of(visual.palette_distances(asked, df)) == rows_of(plain)


def test_rounding_is_sparks(spark):
    values = [0.0000005, 0.0000015, 0.1234565, -0.1234575, 2.5e-7, 1e300, 123456789.1234565, 0.3333335, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert grid.rounded(np.array(values), 6).tolist() == [r[0] for r in df.select(F.bround("v", 6)).collect()]


@pytest.mark.parametrize("name", ["cosine_topk", "narrowed_topk", "centred_topk", "best_per_label", "retrieval_eval", "search_confidence", "softmax_tags", "attribute_tags", "signature_search", "cell_comparison", "palette_distances"])
def test_pairs_are_met_in_blocks(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and ("FlatMapCoGroupsInArrow" in plan or name == "narrowed_topk")


def test_scanned_codes_are_those_of_the_index(spark):
    random.seed(7)
    codes = [random.getrandbits(128) for _ in range(12)]
    rows = [(n, [(c >> 64 * w & (1 << 64) - 1) - (1 << 63) for w in range(2)]) for n, c in enumerate(random.choice(codes) ^ (1 << random.randrange(128)) * random.choice([0, 1]) for _ in range(150))]
    df = spark.createDataFrame(rows + [(500, None)], "id long, code array<long>")
    asked = df.where("id % 25 = 0").select(F.col("id").alias("query"), "code")
    scanned = hamming.nearest_codes(asked, df, 6, 2)
    assert rows_of(scanned) == rows_of(hamming.nearest_codes(asked, df, 6, 2, index=hamming.index_of(df, 2)))
    assert "SortMergeJoin" not in scanned._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["beat_lags", "user_beats"])
def test_blocks_of_series_share_batches(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
