"""From raw documents to packed training sequences, one stage after another.

Each stage gets what its predecessor kept, written and read again, and calls one operator of selvage.llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.llm import line_dedup, minhash_forest, mixing, packing, toxicity
from selvage.llm._common import table, written

#: Shares of expected tokens by the labels' quality. No document is taken less than once.
QUALITY_TARGETS = {"high": 0.9, "low": 0.1}

#: A sequence's limits beside 4096 tokens, and which tokens bear loss.
PACKING = {"loss": "last line", "max_segments": 32, "max_loss": 1536}


def _over(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], *more: str) -> DataFrame:
    """operator over doc_id, text and docs' other columns under names that no operator uses; then its rows with docs' columns, and `more` of its own as _<name>_."""
    names = {c: c if c in ("doc_id", "text") else f"_own{n}_" for n, c in enumerate(docs.columns)}
    out = operator(docs.select(*[F.col(f"`{c}`").alias(u) for c, u in names.items()]))
    return out.select(*[F.col(u).alias(c) for c, u in names.items()], *[F.col(m).alias(f"_{m}_") for m in more])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of less than one half; a null text has no evidence and stays."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _over(docs, lambda d: toxicity.score_toxicity(d, machine).where("toxicity < 0.5"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share (the largest doc_id keeps them); n_chars follows the text."""
    out = _over(docs, line_dedup.drop_shared_lines, "n_dropped")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_dropped_") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group."""
    return _over(docs, lambda d: minhash_forest.near_duplicates(d).where("kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that expected tokens of high and low quality match the targets."""
    domain = F.when(F.col("quality") == 1, F.lit("high")).when(F.col("quality") == 0, F.lit("low"))
    weights = mixing.train(docs, table(spark, sf_dir, "labels"), domain, list(QUALITY_TARGETS))

    def taken(d: DataFrame) -> DataFrame:
        mixed = mixing.mix(d, weights, QUALITY_TARGETS, _vocabulary(), least_rate=1.0)
        return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))

    return _over(docs, taken)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their loss-bearing tokens."""
    pieces = packing.pack_documents(docs, _vocabulary(), end=2, **PACKING)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"), "offset", "loss_tokens")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
