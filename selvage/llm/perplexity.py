"""Quality rules: simple counts of a text, and the band of its perplexity under a model of its own language.

The model is a modified Kneser-Ney model of the bytes of the corpus (A-Z in lower case), of order `order`, one for each
language and half of the texts. Halves are dealt by a hash of the text, and a text is scored by the model of the other
half, so neither it nor its copies make themselves likely. Spark counts the n-grams of every whole text and derives
continuation counts, discounts and probabilities; the result is a table of (hash, value), of which scoring tasks get
sorted arrays. A hash packs 19 bits of language and half, 4 of the kind of entry, and the n-gram itself. What tasks get
at once has at most `shard_entries` entries: models are put together up to that number, and each text is read in the
pass of its own model only. A model of more entries is dealt to shards by the byte before the last, so that all an
n-gram needs is in one shard, and its texts are read once for each. With more than one pass, the rows are written once
with a key of their own, by which the passes' sums are added. The number of entries is bounded by the n-grams of a
language, not by the documents.

A language's band is its median of the log-perplexity, up and down by `width` times the spread (1.4826 times the median
absolute deviation) or `least_up` and `least_down` nats, whichever is more; a text's own band is wider by three standard
errors, so short texts aren't judged by a few letters.

Defined cases: null text has no words, no bytes, log-perplexity null, and fails the base rules; a null language is a
language of its own; repeated rows count as often as they come; other columns pass through, and those of the outputs'
names are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WORD, discard, small_batches, written
from .shingles import chunks, slices

_WORDS = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_START = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: list[str], window: int = 5) -> int:
    """Words in windows that the text has twice or more, the first time included."""
    if len(words) <= window:
        return 0
    found = list(zip(*(words[j:] for j in range(window))))
    if len(set(found)) == len(found):
        return 0
    times, covered, end = Counter(found), 0, 0
    for at, w in enumerate(found):
        if times[w] > 1:
            covered += at + window - max(at, end)
            end = at + window
    return covered


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if _WORDS.search(line):
            n += line in seen
            seen.add(line)
    return n


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def rule_counts(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        t = t or ""
        words = _WORDS.findall(t)
        out.append((len(words), sum(map(len, words)), len(_SYMBOLS.findall(t)), _dup_lines(t), _repeat_words(words)))
    return pd.DataFrame(out, columns=COUNTS, dtype="int64")


def _grams(text: bytes, order: int) -> np.ndarray:
    """Packed n-gram that ends at each byte; before the text stand start marks."""
    data = np.concatenate([np.full(order - 1, _START, np.uint8), _LOWER[np.frombuffer(text, np.uint8)]]).astype(np.int64)
    n = len(text)
    out = np.zeros(n, np.int64)
    for j in range(order):
        out = out << 8 | data[j : j + n]
    return out


def _lang(c: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(1 << 18))


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """_lang, _g, _c: how often each n-gram of bytes is in all texts. docs: _lang, _text. Counted in each task first."""

    def merged(parts):
        grams, counts = (np.concatenate(x) for x in zip(*parts))
        grams, at = np.unique(grams, return_inverse=True)
        return grams, np.bincount(at, counts, len(grams)).astype(np.int64)

    def told(lang, parts):
        grams, counts = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), lang)), pa.array(grams), pa.array(counts)], names=["_lang", "_g", "_c"])

    def work(batches):
        held: dict[int, list] = {}  # of all languages together at most `most` entries, and one run's more
        most, size = 2_000_000, 0
        for batch in slices(batches):
            langs, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for lang in np.unique(langs).tolist():
                own = [t.encode("utf-8", "surrogatepass") for t, k in zip(texts, langs) if k == lang and t]
                for run in chunks(own, 1_000_000):
                    held.setdefault(lang, []).append(np.unique(np.concatenate([_grams(t, order) for t in run]), return_counts=True))
                    size += len(held[lang][-1][0])
                    if size <= most:
                        continue
                    held = {k: [merged(parts)] for k, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    while size > most // 2:  # the largest goes as it is; Spark adds it up
                        k = max(held, key=lambda k: len(held[k][0][0]))
                        size -= len(held[k][0][0])
                        yield told(k, held.pop(k))
        for lang, parts in held.items():
            yield told(lang, parts)

    return docs.mapInArrow(work, "_lang long, _g long, _c long").groupBy("_lang", "_g").agg(F.sum("_c").alias("_c"))


def kneser_ney(top: DataFrame, order: int) -> DataFrame:
    """key, value, context: log-probabilities (kinds 1 to order) and log-weights of contexts (kind 8 + length), from the counts of the longest n-grams."""
    tables, counts = {order: top}, top
    for k in range(order - 1, 0, -1):
        counts = written(counts.groupBy("_lang", F.col("_g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("_g")).agg(F.count("*").alias("_c")), f"counts{k}")
        tables[k] = counts
    entry = lambda kind, gram: F.shiftleft("_lang", 44).bitwiseOR(F.lit(kind << 40)).bitwiseOR(gram)
    below, out = None, []
    for k in range(1, order + 1):
        of = of_counts = tables[k]
        tally = of.groupBy("_lang").agg(*[F.count_if(F.col("_c") == n).cast("double").alias(f"n{n}") for n in range(1, 5)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        fine = F.least("n1", "n2", "n3", "n4") > 0
        discount = [F.when(fine, F.greatest(F.lit(0.05), F.least(F.lit(n - 0.05), n - (n + 1) * y * F.col(f"n{n + 1}") / F.col(f"n{n}")))).otherwise(F.lit(n / 2)).alias(f"d{n}") for n in range(1, 4)]
        of = of.join(F.broadcast(tally.select("_lang", *discount)), "_lang")  # one row for each language
        of = of.withColumn("_h", F.shiftright("_g", 8) if k > 1 else F.lit(0).cast("long"))
        own = Window.partitionBy("_lang", "_h")  # at most 256 rows
        d = F.when(F.col("_c") == 1, F.col("d1")).when(F.col("_c") == 2, F.col("d2")).otherwise(F.col("d3"))
        of = of.withColumn("_d", d).withColumn("_total", F.sum("_c").over(own)).withColumn("_gamma", F.sum("_d").over(own) / F.col("_total"))
        of = of.withColumn("_own", (F.col("_c") - F.col("_d")) / F.col("_total"))
        if below is None:
            of = of.withColumn("_p", F.col("_own") + F.col("_gamma") / 256)
        else:
            shorter = below.select("_lang", F.col("_g").alias("_s"), F.col("_p").alias("_q"))
            of = of.withColumn("_s", F.col("_g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(shorter, ["_lang", "_s"]).withColumn("_p", F.col("_own") + F.col("_gamma") * F.col("_q"))
        below = written(of.select("_lang", "_g", "_h", "_p", "_gamma"), f"grams{k}")
        context = F.when(F.lit(k > 1), F.col("_lang") * 31 + F.col("_h").bitwiseAND(F.lit(255)))
        out.append(below.select(entry(k, F.col("_g")).alias("key"), F.log("_p").cast("float").alias("value"), context.alias("context")))
        discard(of_counts)
        out.append(below.select("_lang", "_h", "_gamma").distinct().select(entry(8 + k - 1, F.col("_h")).alias("key"), F.log("_gamma").cast("float").alias("value"), context.alias("context")))
    model = out[0]
    for more in out[1:]:
        model = model.unionByName(more)
    return model


def _log_probabilities(grams: np.ndarray, lang: int, keys: np.ndarray, values: np.ndarray, order: int) -> np.ndarray:
    """Natural logarithm of each n-gram's last byte after the others, backing off where the model has no entry."""
    out = np.zeros(len(grams))
    left = np.arange(len(grams))
    base = lang << 44

    def find(kind, part):
        want = part | (base | kind << 40)
        at = np.searchsorted(keys, want)
        at[at == len(keys)] = 0
        return at, keys[at] == want if len(keys) else np.zeros(len(want), bool)

    for k in range(order, 0, -1):
        part = grams[left] & ((1 << 8 * k) - 1)
        at, hit = find(k, part)
        out[left[hit]] += values[at[hit]]
        left, part = left[~hit], part[~hit]
        if not len(left):
            return out
        at, hit = find(8 + k - 1, part >> 8)
        out[left[hit]] += values[at[hit]]
    out[left] -= np.log(256)
    return out


def _scorer(shared, order: int, shard: int, shards: int):
    """Sums over the bytes of a text whose n-grams are in this shard; shared: the shard's sorted hashes and values."""

    @F.pandas_udf("_bytes long, _sum double, _squares double")
    def score(langs: pd.Series, texts: pd.Series) -> pd.DataFrame:
        keys, values = shared.value
        out = np.zeros((len(texts), 3))
        for n, (lang, t) in enumerate(zip(langs.tolist(), texts)):
            grams = _grams((t or "").encode("utf-8", "surrogatepass"), order)
            if shards > 1:
                grams = grams[(lang * 31 + (grams >> 8 & 255)) % shards == shard]
            p = _log_probabilities(grams, lang, keys, values, order)
            out[n] = len(grams), -p.sum(), (p * p).sum()
        frame = pd.DataFrame(out, columns=["_bytes", "_sum", "_squares"])
        frame["_bytes"] = frame["_bytes"].astype("int64")
        return frame

    return score


def _passes(sizes: dict[int, int], most: int) -> tuple[dict[int, int], list[int]]:
    """The pass of each model (by its number of entries), and into how many shards each pass's entries are dealt."""
    of, shards, room = {}, [], 0
    for lang, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if n > room:
            shards.append(max(1, -(-n // most)))
            room = shards[-1] * most if shards[-1] == 1 else n  # one dealt to shards stays by itself
        of[lang] = len(shards) - 1
        room -= n
    return of, shards or [1]


def log_perplexity(docs: DataFrame, model: DataFrame, order: int, shard_entries: int = 6_000_000) -> DataFrame:
    """docs (_lang, _text and others) without the text, with _bytes, _sum and _squares of the bytes' negative log-probabilities: a written table of a row for each of docs; model: a written table."""
    spark = docs.sparkSession
    of_model = F.shiftrightunsigned("key", 44).alias("_lang")
    sizes = dict(model.groupBy(of_model).count().collect())  # one number for each language and half
    found, dealt = _passes(sizes, shard_entries)
    several, others, parts = len(dealt) > 1 or dealt[0] > 1, [c for c in docs.columns if c != "_text"], []
    if several:
        # a key that is written once is the row's own in every pass; a language without a model goes with the first
        passes = F.broadcast(spark.createDataFrame(list(found.items()), "_lang long, _pass int"))
        docs = docs.withColumn("_key", F.monotonically_increasing_id()).join(passes, "_lang", "left").withColumn("_pass", F.coalesce("_pass", F.lit(0)))
        docs = written(docs, "keyed", by="_pass")
        model = written(model.select("*", of_model).join(passes, "_lang").drop("_lang"), "model", by="_pass")
    for number, shards in enumerate(dealt):
        for shard in range(shards):
            part = model.where(F.col("_pass") == number) if several else model
            part = part if shards == 1 else part.where(F.col("context").isNull() | (F.pmod("context", F.lit(shards)) == shard))
            entries = part.select("key", "value").toArrow()  # about shard_entries rows of 12 bytes at most
            keys, values = (entries[c].to_numpy() for c in ("key", "value"))
            by_key = np.argsort(keys)
            shared = spark.sparkContext.broadcast((keys[by_key], values[by_key]))
            del entries, keys, values
            got = (docs.where(F.col("_pass") == number) if several else docs).withColumn("_score", _scorer(shared, order, shard, shards)("_lang", "_text"))
            parts.append(written(got.select(*(["_key"] if several else others), "_score.*"), "scores"))
            shared.unpersist()
    if not several:
        return parts[0]
    sums = reduce(DataFrame.unionByName, parts).groupBy("_key").agg(*[F.sum(c).alias(c) for c in ("_bytes", "_sum", "_squares")])
    out = written(docs.select("_key", *others).join(sums, "_key").drop("_key"), "scored")
    for done in (docs, model, *parts):
        discard(done)
    return out


def judge(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 5, width: float = 10.0, least_up: float = 0.8, least_down: float = 0.6, errors: float = 3.0, shard_entries: int = 6_000_000) -> DataFrame:
    """df without its text: the counts, log_perplexity (per byte), base_failed and kept. The model is that of all of df's texts."""
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "base_failed", "kept")
    carry = [c for c in df.columns if c not in (*out, text)]
    half = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(2)), F.lit(2))
    docs = df.select(_lang(F.col(lang)).alias("_of"), half.alias("_half"), F.col(text).alias("_text"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text)).alias("_r"), *[F.col(f"`{c}`").alias(f"c_{n}") for n, c in enumerate(carry)])
    grams = count_grams(docs.select((F.col("_of") * 2 + F.col("_half")).alias("_lang"), "_text"), order)
    with small_batches(df.sparkSession):
        grams = written(grams, "grams")
    model = written(kneser_ney(grams, order), "model")
    # the counts' own pass over the text is the scores' pass: both come from the same scan
    asked = docs.withColumn("_lang", F.col("_of") * 2 + 1 - F.col("_half")).withColumn("_counts", rule_counts("_text"))
    with small_batches(df.sparkSession):
        scored = log_perplexity(asked, model, order, shard_entries)
    x = F.when(F.col("_bytes") > 0, F.col("_sum") / F.col("_bytes"))
    scored = scored.withColumn("log_perplexity", x)
    error = F.sqrt(F.try_divide(F.greatest(F.try_divide("_squares", "_bytes") - F.col("log_perplexity") ** 2, F.lit(0.0)), F.col("_bytes")))
    middle = scored.groupBy("_of").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("_middle"))
    off = scored.join(F.broadcast(middle), "_of").groupBy("_of").agg(F.first("_middle").alias("_middle"), F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("_middle")), 0.5, 10_000).alias("_spread"))
    limit = lambda least: F.greatest(width * 1.4826 * F.col("_spread"), F.lit(least))
    band = off.select("_of", "_middle", limit(least_up).alias("_up"), limit(least_down).alias("_down"))  # one row for each language
    judged = scored.join(F.broadcast(band), "_of", "left")
    n = F.col("_counts.n_words")
    failed = (n < 10) | (100 * F.col("_counts.n_repeat_words") > 20 * n)
    inside = F.col("log_perplexity").between(F.col("_middle") - F.col("_down") - errors * error, F.col("_middle") + F.col("_up") + errors * error)
    return judged.select(*[F.col(f"c_{n}").alias(c) for n, c in enumerate(carry)], "_counts.*", "log_perplexity", failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"))
