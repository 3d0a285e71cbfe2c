"""Order MinHash fingerprints, sensitive to edit distance, with SQL functions only.

Tokens are runs of other characters with the white space before them. A run longer than `token_chars` is cut where its
own characters say so: behind a pair of characters whose hash is not larger than those of the two pairs before and
after it. So an edit moves no cut but those beside it, with or without white space. Each k-mer of consecutive tokens is
numbered by its occurrence in the text. The numbered k-mers are hashed once and dealt to `slots` by their hash; a slot
selects the `per_slot` minimal ones of its own, or, where a short text gives it fewer, goes on with those of the next
slots, round the end; it puts them back in text order, and hashes that tuple. So each slot's tuple tells an order in
every text of `per_slot` k-mers or more. Two fingerprints are as alike as the share of slots that agree: a slot agrees
only if both texts have the same minimal k-mers in the same order, which moves and edits break.

A fingerprint is computed within its row; only the neighbour's text is shuffled. In one packed number the upper 36 bits
are a hash and the lower 28 a position: that is exact for 268 million tokens, more than an array of a row can hold.

Defined cases: null and empty text have no k-mer and the fingerprint of empty slots; two such are alike with 1, one
such and another text with 0. A text of fewer tokens than k is one k-mer. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WS

_BITS = 28
_POS = (1 << _BITS) - 1
_EMPTY = "." * 8


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kmers(tokens: Column, k: int) -> Column:
    """Packed hash and place of each run of k tokens."""
    n = F.size(tokens)
    whole = F.array(F.xxhash64(F.array_join(tokens, "")).bitwiseAND(F.lit(~_POS)))
    ends = F.transform(tokens, lambda t, i: F.when(i + k <= n, F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]).bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(_POS)))))
    return F.when(n == 0, F.array().cast("array<long>")).when(n < k, whole).otherwise(F.slice(ends, 1, F.greatest(n - (k - 1), F.lit(1))))


def _same(a: Column, b: Column) -> Column:
    return F.shiftright(a, _BITS) == F.shiftright(b, _BITS)


def _numbered(sorted_kmers: Column, longest: int = _BITS - 1) -> Column:
    """From k-mers in order of hash: packed hash of (k-mer, occurrence) and place. The occurrence is how far back the
    run of equal hashes goes, found by halving; only k-mers that follow an equal one look."""
    steps = F.array(*[F.lit(1 << b) for b in range(longest, -1, -1)])

    def one(x: Column, i: Column) -> Column:
        def back(far: Column, step: Column) -> Column:
            at = i - far - step
            return F.when((at >= 0) & _same(F.get(sorted_kmers, F.greatest(at, F.lit(0))), x), far + step).otherwise(far)

        occurrence = F.when((i > 0) & _same(F.get(sorted_kmers, F.greatest(i - 1, F.lit(0))), x), F.aggregate(steps, F.lit(0), back)).otherwise(F.lit(0))
        return F.xxhash64(F.shiftright(x, _BITS), occurrence).bitwiseAND(F.lit(~_POS)).bitwiseOR(x.bitwiseAND(F.lit(_POS)))

    return F.transform(sorted_kmers, one)


def _cut(run: Column, reach: int = 2) -> Column:
    """A long run in pieces that its own characters decide."""

    def pieces(chars: Column) -> Column:
        def of(hashes: Column) -> Column:
            def ends(h: Column, i: Column) -> Column:
                beside = [F.coalesce(F.get(hashes, i + d), h) for d in range(-reach, reach + 1) if d]
                return F.when(h <= F.least(*beside), i + 1)

            cuts = F.filter(F.transform(hashes, ends), lambda x: x.isNotNull())
            return _let(F.concat(F.array(F.lit(0)), cuts), lambda at: F.transform(at, lambda x, j: F.array_join(F.slice(chars, x + 1, F.coalesce(F.get(at, j + 1), F.size(chars)) - x), "")))

        # a pair is numbered by its first character: the piece ends between the two
        pairs = F.transform(F.slice(chars, 1, F.size(chars) - 1), lambda c, i: F.xxhash64(c, F.get(chars, i + 1)))
        return _let(pairs, of)

    return _let(F.split(run, ""), pieces)


def tokens_of(text: Column, token_chars: int) -> Column:
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{WS}]*[^{WS}]+|[{WS}]+"), F.lit(0))
    long = lambda t: F.length(t) > token_chars
    return _let(runs, lambda own: F.when(F.exists(own, long), F.flatten(F.transform(own, lambda t: F.when(long(t), _cut(t)).otherwise(F.array(t))))).otherwise(own))


def fingerprint(text: Column, k: int = 2, slots: int = 64, per_slot: int = 2, token_chars: int = 16) -> Column:
    """array<string> of `slots` hashes of 8 hexadecimal digits, dots where the text has no k-mer."""
    bits = int(math.log2(slots))
    if 1 << bits != slots:
        raise ValueError("slots must be a power of two")
    slot = lambda x: F.shiftright(x, 64 - bits)  # noqa: E731  signed: from -slots/2
    least = lambda s: F.filter(s, lambda x, i: (i < per_slot) | (slot(F.get(s, F.greatest(i - per_slot, F.lit(0)))) != slot(x)))

    def tuples(chosen: Column) -> Column:
        def of(round_: Column) -> Column:
            def told(n: Column) -> Column:
                before = F.size(F.filter(chosen, lambda x: slot(x) < n))
                own = F.slice(round_, before + 1, F.least(F.size(chosen), F.lit(per_slot)))
                in_order = F.array_sort(own, lambda a, b: (a.bitwiseAND(F.lit(_POS)) - b.bitwiseAND(F.lit(_POS))).cast("int"))
                said = F.array_join(F.transform(in_order, lambda x: F.shiftright(x, _BITS).cast("string")), ",")
                return F.lower(F.substring(F.lpad(F.hex(F.xxhash64(said)), 16, "0"), 1, 8))

            return F.transform(F.sequence(F.lit(-slots // 2), F.lit(slots // 2 - 1)), told)

        return F.when(F.size(chosen) == 0, F.array_repeat(F.lit(_EMPTY), slots)).otherwise(_let(F.concat(chosen, F.slice(chosen, 1, per_slot)), of))

    return _let(tokens_of(text, token_chars), lambda t: _let(F.sort_array(_kmers(t, k)), lambda s: _let(F.sort_array(_numbered(s)), lambda h: _let(least(h), tuples))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots filled in either that agree; 1 if neither has any."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    filled = F.size(F.filter(pairs, lambda p: (p["a"] != _EMPTY) | (p["b"] != _EMPTY)))
    equal = F.size(F.filter(pairs, lambda p: (p["a"] != _EMPTY) & (p["a"] == p["b"])))
    return F.when(filled == 0, F.lit(1.0)).otherwise(equal / filled)


def with_next(df: DataFrame, id_col: str, carry: list[str], derive: dict[str, Column] | None = None, rows_per_block: int = 500, ranges: int = 64, most_cuts: int = 4096) -> DataFrame:
    """df with the columns `derive`, and next_<c> for each c in `carry` and `derive`: the value in the next row in descending order of id; after the last, the first.

    Rows go to blocks by id: `ranges` ranges of about as many rows each, every one cut by quantiles of its own to about
    rows_per_block rows, or to most_cuts blocks if that makes more. A window looks ahead within the block, and the first
    row of each block is also given to the block before it. Null ids come last. Rows of one id follow each other in order
    of the carried values, in one block."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = df.withColumn("_key", key)
    stats = rows.agg(F.count("*"), F.percentile_approx("_key", [n / ranges for n in range(1, ranges)], 10_000)).first()
    edges = sorted(set(stats[1] or []))
    cuts = min(most_cuts, max(1, round(stats[0] / ranges / rows_per_block)))
    # the number of a range or block falls as the id falls, so that they follow each other in descending order
    of_range = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("_key"))) if edges else F.lit(0)
    rows = rows.withColumn("_range", of_range)
    if cuts > 1:
        inner = rows.groupBy("_range").agg(F.percentile_approx("_key", [n / cuts for n in range(1, cuts)], 10 * cuts).alias("_inner"))
        rows = rows.join(F.broadcast(inner), "_range")  # at most `ranges` rows of most_cuts numbers
        place = F.size(F.filter("_inner", lambda e: e < F.col("_key")))
    else:
        place = F.lit(0)
    rows = rows.withColumn("_block", F.col("_range").cast("long") * cuts + place).drop("_inner")
    # heads are linked within their range, and the ranges' first and last ones over all ranges, which are few
    heads = rows.groupBy("_range", "_block").agg(F.max("_key").alias("_key"))
    above = heads.withColumn("_to", F.lead("_block").over(Window.partitionBy("_range").orderBy("_block")))
    firsts = heads.groupBy("_range").agg(F.min("_block").alias("_first")).withColumn("_up", F.lead("_first").over(Window.orderBy("_range")))
    firsts = firsts.withColumn("_up", F.coalesce("_up", F.min("_first").over(Window.partitionBy())))
    given = above.join(F.broadcast(firsts), "_range").select("_key", F.coalesce("_to", "_up").alias("_to"))
    if ranges * cuts * 32 < 8 << 20:
        given = F.broadcast(given)
    heads_of = rows.join(given, "_key").drop("_block").withColumnRenamed("_to", "_block").withColumn("_given", F.lit(True))
    derive = derive or {}
    # derived here, after the few heads are found, so that each row's are computed once
    both = rows.withColumn("_given", F.lit(False)).unionByName(heads_of).drop("_range").withColumns(derive)
    within = Window.partitionBy("_block").orderBy(F.asc("_given"), F.desc("_key"), *[F.asc(c) for c in carry])
    return both.withColumns({f"next_{c}": F.lead(c).over(within) for c in [*carry, *derive]}).where(~F.col("_given")).drop("_key", "_given", "_block")


def edit_pairs(df: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """For each row: n_chars, its text's fingerprint, an edited text (its last half replaced by as much of the next
    text's start) with its fingerprint, and the likeness to that and to the next text."""
    rows = df.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text"))
    # compact on the way: the slots' digits in one string
    rows = with_next(rows, id_col, ["text"], {"fp": F.array_join(fingerprint(F.col("text"), **params), "")})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_fp", fingerprint(F.col("edited"), **params))
    split = lambda c: F.regexp_extract_all(F.col(c), F.lit("(.{8})"), F.lit(1))
    return rows.withColumn("near_edited", likeness(split("fp"), F.col("edited_fp"))).withColumn("near_next", likeness(split("fp"), split("next_fp"))).withColumn("edited_fp", F.array_join("edited_fp", ""))
