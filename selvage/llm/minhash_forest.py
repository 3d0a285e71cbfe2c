"""Near-duplicate groups by an LSH forest over word shingles, every link confirmed on the full sets.

Each text has one signature of minima. A tree of the forest orders the texts by the signature, begun at the tree's own
place and going round; the neighbours of a text are those with the longest common prefix. A region is what shares a
prefix: it starts at `shallow` minima and, while it holds more than `region` texts, is cut at a greater depth, so dense
parts of the order are compared at long prefixes first, and sparse parts at short ones. A region that is cut also
compares each of its texts with its smallest one. When the links of these pairs are known, the texts of all cut regions
that still hold several groups are joined on their rarest shingles, a prefix filter that loses no link, so what lies on
both sides of a cut is compared whole, and no region's texts meet all others.

Within a region the signatures estimate all likenesses; the surely alike are reduced to a spanning tree, and of the
rest all pairs go on that are not surely below the threshold. Pairs are confirmed on full sets in rounds: first the
best one of each text, then all that still join different groups.

The order of shingles is by the number of texts in their bucket, one of `buckets` (8 MB to every task, whatever the
corpus), and then by hash: any order is exact, a finer one only makes fewer candidates.

Copies (equal sets) are one node from the start, so a group of copies never meets in one task.

Defined cases: null and empty text, or text without words, has no shingle and is linked with nothing; rows of one id
are one document, linked if any of its texts is; a row without id is linked with nothing, its group is null and it is
kept; other columns pass through, and those of the output's names are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import aside, discard, small_batches, spread_join, written
from .shingles import chunks, minhashes, mix, shingle_sets, slices

_SIGNED = np.int64
_NO_ID = -(1 << 63)


def _signatures(rows: DataFrame, words: int, count: int) -> DataFrame:
    """_id, _r (the text's hash), n_shingles, two hashes of the set, and its signature (32-bit big-endian minima)."""

    def work(batches):
        for batch in slices(batches):
            at = 0
            for run in chunks([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]):
                sets, sizes = shingle_sets(run, words)
                least = minhashes(sets, sizes, count)
                full = sizes > 0
                starts = (np.cumsum(sizes) - sizes)[full]
                two = np.zeros((2, len(run)), np.uint64)
                if len(starts):
                    two[0, full] = mix(np.add.reduceat(mix(sets), starts))
                    two[1, full] = mix(np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), starts))
                raw = least.astype(">u4")
                signature: list[bytes | None] = [None] * len(run)
                for n, i in enumerate(np.flatnonzero(full).tolist()):
                    signature[i] = raw[n].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(run)), batch.column(2).slice(at, len(run)), pa.array(sizes), pa.array(two[0].view(_SIGNED)), pa.array(two[1].view(_SIGNED)), pa.array(signature, pa.binary())],
                    names=["_id", "_r", "n_shingles", "_s1", "_s2", "_sig"],
                )
                at += len(run)

    return rows.mapInArrow(work, "_id long, _r long, n_shingles long, _s1 long, _s2 long, _sig binary")


def _region_pairs(rows: DataFrame, threshold: float, count: int) -> DataFrame:
    """rows: _h, _node, _n, _sig, each region's in one partition and in order. Gives a, b (b smaller) and the estimate."""
    sure, least = min(1.0, threshold + 4 * (threshold * (1 - threshold) / count) ** 0.5), threshold - 4.2 * (threshold * (1 - threshold) / count) ** 0.5

    def pairs_of(frame: pd.DataFrame) -> pd.DataFrame:
        h = frame["_h"].to_numpy()
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        sizes = np.diff(np.append(starts, len(h)))
        node, n = frame["_node"].to_numpy(), frame["_n"].to_numpy()
        sig = np.frombuffer(b"".join(frame["_sig"]), ">u4").reshape(len(h), count).astype(np.uint32)
        # each row with those before it in its region
        place = np.arange(len(h)) - np.repeat(starts, sizes)
        right = np.repeat(np.arange(len(h)), place)
        left = right - 1 - (np.arange(len(right)) - np.repeat(np.cumsum(place) - place, place))
        keep = (np.minimum(n[left], n[right]) >= threshold * np.maximum(n[left], n[right])) & (node[left] != node[right])
        left, right = left[keep], right[keep]
        alike = np.empty(len(left))
        for at in range(0, len(left), 20_000):
            alike[at : at + 20_000] = (sig[left[at : at + 20_000]] == sig[right[at : at + 20_000]]).mean(1)
        keep = alike >= least
        left, right, alike = left[keep], right[keep], alike[keep]
        # the surely alike: a spanning tree, the most alike first
        above = np.arange(len(h))

        def top(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        chosen = []
        certain = np.flatnonzero(alike >= sure)
        for k in certain[np.argsort(-alike[certain], kind="stable")].tolist():
            a, b = top(left[k]), top(right[k])
            if a != b:
                above[max(a, b)] = min(a, b)
                chosen.append(k)
        tops = np.array([top(i) for i in range(len(h))], np.int64) if len(certain) else above
        chosen = np.concatenate([np.array(chosen, np.int64), np.flatnonzero((alike < sure) & (tops[left] != tops[right]))])
        a, b = node[left[chosen]], node[right[chosen]]
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b), "alike": alike[chosen]})

    def work(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            last = frame["_h"].iloc[-1]
            cut = int(np.searchsorted(frame["_h"].to_numpy(), last))
            rest = frame.iloc[cut:].reset_index(drop=True)
            if cut:
                yield pairs_of(frame.iloc[:cut].reset_index(drop=True))
        if rest is not None and len(rest):
            yield pairs_of(rest)

    return rows.mapInPandas(work, "a long, b long, alike double")


def _hub_pairs(rows: DataFrame, threshold: float, count: int) -> DataFrame:
    """rows: _node, _n, _sig, _hub, _hub_n, _hub_sig. The pairs that aren't surely below the threshold."""
    least = threshold - 4.2 * (threshold * (1 - threshold) / count) ** 0.5

    def work(frames):
        for frame in frames:
            if not len(frame):
                continue
            one, two = (np.frombuffer(b"".join(frame[c]), ">u4").reshape(-1, count) for c in ("_sig", "_hub_sig"))
            alike = (one == two).mean(1)
            n, m = frame["_n"].to_numpy(), frame["_hub_n"].to_numpy()
            keep = (alike >= least) & (np.minimum(n, m) >= threshold * np.maximum(n, m))
            a, b = frame["_node"].to_numpy()[keep], frame["_hub"].to_numpy()[keep]
            yield pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b), "alike": alike[keep]})

    return rows.mapInPandas(work, "a long, b long, alike double")


def _depths(shallow: int, count: int) -> list[int]:
    out = [shallow]
    while out[-1] < count:
        out.append(min(count, out[-1] * 2))
    return out


def candidates(nodes: DataFrame, threshold: float, trees: int, count: int, region: int, shallow: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """a, b, alike: pairs to confirm first; the texts of the regions cut at `shallow` (_h, _node), in which those cut deeper lie; and tables to discard in the end. nodes: _node, _n, _sig, a written table."""
    step = count // trees
    round_sig = F.concat("_sig", "_sig")
    active = nodes.select("_node", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_tree"), "_sig")
    levels, stars, cut = [], [], None
    for depth in _depths(shallow, count):
        prefix = F.xxhash64("_tree", round_sig.substr(1 + F.col("_tree") * (4 * step), F.lit(4 * depth)))
        keyed = active.select("_node", "_tree", prefix.alias("_h"))
        sizes = written(keyed.groupBy("_h").agg(F.count("*").alias("_size"), F.min("_node").alias("_hub")).where("_size > 1"), "sizes")
        met = spread_join(keyed, sizes, ["_h"], sizes.select("_h", F.col("_size").alias("_n")), ["_node"])
        level = written(met.withColumn("_cut", (F.col("_size") > region) | F.lit(depth == count)), "forest")
        discard(sizes)
        levels.append(level)
        large = level.where("_cut")
        if not large.head(1):
            break
        stars.append(large.select("_node", "_hub"))
        cut = large.select("_h", "_node") if cut is None else cut
        active = large.select("_node", "_tree").join(nodes.select("_node", "_sig"), "_node")
    small = reduce(DataFrame.unionByName, [level.where("not _cut") for level in levels]).select("_h", "_node").join(nodes, "_node")
    pairs = _region_pairs(small.select("_h", "_node", "_n", "_sig").repartition("_h").sortWithinPartitions("_h", "_node"), threshold, count)
    if stars:
        pairs = pairs.unionByName(_with_hubs(reduce(DataFrame.unionByName, stars), nodes, threshold, count))
    out = written(pairs.where("a <> b").groupBy("a", "b").agg(F.max("alike").alias("alike")), "pairs")
    return out, cut, levels


def _tally(rows: DataFrame, key: str) -> DataFrame:
    """key and _n, how many rows a key has. rows: a written table."""
    return rows.groupBy(key).agg(F.count("*").alias("_n"))


def _with_hubs(stars: DataFrame, nodes: DataFrame, threshold: float, count: int) -> DataFrame:
    """The pairs of _node, _hub that may be linked."""
    stars = written(stars.where("_node <> _hub").distinct(), "stars")
    hubs = nodes.select(F.col("_node").alias("_hub"), F.col("_n").alias("_hub_n"), F.col("_sig").alias("_hub_sig"))
    met = spread_join(stars.join(nodes, "_node"), hubs, ["_hub"], _tally(stars, "_hub"), ["_node"])
    return _hub_pairs(met.select("_node", "_n", "_sig", "_hub", "_hub_n", "_hub_sig"), threshold, count)


def _commonness(texts: DataFrame, words: int, buckets: int, width: int = 1 << 12) -> np.ndarray:
    """How many texts hold a shingle of each bucket (its hash, modulo `buckets`, a power of two). texts: _text.

    Each task counts what it reads and gives a row for each run of `width` buckets; tasks that share out the runs add them up, a batch at a time."""
    width = min(width, buckets)

    def work(batches):
        held = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for run in chunks([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]):
                held += np.bincount((shingle_sets(run, words)[0] & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        for part in range(0, buckets, width):
            at = np.flatnonzero(held[part : part + width])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([at.astype("<i4").tobytes()]), pa.array([held[part + at].astype("<i8").tobytes()])], names=["_run", "_at", "_c"])

    def add(batches):
        sums = {}
        for batch in batches:
            for part, at, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums.setdefault(part, np.zeros(width, np.int64))[np.frombuffer(at, "<i4")] += np.frombuffer(counts, "<i8")
        for part, held in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([held.astype("<i8").tobytes()])], names=["_run", "_c"])

    counted = texts.select("_text").mapInArrow(work, "_run long, _at binary, _c binary")
    found = counted.repartition("_run").mapInArrow(add, "_run long, _c binary").toArrow()  # `buckets` numbers at most
    out = np.zeros(buckets, np.int64)
    for part, held in zip(found["_run"].to_pylist(), found["_c"].to_pylist()):
        out[part : part + width] = np.frombuffer(held, "<i8")
    return out


def _prefixes(texts: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """_s, _node, _group, _n, _place, _first: the rarest shingles of each text, in order of their bucket's texts and then their hash. texts: _node, _group, _text.

    Of two linked texts, the smaller one shares one of its first n - ceil(2pn / (100 + p)) + 1 shingles (_first) with the
    first n - ceil(pn / 100) + 1 of the other, as the order is the same for all. A shingle that is alone in its bucket meets none."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def work(batches):
        counts = shared.value
        for batch in slices(batches):
            at = 0
            for run in chunks([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]):
                sets, sizes = shingle_sets(run, words)
                ends, out = np.cumsum(sizes), []
                for i, n in enumerate(sizes.tolist()):
                    own = sets[ends[i] - n : ends[i]]
                    times = counts[(own & np.uint64(len(counts) - 1)).astype(np.int64)]
                    order = np.lexsort((own, times))[: n + percent * -n // 100 + 1]
                    place = np.flatnonzero(times[order] > 1)
                    first = place < n + 2 * percent * -n // (100 + percent) + 1
                    out.append((own[order[place]].view(_SIGNED), np.full(len(place), i), place, first))
                s, i, place, first = (np.concatenate(x) for x in zip(*out))
                row = pa.array(at + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s), batch.column(0).take(row), batch.column(1).take(row), pa.array(sizes[i]), pa.array(place), pa.array(first)],
                    names=["_s", "_node", "_group", "_n", "_place", "_first"],
                )
                at += len(run)

    return texts.select("_node", "_group", "_text").mapInArrow(work, "_s long, _node long, _group long, _n long, _place long, _first boolean")


def _rest_pairs(cut: DataFrame, nodes: DataFrame, groups: DataFrame, rows: DataFrame, sets: DataFrame, threshold: float, count: int, buckets: int, words: int, percent: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """a, b, alike: all pairs of different groups that may be linked, among the texts (_h, _node) of regions of several groups; these texts (_node, _text); and tables to discard in the end.

    A prefix join: texts meet by their rarest shingles only, so what thousands share is no key. Of the texts of a shingle,
    those outside of its largest group meet all others, so the texts of one group never meet each other by its pairs."""
    rest = written(cut.join(groups.withColumnRenamed("node", "_node"), "_node", "left").select("_h", "_node", F.coalesce("label", "_node").alias("_group")), "rest")
    mixed = written(rest.groupBy("_h").agg(F.min("_group").alias("_least"), F.max("_group").alias("_most"), F.count("*").alias("_n")).where("_least <> _most").select("_h", "_n"), "regions")
    asked = written(spread_join(rest, mixed.select("_h"), ["_h"], mixed, ["_node"]).select("_node", "_group").distinct(), "asked")
    texts = _texts_for(rows, asked.select(F.col("_node").alias("_id")), sets)
    with small_batches(rows.sparkSession):
        common = _commonness(texts, words, buckets)
        keys = written(_prefixes(texts.join(asked, "_node"), words, percent, common), "prefixes")
    of_group = keys.groupBy("_s", "_group").agg(F.count("*").alias("_c"))
    of_key = written(of_group.groupBy("_s").agg(F.max_by("_group", F.struct("_c", "_group")).alias("_top"), F.count("*").alias("_groups"), F.sum("_c").alias("_n")).where("_groups > 1").drop("_groups"), "keys")
    shared = written(spread_join(keys, of_key.select("_s", "_top"), ["_s"], of_key.select("_s", "_n"), ["_node"]), "shared")
    one = shared.where("_group <> _top").select("_s", *[F.col(c).alias(f"{c}1") for c in ("_node", "_group", "_n", "_place", "_first")])
    met = spread_join(shared, one, ["_s"], of_key.select("_s", "_n"), ["_node"]).where((F.col("_group") != F.col("_group1")) & ((F.col("_group") == F.col("_top")) | (F.col("_node") < F.col("_node1"))))
    small, large = F.least("_n", "_n1"), F.greatest("_n", "_n1")
    # what both have from here on, at most
    left = F.least(F.col("_n") - F.col("_place"), F.col("_n1") - F.col("_place1"))
    first = F.when(F.col("_n") < F.col("_n1"), F.col("_first")).when(F.col("_n") > F.col("_n1"), F.col("_first1")).otherwise(F.col("_first") & F.col("_first1"))
    met = met.where((100 * small >= percent * large) & (left * (100 + percent) >= percent * (small + large)) & first)
    pairs = met.select(F.col("_node"), F.col("_node1").alias("_hub"))
    out = written(_with_hubs(pairs, nodes, threshold, count), "pairs")
    return out, texts, [rest, mixed, asked, texts, keys, of_key, shared, out]


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """ka, kb of the pairs (a, b, ka, kb) whose full sets have 100 * intersection >= percent * union. texts: _node, _text."""

    def work(batches):
        for batch in slices(batches):
            a, b = batch.column(0), batch.column(1)
            couples = [tuple(x.encode("utf-8", "surrogatepass") for x in pair) for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            good = []
            for run in chunks(couples, 1_000_000):
                sets, sizes = shingle_sets([x for pair in run for x in pair], words)
                ends = np.cumsum(sizes)
                for i in range(0, len(sizes), 2):
                    one, two = sets[ends[i] - sizes[i] : ends[i]], sets[ends[i] : ends[i + 1]]
                    inner = len(np.intersect1d(one, two, assume_unique=True))
                    good.append(100 * inner >= percent * (len(one) + len(two) - inner))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], names=["a", "b"])

    one = texts.select(F.col("_node").alias("a"), F.col("_text").alias("one"))
    two = texts.select(F.col("_node").alias("b"), F.col("_text").alias("two"))
    # a text of many pairs is given to many tasks
    pairs = written(pairs.select("a", "b", "ka", "kb"), "asked")
    met = spread_join(pairs, one, ["a"], _tally(pairs, "a"), ["b"])
    met = spread_join(met, two, ["b"], _tally(pairs, "b"), ["a"])
    return met.select("ka", "kb", "one", "two").mapInArrow(work, "a long, b long")


def roots(parents: DataFrame) -> DataFrame:
    """node, label of a forest given as node, label (a smaller node, one for each; a written table): labels' labels, until nothing changes."""
    labels = parents
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        met = spread_join(labels, jump, ["label"], _tally(labels, "label"), ["node"], "left")
        new = written(met.select("node", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")), "labels")
        discard(labels)
        moved, labels = new.where("moved").head(1), new
        if not moved:
            return labels.select("node", "label")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node it reaches) of every node with an edge: each takes its neighbours' smallest label and that label's label."""
    both = written(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    ends = _tally(both, "b")
    while True:
        near = spread_join(both, labels.withColumnRenamed("node", "b"), ["b"], ends, ["a"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        met = spread_join(own, jump, ["label"], _tally(labels, "label"), ["node"], "left")  # as large as the labels were a step before
        new = written(met.select("node", "old", F.least("label", "further").alias("label")), "labels")
        changed = new.where("old <> label").head(1)
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels.select("node", "label")


def _between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs of texts of different groups (node, label), with these as ka, kb. A text without a group is its own."""
    label = lambda c: groups.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    both = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return both.select("a", "b", "alike", F.coalesce("a_label", "a").alias("ka"), F.coalesce("b_label", "b").alias("kb")).where("ka <> kb")


def _onward(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, label) after links (a, b) between groups."""
    if not links.head(1):
        return groups
    further = components(links)
    onward = further.select(F.col("node").alias("label"), F.col("label").alias("_further"))
    moved = spread_join(groups, onward, ["label"], _tally(groups, "label"), ["node"], "left").select("node", F.coalesce("_further", "label").alias("label"))
    return written(moved.unionByName(further.where("node <> label")), "groups")


def _texts_for(rows: DataFrame, ids: DataFrame, sets: DataFrame) -> DataFrame:
    """_node, _text of the nodes among ids (_id). These are sent to all tasks if they take less than 16 MB."""
    needed = written(ids.join(sets.select(F.col("_node").alias("_id"), "_r"), "_id"), "needed")
    few = F.broadcast(needed) if needed.count() * 24 < 16 << 20 else needed
    texts = rows.join(few, ["_id", "_r"], "left_semi").select(F.col("_id").alias("_node"), F.coalesce("_text", F.lit("")).alias("_text"))
    out = written(texts, "texts")
    discard(needed)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, trees: int = 16, count: int = 128, region: int = 40, shallow: int = 2, buckets: int = 1 << 20) -> DataFrame:
    """df with n_shingles, component_id (the smallest id reachable over links) and kept (whether that is the row's own id)."""
    threshold, out_of = percent / 100, ("n_shingles", "component_id", "kept")
    ident, text_hash = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), F.xxhash64(F.col(text))
    rows = df.select(ident.alias("_id"), F.col(text).alias("_text"), text_hash.alias("_r"))
    with small_batches(df.sparkSession):
        signed = written(_signatures(rows, words, count), "signatures")
    # the set decides the number of shingles and the signature
    real = signed.where(F.col("_sig").isNotNull() & (F.col("_id") != _NO_ID))
    sets = written(real.groupBy("_s1", "_s2").agg(F.min("_id").alias("_node"), F.first("n_shingles").alias("_n"), F.first("_sig").alias("_sig"), F.min_by("_r", F.struct("_id", "_r")).alias("_r"), F.count("*").alias("_rows")), "sets")
    nodes = sets.select("_node", "_n", "_sig")
    pairs, cut, levels = candidates(nodes, threshold, trees, count, region, shallow)
    texts = _texts_for(rows, pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), sets)
    used = [*levels, pairs, texts]

    def links_of(asked: DataFrame, texts: DataFrame = texts) -> DataFrame:
        with small_batches(df.sparkSession):
            return written(confirmed(asked, texts, words, percent).distinct(), "links")

    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("alike", -F.col("b"))).alias("b")).withColumns({"ka": F.col("a"), "kb": F.col("b")})
    groups = roots(links_of(best).select(F.col("a").alias("node"), F.col("b").alias("label")))
    groups = _onward(groups, links_of(_between(pairs, groups)))
    if cut is not None:
        more, near, tables = _rest_pairs(cut, nodes, groups, rows, sets, threshold, count, buckets, words, percent)
        used += tables
        if more.head(1):
            # the likeliest of each text first, then those of groups that are still apart
            likeliest = _between(more, groups).groupBy("a").agg(F.max_by(F.struct("b", "ka", "kb"), F.struct("alike", -F.col("b"))).alias("_p")).select("a", "_p.*")
            groups = _onward(groups, links_of(likeliest, near))
            groups = _onward(groups, links_of(_between(more, groups), near))
    component = F.coalesce("label", "_node")
    sets_labels = sets.select("_s1", "_s2", "_node").join(groups.withColumnRenamed("node", "_node"), "_node", "left").select("_s1", "_s2", component.alias("_component"))

    # each id and text once; copies of one text are many, and texts without shingles meet nobody
    once = written(signed.groupBy("_id", "_r").agg(F.first("n_shingles").alias("n_shingles"), F.first("_s1").alias("_s1"), F.first("_s2").alias("_s2"), F.count("*").alias("_rows")), "once")
    full = once.where("n_shingles > 0")
    joined = spread_join(full, sets_labels, ["_s1", "_s2"], sets.select("_s1", "_s2", F.col("_rows").alias("_n")), ["_id", "_r"], "left")
    by_row = joined.select("_id", "_r", "n_shingles", "_component").unionByName(once.where("n_shingles = 0").select("_id", "_r", "n_shingles", F.lit(None).cast("long").alias("_component")))
    # rows of one id share the smallest component of its texts
    of_row = by_row.withColumn("component_id", F.min("_component").over(Window.partitionBy("_id", F.when(F.col("_id") == _NO_ID, F.col("_r"))))).select("_id", "_r", "n_shingles", "component_id")
    of_row = written(of_row, "rows")
    for done in used:
        discard(done)
    put, back = aside(df, out_of)
    # null texts have a hash too, so every row finds its own; rows without id and text may be many
    asked = df.select(*put, ident.alias("_id"), text_hash.alias("_r"))
    out = spread_join(asked.withColumn("_at", F.monotonically_increasing_id()), of_row, ["_id", "_r"], once.select("_id", "_r", F.col("_rows").alias("_n")), ["_at"], "left")
    component = F.when(F.col("_id") != _NO_ID, F.coalesce("component_id", "_id"))
    return out.select(*back, "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))
