"""Near-duplicates and shared lines against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from selvage.llm.line_dedup import LineRuns, drop_shared_lines
from selvage.llm.minhash_forest import components, near_duplicates, roots
from selvage.llm.shingles import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_components(rows):
    """rows: (id, text). The smallest id that each id reaches."""
    sets, above = [(i, shingles(t)) for i, t in rows if i is not None], {i: i for i, _ in rows if i is not None}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and top(i) != top(j):
                above[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in above}


def text(start, n, change=()):
    words = [WORDS[(start * 37 + k * (start % 7 + 1)) % len(WORDS)] for k in range(n)]
    for k in change:
        words[k % n] = f"x{k}"
    return " ".join(words)


def test_shingle_sets_follow_the_definition():
    texts = ["A b c D e f", "a B c d e F", "", " \t ", "one two", "ONE  two\n", "a a a a a a a", "é É ß 字 a b", "x" * 5000 + " b c d e"]
    sets, sizes = shingle_sets([t.encode() for t in texts])
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    ends = sizes.cumsum()
    own = [set(sets[e - s : e].tolist()) for e, s in zip(ends, sizes)]
    assert own[0] == own[1] and own[4] == own[5] and not own[2] and not own[3]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(own[a] & own[b]) == len(shingles(texts[a]) & shingles(texts[b]))


def test_groups_equal_the_plain_version_with_odd_rows(spark):
    rows = [(n, text(n, 80)) for n in range(12)]
    rows += [(100 + n, text(n % 4, 80, [3 * n, 3 * n + 1])) for n in range(40)]  # near copies
    rows += [(200 + n, text(2, 80).upper()) for n in range(60)]  # copies but for case
    rows += [(300, None), (301, ""), (302, "  \n"), (303, "short text"), (304, "Short  TEXT"), (305, "other"), (None, text(1, 80)), (None, None)]
    rows += [(400, "word " * 30_000), (401, "word " * 29_000), (3, text(3, 80))]
    df = spark.createDataFrame([(i, t, "e", 1, 2) for i, t in rows], "doc_id long, text string, _id string, kept int, _text int")
    out = near_duplicates(df, region=6).collect()
    assert len(out) == len(rows)
    expected = plain_components(rows)
    for r in out:
        assert r["n_shingles"] == len(shingles(r["text"]))
        assert r["component_id"] == (None if r["doc_id"] is None else expected[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
        assert r["_id"] == "e" and r["_text"] == 2


def test_a_dense_group_stays_whole(spark):
    """Many near copies of one text, more than a region takes."""
    rows = [(n, text(5, 120, [n % 120, (n * 7) % 120])) for n in range(150)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), region=10).collect()
    expected = plain_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == expected


def grown(family, n=80):
    """Texts that each change a few words of an earlier one."""
    random = np.random.default_rng(family)
    texts = [[f"f{family}w{k}" for k in range(120)]]
    while len(texts) < n:
        own = list(texts[int(random.integers(max(0, len(texts) - 25), len(texts)))])
        for k in random.choice(120, int(random.integers(1, 5)), replace=False):
            own[k] = f"v{len(texts)}x{k}"
        texts.append(own)
    return [(family * 1000 + int(i), " ".join(t)) for i, t in zip(random.permutation(n), texts)]


def test_what_a_cut_parts_is_joined_by_any_pair(spark):
    """Groups of one dense region whose links are with none of the region's smallest texts."""
    families = [grown(f) for f in range(1, 25)]
    out = near_duplicates(spark.createDataFrame([r for f in families for r in f], "doc_id long, text string"), region=6, buckets=1 << 12).collect()
    expected = {i: c for f in families for i, c in plain_components(f).items()}
    assert {r["doc_id"]: r["component_id"] for r in out} == expected


def test_no_link_is_lost_among_templates(spark):
    """Hundreds of texts that share half of their words, so that every region is cut, among them pairs and chains just at the threshold: all groups are those of an exact comparison."""
    random = np.random.default_rng(8)
    base = [f"t{k}" for k in range(100)]
    rows = []
    for n in range(260):
        own = list(base)
        for k in range(0, 100, 9):
            own[k] = f"r{n}x{k}"
        rows.append(own)
        for _ in range(int(random.integers(0, 2))):
            near = list(own)
            for k in random.choice(100, int(random.integers(1, 4)), replace=False):
                near[k] = f"n{len(rows)}x{k}"
            rows.append(near)
    rows = [(int(i), " ".join(t)) for i, t in zip(random.permutation(len(rows)), rows)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), region=8, buckets=1 << 8).collect()
    expected = plain_components(rows)
    assert len(set(expected.values())) > 200
    assert {r["doc_id"]: r["component_id"] for r in out} == expected


def test_one_id_of_several_texts(spark):
    rows = [(1, text(1, 60)), (1, text(2, 60)), (5, text(2, 60, [3])), (6, text(3, 60)), (7, text(1, 60, [50]))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), region=1).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in out) == sorted((i, 6 if i == 6 else 1, len(shingles(t))) for i, t in rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    assert drop_shared_lines(empty).collect() == []


def test_components_of_chains_and_forests(spark):
    chain = spark.createDataFrame([(n + 1, n) for n in range(40)] + [(101, 100)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(chain).collect()} == {**{n: 0 for n in range(41)}, 100: 100, 101: 100}
    forest = chain.select(F.col("a").alias("node"), F.col("b").alias("label"))
    assert {r["node"]: r["label"] for r in roots(forest).collect()} == {**{n: 0 for n in range(1, 41)}, 101: 100}


def plain_lines(rows, least=3, chars=20):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    low = -(1 << 63)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders.setdefault(key(line), set()).add(low if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [k in holders and len(holders[k]) >= least and (low if i is None else i) != max(holders[k]) for k in map(key, lines)]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 3), (4, 2), (7, 3)])
def test_shared_lines_equal_the_plain_version(spark, batches, fanout):
    common, spaced = "A line that very many documents share", "\t a LINE that very many documents share \r"
    rows = [(n, f"{common if n % 3 else spaced}\nonly in document number {n} and nowhere\n{'short' if n % 2 else ''}\n{common}") for n in range(40)]
    rows += [(50 + n, f"twice only, so it stays in both\nx{n}") for n in range(2)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, common), (None, f"{common}\nown line of a row without id"), (7, f"{common}\nsecond row of one id"), (39, common), (63, f"{common}\n" * 2000)]
    rows += [(200 + n, f"abcdefghijklmnopqrst\t{c}\n\t{c} abcdefghijklmnopqrst \x0b") for n in range(4) for c in ["\x85", "\u2028", "\u2029", "\x1c", ""][n:]]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, _h1 int")
    got = [(r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in drop_shared_lines(df, batches=batches, fanout=fanout).collect()]
    assert sorted(got, key=repr) == plain_lines(rows)


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 4, 0, 3, 1]])
def test_runs_are_kept_between_calls(spark, tmp_path, order):
    rng = random.Random(9)
    shared = [f"a line that several documents share {n}" for n in range(12)]
    rows = [(i, "\n".join(rng.sample(shared, 3) + [f"the own line of document {i}", "short"])) for i in range(60)]
    of = lambda n: spark.createDataFrame([r for r in rows if r[0] % 5 == n], "doc_id long, text string")
    folder = str(tmp_path / "runs")
    seen = []
    for n in order:
        got = drop_shared_lines(of(n), folder=folder, name=f"batch {n}").collect()
        seen += [r for r in rows if r[0] % 5 == n]
        # of a batch, what all batches so far say
        assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got), key=repr) == [r for r in plain_lines(sorted(seen)) if r[0] % 5 == n]
    # once more, by another writer: nothing counts twice, and the runs are those of one call over all
    again = [r for n in range(5) for r in drop_shared_lines(of(n), folder=folder, name=f"batch {n}").collect()]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in again), key=repr) == plain_lines(rows)
    runs = LineRuns(spark, folder=folder)
    assert len(runs.runs()) < 5 and sorted(runs.batches) == [f"batch {n}" for n in range(5)]
    runs.close()
    with pytest.raises(ValueError):
        drop_shared_lines(of(0), folder=folder)


def test_lost_call_leaves_runs_as_they_were(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "runs")
    rows = [(i, "a line that all documents share") for i in range(4)]
    first, second = (spark.createDataFrame(rows[n : n + 2], "doc_id long, text string") for n in (0, 2))
    assert [r["n_dropped"] for r in drop_shared_lines(first, folder=folder, name="one").collect()] == [0, 0]

    def lost(self):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(LineRuns, "_tell", lost)
        with pytest.raises(RuntimeError):
            drop_shared_lines(second, folder=folder, name="two")
    runs = LineRuns(spark, folder=folder)
    assert runs.batches == ["one"] and [r["n_docs"] for r in runs.entries(runs.runs()).collect()] == [2]
    runs.close()
    assert sorted(r["n_dropped"] for r in drop_shared_lines(second, folder=folder, name="two").collect()) == [0, 1]


def test_buckets_are_counted_in_few_rows(spark):
    import numpy as np

    from selvage.llm.minhash_forest import _commonness
    from selvage.llm.shingles import shingle_sets

    texts = [" ".join(f"w{(n * k) % 97}" for k in range(1, 40)) for n in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(7)
    want = np.bincount((shingle_sets([t.encode() for t in texts], 5)[0] & np.uint64(1023)).astype(np.int64), minlength=1024)
    assert (_commonness(df, 5, 1024, width=256) == want).all() and (_commonness(df.where("false"), 5, 1024) == 0).all()
