"""Perplexity, toxicity, host reputation and mixing."""

import math
import os
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from selvage.llm import host_reputation, mixing, perplexity, toxicity
from selvage.llm._common import written

WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows_of(n=60):
    """Texts of two languages, some odd."""
    random = np.random.default_rng(3)
    en, de = ["the", "house", "of", "a", "green", "river", "stone"], ["das", "haus", "und", "ein", "gr\u00fcn", "flu\u00df"]
    rows = [(n, " ".join(random.choice(en if n % 2 else de, 40)), "en" if n % 2 else "de") for n in range(n)]
    return [*rows, (900, None, "en"), (901, "", None), (902, "x", None), (903, "the the the the the the the the the the the the", "en"), (904, "qzxv " * 60, "en"), (None, "the house", "en"), (905, rows[1][1], "en")]


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", "a b c d e a b c d e f", "a " * 30, "a b c d e f", "x\ny\nx\n\n\nx\n ", "#1 *2 $% &|<>", "a b c d e f a b c d e f", "one two three four five six one two three four five"])
def test_rule_counts(text):
    import pandas as pd

    got = perplexity.rule_counts.func(pd.Series([text], dtype=object)).iloc[0].tolist()
    assert tuple(got) == plain_counts(text)


def plain_model(texts, order):
    """Modified Kneser-Ney in dictionaries: probability of a byte after a context."""
    top = Counter()
    for t in texts:
        data = b"\x02" * (order - 1) + bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
        for i in range(len(data) - order + 1):
            top[data[i : i + order]] += 1
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, follow = {}, {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            discounts[k] = [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]
        else:
            discounts[k] = [0.5, 1.0, 1.5]
        follow[k] = defaultdict(list)
        for g, v in c.items():
            follow[k][g[:-1]].append(v)

    def p(g, k):
        if k == 0:
            return 1 / 256
        own = follow[k].get(g[:-1])
        if not own:
            return p(g[1:], k - 1)
        d = lambda v: discounts[k][min(v, 3) - 1]
        v = counts[k].get(g, 0)
        return ((v - d(v)) if v else 0) / sum(own) + sum(map(d, own)) / sum(own) * p(g[1:], k - 1)

    return p


@pytest.mark.parametrize("shard_entries", [10**9, 150])
def test_perplexity_equals_a_plain_model(spark, shard_entries):
    rows, order = rows_of(20), 3
    df = spark.createDataFrame(rows, "_id long, _text string, l string").withColumn("_lang", perplexity._lang(F.col("l"))).withColumn("_r", F.xxhash64("_text"))
    model = written(perplexity.kneser_ney(perplexity.count_grams(df.select("_lang", "_text"), order), order), "model")
    asked = df.unionByName(spark.createDataFrame([(5000, "unseen ZZ words \u5b57", "en")], "_id long, _text string, l string").withColumn("_lang", perplexity._lang(F.col("l"))).withColumn("_r", F.xxhash64("_text")))
    got = perplexity.log_perplexity(asked, model, order, shard_entries).collect()
    assert {r["_id"] for r in got} == {r[0] for r in rows} | {5000}
    texts = {(r["_id"], r["_r"]): (r["_text"], r["l"]) for r in asked.collect()}
    for r in got:
        text, lang = texts[r["_id"], r["_r"]]
        p = plain_model([t for _, t, x in rows if x == lang and t], order)
        data = b"\x02" * (order - 1) + bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        expected = -sum(math.log(p(data[i : i + order], order)) for i in range(len(data) - order + 1))
        assert r["_sum"] == pytest.approx(expected, rel=1e-4, abs=1e-3) and r["_bytes"] == len((text or "").encode())


def test_probabilities_of_a_context_sum_to_one(spark):
    df = spark.createDataFrame([(t, "x") for _, t, _ in rows_of(20) if t], "_text string, l string").withColumn("_lang", perplexity._lang(F.col("l")))
    model = perplexity.kneser_ney(perplexity.count_grams(df.select("_lang", "_text"), 3), 3).toArrow()
    keys, values = model["key"].to_numpy(), model["value"].to_numpy()
    order = np.argsort(keys)
    lang = df.first()["_lang"]
    for context in (b"th", b"he", b"qq"):
        grams = np.array([context[0] << 16 | context[1] << 8 | b for b in range(256)], np.int64)
        assert np.exp(perplexity._log_probabilities(grams, lang, keys[order], values[order], 3)).sum() == pytest.approx(1, abs=1e-4)


def test_judge(spark):
    rows = rows_of(300)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, lang string, _bytes int, kept string")
    got = {(r["doc_id"], r["n_words"]): r for r in perplexity.judge(df).collect()}
    assert sum(1 for _ in perplexity.judge(df).collect()) == len(rows)
    for i, t, _ in rows:
        r = got[i, plain_counts(t)[0]]
        assert tuple(r[c] for c in perplexity.COUNTS) == plain_counts(t)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and r["_bytes"] == 1
        if i is not None and i < 300:
            assert r["kept"] or r["base_failed"]  # clean texts stay
    assert perplexity.judge(df.where("false")).collect() == []


def test_a_text_far_out_of_the_band_goes(spark):
    random = np.random.default_rng(1)
    rows = rows_of(300) + [(990, " ".join("".join(chr(33 + int(random.integers(90))) for _ in range(9)) for _ in range(80)), "en")]
    got = {r["doc_id"]: r["kept"] or r["base_failed"] and r["doc_id"] != 990 for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[990] is False and all(got[n] for n in range(300))


def test_judge_gives_every_row_with_many_shards(spark):
    """Repeated rows, rows without id, and rows that differ only in the language or in a carried column."""
    rows = [(*r, 1) for r in rows_of(40)]
    rows += [rows[3], rows[3], (None, "the house", "en", 1), (None, None, "en", 1), (None, None, "en", 1), (*rows[4][:2], "en", 1), (*rows[5][:3], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, own int")
    one, many = perplexity.judge(df, order=3), perplexity.judge(df, order=3, shard_entries=150)
    told = lambda out: sorted((tuple((c, -9 if r[c] is None else round(r[c], 5) if c == "log_perplexity" else r[c]) for c in out.columns) for r in out.collect()), key=repr)
    assert len(told(one)) == len(rows) and told(many) == told(one)


def toxic_rows(n):
    random = np.random.default_rng(5)
    calm = ["river", "stone", "green", "house", "walking", "table", "window", "garden", "other", "music", "paper", "with", "and", "the"]
    bad = ["idiot", "moron", "scumbag", "loser"]
    out = []
    for i in range(n):
        words = list(random.choice(calm, 30))
        if i % 4 == 0:
            words[int(random.integers(30))] = bad[i // 4 % 4] + ("", ".", "s")[i % 3]
        out.append((i, " ".join(words).capitalize() + ".", int(i % 4 == 0)))
    return out


def test_toxicity_held_out_and_disguised(spark):
    rows = toxic_rows(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300] + [(7, None), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(3), labels.repartition(2))
    assert np.array_equal(machine.weights, again.weights) and machine.slope == again.slope
    more = [(1000, "You i.d.i.o.t, walking"), (1001, "what a m o r o n with music"), (1002, "1d1ot and garden"), (1003, "iddiot in the house"), (1004, None), (1005, ""), (1006, "the garden and the river"), (1007, "... 12 %% a"), (1008, "garden " * 50_000 + "idiot")]
    asked = docs.where("doc_id >= 300").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("toxicity", F.lit("x"))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(asked, machine).collect()}
    assert all(0 <= x <= 1 for x in got.values()) and len(got) == 109
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows if i >= 300]) >= 0.97
    assert all(got[i] >= 0.5 for i in (1000, 1001, 1002, 1003, 1008)) and all(got[i] < 0.5 for i in (1004, 1005, 1006, 1007))


@pytest.mark.parametrize("flipped", [range(0, 16, 4), [*range(0, 32, 4), *range(1, 25, 4)]])
def test_toxicity_with_flipped_labels(flipped):
    """Clean labels on texts with each insult, and toxic ones on clean texts."""
    rows = toxic_rows(400)
    machine = toxicity.fit([t for _, t, _ in rows[:300]], [y ^ (i in flipped) for i, _, y in rows[:300]])
    best = np.array([machine.margins([toxicity.word_of(u) for u in toxicity.units_of(t)]).max() for _, t, _ in rows[300:]])
    assert np.mean((machine.score(best) >= 0.5) == [y for _, _, y in rows[300:]]) >= 0.97


def test_toxicity_where_nothing_tells():
    same = ["river stone green", "house table window"] * 10
    assert toxicity.fit(same, [0, 0, 1, 1] * 5).score(np.zeros(1))[0] == pytest.approx(0.5)
    assert toxicity.fit(["river stone"] * 3 + ["... 1"], [1, 1, 1, 0]).score(np.zeros(1))[0] == pytest.approx(0.75)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.train(docs, none)).first()["toxicity"] < 1e-9
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.train(docs, one)).first()["toxicity"] > 0.99
    assert toxicity.score_toxicity(docs.where("false"), toxicity.train(docs, none)).collect() == []


def test_urls_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net/de", "http://x.example.com/de/1", "http://fr.org/fr/a", "http://notexample.net?x", "example.net/en/", None, "", "ftp://h#/en/", "a://b://c/d", "http://forg/fr/", "http://org/fr/", "http://net/", "http://x.net/\ny?z"]
    pages = spark.createDataFrame([(n, u, "own") for n, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in host_reputation.judge_urls(pages, labels, rules).collect()}
    assert [got[n] for n in range(len(urls))] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de", "net/", "block"), ("x.example.com", "/de/1", "example.com/de/", "block"), ("fr.org", "/fr/a", "org/fr/", "allow"), ("notexample.net", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("forg", "/fr/", None, "allow"), ("org", "/fr/", "org/fr/", "allow"), ("net", "/", "net/", "block"), ("x.net", "/\ny", "net/", "block"),
    ]


def test_reputation_shrinks_and_blocks(spark):
    pages = [(n, f"http://bad.one.com/{n}") for n in range(200)] + [(1000 + n, f"http://good.two.com/{n}") for n in range(200)] + [(2000 + n, f"http://new.one.com/{n}") for n in range(3)] + [(3000, "http://rare.three.co.uk/")]
    labels = [(n, 1, 1) for n in range(200)] + [(1000 + n, 1, 0) for n in range(200)] + [(3000, 0, 0), (9999, 0, 1), (5, None, None)]
    judged = host_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [])
    by = {r["host"]: r for r in judged.collect()}
    assert judged.count() == len(pages)
    assert by["bad.one.com"]["verdict"] == "block" and by["good.two.com"]["verdict"] == "allow" and by["rare.three.co.uk"]["verdict"] == "allow"
    assert by["good.two.com"]["bad_rate"] < by["new.one.com"]["bad_rate"] <= by["bad.one.com"]["bad_rate"] and by["new.one.com"]["n_labelled"] == 0
    r = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("host",), ("",), ("co.uk",)], "h string").select(host_reputation.registered(F.col("h")).alias("r")).collect()
    assert [tuple(x["r"]) for x in r] == [("co.uk", "b.co.uk"), ("com", "y.com"), ("host", "host"), ("", ""), ("uk", "co.uk")]


def test_suffixes_from_a_table(spark):
    rules = spark.createDataFrame([("com",), ("co.uk",), ("*.ck",), ("!www.ck",), ("Blog.example.com",), ("",)], "rule string")
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "x.y.com": ("com", "y.com"), "me.blog.example.com": ("blog.example.com", "me.blog.example.com"), "example.com": ("com", "example.com"), "a.b.c.ck": ("c.ck", "b.c.ck"), "a.www.ck": ("ck", "www.ck"), "www.ck": ("ck", "www.ck"), "c.ck": ("c.ck", "c.ck"), "host": ("host", "host"), "": ("", ""), "a.b.net": ("net", "b.net"), "co.uk": ("co.uk", "co.uk"), ".".join("x" * 3000) + ".com": ("com", "x.com")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: (r["suffix"], r["domain"]) for r in host_reputation.with_domains(df, rules).collect()} == hosts
    pages, labels = [(n, f"http://h{n}.bad.co.uk/") for n in range(20)], [(n, 0, 0) for n in range(20)]
    judged = host_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [], suffixes=rules).collect()
    assert len(judged) == 20 and {r["verdict"] for r in judged} == {"block"}


def test_a_hot_host_is_whole(spark):
    pages = [(n, f"http://hot.example.org/{n % 7}" if n % 3 else (None if n % 2 else f"http://h{n}.net/x"), n) for n in range(3000)] + [(None, "http://hot.example.org/", 1)] * 50
    labels = [(n, 0, 1) for n in range(0, 3000, 5)]
    judged = host_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string, host long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), []).collect()
    assert sorted(map(str, (r["page_id"] for r in judged))) == sorted(map(str, (p[0] for p in pages)))
    hot = {(r["n_labelled"], r["verdict"]) for r in judged if r["host"] == "hot.example.org"}
    assert hot == {(sum(1 for n in range(3000) if n % 3 and n % 5 == 0), "block")}


def test_mixing_meets_targets(spark):
    random = np.random.default_rng(2)
    kinds = [("prose", "abcdefgh "), ("code", "{}();=+_"), ("tables", "0123456|")]
    rows = [(i, "".join(random.choice(list(kinds[k][1] + " "), 300)), kinds[k][0]) for i in range(300) for k in [0 if i % 10 < 7 else 1 + i % 2]]
    df = spark.createDataFrame([(*r, 1.5) for r in rows] + [(900, None, "prose", 1.5), (901, "", "prose", 1.5), (None, "abc abc", "prose", 1.5)], "doc_id long, text string, domain string, rate double")
    targets = {"prose": 0.4, "code": 0.35, "tables": 0.25}
    weights = mixing.train(df, df.where("doc_id < 150 or doc_id is null"), F.col("domain"), list(targets))
    for least in (0.0, 1.0):
        got = mixing.mix(df, weights, targets, WORDS, least_rate=least).collect()
        assert len(got) == 303 and all(r["rate"] >= least and abs(r["rate"] - r["copies"]) <= 1 for r in got)
        assert all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in got)
        totals = np.sum([np.array(r["posterior"]) * r["rate"] * r["n_tokens"] for r in got], axis=0)
        assert totals / totals.sum() == pytest.approx(list(targets.values()), abs=2e-3)
        right = [max(range(3), key=lambda k: r["posterior"][k]) == list(targets).index(r["domain"]) for r in got if r["doc_id"] is not None and 150 <= r["doc_id"] < 300]
        assert np.mean(right) > 0.95
        assert got[0]["gap"] == pytest.approx([t / totals.sum() - s for t, s in zip(totals, targets.values())], abs=1e-3)
        library = Tokenizer.from_file(WORDS)
        assert all(r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in got[::20])
    few = mixing.mix(df, weights, targets, WORDS, least_rate=1.0, total=1.0, carry=["doc_id"])
    assert few.columns == ["doc_id", "n_tokens", "posterior", "rate", "copies", "gap"]
    assert {r["rate"] for r in few.collect()} == {1.0} and max(few.first()["gap"]) > 100  # out of reach, and told
    empty = mixing.mix(df.where("false"), weights, targets, WORDS)
    assert empty.collect() == [] and empty.columns.count("rate") == 1
    unlabelled = mixing.train(df, df.where("false"), F.col("domain"), list(targets))
    assert {tuple(np.round(r["posterior"], 9)) for r in mixing.mix(df, unlabelled, targets, WORDS).collect()} == {(0.333333333,) * 3}


def test_rates_equal_a_plain_projected_gradient(spark):
    random = np.random.default_rng(4)
    tokens, p = random.integers(1, 50, 200), random.dirichlet([0.3, 0.3], 200)
    df = written(spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p)], "_tokens long, _p0 double, _p1 double"), "posteriors")
    fit = mixing.fit_rates(df, [0.95, 0.05])
    thetas, want = fit.thetas, fit.want
    rate, ahead, moments = np.ones(200), np.ones(200), (p * tokens[:, None]).T @ p
    for theta, momentum in zip(thetas, mixing.momenta(len(thetas))):
        assert np.linalg.solve(moments, (ahead * tokens) @ p - want) == pytest.approx(theta, rel=1e-6, abs=1e-9)
        moved = np.maximum(0, ahead - p @ theta)
        rate, ahead = moved, moved + momentum * (moved - rate)
    got = np.array([r["r"] for r in df.select(mixing.rate_of(thetas, 0.0).alias("r")).collect()])
    assert np.sort(got) == pytest.approx(np.sort(rate)) and (rate * tokens) @ p == pytest.approx(want, rel=1e-3)


def test_toxicity_machine_is_the_same_in_each_process():
    code = (
        "import hashlib, numpy as np\n"
        "from selvage.llm import toxicity\n"
        "r = np.random.default_rng(3)\n"
        "word = lambda: ''.join(chr(97 + c) for c in r.integers(0, 26, 5))\n"
        "texts = [' '.join([word() for _ in range(12)] + ['idiot'] * (n % 3 == 0)) for n in range(60)]\n"
        "m = toxicity.fit(texts, [int(n % 3 == 0) for n in range(60)], landmarks=32, negatives=100)\n"
        "print(hashlib.sha256(m.weights.tobytes()).hexdigest(), m.offset, m.slope, m.shift)\n"
    )
    root = str(Path(toxicity.__file__).resolve().parents[2])
    said = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed, "PYTHONPATH": root, "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, check=True).stdout for seed in "123"}
    assert len(said) == 1


def plain_subsequences(word, decay, span):
    """Weight of each three characters that the marked word has in order, within `span` characters."""
    marked, out = f"<{word}>", Counter()
    for i in range(len(marked)):
        for j in range(i + 1, len(marked)):
            for k in range(j + 1, min(len(marked), i + span)):
                out[marked[i] + marked[j] + marked[k]] += decay ** (k - i - 2)
    return out


def plain_kernel(a, b, decay, span):
    x, y = plain_subsequences(a, decay, span), plain_subsequences(b, decay, span)
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    return sum(w * y[k] for k, w in x.items()) / max(norm(x) * norm(y), 1e-9)


def test_kernel_equals_a_plain_one():
    words, marks = ["idiot", "idxiot", "idiiot", "aaaa", "abc", "größe", "字字字", "xyz"], ["idiot", "aaa", "größen", "abcabc"]
    # one text's keys may come several times in a word, so rows are summed by key before they are multiplied
    vocabulary = np.unique(toxicity.subsequences([*words, *marks], 0.7, 6)[1])
    rows, at_marks = (toxicity._kernel_rows(x, vocabulary, 0.7, 6).astype(float) for x in (words, marks))
    rows, at_marks = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rows, at_marks))
    assert rows @ at_marks.T == pytest.approx(np.array([[plain_kernel(a, b, 0.7, 6) for b in marks] for a in words]), abs=1e-5)
    assert plain_kernel("idiot", "idxiot", 0.7, 6) > 2 * plain_kernel("idiot", "abcdef", 0.7, 6)


def test_landmarks_span_the_kernel():
    """With every word a landmark the whitened values give the kernel itself."""
    words = [f"word{i}{chr(97 + i)}" for i in range(30)] + ["idiot", "moron"]
    vocabulary = np.unique(toxicity.subsequences(words, 0.7, 6)[1])
    rows = toxicity._kernel_rows(words, vocabulary, 0.7, 6).astype(np.float64)
    kernel = rows @ rows.T
    values, vectors = np.linalg.eigh(kernel)
    use = values > 1e-6 * values.max()
    features = kernel @ (vectors[:, use] / np.sqrt(values[use]))
    assert features @ features.T == pytest.approx(kernel, abs=1e-4)


def test_scores_equal_plain_sums(spark):
    random = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + c) for c in random.integers(0, 26, 5))
    texts = [" ".join([word() for _ in range(12)] + ["idiot"] * (n % 3 == 0)) for n in range(90)]
    machine = toxicity.fit(texts, [int(n % 3 == 0) for n in range(90)], landmarks=32, negatives=100)
    weights = dict(zip(machine.keys.tolist(), machine.weights.tolist()))
    odd = [*texts[:6], "", None, "ab", "i d i o t here", "1d10t!", "idi.xot word", "字字字", "x" * 400]

    def plain(text):
        best = machine.offset
        for unit in set(toxicity.units_of(text)):
            w = toxicity.word_of(unit)
            if len(w) >= 3:
                own = plain_subsequences(w, machine.decay, machine.span)
                terms = Counter()
                for (_, key, weight) in zip(*toxicity.subsequences([w], machine.decay, machine.span)):
                    terms[int(key)] += weight
                squares = sum(float(x) ** 2 for x in toxicity.subsequences([w], machine.decay, machine.span)[2])
                assert sum(terms.values()) == pytest.approx(sum(own.values()))
                best = max(best, machine.offset + sum(weights.get(k, 0.0) * x for k, x in terms.items()) / math.sqrt(squares))
        return 1 / (1 + math.exp(-max(-50, min(50, machine.slope * best + machine.shift))))

    df = spark.createDataFrame([(n, t) for n, t in enumerate(odd)], "n int, text string")
    got = {r["n"]: r["toxicity"] for r in toxicity.score_toxicity(df, machine).collect()}
    assert [got[n] for n in range(len(odd))] == pytest.approx([plain(t) for t in odd], abs=1e-9)
    assert got[9] > 0.5 and got[10] > 0.5 and got[11] > 0.5 and got[7] < 0.5
