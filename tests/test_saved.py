"""What is kept between runs, and actions, groups, ranks and quantiles by plain versions."""

import collections
import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from selvage.functions import columns
from selvage.operators import feedback, names, retrieval
from selvage.sources import saved


def test_master_comes_back(spark, tmp_path):
    master = spark.createDataFrame([("A", "KA158", 1.5), ("B", "KA136", None)], "sku string, season string, rate double")
    audit = spark.createDataFrame([("attributes", 2, 1, 0.5)], "step string, n_left long, n_matched long, share double")
    saved.save_master(master, audit, str(tmp_path))
    got, told = saved.load_master(spark, str(tmp_path))
    assert sorted((r["sku"], r["season"], r["rate"]) for r in got.collect()) == [("A", "KA158", 1.5), ("B", "KA136", None)]
    assert [tuple(r) for r in told.collect()] == [("attributes", 2, 1, 0.5)]
    assert "season=KA158" in "".join(got.where("season = 'KA158'").inputFiles())


def test_feedback_is_appended_and_edited(spark, tmp_path):
    at = str(tmp_path / "feedback")
    saved.append_feedback(spark.createDataFrame([("1", "A", "STAR", "f_rise | pr_too_high"), ("2", "B", "SLOW", None)], "record_id string, sku string, verdict string, reason_tags string"), at, "2026-01-02")
    saved.append_feedback(spark.createDataFrame([("3", "A", "2025-12-31")], "record_id string, sku string, survey_date string"), at, "2026-01-03")
    rows = {r["record_id"]: r for r in saved.read_feedback(spark, at).collect()}
    assert rows["1"]["reason_tag_list"] == ["F_RISE", "PR_TOO_HIGH"] and rows["1"]["survey_date"] == datetime.date(2026, 1, 2) and rows["3"]["survey_date"] == datetime.date(2025, 12, 31) and rows["2"]["reason_tag_list"] == []
    with pytest.raises(Exception, match="no sku"):
        saved.append_feedback(spark.createDataFrame([("4", " ")], "record_id string, sku string"), at, "2026-01-03")
    edits = spark.createDataFrame([("1", 1, False, "OK", None), ("1", 2, False, None, "B"), ("2", 1, True, None, None)], "record_id string, edited_at int, deleted boolean, verdict string, sku string")
    out = {r["record_id"]: (r["sku"], r["verdict"]) for r in saved.edited(saved.read_feedback(spark, at), edits).collect()}
    assert out == {"1": ("B", "OK"), "3": ("A", None)}


def test_an_index_of_another_version_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5, 1.0])], "id long, signature array<double>")
    saved.export_index(rows, str(tmp_path / "i"))
    assert saved.load_index(spark, str(tmp_path / "i")).collect() == rows.collect()
    saved.export_index(rows, str(tmp_path / "old"), version=1)
    with pytest.raises(ValueError, match="version"):
        saved.load_index(spark, str(tmp_path / "old"))


ACTIONS = [(["P_X", "M_Y"], "A_REVISE_FABRIC"), (["M_Y", "P_X"], "A_WATCH"), (["C_A", "C_B", "F_A"], "A_RE_MERCH"), (["F_A", "S_B", "S_C"], "A_REORDER"), (["PR_A"], "A_REPRICE"), (["F_A"], "A_REVISE_FIT"), (["M_A"], "A_WATCH"), (["X_A", "X_B", "F_A"], "A_WATCH"), ([], "A_WATCH")]


def test_actions_of_every_group(spark):
    df = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(ACTIONS)], "n int, t array<string>")
    assert {r["n"]: r["a"] for r in df.select("n", feedback.action_of(F.col("t")).alias("a")).collect()} == {n: a for n, (_, a) in enumerate(ACTIONS)}
    graded = spark.createDataFrame([(n, 2020, "SLOW") for n in range(len(ACTIONS))], "sku int, season int, perf_band string")
    summary = spark.createDataFrame([(n, "SLOW", t) for n, (t, _) in enumerate(ACTIONS)], "sku int, fb_verdict string, fb_tags array<string>")
    assert {r["sku"]: r["action"] for r in feedback.diagnose(graded, summary).collect()} == {n: a for n, (_, a) in enumerate(ACTIONS)}


def plain_chains(residuals):
    """Residuals, shortest first, each to the first group whose members all hold its letters or are held by them."""
    groups = []
    for r in sorted(residuals, key=lambda r: (len(r), r)):
        for g in groups:
            if all(set(r) <= set(x) or set(x) <= set(r) for x in g):
                g.append(r)
                break
        else:
            groups.append([r])
    return groups


def test_names_that_come_again(spark):
    chance = random.Random(5)
    rows = [(n, f"s{n % 3}", "".join(sorted(chance.choices("abcdef", k=chance.randint(0, 5))))) for n in range(240)]
    out = names.duplicate_groups(spark.createDataFrame(rows, "sku long, signature string, residual string"), least=1).collect()
    expected = collections.Counter()
    for s in ("s0", "s1", "s2"):
        own = [(k, r) for k, t, r in rows if t == s]
        for g in plain_chains({r for _, r in own}):
            expected[(s, sum(r in g for _, r in own), min(k for k, r in own if r in g), len(g))] += 1
    assert collections.Counter((r["signature"], r["n"], r["first_key"], r["n_residuals"]) for r in out) == expected


def test_ranks_and_quantiles_without_keys(spark):
    values = [float(int(x)) for x in np.random.default_rng(4).exponential(30, 2000)] + [7.0] * 900 + [None] * 10
    df = spark.createDataFrame([(n, v, n % 3) for n, v in enumerate(values)], "n int, v double, g int")
    known = np.array([v for v in values if v is not None])
    ranks = {r["n"]: r["r"] for r in columns.pct_rank(df, [], "v", "r").collect()}
    for n, v in list(enumerate(values))[::37]:
        assert ranks[n] is None if v is None else ranks[n] == pytest.approx(((known < v).sum() + ((known == v).sum() + 1) / 2) / len(known))
    shares = [0, 0.1, 0.25, 0.5, 0.77, 1]
    assert columns.quantiles(df, [], "v", shares).first()["_edges"] == pytest.approx(np.quantile(known, shares).tolist())
    for r in columns.quantiles(df, ["g"], "v", shares).collect():
        assert r["_edges"] == pytest.approx(np.quantile([v for n, v in enumerate(values) if v is not None and n % 3 == r["g"]], shares).tolist())
    assert columns.quantiles(df.where("false"), [], "v", shares).collect()[0]["_n"] is None


def test_top_lists_and_confidence(spark):
    rows = [(q, i, (i * 7 + q) % 50 / 50, i % 4) for q in range(3) for i in range(40)] + [(9, 1, 0.5, 0), (9, 2, 0.5, 1)]
    pairs = spark.createDataFrame(rows, "query int, id int, similarity double, label int")
    best = {q: sorted(((-s, i) for k, i, s, _ in rows if k == q))[:5] for q in (0, 1, 2, 9)}
    assert {(r["query"], r["rank"]): r["id"] for r in retrieval.top_k(pairs, 5).collect()} == {(q, n + 1): i for q in best for n, (_, i) in enumerate(best[q])}
    narrow = retrieval.top_k(pairs, 3, F.col("label") == 1, least=5).collect()
    assert {r["query"] for r in narrow} == {0, 1, 2, 9} and all(r["label"] == 1 for r in narrow if r["query"] != 9) and len(narrow) == 11
    told = {r["query"]: r for r in retrieval.confidence(pairs).collect()}
    assert told[9]["top"] == told[9]["second"] == 0.5 and told[0]["second"] == sorted((s for q, _, s, _ in rows if q == 0), reverse=True)[1]
    plan = retrieval.top_k(pairs, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
