"""Fingerprints, WARC records, the queries and the pipeline."""

import gzip
import hashlib
import json
import re
import struct
import sys
from html import unescape

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from selvage.llm import order_minhash, warc

SMALL = "/root/testdata/sf0.001"


def prints(spark, texts, **params):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    rows = df.select("n", order_minhash.fingerprint(F.col("t"), **params).alias("f")).collect()
    return [r["f"] for r in sorted(rows)]


def plain_occurrences(values):
    seen, out = {}, []
    for v in values:
        out.append(seen.get(v, 0))
        seen[v] = out[-1] + 1
    return out


def test_occurrences_are_numbered(spark):
    hashes = sorted([5 << 28] * 7 + [9 << 28 | 1] + [12 << 28] * 3 + [(-4) << 28] * 9)
    keys = [h >> 28 for h in hashes]
    df = spark.createDataFrame([(hashes, plain_occurrences(keys))], "s array<long>, o array<int>")
    expected = F.transform(F.arrays_zip("s", "o"), lambda z: F.xxhash64(F.shiftright(z["s"], 28), z["o"]).bitwiseAND(F.lit(~order_minhash._POS)).bitwiseOR(z["s"].bitwiseAND(F.lit(order_minhash._POS))))
    row = df.select(order_minhash._numbered(F.col("s")).alias("a"), expected.alias("b")).first()
    assert row["a"] == row["b"] and len(set(row["a"])) == len(hashes)


def test_order_and_repeats_count(spark):
    words = [f"word{i}" for i in range(60)]
    swapped = words[30:] + words[:30]
    a, b, c, d, e, f = prints(spark, [" ".join(words), " ".join(words), " ".join(swapped), " ".join(words[:30] * 2), " ".join(words[:-1] + ["other"]), "字" * 400])
    alike = lambda x, y: sum(p == q and p != "." * 8 for p, q in zip(x, y)) / sum(p != "." * 8 or q != "." * 8 for p, q in zip(x, y))
    assert a == b and alike(a, e) > 0.8 and alike(a, c) < 0.95 and alike(a, c) < alike(a, e) and alike(a, d) < alike(a, e)
    assert any(x != "." * 8 for x in f)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def of_text(*texts):
    h = 42
    for t in texts:
        h = xxhash.xxh64_intdigest(t.encode(), h)
    return signed(h)


def plain_tokens(text, token_chars=16, reach=2):
    out = []
    for run in re.findall(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+", text):
        if len(run) <= token_chars:
            out.append(run)
            continue
        hashes = [of_text(a, b) for a, b in zip(run, run[1:])]
        at = [0] + [i + 1 for i, h in enumerate(hashes) if all(h <= hashes[j] for j in range(max(0, i - reach), min(len(hashes), i + reach + 1)))]
        out += [run[a:b] for a, b in zip(at, [*at[1:], len(run)])]
    return out


def plain_fingerprint(text, k=2, slots=64, per_slot=2):
    tokens = plain_tokens(text)
    mask = ~((1 << 28) - 1)
    if not tokens:
        return ["." * 8] * slots
    kmers = [(of_text("".join(tokens)) & mask, 0)] if len(tokens) < k else [(of_text(*tokens[i : i + k]) & mask, i) for i in range(len(tokens) - k + 1)]
    seen, numbered = {}, []
    for h, i in sorted(kmers):
        o = seen.get(h, 0)
        seen[h] = o + 1
        first = xxhash.xxh64_intdigest(struct.pack("<q", h >> 28), 42)
        numbered.append((signed(xxhash.xxh64_intdigest(struct.pack("<i", o), first)) >> 28, i))
    numbered.sort()
    out = []
    for n in range(-slots // 2, slots // 2):
        later = [x for x in numbered if x[0] >> 30 >= n] + [x for x in numbered if x[0] >> 30 < n]
        own = sorted(later[:per_slot], key=lambda x: x[1])
        out.append(f"{of_text(','.join(str(h) for h, _ in own)) & ((1 << 64) - 1):016x}"[:8])
    return out


def test_fingerprints_equal_a_plain_version(spark):
    texts = ["", " ", "a", "one two", "a b a b a b a b", "字" * 300, "".join(chr(97 + i * i % 23) for i in range(700)), "x" * 60 + " \U0001f600 yz" + "-" * 40, "word " * 90, " ".join(f"w{i * i % 37}" for i in range(500)), " " * 50 + "end", "https://example.org/a/long/path?with=query and words"]
    got = prints(spark, texts)
    assert got == [plain_fingerprint(t) for t in texts]


def alike(x, y):
    return sum(p == q for p, q in zip(x, y)) / len(x)


def test_an_edit_is_seen_in_proportion(spark):
    """One character inserted into 3,000: most slots stay, with and without white space. Moved halves of a short text are seen."""
    random = np.random.default_rng(3)
    solid = "".join(chr(97 + i) for i in random.integers(0, 26, 3000))
    spaced = " ".join(solid[i : i + 6] for i in range(0, 3000, 6))
    han = "".join(chr(0x4E00 + i) for i in random.integers(0, 3000, 3000))
    period = "abcdefg" * 430
    short = [f"tok{i}" for i in range(30)]
    texts = [t for s in (solid, spaced, han, period) for t in (s, s[:1500] + "Q" + s[1500:])] + [" ".join(short), " ".join(short[15:] + short[:15])]
    got = prints(spark, texts)
    assert [alike(a, b) > 0.9 for a, b in zip(got[:8:2], got[1:8:2])] == [True] * 4
    assert alike(got[8], got[9]) < 0.75


def test_edit_pairs_follow_the_contract(spark):
    rows = [(5, "abc def ghi jkl"), (9, None), (2, ""), (7, "x" * 50_000), (1, "\U0001f600é one two three"), (8, "abc def ghi jkl"), (None, "no id"), (4, "a"), (3, " ")]
    rows += [(100 + n, f"some text of row {n} " * (n % 13 + 1)) for n in range(300)]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, fp string")
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    for params in ({}, {"rows_per_block": 7, "ranges": 8}, {"rows_per_block": 1, "ranges": 3, "most_cuts": 16}, {"ranges": 400}):
        got = {r["doc_id"]: r for r in order_minhash.with_next(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"], **params).collect()}
        assert len(got) == len(rows)
        for n, (i, _) in enumerate(order):
            assert got[i]["next_text"] == (order[(n + 1) % len(order)][1] or "")
    out = {r["doc_id"]: r for r in order_minhash.edit_pairs(df).collect()}
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert out[i]["edited"] == edited and out[i]["n_chars"] == len(t)
        assert 0 <= out[i]["near_edited"] <= 1 and 0 <= out[i]["near_next"] <= 1
        assert (out[i]["near_edited"] == 1.0) if t == edited else True
    assert out[5]["fp"] == out[8]["fp"] and out[9]["fp"] == out[2]["fp"] != out[3]["fp"]
    assert order_minhash.edit_pairs(df.where("false")).collect() == []
    assert [r["near_next"] for r in order_minhash.edit_pairs(df.where("doc_id = 5")).collect()] == [1.0]


PAGE = "<!DOCTYPE html><html lang='en'><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><p>One<b> two</b></p><div>three &lt;</div><a href='/x'>link</a><img src=i.png><br/>end</body></html>"


def test_derivatives_link_and_keep(spark):
    pages = spark.createDataFrame([(1, "http://h/a", PAGE), (2, None, None), (3, "http://h/b", "plain\n\ntext"), (3, "http://h/b", "plain\n\ntext")], "page_id long, url string, html string")
    responses = warc.responses_of(pages, "2024-01-01T00:00:00Z")
    by_id = {r["record_id"]: r for r in responses.collect()}
    out = warc.derivatives(responses, keep=["page_id", "record_id"]).toPandas()
    assert len(out) == 8 and set(out["warc_type"]) == {"metadata", "conversion"}
    first = out[out["page_id"] == 1].set_index("warc_type")
    assert bytes(first.loc["conversion", "block"]).decode() == "One two\nthree <\nlink\nend"
    about = json.loads(bytes(first.loc["metadata", "block"]))["Envelope"]
    html = about["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert html["Status"] == 200 and html["HTML-Metadata"]["Title"] == "A & B" and html["HTML-Metadata"]["Lang"] == "en"
    assert html["HTML-Metadata"]["Links"] == [{"path": "A@/href", "url": "/x"}, {"path": "IMG@/src", "url": "i.png"}]
    response = by_id[first["refers_to"].iloc[0]]
    source = [(h["name"], h["value"]) for h in about["WARC-Header-Metadata"]]
    assert source[: len(response["headers"])] == [(h["name"], h["value"]) for h in response["headers"]] and ("WARC-Record-ID", response["record_id"]) in source
    assert html["Entity-Digest"] == warc.sha1_digest(PAGE.encode()) and dict(source)["WARC-Block-Digest"] == warc.sha1_digest(bytes(response["block"]))
    for row in out.itertuples():
        headers = {h["name"]: h["value"] for h in row.headers}
        assert headers["WARC-Refers-To"] == row.refers_to in by_id and headers["WARC-Block-Digest"] == row.block_digest == warc.sha1_digest(bytes(row.block))
        assert headers["Content-Length"] == str(len(row.block)) and headers["WARC-Source-Payload-Digest"].startswith("sha1:")
        assert ("WARC-Target-URI" in headers) == (row.target_uri is not None)
    assert warc.derivatives(responses.where("false")).collect() == []


def test_files_round_trip(spark):
    pages = spark.createDataFrame([(n, f"http://h/{n}", f"<p>page {n}\r\n\r\nWARC/1.0 inside</p>") for n in range(5)], "page_id long, url string, html string")
    records = warc.file_bytes(warc.derivatives(warc.responses_of(pages, "2024-01-01T00:00:00Z"))).collect()
    parsed = warc.parse(b"".join(bytes(r["record"]) for r in records))
    assert [(h, b) for h, b in parsed] == [([(x["name"], x["value"]) for x in r["headers"]], bytes(r["block"])) for r in records]


@pytest.mark.parametrize("block", [b"", b"no headers", b"HTTP/1.1 404 Not Found\r\nX: 1", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n\xe9", b"\xff\xfe<a href=x", b"<script>" * 50])
def test_odd_blocks(block):
    records = warc.derived(None, None, None, [], block)
    assert [r[0] for r in records] == ["metadata", "conversion"] and all(r[8] == warc.sha1_digest(r[7]) for r in records)


def test_source_headers_are_kept():
    source = [("warc-warcinfo-id", "<urn:uuid:1>"), ("WARC-Concurrent-To", "<urn:uuid:2>"), ("WARC-Concurrent-To", "<urn:uuid:3>"), ("X-Own", "é"), ("Content-Type", "application/http"), ("WARC-Payload-Digest", "sha1:X")]
    for record in warc.derived("<urn:uuid:0>", "http://h/", None, source, b"HTTP/1.1 200 OK\r\n\r\n<p>x"):
        headers = record[6]
        assert [h for h in headers if h[0].lower() in ("warc-warcinfo-id", "warc-concurrent-to", "x-own")] == source[:4]
        assert ("WARC-Source-Content-Type", "application/http") in headers and ("WARC-Source-Payload-Digest", "sha1:X") in headers
        assert sum(n == "Content-Type" for n, _ in headers) == 1
        if record[0] == "metadata":
            assert [(h["name"], h["value"]) for h in json.loads(record[7])["Envelope"]["WARC-Header-Metadata"]][:6] == source


MARKUP = ["<p>", "</p>", "<![weird[ y ]]>", "<![", "<!", "<!--", "-->", "<?x", "<!DOCTYPE", "<![CDATA[x]]>", "]]>", "<a href='", "'>", "<script>", "</script", "&#xD800;", "&#99999999;", "&amp", "text ", "\x00", "<br/>", "<title>", ">", "\n", "<![if !IE]>", "<![endif]>", "</"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(MARKUP), max_size=25))
def test_any_markup(parts):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + "".join(parts).encode()
    records = warc.derived("r", "u", None, [], block)
    assert [r[0] for r in records] == ["metadata", "conversion"] and json.loads(records[0][7])


def test_what_follows_odd_markup_is_kept():
    for odd in ("<![weird[ y ]]>", "<![if !IE]>", "<!ELEMENT x>", "<?php x ?>"):
        assert b"after" in warc.derived("r", None, None, [], f"<p>before</p>{odd}<p>after</p>".encode())[1][7]


def plain_text(html):
    """Text in lines and links of well-formed markup, by regular expressions."""
    links = re.findall(r"<(?:a|link)\b[^>]*?\bhref=[\"']([^\"']+)[\"']|<(?:img|script)\b[^>]*?\bsrc=[\"']([^\"']+)[\"']", html)
    html = re.sub(r"(?s)<!--.*?-->|<!doctype[^>]*>", "", html, flags=re.I)
    html = re.sub(r"(?is)<(head|script|style|noscript|template)\b[^>]*>.*?</\1\s*>", "", html)
    names = "|".join(sorted(warc._LINES, key=len, reverse=True))
    html = re.sub(rf"(?i)</?(?:{names})\b[^>]*>", "\n", html)
    text = unescape(re.sub(r"<[^>]*>", "", html))
    lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x), [a or b for a, b in links]


def test_all_pages_equal_a_plain_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    out = warc.derivatives(warc.responses_of(pages, "2024-01-01T00:00:00Z"), keep=["page_id"]).select("page_id", "warc_type", "block").collect()
    texts = {r["page_id"]: bytes(r["block"]).decode() for r in out if r["warc_type"] == "conversion"}
    assert set(texts) == set(html)
    same = sum(texts[i] == plain_text(h)[0] for i, h in html.items())
    assert same >= 0.98 * len(html), (same, len(html))
    links = {r["page_id"]: [x["url"] for x in json.loads(bytes(r["block"]))["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"]] for r in out if r["warc_type"] == "metadata"}
    assert sum(links[i] == [unescape(x) for x in plain_text(h)[1]] for i, h in html.items()) >= 0.98 * len(html)


@pytest.mark.parametrize("packed", [False, True])
def test_files_are_read_by_spark(spark, tmp_path, packed):
    pages = spark.createDataFrame([(n, f"http://h/{n}", f"<p>page {n} é\r\n\r\n</p>" * n) for n in range(9)], "page_id long, url string, html string")
    responses = warc.responses_of(pages, "2024-01-01T00:00:00Z").orderBy("page_id").collect()
    for part in range(3):
        records = [warc.to_bytes([(h["name"], h["value"]) for h in r["headers"]], bytes(r["block"])) for r in responses[part * 3 : part * 3 + 3]]
        data = b"".join(gzip.compress(r) for r in records) if packed else b"".join(records)
        (tmp_path / f"{part}.warc{'.gz' if packed else ''}").write_bytes(data)
    got = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert len(got) == 9 and all(r["whole"] for r in got.values())
    for r in responses:
        own = got[r["record_id"]]
        assert own["headers"] == r["headers"] and own["block"] == r["block"] and own["target_uri"] == r["target_uri"] and own["record_type"] == "response"
    again = warc.derivatives(warc.read_warc(spark, str(tmp_path)))
    assert sorted(r["record_id"] for r in again.collect()) == sorted(r["record_id"] for r in warc.derivatives(warc.responses_of(pages, "2024-01-01T00:00:00Z")).collect())


@pytest.mark.parametrize("packed", [False, True])
def test_records_within_blocks_stay_whole(spark, tmp_path, packed):
    def record(name, block, size=None):
        return warc.to_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", name), ("Content-Length", str(len(block) if size is None else size))], block)

    inner = record("<inner>", b"inner block")
    blocks = {"<a>": b"plain", "<b>": inner + record("<c>", inner), "<d>": b"x\r\n\r\nWARC/1.", "<e>": b"", "<f>": b"\r\n\r\nWARC/1.\r\n\r\nWARC/1.0\r\n", "<g>": b"last"}
    data = b"".join(record(n, b) for n, b in blocks.items())
    cut = record("<h>", b"one\r\n\r\nWARC/1.two", 5000)
    (tmp_path / f"x.warc{'.gz' if packed else ''}").write_bytes(gzip.compress(data) if packed else data)
    (tmp_path / f"y.warc{'.gz' if packed else ''}").write_bytes(gzip.compress(cut) if packed else cut)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert {r["record_id"]: bytes(r["block"]) for r in rows if r["whole"]} == blocks
    # the file ends before the record does: its pieces, none of them whole
    assert [r["record_id"] for r in rows if not r["whole"]].count("<h>") == 1 and len(rows) == len(blocks) + 2


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_native_query_has_no_python(spark):
    plan = __spark_entry__.queries()["op7_order_minhash"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline_stages(spark):
    from tests.llm.test_dedup import plain_components, plain_lines

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, SMALL)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
    kept = {r["doc_id"]: r["text"] for r in calm.collect()}
    assert calm.columns == docs.columns and len(kept) >= 150 and len(toxic & kept.keys()) <= len(toxic) * 0.1
    lines = stages["line dedup"](spark, calm, SMALL)
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert lines.columns == docs.columns and got == {i: t for i, t, _, _ in plain_lines(kept.items())}
    unique = stages["near-duplicates"](spark, lines, SMALL)
    left = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert unique.columns == docs.columns and set(left) == {i for i, c in plain_components(got.items()).items() if i == c}
    mixed = stages["mixing"](spark, unique, SMALL)
    copies = [r["doc_id"] for r in mixed.collect()]
    assert mixed.columns == docs.columns and set(copies) == set(left)
    pieces = stages["packing"](spark, mixed, SMALL).collect()
    whole = {}
    for p in pieces:
        whole[p["doc_id"]] = whole.get(p["doc_id"], 0) + p["length"]
    assert set(whole) == set(left) and all(whole[i] % next(p["doc_tokens"] for p in pieces if p["doc_id"] == i) == 0 for i in list(whole)[:20])


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(5)
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (7777, "", "xx", "s", 0), (7778, None, "en", None, None), (7777, "", "xx", "s", 0)], docs.schema))
    for table in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SMALL)
            rows = out.collect()
            assert out.columns == docs.columns if name != "packing" else True
            assert rows or table is not odd


def test_stages_leave_callers_columns_alone(spark):
    own = ["n_dropped", "n_lines", "kept", "component_id", "n_shingles", "rate", "copies", "copy", "n_tokens", "posterior", "toxicity", "_toxicity", "gap", "_copy", "a.b", "_id", "_text", "_own0_"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 40")
    docs = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in own])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in own), name


def test_edited_digest_of_the_query(spark):
    rows = __spark_entry__.queries()["op7_order_minhash"](spark, SMALL).collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()), reverse=True)
    expected = {i: t[: len(t) - len(t) // 2] + texts[(n + 1) % len(texts)][1][: len(t) // 2] for n, (i, t) in enumerate(texts)}
    assert {r["doc_id"]: r["edited_sha256"] for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in expected.items()}


def test_rest_of_the_library_stays_apart():
    import ast
    from pathlib import Path

    root = Path(__file__).parents[2]
    for path in [*root.glob("selvage/**/*.py"), root / "bench.py"]:
        if "llm" in path.parts or not path.exists():
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            named = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in named), path
    assert sys.modules
