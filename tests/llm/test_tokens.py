"""Token counts and packing against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from selvage.llm.packing import Tokens, pack, pack_documents, parted, place
from selvage.llm.token_counts import TokenCounter, count_tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n\n", "  a  b\n\n c \n", "<|endoftext|>a<|endoftext|> <|endoftext|>\n", "a" * 3000, "it's don't we'll  'S 'RE", "x\x1c\x1dy\x85z\xa0w 12 34,5 ...!!", "\r\n\t x ", "é" * 999, "字" * 200 + " 字", "ΑΣ ΣΑΣ İI ß ǅ", "é é Å", "x" * 7 + " " * 9, "²½ª µ\xad\x00z", "<|startoftext|>b"]


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(BYTES, remember=50)


@pytest.fixture(scope="module")
def tokens():
    return Tokens(WORDS, remember=50)


def expected(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_counts_of_odd_texts(counter):
    assert counter.count([*ODD, None]) == [*map(len, expected(BYTES, ODD)), 0]


def test_ids_of_odd_texts(tokens):
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(ODD)] == expected(WORDS, ODD)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from(" \n\t'abcsSTxé字1²!<|>endoftext"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_any_texts(counter, tokens, texts):
    assert counter.count(texts) == list(map(len, expected(BYTES, texts)))
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)] == expected(WORDS, texts)


def test_count_operator(spark):
    df = spark.createDataFrame([(n, t, n) for n, t in enumerate([*ODD, None, ODD[5]])], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, BYTES).collect()}
    assert got == dict(enumerate([*map(len, expected(BYTES, ODD)), 0, len(expected(BYTES, ODD)[5])]))
    assert count_tokens(df.where("false"), BYTES).collect() == []


def test_pieces_cover_every_id_once(spark):
    texts = [*ODD, None, "long text " * 6000, *[f"document {n} " * (n % 50) for n in range(200)]]
    df = spark.createDataFrame([(None if n == 3 else n // 2, t) for n, t in enumerate(texts)], "doc_id long, text string")
    pieces = pack_documents(df, WORDS, end=2, shard_bytes=60_000).collect()
    ids = sorted(tuple(x) + (2,) for x in expected(WORDS, [t or "" for t in texts]))
    fills, sequences = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence"], []).append(p)
    for n, own in sequences.items():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0] + [p["length"] for p in own[:-1]]).tolist()
        fills[n] = sum(p["length"] for p in own)
        assert len(own) <= 512
    assert max(fills.values()) <= 4096 and all(f == 4096 or f & (f - 1) == 0 for f in fills.values())
    joined, by_document = [], {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        by_document.setdefault((p["id"], p["doc_tokens"]), []).append(p)
    for own in by_document.values():  # documents of one id and length lie side by side here
        own.sort(key=lambda p: p["start"])
        joined += [np.frombuffer(p["ids"], "<u4").tolist() for p in own]
    assert sum(map(len, joined)) == sum(map(len, ids))
    assert sorted(x for y in joined for x in y) == sorted(x for y in ids for x in y)
    whole = [own for own in by_document.values() if sum(p["length"] for p in own) == own[0]["doc_tokens"]]
    assert all(tuple(np.frombuffer(b"".join(p["ids"] for p in own), "<u4").tolist()) in ids for own in whole) and len(whole) > 100


def test_limits_of_segments_and_loss_hold():
    tokens = np.array([100] * 50 + [1] * 300 + [900] * 20)
    loss = np.array([50] * 50 + [1] * 300 + [0] * 20)
    sequences = place(tokens, loss, (1000, 16, 300), cut=False)
    assert sorted(i for s in sequences for i, _, _ in s) == list(range(len(tokens)))
    for s in sequences:
        assert sum(n for _, _, n in s) <= 1000 and len(s) <= 16 and sum(loss[i] for i, _, _ in s) <= 300
    with pytest.raises(ValueError):
        place(np.array([2000]), np.array([0]), (1000, 16, 300), cut=False)


def test_packing_instruction_examples(spark):
    rows = [(n, n, bytes(4 * (n % 90 + 1)), n % 90 + 1, (n % 90 + 1) // 2) for n in range(400)]
    df = spark.createDataFrame(rows, "id long, deal long, ids binary, n_tokens long, loss_tokens long")
    pieces = pack(df, width=128, max_segments=4, max_loss=64, cut=False, shards=3).collect()
    assert sorted(p["id"] for p in pieces) == list(range(400))
    by = {}
    for p in pieces:
        by.setdefault(p["sequence"], []).append(p)
    assert all(sum(p["length"] for p in s) <= 128 and len(s) <= 4 and sum(p["loss_tokens"] for p in s) <= 64 for s in by.values())
    for s in by.values():
        assert {(p["sequence_tokens"], p["sequence_segments"], p["sequence_loss"]) for p in s} == {(sum(p["length"] for p in s), len(s), sum(p["loss_tokens"] for p in s))}
    assert pack(df.where("false")).collect() == []


def test_checksums_are_those_of_the_ids(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    got = {r["id"]: r["c"] for r in pack_documents(df, WORDS, end=2).select("id", F.crc32("ids").alias("c")).collect()}
    assert got == {1: zlib.crc32(np.array([*expected(WORDS, ["some words here"])[0], 2], "<u4").tobytes()), 2: zlib.crc32(np.array([2], "<u4").tobytes())}


def test_last_lines_bear_loss():
    assert [parted(t) for t in ("", "a b", "a\nb", "a\n\nb c\n \n", "\n", "\nx", "x\n")] == [("", ""), ("a b", ""), ("a", "\nb"), ("a\n", "\nb c\n \n"), ("\n", ""), ("", "\nx"), ("x\n", "")]


@settings(max_examples=100, deadline=None)
@given(
    examples=st.lists(st.tuples(st.integers(1, 400), st.integers(0, 100)), max_size=60),
    limits=st.tuples(st.integers(5, 100), st.integers(1, 6), st.integers(1, 100)),
)
def test_any_examples_keep_all_limits(examples, limits):
    tokens = np.array([n for n, _ in examples], np.int64)
    loss = np.array([n * share // 100 for n, share in examples], np.int64)
    sequences = place(tokens, loss, limits)
    seen = [[] for _ in examples]
    for s in sequences:
        size, bearing = sum(n for _, _, n in s), sum(sum(k >= tokens[i] - loss[i] for k in range(a, a + n)) for i, a, n in s)
        assert 0 < size <= limits[0] and len(s) <= limits[1] and bearing <= limits[2]
        assert size == limits[0] or size & (size - 1) == 0
        for i, a, n in s:
            seen[i].append((a, n))
    for i, own in enumerate(seen):
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0] + [n for _, n in own[:-1]]).tolist()[: len(own)] and sum(n for _, n in own) == tokens[i]


def test_limits_bind(spark):
    """Where answers are three fifths of all tokens, context can't fill many sequences: most end before their tokens do. Where texts of one line are there too, no limit is passed; which one ends a sequence is up to the scores."""
    answers = [(n, "some words of context " * 30 + "\n" + "an answer of many more words " * 36) for n in range(60)]
    lines = [(100 + n, "one line only " * 300) for n in range(40)]
    packed = lambda rows: pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, end=2, loss="last line", max_segments=32, max_loss=1536)
    pieces = packed(answers).collect()
    loads = {p["sequence"]: (p["sequence_tokens"], p["sequence_loss"]) for p in pieces}
    tokens, loss = sum(p["length"] for p in pieces), sum(p["loss_tokens"] for p in pieces)
    assert sum(n for n, _ in loads.values()) == tokens and sum(x for _, x in loads.values()) == loss > 0.6 * tokens
    assert all(x <= 1536 and n & (n - 1) == 0 for n, x in loads.values())
    # a full sequence has 2560 tokens of context at least
    full = sum(n == 4096 for n, _ in loads.values())
    assert full <= (tokens - loss) // 2560 < tokens // 4096
    both = {p["sequence"]: (p["sequence_tokens"], p["sequence_segments"], p["sequence_loss"]) for p in packed(answers + lines).collect()}
    assert all(n <= 4096 and k <= 32 and x <= 1536 for n, k, x in both.values()) and sum(n == 4096 for n, _, _ in both.values()) > 3
    assert max(x for _, _, x in both.values()) > 0.95 * 1536


def test_limits_hold_in_the_query(spark):
    import __spark_entry__

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    pieces = __spark_entry__.queries()["op2_vector_packing"](spark, "/root/testdata/sf0.01").collect()
    halves = {i: [len(x) for x in expected(WORDS, list(parted(t)))] for i, t in docs.items()}
    loads, bearing = {}, {}
    for p in pieces:
        context, answer = halves[p["doc_id"]]
        assert p["doc_tokens"] == context + answer + 1
        first = context if answer else context + 1
        own = max(0, p["start"] + p["length"] - max(p["start"], first))
        assert p["loss_tokens"] == own
        load = loads.setdefault(p["sequence_id"], [0, 0, 0, p])
        load[:3] = load[0] + p["length"], load[1] + 1, load[2] + own
    for size, segments, loss, p in loads.values():
        assert (size, segments, loss) == (p["sequence_tokens"], p["sequence_segments"], p["sequence_loss"])
        assert size <= 4096 and segments <= 32 and loss <= 1536
    full = [x for x in loads.values() if x[0] == 4096]
    assert 4096 * len(full) > 0.95 * sum(x[0] for x in loads.values())
