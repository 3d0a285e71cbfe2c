"""Alignment of two vocabularies against the libraries on whole texts, in plain Python."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from selvage.llm.alignment import Aligner, align, byte_ends, pair_counts, with_counts
from selvage.llm.queries import QUERIES
from selvage.llm.token_counts import _byte_letters

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n\n\n", "  a  b\n\n c \n", "<|endoftext|>a<s> </s><unk><0x0A>\n", "a" * 900, "it's don't", "x\x1c\x1dy\x85z\xa0w 12 34,5 ...!!", "\r\n\t x ", "f();\r\n  g();\r\n}\r\r", "a\r", "a\r b\r\r\r c", "é" * 99, "字" * 50 + " 字", "𐍈 a𐍈b é 👩‍👩‍👧", "a▁b", "▁", "a　b　", "  ☃​", " a ", "x" * 7 + " " * 9, "²½ª µ\xad\x00z", "﻿a�"]
_FIRST, _SECOND = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
_FIRST.encode_special_tokens = True
_LETTERS = {letter: b for b, letter in _byte_letters().items()}


def plainly(text):
    """Groups of ids of a whole text by the bytes of its tokens, or none."""
    if not text:
        return []
    whole = (" " + text).encode()
    first = [(i, bytes(_LETTERS[c] for c in _FIRST.id_to_token(i))) for i in _FIRST.encode(" " + text, add_special_tokens=False).ids]
    second = [(i, bytes([int(_SECOND.id_to_piece(i)[3:5], 16)]) if _SECOND.is_byte(i) else _SECOND.id_to_piece(i).replace("▁", " ").encode()) for i in _SECOND.encode(text)]
    if b"".join(b for _, b in first) != whole or b"".join(b for _, b in second) != whole:
        return []
    groups, a, b, at, to, n, m = [], [], [], 0, 0, 0, 0
    while n < len(first) or m < len(second):
        if at <= to:
            a.append(first[n][0])
            at += len(first[n][1])
            n += 1
        else:
            b.append(second[m][0])
            to += len(second[m][1])
            m += 1
        if at == to:
            groups.append((a, b))
            a, b = [], []
    return groups


def written_out(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def links_of(groups):
    return Counter((x, y) for a, b in groups for x in a for y in b)


def corpus(texts):
    """What the query tells of each text."""
    found = [plainly(t) for t in texts]
    counts = Counter(p for g in found for p in links_of(g))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for groups in found:
        links = links_of(groups)
        digest = hashlib.sha256(written_out(groups).encode()).hexdigest() if groups else ""
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), digest))
    return out


@pytest.fixture(scope="module")
def aligner():
    return Aligner(BYTES, PIECES, remember=20)


def check(aligner, texts):
    for text, got in zip(texts, aligner.texts(texts)):
        want = plainly(text)
        assert got.groups == written_out(want), text
        assert (got.n_a, got.n_b, got.n_groups, got.n_links) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want), sum(links_of(want).values()))


def test_odd_texts(aligner):
    check(aligner, [*ODD, None])
    check(aligner, ODD[::-1])
    assert [x.n_a for x in aligner.texts([None, "", "a▁b"])] == [0, 0, 0]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from(" \n\r\t;)(}'abcST字é1!<|>𐍈　\xa0▁"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_any_texts(aligner, texts):
    check(aligner, texts)


def test_offsets_are_refined_between_coarse_cuts():
    """Three byte tokens of one character lie between two coarse cuts; lengths that don't fill a cut are refused."""
    import numpy as np

    begin, end, clean = np.array([0, 2, 2, 2, 5]), np.array([2, 2, 2, 5, 6]), np.array([True, False, False, True, True])
    assert byte_ends(begin, end, clean, np.array([2, 1, 1, 1, 1])).tolist() == [2, 3, 4, 5, 6]
    assert byte_ends(begin, end, clean, np.array([2, 1, 1, 2, 1])) is None


@pytest.mark.parametrize("most_hot", [0, 10, 200_000])
def test_counts_with_odd_rows(spark, most_hot):
    """The same whether pairs are broadcast or shuffled."""
    texts = [*ODD, None, ODD[3], "the common words", "the common words and more", "the words"]
    df = spark.createDataFrame([(None if n == 2 else n // 2, t, n, "y") for n, t in enumerate(texts)], "doc_id long, text string, n_a int, `a.b` string")
    aligned = align(df, BYTES, PIECES)
    aligned.write.parquet(at := f"{spark.conf.get('spark.checkpoint.dir')}/aligned-{most_hot}")
    aligned = spark.read.parquet(at)
    got = with_counts(aligned, pair_counts(aligned), most_hot)
    assert got.columns == ["doc_id", "text", "a.b", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    told = [(r["text"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got.collect()]
    assert sorted(told, key=repr) == sorted(((t, *x) for t, x in zip(texts, corpus(texts))), key=repr)
    assert align(df.where("false"), BYTES, PIECES).collect() == []


def test_query_against_the_libraries(spark):
    at = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], *x) for r, x in zip(rows, corpus([r["text"] for r in rows])))
    assert sorted(tuple(r) for r in QUERIES["op11_span_alignment"](spark, at).collect()) == want
