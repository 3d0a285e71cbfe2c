"""The transducer lexicon against plain dictionaries and the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from selvage.llm.lexicon import Encoder, Lexicon, Vocabulary, build_lexicon, count_words, encode, transducer
from selvage.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n\n", "  a  b\n\n c \n", "<|endoftext|>a<|endoftext|> <|startoftext|>\n", "a<|endoftext|", "a" * 3000, "it's don't we'll 'S 'RE", "x\x1c\x1dy\x85z\xa0w 12 34,5 ...!!", "é" * 999, "字" * 20_000 + " 字", "ΑΣ ΣΑΣ İI ß ǅ", "é é Å ́ á", "x" * 7 + " " * 9, "²½ª µ\xad\x00z"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(WORDS)


def expected(texts):
    library = Tokenizer.from_file(WORDS)
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    return ids, [library.decode(i, skip_special_tokens=False) for i in ids]


def plain_states(entries):
    """How many states a minimal transducer has: the different functions that are left to tell after a prefix, without what is already certain."""

    def common(told):
        n = 0
        while all(len(t) > n and t[n] == told[0][n] for t in told):
            n += 1
        return n

    states = set()
    for prefix in {w[:n] for w in entries for n in range(len(w) + 1)}:
        rest = {w[len(prefix) :]: t for w, t in entries.items() if w.startswith(prefix)}
        n = common(list(rest.values())) if prefix else 0
        states.add(frozenset((w, t[n:]) for w, t in rest.items()))
    return len(states)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), st.lists(st.integers(0, 3), min_size=0, max_size=4).map(tuple), max_size=25))
def test_transducer_is_right_and_minimal(entries):
    lexicon = Lexicon(transducer(sorted(entries.items())))
    asked = [*entries, b"", b"abcabc", b"zz", *(w[:-1] for w in entries), *(w + b"a" for w in entries)]
    known, counts, ids = lexicon.look_up(asked)
    assert known.tolist() == [w in entries for w in asked]
    assert counts[known].tolist() == [len(entries[w]) for w in asked if w in entries]
    assert ids.tolist() == [i for w in asked for i in entries.get(w, ())]
    assert not counts[~known].any()
    if entries:
        assert len(lexicon.last) == plain_states(entries)


def test_rests_are_shared():
    entries = sorted((stem + rest, (n, *told)) for n, stem in enumerate([b"walk", b"talk", b"bark"]) for rest, told in [(b"", (9,)), (b"ed", (7,)), (b"ing", (8, 5))])
    alone = Lexicon(transducer(entries[:3]))
    assert len(Lexicon(transducer(entries)).last) == len(alone.last) + 2  # walk and talk share all but their first arc, and both share what comes after bark's r
    with pytest.raises(ValueError):
        transducer([(b"b", (1,)), (b"a", (2,))])
    with pytest.raises(ValueError):
        Lexicon(b"x" * 80)


@pytest.mark.parametrize("frequent", [[], [b"a", b"it", b"'s"], None])
def test_ids_don_t_depend_on_the_lexicon(vocabulary, frequent):
    if frequent is None:
        frequent = {w for t in ODD for w in vocabulary.words(t) if isinstance(w, bytes)}
    encoder = Encoder(vocabulary, Lexicon(transducer(sorted((w, vocabulary.merge(w)) for w in frequent))), remember=3)
    ids, texts = expected(ODD)
    got = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode([*ODD, None])]
    assert got == [*ids, []] and [vocabulary.decode(i) for i in got] == [*texts, ""]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from(" \n\t'abcsSTxé字1²!<|>endoftext"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_any_texts(vocabulary, texts):
    encoder = Encoder(vocabulary, Lexicon(transducer([(b"a", vocabulary.merge(b"a")), (b"text", vocabulary.merge(b"text"))])))
    ids, decoded = expected(texts)
    got = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)]
    assert got == ids and [vocabulary.decode(i) for i in got] == decoded


@settings(max_examples=100, deadline=None)
@given(words=st.lists(st.one_of(st.binary(min_size=1, max_size=60), st.text("aenrst'", min_size=1, max_size=60).map(str.encode)), max_size=30), block=st.integers(1, 200))
def test_words_merged_side_by_side(vocabulary, words, block):
    want = [vocabulary.merge(w) for w in words]
    for longest in (0, 20, 48):
        assert [tuple(np.frombuffer(x, "<i4").tolist()) for x in vocabulary.merge_all(words, longest, block)] == want


def test_short_words_aren_t_merged_one_by_one(monkeypatch):
    vocabulary = Vocabulary(WORDS)
    texts = [" ".join(f"{a}{b}zq{c}" for a in "abcde" for b in "rstuv" for c in "xyz") + " <|endoftext|> don't", "", None]
    ids, decoded = expected([t or "" for t in texts])
    monkeypatch.setattr(vocabulary, "merge", None)
    lists = Encoder(vocabulary, Lexicon(transducer([]))).lists(texts)
    assert lists.to_pylist() == ids and vocabulary.decode_all(lists).to_pylist() == decoded


def test_operator_with_odd_rows(spark, vocabulary):
    texts = [*ODD, None, ODD[3], "common words common words"]
    df = spark.createDataFrame([(None if n == 2 else n, t, n, "y") for n, t in enumerate(texts)], "doc_id long, text string, ids int, `a.b` string")
    counted = {bytes(r["word"]): r["n"] for r in count_words(df, WORDS).collect()}
    assert counted[b"common"] == 2 and counted[b"b"] == 2
    ids, decoded = expected([t or "" for t in texts])
    for most in (5, 1000):
        got = encode(df, WORDS, build_lexicon(df, WORDS, most_words=most))
        assert got.columns == ["doc_id", "text", "a.b", "ids", "decoded"]
        assert sorted(((r["text"], list(r["ids"]), r["decoded"]) for r in got.collect()), key=repr) == sorted(zip(texts, ids, decoded), key=repr)
    empty = df.where("false")
    assert encode(empty, WORDS, build_lexicon(empty, WORDS)).collect() == []


def test_query_against_the_library(spark):
    at = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    ids, decoded = expected([r["text"] or "" for r in rows])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((r["doc_id"], len(i), digest(" ".join(map(str, i))), digest(d)) for r, i, d in zip(rows, ids, decoded))
    assert sorted(tuple(r) for r in QUERIES["op12_transducer_lexicon"](spark, at).collect()) == want
