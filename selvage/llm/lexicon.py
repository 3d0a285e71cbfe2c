"""BPE encoding and decoding with a lexicon of frequent words, a minimal acyclic transducer.

Spark counts the words (pre-tokens) of all texts; the most frequent ones and their ids are compiled into a transducer that
reads a word byte by byte and tells its ids. Words with equal rests share the states of the rest, as ids are told as early
as they are certain: what is left to tell after a prefix is the same for all prefixes that told theirs. The automaton is
one file of flat arrays in the shared folder. Spark gives it to every executor, also to those that come later, and a task
maps it into memory, so the workers of a machine share its pages.

All distinct words of a batch walk the automaton together, one byte a step. Words that it doesn't know are merged exactly,
those of like length side by side, in each round of every word the pair of the least rank, the leftmost first; a long word
by a linked list of symbols and a heap of its pairs. So the lexicon decides the speed and never the result. Its bound is `most_words`: of the words whose counts are of the highest classes that hold at most so many.

For vocabularies in lower case that drop white space, mark the ends of words and have no decoder: decoding gives the
tokens' strings with a blank between each two, as the library does for such a file.

Defined cases: null and empty text have no ids and decode to an empty text; a special token's string in a text is that
token; repeated rows are encoded each; other columns pass through, and existing ones of the outputs' names are replaced;
an empty table has an empty lexicon. A text without white space is one long word at most, which is merged in n log n.
"""

from __future__ import annotations

import functools
import heapq
import json
import mmap
import re
import struct
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, shared_dir, written
from .packing import _PIECES, _UNITS
from .shingles import chunks, slices
from .token_counts import _byte_letters

_MAGIC = b"lexicon1"


def transducer(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The minimal transducer of words in ascending order and their ids, as the bytes of a file.

    Words come one after another. The states of the latest word's path are open; when the next word leaves this path, the
    states behind the fork can't change any more and are replaced by equal ones that are known already. Ids that the new
    word doesn't share move behind the fork."""
    # a state: arcs {byte: [target, ids]}, its ids at a word's end or None
    known: dict[tuple, int] = {}
    arcs_of: list[list[tuple[int, int, tuple]]] = []
    last_of: list[tuple | None] = []

    def closed(state: list) -> int:
        key = (tuple((byte, target, told) for byte, (target, told) in state[0].items()), state[1])
        if key not in known:
            known[key] = len(arcs_of)
            arcs_of.append(list(key[0]))
            last_of.append(state[1])
        return known[key]

    path, before = [[{}, None]], b""
    for word, ids in entries:
        if word <= before and before:
            raise ValueError("words must ascend")
        fork = 0
        while fork < min(len(word), len(before)) and word[fork] == before[fork]:
            fork += 1
        for depth in range(len(before), fork, -1):
            path[depth - 1][0][before[depth - 1]][0] = closed(path[depth])
        del path[fork + 1 :]
        for depth in range(fork):
            arc = path[depth][0][word[depth]]
            same = 0
            while same < min(len(ids), len(arc[1])) and ids[same] == arc[1][same]:
                same += 1
            rest, arc[1], ids = arc[1][same:], arc[1][:same], ids[same:]
            if rest:
                follower = path[depth + 1]
                for onward in follower[0].values():
                    onward[1] = rest + onward[1]
                if follower[1] is not None:
                    follower[1] = rest + follower[1]
        for depth in range(fork, len(word)):
            path[depth][0][word[depth]] = [None, ids if depth == fork else ()]
            path.append([{}, None])
        path[len(word)][1] = () if len(word) > fork else ids
        before = word
    for depth in range(len(before), 0, -1):
        path[depth - 1][0][before[depth - 1]][0] = closed(path[depth])
    root = closed(path[0])

    pool: dict[tuple, int] = {}
    ids_pool: list[int] = []

    def placed(told: tuple) -> int:
        if told not in pool:
            pool[told] = len(ids_pool)
            ids_pool.extend(told)
        return pool[told]

    arcs = sorted((state << 8 | byte, target, placed(told), len(told)) for state, own in enumerate(arcs_of) for byte, target, told in own)
    lasts = [(placed(t), len(t)) if t is not None else (0, -1) for t in last_of]
    arrays = [np.array([a[0] for a in arcs], "<i8"), *(np.array([a[n] for a in arcs], "<i4") for n in (1, 2, 3)), *(np.array([x[n] for x in lasts], "<i4") for n in (0, 1)), np.array(ids_pool, "<i4")]
    return _MAGIC + struct.pack("<4q", root, len(arcs), len(lasts), len(ids_pool)) + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled transducer, mapped into memory from a file or read from bytes."""

    def __init__(self, data):
        if data[:8] != _MAGIC:
            raise ValueError("not a lexicon")
        self.root, arcs, states, pool = struct.unpack_from("<4q", data, 8)
        at, out = 40, []
        for kind, n in (("<i8", arcs), ("<i4", arcs), ("<i4", arcs), ("<i4", arcs), ("<i4", states), ("<i4", states), ("<i4", pool)):
            out.append(np.frombuffer(data, kind, n, at))
            at += out[-1].nbytes
        self.key, self.target, self.told, self.told_n, self.last, self.last_n, self.ids = out

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is known, how many ids it has, and the ids of the known words one after another."""
        size = np.array([len(w) for w in words], np.int64)
        return self.walk(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)

    def walk(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """look_up() of the words that start at these places of the data."""
        n_words = len(size)
        state, on = np.full(n_words, self.root, np.int64), np.arange(n_words)
        visits: list[tuple[np.ndarray, np.ndarray]] = []
        lost = np.zeros(n_words, bool)
        step = 0
        while len(self.key):
            on = on[size[on] > step]
            if not len(on):
                break
            wanted = state[on] << 8 | data[starts[on] + step]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[at] == wanted
            lost[on[~hit]] = True
            on, at = on[hit], at[hit]
            state[on] = self.target[at]
            visits.append((on, at))
            step += 1
        if not len(self.key):
            lost[size > 0] = True
        known = ~lost & (self.last_n[state] >= 0)
        # what each known word is told: by its arcs in order, then at its end
        who = np.concatenate([*(o for o, _ in visits), np.arange(n_words)])
        when = np.concatenate([*(np.full(len(o), n) for n, (o, _) in enumerate(visits)), np.full(n_words, step)])
        begin = np.concatenate([*(self.told[a] for _, a in visits), self.last[state]]).astype(np.int64)
        many = np.concatenate([*(self.told_n[a] for _, a in visits), self.last_n[state]]).astype(np.int64)
        keep = known[who] & (many > 0)
        who, when, begin, many = who[keep], when[keep], begin[keep], many[keep]
        order = np.lexsort((when, who))
        who, begin, many = who[order], begin[order], many[order]
        ends = np.cumsum(many)
        flat = np.repeat(begin - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)
        counts = np.bincount(who, weights=many, minlength=n_words).astype(np.int64)
        return known, counts, self.ids[flat]


class _Places:
    """Finds numbers among different ones of 0 or more by their hashes, many at once."""

    def __init__(self, numbers: np.ndarray):
        self.shift = np.uint64(64 - max(1, (4 * len(numbers)).bit_length()))
        hashes = self._hashes(numbers)
        self.order = np.argsort(hashes, kind="stable")
        self.numbers = numbers[self.order]
        self.first = np.searchsorted(hashes[self.order], np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64))

    def _hashes(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each, -1 where it isn't among them."""
        hashes, out = self._hashes(wanted), np.full(len(wanted), -1)
        at, end = self.first[hashes], self.first[hashes + np.uint64(1)]
        on = np.flatnonzero(at < end)
        at, end, wanted = at[on], end[on], wanted[on]
        while len(on):
            hit = self.numbers[at] == wanted
            out[on[hit]] = self.order[at[hit]]
            at += 1
            more = ~hit & (at < end)
            on, at, end, wanted = on[more], at[more], end[more], wanted[more]
        return out


class Vocabulary:
    """Pre-tokens, exact merges and token strings of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        added = spec["added_tokens"]
        if not self.end or spec["decoder"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("only vocabularies that mark the ends of words and have no decoder are supported")
        letters = _byte_letters()
        self.byte_of = {ord(letter): b for b, letter in letters.items()}
        vocabulary = model["vocab"]
        self.inner = [vocabulary[letters[b]] for b in range(256)]
        self.final = [vocabulary[letters[b] + self.end] for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in added}
        self.units: dict[str, list[str]] = {}
        self.splits = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})") if added else None
        self.strings = [""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, n in [*vocabulary.items(), *self.special.items()]:
            self.strings[n] = token
        # for merging side by side: pairs as numbers and what they make, by rank; `none` stands for no symbol
        self.none = len(self.strings)
        by_rank = sorted((rank, a * (self.none + 1) + b, made) for (a, b), (rank, made) in self.merges.items())
        _, pairs, self.made = (np.array(c, np.int64) for c in (zip(*by_rank) if by_rank else ((), (), ())))
        self.pairs = _Places(pairs)

    def words(self, text: str) -> list[bytes | int]:
        """A text's words in UTF-8, and the ids of special tokens in between."""
        return [p if isinstance(p, int) else p.encode() for p in self.pieces(text)]

    def pieces(self, text: str) -> list[str | int]:
        """The words as strings. A Latin-1 text, which no normal form changes, is lowered and cut here; the runs between blanks of another by the library."""
        parts = self.splits.split(text) if self.splits else [text]
        out: list[str | int] = []
        for n, part in enumerate(parts):
            if n % 2:
                out.append(self.special[part])
                continue
            try:
                part.encode("latin-1")
                out += _PIECES.findall(part.lower())
            except UnicodeEncodeError:
                for unit in _UNITS.findall(part):
                    out += self._pieces_of(unit)
        return out

    def _pieces_of(self, unit: str) -> list[str]:
        found = self.units.get(unit)
        if found is None:
            whole = self.library.normalizer.normalize_str(unit)
            found = [w.translate(self.byte_of).encode("latin-1").decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(whole)]
            if len(unit) <= 48:
                if len(self.units) >= 50_000:
                    self.units.clear()
                self.units[unit] = found
        return found

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The word's ids by merging: the pair of the least rank first, of equal pairs the leftmost."""
        symbols = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        n = len(symbols)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := self.merges.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue  # one of them was merged meanwhile
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                ahead[after[j]] = i
                if found := self.merges.get((made, symbols[after[j]])):
                    heapq.heappush(heap, (found[0], i, made, symbols[after[j]], found[1]))
            if ahead[i] >= 0 and (found := self.merges.get((symbols[ahead[i]], made))):
                heapq.heappush(heap, (found[0], ahead[i], symbols[ahead[i]], made, found[1]))
        return tuple(s for s in symbols if s >= 0)

    def merge_all(self, words: list[bytes], longest: int = 48, block: int = 1 << 19) -> list[bytes]:
        """The ids of each word that merge() tells, as little-endian 32-bit numbers. Words of up to `longest` bytes are merged side by side, those of like length in tables of at most about `block` symbols."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        bounds = [*range(0, longest + 1, 8), *([longest] if longest % 8 else [])]
        ends = np.searchsorted(sizes[order], bounds, side="right").tolist()
        for width, begin, end in zip(bounds[1:], ends, ends[1:]):
            rows = max(1, block // width)
            for at in range(begin, end, rows):
                own = order[at : min(at + rows, end)].tolist()
                for n, ids in zip(own, self._merge_table([words[n] for n in own], width)):
                    out[n] = ids
        for n in order[ends[-1] :].tolist():
            out[n] = np.array(self.merge(words[n]), "<i4").tobytes()
        return out

    def _places_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the ranks, and one after the last for no pair."""
        at = self.pairs.of((left * (self.none + 1) + right).ravel()).reshape(left.shape)
        return np.where(at < 0, len(self.made), at)

    def _merge_table(self, words: list[bytes], width: int) -> list[bytes]:
        size = np.array([len(w) for w in words])
        held = np.arange(width) < size[:, None]
        symbols = np.full((len(words), width + 1), self.none)  # the last column stays empty
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols[:, :width][held] = np.array(self.inner)[data]
        symbols[np.arange(len(words)), size - 1] = np.array(self.final)[data[np.cumsum(size) - 1]]
        ranks, done = self._places_of(symbols[:, :-1], symbols[:, 1:]), np.empty_like(symbols)
        on, columns = np.arange(len(words)), np.arange(width + 1)
        while len(on):
            best = ranks.argmin(axis=1)  # the first of equal ones
            rank = ranks[np.arange(len(on)), best]
            more = rank < len(self.made)
            if not more.all():
                done[on[~more]] = symbols[~more]
                on, symbols, ranks, best, rank = on[more], symbols[more], ranks[more], best[more], rank[more]
            row = np.arange(len(on))
            # what comes after the pair moves one place to the left
            symbols[:, :-1] = np.where(columns[:-1] > best[:, None], symbols[:, 1:], symbols[:, :-1])
            ranks[:, :-1] = np.where(columns[:-2] > best[:, None], ranks[:, 1:], ranks[:, :-1])
            symbols[row, best] = self.made[rank]
            ranks[row, best] = self._places_of(symbols[row, best], symbols[row, best + 1])
            inside = row[best > 0]
            before = best[inside] - 1
            ranks[inside, before] = self._places_of(symbols[inside, before], symbols[inside, before + 1])
        kept = done != self.none
        raw, ends = done[kept].astype("<i4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with blanks in between; an id that there isn't is passed over."""
        return " ".join([self.strings[i] for i in ids if 0 <= i < len(self.strings)])

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """decode() of each list of ids that there are."""
        strings = pa.ListArray.from_arrays(ids.offsets, pa.array(self.strings).take(ids.values))
        return pc.binary_join(strings, " ")


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def _lexicon(path: str) -> Lexicon:
    return Lexicon.mapped(path)


class Encoder:
    """Ids of texts by a lexicon, and by merging where it doesn't know a word; remembers at most `remember` merged words."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, remember: int = 50_000, longest: int = 48):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.merged: dict[bytes, bytes] = {}
        self.remember, self.longest = remember, longest

    def _merge(self, words: list[bytes]) -> list[bytes]:
        found = [self.merged.get(w) for w in words]
        new = [w for w, ids in zip(words, found) if ids is None]
        if new:
            made = dict(zip(new, self.vocabulary.merge_all(new, self.longest)))
            found = [made[w] if ids is None else ids for w, ids in zip(words, found)]
            for w, ids in made.items():
                if len(w) <= self.longest:
                    if len(self.merged) >= self.remember:
                        self.merged.clear()
                    self.merged[w] = ids
        return found

    def _told(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word or special token start, how many it has, and all ids: those of the words that the lexicon knows first."""
        ends = np.frombuffer(pieces.buffers()[1], "<i4")[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        is_special = data[ends[:-1]] == ord(" ")
        word, special = np.flatnonzero(~is_special), np.flatnonzero(is_special)
        known, many, ids = self.lexicon.walk(data, ends[word], np.diff(ends)[word])
        unknown = word[~known]
        merged = self._merge(pieces.take(pa.array(unknown)).cast(pa.binary()).to_pylist())
        rest = np.concatenate([word[known], unknown, special])  # in the order of their ids
        counts, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        counts[rest] = np.concatenate([many[known], [len(x) // 4 for x in merged], np.ones(len(special))])
        starts[rest] = np.cumsum(counts[rest]) - counts[rest]
        tail = b"".join([*merged, *(struct.pack("<i", int(p)) for p in pieces.take(pa.array(special)).to_pylist())])
        return starts, counts, np.concatenate([ids.astype("<i4"), np.frombuffer(tail, "<i4")])

    def lists(self, texts: list[str | None]) -> pa.ListArray:
        """Each text's ids."""
        flat: list[str | int] = []
        ends = [0]
        for t in texts:
            flat += self.vocabulary.pieces(t or "")
            ends.append(len(flat))
        if int in set(map(type, flat)):
            flat = [p if isinstance(p, str) else f" {p}" for p in flat]  # no word has a blank
        coded = pa.array(flat, pa.string()).dictionary_encode()
        starts, counts, ids = self._told(coded.dictionary)
        codes = coded.indices.to_numpy()
        many = counts[codes]
        after = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(starts[codes] - after[:-1], many) + np.arange(after[-1])
        return pa.ListArray.from_arrays(pa.array(after[ends], pa.int32()), pa.array(ids[at], pa.int32()))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        return [np.array(ids, "<i4").tobytes() for ids in self.lists(texts).to_pylist()]


def count_words(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """word (binary) and n: how often each word occurs in all texts."""

    def work(batches):
        vocabulary, held, rows = _vocabulary(path), [], 0
        for batch in batches:
            for run in chunks([t or "" for t in batch.column(0).to_pylist()], 2_000_000):
                words = []
                for t in run:
                    words += vocabulary.pieces(t)
                if int in set(map(type, words)):
                    words = [w for w in words if isinstance(w, str)]  # without special tokens
                word, n = pa.array(words, pa.string()).value_counts().flatten()
                held.append(pa.table({"word": word.cast(pa.binary()), "n": n}))
                rows += len(word)
                if rows > 400_000:
                    yield from told(held)
                    held, rows = [], 0
        if rows:
            yield from told(held)

    def told(held):
        words = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return words.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches()

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, path: str, text: str = "text", most_words: int = 60_000, longest: int = 48) -> str:
    """Compiles the frequent words of all texts, of at most `longest` bytes; the file's name, under which every task finds it.

    Words are taken in classes of counts (16 for each doubling), the most frequent first, as long as there are at most
    `most_words`; so no task and no sort meets all words, and equal counts are taken or left together."""
    spark = df.sparkSession
    counted = written(count_words(df, path, text).where(F.octet_length("word") <= longest).withColumn("class", F.floor(16 * F.log2("n")).cast("int")), "words")
    sizes = sorted(((r["class"], r["n"]) for r in counted.groupBy("class").agg(F.count("*").alias("n")).collect()), reverse=True)  # 16 for each doubling of the largest count
    least, held = None, 0
    for c, n in sizes:
        if (held := held + n) > most_words:
            break
        least = c
    found = []
    if least is not None:

        def work(batches):
            vocabulary = _vocabulary(path)
            for batch in batches:
                ids = [np.frombuffer(x, "<i4") for x in vocabulary.merge_all(batch.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

        found = counted.where(F.col("class") >= least).select("word").mapInArrow(work, "word binary, ids array<int>").collect()  # at most most_words
    data = transducer(sorted((bytes(r["word"]), tuple(r["ids"])) for r in found))
    discard(counted)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    for n in range(0, len(data), 1 << 20):
        out.write(bytearray(data[n : n + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(at.toString())
    return name


def encode(df: DataFrame, path: str, lexicon: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the ids of every whole text (array<int>) and the text that they decode to. lexicon: the name that build_lexicon gave."""
    kept = [c for c in df.columns if c not in (ids, decoded)]
    rows = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_u{n}_") for n, c in enumerate(kept)])

    def work(batches):
        vocabulary = _vocabulary(path)
        encoder = Encoder(vocabulary, _lexicon(SparkFiles.get(lexicon)))
        for batch in slices(batches):
            at = 0
            for run in chunks([t or "" for t in batch.column(0).to_pylist()], 2_000_000):
                lists = encoder.lists(run)
                own = batch.slice(at, len(run))
                yield pa.RecordBatch.from_arrays([*own.columns[1:], lists, vocabulary.decode_all(lists)], names=[*own.schema.names[1:], "_ids", "_decoded"])
                at += len(run)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    out = rows.mapInArrow(work, f"{schema}_ids array<int>, _decoded string")
    return out.select(*[F.col(f"_u{n}_").alias(c) for n, c in enumerate(kept)], F.col("_ids").alias(ids), F.col("_decoded").alias(decoded))
