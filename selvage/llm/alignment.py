"""Alignment of two tokenizers' tokens over the same text, and how many documents link a pair of ids.

One vocabulary is byte-level (tokenizers), the other has pieces with byte fallback (sentencepiece, which puts a space
before the text; so the first one reads space and text). The library's spans are coarse cuts: where a token of the first
ends at a character's end by its character offsets, or a piece of the second by its span in the proto, its byte offset is
known. Tokens that share a character (parts of a multibyte character, byte-fallback tokens) get theirs from the bytes that
they decode to, counted on from the last coarse cut; at the next one both must agree. Byte offsets where tokens of both
end cut the tokens into groups, and each token of one vocabulary is linked to each of the other in its group.

Neither vocabulary has a token that reaches from a character that isn't white space to white space, but for the characters
that some piece says it does (found in the pieces). So a text is cut there into units, of which the last token of both
ends together, and a distinct unit is aligned once; workers remember units in two generations. The result is that of whole
texts; tests compare it with the libraries on whole texts.

The count of an id pair is the number of documents that have it linked. Documents' distinct pairs are written once; their
counts come from one aggregation. To give each document its counts, the most frequent pairs (whole classes of counts that
together hold at most `most_hot` pairs) are broadcast, and only the others, each of which has few rows, are shuffled; so no
pair, however common, gathers in one task.

Defined cases: a text that is null or empty, or whose tokens of either vocabulary don't decode to space and text (those
with U+2581, which the pieces read as a space), has no tokens: zeros, and no groups. Strings of special tokens are plain
text. Repeated rows, also of one id, are documents of their own. Other columns pass through, and existing ones of the
outputs' names are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, written
from .shingles import chunks, slices
from .token_counts import _SPACE, _byte_letters

_MARK = "▁"


@dataclass(frozen=True)
class Aligned:
    """One text: numbers of tokens, groups and links, the groups as text, and the distinct pairs (first id << 32 | second id) with their links, interleaved as little-endian longs."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    pairs: bytes


_NOTHING = Aligned(0, 0, 0, 0, "", b"")
#: A unit: its four numbers as longs, its groups, and its pairs with their links.
Unit = tuple[bytes, str, bytes]


def byte_ends(begin: np.ndarray, end: np.ndarray, clean: np.ndarray, length: np.ndarray) -> np.ndarray | None:
    """Byte offsets at which tokens end. begin, end: their library spans in bytes, which hold where a token is clean, that is, ends where no later token of the same character begins; the others are refined by the lengths of the tokens' bytes. None if the two disagree."""
    run = np.cumsum(length)
    at = np.flatnonzero(clean)
    last = np.searchsorted(at, np.arange(len(end)), side="right") - 1  # the last clean token up to each
    base = np.where(last >= 0, end[at[np.maximum(last, 0)]] - run[at[np.maximum(last, 0)]], 0) if len(at) else 0
    ends = run + base
    # a coarse cut holds if the tokens since the one before fill what lies between
    steps = np.diff(np.concatenate([[0], end[at]])), np.diff(np.concatenate([[0], run[at]]))
    return ends if np.array_equal(*steps) else None


class Aligner:
    """The two vocabularies and the alignment of units."""

    def __init__(self, byte_level: str, pieces: str, remember: int = 200_000, longest: int = 48):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_level)
        self.first.encode_special_tokens = True
        byte_of = {ord(letter): b for b, letter in _byte_letters().items()}
        size = max(self.first.get_vocab().values()) + 1
        self.first_bytes = [b""] * size
        for token, n in self.first.get_vocab().items():
            with_bytes = token.translate(byte_of)
            if all(ord(c) < 256 for c in with_bytes):
                self.first_bytes[n] = with_bytes.encode("latin-1")
        self.second = SentencePieceProcessor(model_file=pieces)
        names = [self.second.id_to_piece(n) for n in range(self.second.vocab_size())]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(n) else p.replace(_MARK, " ").encode() for n, p in enumerate(names)]
        self.first_length = np.array([len(b) for b in self.first_bytes], np.int64)
        self.second_length = np.array([len(b) for b in self.second_bytes], np.int64)
        # white space that a piece holds after another character
        spaced = [p.replace(_MARK, " ") for n, p in enumerate(names) if not self.second.is_byte(n)]
        joined = {m[0] for p in spaced for m in re.findall(f"(?<=[^{_SPACE}])([{_SPACE}])", p)}
        on = "".join(sorted(joined))
        more = f"(?:[{re.escape(on)}][{_SPACE}]*[^{_SPACE}]*)*" if on else ""
        self.units = re.compile(f"[{_SPACE}]*[^{_SPACE}]+{more}|[{_SPACE}]+")
        self.known: dict[str, Unit | None] = {}
        self.before: dict[str, Unit | None] = {}
        self.remember, self.longest = remember, longest

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray | None]:
        """Ids and byte ends of both vocabularies over a text that begins with a space. The ends are None where the bytes don't fit."""
        raw = text.encode()
        sizes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        offset = np.concatenate([[0], np.cumsum(1 + (sizes > 0x7F) + (sizes > 0x7FF) + (sizes > 0xFFFF))])
        got = self.first.encode(text, add_special_tokens=False)
        a = np.array(got.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(got.offsets), np.int64).reshape(-1, 2)
        clean = np.append(spans[1:, 0] >= spans[:-1, 1], True)
        a_ends = byte_ends(offset[spans[:, 0]], offset[spans[:, 1]], clean, self.first_length[a])
        if b"".join(map(self.first_bytes.__getitem__, a.tolist())) != raw:
            a_ends = None
        # the proto's spans are bytes of the text without its first space; those of the byte tokens of a character end with its last
        proto = self.second.encode(text[1:], return_type="proto").pieces
        b, begin, end = (np.fromiter(map(attrgetter(name), proto), np.int64, len(proto)) for name in ("id", "begin", "end"))
        clean = np.ones(len(b), bool)
        if len(b):
            empty = begin == end
            clean = ~empty | (b == self.second.piece_to_id(_MARK))
            begin, end = begin + 1, end + 1
        b_ends = byte_ends(begin, end, clean, self.second_length[b])
        if b"".join(map(self.second_bytes.__getitem__, b.tolist())) != raw:
            b_ends = None
        return a, a_ends, b, b_ends

    def align(self, units: list[str]) -> list[Unit | None]:
        """Each unit's alignment, None where it has none. The units are read by the libraries as one text."""
        good = [u for u in units if _MARK not in u]
        inner = [u for u in good if u[-1] not in _SPACE]
        found: dict[str, Unit | None] = dict.fromkeys(units)
        for group in ([inner] if inner else []) + [[u] for u in good if u[-1] in _SPACE]:
            found |= zip(group, self._aligned(group))
        return [found[u] for u in units]

    def _aligned(self, group: list[str]) -> list[Unit | None]:
        """Units of which all but the last end in no white space."""
        text = " ." + "".join(group)  # a unit of its own, so that every text begins with a space
        a, a_ends, b, b_ends = self._tokens(text)
        if a_ends is None or b_ends is None:
            half = len(group) // 2  # what doesn't fit is found by halving
            return self._aligned(group[:half]) + self._aligned(group[half:]) if half else [None]
        bounds = np.cumsum([2, *(len(u.encode()) for u in group)])
        near = np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)
        both = a_ends[b_ends[near] == a_ends]  # the ends ascend, as no token is empty
        if not np.array_equal(both[np.minimum(np.searchsorted(both, bounds), len(both) - 1)], bounds):
            raise ValueError("a token reaches over the end of a unit")
        # the groups of a unit are those that end after the unit before
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        a_at, b_at = np.searchsorted(a_group, np.arange(len(both) + 1)), np.searchsorted(b_group, np.arange(len(both) + 1))
        group_at = np.searchsorted(both, bounds) + 1
        a, b = a.tolist(), b.tolist()
        a_names, b_names = list(map(str, a)), list(map(str, b))
        a_cut, b_cut = a_at.tolist(), b_at.tolist()
        simple = ((np.diff(a_at) == 1) & (np.diff(b_at) == 1)).tolist()
        texts = [f"{a_names[i]}|{b_names[j]}" if one else f"{','.join(a_names[i:to])}|{','.join(b_names[j:b_to])}" for one, i, to, j, b_to in zip(simple, a_cut, a_cut[1:], b_cut, b_cut[1:])]
        links = np.concatenate([[0], np.cumsum(np.diff(a_at) * np.diff(b_at))])
        cuts = group_at.tolist()
        numbers = np.stack([np.diff(x) for x in (a_at[group_at], b_at[group_at], group_at, links[group_at])], 1).astype("<i8").tobytes()
        pairs, pair_cut = self._pairs(np.array(a), np.array(b), a_at, b_at, group_at)
        return [(numbers[32 * n : 32 * n + 32], ";".join(texts[first:last]), pairs[16 * pair_cut[n] : 16 * pair_cut[n + 1]]) for n, (first, last) in enumerate(zip(cuts, cuts[1:]))]

    @staticmethod
    def _pairs(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, group_at: np.ndarray) -> tuple[bytes, list[int]]:
        """Distinct pairs of each unit's groups with their links, one unit after another, and where each unit's begin. The ids of a long group are counted before they are paired, so one of few ids stays small."""
        groups = np.arange(int(group_at[0]), int(group_at[-1]))
        many_a, many_b = np.diff(a_at)[groups], np.diff(b_at)[groups]
        short = many_a * many_b <= 1024
        which, own = groups[short], (many_a * many_b)[short]
        place = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)  # of a link within its group
        wide = np.repeat(many_b[short], own)
        pair = a[np.repeat(a_at[which], own) + place // wide] << 32 | b[np.repeat(b_at[which], own) + place % wide]
        of, n_links = [np.repeat(which, own)], [np.ones(len(pair), np.int64)]
        pairs = [pair]
        for g in groups[~short].tolist():
            ids, n = np.unique(a[a_at[g] : a_at[g + 1]], return_counts=True)
            other, m = np.unique(b[b_at[g] : b_at[g + 1]], return_counts=True)
            pairs.append((ids[:, None] << 32 | other).ravel())
            n_links.append((n[:, None] * m).ravel())
            of.append(np.full(len(pairs[-1]), g))
        pair, n_links = np.concatenate(pairs), np.concatenate(n_links)
        unit = np.searchsorted(group_at, np.concatenate(of), side="right") - 1
        order = np.lexsort((pair, unit))
        pair, unit, n_links = pair[order], unit[order], n_links[order]
        first = np.flatnonzero(np.append(True, (np.diff(pair) != 0) | (np.diff(unit) != 0))[: len(pair)])
        told = np.stack([pair[first], np.add.reduceat(n_links, first)], 1) if len(first) else np.zeros((0, 2), np.int64)
        return told.astype("<i8").tobytes(), np.searchsorted(unit[first], np.arange(len(group_at))).tolist()

    def texts(self, texts: list[str | None]) -> list[Aligned]:
        """Alignments of whole texts."""
        cut = [self.units.findall(" " + t) if t else [] for t in texts]
        known, before, new = self.known, self.before, []
        for u in set().union(*cut):
            if u not in known:
                if u in before:
                    known[u] = before[u]
                else:
                    new.append(u)
        for run in chunks(sorted(new), 200_000):
            known |= zip(run, self.align(run))
        out = [self._whole(list(map(known.__getitem__, own))) for own in cut]
        for u in new:
            if len(u) > self.longest:
                del known[u]
        if len(known) > self.remember:
            self.before, self.known = known, {}
        return out

    @staticmethod
    def _whole(own: list[Unit | None]) -> Aligned:
        if not own or not all(own):
            return _NOTHING
        numbers, groups, raw = zip(*own)
        flat = np.frombuffer(b"".join(raw), "<i8")
        order = np.argsort(flat[::2])
        pairs = flat[::2][order]
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        both = np.stack([pairs[first], np.add.reduceat(flat[1::2][order], first)], 1).astype("<i8").tobytes()
        return Aligned(*np.frombuffer(b"".join(numbers), "<i8").reshape(-1, 4).sum(0).tolist(), ";".join(groups), both)


@functools.lru_cache(maxsize=2)
def _aligner(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


OUT = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<long>"


def align(df: DataFrame, byte_level: str, pieces: str, text: str = "text") -> DataFrame:
    """df with n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), pairs (distinct, first id << 32 | second id) and the links of each."""
    made = [c.split()[0] for c in OUT.split(", ")]
    kept = [c for c in df.columns if c not in made]
    rows = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_u{n}_") for n, c in enumerate(kept)])

    def work(batches):
        aligner = _aligner(byte_level, pieces)
        for batch in slices(batches):
            at = 0
            for run in chunks([t or "" for t in batch.column(0).to_pylist()], 1_000_000):
                found = aligner.texts(run)
                flat = [np.frombuffer(x.pairs, "<i8") for x in found]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) // 2 for x in flat])]), pa.int32())
                whole = np.concatenate(flat)
                own = batch.slice(at, len(run))
                counts = [pa.array([getattr(x, n) for x in found], pa.int64()) for n in made[:4]]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (whole[::2].copy(), whole[1::2].copy())]
                yield pa.RecordBatch.from_arrays([*own.columns[1:], *counts, pa.array([x.groups for x in found], pa.string()), *lists], names=[*own.schema.names[1:], *made])
                at += len(run)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(work, schema + OUT).select(*[F.col(f"_u{n}_").alias(c) for n, c in enumerate(kept)], *made)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, n (documents that have it linked) and best (whether no other pair of the same first id has more)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = written(counts.withColumn("a", F.shiftright("pair", 32)), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    out = written(counts.join(most, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")
    discard(counts)
    return out


def with_counts(aligned: DataFrame, counts: DataFrame, most_hot: int = 200_000) -> DataFrame:
    """aligned without pairs and links, with n_best (links whose pair is the best of its first id) and count_sum (the pairs' counts over all links). aligned must be a written table: its rows are numbered twice."""
    classes = counts.groupBy(F.floor(8 * F.log2("n")).cast("int").alias("class")).agg(F.count("*").alias("n")).collect()  # 8 for each doubling of the largest count
    least, held = None, 0
    for r in sorted(classes, key=lambda r: -r["class"]):
        if (held := held + r["n"]) > most_hot:
            break
        least = r["class"]
    is_hot = F.lit(False) if least is None else F.floor(8 * F.log2("n")).cast("int") >= least
    of = counts.select("pair", F.col("n").alias("_n"), "best", is_hot.alias("_hot"))
    numbered = aligned.withColumn("_row", F.monotonically_increasing_id())
    linked = numbered.select("_row", F.explode(F.arrays_zip("pairs", "links")).alias("_p")).select("_row", F.col("_p.pairs").alias("pair"), F.col("_p.links").alias("_links"))
    hot = F.broadcast(of.where("_hot").drop("_hot"))  # at most most_hot rows
    often = linked.join(hot, "pair").select("_row", "_links", "_n", "best")
    rarely = linked.join(hot.select("pair"), "pair", "left_anti").join(of.where("not _hot").drop("_hot"), "pair").select("_row", "_links", "_n", "best")
    summed = lambda rows: rows.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("_links")).otherwise(0)).alias("n_best"), F.sum(F.col("_links") * F.col("_n")).alias("count_sum"))
    sums = often.unionByName(rarely)
    out = numbered.drop("pairs", "links").join(summed(sums), "_row", "left").drop("_row")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
