"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

A text is cut into pre-tokens. The distinct pre-tokens of a batch that are not known yet lie one after another in one
ragged numpy array of symbols. Each round finds the lowest-ranked pair of every pre-token and merges all its
occurrences at once; a pre-token leaves when none of its pairs has a rank, and its surviving symbols are its count.

Defined cases: null and empty text have 0 tokens; repeated rows are counted each; other columns pass through, and an
existing column of the output's name is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode's White_Space, which a pre-token never spans but at its start.
_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_UNITS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Fixed pattern of this vocabulary's pre-tokens.
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_NONE = np.int64(1) << 60


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


class RankMerger:
    """Pair ranks of one vocabulary as sorted arrays."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int]):
        letters = _byte_letters()
        self.first = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece."""
        out = np.zeros(len(pieces), np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        owner = np.flatnonzero(size)
        size = size[owner]
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        while len(owner):
            starts = np.cumsum(size) - size
            # a pair is at its left symbol; the last symbol of a piece has none
            at = np.searchsorted(self.keys, pair := symbols << 32 | np.append(symbols[1:], 0))
            at[at == len(self.keys)] = 0
            rank = np.where(self.keys[at] == pair, self.rank[at], _NONE)
            rank[starts + size - 1] = _NONE
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            out[owner[done]] = size[done]
            hit = (rank == np.repeat(least, size)) & (rank != _NONE)
            # of overlapping hits (a pair of equal symbols) every second counts, from the left
            index = np.arange(len(hit))
            run = index - np.maximum.accumulate(np.where(hit, -1, index))
            hit &= run % 2 == 1
            symbols[hit] = self.made[at[hit]]
            keep = np.repeat(~done, size)
            keep[np.flatnonzero(hit) + 1] = False
            size = (size - np.add.reduceat(hit.astype(np.int64), starts))[~done]
            symbols, owner = symbols[keep], owner[~done]
        return out


class TokenCounter:
    """Counts of whole texts; remembers those of short units in two generations of at most `remember` each."""

    def __init__(self, path: str, remember: int = 300_000, longest: int = 48):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = RankMerger(merges, model["vocab"])
        added = spec["added_tokens"]
        if spec["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("only byte-level vocabularies without a normalizer are supported")
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}
        self.remember, self.longest = remember, longest

    def _learn(self, units: list[str]) -> dict[str, int]:
        pieces = [_PIECES.findall(u) for u in units]
        distinct = list({p for own in pieces for p in own})
        count = dict(zip(distinct, self.merger.counts([p.encode() for p in distinct]).tolist()))
        return {u: sum(map(count.__getitem__, own)) for u, own in zip(units, pieces)}

    def count(self, texts: list[str | None]) -> list[int]:
        extra, units = [0] * len(texts), []
        for n, text in enumerate(texts):
            runs = [text or ""]
            if self.special and self.special.search(runs[0]):
                runs = self.special.split(runs[0])
                extra[n] = len(runs) - 1
            units.append([u for run in runs for u in _UNITS.findall(run)])
        new = [u for u in set().union(*units) if u not in self.known]
        self.known |= {u: self.before[u] for u in new if u in self.before}
        fresh = self._learn([u for u in new if u not in self.before])
        self.known |= fresh
        out = [e + sum(map(self.known.__getitem__, own)) for e, own in zip(extra, units)]
        for u in fresh:
            if len(u) > self.longest:
                del self.known[u]
        if len(self.known) > self.remember:
            self.before, self.known = self.known, {}
        return out


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", to: str = "n_tokens", batch_chars: int = 2_000_000) -> DataFrame:
    """df with column `to`: the tokens of every whole text under the vocabulary file at `path` (present on each worker).

    Rows are worked on in runs of about batch_chars characters, which bounds the memory; nothing is shuffled."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path)
        for batch in batches:
            out, run, chars = [], [], 0
            for t in batch:
                run.append(t)
                chars += len(t or "")
                if chars >= batch_chars:
                    out += counter.count(run)
                    run, chars = [], 0
            yield pd.Series(out + counter.count(run), dtype="int64") if len(batch) else pd.Series([], dtype="int64")

    return df.withColumn(to, tokens(F.col(text)))
