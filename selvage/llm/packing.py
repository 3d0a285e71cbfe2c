"""Vector bin packing of tokenized examples into training sequences.

An example is a vector of tokens, segments and loss-bearing tokens, which are its last ones: first comes what the model
reads, then what it learns to say. A sequence has a limit on each. The open sequence takes, again and again, the example
with the largest dot product of its demand and the sequence's free room, both as shares of the limits, among those that
fit. Where none fits whole, the best of those of which a part fits is cut, if cutting is allowed. No limit is ever passed;
which one ends a sequence is up to the scores, and it isn't promised that all are reached. An example that is over
a limit by itself opens sequences with parts of it, which others then fill. A sequence that can't be filled (the shard's
examples run out, or a limit other than that of tokens is reached) is dealt into sequences whose sizes are powers of
two, as those need no padding.

Of a document (tokenize), by default every token bears loss. With loss="last line" the last line that has a character
other than blanks is the answer and bears loss, with what follows it and the end token; what precedes it is context. A
document of one line has no answer and bears none.

Examples are dealt to shards by a hash of their id and their text, so a hot source or a group of copies spreads
evenly; each shard is packed by one task and holds about `shard_tokens` tokens (and one example more).

Defined cases: a null or empty text has only its end token; repeated rows are examples of their own; a null id is
allowed; other columns are dropped; an empty table gives an empty table. A text longer than a sequence fills whole
sequences first.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import chunks, slices

_UNITS = re.compile(r"[^ \t\r\n]+")
#: Fixed: this vocabulary's pattern of pre-tokens, with the letters, digits and white space of Latin-1 in lower case written out.
_LETTER, _DIGIT, _BLANK = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_BLANK}{_LETTER}{_DIGIT}]+")
PIECES = "id long, start long, length long, segments long, loss_tokens long, doc_tokens long, sequence long, offset long, ids binary, sequence_tokens long, sequence_segments long, sequence_loss long"


class Tokens:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    For vocabularies in lower case that drop white space, as their pre-tokens never cross it. A Latin-1 text, which no
    normal form changes, is lowered and cut into pre-tokens here; of another text the runs between white space are
    taken as they are. The library encodes each distinct piece once; pieces in use are remembered in two generations of
    at most `remember` each."""

    def __init__(self, path: str, remember: int = 300_000, longest: int = 48):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.remember, self.longest = remember, longest
        # whether a token ends a word; only vocabularies that say so
        suffix = "</w>"
        vocabulary = self.library.get_vocab()
        self.ends = None
        if getattr(self.library.model, "end_of_word_suffix", None) == suffix:
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[n for t, n in vocabulary.items() if t.endswith(suffix)]] = True

    def _pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _UNITS.findall(text)
        if any(s in text for s in self.special):
            return _UNITS.findall(text)
        return _PIECES.findall(text.lower())

    def _learn(self, new: list[str]) -> None:
        """Encodes pieces that aren't known: those that are one pre-token each as one text, told apart by the tokens that end a word."""
        whole = [u for u in new if _PIECES.fullmatch(u)] if self.ends is not None else []
        if whole:
            ids = np.array(self.library.encode_batch_fast([" ".join(whole)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(whole):
                raw, at = ids.tobytes(), 0
                for u, end in zip(whole, (4 * ends).tolist()):
                    self.known[u], at = raw[at:end], end
                new = [u for u in new if u not in self.known]
        if new:
            got = self.library.encode(new, is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(got.ids, "<u4"), np.array(got.word_ids, np.int64)
            ends = np.searchsorted(owner, np.arange(len(new)), side="right") if len(owner) else np.zeros(len(new), np.int64)
            raw, at = ids.tobytes(), 0
            for u, end in zip(new, (4 * ends).tolist()):
                self.known[u], at = raw[at:end], end

    def _known(self, texts: list[str | None], told) -> list:
        """told(pieces' ids) of each text."""
        cut, known, before, new = [self._pieces(t or "") for t in texts], self.known, self.before, []
        for u in set().union(*cut):
            if u not in known:
                if u in before:
                    known[u] = before[u]
                else:
                    new.append(u)
        self._learn(new)
        out = [told(map(known.__getitem__, pieces)) for pieces in cut]
        for u in new:
            if len(u) > self.longest:
                del known[u]
        if len(known) > self.remember:
            self.before, self.known = known, {}
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self._known(texts, b"".join)

    def count(self, texts: list[str | None]) -> list[int]:
        return [n // 4 for n in self._known(texts, lambda ids: sum(map(len, ids)))]


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def token_counts(path: str, texts: list[str | None]) -> list[int]:
    """Tokens of each text, without an end token."""
    return [n for run in chunks([t or "" for t in texts], 2_000_000) for n in _tokens(path).count(run)]


def parted(text: str) -> tuple[str, str]:
    """What precedes the last line with a character other than blanks, and the rest; a text of one line has no rest."""
    at = text.rfind("\n", 0, len(text.rstrip(" \t\n\r\x0b\x0c")))
    return (text, "") if at < 0 else (text[:at], text[at:])


def tokenize(df: DataFrame, path: str, end: int, id_col: str = "doc_id", text: str = "text", loss: str = "all") -> DataFrame:
    """id, ids (little-endian unsigned 32-bit, the end token last), n_tokens, loss_tokens (of the last ones) and a hash of the text for dealing."""
    if loss not in ("all", "last line"):
        raise ValueError(loss)

    def work(batches):
        tokens, last = _tokens(path), struct.pack("<I", end)
        for batch in slices(batches):
            at = 0
            for run in chunks([t or "" for t in batch.column(1).to_pylist()], 2_000_000):
                if loss == "all":
                    whole = [x + last for x in tokens.encode(run)]
                    bearing = [len(x) // 4 for x in whole]
                else:  # pre-tokens never cross a line's end, so the parts' ids are the text's
                    halves = tokens.encode([x for t in run for x in parted(t)])
                    whole = [a + b + last for a, b in zip(halves[::2], halves[1::2])]
                    bearing = [len(b) // 4 + 1 if b else 0 for b in halves[1::2]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(run)), batch.column(2).slice(at, len(run)), pa.array(whole, pa.binary()), pa.array([len(x) // 4 for x in whole], pa.int64()), pa.array(bearing, pa.int64())],
                    names=["id", "deal", "ids", "n_tokens", "loss_tokens"],
                )
                at += len(run)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(id_col), F.col(text)).alias("deal"))
    return rows.mapInArrow(work, "id long, deal long, ids binary, n_tokens long, loss_tokens long")


def _pow2_sizes(n: int) -> list[int]:
    """The powers of two that sum to n, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _even(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of one sequence in sequences whose sizes are powers of two."""
    out, at, row = [], 0, list(row)
    for want in _pow2_sizes(sum(length for _, _, length in row)):
        part: list[tuple[int, int, int]] = []
        while want:
            i, start, length = row[at]
            take = min(want, length)
            part.append((i, start, take))
            want -= take
            row[at] = (i, start + take, length - take)
            at += take == length
        out.append(part)
    return out


def place(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int], cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, start, length). loss: how many of an example's last tokens bear loss. Examples of the same vector form one class; each step scores the classes."""
    width, most_segments, most_loss = limits
    if not cut and ((tokens > width) | (loss > most_loss)).any():
        raise ValueError(f"{int(((tokens > width) | (loss > most_loss)).sum())} examples are over a sequence's limits, and cutting is off")
    sequences: list[list[tuple[int, int, int]]] = []
    openings: list[tuple[int, int, int]] = []
    begun = np.zeros(len(tokens), np.int64)
    for i in np.flatnonzero((tokens > width) | (loss > most_loss)).tolist():
        n, ahead = int(tokens[i]), int(tokens[i] - loss[i])  # parts that none can hold with the rest
        at = 0
        while n - at > width or n - max(at, ahead) > most_loss:
            take = min(n - at, width, max(0, ahead - at) + most_loss)
            (sequences.append([(i, at, take)]) if take == width else openings.append((i, at, take)))
            at += take
        begun[i] = at
    left = tokens - begun
    classes, member = np.unique(np.stack([left, np.minimum(loss, left)], 1), axis=0, return_inverse=True)
    order = np.argsort(member.ravel(), kind="stable")
    pools = [list(x) for x in np.split(order, np.cumsum(np.bincount(member.ravel(), minlength=len(classes)))[:-1])] if len(classes) else []
    size, cost = classes[:, 0].copy(), classes[:, 1].copy()
    alive = np.array([len(p) for p in pools], np.int64)
    alive[size == 0] = 0
    scale = np.array([1 / width, 1 / most_segments, 1 / most_loss])
    demand = np.stack([size * scale[0], np.full(len(size), scale[1]), cost * scale[2]], 1)
    n = int(alive.sum())
    while n or openings:
        room, row = np.array([width, most_segments, most_loss], np.int64), []
        if openings:
            i, start, take = openings.pop()
            row.append((i, start, take))
            room -= (take, 1, start + take - max(start, min(start + take, int(tokens[i] - loss[i]))))
        while n and room[0] > 0 and room[1] > 0:
            score = demand @ (room * scale)
            fits = (size <= room[0]) & (cost <= room[2]) & (alive > 0)
            if fits.any():
                c = int(np.argmax(np.where(fits, score, -1.0)))
                i, take = int(pools[c].pop()), int(size[c])
                alive[c] -= 1
                n -= 1
                row.append((i, int(begun[i]), take))
                room -= (take, 1, int(cost[c]))
                continue
            most = np.minimum(room[0], size - cost + room[2])
            part = (alive > 0) & (most > 0)
            if not cut or not part.any():
                break
            c = int(np.argmax(np.where(part, score, -1.0)))
            i, take = int(pools[c].pop()), int(most[c])
            alive[c] -= 1
            row.append((i, int(begun[i]), take))
            room -= (take, 1, max(0, take - int(size[c] - cost[c])))
            begun[i] += take
            rest = int(size[c]) - take, min(int(cost[c]), int(size[c]) - take)
            same = np.flatnonzero((size == rest[0]) & (cost == rest[1]))
            if len(same):
                pools[same[0]].append(i)
                alive[same[0]] += 1
            else:
                size, cost, alive = np.append(size, rest[0]), np.append(cost, rest[1]), np.append(alive, 1)
                demand = np.vstack([demand, [rest[0] * scale[0], scale[1], rest[1] * scale[2]]])
                pools.append([i])
        sequences += _even(row) if cut and room[0] > 0 else [row]
    return sequences


def pack(examples: DataFrame, width: int = 4096, max_segments: int = 512, max_loss: int | None = None, cut: bool = True, shards: int | None = None, shard_tokens: int = 4_000_000) -> DataFrame:
    """Pieces of the examples (columns id, deal, ids, n_tokens, loss_tokens), each with its sequence, its offset there and its ids.

    A piece is a segment; its loss-bearing tokens are those of the example's last loss_tokens that it has. Each piece also
    tells its sequence's three loads. Without `shards` the examples are read once more, to sum their tokens."""
    shards = shards or max(1, round((examples.agg(F.sum("n_tokens")).first()[0] or 0) / shard_tokens))
    limits = (width, max_segments, max_loss or width)

    def work(key, rows):
        rows = rows.sort_values(["id", "deal"], kind="stable", ignore_index=True)
        tokens, loss = rows["n_tokens"].to_numpy(np.int64), rows["loss_tokens"].to_numpy(np.int64)
        ids, raw = rows["id"].tolist(), rows["ids"].tolist()
        out = []
        for n, sequence in enumerate(place(tokens, loss, limits, cut)):
            offset = 0
            own = [start + length - max(start, min(start + length, int(tokens[i] - loss[i]))) for i, start, length in sequence]
            loads = sum(length for _, _, length in sequence), len(sequence), sum(own)
            for (i, start, length), bearing in zip(sequence, own):
                out.append((ids[i], start, length, 1, bearing, int(tokens[i]), int(key[0]) << 32 | n, offset, raw[i][4 * start : 4 * (start + length)], *loads))
                offset += length
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
        frame["id"] = frame["id"].astype("Int64")
        return frame

    dealt = examples.withColumn("shard", F.pmod(F.col("deal"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(work, PIECES)


def pack_documents(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text: str = "text", width: int = 4096, shard_bytes: int = 12_000_000, loss: str = "all", **limits) -> DataFrame:
    """pack() of whole texts; the bytes of the texts fix the number of shards, so that each is tokenized once."""
    total = docs.agg(F.sum(F.octet_length(text) + 8)).first()[0] or 0
    return pack(tokenize(docs, path, end, id_col, text, loss), width, shards=max(1, round(total / shard_bytes)), **limits)
