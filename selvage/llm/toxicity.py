"""Toxicity by a support vector machine over a gapped subsequence string kernel with Nyström landmarks.

The kernel of two words is the normalized sum over their common subsequences of three characters, each weighted by
`decay` for every character that it skips, up to a span of `span`; so a word with characters inserted, or with other
endings, stays close to what it came from. Landmarks are words of labelled sentences; the machine is linear in the
landmarks' whitened kernel values (Nyström) and is trained as a multiple-instance machine: a toxic text's most toxic
word is its witness, every word of a clean text is a negative, but for words that tell: those whose share of toxic
texts is at least twice that of clean ones (less 1.645 standard errors), as labels may be wrong and clean texts quote.
Witnesses that tell are positives, each by how far it leans to toxic texts; if none tells, all that lean there are. As the margin is linear in the kernel values, it folds
into one weight for each subsequence, and a text's margin is that of its most toxic word, scaled to 0..1.

Runs of single letters are one word; digits and signs that stand for letters count as these.

The machine is fitted on the driver from a bounded sample: at most `most_docs` labelled texts of each class, of at
most `most_chars` characters each, taken in order of a hash. Scoring covers every whole text and shuffles nothing.

Defined cases: null and empty text, or text without a word of three letters, has the score of a text with no evidence;
without labels of both classes, or if no word leans to toxic texts or none is left as a negative, every score is the
share of toxic labels (0 if there are none); labels that are null
are left out, and of several labels of one document the largest counts; other columns pass through, and one of the
output's name is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNIT = re.compile(r"[^ \t\r\n]+")
_SPELLED = re.compile(r"(?:(?<![^\W_])[^\W\d_][^\w\n]{1,3}){2,}[^\W\d_](?![^\W_])")
#: Fixed: digits and signs often written for letters.
_FOR = str.maketrans("013457@", "oieasta")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_U = np.uint64


def word_of(unit: str) -> str:
    """The letters of a unit in lower case, signs for letters read as these."""
    unit = unit.lower()
    if unit.isalpha():
        return unit
    if any(c.isalpha() for c in unit):
        unit = unit.translate(_FOR)
    return _NOT_LETTER.sub("", unit)


def units_of(text: str | None) -> list[str]:
    """Units between white space, and runs of spelled-out letters."""
    text = text or ""
    return _UNIT.findall(text) + [_NOT_LETTER.sub("", m) for m in _SPELLED.findall(text)]


def subsequences(words: list[str], decay: float, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, key and weight of each gapped subsequence of three characters of the words between marks."""
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(_U)
    size = np.array([len(m) for m in marked], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    to_end = np.repeat(np.cumsum(size), size) - np.arange(len(chars))
    owners, keys, weights = [], [], []
    for b in range(2, span):
        at = np.flatnonzero(to_end > b)
        for a in range(1, b):
            owners.append(owner[at])
            keys.append((chars[at] << _U(42)) | (chars[at + a] << _U(21)) | chars[at + b])
            weights.append(np.full(len(at), decay ** (b - 2), np.float64))
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(weights)


@dataclass
class Machine:
    """Weight of each subsequence (sorted keys), the margin's offset, and the scale from margin to score."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    offset: float = 0.0
    slope: float = 0.0
    shift: float = -50.0
    decay: float = 0.6
    span: int = 6

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word; without a subsequence, the offset."""
        out = np.full(len(words), self.offset)
        if len(self.keys) and words:
            owner, keys, weight = subsequences(words, self.decay, self.span)
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            value = np.where(self.keys[at] == keys, self.weights[at], 0.0) * weight
            total = np.bincount(owner, value, len(words))
            norm = np.sqrt(np.bincount(owner, weight * weight, len(words)))
            out += total / np.maximum(norm, 1e-9)
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def _kernel_rows(words: list[str], vocabulary: np.ndarray, decay: float, span: int) -> np.ndarray:
    owner, keys, weight = subsequences(words, decay, span)
    at = np.searchsorted(vocabulary, keys)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == keys
    norm = np.sqrt(np.bincount(owner, weight * weight, len(words)))
    out = np.bincount(owner[hit] * len(vocabulary) + at[hit], weight[hit], len(words) * len(vocabulary)).reshape(len(words), -1)
    return (out / np.maximum(norm, 1e-9)[:, None]).astype(np.float32)


def _squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton's method; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(rounds):
        short = 1 - y * (x @ w)
        on = short > 0
        gradient = ridge * w - 2 * x[on].T @ (c[on] * y[on] * short[on])
        if np.abs(gradient).max() < 1e-6:
            break
        hessian = np.diag(ridge) + 2 * (x[on].T * c[on]) @ x[on]
        step = np.linalg.solve(hessian, gradient)
        loss = lambda v: 0.5 * (ridge * v * v).sum() + (c * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
    return w


def fit(texts: list[str], toxic: list[int], landmarks: int = 256, negatives: int = 4000, rounds: int = 4, decay: float = 0.7, span: int = 6, seed: int = 7, tell: float = 2 / 3) -> Machine:
    """A machine from labelled texts."""
    y = np.array(toxic, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    even = Machine(slope=0.0, shift=float(np.clip(np.log(max(share, 1e-20) / max(1 - share, 1e-20)), -50, 50)))
    if not len(y) or y.min() == y.max():
        return even
    numbers: dict[str, int] = {}
    bags = []
    for text in texts:
        words = sorted({w for u in units_of(text) if len(w := word_of(u)) >= 3})  # a set's order changes with each process
        bags.append(np.array(sorted(numbers.setdefault(w, len(numbers)) for w in words), np.int64))
    words = list(numbers)
    flat = np.concatenate(bags) if bags else np.zeros(0, np.int64)
    label = np.repeat(y, [len(b) for b in bags])
    bad, good = np.bincount(flat[label == 1], minlength=len(words)), np.bincount(flat[label == 0], minlength=len(words))
    odds = (np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / ((1 - y).sum() + 1))) * np.sqrt(bad)
    margin, random = odds, np.random.default_rng(seed)
    in_bad, in_good = bad / y.sum(), good / (1 - y).sum()
    lean = in_bad / np.maximum(in_bad + in_good, 1e-300)  # 1: in toxic texts only
    telling = lean - 1.645 * np.sqrt(lean * (1 - lean) / np.maximum(bad + good, 1)) >= tell
    clean = np.flatnonzero((good > 0) & ~telling)
    machine = None
    hard = clean[np.argsort(-odds[clean], kind="stable")[: negatives // 4]]
    for _ in range(rounds):
        witness = np.array([b[np.argmax(margin[b])] for b, t in zip(bags, y) if t and len(b)], np.int64)
        chosen, times = np.unique(witness, return_counts=True)
        own = telling[chosen] if telling[chosen].any() else lean[chosen] > 0.5
        chosen, times = chosen[own], times[own] * lean[chosen[own]]
        rest = np.setdiff1d(clean, chosen)
        if not len(chosen) or not len(rest):
            break
        top = np.argsort(-times, kind="stable")[:negatives]
        chosen, times = chosen[top], times[top]
        often, hard = rest[np.argsort(-good[rest], kind="stable")[: negatives // 2]], hard[np.isin(hard, rest)]
        against = np.unique(np.concatenate([hard, often, random.choice(rest, min(len(rest), negatives), replace=False)]))
        marks = [words[i] for i in chosen[: landmarks * 3 // 4]] + [words[i] for i in hard[: landmarks // 8]] + [words[i] for i in often[: landmarks // 8]]
        vocabulary = np.unique(subsequences(marks, decay, span)[1])
        at_marks = _kernel_rows(marks, vocabulary, decay, span)
        values, vectors = np.linalg.eigh((at_marks @ at_marks.T).astype(np.float64))
        use = values > 1e-6 * values.max()
        whiten = vectors[:, use] / np.sqrt(values[use])
        # witnesses with a letter inserted are positives too
        spread = [(words[i][: (k := 1 + int(random.integers(len(words[i]) - 1)))] + chr(97 + int(random.integers(26))) + words[i][k:]) for i in np.repeat(chosen[:300], 3)]
        sample = [words[i] for i in chosen] + spread + [words[i] for i in against]
        nystroem = np.vstack([_kernel_rows(sample[i : i + 1000], vocabulary, decay, span) @ at_marks.T for i in range(0, len(sample), 1000)]) @ whiten
        side = np.append(np.ones(len(chosen) + len(spread)), -np.ones(len(against)))
        times = np.sqrt(np.append(times, np.repeat(times[:300], 3) / 100))
        cost = np.append(times * len(against) / times.sum(), np.ones(len(against))) * 4
        w = _squared_hinge(nystroem, side, cost)
        machine = Machine(vocabulary, at_marks.T.astype(np.float64) @ (whiten @ w[:-1]), float(w[-1]), decay=decay, span=span)
        margin = np.concatenate([machine.margins(words[i : i + 20_000]) for i in range(0, len(words), 20_000)])
        hard = clean[np.argsort(-margin[clean], kind="stable")[: negatives // 2]]
    if machine is None:
        return even
    best = np.array([margin[b].max() if len(b) else machine.offset for b in bags])
    # scale: logistic regression on the texts' margins, classes weighted alike, with a small ridge
    x, weight, v = np.stack([best, np.ones(len(best))], 1), np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -50, 50)))
        gradient = x.T @ (weight * (p - y)) + 1e-4 * v
        v = v - np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 1e-4 * np.eye(2), gradient).clip(-2, 2)
    machine.slope, machine.shift = float(v[0]), float(v[1])
    return machine


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most_docs: int = 3000, most_chars: int = 20_000, **params) -> Machine:
    """A machine from at most most_docs labelled texts of each class, of at most most_chars characters."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    known = known.withColumn("_order", F.xxhash64("_id"))
    taken = known.where("_y = 1").orderBy("_order", "_id").limit(most_docs).unionByName(known.where("_y = 0").orderBy("_order", "_id").limit(most_docs))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where(F.length("_text") <= most_chars)
    rows = texts.join(F.broadcast(taken), "_id").groupBy("_id", "_order", "_y").agg(F.min("_text").alias("_text")).collect()  # one of each id: at most 2 * most_docs rows of most_chars
    rows.sort(key=lambda r: (r["_order"], r["_text"]))
    return fit([r["_text"] for r in rows], [r["_y"] for r in rows], **params)


def score_toxicity(df: DataFrame, machine: Machine, text: str = "text", to: str = "toxicity", remember: int = 250_000, at_once: int = 4000) -> DataFrame:
    """df with column `to`, 0..1, of every whole text. A task remembers the margins of at most `remember` words and computes `at_once` new ones at a time."""
    shared = df.sparkSession.sparkContext.broadcast(machine)  # at most `landmarks` words' subsequences

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, known = shared.value, {}
        for texts in batches:
            out = np.full(len(texts), own.offset)
            for n, t in enumerate(texts):
                units = set(units_of(t))
                new = [u for u in units if u not in known]
                for i in range(0, len(new), at_once):
                    part = new[i : i + at_once]
                    words = [word_of(u) for u in part]
                    margins = own.margins([w if len(w) >= 3 else "" for w in words])
                    known.update(zip(part, np.where([len(w) >= 3 for w in words], margins, own.offset).tolist()))
                out[n] = max(map(known.__getitem__, units), default=own.offset)
                if len(known) > remember:
                    known.clear()
            yield pd.Series(own.score(np.maximum(out, own.offset)))

    return df.withColumn(to, scores(F.col(text)))
