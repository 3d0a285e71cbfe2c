"""Mixing documents to target weights of domains that they belong to in part.

A classifier fitted on the labelled table gives each document a posterior over the domains; a document of t tokens
with posterior p brings t * p[k] expected tokens of domain k for each time it is taken. Nonnegative rates are fitted so
that these totals match the targets: accelerated projected-gradient least squares, with the residual whitened by the
documents' second moments of p, so that its step is 1. From a rate of 1 each step takes rate = max(least, ahead -
p . theta), where theta is the whitened residual at `ahead`, a vector of as many numbers as there are domains, and
ahead = rate + momentum * (rate - the rate before). A document's rate follows from the thetas alone, so nothing but sums
over all documents is gathered.

Tokens are those of the given vocabulary, counted in every whole text. Rows are read once: posteriors and tokens are
written with the columns that go on.

The classifier (softmax over hashed byte pairs) is fitted on the driver from a bounded sample: at most `most_docs`
labelled texts of each domain, of at most `most_chars` characters, in order of a hash. All else covers every document.

Defined cases: a null or empty text has no tokens and the domains' priors; without labels all domains are equally
likely; a target domain without labels or expected tokens can't be reached and is left out of the fit; where least_rate
keeps targets out of reach, the fit ends at the nearest rates and `gap` tells each domain's distance; repeated rows count
each; rates are at least `least_rate`, and the totals grow accordingly; other columns pass through, and those of the
outputs' names are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, small_batches, written
from .packing import token_counts

_SIZE = 1024


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of the text's hashed byte pairs, and a constant."""
    out = np.zeros(_SIZE + 1)
    out[_SIZE] = 1
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    if len(data) > 1:
        counts = np.bincount((data[:-1] * 33 + data[1:]) % _SIZE, minlength=_SIZE)
        out[:_SIZE] = np.sqrt(counts / (len(data) - 1))
    return out


def fit(texts: list[str], classes: list[int], n: int, ridge: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights (features x classes) of a softmax classifier, classes weighted by how often they come; accelerated gradient."""
    weights = np.zeros((_SIZE + 1, n))
    if not texts:
        return weights
    x, y = np.stack([features(t) for t in texts]), np.eye(n)[np.array(classes)]
    x[:, :_SIZE] *= 8
    step = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + ridge)
    ahead, momentum = weights.copy(), 1.0
    for _ in range(rounds):
        score = x @ ahead
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - step * (x.T @ (p - y) / len(x) + ridge * ahead)
        further = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, weights, momentum = new + (momentum - 1) / further * (new - weights), new, further
    weights[:_SIZE] *= 8
    return weights


def train(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], id_col: str = "doc_id", text: str = "text", most_docs: int = 2000, most_chars: int = 20_000) -> np.ndarray:
    """A classifier of `domains` from labelled texts; domain: the label of a row of the labels table."""
    known = labels.select(F.col(id_col).alias("_id"), domain.alias("_domain")).where(F.col("_domain").isin(domains)).groupBy("_id").agg(F.min("_domain").alias("_domain"))
    known = known.withColumn("_order", F.xxhash64("_id"))
    taken, shares = None, dict(known.groupBy("_domain").count().collect())  # one row for each domain
    for d in domains:
        part = known.where(F.col("_domain") == d).orderBy("_order", "_id").limit(most_docs)
        taken = part if taken is None else taken.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where(F.length("_text") <= most_chars)
    rows = texts.join(F.broadcast(taken), "_id").groupBy("_id", "_order", "_domain").agg(F.min("_text").alias("_text")).collect()  # one of each id: at most most_docs rows of each domain
    rows.sort(key=lambda r: (r["_order"], r["_text"]))
    found = [domains.index(r["_domain"]) for r in rows]
    weights = fit([r["_text"] for r in rows], found, len(domains))
    if rows:  # the sample is even where the labels aren't: priors are put right
        sampled, whole = np.bincount(found, minlength=len(domains)) + 1e-9, np.array([shares.get(d, 0) for d in domains]) + 1e-9
        weights[_SIZE] += np.log(whole / whole.sum()) - np.log(sampled / sampled.sum())
    return weights


def with_posteriors(df: DataFrame, weights: np.ndarray, tokenizer: str, text: str = "text") -> DataFrame:
    """df (columns of other names) with _tokens and _p0, _p1, ... of every whole text."""
    n = weights.shape[1]

    @F.arrow_udf("_tokens long, " + ", ".join(f"_p{k} double" for k in range(n)))
    def score(texts: pa.Array) -> pa.Array:
        x, tokens = np.zeros((len(texts), n)), np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), 100):  # few texts are Python objects at a time
            some = texts.slice(at, 100).to_pylist()
            x[at : at + 100] = np.stack([features(t) for t in some]) @ weights
            tokens[at : at + 100] = token_counts(tokenizer, some)
        p = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
        p = p / p.sum(1, keepdims=True)
        return pa.StructArray.from_arrays([pa.array(tokens), *[pa.array(p[:, k]) for k in range(n)]], names=["_tokens", *[f"_p{k}" for k in range(n)]])

    return df.withColumn("_posterior", score(F.col(text))).select(*df.columns, "_posterior.*")


def momenta(n: int) -> list[float]:
    """How far each of n steps looks ahead."""
    out, t = [], 1.0
    for _ in range(n):
        further = (1 + (1 + 4 * t * t) ** 0.5) / 2
        out.append((t - 1) / further)
        t = further
    return out


def state_of(thetas: list[np.ndarray], least: float, before: int = 0) -> Column:
    """Struct of a document's rate and the point ahead of it after these steps, from a rate of 1, or from _rate and _ahead if steps have gone before."""
    one = F.lit(1.0)
    start = F.struct((F.col("_rate") if before else one).alias("rate"), (F.col("_ahead") if before else one).alias("ahead"))
    if not thetas:
        return start
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in (*theta, m)]) for theta, m in zip(thetas, momenta(before + len(thetas))[before:])])

    def step(state: Column, s: Column) -> Column:
        moved = F.greatest(F.lit(float(least)), state["ahead"] - sum((F.col(f"_p{k}") * s[k] for k in range(len(thetas[0]))), F.lit(0.0)))
        return F.struct(moved.alias("rate"), (moved + s[len(thetas[0])] * (moved - state["rate"])).alias("ahead"))

    return F.aggregate(steps, start, step)


def rate_of(thetas: list[np.ndarray], least: float) -> Column:
    return state_of(thetas, least)["rate"]


@dataclass
class Fit:
    """The steps' thetas, and the tokens of each domain: wanted, and expected at the rates reached."""

    thetas: list[np.ndarray]
    want: np.ndarray
    have: np.ndarray

    @property
    def gap(self) -> np.ndarray:
        """What each domain has over its target, as a share of all tokens wanted."""
        return (self.have - self.want) / max(float(self.want.sum()), 1e-300)


def fit_rates(posteriors: DataFrame, targets: list[float], least: float = 0.0, total: float | None = None, rounds: int = 60, close: float = 1e-4, steps_between: int = 8) -> Fit:
    """The fit to the targets. posteriors: a written table with _tokens and _p<k>.

    Rates are written after every `steps_between` steps, so that no step repeats more than so many before it.

    total: the tokens wanted; by default as many as there are, but at least so many that no domain has to shrink below
    `least` times what it has."""
    n = len(targets)
    p = [F.col(f"_p{k}") for k in range(n)]
    sums = posteriors.agg(F.sum("_tokens"), *[F.sum(F.col("_tokens") * x) for x in p], *[F.sum(F.col("_tokens") * p[j] * p[k]) for j in range(n) for k in range(n)]).first()
    if not sums[0]:
        return Fit([], np.zeros(n), np.zeros(n))
    have = np.array(sums[1 : n + 1], float)
    moments = np.array(sums[n + 1 :], float).reshape(n, n)
    share = np.where(have > 1e-9 * sums[0], np.array(targets, float), 0.0)
    share = share / share.sum()
    use = share > 0
    total = total or max(float(sums[0]), least * float((have[use] / share[use]).max()))
    want = share * total
    inverse = np.linalg.pinv(moments[np.ix_(use, use)], rcond=1e-9)
    thetas: list[np.ndarray] = []
    ahead, off = have, []
    rates, before = posteriors, 0
    for _ in range(rounds):
        off.append(np.abs(np.where(use, have - want, 0.0)).max())
        # done when close, or when eight steps have brought nothing: least_rate may keep the targets out of reach
        if off[-1] <= close * total or (len(off) > 8 and min(off[-8:]) > 0.99 * min(off[:-8])):
            break
        theta = np.zeros(n)
        theta[use] = inverse @ (ahead - want)[use]
        thetas.append(theta)
        state = rates.select("_tokens", *p, state_of(thetas[before:], least, before).alias("_s"))
        if len(thetas) - before == steps_between:
            reached = written(state.select("_tokens", *p, F.col("_s.rate").alias("_rate"), F.col("_s.ahead").alias("_ahead")), "rates")
            if before:
                discard(rates)
            rates, before = reached, len(thetas)
            state = rates.select("_tokens", *p, state_of([], least, before).alias("_s"))
        sums = state.agg(*[F.sum(F.col(f"_s.{at}") * F.col("_tokens") * x) for at in ("rate", "ahead") for x in p]).first()
        have, ahead = np.array(sums[:n], float), np.array(sums[n:], float)
    if before:
        discard(rates)
    return Fit(thetas, want, have)


def mix(df: DataFrame, weights: np.ndarray, targets: dict[str, float], tokenizer: str, id_col: str = "doc_id", text: str = "text", least_rate: float = 0.0, total: float | None = None, seed: int = 11, carry: list[str] | None = None) -> DataFrame:
    """df (all columns, or those in `carry`) with n_tokens, posterior (one share for each domain of targets, in their
    order), rate, copies (the rate rounded up or down by a hash of the row), and gap: how far each domain's expected
    tokens end above its target, as a share of all, the same in every row."""
    out = ("n_tokens", "posterior", "rate", "copies", "gap")
    carry = df.columns if carry is None else carry
    names = {c: f"_u{n}_" for n, c in enumerate(carry) if c not in out}
    chance = F.pmod(F.xxhash64(F.col(id_col), F.col(text), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    # the text waits for its scores once, under its own name or another
    scored_by = names.get(text, "_text")
    own = [] if text in names else [F.col(text).alias("_text")]
    rows = df.select(*[F.col(f"`{c}`").alias(u) for c, u in names.items()], *own, chance.alias("_chance"))
    with small_batches(df.sparkSession):
        scored = with_posteriors(rows, weights, tokenizer, scored_by)
        scored = written(scored.drop("_text"), "posteriors")
    fit = fit_rates(scored.select("_tokens", *[f"_p{k}" for k in range(len(targets))]), list(targets.values()), least_rate, total)
    done = scored.withColumn("_rate", rate_of(fit.thetas, least_rate))
    return done.select(
        *[F.col(u).alias(c) for c, u in names.items()],
        F.col("_tokens").alias("n_tokens"),
        F.array(*[F.col(f"_p{k}") for k in range(len(targets))]).alias("posterior"),
        F.col("_rate").alias("rate"),
        F.floor(F.col("_rate") + F.col("_chance")).cast("int").alias("copies"),
        F.array(*[F.lit(float(g)) for g in fit.gap]).alias("gap"),
    )
