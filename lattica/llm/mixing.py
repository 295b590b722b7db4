"""Mixing sources to target weights with soft memberships.

A classifier fitted on a labelled table (document, domain) gives every document
a posterior over the domains: multinomial naive Bayes over hashed byte
trigrams of whole texts, its mean log-likelihoods tempered on rows it has not
seen. A document then counts for each domain by its tokens times its posterior.
Nonnegative rates, one for each document, are fitted by projected gradient on
the squared distance of the domains' expected token totals from the targets.
A step moves a document's rate by its posterior's product with the residual, so
the residuals so far (a few numbers a step) determine all rates: every step is
one distributed sum over the scored documents, which tries several lengths of it,
and no rate is ever collected. Every few steps the rates are written down, so a
step's work does not grow with those before it. The steps end when the targets
are met, when no step comes closer (targets that no rates meet), or at STEPS; a
mix that is off target then says by how much.

A rate r stands for floor(r) copies and one more with probability r - floor(r),
drawn by a hash of the id.

Results for odd inputs: a null or blank text has no tokens, posteriors equal to
the prior, and a rate that changes no total; domains without labelled rows keep
a posterior of the prior's share; labels outside the targets and null labels are
not used; repeated rows get a rate each; without any tokens all rates are 1; an
empty table gives an empty result; the documents' other columns are not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import tidy
from .scratch import Scratch
from .words import slices, text_array, words

BINS = 1 << 13
#: Bound of the training sample, for each domain.
MOST = 400
#: Lengths of the steps that one pass tries, and after how many steps the rates are written down.
LENGTHS, RENEW = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0), 16
#: A mix is met within this share of all tokens; rates stand still where a step gains less than the second share of the squared distance.
TOLERANCE, STILL = 1e-7, 1e-5
#: Steps taken at most; what is then left is returned and warned of.
STEPS = 60


def _bins(data: np.ndarray) -> np.ndarray:
    """Hashed trigram that starts at each byte (the last two bytes wrap into what follows)."""
    x = data.astype(np.uint32)
    pad = np.concatenate([x, np.zeros(2, np.uint32)])
    code = pad[:-2] * np.uint32(0x9E3779B1) ^ pad[1:-1] * np.uint32(0x85EBCA6B) ^ pad[2:] * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    return (code * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 13)


@dataclass
class Domains:
    """Log probabilities of the bins in each domain, prior and temperature."""

    log_bins: np.ndarray  # (BINS, domains), float32
    log_prior: np.ndarray
    temper: float = 1.0

    def likelihood(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.log_prior)))
        for lo, hi, data, row_at in slices(texts):
            if len(data):
                code = _bins(data)
                size = np.diff(row_at)
                some = np.flatnonzero(size)
                for d in range(len(self.log_prior)):
                    each = self.log_bins[code, d]
                    out[lo + some, d] = np.add.reduceat(each, row_at[some], dtype=np.float64) / size[some]
        return out

    def posterior(self, likelihood: np.ndarray) -> np.ndarray:
        z = likelihood * self.temper + self.log_prior
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(sample: list[tuple[str, int]], n: int) -> Domains:
    """Bins from two thirds of the sample, the temperature from the rest."""
    learn = [s for i, s in enumerate(sample) if i % 3] or sample
    check = [s for i, s in enumerate(sample) if i % 3 == 0] or sample
    count = np.ones((BINS, n))
    for text, d in learn:
        data = np.frombuffer(text.encode(), np.uint8)
        count[:, d] += np.bincount(_bins(data), minlength=BINS) if len(data) else 0
    prior = np.bincount([d for _, d in sample], minlength=n) + 1.0
    m = Domains(np.log(count / count.sum(0)).astype(np.float32), np.log(prior / prior.sum()))
    if not check:
        return m
    like = m.likelihood(text_array(pa.array([t for t, _ in check], pa.string())))
    truth = np.array([d for _, d in check])
    best = None
    for temper in (0.5, 1, 2, 4, 8, 16, 32, 64, 128, 256):
        m.temper = temper
        loss = -np.mean(np.log(np.maximum(m.posterior(like)[np.arange(len(truth)), truth], 1e-12)))
        if best is None or loss < best[0]:
            best = (loss, temper)
    m.temper = best[1]
    return m


def _rates(p: np.ndarray, start: np.ndarray, pulls: np.ndarray, least: float) -> np.ndarray:
    """Rates after some steps: r = max(least, r + p . pull) for each."""
    r = start
    for pull in pulls:
        r = np.maximum(least, r + p @ pull)
    return r


def learn(docs: DataFrame, labelled: DataFrame, names: list[str]) -> Domains:
    """The classifier, from at most MOST labelled documents of each domain."""
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(*names)).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    sample: list[tuple[str, int]] = []
    for d, name in enumerate(names):
        some = known.filter(F.col("domain") == name).orderBy(order, "doc_id").limit(MOST)
        found = texts.join(F.broadcast(some), "doc_id")  # at most MOST rows
        sample += [(r.text or "", d) for r in found.orderBy(order, "doc_id").limit(MOST).select("text").collect()]
    sample = [sample[i] for i in np.random.default_rng(3).permutation(len(sample))]
    return fit(sample, len(names))


def scored(docs: DataFrame, shared, names: list[str], scratch: Scratch) -> DataFrame:
    """doc_id, tokens and posteriors of every document, as a written table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            body = text_array(batch.column(1))
            p = m.posterior(m.likelihood(body))
            count = np.zeros(len(body), np.int64)
            for w in words(body):
                count[w.lo : w.hi] = np.bincount(w.row, minlength=w.hi - w.lo)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(names)).cast(pa.list_(pa.float64()))
            ones = pa.array(np.ones(len(body)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), lists, ones], names=["doc_id", "tokens", "posterior", "rate"])

    return scratch.table("scored", texts.mapInArrow(tidy(run), "doc_id long, tokens long, posterior array<double>, rate double"))


def _sums(table: DataFrame, pulls: np.ndarray, pull: np.ndarray, d: int, least: float) -> tuple[np.ndarray, float]:
    """(expected tokens of each domain after a step of each length, share of the tokens that the shortest one moves)."""
    n = len(LENGTHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, moved = np.zeros((n, d)), np.zeros(2)
        for batch in batches:
            p = batch.column(1).flatten().to_numpy().reshape(-1, d)
            tokens, was = batch.column(0).to_numpy(), _rates(p, batch.column(2).to_numpy(), pulls, least)
            way = p @ pull
            for k, length in enumerate(LENGTHS):
                rate = np.maximum(least, was + length * way)
                total[k] += (tokens * rate) @ p
                if not k:
                    moved += [tokens @ np.abs(rate - was), tokens.sum()]
        yield pa.RecordBatch.from_pydict({"k": np.arange(n * d + 2), "v": np.append(total.ravel(), moved)})

    parts = table.select("tokens", "posterior", "rate").mapInArrow(run, "k long, v double")
    out = np.zeros(n * d + 2)
    for row in parts.groupBy("k").agg(F.sum("v").alias("v")).collect():  # one row for each domain and length
        out[row.k] = row.v
    return out[: n * d].reshape(n, d), out[-2] / out[-1] if out[-1] else 0.0


def _renewed(table: DataFrame, pulls: np.ndarray, d: int, least: float, scratch: Scratch, name: str) -> DataFrame:
    """The table with the rates after the steps so far, so that these need not be taken again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(batch.schema.get_field_index("posterior")).flatten().to_numpy().reshape(-1, d)
            at = batch.schema.get_field_index("rate")
            yield batch.set_column(at, "rate", pa.array(_rates(p, batch.column(at).to_numpy(), pulls, least)))

    return scratch.table(name, table.mapInArrow(run, table.schema))


def fit_rates(
    table: DataFrame, names: list[str], weights: np.ndarray, total: float | str, least: float, scratch: Scratch
) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(table with rates, all steps, targets, totals reached); ``total`` tokens, "same" as now, or "grow" so that no domain shrinks.

    No rate goes below ``least``. A pass over the table takes a step of each of
    LENGTHS and keeps the best.
    """
    d = len(names)
    none = np.zeros(d)
    now = _sums(table, np.zeros((0, d)), none, d, least)[0][0]
    if not now.sum():
        return table, np.zeros((0, d)), now, now
    weights = weights / weights.sum()
    if total == "same":
        total = now.sum()
    elif total == "grow":
        total = (now / np.maximum(weights, 1e-12))[weights > 0].max()
    target = weights * float(total)
    scale = np.maximum(now, 1e-9 * now.sum())
    every, pulls, reached = np.zeros((0, d)), np.zeros((0, d)), now
    for turn in range(STEPS):
        if np.abs(target - reached).max() <= TOLERANCE * target.sum():
            break
        # the scaled problem's curvature is at most 1, so a step of length 1 descends; longer ones may do better
        pull = (target - reached) / scale
        sums, moved = _sums(table, pulls, pull, d, least)
        loss = ((target - sums) ** 2 / scale).sum(1)
        best = int(loss.argmin())
        if moved <= TOLERANCE or loss[best] >= ((target - reached) ** 2 / scale).sum() * (1 - STILL):
            break
        every, pulls = (np.vstack([x, LENGTHS[best] * pull]) for x in (every, pulls))
        reached = sums[best]
        if len(pulls) == RENEW:
            table, pulls = _renewed(table, pulls, d, least, scratch, f"rated-{turn}"), pulls[:0]
            if turn > RENEW:
                scratch.drop(f"rated-{turn - RENEW}")
    return _renewed(table, pulls, d, least, scratch, "rated"), every, target, reached


def residual(target: np.ndarray, reached: np.ndarray) -> float:
    """Largest distance of a domain from its target, as a share of all; a warning if the targets are not met."""
    left = float(np.abs(target - reached).max() / target.sum()) if target.sum() else 0.0
    if left > TOLERANCE:
        warnings.warn(f"the mix is {left:.2g} of its tokens off target", stacklevel=3)
    return left


def mix(
    spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | str = "same"
) -> DataFrame:
    """doc_id, domain (likeliest), tokens, posterior, rate and copies of every document, and the residual of the whole mix."""
    names = sorted(targets)
    scratch = Scratch(spark, "mixing")
    shared = spark.sparkContext.broadcast(learn(docs, labelled, names))  # BINS x domains numbers
    table = scored(docs, shared, names, scratch)
    table, _, target, reached = fit_rates(table, names, np.array([targets[n] for n in names], float), total, 0.0, scratch)
    left = residual(target, reached)
    likeliest = F.array_position("posterior", F.array_max("posterior")).cast("int")
    domain = F.get(F.array(*[F.lit(n) for n in names]), likeliest - 1)
    out = table.select("doc_id", domain.alias("domain"), "tokens", "posterior", "rate")
    return out.withColumn("copies", copies(F.col("doc_id"), F.col("rate"))).withColumn("residual", F.lit(left))


def copies(doc_id: Column, rate: Column) -> Column:
    """Whole copies for a rate, with the fraction drawn by the id; 1e-6 is taken for rounding."""
    u = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("copies")), 11) / F.lit(2.0**53)
    whole = F.floor(rate + F.lit(1e-6))
    return (whole + (u < rate - whole).cast("int")).cast("int")


def resample(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | str = "grow") -> DataFrame:
    """The documents with all their columns, as often as their rates say.

    Where the total grows no rate goes below 1, so no document is lost. Rates are
    worked out again beside each text, so nothing is joined.
    """
    least = 1.0 if total == "grow" else 0.0
    names = sorted(targets)
    shared = spark.sparkContext.broadcast(learn(docs, labelled, names))
    scratch = Scratch(spark, "mixing")
    table = scored(docs, shared, names, scratch)
    _, pulls, target, reached = fit_rates(table, names, np.array([targets[n] for n in names], float), total, least, scratch)
    residual(target, reached)
    scratch.drop("scored", "rated")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = m.posterior(m.likelihood(text_array(batch.column(at))))
            rate = _rates(p, np.ones(len(p)), pulls, least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "__rate"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__rate", T.DoubleType())])
    rated = docs.mapInArrow(tidy(run), schema)
    times = F.sequence(F.lit(1), copies(F.col("doc_id").cast("long"), F.col("__rate")))
    some = rated.filter(copies(F.col("doc_id").cast("long"), F.col("__rate")) > 0)
    return some.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(times).alias("__copy")).drop("__copy")
