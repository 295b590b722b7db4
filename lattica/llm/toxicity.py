"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

Both dictionaries are trained by zstandard: the ordinary one on windows of
ordinary texts, the toxic one on what toxic texts repeat and ordinary ones do
not have, cut out of each toxic text (on whole toxic windows the trainer fills a
dictionary with the ordinary wording that most of their bytes are; the README
has the figures). The toxic side compresses with
both, so a window costs the same under either unless it holds toxic wording, and
then fewer bytes under the toxic one. Strings that ordinary windows share with
the toxic wording are added to the ordinary part (rounds of hard negatives),
which makes them as cheap there. A text's score is a logistic curve over its
windows' savings (largest, number above the cuts, sum by length), fitted and
calibrated on labelled texts that the dictionaries have not seen.

Whole texts are compressed, in overlapping windows of fixed bytes. The fit uses
a bounded sample of labelled rows outside the held-out fold.

Results for odd inputs: a null or empty text is one empty window (the lowest
scores); without both classes among the labels every score is the share of
label 1, or 0; rows that repeat an id are scored each; ids that are null are in
no fold's training rows; an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import held_out, logistic, training_sample
from .words import slices, text_array

WINDOW, STRIDE = 64, 48
LEVEL = 6
#: Bytes of the strings that are counted in both classes, and the toxic share they need.
GRAMS, PURE = (5, 7, 9), 0.75
#: Bounds of the training sample (documents) and of the dictionaries' parts (bytes).
MOST_TOXIC, MOST_ORDINARY = 1500, 3000
ORDINARY_BYTES, TOXIC_BYTES = 16384, 1024
#: The trainer's segment and string sizes for the toxic dictionary.
SEGMENT, MATCH = 16, 6
#: Bounds of the windows, by hash over whole texts: a dictionary learns from, hard negatives are sought in, and a round of these takes up.
MOST_WINDOWS, MOST_PROBES, MOST_HARD = 100_000, 200_000, 2000
#: Fixed value: what ends a trained dictionary's tables, before its content.
REPEATS = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BLANK = re.compile(rb"[\x20\x09-\x0D]+")


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    beta: np.ndarray | None
    constant: float = 0.0

    def tools(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        return tuple(
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how
            )
            for d in (self.toxic + self.ordinary, self.ordinary)
        )


def _savings(tools, data: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that the toxic dictionary saves, row) of every window of the rows."""
    size = np.diff(row_at)
    count = np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE))
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    start = row_at[row] + nth * STRIDE
    length = np.minimum(WINDOW, row_at[row + 1] - start)
    some = np.flatnonzero(length > 0)
    saved = np.zeros(len(row), np.int64)
    if len(some):
        spans = np.stack([start[some], length[some]], 1).astype(np.uint64).tobytes()
        body = zstandard.BufferWithSegments(data.tobytes().lower(), spans)
        toxic, ordinary = (np.fromiter(map(len, t.multi_compress_to_buffer(body, threads=1)), np.int64, len(some)) for t in tools)
        saved[some] = ordinary - toxic
    return saved, row


def _features(saved: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    first = np.searchsorted(row, np.arange(n))
    count = np.diff(np.append(first, len(row)))
    gain = np.clip(saved, 0, None)
    cuts = [np.add.reduceat((saved >= c).astype(float), first) for c in (2, 3, 4, 6)]
    total = np.add.reduceat(gain.astype(float), first)
    out = [np.minimum(np.maximum.reduceat(gain, first), 12), total / np.sqrt(count), *[np.log1p(c) for c in cuts]]
    out += [cuts[1] / count, np.log1p(count)]
    return np.column_stack(out)


def _of_texts(tools, texts: list[str]) -> np.ndarray:
    out = []
    for lo, hi, data, row_at in slices(text_array(pa.array(texts, pa.string()))):
        out.append(_features(*_savings(tools, data, row_at), hi - lo))
    return np.concatenate(out)


def _wording(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Strings that toxic texts repeat and ordinary ones do not have, most frequent first."""

    def grams(word: bytes) -> list[tuple[int, bytes]]:
        word = b" " + word + b" "
        return [(i, word[i : i + n]) for n in GRAMS for i in range(len(word) - n + 1)]

    counts = []
    for texts in (toxic, ordinary):
        docs_with: Counter = Counter()
        for t in texts:
            docs_with.update({g for w in set(_WORD.findall(t.encode().lower())) for _, g in grams(w)})
        counts.append(docs_with)
    bad, good = counts
    share = len(toxic) / (len(toxic) + len(ordinary))
    sure = 16 / -np.log(share)  # so rare by chance that some 10**7 strings would give one
    held = {g: k for g, k in bad.items() if k >= sure and k >= PURE * (k + good[g])}
    cores: Counter = Counter()
    for t in toxic:
        for w in _WORD.findall(t.encode().lower()):
            at = [(i, g, held[g]) for i, g in grams(w) if g in held]
            if at:
                top = max(k for *_, k in at)
                at = [(i, i + len(g)) for i, g, k in at if k >= 0.7 * top]
                cores[(b" " + w + b" ")[min(at)[0] : max(e for _, e in at)]] += 1
    return [c for c, k in cores.most_common() if k >= 4]


def _windows(texts: list[str], most: int) -> list[bytes]:
    """At most so many windows of whole texts, those with the smallest hashes; in the order of their hashes."""

    def every() -> Iterator[bytes]:
        for t in texts:
            b = t.encode().lower()
            for i in range(0, max(1, len(b) - (WINDOW - STRIDE)) if b else 0, STRIDE):
                yield b[i : i + WINDOW]

    return heapq.nsmallest(most, every(), key=zlib.crc32)


def _repeated(texts: list[str], wording: list[bytes]) -> list[bytes]:
    """The wording that each text holds, one after the other."""
    if not wording:
        return []
    find = re.compile(b"|".join(re.escape(c) for c in sorted(wording, key=lambda c: (-len(c), c))))
    out = []
    for t in texts:
        body = _BLANK.sub(b" ", b" " + t.encode().lower() + b" ")
        out.append(b"".join(m[0] for m in find.finditer(body)))
    return [s for s in out if len(s) >= 8]  # the trainer takes no shorter ones


def _trained(most: int, samples: list[bytes], **how: int) -> bytes:
    try:
        made = zstandard.train_dictionary(most, samples, **how).as_bytes()
        return made[made.index(REPEATS) + len(REPEATS) :]
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(dict.fromkeys(samples))[:most]


def fit(sample: list[tuple[str, int]]) -> Model:
    """Train the dictionaries on two thirds of the sample and the curve on the rest."""
    if len({y for _, y in sample}) < 2:
        return Model(b"", b" ", None, float(np.mean([y for _, y in sample])) if sample else 0.0)
    by = {y: [t for t, k in sample if k == y] for y in (0, 1)}
    learn = {y: ts[: max(1, 2 * len(ts) // 3)] for y, ts in by.items()}
    check = {y: ts[len(learn[y]) :] or learn[y] for y, ts in by.items()}
    wording = _wording(learn[1], learn[0])
    toxic = _trained(TOXIC_BYTES, _repeated(learn[1], wording), k=SEGMENT, d=MATCH)
    probe = _windows(learn[0], MOST_PROBES)
    ordinary = _trained(ORDINARY_BYTES, probe[:MOST_WINDOWS]) or b" "
    hard: list[bytes] = []
    for _ in range(3 if probe else 0):
        tools = Model(toxic, b"".join(hard) + ordinary, None).tools()
        at = np.concatenate([[0], np.cumsum([len(w) for w in probe])]).astype(np.uint64)
        spans = np.stack([at[:-1], np.diff(at)], 1).astype(np.uint64).tobytes()
        body = zstandard.BufferWithSegments(b"".join(probe), spans)
        cost = [np.fromiter(map(len, t.multi_compress_to_buffer(body, threads=1)), np.int64, len(probe)) for t in tools]
        found = len(hard)
        for i in np.flatnonzero(cost[1] - cost[0] >= 2)[:MOST_HARD]:
            for core in wording:
                for n in range(len(core) - 1, 3, -1):
                    parts = [core[a : a + n] for a in range(len(core) - n + 1) if core[a : a + n] in probe[i]]
                    if parts:
                        hard += [p for p in parts if p not in hard]
                        break
        if len(hard) == found:
            break
    model = Model(toxic, b"".join(hard) + ordinary, None)
    tools = model.tools()
    x = _of_texts(tools, check[0] + check[1])
    y = np.array([0.0] * len(check[0]) + [1.0] * len(check[1]))
    weight = np.where(y > 0, len(y) / y.sum(), len(y) / (len(y) - y.sum())) / 2
    beta = logistic(x, y, weight, penalty=0.1)
    # calibrate: 0.5 goes to the cut that best separates, false alarms counting double
    z = x @ beta[:-1] + beta[-1]
    cuts = np.unique(np.round(z, 6))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    worth = [np.mean(z[y > 0] >= c) - 2 * np.mean(z[y == 0] >= c) for c in cuts]
    beta[-1] -= cuts[int(np.flatnonzero(np.array(worth) == max(worth))[-1])]  # of equals the one with fewer alarms
    model.beta = beta
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of a few KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tools = m.tools() if m.beta is not None else None
        for batch in batches:
            texts = text_array(batch.column(1))
            value = np.full(len(texts), m.constant)
            if tools:
                for lo, hi, data, row_at in slices(texts):
                    x = _features(*_savings(tools, data, row_at), hi - lo)
                    value[lo:hi] = 1 / (1 + np.exp(-np.clip(x @ m.beta[:-1] + m.beta[-1], -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(training_sample(docs, labels, "toxic", {0: MOST_ORDINARY, 1: MOST_TOXIC}))
    out = score(spark, docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
