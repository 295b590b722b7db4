"""Exact top-k inner products by a three-phase uniform threshold.

A vector's score with a query is the sum of partial scores over coordinate
blocks; every (partition of vectors, coordinate block) is a node with a local
score list for each query.

1. Every node sends its k best partial scores of each query, with the vectors'
   full scores, which the partition can look up. The k-th best full score among
   all listed vectors is tau: at least k vectors reach it.
2. tau / blocks is sent to all nodes. A vector whose partial scores are all
   below it sums to less than tau and cannot be in the answer; nodes collect
   only the others, less those whose upper bound (the cutoff in place of every
   part below it) is under tau.
3. The collected vectors' missing parts are added, which gives exact scores; each
   partition passes on its k best and the last k are taken from those.

Queries are taken in blocks of bounded bytes; only one block at a time is on the
driver and in a broadcast. Scores are integers: vectors are floor(scale * x) and
products are summed in float64 while they are below 2**53 and else in int64.

Results for odd inputs: vectors that are null, empty or hold a null or
non-finite component take no part; only vectors of equal length meet; rows with
the query's own ``vec_id`` are never its candidates; other repeated rows are
candidates each; a ``vec_id`` of null is no query and no candidate; ties go to
the smaller ``vec_id``; fewer than k candidates give fewer rows; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bytes of one block of queries, as int64; it bounds the driver and the broadcast.
QUERY_BYTES = 4 << 20
#: Scores computed at once by a task.
TILE = 1 << 22
BLOCKS = 2


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, an array of floor(scale * x); rows that take no part are left out."""
    x = F.col("embedding")
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ok)
    return rows.select("vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, int64 matrix) for every length of vector in the batch."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, int)
    length = np.diff(at)
    for d in np.unique(length):
        rows = np.flatnonzero(length == d)
        yield ids[rows], flat[(at[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)


def _spans(d: int) -> list[slice]:
    blocks = min(BLOCKS, d)
    cut = [d * i // blocks for i in range(blocks + 1)]
    return [slice(a, b) for a, b in zip(cut, cut[1:], strict=False)]


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if bound < 2.0**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _tiles(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple[np.ndarray, np.ndarray]]):
    """(length, first query, ids and matrix of queries, row tags, ids and matrix of vectors)."""
    tag = pid() << 40
    for batch in batches:
        for ids, m in _matrices(batch):
            tags = np.arange(tag, tag + len(ids))
            tag += len(ids)
            if m.shape[1] in queries:
                qid, q = queries[m.shape[1]]
                step = max(1, TILE // max(1, len(m)))
                for lo in range(0, len(qid), step):
                    yield m.shape[1], lo, qid[lo : lo + step], q[lo : lo + step], tags, ids, m


def pid() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def _cut(rows: list[dict[str, np.ndarray]], key: list[str], score: str, tie: str, k: int) -> dict[str, np.ndarray]:
    """The k best rows of each key."""
    joined = {c: np.concatenate([r[c] for r in rows]) for c in rows[0]}
    order = np.lexsort((joined[tie], -joined[score], *[joined[c] for c in reversed(key)]))
    joined = {c: v[order] for c, v in joined.items()}
    n = len(order)
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([joined[c][1:] != joined[c][:-1] for c in key], axis=0)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    top = np.arange(n) - first < k
    return {c: v[top] for c, v in joined.items()}


def _listed(tiles: Iterator[dict[str, np.ndarray]], key: list[str], score: str, tie: str, k: int) -> Iterator[pa.RecordBatch]:
    """One list for the whole partition, cut as it grows."""
    held, n = [], 0
    for rows in tiles:
        held.append(rows)
        n += len(rows[tie])
        if n > 500_000:
            held = [_cut(held, key, score, tie, k)]
            n = len(held[0][tie]) // 2
    if held:
        yield pa.RecordBatch.from_pydict(_cut(held, key, score, tie, k))


def _phase_one(shared, k: int):
    """The node's k best partial scores of each query, with full scores."""

    def tiles(batches):
        for d, lo, qid, q, tags, ids, m in _tiles(batches, shared.value):
            own = qid[:, None] == ids[None, :]
            parts = [_product(q[:, span], m[:, span]) for span in _spans(d)]
            n = len(ids)
            for b, part in enumerate(parts):
                ranked = np.where(own, np.iinfo(np.int64).min, part)
                at = np.argpartition(ranked, n - k, axis=1)[:, -k:] if n > k else np.broadcast_to(np.arange(n), part.shape)
                row, col = np.nonzero(~np.take_along_axis(own, at, 1))
                col = at[row, col]
                yield {
                    "q": lo + row, "d": np.full(len(row), d), "block": np.full(len(row), b), "tag": tags[col],
                    "part": part[row, col], "total": sum(p[row, col] for p in parts),
                }

    return lambda batches: _listed(tiles(batches), ["q", "d", "block"], "part", "tag", k)


def _phase_two(shared, cutoffs, k: int):
    """Exact scores of the entries at or above the cutoff that can still reach tau."""

    def tiles(batches):
        for d, lo, qid, q, tags, ids, m in _tiles(batches, shared.value):
            tau = cutoffs.value[d][lo : lo + len(qid), None]
            spans = _spans(d)
            edge = tau / len(spans)
            parts = [_product(q[:, span], m[:, span]) for span in spans]
            over = np.zeros(parts[0].shape, bool)
            bound = np.zeros(parts[0].shape)
            for part in parts:
                hit = part >= edge
                over |= hit
                bound += np.where(hit, part, edge)
            slack = 1 + 1e-9 * np.abs(np.where(np.isfinite(tau), tau, 0))
            over &= ~(bound < tau - slack) & (qid[:, None] != ids[None, :])
            row, col = np.nonzero(over)
            yield {
                "q": lo + row, "d": np.full(len(row), d), "query_id": qid[row], "vec_id": ids[col],
                "score": sum(p[row, col] for p in parts), "tag": tags[col],
            }

    return lambda batches: _listed(tiles(batches), ["q", "d"], "score", "vec_id", k)


def _query_blocks(queries: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of queries of bounded bytes, each as length -> (ids, matrix)."""
    held: dict[int, list] = {}
    used = 0
    for row in queries.toLocalIterator():
        held.setdefault(len(row.v), []).append((row.vec_id, row.v))
        used += 8 * len(row.v)
        if used >= QUERY_BYTES:
            yield _packed(held)
            held, used = {}, 0
    if held:
        yield _packed(held)


def _packed(held: dict[int, list]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {d: (np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.int64)) for d, rows in held.items()}


def _cutoffs(lists: DataFrame, block: dict, k: int) -> dict[int, np.ndarray]:
    """tau of each query of one block; minus infinity where fewer than k vectors are listed."""
    place = F.row_number().over(Window.partitionBy("q", "d").orderBy(F.desc("total"), "tag"))
    kth = lists.select("q", "d", "tag", "total").distinct().withColumn("place", place).filter(F.col("place") == k)
    out = {d: np.full(len(ids), -np.inf) for d, (ids, _) in block.items()}
    for row in kth.collect():  # one row for each query of the block
        out[row.d][row.q] = row.total
    return out


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of every query's k best vectors.

    ``is_query`` is a condition on ``vec_id``.
    """
    scratch = Scratch(spark, "top-k")
    ready = scratch.table("vectors", integer_vectors(vectors, scale))
    found = []
    for n, block in enumerate(_query_blocks(ready.filter(is_query))):
        shared = spark.sparkContext.broadcast(block)  # at most QUERY_BYTES and one row
        lists = ready.mapInArrow(_phase_one(shared, k), "q long, d long, block long, tag long, part long, total long")
        cutoffs = spark.sparkContext.broadcast(_cutoffs(lists, block, k))
        kept = ready.mapInArrow(_phase_two(shared, cutoffs, k), "q long, d long, query_id long, vec_id long, score long, tag long")
        place = Window.partitionBy("q", "d").orderBy(F.desc("score"), "vec_id", "tag")
        best = kept.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        found.append(scratch.table(f"block-{n}", best.select("query_id", "rank", "vec_id", "score")))
        shared.unpersist()
        cutoffs.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(found[0].schema).parquet(*[scratch.path(f"block-{n}") for n in range(len(found))])
