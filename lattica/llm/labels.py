"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows of the fold that no classifier learns from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, target: str, most: dict[int, int]) -> list[tuple[str, int]]:
    """(text, label) of at most ``most[label]`` labelled documents outside the held-out fold.

    The sample is chosen by a hash of the id, alike at every size. Null labels and
    ids are left out; an id labelled twice counts with its larger label.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(*most) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = [rows.filter(F.col("y") == y).orderBy(order, "doc_id").limit(n) for y, n in most.items()]
    ids = chosen[0]
    for more in chosen[1:]:
        ids = ids.union(more)
    # at most sum(most) ids of 16 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").select("text", "y", "doc_id")
    found = found.orderBy(order, "doc_id").limit(sum(most.values()))
    return [(r.text or "", r.y) for r in found.collect()]


def logistic(x, y, weight, penalty: float = 1e-2, turns: int = 60):
    """Weighted ridge logistic regression by Newton steps: (coefficients, intercept last)."""
    import numpy as np

    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(design.shape[1])
    ridge = penalty * np.eye(len(beta))
    ridge[-1, -1] = 1e-9
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge @ beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(curve + 1e-9 * np.eye(len(beta)), gradient)
        beta = beta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta
