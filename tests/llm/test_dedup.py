"""Exact and near dedup against brute force."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lattica.llm.exact_dedup import directory, exact_dedup, keep_one
from lattica.llm.near_dedup import RADIUS, components, near_dedup
from lattica.llm.scratch import Scratch

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text, width):
    words = WORD.findall((text or "").encode().translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def brute(rows, width=3, percent=85):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, width))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y):
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Groups of edits round the threshold, a passage many share, chains and strangers."""
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 200))]
        for _ in range(8):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 12)))))
    passage = [f"p{i}" for i in range(60)]
    rows += [" ".join(passage + [f"q{rng.randrange(10**5)}" for _ in range(rng.randrange(3, 40))]) for _ in range(60)]
    chain = [f"c{i}" for i in range(150)]
    for k in range(25):
        chain = edited(rng, chain, 2)
        rows.append(" ".join(chain))
    hot = [f"h{i}" for i in range(150)]
    rows += [" ".join(edited(rng, hot, rng.randrange(1, 14))) for _ in range(120)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_dedup_equals_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(spark, docs).collect()}
    want = brute(corpus)
    assert {i: c for i, (_, c, _) in got.items()} == want
    assert all(got[i][0] == len(shingles(t, 3)) and got[i][2] == (want[i] == i) for i, t in corpus)


def test_near_dedup_wide_shingles(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup(spark, docs, width=5, percent=80).collect()}
    assert got == brute(corpus, 5, 80)


def test_radius_is_covered_by_the_chunks():
    from lattica.llm.near_dedup import CHUNK, CHUNKS, SYMBOLS

    rng = random.Random(0)
    for _ in range(2000):
        wrong = set(rng.sample(range(SYMBOLS), RADIUS))
        assert min(sum(i in wrong for i in range(c * CHUNK, c * CHUNK + CHUNK)) for c in range(CHUNKS)) <= 1


def test_near_dedup_odd_inputs(spark, odd, empty):
    got = {}
    for r in near_dedup(spark, odd).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert all(v[1] == want[i] for i, vs in got.items() if i is not None for v in vs)
    assert got[None] == [(1, None, True)] and got[3] == [(0, 3, True)] and got[5] == [(0, 5, True)] and len(got[8]) == 2
    assert near_dedup(spark, empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(40)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(df, Scratch(spark, "t"), "cc").collect()}
    assert all(find(i) == c for i, c in got.items())
    assert {x for e in edges for x in e if find(x) != x} <= set(got)


def test_exact_dedup(spark, odd, empty):
    got = [r for r in exact_dedup(spark, odd).collect()]
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in got:
        members = by_sha[r.text_sha256]
        top = max((m for m in members if m is not None), default=None)
        assert r.keep_id == top and r.group_size == len(members) and r.kept == (r.doc_id == top)
    assert exact_dedup(spark, empty).count() == 0


def test_exact_dedup_hash_collisions_are_told_apart(spark, odd):
    """Chains compare bytes: texts of one length in one bucket stay separate."""
    docs = spark.createDataFrame([(i, f"{i % 50:04d}") for i in range(400)], "doc_id long, text string")
    got = {r.doc_id: r for r in exact_dedup(spark, docs, capacity=1).collect()}
    assert all(got[i].keep_id == 350 + i % 50 and got[i].group_size == 8 for i in range(400))
    kept = keep_one(spark, docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(350, 400)) and kept.columns == docs.columns
    assert keep_one(spark, odd).columns == odd.columns


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("h")).union(spark.range(500).select(F.col("id").alias("h")))
    d = directory(keys, capacity=64, max_depth=10)
    rows = d.collect()
    assert all(r["keys"] <= 64 or r.depth == 10 for r in rows)
    assert sum({(r.depth, r.bucket): r["keys"] for r in rows}.values()) == 1500
    assert len({r.depth for r in rows}) > 1


def test_directory_decides_the_owners(spark):
    """Runs of buckets, alike in keys, go to one owner; the chains follow the directory."""
    from pyspark.sql import functions as F

    from lattica.llm.exact_dedup import MAX_DEPTH, build_index, owners
    from lattica.llm.scratch import Scratch

    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2000).alias("text"))
    entries = directory(docs.select(F.xxhash64("text").alias("h")).distinct(), capacity=50)
    few, many = (owners(entries, n).select("cell", "owner", "keys", "depth", "bucket").orderBy("cell").collect() for n in (2, 8))
    assert {r.owner for r in few} == {0, 1} and {r.owner for r in many} == set(range(8))
    assert [r.owner for r in many] == sorted(r.owner for r in many)
    load = {}
    for r in {(r.owner, r.depth, r.bucket, r["keys"]) for r in many}:
        load[r[0]] = load.get(r[0], 0) + r[3]
    assert sum(load.values()) == 2000 and max(load.values()) <= 250 + 2 * 50
    index = build_index(spark, docs, Scratch(spark, "test"), capacity=50).collect()
    owner = {r.cell: r.owner for r in owners(entries, int(spark.conf.get("spark.sql.shuffle.partitions"))).collect()}
    assert len(index) == 2000 and all(r.group_size == 3 and r.owner == owner[(r.h % 2**64) >> (64 - MAX_DEPTH)] for r in index)


def test_colliding_keys_are_compared(spark, monkeypatch):
    """Different texts with one hash and length chain up and are told apart by their bytes."""
    from pyspark.sql import functions as F

    from lattica.llm import exact_dedup as module

    plain = module._keyed
    monkeypatch.setattr(module, "_keyed", lambda docs: plain(docs).withColumn("h", F.lit(7).cast("long")))
    rows = [(1, "ab"), (2, "ba"), (3, "ab"), (4, "cd"), (5, None), (6, "")]
    got = module.exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 4, 1), (5, 6, 2), (6, 6, 2)]
