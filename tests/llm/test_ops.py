"""The other operators: exact references, round trips and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from lattica.llm import queries as Q
from lattica.llm.bpe import Encoder, Vocabulary, token_counts
from lattica.llm.mixing import mix, resample
from lattica.llm.packing import materialise, permute, read_slots
from lattica.llm.quality import _discriminant, keep_good, quality
from lattica.llm.segmentation import MARK, Pieces, Segmenter, segment
from lattica.llm.sharding import grow, reweigh, shard, shard_of, tree
from lattica.llm.topk import top_k
from lattica.llm.toxicity import toxicity

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held_scores(spark, query, target):
    rows = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", target).collect()
    good = [r.score for r in rows if r[target]]
    bad = [r.score for r in rows if not r[target]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    return auc, rows


def test_quality_held_out(spark):
    auc, rows = held_scores(spark, Q.op1_quality, "quality")
    assert auc > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_discriminant_matches_direct_density():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 4)), np.repeat([0, 1], 150)
    x[y == 1] = x[y == 1] * 2 + 1
    m = _discriminant(x, y, 0.2, 0.01)
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    out = []
    for k in (0, 1):
        s = 0.8 * own[k] + 0.2 * (own[0] + own[1]) / 2
        s = 0.99 * s + (0.01 * np.trace(s) / 4 + 1e-9) * np.eye(4)
        d = x - x[y == k].mean(0)
        out.append(-0.5 * (np.sum(d @ np.linalg.inv(s) * d, 1) + np.linalg.slogdet(s)[1]))
    direct = out[1] - out[0]
    assert np.allclose(m.difference(x), np.sign(direct) * np.log1p(np.abs(direct)))


def test_toxicity_held_out(spark):
    auc, rows = held_scores(spark, Q.op8_toxicity, "toxic")
    assert auc > 0.75  # some labels of the small table have no wording to learn from
    clean = [r for r in rows if not r.toxic]
    assert np.mean([r.predicted for r in clean]) < 0.1


@pytest.mark.parametrize("op", [quality, toxicity])
def test_classifiers_odd_inputs(spark, odd, odd_labels, empty, op):
    for labels in (odd_labels, odd_labels.limit(0), odd_labels.filter("doc_id = 1")):
        got = op(spark, odd, labels).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert op(spark, empty, odd_labels).count() == 0


def test_keep_good_keeps_columns(spark, odd, odd_labels):
    assert keep_good(spark, odd, odd_labels).columns == odd.columns


def test_top_k_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.125, 1.0]) * rng.randrange(-3, 4) for _ in range(6)]) for i in range(300)]
    rows += [(400, None), (500, [float("nan")] * 6), (600, [None] * 6), (700, [1.0, 2.0]), (800, [3.0, 1.0]), (200, rows[200][1]), (None, rows[0][1]), (900, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(5)
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in ok:
        if i % 100 == 0:
            found = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q)))
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:10])]
    got = [tuple(r) for r in top_k(spark, df, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert top_k(spark, df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_sharding_law(spark, odd, empty):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 7).cast("int")).alias("text"))
    got = shard(spark, docs).toPandas()
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 8)).all() and (got.grown_shard == 8).mean() == pytest.approx(1 / 9, abs=0.01)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g))) and len(g) == pytest.approx(2500, rel=0.08)
    assert (got["size"] == 1 + 2 * (got.doc_id % 7)).all()
    assert all(zlib.crc32(("é" * (i % 7)).encode()) == c for i, c in zip(got.doc_id[:100], got.text_crc32[:100]))
    odd_rows = shard(spark, odd).collect()
    assert len(odd_rows) == odd.count() and all(r["size"] == 1 for r in odd_rows if r.doc_id in (3, 4))
    assert shard(spark, empty).count() == 0


def test_sharding_moves_only_into_changed_subtrees(spark):
    nodes = tree(8)
    key = F.col("id").cast("string")
    heavier = reweigh(nodes, {5: 2.0})
    rows = spark.range(5000).select(shard_of(key, nodes).alias("a"), shard_of(key, heavier).alias("b"), shard_of(key, grow(nodes, 8)).alias("c")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(b in (4, 5, 6, 7) for _, b in moved)  # the region whose weight grew
    assert all(b in (4, 5) for a, b in moved if a in (4, 5, 6, 7))  # within it, the rack
    assert all(b == 5 for a, b in moved if a in (4, 5))  # within that, the shard
    assert all(r.c in (r.a, 8) for r in rows)


def test_token_counts_equal_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    rng = random.Random(5)
    alphabet = list("aabcdestlmrv '''\"\n\t  !?.,0123éßñ中文😀 　\x1c½²א") + ["<|endoftext|>", "'s", "'ll", "'re", "  ", "\r\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["", "a" * 4000, "'" * 99, "<|endoftext|>" * 3]
    tool = Encoder(Vocabulary.read(BPE))
    col = pa.array(texts).cast(pa.large_string())
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert tool.counts(col).tolist() == [len(w) for w in want]
    ids = [x.tolist() for *_, flat, n in tool.ids(col) for x in np.split(flat, np.cumsum(n)[:-1])]
    assert ids == want
    got = token_counts(spark, odd, BPE, limit=10).collect()
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.n_tokens == len(lib.encode(text[r.doc_id], add_special_tokens=False).ids) and r.n_bytes == len(text[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 10) for r in got)
    assert token_counts(spark, empty, BPE).count() == 0


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = permute(np.arange(n), n, 7)
        assert sorted(p) == list(range(n)) and (permute(p, n, 7, inverse=True) == np.arange(n)).all()
    assert (permute(np.arange(500), 500, 1) != permute(np.arange(500), 500, 2)).any()


def test_packing_round_trip(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    lib, end = Tokenizer.from_file(BPE), 50256
    path = str(tmp_path / "shards")
    made = materialise(spark, odd, BPE, path, end, length=32, per_shard=40).collect()
    made.sort(key=lambda r: r.slot)
    assert [r.slot for r in made] == list(range(len(made)))
    records = dict(read_slots(spark, path, 0, len(made), 32, 40))
    assert all(zlib.crc32(records[r.slot][: r.n_tokens].tobytes()) == r.tokens_crc32 and r.offset == r.slot % 40 * 64 and r.shard == r.slot // 40 for r in made)
    assert [s for s, _ in read_slots(spark, path, 37, 44, 32, 40)] == list(range(37, 44))
    want = sorted(lib.encode(r.text or "", add_special_tokens=False).ids for r in odd.collect())
    assert sum(r.n_tokens for r in made) == sum(len(w) + 1 for w in want)
    assert {i for r in made for i in r.doc_ids} == {r.doc_id for r in odd.collect()}
    assert materialise(spark, empty, BPE, str(tmp_path / "none"), end).count() == 0


def test_mixing_reaches_targets(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Q.op2_mixing(spark, SF).toPandas()
    p = np.array(got.posterior.tolist())
    total = (got.rate * got.tokens).to_numpy() @ p
    share = total / total.sum()
    assert np.allclose(share, [0.2, 0.5, 0.1, 0.2], atol=1e-4) and (got.rate >= 0).all()
    assert total.sum() == pytest.approx(got.tokens.sum(), rel=1e-4)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert np.mean([truth[i] == d for i, d in zip(got.doc_id, got.domain)]) > 0.95
    labelled = odd.select("doc_id", F.col("lang").alias("domain"))
    for frame in (odd, empty):
        out = mix(spark, frame, labelled, {"en": 1, "fr": 1})
        assert out.count() == frame.count()
    again = resample(spark, odd, labelled, {"en": 1, "fr": 1})
    assert again.columns == odd.columns and set(again.select("doc_id").distinct().toPandas().doc_id.dropna()) == set(range(1, 13))
    assert mix(spark, odd, labelled.limit(0), {"en": 1, "fr": 1}).count() == odd.count()


def toy():
    score = {"a": -3.0, "b": -2.5, "ab": -4.0, "ba": -4.5, "aab": -5.0, MARK: -2.0, MARK + "a": -3.3, MARK + "ab": -5.5, MARK * 2: -3.1, "c": -4.0}
    pieces = ["<unk>", *score, *[f"<0x{b:02X}>" for b in range(256)]]
    return Pieces.of("toy", pieces, {p: (i + 1, s) for i, (p, s) in enumerate(score.items())}, list(range(len(score) + 1, len(pieces)))), score


def test_n_best_equals_enumeration():
    vocab, score = toy()
    tool, rng = Segmenter(vocab), random.Random(2)

    def every(text):
        if not text:
            return [0.0]
        out = []
        for j in range(1, min(3, len(text)) + 1):
            if text[:j] in score:
                out += [score[text[:j]] + s for s in every(text[j:])]
        if text[0] not in score:
            out += [vocab.unknown / 1e6 + s for s in every(text[1:])]
        return out

    for _ in range(400):
        text = "".join(rng.choice("aabbc  d") for _ in range(rng.randrange(9)))
        for n in (1, 3, 5):
            ids, scores = tool.encode(text, n)
            want = sorted(every((" " + text).replace(" ", MARK)) if text else [0.0], reverse=True)[:n]
            assert np.allclose(scores, want) and tool.decode(np.array(ids, int)) == text.encode()
    best = tool.search(MARK + "aab", 4)
    assert [s for s, _ in best] == sorted((s for s, _ in best), reverse=True)


def test_segmentation_round_trip(spark, odd, empty):
    got = segment(spark, odd, PIECES).collect()
    assert len(got) == odd.count() and all(r.exact for r in got)
    assert all(r.n_pieces == 0 and r.scores == [0.0] for r in got if r.doc_id in (3, 4))
    assert segment(spark, empty, PIECES).count() == 0


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in Q.ORACLES.items():
        want = con.sql(sql)
        got = Q.QUERIES[name](spark, SF).select(*want.columns)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark):
    from pathlib import Path

    if not (Path(__file__).parents[2] / "corpus_pipeline.py").exists():
        pytest.skip("no pipeline here")
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality_ = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = C.drop_low_quality(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    assert sum(1 for i, q in quality_.items() if q and i not in kept) <= 2 and sum(1 for i, q in quality_.items() if not q and i in kept) <= 3
    assert [name for name, _ in C.STAGES] and len(C.STAGES) == 5
    out = C.run(spark, SF)
    assert out.filter("not exact").count() == 0 and out.count() > 0.7 * len(kept)
