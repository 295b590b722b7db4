"""Token ids as fixed-stride binary shards in training order.

Documents are tokenised once and laid end to end, each with the end token after
it, into sequences of a fixed number of tokens. A keyed Feistel permutation of
[0, 2**(2w)) with cycle-walking maps each sequence's index to its global slot in
[0, N): no state, no sort over the whole corpus, and the same key gives the same
order. Shard k holds the slots [k * S, (k + 1) * S) back to back, so a reader
seeks to slot * stride and resumes anywhere.

Each map task compresses what it has for a shard into one blob; blobs are dealt
by ranges of shards, and one task assembles a shard at a time (S records, a
fixed size). Spark's own writer commits the files, so a retried task never
leaves half a shard and any file system that Spark writes will do.

Results for odd inputs: a null or empty text is only its end token; a null
``doc_id`` is carried as null; texts longer than a sequence run over as many as
they need; each input task's last sequence is filled up with the end token and
``n_tokens`` says where it ends; repeated rows are sequences' content like any
other; an empty table writes no shard; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Vocabulary, encoder
from .scratch import Scratch
from .words import mix, text_array

ROUNDS = 4


def _round_keys(key: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of [0, n), or its inverse, of an array of indices."""
    w = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << w) - np.uint64(1)
    keys = _round_keys(key)
    keys = keys[::-1] if inverse else keys

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> w, x & mask
        for k in keys:
            if inverse:
                a, b = b ^ (mix(a + k) & mask), a
            else:
                a, b = b, a ^ (mix(b + k) & mask)
        return a << w | b

    out = once(np.asarray(index).astype(np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _pack(shared, length: int, end: int, dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(shared.value)
        pid = TaskContext.get().partitionId()
        at = 0
        tokens = np.zeros(0, dtype)
        owners: list = []  # ids of the documents in the buffer
        ends = np.zeros(0, np.int64)  # where each of them ends, in the buffer

        def cut(whole: int, fill: int) -> pa.RecordBatch:
            nonlocal at, tokens, owners, ends
            body = tokens[: whole * length]
            used = [length] * whole
            if fill:
                body = np.concatenate([tokens, np.full(length - fill, end, dtype)])
                used = [length] * whole + [fill]
            n = len(used)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            lists = []
            for i in range(n):
                lo = np.searchsorted(ends, i * length, "right")
                hi = np.searchsorted(starts, i * length + used[i], "left")
                lists.append(owners[lo:hi])
            rows = body.reshape(n, length)
            out = pa.RecordBatch.from_arrays(
                [pa.array([pid] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(used, pa.int32()),
                 pa.array(lists, pa.list_(pa.int64())), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["pid", "at", "n_tokens", "doc_ids", "tokens"],
            )
            at += n
            gone = int(np.searchsorted(ends, whole * length, "right"))
            tokens, owners, ends = tokens[whole * length :], owners[gone:], ends[gone:] - whole * length
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, flat, count in tool.ids(text_array(batch.column(1))):
                stop = np.cumsum(count)
                flat = np.insert(flat, stop, end).astype(dtype)
                ends = np.concatenate([ends, len(tokens) + stop + np.arange(1, hi - lo + 1)])
                tokens = np.concatenate([tokens, flat])
                owners = owners + ids[lo:hi]
                if len(tokens) >= length:
                    yield cut(len(tokens) // length, 0)
        if len(tokens):
            yield cut(0, len(tokens))

    return run


def _blobs(n: int, key: int, per_shard: int):
    """One compressed blob for each shard that a batch has records of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            slot = permute(batch.column(0).to_numpy(), n, key)
            order = np.argsort(slot)
            shard = slot[order] // per_shard
            first = np.flatnonzero(np.diff(shard, prepend=-1))
            records = batch.column(1)
            parts = []
            for a, b in zip(first, np.append(first[1:], len(order)), strict=True):
                body = b"".join([slot[order[a:b]].tobytes(), *(records[int(i)].as_py() for i in order[a:b])])
                parts.append(squeeze.compress(body))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[first]), pa.array(np.diff(np.append(first, len(order))).astype(np.int32)), pa.array(parts, pa.binary())],
                names=["shard", "n", "blob"],
            )

    return run


def _assemble(stride: int):
    """Whole shards, from blobs that arrive sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        now, slots, bodies = None, [], []

        def whole() -> pa.RecordBatch:
            order = np.argsort(np.concatenate(slots))
            body = np.concatenate(bodies)[order]
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int64()), "value": pa.array([body.tobytes()], pa.binary())})

        for batch in batches:
            for shard, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and now is not None:
                    yield whole()
                    slots, bodies = [], []
                now = shard
                raw = expand.decompress(blob)
                slots.append(np.frombuffer(raw, np.int64, n))
                bodies.append(np.frombuffer(raw, np.uint8, offset=8 * n).reshape(n, stride))
        if now is not None:
            yield whole()

    return run


def materialise(
    spark: SparkSession, docs: DataFrame, vocabulary: str, path: str, end: int, length: int = 1024, per_shard: int = 4096, key: int = 2024
) -> DataFrame:
    """Write ``path``/shard=k/ files and return their manifest, a row for each sequence.

    Manifest: slot, shard, offset (bytes into the shard), n_tokens, doc_ids (the
    documents with tokens in the sequence, in order) and tokens_crc32 (of its
    n_tokens tokens). Tokens are little-endian, 2 bytes each for vocabularies of up
    to 65,536 and else 4; a record is ``length`` of them.
    """
    vocab = Vocabulary.read(vocabulary)
    wide = max(int(vocab.merged.max(initial=0)), end, *vocab.special.values(), 0) >= 1 << 16
    dtype = np.dtype("<u4" if wide else "<u2")
    stride = length * dtype.itemsize
    shared = spark.sparkContext.broadcast(vocab)
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(_pack(shared, length, end, dtype), "pid long, at long, n_tokens int, doc_ids array<long>, tokens binary")
    packed.write.option("compression", "zstd").parquet(scratch.path("sequences"))
    packed = spark.read.schema(packed.schema).parquet(scratch.path("sequences"))
    # one row for each input task: where its sequences begin
    tasks = packed.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    tasks = scratch.table("tasks", tasks.select("pid", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    n = tasks.agg(F.sum("n")).first()[0] or 0
    indexed = packed.join(tasks.select("pid", "base"), "pid").withColumn("index", F.col("base") + F.col("at"))
    if n:
        shards = -(-n // per_shard)
        blobs = indexed.select("index", "tokens").mapInArrow(_blobs(n, key, per_shard), "shard long, n int, blob binary")
        parts = min(shards, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = blobs.repartitionByRange(parts, "shard").sortWithinPartitions("shard")
        made = dealt.mapInArrow(_assemble(stride), "shard long, value binary")
        # a row is a whole shard; the line end after it lies behind the last record
        made.select("shard", F.col("value").cast("string").alias("value")).write.mode("overwrite").partitionBy("shard").text(path)

    def manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(batch.column(0).to_numpy(), n, key)
            used = batch.column(1).to_numpy()
            crc = [zlib.crc32(memoryview(r.as_buffer())[: k * dtype.itemsize]) for r, k in zip(batch.column(3), used, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard * stride), batch.column(1), batch.column(2), pa.array(crc, pa.int64())],
                names=["slot", "shard", "offset", "n_tokens", "doc_ids", "tokens_crc32"],
            )

    listed = indexed.select("index", "n_tokens", "doc_ids", "tokens")
    return listed.mapInArrow(manifest, "slot long, shard long, offset long, n_tokens int, doc_ids array<long>, tokens_crc32 long")


def read_slots(spark: SparkSession, path: str, start: int, stop: int, length: int = 1024, per_shard: int = 4096, width: int = 2) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, tokens) of the slots [start, stop), shard after shard, from anywhere on."""
    dtype = np.dtype("<u2" if width == 2 else "<u4")
    for shard in range(start // per_shard, -(-stop // per_shard)):
        files = spark.read.format("binaryFile").load(f"{path}/shard={shard}")
        body = np.frombuffer(files.select("content").first()[0], np.uint8)
        lo, hi = max(start - shard * per_shard, 0), min(stop - shard * per_shard, per_shard)
        for i in range(lo, hi):
            at = i * length * width
            yield shard * per_shard + i, body[at : at + length * width].view(dtype)
