"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct word shingles; two documents are linked when
their sets' Jaccard similarity reaches the threshold, checked on the full sets.
Candidates come from b-bit MinHash signatures: ``SYMBOLS`` minima of 8 bits.
Two signatures within ``RADIUS`` differing symbols have, by the pigeonhole
principle, at least one of ``CHUNKS`` chunks with at most one error, so each
chunk is indexed once for every symbol left out: all pairs within the radius
share a key, whatever the erroneous symbol holds. At similarity 0.85 a pair lies
beyond the radius with a probability of about 2e-6, at 0.80 of about 2.8e-4, less
for anything closer. Thresholds below ``LEAST_PERCENT`` would lose more and are refused.

A key that many rows share never expands into all its pairs:

1. Texts with the same word sequence are folded into one representative.
2. Every row meets only the leader (smallest id) of each of its keys; these
   stars are filtered by signature, confirmed on the full sets and joined into
   components (alternating star contraction, on tables in the shared folder).
3. Rows of one key have the same leader, so every pair left to test lies in one
   leader's cluster, and only clusters that still hold several components matter.
   A cluster is cut into blocks of bounded size and every pair of blocks is a task
   of its own. It compares signatures of rows in different components, counts the
   survivors' intersections on the full sets through posting lists, and returns
   no more links than join its components (a spanning forest). A large group
   of edits of one text therefore never expands into rows for its pairs, and no
   pair within the radius is skipped.

Results for odd inputs: null and blank texts have an empty set and link with
nothing; a text with fewer words than a shingle is one shingle; a null
``doc_id`` takes no part (component_id null, kept true); rows that repeat an id
are one document for linking; ties do not matter, the smallest id names a
component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import maybe_in
from .memory import tidy
from .scratch import Scratch
from .words import mix, text_array, words

CHUNKS, CHUNK = 12, 5
SYMBOLS = CHUNKS * CHUNK
RADIUS = 2 * CHUNKS - 1
#: The lowest threshold that this radius covers.
LEAST_PERCENT = 80
PACKED = [f"s{i}" for i in range(-(-SYMBOLS // 8))]
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, (SYMBOLS, 2), dtype=np.uint64)

_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("seq_a", pa.int64()), ("seq_b", pa.int64()), *[(c, pa.int64()) for c in PACKED]]
)
_SIGNED_SQL = "doc_id long, n_shingles long, seq_a long, seq_b long, " + ", ".join(f"{c} long" for c in PACKED)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]:
    """(lo, hi, shingle hashes, row of each, sequence hashes): sorted and distinct within a row."""
    for w in words(texts):
        h, first = w.hashes(), w.first()
        count = np.diff(first)
        m = len(h) - width + 1
        if m > 0:
            inside = np.flatnonzero(w.row[:m] == w.row[width - 1 :])
            code = np.zeros(len(inside), np.uint64)
            for j in range(width):
                code = mix(code * np.uint64(0xA0761D6478BD642F) + h[inside + j])
            row = w.row[inside]
        else:
            code, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # the whole sequence, position by position, in two independent sums
        place = (np.arange(len(h)) - first[w.row]).astype(np.uint64) if len(h) else np.zeros(0, np.uint64)
        sums = []
        for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)):
            each = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h * salt + place * np.uint64(0xD1342543DE82EF95) + salt), out=each[1:])
            sums.append(mix(each[first[1:]] - each[first[:-1]] + count.astype(np.uint64)))
        few = np.flatnonzero((count > 0) & (count < width))
        code, row = np.concatenate([code, sums[0][few]]), np.concatenate([row, few])
        order = np.lexsort((code, row))
        code, row = code[order], row[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
        yield w.lo, w.hi, code[new], row[new], sums


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, code, row, sums in shingle_sets(text_array(batch.column(1)), width):
                n = hi - lo
                size = np.bincount(row, minlength=n)
                symbols = np.zeros((len(PACKED) * 8, n), np.uint8)
                some = np.flatnonzero(size)
                if len(some):
                    at = np.searchsorted(row, some)
                    for j, (a, b) in enumerate(_SEEDS):
                        low = np.minimum.reduceat(code * (a | np.uint64(1)) + b, at)
                        symbols[j, some] = (mix(low) >> np.uint64(56)).astype(np.uint8)
                packed = np.ascontiguousarray(symbols.T).view(np.int64)
                cols = [ids.slice(lo, n), pa.array(size.astype(np.int64)), *[pa.array(s.view(np.int64)) for s in sums]]
                cols += [pa.array(np.ascontiguousarray(packed[:, i])) for i in range(len(PACKED))]
                yield pa.RecordBatch.from_arrays(cols, schema=_SIGNED)

    return run


def signatures(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, n_shingles, two hashes of the word sequence and the packed signature."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(_sign(width)), _SIGNED_SQL
    )


def _symbol(i: int) -> Column:
    return F.shiftrightunsigned(F.col(PACKED[i // 8]), 8 * (i % 8)).bitwiseAND(F.lit(255))


def _keys() -> Column:
    """One key for each chunk and symbol left out: the chunk's other symbols."""
    out = []
    for c in range(CHUNKS):
        for skip in range(CHUNK):
            key = F.lit(c * CHUNK + skip).cast("long")
            for j in range(CHUNK):
                if j != skip:
                    key = F.shiftleft(key, 8).bitwiseOR(_symbol(c * CHUNK + j))
            out.append(key)
    return F.array(*out)


def _distance(a: str, b: str) -> Column:
    """Differing symbols of two packed signatures."""
    low = F.lit(0x0101010101010101)
    total = F.lit(0)
    for c in PACKED:
        x = F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(low))
    return total


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (a > 0)


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for side in (2, 3):
                rows: list[np.ndarray] = []
                for lo, hi, code, row, _ in shingle_sets(text_array(batch.column(side)), width):
                    rows += np.split(code, np.searchsorted(row, np.arange(1, hi - lo)))
                sets.append(rows)
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(*sets, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    return maybe_in(texts, F.col("doc_id"), wanted, F.col("doc_id")).join(wanted, "doc_id", "left_semi")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, code, row, sums in shingle_sets(text_array(batch.column(1)), width):
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                body = [code[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                cols = [ids.slice(lo, hi - lo), pa.array(sums[0].view(np.int64)), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "seq_a", "codes"])

    return run


#: Shingles of a block of a cluster; a task holds two blocks.
BLOCK_SHINGLES = 1 << 20


def _joining_links(percent: int):
    """Links that join the components of two blocks of a cluster, each tested on the full sets."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp, block, size = (table.column(c).to_numpy() for c in ("doc_id", "component", "block", "n_shingles"))
        signs = np.column_stack([table.column(c).to_numpy().view(np.uint64) for c in PACKED])
        codes = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("codes")]
        sides = np.unique(block)
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        flat = np.concatenate(codes)
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        n, found = len(ids), []
        for x in range(n):
            # later rows of the other block, or of the same one if there is no other
            other = np.arange(x + 1, n)
            if len(sides) > 1:
                other = other[block[other] != block[x]]
            other = other[comp[other] != comp[x]]
            if not len(other):
                continue
            fit = (np.minimum(size[other], size[x]) * 100 >= np.maximum(size[other], size[x]) * percent)
            other = other[fit]
            y = signs[other] ^ signs[x]
            for shift in (4, 2, 1):
                y = y | (y >> np.uint64(shift))
            far = np.bitwise_count(y & np.uint64(0x0101010101010101)).sum(1)
            other = other[far <= RADIUS]
            mine = find(int(comp[x]))
            other = np.array([o for o in other if find(int(comp[o])) != mine], np.int64)
            if not len(other):
                continue
            if len(other) <= 16:
                both = np.array([len(np.intersect1d(codes[x], codes[o], assume_unique=True)) for o in other])
            else:
                lo, hi = np.searchsorted(flat, codes[x], "left"), np.searchsorted(flat, codes[x], "right")
                shift = np.cumsum(hi - lo) - (hi - lo)
                at = np.arange(int((hi - lo).sum())) + np.repeat(lo - shift, hi - lo)
                both = np.bincount(owner[at], minlength=n)[other]
            for o in other[100 * both >= percent * (size[x] + size[other] - both)]:
                p, q = find(int(comp[x])), find(int(comp[o]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found.append((int(ids[x]), int(ids[o])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = scratch.table(f"{name}-texts", _texts_of(texts, wanted))
    both = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(tidy(_confirm(width, percent)), "a long, b long")
    out = scratch.table(f"{name}-links", links)
    scratch.drop(f"{name}-texts")
    return out


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id reached.

    Alternates large and small stars until the edges no longer change. All sets
    stay distributed; only a count and a checksum reach the driver.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.table(f"{name}-0", edges)
    seen = None
    for turn in itertools.count(1):  # until nothing changes
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # every u now points down only
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = scratch.table(f"{name}-{turn}", small.filter("u <> v").distinct())
        scratch.drop(f"{name}-{turn - 1}")
        edges = now
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def near_dedup(spark: SparkSession, docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"signatures cover thresholds of {LEAST_PERCENT} percent or more, not {percent}")
    scratch = Scratch(spark, "near-dedup")
    signed = scratch.table("signed", signatures(docs, width))
    usable = signed.filter("doc_id is not null and n_shingles > 0")
    copies = usable.groupBy("seq_a", "seq_b").agg(
        F.min(F.struct("doc_id", "n_shingles", *PACKED)).alias("r"), F.count(F.lit(1)).alias("copies")
    )
    reps = scratch.table("reps", copies.select("r.*", "seq_a", "seq_b", "copies"))

    keyed = reps.select("doc_id", F.explode(_keys()).alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = scratch.table("shared", keyed.join(leaders.select("key", "a"), "key"))
    stars = shared.filter("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()

    def side(p: str) -> DataFrame:
        return reps.select(*[F.col(c).alias(f"{p}{c}") for c in ("doc_id", "n_shingles", *PACKED)])

    near = (_distance("a_", "b_") <= RADIUS) & _sizes_fit(F.col("a_n_shingles"), F.col("b_n_shingles"), percent)
    stars = stars.join(side("a_"), F.col("a") == F.col("a_doc_id")).join(side("b_"), F.col("b") == F.col("b_doc_id"))
    stars = scratch.table("stars", stars.filter(near).select("a", "b"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    links = confirmed(stars, texts, width, percent, scratch, "stars")
    first = scratch.table("first", components(links, scratch, "first-cc"))

    # leaders whose clusters still hold more than one component
    label = F.coalesce("component", "doc_id").alias("component")
    placed = shared.select("a", "doc_id").distinct().join(first, F.col("doc_id") == F.col("id"), "left").select("a", "doc_id", label)
    placed = placed.join(reps.select("doc_id", "seq_a", "n_shingles", *PACKED), "doc_id")
    mixed = placed.groupBy("a").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("blocks")
    )
    mixed = mixed.filter("lo < hi").select("a", "blocks")
    left = scratch.table("mixed", placed.join(mixed, "a"))
    sets = _texts_of(texts, left.select("doc_id").distinct()).mapInArrow(tidy(_sets(width)), "doc_id long, seq_a long, codes binary")
    sets = scratch.table("sets", sets.dropDuplicates(["doc_id", "seq_a"]))
    split = left.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")))
    split = split.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tasks = split.join(sets, ["doc_id", "seq_a"]).select("a", "i", "j", "doc_id", "component", "block", "n_shingles", *PACKED, "codes")
    more = scratch.table("more", tasks.groupBy("a", "i", "j").applyInArrow(_joining_links(percent), "a long, b long"))
    joined = links.union(more)
    # a row that repeats an id joins its texts' classes; copies join their representative
    twins = usable.join(reps.filter("copies > 1").select("seq_a", "seq_b", F.col("doc_id").alias("rep")), ["seq_a", "seq_b"])
    twins = twins.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = scratch.table("final", components(joined.union(twins), scratch, "final-cc"))
    scratch.drop("shared", "mixed", "sets", "stars", "first")

    out = signed.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
