"""Byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Texts are cut into pre-tokens by character classes, whole batches at a time.
Distinct pre-tokens are held as one ragged array of symbols; in every round each
sequence merges all occurrences of its lowest-ranked pair at once (a merge can
only create pairs of higher rank, so this equals merging one at a time), and the
symbols that survive are the tokens. Pre-tokens met before come from a bounded
cache of the Python worker.

The vocabulary file is read on the driver and sent to the tasks as three arrays
whose size is the vocabulary's.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import _BASE, _BASE_INV, _BYTE, _ODD, _power, mix, slices, text_array

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space.
_WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that are cut off after an apostrophe.
_ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]
#: Distinct pre-tokens kept by a worker before the cache starts anew.
CACHE_PIECES = 1_000_000

_classes: np.ndarray | None = None
_worker: dict[str, "Encoder"] = {}


def char_classes() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    global _classes
    if _classes is None:
        kind = {"L": _LETTER, "N": _NUMBER}
        _classes = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        _classes[_WHITE] = _SPACE
    return _classes


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character; all bytes of a character share it."""
    table = char_classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data.astype(np.uint32, copy=False) if len(lead) * 4 > len(data) else data
        pad = np.concatenate([b, np.zeros(3, b.dtype)])
        c0, c1, c2, c3 = (pad[lead + i].astype(np.uint32) for i in range(4))
        size = np.where(c0 >= 0xF0, 4, np.where(c0 >= 0xE0, 3, 2))
        point = np.where(
            size == 2,
            (c0 & 0x1F) << 6 | c1 & 0x3F,
            np.where(
                size == 3,
                (c0 & 0x0F) << 12 | (c1 & 0x3F) << 6 | c2 & 0x3F,
                (c0 & 0x07) << 18 | (c1 & 0x3F) << 12 | (c2 & 0x3F) << 6 | c3 & 0x3F,
            ),
        )
        kind = table[np.minimum(point, 0x10FFFF)]
        for i in range(4):
            at = size > i
            out[lead[at] + i] = kind[at]
    return out


def pre_tokens(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pre-tokens; ``edges`` are offsets no pre-token crosses.

    The rule: an apostrophe with one of the fixed endings; a run of letters, of
    numbers or of other characters, each with one blank before it; white space,
    without the last character if something follows; that last one.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = byte_classes(data)
    cut = np.zeros(n + 1, bool)
    cut[edges] = True
    cut[0] = cut[n] = True
    hard = cut.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(cut[:n])
    end = np.append(start[1:], n)
    # white space before something on the same side of an edge: its last character stands apart
    space = np.flatnonzero((kind[start] == _SPACE) & ~hard[end])
    last = end[space] - 1
    wide = np.flatnonzero((data[last] & 0xC0) == 0x80)
    while len(wide):
        last[wide] -= 1
        wide = wide[(data[last[wide]] & 0xC0) == 0x80]
    blank = data[last] == 0x20
    cut[last] = True
    cut[end[space][blank]] = False  # a blank goes with what follows
    # apostrophes that start a pre-token and are followed by an ending
    tick = np.flatnonzero((data == 0x27) & cut[:n])
    if len(tick):
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        stop = np.append(np.flatnonzero(hard), n)
        room = stop[np.searchsorted(stop, tick, "right")] - tick
        done = np.zeros(len(tick), bool)
        for ending in _ENDINGS:
            ok = ~done & (room > len(ending))
            for i, c in enumerate(ending):
                ok &= pad[tick + 1 + i] == c
            cut[tick[ok] + 1] = False
            cut[tick[ok] + 1 + len(ending)] = True
            done |= ok
    start = np.flatnonzero(cut[:n])
    return start, np.append(start[1:], n)


@dataclass
class Vocabulary:
    """Merges of a byte-level BPE as arrays."""

    name: str
    byte_ids: np.ndarray  # symbol of each byte
    keys: np.ndarray  # sorted left << 32 | right
    ranks: np.ndarray  # of each key
    merged: np.ndarray  # symbol that a rank's merge gives
    special: dict[bytes, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        """From a tokenizer JSON file (local to the driver)."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, both = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        byte_ids = np.array([vocab[c] for c in _byte_letters()], np.int64)
        return cls(path, byte_ids, key[order], order.astype(np.int64), both, special)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_NEVER = np.iinfo(np.int64).max


def _ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left << 32 | right
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    return np.where(v.keys[at] == key, v.ranks[at], _NEVER)


def merge(v: Vocabulary, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence of a ragged array to the end: (symbols, sizes)."""
    rows = np.flatnonzero(size > 0)
    size = size[rows]
    total = int(rows[-1]) + 1 if len(rows) else 0
    done_rows, done_sizes, done_symbols = [], [], []
    row = np.repeat(np.arange(len(rows)), size)
    rank = np.full(len(symbols), _NEVER)
    same = np.flatnonzero(row[1:] == row[:-1])
    rank[same] = _ranks(v, symbols[same], symbols[same + 1])
    while len(rows):
        first = np.cumsum(size) - size
        low = np.minimum.reduceat(rank, first)
        alive = low < _NEVER
        if not alive.all():
            mask = alive[row]
            done_rows.append(rows[~alive])
            done_sizes.append(size[~alive])
            done_symbols.append(symbols[~mask])
            rows, size, low = rows[alive], size[alive], low[alive]
            symbols, rank = symbols[mask], rank[mask]
            row = np.repeat(np.arange(len(rows)), size)
            if not len(rows):
                break
        hit = np.flatnonzero(rank == low[row])
        # of overlapping occurrences (x x x) every second one merges, from the left
        if len(hit) > 1:
            joint = np.flatnonzero(hit[1:] == hit[:-1] + 1)
            if len(joint):
                run = np.ones(len(hit), bool)
                run[joint + 1] = False
                nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[nth % 2 == 0]
        symbols[hit] = v.merged[rank[hit]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        at = hit - np.arange(len(hit))  # where the merged symbols are after removal
        size = size - np.bincount(row[hit], minlength=len(rows))
        symbols, rank, row = symbols[keep], rank[keep], row[keep]
        n = len(symbols)
        for p in (at, at[at > 0] - 1):
            inside = p[p + 1 < n]
            inside = inside[row[inside] == row[inside + 1]]
            rank[p] = _NEVER
            rank[inside] = _ranks(v, symbols[inside], symbols[inside + 1])
    if not done_rows:
        return np.zeros(0, np.int64), np.zeros(total, np.int64)
    order_rows, order_sizes = np.concatenate(done_rows), np.concatenate(done_sizes)
    flat, begin = np.concatenate(done_symbols), np.cumsum(order_sizes) - order_sizes
    order = np.argsort(order_rows)
    return flat[_ragged(begin[order], order_sizes[order])], order_sizes[order]


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin[i] .. begin[i] + size[i] - 1, one run after the other."""
    if not len(size):
        return np.zeros(0, np.int64)
    shift = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(begin - shift, size)


class Encoder:
    """Token counts and ids of texts, with a cache of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.seen = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2  # large and recent: sorted hashes, slots
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16 if self.v.merged.max(initial=0) < 1 << 16 else np.int32)

    def _slots(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Cache slots of distinct pre-tokens; those not seen yet are merged first."""
        if len(self.begin) > CACHE_PIECES:
            self._clear()
        slot = np.full(len(hashes), -1)
        for known, slots in self.seen:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                slot[hit] = slots[at[hit]]
        new = np.flatnonzero(slot < 0)
        if len(new):
            size = end[new] - start[new]
            symbols = self.v.byte_ids[data[_ragged(start[new], size)]]
            ids, count = merge(self.v, symbols, size)
            slot[new] = len(self.begin) + np.arange(len(new))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
            self.size = np.concatenate([self.size, count])
            self.flat = np.concatenate([self.flat, ids.astype(self.flat.dtype)])
            old, recent = self.seen
            recent = _union(recent, (hashes[new], slot[new]))
            self.seen = [_union(old, recent), (recent[0][:0], recent[1][:0])] if len(recent[0]) * 4 > len(old[0]) else [old, recent]
        return slot

    def pieces(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(lo, hi, row, cache slot, special id or -1) of every pre-token, in order."""
        for lo, hi, data, row_at in slices(texts):
            edges, marks = [row_at], []
            for word, number in self.v.special.items():
                at = _find(data, word)
                at = at[np.searchsorted(row_at, at, "right") == np.searchsorted(row_at, at + len(word), "left")]
                if len(at):
                    edges += [at, at + len(word)]
                    marks.append((at, number))
            start, end = pre_tokens(data, np.concatenate(edges))
            fixed = np.full(len(start), -1)
            if marks:
                inside = np.zeros(len(data) + 1, np.int64)
                for at, number in marks:
                    fixed[np.searchsorted(start, at)] = number
                    length = len(next(w for w, k in self.v.special.items() if k == number))
                    np.add.at(inside, at + 1, 1)
                    np.add.at(inside, at + length, -1)
                keep = np.cumsum(inside)[start] == 0
                start, end, fixed = start[keep], end[keep], fixed[keep]
            hashes = span_hashes(data, start, end)
            unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            slot = self._slots(unique, data, start[first], end[first])[back]
            yield lo, hi, np.searchsorted(row_at, start, "right") - 1, slot, fixed

    def counts(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for lo, hi, row, slot, fixed in self.pieces(texts):
            each = np.where(fixed >= 0, 1, self.size[slot])
            out[lo:hi] = np.bincount(row, weights=each, minlength=hi - lo)
        return out

    def ids(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(lo, hi, token ids, tokens of each row)."""
        for lo, hi, row, slot, fixed in self.pieces(texts):
            size = self.size[slot]
            flat = self.flat[_ragged(self.begin[slot], size)].astype(np.int64)
            if (fixed >= 0).any():
                begin = np.cumsum(size) - size
                keep = np.ones(len(flat), bool)
                for i in np.flatnonzero(fixed >= 0):
                    flat[begin[i]] = fixed[i]
                    keep[begin[i] + 1 : begin[i] + size[i]] = False
                    size[i] = 1
                flat = flat[keep]
            yield lo, hi, flat, np.bincount(row, weights=size, minlength=hi - lo).astype(np.int64)


def _union(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, slots = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")
    return keys[order], slots[order]


def _find(data: np.ndarray, word: bytes) -> np.ndarray:
    """Offsets of a byte string, without overlaps, from the left."""
    out, body, at = [], data.tobytes(), -1
    while (at := body.find(word, at + 1)) >= 0:
        out.append(at)
        at += len(word) - 1
    return np.array(out, np.int64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, n), out=prefix[1:])
    span = (prefix[end] - prefix[start]) * _power("down", _BASE_INV, n)[start]
    return mix(span + (end - start).astype(np.uint64) * _ODD)


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder for this vocabulary, kept between tasks."""
    if vocabulary.name not in _worker:
        _worker.clear()
        _worker[vocabulary.name] = Encoder(vocabulary)
    return _worker[vocabulary.name]


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    ``vocabulary`` is the path of a byte-level BPE tokenizer JSON. A special
    token's string inside a text is that one token. A null text counts as empty
    (0 bytes, 0 tokens); a null ``doc_id`` and repeated rows are passed through;
    an empty table gives an empty result; other columns are not read.
    """
    shared = spark.sparkContext.broadcast(Vocabulary.read(vocabulary))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(shared.value)
        for batch in batches:
            count = pa.array(tool.counts(text_array(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), count], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
