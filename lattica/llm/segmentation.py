"""N-best SentencePiece segmentation by Viterbi and backward A-star, with exact decoding.

A text becomes a lattice of vocabulary pieces over its characters, blanks shown
as the vocabulary's mark. The forward Viterbi pass gives the best score of every
way to a piece; the search for the N best paths then runs backwards from the end,
where those scores are exact estimates of what is left, so each path that leaves
the queue is the next best one.

No piece joins a character to a mark after it, and some characters are part of
no longer piece: the lattice falls apart there into segments, whose N best lists
are combined exactly (the N best sums differ from the best one in the N - 1
segments with the smallest losses only). The forward pass runs over all new
segments of a slice of texts at once, as array operations from one character to
the next; segments met before come from a bounded table of the task.

Scores are the model's own, if they are log probabilities. A model of merges has
no path scores, only an order of merges: of its paths those come first in which
the fewest neighbouring pieces would have been merged otherwise, and of these the
ones with the better piece scores (merge ranks read as Zipf frequencies,
-log(2 + rank)). A sequence of pieces is the model's own encoding just if all
its neighbours stand side by side when the two are encoded alone, so the best
path has no such clash and equals the library's encoding. Sums are kept in whole
millionths, so equal paths are exactly equal and the search goes down one of them
instead of through all.

Characters that are no piece, and a literal mark in a text, are spelled in byte
pieces at a cost below any piece's. Decoding gives back the text's exact bytes.

Results for odd inputs: a null or empty text has no pieces and a score of 0; if
there are fewer than N paths the list is shorter; ties keep one of the equal
paths, the same at every run; long texts are segmented whole; repeated rows and
null ids are passed through; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import tidy

MARK = "▁"
UNIT = 1_000_000
#: What a clash costs, in millionths: more than pieces can make up for.
CLASH = 1 << 40
_NEVER = -(1 << 62)
#: Distinct segments in a task's table, characters of texts worked on at a time, and of new segments in a lattice.
TABLE_SEGMENTS, SLICE_CHARS, LATTICE_CHARS = 200_000, 1 << 20, 1 << 15


@dataclass
class Merges:
    """When each piece of a merge model is made, from which parts, and which neighbours would not stand."""

    time: np.ndarray  # by piece id; 0 for single characters
    left: np.ndarray
    right: np.ndarray
    keys: np.ndarray  # neighbours that some piece joins, as left * pieces + right, in order
    joins: np.ndarray
    odd: np.ndarray  # pieces that share their time with others or come before their parts: neighbours are encoded to see
    broken: np.ndarray  # pieces that encoding never leaves whole
    pieces: list[str]
    score: dict[str, float]
    seen: dict[tuple[int, int], bool] = field(default_factory=dict)

    @classmethod
    def of(cls, pieces: list[str], score: dict[str, tuple[int, float]]) -> "Merges":
        n = len(pieces)
        order = sorted((p for p in score if len(p) > 1), key=lambda p: -score[p][1])
        time, left, right = (np.zeros(n, np.int64) for _ in range(3))
        for t, p in enumerate(order):
            time[score[p][0]] = t + 1
        shared = Counter(score[p][1] for p in order)
        odd, broken = np.zeros(n, bool), np.zeros(n, bool)
        own = {p: s for p, (_, s) in score.items()}
        ids = {p: i for p, (i, _) in score.items()}
        keys, joins = [], []
        for p in order:
            i = ids[p]
            odd[i] = shared[own[p]] > 1
            made, parts = _merged(p, own)
            broken[i] = made != [p]
            if not broken[i]:
                left[i], right[i] = ids[parts[0]], ids[parts[1]]
                odd[i] |= max(time[left[i]], time[right[i]]) >= time[i]
            else:
                odd[i] = True
            for at in range(1, len(p)):
                if p[:at] in ids and p[at:] in ids:
                    keys.append(ids[p[:at]] * n + ids[p[at:]])
                    joins.append(i)
        for p in order:  # what is made of odd pieces is odd
            odd[ids[p]] |= odd[left[ids[p]]] or odd[right[ids[p]]]
        by = np.argsort(np.array(keys, np.int64))
        return cls(time, left, right, np.array(keys, np.int64)[by], np.array(joins, np.int64)[by], odd, broken, pieces, own)

    def clashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the two pieces of each pair as one text gives anything but the two.

        Going back in time, the piece of the two that was made last is taken apart, so
        all symbols that ever were neighbours are met. They join if some piece does so before either is
        used up by its own side; at the same time, the one on the left goes first.
        """
        out = np.zeros(len(a), bool)
        strange = self.odd[a] | self.odd[b]
        for i in np.flatnonzero(strange):
            pair = (int(a[i]), int(b[i]))
            if pair not in self.seen:
                if len(self.seen) >= TABLE_SEGMENTS:
                    self.seen.clear()
                p, q = self.pieces[pair[0]], self.pieces[pair[1]]
                self.seen[pair] = _merged(p + q, self.score)[0] != [p, q]
            out[i] = self.seen[pair]
        live = np.flatnonzero(~strange)
        a, b = a[live], b[live]
        end_a = np.full(len(live), np.iinfo(np.int64).max)
        end_b = end_a.copy()
        n = len(self.time)
        while len(live) and len(self.keys):
            key = a * n + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            when = np.where(self.keys[at] == key, self.time[self.joins[at]], np.iinfo(np.int64).max)
            hit = (when < end_a) & (when <= end_b)
            out[live[hit]] = True
            ta, tb = self.time[a], self.time[b]
            on = ~hit & ((ta > 0) | (tb > 0))
            live, a, b, ta, tb, end_a, end_b = (x[on] for x in (live, a, b, ta, tb, end_a, end_b))
            back = ta > tb
            end_a, end_b = np.where(back, ta, end_a), np.where(back, end_b, tb)
            a, b = np.where(back, self.right[a], a), np.where(back, b, self.left[b])
        return out


def _merged(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str]]:
    """(symbols, parts of the last merge) after always joining the neighbours whose piece scores best, leftmost first."""
    parts, last = list(text), ("", "")
    while len(parts) > 1:
        best = max(((score.get(parts[i] + parts[i + 1], -math.inf), -i) for i in range(len(parts) - 1)))
        if best[0] == -math.inf:
            break
        i = -best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


@dataclass
class Pieces:
    """A vocabulary: normal pieces with scores, and the ids that spell single bytes."""

    name: str
    pieces: list[str]
    score: dict[str, tuple[int, int]]  # id and score in millionths
    byte_ids: list[int]
    unknown: int
    joined: set = field(default_factory=set)
    merges: Merges | None = None

    @classmethod
    def read(cls, path: str) -> "Pieces":
        """From a SentencePiece model file (local to the driver)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        raw = {i: sp.get_score(i) for i in normal}
        merges = None
        if raw and all(s == int(s) for s in raw.values()):  # ranks of merges
            merges = Merges.of(pieces, {pieces[i]: (i, s) for i, s in raw.items()})
            raw = {i: -math.log(2 - s) for i, s in raw.items()}
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        out = cls.of(path, pieces, {pieces[i]: (i, raw[i]) for i in normal}, byte_ids)
        out.merges = merges
        return out

    @classmethod
    def of(cls, name: str, pieces: list[str], score: dict[str, tuple[int, float]], byte_ids: list[int]) -> "Pieces":
        exact = {p: (i, round(s * UNIT)) for p, (i, s) in score.items()}
        out = cls(name, pieces, exact, byte_ids, min((s for _, s in exact.values()), default=0) - 10 * UNIT)
        out.joined = {c for p in score if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p in score):
            raise ValueError("pieces that hold a mark after another character are not supported")
        return out


@dataclass
class Lattice:
    """Pieces over several segments as arrays, with the two best scores of every way to the end of each."""

    bounds: np.ndarray  # first character of each segment, and the end
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray  # -1: a character that is none
    cost: np.ndarray
    first: np.ndarray  # best score up to and with the piece
    second: np.ndarray
    came: np.ndarray  # the piece before it on the best way, -1 at the start
    into: np.ndarray  # range of the pieces before each, in ``before``
    before: np.ndarray
    between: np.ndarray  # cost of standing behind each of them
    at_end: np.ndarray  # pieces in the order of their ends, and where each position's begin
    ends: np.ndarray
    codes: np.ndarray


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All members of the ranges, one after the other."""
    shift = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(begin - shift, count)


def _top_two(values: np.ndarray, others: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest, next largest, place of the largest) of each range; ``others`` are the runners-up behind each value."""
    top = np.maximum.reduceat(values, begin)
    row = np.repeat(np.arange(len(count)), count)
    hits = np.flatnonzero(values == top[row])
    where = hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]  # each range has a hit
    rest = values.copy()
    rest[where] = others[where]
    return top, np.maximum.reduceat(rest, begin), where


class Segmenter:
    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        body = vocabulary.joined - {MARK}
        table = [b""] * len(vocabulary.pieces)
        for p, (i, _) in vocabulary.score.items():
            table[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(vocabulary.byte_ids):
            table[i] = bytes([b])
        self.size = np.array([len(t) for t in table], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        # marks and then characters of longer pieces; or one other character
        inside = "".join(re.escape(c) for c in sorted(body))
        self.cut = re.compile(f"{MARK}*[{inside}]+|{MARK}+|." if inside else f"{MARK}+|.", re.DOTALL)
        self.cost = np.zeros(len(vocabulary.pieces) + 1, np.int64)  # the last one is that of a character that is no piece
        for i, s in vocabulary.score.values():
            self.cost[i] = s
        self.cost[-1] = vocabulary.unknown
        if vocabulary.merges is not None:
            self.cost[:-1][vocabulary.merges.broken] -= CLASH
        self._states()
        self.clash_keys = np.full(1 << 20, -1, np.int64)
        self.clash_found = np.zeros(1 << 20, bool)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str | None, int] = {}
        self.scores, self.losses, self.lengths = (np.zeros(0, np.int64) for _ in range(3))
        self.paths_flat, self.paths_at = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.listed: dict[tuple[str, int], list[tuple[int, np.ndarray]]] = {}

    def _states(self) -> None:
        """Prefixes of pieces as states of an automaton; those that go on are numbered first."""
        score = self.v.score
        longer = [p for p in score if len(p) > 1]
        inner = sorted({p[:n] for p in longer for n in range(1, len(p))})
        number = {p: i + 1 for i, p in enumerate(inner)}
        for p in longer:
            number.setdefault(p, len(number) + 1)
        chars = sorted(self.v.joined)
        kind = {c: i + 1 for i, c in enumerate(chars)}
        self.inner = len(inner) + 1
        self.step = np.zeros((self.inner, len(chars) + 1), np.int32)
        self.piece_of = np.full(len(number) + 1, -1, np.int64)
        for p, i in number.items():
            self.step[number[p[:-1]] if len(p) > 1 else 0, kind[p[-1]]] = i
            if p in score:
                self.piece_of[i] = score[p][0]
        self.kind = np.zeros(0x110000, np.int32)
        self.single = np.full(0x110000, -1, np.int64)
        for c, i in kind.items():
            self.kind[ord(c)] = i
        for p, (i, _) in score.items():
            if len(p) == 1:
                self.single[ord(p)] = i

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cost of two pieces standing side by side."""
        out = np.zeros(len(a), np.int64)
        if self.v.merges is None or not len(a):
            return out
        both = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[both] * len(self.v.pieces) + b[both]
        slot = (key * 0x9E3779B1 >> 7) & (len(self.clash_keys) - 1)
        hit = self.clash_found[slot]
        missed = np.flatnonzero(self.clash_keys[slot] != key)
        if len(missed):
            n = len(self.v.pieces)
            new, back = np.unique(key[missed], return_inverse=True)
            found = self.v.merges.clashes(new // n, new % n)
            hit[missed] = found[back]
            into = (new * 0x9E3779B1 >> 7) & (len(self.clash_keys) - 1)
            self.clash_keys[into], self.clash_found[into] = new, found
            last = self.clash_keys[into] == new  # of several new keys in a slot the one whose key stayed
            self.clash_found[into[last]] = found[last]
        out[both] = np.where(hit, -CLASH, 0)
        return out

    def lattice(self, segments: list[str]) -> Lattice:
        """The lattices of segments and their forward passes."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        bounds = np.append(0, np.cumsum(size))
        of = np.repeat(np.arange(len(segments)), size)
        last = bounds[1:][of]
        kind = self.kind[codes]
        starts, ends, pieces = [np.arange(len(codes))], [np.arange(len(codes)) + 1], [self.single[codes]]
        at = np.arange(len(codes))
        state = self.step[0, kind]
        n = 1
        while len(at):
            go = (state > 0) & (state < self.inner) & (at + n < last[at])
            at, state = at[go], state[go]
            state = self.step[state, kind[at + n]]
            n += 1
            whole = self.piece_of[state]
            some = np.flatnonzero((state > 0) & (whole >= 0))
            starts.append(at[some])
            ends.append(at[some] + n)
            pieces.append(whole[some])
        start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)
        offset = start - bounds[of[start]]
        order = np.argsort(offset, kind="stable")
        start, end, piece, offset = start[order], end[order], piece[order], offset[order]
        at_end = np.argsort(end, kind="stable")
        per = np.bincount(end, minlength=len(codes) + 1)
        ends_at = np.append(0, np.cumsum(per))
        count = np.where(offset > 0, per[start], 0)
        before = at_end[_ranges(ends_at[start], count)]
        into = np.append(0, np.cumsum(count))
        between = self.between(piece[before], np.repeat(piece, count))
        cost = self.cost[piece]
        first, second, came = cost.copy(), np.full(len(start), _NEVER), np.full(len(start), -1)
        level = np.append(np.flatnonzero(np.diff(offset, prepend=-1)), len(start))
        for lo, hi in zip(level[1:-1], level[2:], strict=True):  # from one character of the segments to the next
            a, b = into[lo], into[hi]
            way = before[a:b]
            one, two = first[way] + between[a:b], second[way] + between[a:b]
            top, runner, where = _top_two(one, two, into[lo:hi] - a, count[lo:hi])
            first[lo:hi] += top
            second[lo:hi] = np.maximum(runner + cost[lo:hi], _NEVER)
            came[lo:hi] = way[where]
        return Lattice(bounds, start, end, piece, cost, first, second, came, into, before, between, at_end, ends_at, codes)

    def _spelled(self, lat: Lattice, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number for each edge) of pieces; characters that are none are spelled in bytes."""
        ids, count = lat.piece[edges], np.ones(len(edges), np.int64)
        strange = np.flatnonzero(ids < 0)
        if not len(strange):
            return ids.astype(np.int32), count
        spelled = [[self.v.byte_ids[b] for b in chr(lat.codes[lat.start[e]]).encode()] for e in edges[strange]]
        count[strange] = [len(s) for s in spelled]
        out = np.repeat(ids, count)
        at = (np.cumsum(count) - count)[strange]
        for i, s in zip(at, spelled, strict=True):
            out[i : i + len(s)] = s
        return out.astype(np.int32), count

    def _learn(self, segments: list[str]) -> None:
        """Add segments, in order of length, to the table: score, loss of the next best path and ids of the best."""
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
        lo, found = 0, []
        while lo < len(segments):  # lattices that stay in the processor's cache, one segment at least
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LATTICE_CHARS, "right")))
            found.append(self._best_paths(segments[lo:hi]))
            lo = hi
        scores, losses, lengths, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        self.paths_at = np.append(self.paths_at, len(self.paths_flat) + np.cumsum(lengths) - lengths)
        self.paths_flat = np.append(self.paths_flat, ids)
        self.scores, self.losses, self.lengths = np.append(self.scores, scores), np.append(self.losses, losses), np.append(self.lengths, lengths)

    def _best_paths(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of segments: score, loss of the next best path, and number and ids of the best one's pieces."""
        lat = self.lattice(segments)
        stop = lat.bounds[1:]
        begin, count = lat.ends[stop], lat.ends[stop + 1] - lat.ends[stop]
        flat = lat.at_end[_ranges(begin, count)]
        top, runner, where = _top_two(lat.first[flat], lat.second[flat], np.cumsum(count) - count, count)
        edge, row = flat[where], np.arange(len(segments))
        edges, rows = [], []
        while len(edge):
            edges.append(edge)
            rows.append(row)
            edge = lat.came[edge]
            on = edge >= 0
            edge, row = edge[on], row[on]
        step = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
        edges, rows = np.concatenate(edges), np.concatenate(rows)
        order = np.lexsort((-step, rows))
        ids, spelled = self._spelled(lat, edges[order])
        length = np.bincount(rows[order], weights=spelled, minlength=len(segments)).astype(np.int64)
        return top, np.where(runner > _NEVER // 2, top - runner, -_NEVER), length, ids

    def _index(self, segments: list[str | None]) -> np.ndarray:
        """Places in the table, after adding what is new."""
        new = set(segments).difference(self.known)
        if None in new:  # a literal mark, spelled in bytes
            new.remove(None)
            self.scores = np.append(self.scores, self.v.unknown)
            self.losses = np.append(self.losses, -_NEVER)
            self.paths_at = np.append(self.paths_at, len(self.paths_flat))
            self.paths_flat = np.append(self.paths_flat, np.array([self.v.byte_ids[b] for b in MARK.encode()], np.int32))
            self.lengths = np.append(self.lengths, len(MARK.encode()))
            self.known[None] = len(self.known)
        if new:
            new = sorted(new, key=len)
            self._learn(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))

    def _best(self, at: int) -> np.ndarray:
        return self.paths_flat[self.paths_at[at] : self.paths_at[at] + self.lengths[at]]

    def search_of(self, segments: list[str], n: int) -> list[list[tuple[int, np.ndarray]]]:
        """The n best (score, ids) of each segment: forward Viterbi, backward A-star."""
        lat = self.lattice(segments)
        out = []
        for lo, hi in zip(lat.bounds, lat.bounds[1:], strict=False):
            found, turn = [], 0
            # (estimate, place, turn, what the pieces behind the edge give, edge, chain of the edges behind it):
            # of equal estimates the one nearest the start goes first: ties are followed to the end, not fanned out
            queue: list = [(-int(lat.first[e]), int(lat.start[e]), -i, 0, int(e), None) for i, e in enumerate(lat.at_end[lat.ends[hi] : lat.ends[hi + 1]])]
            heapq.heapify(queue)
            while queue and len(found) < n:
                _, at, _, tail, edge, chain = heapq.heappop(queue)
                chain = (edge, chain)
                gone = tail + int(lat.cost[edge])
                if at == lo:
                    edges = []
                    while chain is not None:
                        edges.append(chain[0])
                        chain = chain[1]
                    found.append((gone, self._spelled(lat, np.array(edges))[0]))
                    continue
                for k in range(lat.into[edge], lat.into[edge + 1]):
                    turn += 1
                    e, more = int(lat.before[k]), gone + int(lat.between[k])
                    heapq.heappush(queue, (-(more + int(lat.first[e])), int(lat.start[e]), turn, more, e, chain))
            out.append(found)
        return out

    def search(self, segment: str, n: int) -> list[tuple[int, np.ndarray]]:
        return self.search_of([segment], n)[0]

    def segments(self, text: str) -> list[str | None]:
        """The text cut into segments; a literal mark stands as None."""
        if not text:
            return []
        out: list[str | None] = []
        for i, part in enumerate((" " + text).split(MARK)):
            if i:
                out.append(None)
            out += self.cut.findall(part.replace(" ", MARK))
        return out

    def n_best_of(self, texts: list[str], n: int) -> list[list[tuple[float, np.ndarray]]]:
        """The n best (score, ids) of each text, best first."""
        if len(self.known) > TABLE_SEGMENTS:
            self._clear()
        cut = [self.segments(t) for t in texts]
        flat = [s for c in cut for s in c]
        index = self._index(flat)
        row_at = np.append(0, np.cumsum([len(c) for c in cut]))
        losses, lengths = self.losses[index], self.lengths[index]
        ids = self.paths_flat[_ranges(self.paths_at[index], lengths)]
        id_at = np.append(0, np.cumsum(lengths))
        total = np.append(0, np.cumsum(self.scores[index]))
        near: list[list[int]] = []  # of each text the segments with the smallest losses
        for lo, hi in zip(row_at, row_at[1:], strict=False):
            own, picked = losses[lo:hi].copy(), []
            for _ in range(min(n - 1, hi - lo)):
                k = int(own.argmin())
                if own[k] >= -_NEVER:
                    break
                picked.append(int(lo) + k)
                own[k] = -_NEVER
            near.append(picked)
        wanted = sorted({flat[k] for picked in near for k in picked if (flat[k], n) not in self.listed})
        if wanted:
            for s, found in zip(wanted, self.search_of(wanted, n), strict=True):
                first = self._best(self.known[s])
                score = int(self.scores[self.known[s]])
                rest = [x for x in found if len(x[1]) != len(first) or (x[1] != first).any()]
                self.listed[(s, n)] = [(score, first), *rest][:n]
        out = []
        for i, picked in enumerate(near):
            best = ids[id_at[row_at[i]] : id_at[row_at[i + 1]]]
            whole = int(total[row_at[i + 1]] - total[row_at[i]])
            kept: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ())]  # loss, and (segment, rank) of each segment's other path
            for k in picked:
                paths = self.listed[(flat[k], n)]
                kept = heapq.nsmallest(n, [(a + paths[0][0] - s, (*other, (k, j)) if j else other) for a, other in kept for j, (s, _) in enumerate(paths)])
            found = []
            for loss, other in kept:
                parts, done = [], int(id_at[row_at[i]])
                for k, j in sorted(other):
                    parts += [ids[done : id_at[k]], self.listed[(flat[k], n)][j][1]]
                    done = int(id_at[k + 1])
                path = np.concatenate([*parts, ids[done : id_at[row_at[i + 1]]]]) if parts else best
                found.append(((whole - loss) / UNIT, path))
            out.append(found)
        if len(self.listed) > TABLE_SEGMENTS // 4:
            self.listed.clear()
        return out

    def n_best(self, text: str, n: int) -> list[tuple[float, np.ndarray]]:
        return self.n_best_of([text], n)[0]

    def encode(self, text: str, n: int) -> tuple[np.ndarray, list[float]]:
        """(ids of the best path, scores of the n best paths)."""
        found = self.n_best(text, n)
        return found[0][1], [score for score, _ in found]

    def decode(self, ids: np.ndarray) -> bytes:
        """The exact bytes that the ids spell, without the blank put before the text."""
        if not len(ids):
            return b""
        size = self.size[ids]
        return self.flat[_ranges(self.begin[ids], size)].tobytes()[1:]


def segment(spark: SparkSession, docs: DataFrame, model: str, n: int = 3) -> DataFrame:
    """doc_id, n_pieces (of the best) and, for each of the n best, ids, scores, ids_crc32 and decodes (to the same bytes); exact if all do."""
    shared = spark.sparkContext.broadcast(Pieces.read(model))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Segmenter(shared.value)  # for this task only: its tables go with it
        for batch in batches:
            size = pa.compute.fill_null(pa.compute.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            lo = 0
            while lo < batch.num_rows:  # a bounded number of characters at a time, one text at least
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), SLICE_CHARS, "right")) + lo)
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                ids, ranks, scores, crc, decodes = [], [], [], [], []
                for text, found in zip(texts, tool.n_best_of(texts, n), strict=True):
                    raw = text.encode()
                    ranks.append(len(found))
                    for score, path in found:
                        ids.append(path)
                        scores.append(score)
                        crc.append(zlib.crc32(path.astype("<i4").tobytes()))
                        decodes.append(tool.decode(path) == raw)
                length = np.array([len(x) for x in ids])
                paths = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(np.concatenate(ids)))
                row_at = np.append(0, np.cumsum(ranks))
                lists = [pa.ListArray.from_arrays(pa.array(row_at.astype(np.int32)), x) for x in (paths, pa.array(scores), pa.array(crc, pa.int64()), pa.array(decodes))]
                exact = np.logical_and.reduceat(decodes, row_at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(length[row_at[:-1]].astype(np.int64)), *lists, pa.array(exact)],
                    names=["doc_id", "n_pieces", "ids", "scores", "ids_crc32", "decodes", "exact"],
                )
                lo = hi

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_pieces long, ids array<array<int>>, scores array<double>, ids_crc32 array<long>, decodes array<boolean>, exact boolean"
    return rows.mapInArrow(tidy(run), schema)
