"""Every one of the n best segmentations is returned with its ids."""

import random
import zlib

import numpy as np

from lattica.llm.segmentation import MARK, Pieces, Segmenter, _merged, segment

from test_ops import PIECES, toy


def test_paths_equal_enumeration():
    vocab, score = toy()
    tool, rng = Segmenter(vocab), random.Random(4)

    def every(text):
        if not text:
            return [(0, ())]
        out = []
        for j in range(1, min(3, len(text)) + 1):
            if text[:j] in score:
                i, s = vocab.score[text[:j]]
                out += [(s + x, (i, *ids)) for x, ids in every(text[j:])]
        if text[0] not in score:
            own = tuple(vocab.byte_ids[b] for b in text[0].encode())
            out += [(vocab.unknown + x, own + ids) for x, ids in every(text[1:])]
        return out

    for _ in range(400):
        text = "".join(rng.choice("aabbc  d") for _ in range(rng.randrange(1, 9)))
        known = {ids: s for s, ids in every((" " + text).replace(" ", MARK))}
        for n in (1, 2, 3, 5):
            got = [(round(s * 1e6), tuple(ids.tolist())) for s, ids in tool.n_best(text, n)]
            assert [s for s, _ in got] == sorted(known.values(), reverse=True)[:n]
            assert all(known[ids] == s for s, ids in got) and len({ids for _, ids in got}) == len(got)
            assert all(tool.decode(np.array(ids, int)) == text.encode() for _, ids in got)


def test_every_rank_has_ids(spark, odd):
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in segment(spark, odd, PIECES).collect():
        assert len(r.ids) == len(r.scores) == len(r.ids_crc32) == len(r.decodes) and all(r.decodes) and r.exact
        assert len(r.ids) == (3 if len(text[r.doc_id].strip()) > 5 else len(r.ids)) and len(set(map(tuple, r.ids))) == len(r.ids)
        assert r.n_pieces == len(r.ids[0]) and [zlib.crc32(np.array(i, "<i4").tobytes()) for i in r.ids] == r.ids_crc32


def test_first_path_is_the_library_s(spark):
    """On whole texts of ``documents``, and on marks, rare characters and long words without blanks."""
    import sentencepiece

    tool = Segmenter(Pieces.read(PIECES))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [r.text or "" for r in spark.read.parquet(f"/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = random.Random(9)
    texts += ["".join(rng.choice("aabcdeinrst \n\téß漢門語🙂.,-(") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    texts += [" " * n + "the  end" + " " * n for n in range(40)] + ["ab" * 20_000, "the" * 5_000 + " and" * 5_000, "a" * 3_000, "\x00\x7f"]
    want = library.encode(texts)
    for lo in range(0, len(texts), 100):
        for text, ids, found in zip(texts[lo : lo + 100], want[lo : lo + 100], tool.n_best_of(texts[lo : lo + 100], 3), strict=True):
            assert found[0][1].tolist() == ids and tool.decode(found[0][1]) == text.encode()
            assert len({tuple(path.tolist()) for _, path in found}) == len(found)


def test_clashes_equal_encoding_the_pair():
    vocab = Pieces.read(PIECES)
    rng, m = np.random.default_rng(2), vocab.merges
    ids = np.array([i for i, _ in vocab.score.values() if MARK not in vocab.pieces[i]])
    a, b = rng.choice(ids, 4000), rng.choice(ids[:3000], 4000)
    want = [_merged(vocab.pieces[x] + vocab.pieces[y], m.score)[0] != [vocab.pieces[x], vocab.pieces[y]] for x, y in zip(a, b, strict=True)]
    assert m.clashes(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_paths_of_a_merge_model_equal_enumeration():
    """Fewest clashes first, then the better scores; over all segmentations of short words."""
    vocab = Pieces.read(PIECES)
    tool, rng = Segmenter(vocab), random.Random(6)

    def every(text):
        if not text:
            return [()]
        return [(text[:j], *rest) for j in range(1, len(text) + 1) if text[:j] in vocab.score for rest in every(text[j:])]

    def worth(parts):
        clash = sum(_merged(x + y, vocab.merges.score)[0] != [x, y] for x, y in zip(parts, parts[1:]))
        return sum(vocab.score[p][1] for p in parts) - (clash << 40)

    for _ in range(60):
        text = "".join(rng.choice("theinandort") for _ in range(rng.randrange(1, 9)))
        known = sorted((worth(parts) for parts in every(MARK + text)), reverse=True)
        for n in (1, 3, 6):
            got = tool.n_best(text, n)
            assert [round(s * 1e6) for s, _ in got] == known[:n] and len({tuple(p.tolist()) for _, p in got}) == len(got)
            assert all(worth([vocab.pieces[i] for i in p]) == round(s * 1e6) for s, p in got)


def test_results_do_not_depend_on_the_table(monkeypatch):
    from lattica.llm import segmentation

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 7))) for _ in range(20)) for _ in range(60)]
    plain = [[(s, p.tolist()) for s, p in x] for x in Segmenter(Pieces.read(PIECES)).n_best_of(texts, 3)]
    monkeypatch.setattr(segmentation, "TABLE_SEGMENTS", 50)
    tool = Segmenter(Pieces.read(PIECES))
    assert [[(s, p.tolist()) for s, p in tool.n_best(t, 3)] for t in texts] == plain


def test_new_segments_are_learnt_in_bounded_lattices(monkeypatch):
    """Many new words at once make several small lattices; only a single longer word exceeds the bound."""
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(4, 14))) for _ in range(9_000)] + ["the" * 15_000]
    sizes, plain = [], Segmenter.lattice

    def seen(self, segments):
        sizes.append((len(segments), sum(map(len, segments))))
        return plain(self, segments)

    monkeypatch.setattr(Segmenter, "lattice", seen)
    tool = Segmenter(Pieces.read(PIECES))
    [found] = tool.n_best_of([" ".join(words)], 3)
    assert len(found) == 3 and tool.decode(found[0][1]) == " ".join(words).encode()
    assert sum(n for _, n in sizes) > 1 << 16 and all(n <= 1 << 15 or k == 1 for k, n in sizes)
