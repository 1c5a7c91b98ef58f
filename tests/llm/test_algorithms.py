"""Near duplicates, packing, splitting, neighbours, encoding and leaks against brute force and round trips."""

import itertools
import random
from pathlib import Path

import pytest

pytest.importorskip("loomledger.llm")
import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from loomledger.llm import encoding, leakage, neardup, neighbours, packing, splitting  # noqa: E402

# near duplicates


def shingles(t, k):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def edited(n, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [r.choices(vocab, k=r.randint(3, 60)) for _ in range(n)]
    out = []
    for i in range(3 * n):
        w = list(base[i % n])
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append((i, ("  " if i % 2 else " ").join(w)))
    return out + [(900, None), (901, ""), (902, "one two"), (903, out[0][1].upper()), (904, out[0][1] + "   ")]


@pytest.mark.parametrize(("k", "s", "least"), [(3, 0.6, 20), (5, 0.8, 0), (1, 0.5, 0)])
def test_links_against_brute_force(spark, k, s, least, monkeypatch):
    rows = edited(25, k)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t, k) for i, t in rows if t is not None and len(t) >= least and len(t.split()) >= k}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b]) - 1e-9}
    got = neardup.document_pairs(*neardup.links(df, words=k, similarity=s, min_chars=least))
    assert {(r.doc_a, r.doc_b) for r in got.collect()} == want


def test_hot_lists_are_split(spark, monkeypatch):
    # a third of all texts share most shingles: their lists go over cells
    monkeypatch.setattr(neardup, "LIST", 8)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(common[: 30 + i % 10] + [f"x{i}", f"y{i}", f"z{i}"])) for i in range(60)] + [(100 + i, " ".join(f"u{i}_{j}" for j in range(20))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: shingles(t, 3) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    got = neardup.document_pairs(*neardup.links(df, words=3, similarity=0.6))
    assert {(r.doc_a, r.doc_b) for r in got.collect()} == want and len(want) > 500


def test_classes_of_any_size_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIDE", 3)
    one = "a b c d e f g h i j k l"
    rows = [(i, one + " " * (i % 3)) for i in range(20)] + [(100 + i, one + " m") for i in range(8)] + [(500, "quite another text of more than five words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_a, r.doc_b) for r in neardup.document_pairs(*neardup.links(df, words=2, similarity=0.8)).collect()]
    same = [*range(20), *range(100, 108)]
    assert sorted(got) == [(a, b) for a in same for b in same if a < b]


def test_tables_merge_in_two_steps(spark):
    df = spark.range(0, 5000, 1, 9).selectExpr("id * 7919 as cls")
    shared = neardup.bits.bitmap(df, "cls", 1 << 18)
    own = np.arange(5000, dtype=np.int64) * 7919
    assert neardup.bits.has(shared, 1 << 18, own).all() and neardup.bits.has(shared, 1 << 18, own + 1).mean() < 0.1
    other = neardup.bits.bitmap(df.limit(0), "cls", 1 << 18)
    assert not neardup.bits.has(other, 1 << 18, own).any() and neardup.bits.has(shared, 1 << 18, own).all()  # each by its own name


def test_groups(spark):
    chain = [list("abcdefghijklmnopqrstuvwxyz")]
    for i in range(6):
        w = list(chain[-1])
        w[4 * i] = f"n{i}"
        chain.append(w)
    rows = [(10 + i, " ".join(w)) for i, w in enumerate(chain)] + [(5, " ".join(chain[0])), (99, "quite another text of more than five words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.groups(*neardup.links(df, words=1, similarity=0.9)).collect()}
    assert {r.grp for i, r in got.items() if i != 99} == {5} and got[99].grp == 99 and got[99].n_links == 0
    assert neardup.document_pairs(*neardup.links(df.limit(0))).count() == 0


def test_groups_have_every_document(spark):
    spaceless = "请启用浏览器的脚本功能后再继续浏览。"
    rows = [(i, spaceless + " " * (i % 2)) for i in range(1, 6)] + [(6, "One two"), (7, "one  TWO"), (8, "two one"), (9, None), (10, ""), (11, " \n"), (12, None), (13, "a b c d e f"), (14, "a b c d e f"), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.grp, r.n_links) for r in neardup.groups(*neardup.links(df, short=True)).collect()}
    assert got == {**{i: (1, 0) for i in range(1, 6)}, 6: (6, 0), 7: (6, 0), **{i: (i, 0) for i in range(8, 14)}, 14: (13, 0)}
    only = df.where("doc_id < 13")  # no text has a shingle
    assert neardup.groups(*neardup.links(only, short=True)).count() == 12 and neardup.groups(*neardup.links(only)).count() == 0


def test_counts_in_16_bits_are_never_too_small():
    n = np.array([0, 1, 5, 32767, 32768, 40000, 10**6, 10**9])
    back = neardup._decode(neardup._code(n))
    assert (back >= n).all() and (back <= n * 1.001 + 1e-9).all()
    assert neardup.heap_merge([[1, 3, 5], [3, 4], [3, 5]], 2) == [3, 5]
    assert neardup.probe(np.array([1, 4, 9], np.uint64), np.array([4, 9, 10], np.uint64)) == 2 and neardup.probe(np.array([1], np.uint64), np.array([], np.uint64)) == 0


# packing


def test_fill_is_the_best_subset():
    r = random.Random(5)
    for _ in range(200):
        counts = {r.randint(1, 12): r.randint(1, 3) for _ in range(r.randint(1, 4))}
        room = r.randint(1, 30)
        items = [k for k, n in counts.items() for _ in range(n)]
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        got = packing.fill(counts, room)
        assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


def test_pack_holds_everything_once():
    r = random.Random(6)
    for _ in range(50):
        hist = {r.randint(1, 40): r.randint(1, 50) for _ in range(10)}
        left = dict(hist)
        bins = 0
        for kind, times in packing.pack(hist.items(), 40):
            assert sum(k * n for k, n in kind.items()) <= 40
            bins += times
            for k, n in kind.items():
                left[k] -= n * times
        assert not any(left.values())
        rooms: list[int] = []  # first fit of the longest first
        for k in sorted((k for k, n in hist.items() for _ in range(n)), reverse=True):
            i = next((i for i, x in enumerate(rooms) if x >= k), None)
            if i is None:
                rooms.append(40 - k)
            else:
                rooms[i] -= k
        assert bins <= len(rooms) + 1


def test_chunks(spark):
    words = lambda n: " ".join(["ß"] * n)
    turns = [(1, 0, words(30), "2024-01-01"), (1, 1, words(300), "2024-01-01"), (1, 2, words(90), "2024-01-01"), (2, 0, None, "2024-01-01"), (3, 0, words(5), "2024-01-01")]
    t = spark.createDataFrame(turns, "script_id long, turn int, text string, ingested_at string")
    size = lambda n: len(words(n).encode())
    pieces = [(1, 1, 0, 0, (0, size(30)), "a"), (1, 1, 0, 0, (0, size(30)), "b"), (2, 1, 1, 1, (0, size(300)), "a"), (3, 1, 2, 2, (0, size(90)), "a"), (4, 2, 0, 0, (0, 4), "a"), (5, 2, 0, 0, (0, 0), "a"), (6, 3, 0, 0, (0, 8), "a"), (7, 77, 0, 0, (0, 8), "a")]
    p = spark.createDataFrame(pieces, "piece_id long, script_id long, turn int, beat int, text struct<start:long,stop:long>, ingested_at string")
    s = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "script_id long, backend string")
    b = spark.createDataFrame([("x", 48), ("y", 4)], "backend string, max_chunk_secs int")
    parts = packing.parts(p, t, s, b)
    got = packing.chunks(packing.assign(parts)).collect()
    assert all(r.words <= r.room for r in got) and {r.room for r in got if r.script_id == 3} == {10}
    held = sorted((x.piece_id, x.part, x.text.start, x.text.stop) for r in got for x in r.pieces)
    assert [(i, k) for i, k, _, _ in held] == [(1, 0), (2, 0), (2, 1), (2, 2), (3, 0), (4, 0), (5, 0), (6, 0)]
    own = [h for h in held if h[0] == 2]
    assert own[0][2] == 0 and own[-1][3] == size(300) and all(a[3] == z[2] for a, z in itertools.pairwise(own))
    assert len([r for r in got if r.script_id == 1]) == 4
    assert packing.chunks(packing.assign(packing.parts(p.limit(0), t, s, b))).count() == 0


# splitting


def test_pieces_keep_the_text():
    r = random.Random(7)
    for n in (0, 1, 2400, 2401, 5000, 40_000):
        for alphabet in ("ab c. \n", "x", "ก", "é", "one two. three,\n\n# "):
            t = "".join(r.choices(alphabet, k=n))
            got = splitting.pieces(t)
            assert got[0][0] == 0 and got[-1][1] == len(t)
            assert all(0 < z - a <= 2400 or n == 0 for a, z, _ in got)
            for (a, z, _), (b, y, o) in itertools.pairwise(got):
                assert b + o == z and 0 <= o <= 200 and b >= a and y > z


def test_cuts_at_pauses():
    t = ("word " * 100 + "end. ") * 8
    assert all(t[:z].rstrip().endswith(".") for _, z, _ in splitting.pieces(t)[:-1])
    t = "a" * 1500 + "\n\n" + "b" * 1500
    assert splitting.cuts(t) == [1502]


def test_split_frame(spark):
    s = "chunk_id string, ingested_at string, heading_path array<string>, span struct<start:long,stop:long>, text string, n_pieces long"
    long = "Öl und Holz. " * 400
    df = spark.createDataFrame([("a", "1", ["H"], (100, 100 + len(long.encode())), long, 1), ("a", "2", ["H"], (100, 100 + len(long.encode())), long, 1), ("b", "1", None, None, None, 1), ("c", "1", [], (0, 0), "", 1), ("d", "2", [], (0, 5), "short", 1), ("d", "1", [], (0, 5), long, 1)], s)
    got = splitting.split(df).orderBy("chunk_id", "piece_ix").collect()
    a = [r for r in got if r.chunk_id == "a"]
    raw = b"\0" * 100 + long.encode()
    assert len(a) > 2 and all(raw[r.span.start : r.span.stop].decode() == r.text and r.heading_path == ["H"] and len(r.text) <= 2400 for r in a)
    assert [(r.chunk_id, r.n_pieces, r.text) for r in got if r.chunk_id in "bcd"] == [("b", 1, None), ("c", 1, ""), ("d", 1, "short")]
    assert [r.chunk_id for r in splitting.oversized(df).collect()] == ["a"]


# neighbours


def test_hilbert_is_a_walk():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = neighbours.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def exact(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and i is not None and len(v) == 8 and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = set()
    for i, v in ok:
        near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, w in ok if j != i)[:k]
        out |= {(i, j) for _, j in near}
    return out


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(120, 8)), 2).astype(np.float32)
    v[:40] = v[0]  # a third are equal
    v[50] = 2 * v[51]
    rows = [(i, [float(x) for x in v[i]]) for i in range(120)] + [(200, None), (201, []), (202, [1.0] * 7), (203, [0.0] * 8), (204, [float("nan")] + [1.0] * 7), (205, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "item_id long, embedding array<float>")
    got = {(r.item_id, r.neighbour) for r in neighbours.nearest(df, dims=8, block=64, curves=3).collect()}
    assert got == exact(rows, 5)
    few = spark.createDataFrame(rows[100:103] + rows[-3:], "item_id long, embedding array<float>")
    assert {(r.item_id, r.neighbour) for r in neighbours.nearest(few, dims=8, curves=1).collect()} == exact(rows[100:103], 5)
    assert neighbours.nearest(df.limit(0), dims=8).count() == 0


def test_recall_with_small_windows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    v = (centres[rng.integers(0, 60, 900)] + 0.15 * rng.normal(size=(900, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(900)], "item_id long, embedding array<float>")
    got = {(r.item_id, r.neighbour) for r in neighbours.nearest(df, dims=16, block=64, curves=10).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(900) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) / len(want) >= 0.9


def test_best_columns_and_ranges():
    rng = np.random.default_rng(4)
    for m in (3, 50, 401, 1000):
        s = rng.normal(size=(30, m)).astype(np.float32)
        got = neighbours.best_columns(s, 6)
        assert [set(x) for x in got.tolist()] == [set(x) for x in np.argsort(-s, axis=1)[:, :6].tolist()]
    keys = rng.integers(0, 3, size=(200, 4))
    begins = np.array(sorted(map(tuple, rng.integers(0, 3, size=(7, 4)).tolist())))
    assert neighbours.part_of(keys, begins).tolist() == [sum(tuple(b) <= tuple(x) for b in begins.tolist()) for x in keys.tolist()]


def test_refinement_makes_up_for_small_windows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RANGE", 400)  # several ranges a curve
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(80, 16))
    v = (centres[rng.integers(0, 80, 2400)] + 0.4 * rng.normal(size=(2400, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(2400)], "item_id long, embedding array<float>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(2400) for j in np.argsort(-s[i])[:5]}
    recall = [len({(r.item_id, r.neighbour) for r in neighbours.nearest(df, dims=16, block=16, curves=4, rounds=n).collect()} & want) / len(want) for n in (1, 2)]
    assert recall[1] > recall[0] and recall[1] > 0.9


def test_tight_clusters_keep_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "DENSE_FROM", 32)
    # a third of the rows are scaled copies of one vector or copies with noise below a cell; windows hold 96 of them
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 8))
    v[rng.permutation(1500)[:500]] = v[0]
    same = (v == v[0]).all(1)
    v[same] *= rng.uniform(0.1, 9, size=(same.sum(), 1))
    noisy = np.nonzero(same)[0][::2]
    v[noisy] *= 1 + rng.normal(size=(len(noisy), 8)) * np.repeat([1e-6, 1e-4], [len(noisy) // 2, len(noisy) - len(noisy) // 2])[:, None]
    v = v.astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)]
    got = {(r.item_id, r.neighbour) for r in neighbours.nearest(spark.createDataFrame(rows, "item_id long, embedding array<float>"), dims=8, block=32, curves=4).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    cos = np.round(u @ u.T, 9)
    np.fill_diagonal(cos, -9)
    want = {(i, int(j)) for i in np.nonzero(same)[0] for j in np.lexsort((np.arange(1500), -cos[i]))[:5]}
    assert len(got & want) / len(want) >= 0.99


# encoding


@pytest.mark.skipif(not Path(encoding.VOCABULARY).exists(), reason="no vocabulary")
def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(Path(encoding.VOCABULARY).with_suffix(".json")))
    t.encode_special_tokens = True
    r = random.Random(8)
    texts = ["", None, "<|endoftext|> don't we'll I'd", "  a\n\n b \t", "漢字かな交じり文", "naïve café 🌊 ก็ 12345", "x" * 5000, " " * 3000 + "y", "".join(r.choices("ab c'd\n\t 1é漢<|>", k=20_000)), ("word " * 3000) + "z" * 9000 + (" end" * 2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
    for chunk, overlap in ((encoding.CHUNK, encoding.OVERLAP), (1 << 17, 1 << 11), (700, 120), (64, 16)):
        got = {x.doc_id: x.ids for x in encoding.encode(df, chunk=chunk, overlap=overlap).collect()}
        assert got == want, (chunk, overlap)
    twice = spark.createDataFrame([(1, texts[8]), (1, texts[8]), (None, texts[9])], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.ids) for x in encoding.encode(twice, chunk=700, overlap=120).collect())
    assert got == [(0, want[9]), (1, want[8]), (1, want[8])]
    assert all(encoding.decode(want[i]) == (x or "") for i, x in enumerate(texts))


def test_chunks_are_stitched_and_do_decide(monkeypatch):
    t = " ".join(f"word{i} don't" for i in range(400))
    ends = list(encoding.stitches(t, encoding.chunk_places(len(t), 1024, 128)))
    assert len(ends) == len(encoding.chunk_places(len(t), 1024, 128)) > 5 and ends[-1] == len(t)
    whole = encoding.boundaries(t, True)
    assert set(ends[:-1]) <= set(whole)
    # a pre-token longer than any overlap joins its chunks
    long = "ab " * 100 + "x" * 5000 + " cd" * 500
    ends = list(encoding.stitches(long, encoding.chunk_places(len(long), 200, 20)))
    assert ends[-1] == len(long) and not any(300 < e < 5300 for e in ends) and len(ends) > 5
    # without agreement on boundaries every text of several chunks would be one piece
    monkeypatch.setattr(encoding, "boundaries", lambda chunk, last: [])
    assert list(encoding.stitches(t, encoding.chunk_places(len(t), 1024, 128))) == [len(t)]


# leaks


def test_myers_against_the_table():
    r = random.Random(9)
    for m, n in ((0, 4), (1, 0), (3, 5), (7, 8), (8, 3)):
        ps, ts = [[r.randint(2, 4) for _ in range(m)] for _ in range(100)], [[r.randint(2, 4) for _ in range(n)] for _ in range(100)]
        got = leakage.myers(np.array(ps, np.uint64).reshape(100, m), np.array(ts, np.uint64).reshape(100, n))
        for p, t, own in zip(ps, ts, got.tolist(), strict=True):
            d = [[0] * (len(t) + 1) for _ in range(len(p) + 1)]
            for i in range(len(p) + 1):
                for j in range(len(t) + 1):
                    d[i][j] = max(i, j) if not i or not j else min(d[i - 1][j - 1] + (p[i - 1] != t[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
            assert own == [min(row) for row in d]


ITEM = "The keeper of the old harbour log wrote that a narrow water wheel drifted past the flooded meadow in 1875"


def leak_rows(spark):
    w = ITEM.split()
    docs = [
        (1, "x y " + ITEM), (2, "<p>The <b>keeper</b> of&nbsp;the OLD\nharbоur log, wrote <!-- q --> that a [narrow](/x) water!</p>"), (3, " ".join(w[:9])), (4, " ".join(w[3:8] + ["[3]"] + w[8:13])),
        (5, " ".join(w[2:7] + ["zz"] + w[8:13])), (6, None), (7, ""), (8, "q " * 40), (9, " ".join(w[5:15])), (9, " ".join(w[5:15])), (None, ITEM),
    ]
    items = [(7, ITEM), (8, ITEM), (9, None), (10, "too short"), (None, ITEM)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("shipped", [leakage.SHIPPED, 0])
def test_leaks(spark, shipped):
    df, items = leak_rows(spark)
    got = {(r.doc_id, r.item_id): r.distance for r in leakage.leaks(df, items, shipped=shipped).collect()}
    assert {k for k, d in got.items() if d == 0} == {(d, i) for d in (1, 2, 9) for i in (7, 8)}
    assert {k for k, d in got.items() if d == 1} == {(d, i) for d in (3, 4, 5) for i in (7, 8)}
    assert leakage.leaks(df, items.limit(0), shipped=shipped).count() == 0 and leakage.leaks(df.limit(0), items, shipped=shipped).count() == 0


def test_leaks_against_brute_force(spark):
    r = random.Random(12)
    pool = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(pool, k=r.randint(8, 30)))) for i in range(12)]
    docs = []
    for i in range(60):
        w = items[i % 12][1].split()
        a = r.randrange(len(w))
        part = w[a : a + r.randint(9, 14)]
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(part))
            part[at : at + 1] = r.choice(([], ["zz"], [part[at], "zz"]))
        docs.append((i, " ".join([*r.choices(pool, k=r.randint(0, 6)), *part, *r.choices(pool, k=r.randint(0, 6))])))

    def nearest(p, t):  # of a passage to any stretch of the text
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    want = {}
    for d, t in docs:
        for i, x in items:
            w = x.split()
            best = min((nearest(w[k : k + 10], t.split()) for k in range(len(w) - 9)), default=9)
            if best <= 1:
                want[d, i] = best
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id): x.distance for x in got.collect()} == want and len(want) >= 12


def test_without_myers_nothing_leaks(spark, monkeypatch):
    df, items = leak_rows(spark)
    shape = leakage.Shape(10, 1)
    known = leakage._Hashes()
    h = leakage.hashed([ITEM], known)
    grid = np.arange(0, len(h[0]) - 2, 3)
    own = leakage.Pieces(leakage.keys_of(h[0], 3)[grid], pa.array([7] * len(grid)), shape.of_items(h[0], grid))
    assert set(own.find(h, shape)[2].tolist()) == {0}
    monkeypatch.setattr(leakage, "myers", lambda p, t: np.full((len(p), p.shape[1] + 1), 99))
    assert not len(own.find(h, shape)[2])
    assert F is not None and df is not None and items is not None
