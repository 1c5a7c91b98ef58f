"""Problem 2: near-duplicate documents by T-occurrence search over word shingles.

Two texts of n and m different shingles with a Jaccard similarity of at least s share at least
T = ceil(s / (1 + s) * (n + m)) of them. DivideSkip looks a text's shingles up in inverted lists, the shortest
first: of a text's n lists the T0 - SURE longest (T0 = ceil(s * n)) are skipped, and a partner must
occur in at least SURE of the others. Here:

1. One pass gives every text a class (texts of the same words are one class: it is indexed once) and counts the
   shingles in a sketch of fixed size, which never counts too few, so its order of the lists is good and its bound on a list's length holds.
2. The short lists come from a shuffle by shingle. Where the sketch cannot tell that a list is at most ``LIST`` long, its true length is counted; a longer one
   is split into cells of two blocks each, one of a single member is left out. So the work an entry costs does not grow with how full the sketch is.
3. The lists of each class are merged by a heap; partners that occur at least SURE times stay.
4. A partner's remaining shingles - the long lists - are probed by binary search in its sorted shingles, and T is checked.

No list, partner or text is dropped, so the pairs are exact. Defined results: null texts, texts below ``min_chars`` and texts of fewer
words than a shingle are in no pair, but can be members (``short``): those of the same words are one class, and a text without words
(null, empty, blank) is a class of its own; words are the parts between Unicode white space of the lower-cased text;
rows with a null id are left out; an id given twice is a document twice with the same id, which pairs with others once.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.llm import bits
from loomledger.tables import settle

WORDS = 5
SIMILARITY = 0.8
#: A partner must occur in so many of the short lists.
SURE = 4
#: Cells of the sketch and members of a list that one task compares at once.
CELLS = 1 << 24
LIST = 4096
SLICE = bits.SLICE
#: Pairs that a task holds before it passes them on.
HELD = 2_000_000
#: Documents of one class that a task pairs with as many others.
SIDE = 2048
#: Bits of the filter that keeps texts without a candidate out of the verification's shuffle.
BITMAP = 1 << 24


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Each word's 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, w: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


class Shingler:
    """Hashed shingle sets of many texts."""

    def __init__(self, words: int):
        self.words, self.known = words, _Words()
        # a word's place in the shingle turns its hash by an odd factor of its own
        self.factors = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) ** 3 | 1) & (2**64 - 1)) for j in range(words)]

    def hashes(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))

    def shingles(self, h: np.ndarray) -> np.ndarray:
        """The different shingles, sorted, of 48 bits each: two of a thousand differing ones agree once in 10**11."""
        n = len(h) - self.words + 1
        x = h[:n] * self.factors[0]
        for j in range(1, self.words):
            x += h[j : j + n] * self.factors[j]
        x = np.sort(_mix(x) >> np.uint64(16))
        return x[np.append(True, x[1:] != x[:-1])] if n > 1 else x

    def text(self, text: str | None, min_chars: int) -> np.ndarray | None:
        if text is None or len(text) < min_chars:
            return None
        tokens = text.lower().split()
        return self.hashes(tokens) if len(tokens) >= self.words else None


def class_of(h: np.ndarray) -> tuple[int, int]:
    """Two independent 63-bit names of a sequence of words."""
    return _halves(hashlib.blake2b(h.tobytes(), digest_size=16).digest())


def wordless_class(doc: int) -> tuple[int, int]:
    """The names of the class that a document without words is alone in."""
    return _halves(hashlib.blake2b(str(doc).encode(), digest_size=16, person=b"wordless").digest())


def _halves(d: bytes) -> tuple[int, int]:
    return int.from_bytes(d[:8], "little") >> 1, int.from_bytes(d[8:], "little") >> 1


def _rows(batches) -> Iterator[tuple[int, str | None]]:
    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if doc is not None:
                yield doc, text


def _texts(batches, shingler: Shingler, min_chars: int) -> Iterator[tuple[object, np.ndarray]]:
    for doc, text in _rows(batches):
        if (h := shingler.text(text, min_chars)) is not None:
            yield doc, h


def _code(n: np.ndarray) -> np.ndarray:
    """Counts in 16 bits: exact below 2**15, then logarithms, rounded up."""
    n = np.asarray(n, np.float64)
    big = 32768 + np.ceil((np.log2(np.maximum(n, 32768.0)) - 15) * 1024)
    return np.where(n < 32768, n, np.minimum(big, 65535)).astype(np.uint16)


def _decode(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.float64)
    return np.where(c < 32768, c, np.exp2((c - 32768) / 1024 + 15))


def _first_pass(docs: DataFrame, words: int, min_chars: int, short: bool) -> DataFrame:
    from pyspark import TaskContext

    def run(batches):
        s, part = Shingler(words), TaskContext.get().partitionId() % bits.PARTS
        counts = np.zeros(CELLS, np.uint32)
        ids, sigs, checks, cells = [], [], [], []

        def add():
            if cells:
                u, c = np.unique(np.concatenate(cells), return_counts=True)
                counts[u] += c.astype(np.uint32)
                cells.clear()
            rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "sig": pa.array(sigs, pa.int64()), "chk": pa.array(checks, pa.int64()), "slice": pa.nulls(len(ids), pa.int32()), "part": pa.nulls(len(ids), pa.int32()), "data": pa.nulls(len(ids), pa.binary())})
            for x in (ids, sigs, checks):
                x.clear()
            return rows

        for doc, text in _rows(batches):
            h = s.text(text, min_chars)
            if h is not None:
                cells.append((s.shingles(h) & np.uint64(CELLS - 1)).astype(np.int64))
                a, b = class_of(h)
            elif not short:
                continue
            else:
                tokens = (text or "").lower().split()
                a, b = class_of(s.hashes(tokens)) if tokens else wordless_class(doc)
            ids.append(doc)
            sigs.append(a)
            checks.append(b)
            if len(ids) >= 4096:
                yield add()
        if ids:
            yield add()
        for k in range(CELLS // SLICE):
            own = counts[k * SLICE : (k + 1) * SLICE]
            if own.any():
                yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, pa.int64()), "sig": pa.nulls(1, pa.int64()), "chk": pa.nulls(1, pa.int64()), "slice": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([_pack(own)], pa.binary())})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, sig bigint, chk bigint, slice int, part int, data binary")


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(_code(counts).tobytes(), 1)


def _codes(c: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(c), np.uint16)


def _sketch(spark: SparkSession, first: DataFrame) -> bits.Shared:
    """The sketch as a broadcast of at most 2 * CELLS bytes, whatever the number of texts."""
    add = lambda total, c: _decode(_codes(c)) + (0 if total is None else total)
    return bits.share(spark, bits.merged(first.where("slice is not null").select("slice", "part", "data"), add, _pack))


def _name(h: np.ndarray, double: frozenset[int]) -> int:
    a, b = class_of(h)
    return a ^ b if a in double else a


def _postings(docs: DataFrame, words: int, min_chars: int, similarity: float, sketch: bits.Shared, double: frozenset[int]) -> DataFrame:
    """A row for each short list that a class is on; lists that have surely one member are left out. ``open``: the sketch cannot tell that the list is no longer than LIST."""

    def run(batches):
        s, table, seen = Shingler(words), bits.opened(sketch, CELLS, np.uint16, _codes), set()
        out: list[tuple[np.ndarray, ...]] = []
        size = 0
        for _, h in _texts(batches, s, min_chars):
            cls = _name(h, double)
            if cls in seen:
                continue
            seen.add(cls)
            x = s.shingles(h)
            n = len(x)
            code = table[(x & np.uint64(CELLS - 1)).astype(np.int64)]
            order = np.lexsort((x, code))
            order = order[: n - math.ceil(similarity * n - 1e-9) + SURE]
            at = np.nonzero(code[order] > 1)[0].astype(np.int32)
            if len(at):
                out.append((x[order][at].astype(np.int64), np.full(len(at), cls), np.full(len(at), n, np.int32), at, _decode(code[order][at]) > LIST))
                size += len(at)
            if size > 60_000:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["tok", "cls", "n", "at", "open"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "tok bigint, cls bigint, n int, at int, open boolean")


def _cells(postings: DataFrame) -> DataFrame:
    """``postings`` with cell and side. A short list is one cell, in which all meet (side 2); the k blocks of a long one meet two by two, those of different sides (0 and 1) only."""
    short = postings.where("not open").select("tok", F.lit(0).cast("bigint").alias("cell"), F.lit(2).alias("side"), "cls", "n", "at")
    length = postings.where("open").groupBy("tok").agg(F.count("*").alias("_n")).where("_n > 1").select("tok", F.ceil(F.col("_n") / LIST).alias("k"))
    own = postings.where("open").join(length, "tok").withColumn("own", F.pmod("cls", "k"))
    j, mine = F.col("j"), F.col("own")
    split = own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    cell = F.when(F.col("k") == 1, F.lit(0)).otherwise(F.least(mine, j) * F.col("k") + F.greatest(mine, j) + 1)
    return short.unionByName(split.select("tok", cell.cast("bigint").alias("cell"), F.when(j == mine, 2).when(mine < j, 0).otherwise(1).alias("side"), "cls", "n", "at"))


def _need(similarity: float, total: np.ndarray) -> np.ndarray:
    return np.ceil(similarity / (1 + similarity) * total - 1e-9)


def _lists(postings: DataFrame, similarity: float) -> DataFrame:
    """For each class on a list the longer classes on it that can still reach T."""

    def run(batches):
        rest = None
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("tok", "cell", "side", "cls", "n", "at")]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            tok, cell = cols[0], cols[1]
            if (tok[0], cell[0]) == (tok[-1], cell[-1]):
                rest = cols
                continue
            last = len(tok) - int(np.argmax((tok != tok[-1])[::-1] | (cell != cell[-1])[::-1]))
            yield from pairs([c[:last] for c in cols])
            rest = [c[last:] for c in cols]
        if rest is not None and len(rest[0]):
            yield from pairs(rest)

    def pairs(cols):
        tok, cell, side, cls, n, at = cols
        order = np.lexsort((cls, n, cell, tok))
        tok, cell, side, cls, n, at = (c[order] for c in (tok, cell, side, cls, n, at))
        same = np.zeros(len(tok), bool)  # copies of a class from other tasks
        same[1:] = (tok[1:] == tok[:-1]) & (cell[1:] == cell[:-1]) & (cls[1:] == cls[:-1])
        tok, cell, side, cls, n, at = (c[~same] for c in (tok, cell, side, cls, n, at))
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (cell[1:] != cell[:-1])
        group = np.cumsum(new) - 1
        stop = np.append(np.nonzero(new)[0][1:], len(tok))[group]
        # the longer partners end where n exceeds n / similarity
        reach = int((stop - np.arange(len(tok))).max()) if len(tok) else 0
        left_all, right_all, held = [], [], 0
        alive = np.arange(len(tok))
        for d in range(1, reach):
            alive = alive[alive + d < stop[alive]]
            alive = alive[n[alive + d] * similarity <= n[alive] + 1e-9]
            if not len(alive):
                break
            i, j = alive, alive + d
            good = SURE + np.minimum(n[i] - at[i], n[j] - at[j]) - 1 >= _need(similarity, n[i].astype(np.int64) + n[j])
            good &= (side[i] == 2) | (side[i] != side[j])
            left_all.append(i[good])
            right_all.append(j[good])
            held += len(left_all[-1])
            if held > HELD:
                yield from lists(left_all, right_all, cls, n)
                left_all, right_all, held = [], [], 0
        yield from lists(left_all, right_all, cls, n)

    def lists(left_all, right_all, cls, n):
        """A row for each class and the partners of it that are held; a class can have several of a list."""
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left_all, right_all))
        if not len(left):
            return
        order = np.lexsort((cls[right], left))
        left, right = left[order], right[order]
        head = np.append(np.nonzero(np.diff(left, prepend=-1))[0], len(left)).astype(np.int32)
        for a in range(0, len(head) - 1, 20_000):
            cut = head[a : a + 20_001]
            own = pa.ListArray.from_arrays(pa.array(cut - cut[0]), pa.array(cls[right[cut[0] : cut[-1]]]))
            yield pa.RecordBatch.from_arrays([pa.array(cls[left[cut[:-1]]]), pa.array(n[left[cut[:-1]]]), own], names=["cls", "n", "list"])

    ordered = postings.repartition("tok", "cell").sortWithinPartitions("tok", "cell")
    return ordered.mapInArrow(run, "cls bigint, n int, list array<bigint>")


def heap_merge(lists: list[list[int]], least: int) -> list[int]:
    """The members of at least ``least`` of the sorted lists."""
    return [k for k, same in groupby(heapq.merge(*lists)) if sum(1 for _ in same) >= least]


def _candidates(lists: DataFrame, similarity: float) -> DataFrame:
    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("cls", "n", "list")), strict=True)

        a, b = [], []
        for cls, own in groupby(rows(), key=lambda r: r[0]):
            rows_ = list(own)
            least = min(SURE, max(1, math.ceil(similarity * rows_[0][1] - 1e-9)))  # a text of few shingles shares fewer
            if len(rows_) >= least:
                found = heap_merge([x[2] for x in rows_], least)
                a += [cls] * len(found)
                b += found
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return lists.repartition("cls").sortWithinPartitions("cls").mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, ids: DataFrame, candidates: DataFrame, words: int, min_chars: int, double: frozenset[int]) -> DataFrame:
    """The sorted shingles, six bytes each, of the classes that may be in a candidate. Two bitmaps - of the classes, then of their documents - keep all other texts from being read into words again."""
    wanted = bits.bitmap(candidates.select(F.col("a").alias("cls")).union(candidates.select(F.col("b").alias("cls"))), "cls", BITMAP)
    number = F.xxhash64("doc_id").alias("number")

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(bits.has(wanted, BITMAP, b.column(0).to_numpy())))], names=["number"])

    readers = bits.bitmap(ids.select("cls", number).mapInArrow(held, "number bigint"), "number", BITMAP)

    def run(batches):
        s, seen = Shingler(words), set()
        names, sets = [], []
        for b in batches:
            some = b.filter(pa.array(bits.has(readers, BITMAP, b.column("number").to_numpy())))
            for _, h in _texts([some], s, min_chars):
                cls = _name(h, double)
                if cls in seen:
                    continue
                seen.add(cls)
                names.append(cls)
                sets.append(np.ascontiguousarray(s.shingles(h).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
            if len(names) >= 1000:
                yield pa.RecordBatch.from_pydict({"cls": pa.array(names, pa.int64()), "set": pa.array(sets, pa.binary())})
                names, sets = [], []
        yield pa.RecordBatch.from_pydict({"cls": pa.array(names, pa.int64()), "set": pa.array(sets, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null").select("doc_id", "text", number).mapInArrow(run, "cls bigint, set binary")
    return rows.dropDuplicates(["cls"])


def _unpack(b: bytes) -> np.ndarray:
    six = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).ravel()


def probe(mine: np.ndarray, theirs: np.ndarray) -> int:
    """How many members of a sorted set occur in another, by binary search."""
    at = np.searchsorted(theirs, mine)
    at[at == len(theirs)] = 0
    return int((theirs[at] == mine).sum()) if len(theirs) else 0


def _verify(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    def run(batches):
        for b in batches:
            keep, common, union = [], [], []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
                mine, theirs = _unpack(x), _unpack(y)
                c = probe(mine, theirs) if len(mine) <= len(theirs) else probe(theirs, mine)
                u = len(mine) + len(theirs) - c
                keep.append(c >= similarity * u - 1e-9)
                common.append(c)
                union.append(u)
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(common, pa.int32()), pa.array(union, pa.int32())], names=["a", "b", "common", "either"])
            yield out.filter(pa.array(keep, pa.bool_()))

    left = candidates.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint, common int, either int")


def links(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, min_chars: int = 0, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id and cls of every eligible document (with ``short`` of every document), and the pairs of different classes with their shared and joint shingles.

    A class is one sequence of words; it stands for all documents that have it.
    """
    if not 0 < similarity <= 1 or words < 1:
        raise ValueError("similarity must be in (0, 1] and words at least 1")
    spark = docs.sparkSession
    first = settle(_first_pass(docs, words, min_chars, short), "p2-first")
    ids = first.where("slice is null")
    # two word sequences under one 63-bit name: about n**2 / 2**64 of n texts, and those take both their names
    twice = ids.groupBy("sig").agg(F.min("chk").alias("x"), F.max("chk").alias("y")).where("x <> y").select("sig").collect()
    double = frozenset(r["sig"] for r in twice)
    sketch = _sketch(spark, first)
    postings = settle(_postings(docs, words, min_chars, similarity, sketch, double), "p2-postings")
    candidates = settle(_candidates(_lists(_cells(postings), similarity), similarity), "p2-candidates")
    cls = F.when(F.col("sig").isin(*double), F.col("sig").bitwiseXOR(F.col("chk"))).otherwise(F.col("sig")) if double else F.col("sig")
    members = ids.select("doc_id", cls.alias("cls"))
    return members, _verify(candidates, _sets(docs, members, candidates, words, min_chars, double), similarity)


def document_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_a < doc_b: the documents of linked classes, and those of one class. Only classes in a pair or of several documents are joined.

    Both sides of a join are cut into parts of about ``SIDE`` documents a class, so that classes of any size meet in parts.
    """
    m = settle(members.distinct(), "p2-members")
    size = m.groupBy("cls").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / SIDE).cast("int")
    own = m.join(size.where("size > 1"), "cls").select("cls", "doc_id", parts.alias("k"), F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"))
    # each two parts of a class, and each part with itself
    within = own.select("cls", F.col("doc_id").alias("x"), "part", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    facing = own.select("cls", F.col("doc_id").alias("y"), F.col("part").alias("other"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    inside = within.join(facing, ["cls", "part", "other"]).where("x < y").select("x", "y")
    sized = pairs.select("a", "b").join(size.select(F.col("cls").alias("a"), parts.alias("ka")), "a").join(size.select(F.col("cls").alias("b"), parts.alias("kb")), "b")
    cut = sized.withColumn("pa", F.explode(F.sequence(F.lit(0), F.col("ka") - 1))).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)))
    placed = m.join(size, "cls").select("cls", "doc_id", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"))
    left = placed.select(F.col("cls").alias("a"), F.col("part").alias("pa"), F.col("doc_id").alias("x"))
    right = placed.select(F.col("cls").alias("b"), F.col("part").alias("pb"), F.col("doc_id").alias("y"))
    across = cut.join(left, ["a", "pa"]).join(right, ["b", "pb"]).select("x", "y")
    return across.unionByName(inside).where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, grp (the smallest doc_id reached over links) and n_links (linked classes) of every member."""
    members, pairs = settle(members.distinct(), "p2-members"), settle(pairs, "p2-pairs")
    least = members.groupBy("cls").agg(F.min("doc_id").alias("label"))
    both = settle(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "p2-both")
    labels = settle(least, "p2-labels")
    linked = both.select(F.col("a").alias("cls")).distinct()
    moving = settle(labels.join(linked, "cls", "left_semi"), "p2-moving")
    while True:  # until no label moves; each round at least doubles how far a label has got along a chain
        heard = both.join(moving.select(F.col("cls").alias("b"), "label"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("heard"))
        step = moving.join(heard, "cls", "left").select("cls", F.least("label", "heard").alias("label"), (F.col("heard") < F.col("label")).alias("changed"))
        # a label that is itself a class's smallest document is followed to where that class has got
        step = settle(step, "p2-step")
        owner = least.select(F.col("cls").alias("own"), F.col("label").alias("label"))
        jumped = step.join(owner, "label", "left").join(step.select(F.col("cls").alias("own"), F.col("label").alias("further")), "own", "left")
        moving = settle(jumped.select("cls", F.least("label", "further").alias("label"), F.coalesce(F.col("changed") | (F.col("further") < F.col("label")), F.lit(False)).alias("changed")), "p2-moving")
        if not moving.where("changed").limit(1).count():
            break
        moving = moving.select("cls", "label")
    n = both.groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("n_links"))
    out = members.join(labels, "cls").join(moving.select("cls", F.col("label").alias("reached")), "cls", "left").join(n, "cls", "left")
    return out.select("doc_id", F.coalesce("reached", "label").alias("grp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
