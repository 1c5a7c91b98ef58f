"""Problem 6: the most similar vectors of every vector, by shifted space-filling curves.

Unit vectors are projected onto a few random directions, several times over; each projection, shifted at random, is laid on a Hilbert curve. The keys of a curve
are range-partitioned by the quantiles of a sample, with the vectors beside them: a vector is sent once a curve. In its range every run of ``block`` keys
meets itself and the runs on either side, so a vector is compared with ``block`` to 2 * ``block`` vectors on both sides on each curve, whatever their number; the lists of all
curves are merged into ``KEEP`` candidates a vector.

Curves miss neighbours the more vectors there are, so the lists are refined: every vector is sent to the ``GUIDES`` first of its list and to itself, and the
vectors that meet at one of them are compared in double precision - neighbours of neighbours, both ways. ``rounds`` times. The work a vector costs does not grow with their number;
README has the measured recall.

Exactly equal vectors are one class: it travels once, with the six smallest ids of its members, however many it has. No list is cut: the nearest of a class come from its own
members and those of other classes.

Tight clusters (scaled or slightly noisy copies): below its first bits a key goes on for 14 more bits an axis, so each curve orders the inside of a cell its own way; and the vectors of
a cell that fills more than ``DENSE_FROM`` keys in a row are compared all with all. Each vector takes part in the fullest of its cells, so a cluster is compared once, on a curve
that doesn't divide it. That work is quadratic in the cluster.

Defined results: vectors that are null, not of ``dims`` members, not finite or all zero have no neighbours and are
nobody's; with fewer than k + 1 usable vectors, the neighbours are all others. Rows with a null id are left out; a row given twice counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomledger.tables import settle

K = 5
DIMS = 64
CURVES = 12
BLOCK = 2048
ROUNDS = 1
#: Candidates kept of each vector, and those it is sent to for a round.
KEEP = 10
GUIDES = 7
AXES = 8
BITS = 7
#: Bits an axis of a whole key; vectors of a cell beyond which all are compared with all, and of such a cell that one task compares with as many others.
FINE = 21
DENSE_FROM = 2048
DENSE = 8192
#: Vectors of a range of a curve, and the most vectors that the ranges are measured on.
RANGE = 16_384
SAMPLE = 100_000
#: Vectors that meet at one guide in one task.
MEET = 256

def _transposed(cells: np.ndarray, bits: int) -> np.ndarray:
    """Skilling's transform: a row for each axis; the places' bits are theirs, taken in turn."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        low = q - one
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, np.uint64(0)) ^ swap
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= t
    return x


def _woven(x: np.ndarray, high: int, low: int) -> np.ndarray:
    """The bits from ``high`` (exclusive) down to ``low`` of all axes as one number."""
    key = np.zeros_like(x[0])
    for j in range(high - 1, low - 1, -1):
        for row in x:
            key = (key << np.uint64(1)) | ((row >> np.uint64(j)) & np.uint64(1))
    return key.astype(np.int64)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places on the Hilbert curve of points with integer coordinates below 2**bits."""
    return _woven(_transposed(cells, bits), bits, 0)


def curve_keys(units: np.ndarray, curve: int, axes: int = AXES, bits: int = BITS) -> list[np.ndarray]:
    """The places on a curve, ``bits`` an axis in each member: the first is the cell, the others go on inside it."""
    rng = np.random.default_rng(7919 + curve)
    to = np.linalg.qr(rng.normal(size=(units.shape[1], min(axes, units.shape[1]))))[0]
    spread = 3.0 / np.sqrt(units.shape[1])  # a unit vector's coordinate rarely leaves three deviations
    y = (units @ to + spread) / (2 * spread) * 0.75 + rng.uniform(0, 0.25, size=to.shape[1])
    x = _transposed(np.clip(y * (1 << FINE), 0, (1 << FINE) - 1).astype(np.int64), FINE)
    return [_woven(x, high, high - bits) for high in range(FINE, 0, -bits)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Breaks what ties remain between keys, in the same way on all curves."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _units(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    u = _matrix(column, dims)
    return u / np.linalg.norm(u, axis=1)[:, None]


def usable(items: DataFrame, dims: int = DIMS) -> DataFrame:
    """item_id, embedding and two hashes of it, of the vectors that have ``dims`` finite members, not all zero."""
    key = items.schema["item_id"].dataType.simpleString()
    odd = np.random.default_rng(31).integers(0, 2**63, size=(2, dims), dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for b in batches:
            v = b.column("embedding")
            b = b.filter(pa.compute.and_(pa.compute.equal(pa.compute.list_value_length(v), dims), b.column("item_id").is_valid()))
            if not b.num_rows:
                continue
            flat = b.column("embedding").flatten()
            m = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims) + np.float32(0)  # null members become NaN, -0 becomes 0
            good = np.isfinite(m).all(1) & (m != 0).any(1)
            bits = m.view(np.uint32).astype(np.uint64) + np.uint64(1)
            hashes = [pa.array(((bits * o).sum(1, dtype=np.uint64) ^ (bits[:, ::-1] * o).sum(1, dtype=np.uint64) >> np.uint64(29)).view(np.int64)) for o in odd]
            yield pa.RecordBatch.from_arrays([*b.columns, *hashes], names=["item_id", "embedding", "d1", "d2"]).filter(pa.array(good))

    return items.select("item_id", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, f"item_id {key}, embedding array<float>, d1 bigint, d2 bigint")


def classes(tags: DataFrame, keep: int) -> DataFrame:
    """One row per exactly equal vector (by its hashes): the smallest id and the ``keep`` smallest ids."""
    w = Window.partitionBy("d1", "d2").orderBy("item_id")
    first = tags.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= keep)  # a group limit before the shuffle
    return first.groupBy("d1", "d2").agg(F.min("item_id").alias("cls"), F.array_sort(F.collect_set("item_id")).alias("ids"))


def best_columns(score: np.ndarray, k: int) -> np.ndarray:
    """The k best columns of each row: first of columns in groups by the best of each, then of the members of the k best groups, in which they all are."""
    n, m = score.shape
    if m <= k:
        return np.tile(np.arange(m), (n, 1))
    width = m // 8
    if width <= 2 * k:
        return np.argpartition(-score, k - 1, axis=1)[:, :k]
    top = score[:, :width].copy()
    for g in range(1, 8):
        np.maximum(top, score[:, g * width : (g + 1) * width], out=top)
    group = np.argpartition(-top, k - 1, axis=1)[:, :k]
    some = (group[:, :, None] + np.arange(8) * width).reshape(n, -1)
    if 8 * width < m:
        some = np.concatenate([some, np.tile(np.arange(8 * width, m), (n, 1))], axis=1)
    pick = np.argpartition(-np.take_along_axis(score, some, 1), k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, pick, 1)


_LISTS = "cls bigint, near array<bigint>, cos array<double>"


def _lists(cls: np.ndarray, near: np.ndarray, cos: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(near, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(cos, pa.float64()))], names=["cls", "near", "cos"])


def _ranked(cls: np.ndarray, near: np.ndarray, cos: np.ndarray, keep: int) -> pa.RecordBatch:
    """The ``keep`` best different partners of each class, ties to the smaller id."""
    order = np.lexsort((-cos, near, cls))
    cls, near, cos = cls[order], near[order], cos[order]
    new = np.ones(len(cls), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (near[1:] != near[:-1])
    cls, near, cos = cls[new], near[new], cos[new]
    order = np.lexsort((near, -cos, cls))
    cls, near, cos = cls[order], near[order], cos[order]
    first = np.nonzero(np.append(True, cls[1:] != cls[:-1]))[0] if len(cls) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(cls)))
    good = np.arange(len(cls)) - np.repeat(first, sizes) < keep
    return _lists(cls[first], near[good], cos[good], np.minimum(sizes, keep))


def merged(lists: DataFrame, keep: int = KEEP) -> DataFrame:
    """One list a class out of several."""

    def run(batches):
        rest: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for b in batches:
            sizes = b.column("near").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            own = (np.repeat(b.column("cls").to_numpy(), sizes), b.column("near").flatten().to_numpy(zero_copy_only=False), b.column("cos").flatten().to_numpy(zero_copy_only=False))
            rest = tuple(np.concatenate(x) for x in zip(rest, own, strict=True))
            if len(rest[0]):
                last = int(np.searchsorted(rest[0], rest[0][-1], "left"))  # the last class can go on
                if last > 50_000:
                    yield _ranked(*(x[:last] for x in rest), keep)
                    rest = tuple(x[last:] for x in rest)
        if len(rest[0]):
            yield _ranked(*rest, keep)

    return lists.repartition("cls").sortWithinPartitions("cls").mapInArrow(run, _LISTS)


def _exact(units: np.ndarray, others: np.ndarray, ids: np.ndarray, k: int, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of ``others`` by the rounded cosine in double precision, ties to the smaller id; pairs ``apart`` don't count."""
    m = len(others)
    place = np.empty(m)
    place[np.argsort(ids)] = np.arange(m)
    cos = units @ others.T
    rank = place - np.rint(cos * 1e9) * m  # whole numbers below 2**53: the rounded cosine first, then the id
    rank[apart] = np.inf
    pick = np.argpartition(rank, k - 1, axis=1)[:, :k] if k < m else np.tile(np.arange(m), (len(units), 1))
    got = np.take_along_axis(rank, pick, 1)
    order = np.argsort(got, axis=1)
    pick, got = np.take_along_axis(pick, order, 1), np.take_along_axis(got, order, 1)
    return pick, np.where(np.isinf(got), -9, np.round(np.take_along_axis(cos, pick, 1), 9))


def _all(dims: int, k: int):
    """Compares two parts of a full cell, or one part with itself."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        right = table.column("right").to_numpy()
        cls = table.column("cls").to_numpy()
        u = _units(table.column("embedding"), dims)
        one = not right.any()
        lists = []
        for side in (0,) if one else (0, 1):
            mine, their = np.nonzero(right == side)[0], np.nonzero(right == (0 if one else 1 - side))[0]
            for a in range(0, len(mine) if len(their) else 0, 256):
                q = mine[a : a + 256]
                out, cos = _exact(u[q], u[their], cls[their], k, cls[q][:, None] == cls[their])
                good = cos > -1.5
                lists.append(_lists(cls[q], cls[their][out][good], cos[good], good.sum(1)))
        return pa.Table.from_batches(lists) if lists else pa.Table.from_batches([_lists(*(np.zeros(0),) * 4)])

    return run


def _window(dims: int, block: int, curves: int):
    """Compares the runs of a range with themselves and the runs beside them; also says which vectors lie in a full cell."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        curve = table.column("curve")[0].as_py()
        cls = table.column("cls").to_numpy()
        u = _units(table.column("embedding"), dims)
        keys = curve_keys(u, curve)
        order = np.lexsort((_mixed(cls), *keys[::-1]))
        cls, cell, f = cls[order], keys[0][order], u[order].astype(np.float32)
        n = len(cls)
        ids, near, cos, sizes = [], [], [], []
        for a in range(0, n, block):
            z, lo, hi = min(n, a + block), max(0, a - block), min(n, a + 2 * block)
            for x in range(a, z, 256):
                y = min(z, x + 256)
                score = f[x:y] @ f[lo:hi].T
                score[np.arange(y - x), np.arange(x, y) - lo] = -2
                pick = best_columns(score, min(KEEP, hi - lo))
                s = np.take_along_axis(score, pick, 1)
                good = s > -1.5
                ids.append(cls[x:y])
                near.append(cls[lo + pick][good])
                cos.append(s[good].astype(np.float64))
                sizes.append(good.sum(1))
        out = pa.Table.from_batches([_lists(*(np.concatenate(x) for x in (ids, near, cos, sizes)))])
        first = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0]
        held = np.repeat(np.diff(np.append(first, n)), np.diff(np.append(first, n)))
        full = np.where(held > DENSE_FROM, held, 0)
        return out.append_column("full", pa.array(full, pa.int32())).append_column("cell", pa.array(cell)).append_column("curve", pa.array(np.full(n, curve, np.int32)))

    return run


def _meeting(dims: int):
    """Compares the vectors that are at one guide, in double precision."""

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            guide, salt = t.column("guide").to_numpy(), t.column("salt").to_numpy()
            same = (guide == guide[-1]) & (salt == salt[-1]) if len(guide) else np.zeros(0, bool)
            last = len(guide) - int(same.sum())
            if last < 4096:
                rest = t
                continue
            yield compared(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield compared(rest)

    def compared(t: pa.Table) -> pa.RecordBatch:
        guide, salt, cls = (t.column(c).to_numpy() for c in ("guide", "salt", "cls"))
        u = _units(t.column("embedding"), dims)
        new = np.append(True, (guide[1:] != guide[:-1]) | (salt[1:] != salt[:-1]))
        first = np.nonzero(new)[0]
        stop = np.repeat(np.append(first[1:], len(guide)), np.diff(np.append(first, len(guide))))
        left, right, cos = [], [], []
        alive = np.arange(len(guide))
        for d in range(1, int((stop - np.arange(len(guide))).max())):
            alive = alive[alive + d < stop[alive]]
            for a in range(0, len(alive), 100_000):
                i = alive[a : a + 100_000]
                left.append(cls[i])
                right.append(cls[i + d])
                cos.append(np.round(np.einsum("nd,nd->n", u[i], u[i + d]), 9))
        if not left:
            return _ranked(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), KEEP)
        x, y, c = np.concatenate(left), np.concatenate(right), np.concatenate(cos)
        other = x != y
        x, y, c = x[other], y[other], c[other]
        return _ranked(np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([c, c]), KEEP)

    return run


def _refined(lists: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """Lists of those that meet at the first of their lists or at themselves. At a guide of very many they meet in parts, and the guide is in each of them."""
    sent = lists.select("cls", F.explode(F.slice("near", 1, GUIDES)).alias("guide"))
    crowded = sent.groupBy("guide").agg(F.count("*").alias("n")).where(F.col("n") > MEET).select("guide", F.ceil(F.col("n") / MEET).cast("int").alias("parts"))
    some = sent.join(crowded, "guide", "left").select("cls", "guide", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("cls"), "parts")).cast("int").alias("salt"))
    selves = lists.select("cls").join(crowded.withColumnRenamed("guide", "cls"), "cls", "left").select("cls", F.col("cls").alias("guide"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    targets = some.unionByName(selves).groupBy("cls").agg(F.collect_list(F.struct("guide", "salt")).alias("to"))
    going = vectors.join(targets, "cls").select("cls", "embedding", F.explode("to").alias("t")).select("t.guide", "t.salt", "cls", "embedding")
    return going.repartition("guide", "salt").sortWithinPartitions("guide", "salt").mapInArrow(_meeting(dims), _LISTS)


def _ranges(vectors: DataFrame, n: int, curves: int, dims: int) -> list[np.ndarray]:
    """Of each curve the keys at which its ranges begin, from at most ``SAMPLE`` vectors by the hash of their ids."""
    parts = -(-n // RANGE)
    if parts <= 1:
        return [np.zeros((0, FINE // BITS + 1), np.int64)] * curves
    share = min(1.0, 64 * parts / n, SAMPLE / n)
    t = vectors.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE).toArrow().combine_chunks()
    u, cls = _units(t.column("embedding"), dims), t.column("cls").to_numpy()
    out = []
    for c in range(curves):
        keys = np.stack([*curve_keys(u, c), _mixed(cls)], axis=1)
        keys = keys[np.lexsort(keys.T[::-1])]
        out.append(keys[np.linspace(0, len(keys), parts, endpoint=False).astype(int)[1:]])
    return out


def part_of(keys: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of each key (a row of numbers) how many ranges begin at or before it."""
    both = np.concatenate([begins, keys])
    own = np.arange(len(both)) >= len(begins)
    order = np.lexsort((own, *both.T[::-1]))
    out = np.empty(len(both), np.int64)
    out[order] = np.cumsum(~own[order])
    return out[len(begins) :]


def nearest(items: DataFrame, k: int = K, dims: int = DIMS, curves: int = CURVES, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """item_id, neighbour, cosine (rounded to 9 decimals) and rank (from 1) of the ``k`` nearest of each usable item."""
    if k > min(KEEP, GUIDES):
        raise ValueError("more neighbours than lists keep")
    rows = usable(items.withColumn("item_id", F.col("item_id").cast("bigint")), dims)
    tags = rows.select("item_id", "d1", "d2")
    own = settle(classes(tags, k + 1), "p6-classes")
    vectors = settle(rows.select(F.col("item_id").alias("cls"), "embedding").join(own.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "p6-vectors")
    begins = items.sparkSession.sparkContext.broadcast(_ranges(vectors, vectors.count(), curves, dims))

    def place(batches):
        for b in batches:
            u, cls = _units(b.column("embedding"), dims), b.column("cls").to_numpy()
            for c, own_begins in enumerate(begins.value):
                part = part_of(np.stack([*curve_keys(u, c), _mixed(cls)], axis=1), own_begins) if len(own_begins) else np.zeros(len(u), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), c, np.int32)), pa.array(part.astype(np.int32)), *b.select(["cls", "embedding"]).columns], names=["curve", "part", "cls", "embedding"])

    placed = vectors.mapInArrow(place, "curve int, part int, cls bigint, embedding array<float>")
    near = settle(placed.groupBy("curve", "part").applyInArrow(_window(dims, block, curves), f"{_LISTS}, full int, cell bigint, curve int"), "p6-near")
    lists = merged(near.select("cls", "near", "cos"))
    for i in range(rounds):
        lists = settle(lists, "p6-lists")
        lists = merged(_refined(lists, vectors, dims))
    # a full cell is divided into parts, and each two of them meet
    fullest = near.where("full > 0").groupBy("cls").agg(F.max(F.struct("full", "curve", "cell")).alias("f")).select("cls", "f.curve", "f.cell")
    size = fullest.groupBy("curve", "cell").agg(F.ceil(F.count("*") / DENSE).cast("int").alias("parts"))
    cut = fullest.join(size, ["curve", "cell"]).withColumn("p", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    halves = cut.select("cls", "curve", "cell", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).select("cls", "curve", "cell", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), (F.col("p") > F.col("q")).cast("int").alias("right"))
    dense = halves.join(vectors, "cls").groupBy("curve", "cell", "x", "y").applyInArrow(_all(dims, k), _LISTS)
    exact = merged(lists.unionByName(dense), k)
    # other classes give up to k ids each; the best k of them
    pair = exact.select("cls", F.explode(F.arrays_zip("near", "cos")).alias("x")).select("cls", F.col("x.near").alias("n"), (-F.col("x.cos")).alias("c"))
    other = pair.join(own.select(F.col("cls").alias("n"), F.col("ids").alias("nids")), "n").select("cls", F.transform(F.slice("nids", 1, k), lambda i: F.struct(F.col("c").alias("c"), i.alias("i"))).alias("l"))
    best = other.groupBy("cls").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, k).alias("l"))
    with_ids = own.select("d1", "d2", "cls", "ids").join(best, "cls", "left").select("d1", "d2", "ids", F.coalesce("l", F.array().cast("array<struct<c:double,i:bigint>>")).alias("l"))
    few = F.slice(F.array_sort(F.concat(F.filter(F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("c"), i.alias("i"))), lambda s: s["i"] != F.col("item_id")), "l")), 1, k)
    # members find their class again by the vector's hashes; the class side is small where members are many
    return tags.join(with_ids, ["d1", "d2"]).select("item_id", F.posexplode(few).alias("rank", "s")).select("item_id", F.col("s.i").alias("neighbour"), (-F.col("s.c")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def pairs(found: DataFrame) -> DataFrame:
    """Each pair of which one is among the nearest of the other, the smaller id first."""
    return found.select(F.least("item_id", "neighbour").alias("item_a"), F.greatest("item_id", "neighbour").alias("item_b")).distinct()
