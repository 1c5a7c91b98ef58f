"""Vectors: the deterministic stand-in for an embedding model, cosines, and exact top-k by blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from loomledger.config import DEFAULT
from loomledger.functions.ids import per_mille
from loomledger.functions.text import content_words
from loomledger.tables import settle

SLOTS = 256


def slot_of(word: Column, slots: int = SLOTS) -> Column:
    return (F.conv(F.substring(F.md5(F.encode(word, "utf-8")), 1, 4), 16, 10).cast("int") % slots).cast("int")


def slots_of(text: Column | str, slots: int = SLOTS) -> Column:
    """The slot of each content word; the counts of the slots are the stand-in's vector before it is normalised."""
    return F.transform(content_words(text), lambda w: slot_of(w, slots))


def dot_of_slots(a: Column, b: Column) -> Column:
    """The dot product of two count vectors given as arrays of slots."""
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + F.size(F.filter(b, lambda y: y == x)))


def cosine_of_slots(a: Column, b: Column) -> Column:
    """Cosine of two count vectors; 0 where one is empty. Integer counts until the last step, so no rounding differs between engines."""
    aa, bb = dot_of_slots(a, a), dot_of_slots(b, b)
    return F.when((aa > 0) & (bb > 0), dot_of_slots(a, b) / F.sqrt((aa * bb).cast("double"))).otherwise(F.lit(0.0))


def _dense(flat: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """Counts of slots, a row for each array."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(rows * slots + flat, minlength=len(sizes) * slots).reshape(len(sizes), slots).astype(np.float64)


def _of_series(s: pd.Series, slots: int) -> np.ndarray:
    sizes = np.array([0 if x is None else len(x) for x in s], np.int64)
    flat = np.concatenate([x for x in s if x is not None and len(x)] or [np.zeros(0, np.int64)]).astype(np.int64)
    return _dense(flat, sizes, slots)


@F.pandas_udf(DoubleType())
def pair_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """``cosine_of_slots`` for many pairs at once, as count matrices."""
    parts = [np.zeros(0)]
    for i in range(0, len(a), 4096):
        x, y = _of_series(a[i : i + 4096], SLOTS), _of_series(b[i : i + 4096], SLOTS)
        norms = (x * x).sum(1) * (y * y).sum(1)
        parts.append(np.where(norms > 0, (x * y).sum(1) / np.sqrt(np.where(norms > 0, norms, 1)), 0.0))
    return pd.Series(np.concatenate(parts), dtype="float64")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; 0 where a norm is zero or the lengths differ; null members count as zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    one = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    dot = total(F.zip_with(a, b, lambda x, y: one(x) * one(y)))
    norms = F.sqrt(total(F.transform(a, lambda x: one(x) * one(x)))) * F.sqrt(total(F.transform(b, lambda x: one(x) * one(x))))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot / norms).otherwise(F.lit(0.0))


def usable(v: Column | str) -> Column:
    """Whether a provider's vector is there, not empty and finite."""
    v = F.col(v) if isinstance(v, str) else v
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & sound, F.lit(False))


def _matrix(column: pa.Array, dims: int | None) -> np.ndarray:
    """Slot arrays become counts; vectors stay as they are."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if dims is None:
        return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    sizes = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return _dense(flat.astype(np.int64), sizes, dims)


_FOUND = "qid bigint, cid bigint, sim_pm int, cosine double, ord bigint"

#: Count vectors of many queries meet in cells of at most so many queries and rows; a cell takes its rows in parts of ``PART``, and there are ``CELLS_A_CORE`` cells for each core at least. Sums of up to ``SHARED`` - 1 slots are taken over by the next query.
CELL_QUERIES, CELL_ROWS, PART, CELLS_A_CORE, SHARED = 1 << 16, 1 << 19, 1 << 15, 2, 4


def top_k(queries: DataFrame, corpus: DataFrame, k: int, floor_pm: int = 0, slots: int | None = SLOTS, on_pm: bool = True, block: int = DEFAULT.query_block, corpus_block: int = 1 << 16) -> DataFrame:
    """qid, cid, sim_pm, cosine and rank (from 1) of the ``k`` most similar rows of ``corpus`` for each row of ``queries``.

    Both sides have ``id`` (long), ``ord`` (order for ties), ``vec`` (slot arrays, or vectors of one length with ``slots=None``) and ``grp``
    (array of groups on the query side, one group on the corpus side; a query meets no row of its own groups, null groups exclude nothing).
    Exact: every query meets every row. Up to ``block`` queries are broadcast, so what a task holds does not grow with the data. More of them, and the corpus, are cut into blocks, and
    each two blocks meet in one task of a single job. A task reduces its rows to k a query before the shuffle. Rows whose cosine, in per mille, is below ``floor_pm`` are left out.
    More than ``block`` slot arrays above a floor are compared by ``_counted``, which finds the same with a sum of a few columns for each query.
    Where the floor is high and a collection is compared with itself, ``similar`` finds the same without comparing all.
    """
    q = queries.select(F.col("id").cast("bigint").alias("id"), "vec", "grp")
    c = corpus.select(F.col("id").cast("bigint").alias("id"), F.col("ord").cast("bigint").alias("ord"), "vec", "grp")
    n = q.count()
    if n <= block:
        rows = q.toArrow().combine_chunks()  # within ``block`` rows
        shipped = corpus.sparkSession.sparkContext.broadcast(_side(rows, slots) if rows.num_rows else None)

        def run(batches):
            own = shipped.value
            for b in batches if own is not None else ():
                for a in range(0, b.num_rows, 2048):
                    yield _compared(own, pa.Table.from_batches([b.slice(a, 2048)]), k, floor_pm, slots, on_pm)

        out = c.mapInArrow(run, _FOUND)
    elif slots is not None and slots <= 256 and on_pm and floor_pm > 0:
        out = _counted(q, n, c, k, floor_pm, slots)
    else:
        qn, cn = -(-n // block), max(1, -(-c.count() // corpus_block))
        cell = lambda df, own, parts, other, others: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        left = cell(q, "qb", qn, "cb", cn)
        right = cell(c, "cb", cn, "qb", qn)

        def meet(x: pa.Table, y: pa.Table) -> pa.Table:
            if not x.num_rows or not y.num_rows:
                return pa.Table.from_batches([], schema=pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("sim_pm", pa.int32()), ("cosine", pa.float64()), ("ord", pa.int64())]))
            own = _side(x.combine_chunks(), slots)
            return pa.Table.from_batches([_compared(own, y.slice(a, 2048), k, floor_pm, slots, on_pm) for a in range(0, y.num_rows, 2048)])

        out = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, _FOUND)
    by = [F.desc("sim_pm")] if on_pm else [F.desc("cosine")]
    w = Window.partitionBy("qid").orderBy(*by, "ord")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "cid", "sim_pm", "cosine", "rank")


def _side(t: pa.Table, slots: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """ids, vectors, their squared lengths and groups of the queries."""
    t = t.combine_chunks()
    m = _matrix(t.column("vec").combine_chunks() if isinstance(t.column("vec"), pa.ChunkedArray) else t.column("vec"), slots)
    return t.column("id").to_numpy(), m, (m * m).sum(1), [set(g or ()) for g in t.column("grp").to_pylist()]


def _compared(own, part: pa.Table, k: int, floor_pm: int, slots: int | None, on_pm: bool) -> pa.RecordBatch:
    """The best rows of a part of the corpus for each query."""
    qid, qm, qn, groups = own
    part = part.combine_chunks()
    cid, order = part.column("id").to_numpy(), part.column("ord").to_numpy()
    cm = _matrix(part.column("vec").combine_chunks(), slots)
    norm = np.sqrt(np.outer(qn, (cm * cm).sum(1)))
    cos = np.where(norm > 0, (qm @ cm.T) / np.where(norm > 0, norm, 1), 0.0)
    pm = np.floor(np.clip(cos, 0, 1) * 1000 + 0.5).astype(np.int32)
    score = pm.astype(np.float64) if on_pm else cos.copy()
    score[pm < floor_pm] = -9
    score[qid[:, None] == cid[None, :]] = -9
    if any(groups):
        names = part.column("grp").to_pylist()
        code = {g: i for i, g in enumerate(dict.fromkeys(x for x in names if x is not None))}
        backed = np.zeros((len(qid), len(code) + 1), bool)
        for r, g in enumerate(groups):
            backed[r, [code[x] for x in g if x in code]] = True
        score[backed[:, [len(code) if x is None else code[x] for x in names]]] = -9
    # all that tie with the k-th stay, unless a row has very many ties: then their order decides here
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), -5.0)
    mask = (score >= least[:, None]) & (score > -5)
    for r in np.nonzero(mask.sum(1) > 8 * k)[0]:
        keep = np.lexsort((order, -score[r]))[:k]
        mask[r] = False
        mask[r, keep[score[r, keep] > -5]] = True
    rr, cc = np.nonzero(mask)
    return pa.RecordBatch.from_arrays([pa.array(qid[rr]), pa.array(cid[cc]), pa.array(pm[rr, cc]), pa.array(cos[rr, cc]), pa.array(order[cc])], names=["qid", "cid", "sim_pm", "cosine", "ord"])


def _counted(q: DataFrame, n: int, c: DataFrame, k: int, floor_pm: int, slots: int) -> DataFrame:
    """The best rows of each cell of queries and rows, for slot arrays; rows without slots are below any floor."""
    spark = q.sparkSession
    cores = spark.sparkContext.defaultParallelism
    cn = max(1, -(-c.count() // CELL_ROWS))
    qn = max(-(-n // CELL_QUERIES), min(-(-CELLS_A_CORE * cores // cn), -(-n // 1024)))
    cells = qn * cn
    # the names of the cells: numbers that the hash partitioning of one cell a partition tells apart
    at = spark.sql(f"SELECT transform(sequence(0, {64 * cells}), x -> pmod(hash(x), {cells})) AS at").first()["at"]
    name = {r: x for x, r in reversed(list(enumerate(at)))}
    names = [name.get(i, 64 * cells + i + 1) for i in range(cells)]

    def packed(batches):
        """Slots as bytes, and the squared length."""
        for b in batches:
            t = pa.Table.from_batches([b])
            vec = t.column("vec").combine_chunks()
            sizes = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sq = np.zeros(len(sizes), np.int64)
            for a in range(0, len(sizes), 2048):
                m = _dense(flat[ends[a] : ends[min(a + 2048, len(sizes))]].astype(np.int64), sizes[a : a + 2048], slots)
                sq[a : a + 2048] = (m * m).sum(1)
            data = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            t = t.set_column(t.schema.get_field_index("vec"), "vec", data).append_column("sq", pa.array(sq)).filter(pa.array(sq > 0))
            yield from t.to_batches()

    def celled(df: DataFrame, kinds: str, parts: int, numbers) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        lists = F.array(*[F.array(*[F.lit(names[i]) for i in numbers(p)]) for p in range(parts)])
        return df.mapInArrow(packed, kinds).withColumn("cell", F.explode(F.get(lists, own))).repartition(cells, "cell")

    left = celled(q.select("id", "vec", "grp"), "id bigint, vec binary, grp array<string>, sq bigint", qn, lambda p: range(p * cn, p * cn + cn))
    right = celled(c.select("id", "ord", "vec", "grp"), "id bigint, ord bigint, vec binary, grp string, sq bigint", cn, lambda p: range(p, cells, cn))
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(lambda x, y: _best_counted(x, y, k, floor_pm, slots), _FOUND)


def _bytes_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all rows, and where each row's begin and the last one's end."""
    vec = t.column("vec").combine_chunks().cast(pa.large_binary())
    ends = np.frombuffer(vec.buffers()[1], np.int64)[vec.offset : vec.offset + len(vec) + 1]
    return np.frombuffer(vec.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _best_counted(x: pa.Table, y: pa.Table, k: int, floor_pm: int, slots: int) -> pa.Table:
    """The ``k`` best rows of ``y`` for each row of ``x``, by per mille and order.

    The rows are counted slot by slot, a column for each slot, so a query's dot products are the sum of the columns of its slots: one byte a row where no sum can be over 255; rows come
    by their lengths, which keeps the few that need wider sums together. The least per mille that still counts, that of the k-th row so far, at first the floor, is a least dot product
    for each row's length. Only rows that have it are looked at one by one.
    """
    if not x.num_rows or not y.num_rows:
        return pa.table({"qid": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "sim_pm": pa.array([], pa.int32()), "cosine": pa.array([], pa.float64()), "ord": pa.array([], pa.int64())})
    # by length, behind a small part of all lengths, which lifts the floor of most queries
    by = np.argsort(y.column("sq").to_numpy(), kind="stable")
    every = -(-len(by) * 16 // PART)
    few = len(by[::every])
    y = y.take(pa.array(np.concatenate([by[::every], np.delete(by, slice(None, None, every))])))
    qid, qsq, qgrp = x.column("id").to_numpy(), x.column("sq").to_numpy().tolist(), x.column("grp").to_pylist()
    cid, order, csq = (y.column(c).to_numpy() for c in ("id", "ord", "sq"))
    named = y.column("grp").combine_chunks().dictionary_encode()
    code = named.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    known = {g: i for i, g in enumerate(named.dictionary.to_pylist())}
    backed = [[known[g] for g in set(own or ()) if g in known] for own in qgrp]
    qflat, qends = _bytes_of(x)
    cflat, cends = _bytes_of(y)
    lists = [qflat[a:b].tolist() for a, b in zip(qends, qends[1:])]
    lengths = [v**0.5 for v in qsq]
    same = set(qid.tolist()) & set(cid.tolist())
    ids = qid.tolist()
    least = [floor_pm] * len(lists)
    kept: list[tuple[np.ndarray, ...] | None] = [None] * len(lists)
    # queries that begin with the same slots follow each other, and share the sums of those
    often = np.bincount(qflat, minlength=slots)
    lists = [sorted(v, key=lambda s: (-often[s], s)) for v in lists]
    turns = sorted(range(len(lists)), key=lists.__getitem__)
    edges = [0, *range(few, len(cid), PART), len(cid)]
    for a, b in zip(edges, edges[1:]):
        n = b - a
        flat = cflat[cends[a] : cends[b]].astype(np.int64)
        counts = np.bincount(flat * n + np.repeat(np.arange(n), np.diff(cends[a : b + 1])), minlength=slots * n).reshape(slots, n)
        top = counts.max(1)
        highest = np.add.reduceat(top[qflat], qends[:-1]).tolist()
        columns, wide = list(counts.astype(np.uint8)), list(counts) if max(highest) > 255 else None
        del counts
        sums, mask, last = [np.empty(n, np.uint8) for _ in range(SHARED)], np.empty(n, bool), []
        sq, where, roots = csq[a:b], code[a:b], np.sqrt(csq[a:b])
        shortest, needs = float(roots.min()), {}
        for i in turns:
            own, bound = lists[i], (least[i] - 0.5) / 1000 * lengths[i]
            if highest[i] < bound * shortest - 1e-6:
                continue
            if highest[i] <= 255:
                step = int(bound * 64)
                if step not in needs:
                    needs[step] = np.minimum(np.ceil(step / 64 * roots - 1e-6), 255).astype(np.uint8)
                d = 0
                while d < SHARED - 1 and d < len(own) and d < len(last) and own[d] == last[d]:
                    d += 1
                dot = sums[d - 1] if d else None
                for j in range(d, len(own)):
                    dot = columns[own[0]] if not j else np.add(dot, columns[own[j]], sums[min(j, SHARED - 1)])
                    if not j:
                        sums[0] = dot
                last = own
                np.greater_equal(dot, needs[step], mask)
            else:
                dot = sum(wide[s] for s in own)
                np.greater_equal(dot, bound * roots - 1e-6, mask)
            if not mask.any():
                continue
            h = np.flatnonzero(mask)
            cos = dot[h] / np.sqrt(qsq[i] * sq[h])
            pm = np.floor(np.minimum(cos, 1) * 1000 + 0.5).astype(np.int32)
            good = pm >= least[i]
            if backed[i]:
                good &= np.isin(where[h], backed[i], invert=True) if len(backed[i]) > 8 else np.logical_and.reduce([where[h] != g for g in backed[i]])
            if ids[i] in same:
                good &= cid[a:b][h] != ids[i]
            if not good.any():
                continue
            new = (pm[good], cos[good], h[good] + a)
            if kept[i] is not None:
                new = tuple(np.concatenate(z) for z in zip(kept[i], new))
            if len(new[0]) > k:
                best = np.lexsort((order[new[2]], -new[0]))[:k]
                new = tuple(z[best] for z in new)
            kept[i] = new
            if len(new[0]) == k:
                least[i] = int(new[0].min())
    at = [i for i, z in enumerate(kept) if z is not None]
    pm, cos, rows = (np.concatenate([kept[i][j] for i in at] or [np.zeros(0, d)]) for j, d in enumerate((np.int32, float, np.int64)))
    who = np.repeat(qid[at], [len(kept[i][0]) for i in at]) if at else np.zeros(0, np.int64)
    return pa.table({"qid": who, "cid": cid[rows], "sim_pm": pm, "cosine": cos, "ord": order[rows]})


def prefix_keys(slots: np.ndarray, counts: np.ndarray, floor: float) -> list[int]:
    """What another vector must share one of to have a cosine of ``floor``: the first three slots that both have, in one order of all slots.

    Where a, b and c are the first they share, the cosine is at most the length of what is left of either from c on with a and b; so only triples whose remainder is that long count.
    Vectors that share fewer are found by pairs and single slots that are that long themselves.
    """
    w = counts.astype(float) ** 2
    w /= w.sum()
    rest = np.cumsum(w[::-1])[::-1]
    least = floor * floor - 1e-9
    n, code = len(slots), (slots + 1).tolist()
    out = []
    for i in range(n):
        if rest[i] < least:
            break
        if w[i] >= least:
            out.append(code[i] << 18)
        for j in range(i + 1, n):
            if w[i] + rest[j] < least:
                break
            if w[i] + w[j] >= least:
                out.append(code[i] << 18 | code[j] << 9)
            for k in range(j + 1, n):
                if w[i] + w[j] + rest[k] < least:
                    break
                out.append(code[i] << 18 | code[j] << 9 | code[k])
    return out


def _ranked_counts(column: pa.Array, rank: np.ndarray) -> np.ndarray:
    """Counts of slots in the order of their ranks, a row for each array."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rank[column.flatten().to_numpy(zero_copy_only=False)]
    out = np.zeros((len(sizes), SLOTS), np.int32)
    np.add.at(out.ravel(), np.repeat(np.arange(len(sizes)) * SLOTS, sizes) + flat, 1)
    return out


def similar(rows: DataFrame, k: int, floor_pm: int) -> DataFrame:
    """qid, cid, sim_pm and rank: the same as ``top_k`` of ``rows`` (id, ord, vec of slots) with themselves above a floor, without comparing all with all.

    Rows of equal vectors are one class with its k + 1 first members. Classes meet where they share one of their ``prefix_keys`` in an inverted index, and a pair counts at the key of
    the first slots it shares, so it is taken once. Rows without slots are similar to none.
    """
    if floor_pm < 1:
        raise ValueError("an index needs a floor")
    own = rows.select(F.col("id").cast("bigint").alias("id"), F.col("ord").cast("bigint").alias("ord"), F.array_sort("vec").alias("vec")).where(F.size("vec") > 0)
    w = Window.partitionBy("vec").orderBy("ord", "id")
    first = own.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)  # a group limit before the shuffle
    classes = settle(first.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("members")).withColumn("cls", F.col("members")[0]["id"]), "vectors")
    # how often each slot occurs: a row for each of them, whatever the number of rows
    often = np.zeros(SLOTS)
    for r in classes.select(F.explode("vec").alias("s")).groupBy("s").count().collect():
        often[r["s"]] = r["count"]
    rank = np.argsort(np.argsort(often, kind="stable"), kind="stable")  # rare slots first
    floor = (floor_pm - 0.5) / 1000

    def keys(batches):
        for b in batches:
            at, out = [], []
            for i, v in enumerate(b.column(1).to_pylist()):
                slots, counts = np.unique(rank[np.array(v)], return_counts=True)
                found = prefix_keys(slots, counts, floor)
                at += [i] * len(found)
                out += found
            at_ = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), b.column(0).take(at_), b.column(1).take(at_)], names=["key", "cls", "vec"])

    def verify(batches):
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                s = b.slice(a, 2048)
                x, y = _ranked_counts(s.column("vx"), rank), _ranked_counts(s.column("vy"), rank)
                both = (x > 0) & (y > 0)
                nth = np.cumsum(both, 1, dtype=np.int16)
                code = [np.where(nth[:, -1] >= i, (nth >= i).argmax(1) + 1, 0) for i in (1, 2, 3)]
                dot, xx, yy = (np.einsum("ij,ij->i", u, v, dtype=np.int64).astype(float) for u, v in ((x, y), (x, x), (y, y)))
                pm = np.floor(np.clip(dot / np.sqrt(xx * yy), 0, 1) * 1000 + 0.5).astype(np.int32)
                good = (pm >= floor_pm) & ((code[0] << 18 | code[1] << 9 | code[2]) == s.column("key").to_numpy())
                yield pa.RecordBatch.from_arrays([s.column("x"), s.column("y"), pa.array(pm)], names=["x", "y", "pm"]).filter(pa.array(good))

    index = settle(classes.select("cls", "vec").mapInArrow(keys, "key int, cls bigint, vec array<int>"), "index")
    left = index.select("key", F.col("cls").alias("x"), F.col("vec").alias("vx"))
    right = index.select("key", F.col("cls").alias("y"), F.col("vec").alias("vy"))
    pairs = left.join(right, "key").where("x < y").mapInArrow(verify, "x bigint, y bigint, pm int")
    both = pairs.select("x", "y", "pm").union(pairs.select(F.col("y"), F.col("x"), "pm"))
    others = both.join(classes.select(F.col("cls").alias("y"), "members"), "y").select(F.col("x").alias("cls"), F.transform("members", lambda m: F.struct((-F.col("pm")).alias("pm"), m["ord"].alias("ord"), m["id"].alias("id"))).alias("l"))
    mine = classes.select("cls", F.transform("members", lambda m: F.struct(F.lit(-1000).alias("pm"), m["ord"].alias("ord"), m["id"].alias("id"))).alias("l"))
    best = others.union(mine).groupBy("cls").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, k + 1).alias("l"))
    listed = classes.select("vec", "cls").join(best, "cls").select("vec", "l")
    without = F.slice(F.filter("l", lambda m: m["id"] != F.col("id")), 1, k)
    return own.join(listed, "vec").select(F.col("id").alias("qid"), F.posexplode(without).alias("rank", "m")).select("qid", F.col("m.id").alias("cid"), (-F.col("m.pm")).alias("sim_pm"), (F.col("rank") + 1).alias("rank"))


def cosine_pm(a: Column | str, b: Column | str) -> Column:
    return per_mille(cosine(a, b))
