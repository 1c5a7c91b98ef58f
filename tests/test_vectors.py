import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomledger.operators import vectors


def brute(q, c, k, floor):
    out = set()
    for qi, qv, qg in q:
        scored = []
        for ci, cv, cg in c:
            if ci == qi or cg in qg:
                continue
            pm = int(np.floor(max(0, np.dot(qv, cv) / np.linalg.norm(qv) / np.linalg.norm(cv)) * 1000 + 0.5))
            if pm >= floor:
                scored.append((-pm, ci))
        out |= {(qi, ci, r + 1) for r, (_, ci) in enumerate(sorted(scored)[:k])}
    return out


def test_top_k_against_brute_force_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(60, 6)), 1)
    v[10] = v[11] = v[12]
    rows = [(i, [float(x) for x in v[i]], f"g{i % 3}") for i in range(60)]
    corpus = spark.createDataFrame(rows, "id long, vec array<double>, grp string").withColumn("ord", F.col("id"))
    queries = spark.createDataFrame([(i, vec, [g]) for i, vec, g in rows[:25]], "id long, vec array<double>, grp array<string>")
    want = brute([(i, v[i], [f"g{i % 3}"]) for i in range(25)], [(i, v[i], f"g{i % 3}") for i in range(60)], 4, 100)
    for block, rows_ in ((4096, 1 << 16), (7, 1 << 16), (7, 13)):
        got = vectors.top_k(queries, corpus, 4, 100, slots=None, block=block, corpus_block=rows_).collect()
        assert {(r.qid, r.cid, r["rank"]) for r in got} == want
    assert vectors.top_k(queries.limit(0), corpus, 4, slots=None).count() == 0


def test_similar_equals_top_k(spark):
    r = random.Random(5)
    rows = [(i, (i * 7) % 300, [r.choice((3, 8, 9, 20, 21, 22, 40, 41, 90, 91, 200, 255)) for _ in range(r.choice((1, 2, 3, 5, 8)))]) for i in range(300)]
    rows += [(300 + i, 400 + i % 5, [1, 2, 2, 5]) for i in range(60)] + [(500, 0, []), (501, 0, None)]  # many of one vector, with ties
    df = spark.createDataFrame(rows, "id long, ord long, vec array<int>").repartition(3)
    for floor in (300, 800, 950):
        got = {(x.qid, x["rank"], x.sim_pm) for x in vectors.similar(df, 8, floor).collect()}
        every = vectors.top_k(df.select("id", "vec", F.array().cast("array<string>").alias("grp")), df.withColumn("grp", F.lit(None).cast("string")), 8, floor)
        assert got == {(x.qid, x["rank"], x.sim_pm) for x in every.collect()} and len(got) > 400
    unique = df.withColumn("ord", F.col("id"))
    got = {(x.qid, x.cid, x["rank"]) for x in vectors.similar(unique, 8, 800).collect()}
    every = vectors.top_k(unique.select("id", "vec", F.array().cast("array<string>").alias("grp")), unique.withColumn("grp", F.lit(None).cast("string")), 8, 800)
    assert got == {(x.qid, x.cid, x["rank"]) for x in every.collect()}
    assert vectors.similar(df.limit(0), 8, 800).count() == 0


def _counted_rows(n, seed):
    r = random.Random(seed)
    rows = [(i, [min(255, int(r.expovariate(1 / 40))) for _ in range(r.choice((1, 2, 5, 9, 12, 30)))]) for i in range(n)]
    return rows + [(n, []), (n + 1, None), (n + 2, [7] * 300 + [8]), (n + 3, [7, 9])] + [(n + 4 + i, [1, 2, 2, 5]) for i in range(30)]


def test_many_counts_equal_the_broadcast(spark):
    """Also with ties, empty and null slots, counts that no byte holds, own and null groups."""
    q = spark.createDataFrame([(i, v, [None, ["g1"], ["g0", "g2", None], []][i % 4]) for i, v in _counted_rows(230, 1)], "id long, vec array<int>, grp array<string>")
    c = spark.createDataFrame([(10_000 + i if i % 9 else i, i % 50, v, [None, "g0", "g1", "g2", "other"][i % 5]) for i, v in _counted_rows(900, 2)], "id long, ord long, vec array<int>, grp string").repartition(3)
    for k, floor in ((4, 300), (1, 1), (9, 900)):
        want, got = ({(r.qid, r["rank"], r.sim_pm, r.cosine) for r in vectors.top_k(q, c, k, floor, block=b).collect()} for b in (4096, 50))
        assert got == want and len(got) > 200
    unique = c.withColumn("ord", F.col("id"))
    want, got = ({(r.qid, r.cid, r["rank"]) for r in vectors.top_k(q, unique, 4, 300, block=b).collect()} for b in (4096, 50))
    assert got == want
    assert vectors.top_k(q, c.limit(0), 4, 300, block=50).count() == 0


def test_many_counts_in_parts_cost_less_than_a_product(monkeypatch):
    def sides(n, seed, ids):
        rng = np.random.default_rng(seed)
        vec = [bytes((rng.random(rng.integers(8, 15)) ** 2 * 255).astype(np.uint8)) for _ in range(n)]
        m = np.array([np.bincount(np.frombuffer(v, np.uint8), minlength=256) for v in vec], float)
        return m, pa.table({"id": pa.array(np.arange(n) + ids), "ord": pa.array(np.arange(n)), "vec": vec, "sq": pa.array((m * m).sum(1).astype(np.int64))})

    (qm, x), (cm, y) = sides(3000, 1, 0), sides(30_000, 2, 10**6)
    x, y = x.append_column("grp", pa.nulls(3000, pa.list_(pa.string()))), y.append_column("grp", pa.nulls(30_000, pa.string()))
    began = time.process_time()
    found = vectors._best_counted(x, y, 4, 300, 256)
    took = time.process_time() - began
    began = time.process_time()
    cos = (qm @ cm.T) / np.sqrt(np.outer((qm * qm).sum(1), (cm * cm).sum(1)))
    pm = np.floor(cos * 1000 + 0.5).astype(np.int32)
    assert took < (time.process_time() - began)
    best = [tuple(-np.sort(-row)[:4]) for row in pm]
    for part in (1 << 15, 1000):
        monkeypatch.setattr(vectors, "PART", part)
        got = found if part == 1 << 15 else vectors._best_counted(x, y, 4, 300, 256)
        of = {}
        for i, s in zip(got["qid"].to_pylist(), got["sim_pm"].to_pylist()):
            of.setdefault(i, []).append(s)
        assert [tuple(sorted(of[i], reverse=True)) for i in range(3000)] == best


def test_slots_and_cosines(spark):
    df = spark.createDataFrame([("river mill fire", "mill river"), ("river", "tower"), ("", "x"), (None, "mill")], "a string, b string")
    rows = df.select(vectors.cosine_of_slots(vectors.slots_of("a"), vectors.slots_of("b")).alias("x"), vectors.pair_cosine(vectors.slots_of("a"), vectors.slots_of("b")).alias("y")).collect()
    assert abs(rows[0].x - 2 / 6**0.5) < 1e-12 and all(abs((r.x or 0) - r.y) < 1e-12 for r in rows)
    e = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in e.select(vectors.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0]
    u = spark.createDataFrame([([1.0],), ([],), (None,), ([float("nan")],), ([float("inf")],), ([None],)], "v array<double>")
    assert [r[0] for r in u.select(vectors.usable("v")).collect()] == [True, False, False, False, False, False]
