"""Problem 3: filling planned chunks with pieces by minimum bin slack.

Lengths are whole words (a piece lasts words * 60 / 150 seconds), a chunk holds floor(max_chunk_secs * 150 / 60) words.
Of each script only the histogram of lengths travels to one task - at most as many rows as a chunk has words. There a
bitset subset-sum picks, beside the longest remaining length, the multiset of remaining lengths that fills the chunk best;
it is used as often as the counts allow, and what is left is packed on. The pieces then find their chunk by their rank
among those of the same length, counted in salted parts, so that one script may hold any share of all rows.

A piece longer than a chunk is divided at words into full chunks and a rest. Defined results: an empty, null or unreadable slice counts as one
word; a script without a known backend gets the smallest limit of all backends; a piece whose script is unknown is left out;
repeated deliveries count once (the latest).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomledger.tables import latest, settle

WORDS_A_MINUTE = 150
#: Parts that the pieces of one length of a script are ranked in: so many at least, and one for each so many rows.
SALTS, SALT_ROWS = 32, 500_000
_WORD = re.compile(rb"[^\s]+")


def word_ends(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the words between Unicode white space."""
    text = raw.decode("utf-8", "replace")
    if text.isascii():
        return [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for m in re.finditer(r"\S+", text):
        first = at + len(text[out[-1][2] if out else 0 : m.start()].encode("utf-8", "replace"))
        at = first + len(m[0].encode("utf-8", "replace"))
        out.append((first, at, m.end()))
    return [(a, b) for a, b, _ in out]


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (with counts) whose sum is the greatest that is at most ``room``; long lengths first."""
    steps: list[tuple[int, int, int]] = []
    reach, mask = 1, (1 << (room + 1)) - 1
    for length in sorted(counts):
        left, k = min(counts[length], room // length) if length else 0, 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left -= take
            k *= 2
    at = reach.bit_length() - 1
    got: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if at >= take * length and before >> (at - take * length) & 1:
            got[length] = got.get(length, 0) + take
            at -= take * length
    return got


def pack(histogram: Iterable[tuple[int, int]], room: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with counts, how many chunks of this kind) until all is packed."""
    left = {length: n for length, n in histogram if n > 0}
    plan = []
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if v - (k == longest) > 0}
        kind = fill(rest, room - longest)
        kind[longest] = kind.get(longest, 0) + 1
        times = min(left[k] // n for k, n in kind.items())
        plan.append((kind, times))
        for k, n in kind.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def parts(pieces: DataFrame, turns: DataFrame, scripts: DataFrame, backends: DataFrame) -> DataFrame:
    """Every piece, divided where it alone is too long: script_id, piece_id, part, turn, beat, start, stop, words, room."""
    p = latest(pieces.select("piece_id", "script_id", "turn", "beat", F.col("text.start").alias("start"), F.col("text.stop").alias("stop"), "ingested_at"), "piece_id").drop("ingested_at")
    t = latest(turns.select("script_id", "turn", "ingested_at", "text"), ["script_id", "turn"]).drop("ingested_at")
    rooms = backends.groupBy("backend").agg(F.max("max_chunk_secs").alias("secs"))
    least = backends.agg(F.min("max_chunk_secs").alias("least"))
    limit = scripts.select("script_id", "backend").join(rooms, "backend", "left").crossJoin(F.broadcast(least)).groupBy("script_id").agg(F.min(F.coalesce("secs", "least")).alias("secs"))  # one row against all
    room = limit.select("script_id", F.greatest(F.lit(1), F.floor(F.col("secs") * WORDS_A_MINUTE / 60)).cast("int").alias("room"))
    sliced = F.encode("text", "utf-8").substr(F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    rows = p.join(t, ["script_id", "turn"], "left").select("script_id", "piece_id", "turn", "beat", "start", "stop", sliced.alias("raw")).join(room, "script_id")

    def run(batches):
        for b in batches:
            at, part, first, last, size = [], [], [], [], []
            for row, (raw, start, stop, room) in enumerate(zip(*(b.column(c).to_pylist() for c in ("raw", "start", "stop", "room")), strict=True)):
                w = word_ends(raw) if raw else []
                n = max(1, -(-len(w) // room))
                for k in range(n):
                    own = w[k * room : (k + 1) * room]
                    at.append(row)
                    part.append(k)
                    first.append(start if k == 0 else start + own[0][0])
                    last.append(stop if k == n - 1 else start + w[(k + 1) * room][0])
                    size.append(max(1, len(own)))
            rows_ = pa.array(at, pa.int64())
            same = {c: b.column(c).take(rows_) for c in ("script_id", "piece_id", "turn", "beat", "room")}
            yield pa.RecordBatch.from_arrays([same["script_id"], same["piece_id"], pa.array(part, pa.int32()), same["turn"], same["beat"], pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(size, pa.int32()), same["room"]], names=["script_id", "piece_id", "part", "turn", "beat", "start", "stop", "words", "room"])

    return rows.mapInArrow(run, "script_id bigint, piece_id bigint, part int, turn int, beat int, start bigint, stop bigint, words int, room int")


def _plan(table: pa.Table) -> pa.Table:
    script, room = table.column("script_id")[0].as_py(), table.column("room")[0].as_py()
    rank: dict[int, int] = {}
    chunk, rows = 0, []
    for kind, times in pack(zip(table.column("words").to_pylist(), table.column("n").to_pylist(), strict=True), room):
        for length, take in kind.items():
            rows.append((script, length, rank.get(length, 0), take, times, chunk))
            rank[length] = rank.get(length, 0) + take * times
        chunk += times
    cols = list(zip(*rows, strict=True))
    names = ["script_id", "words", "first", "take", "times", "chunk"]
    return pa.table({n: pa.array(c, pa.int32() if n in ("words", "take") else pa.int64()) for n, c in zip(names, cols, strict=True)})


def assign(rows: DataFrame) -> DataFrame:
    """``rows`` (as of ``parts``) with chunk_no."""
    rows = settle(rows, "p3-parts")
    salts = max(SALTS, -(-rows.count() // SALT_ROWS))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("piece_id", "part"), F.lit(salts)))
    counts = rows.groupBy("script_id", "room", "words", "salt").agg(F.count("*").alias("n"))
    plan = counts.groupBy("script_id", "room", "words").agg(F.sum("n").alias("n")).groupBy("script_id").applyInArrow(_plan, "script_id bigint, words int, first bigint, take int, times bigint, chunk bigint")
    kinds = plan.groupBy("script_id", "words").agg(F.collect_list(F.struct("first", "take", "times", "chunk")).alias("kinds"))
    before = counts.select("script_id", "words", "salt", (F.sum("n").over(Window.partitionBy("script_id", "words").orderBy("salt")) - F.col("n")).alias("before"))
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy("script_id", "words", "salt").orderBy("piece_id", "part")) - 1)
    ranked = local.join(before, ["script_id", "words", "salt"]).join(kinds, ["script_id", "words"]).withColumn("rank", F.col("_r") + F.col("before"))
    mine = F.filter("kinds", lambda k: (F.col("rank") >= k["first"]) & (F.col("rank") < k["first"] + k["take"] * k["times"]))[0]
    return ranked.withColumn("_k", mine).withColumn("chunk_no", F.floor(F.col("_k.chunk") + (F.col("rank") - F.col("_k.first")) / F.col("_k.take")).cast("bigint")).select(
        "script_id", "chunk_no", "piece_id", "part", "turn", "beat", "start", "stop", "words", "room"
    )


def chunks(assigned: DataFrame) -> DataFrame:
    """The planned chunks; the pieces of each, of which there are at most as many as it holds words, in the order of the script."""
    piece = F.struct("turn", "beat", "start", "stop", "piece_id", "part")
    out = assigned.groupBy("script_id", "chunk_no").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("words").cast("int").alias("words"), F.max("room").alias("room"))
    own = F.transform("p", lambda x: F.struct(x["turn"].alias("turn"), x["beat"].alias("beat"), F.struct(x["start"].alias("start"), x["stop"].alias("stop")).alias("text"), x["piece_id"].alias("piece_id"), x["part"].alias("part")))
    return out.select("script_id", "chunk_no", own.alias("pieces"), "words", "room", (F.col("words") * 60.0 / WORDS_A_MINUTE).alias("secs"))
