"""Problem 9: passages of test items inside documents.

Pigeonhole: a passage of ``least`` words with at most ``budget`` word edits contains, on a grid of pieces of
g = (least + 1) // (budget + 2) words laid over the item, at least budget + 1 whole pieces, one of which is
untouched. Piece hits are exact; around each, Myers' bit-parallel distance - on words as symbols, many candidates at once - tells how
near the best passage there is: the words before the piece and those behind it are matched against the item's as prefixes, and the
cheapest two that make ``least`` words with the piece are its distance. Every reported row comes from that distance; 0 means ``least`` words in a row.

Words are runs of letters or digits of the canonical form (``canonical``) in lower case, tags, entities, comments, link
targets, emphasis and font commands taken out; a note mark or any other word in between stays a word and interrupts. They are compared by 64-bit hashes.

The test set is read and cut on the executors. Where its words are at most ``SHIPPED``, its pieces go to every task as arrays, and documents are read once
without a shuffle; a larger test set meets the documents in a join over piece hashes, each row of which carries the words around it. Both find the same.
Defined results: null and empty texts hold nothing; items with null text or fewer than ``least`` words cannot be held;
an item of which two copies exist under two ids is reported under both; rows with a null id are left out.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomledger.llm import bits
from loomledger.llm.canonical import canonical, looks, suspects, use
from loomledger.tables import settle

LEAST = 10
BUDGET = 1
#: Words of a test set that are broadcast, at 8 bytes each; and parts that a piece's rows are spread over in the join.
SHIPPED = 4_000_000
SALTS = 8
BITMAP = 1 << 27

WORD = re.compile(r"[^\W_]+")
_INLINE = "a|abbr|b|bdi|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|tt|u|var|wbr"
_TAGS = re.compile(rf"<!--.*?-->|(</?(?:{_INLINE})(?:\s[^<>]*)?/?>)|</?[A-Za-z][^<>]*>", re.S)
_TARGETS = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)|\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]|\[https?://\S+ ([^\[\]]*)\]")
_FONTS = re.compile(r"\\(?:emph|text(?:bf|it|tt|sc|sl|rm|sf|up|md)?|underline|mbox|uline|enquote)\s*\{|(?<!\\)%.*\n[ \t]*|\\[,;:! ]|''+")


def _links(m: re.Match[str]) -> str:
    return next((g for g in m.groups() if g is not None), "")


def words(text: str, odd: bool = True) -> list[str]:
    """The words of a text, as they are compared. ``odd``: whether it may hold characters that are not canonical."""
    if "&" in text:
        text = html.unescape(text)
        odd = True
    if odd:
        text = canonical(text) or ""
    if "<" in text:
        text = _TAGS.sub(lambda m: "" if m[1] or m[0].startswith("<!--") else " ", text)
    if "[" in text:
        text = _TARGETS.sub(_links, text)
    if "\\" in text or "''" in text:
        text = _FONTS.sub("", text)
    return WORD.findall(text.lower())


class _Hashes(dict):
    """Each word's 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 2
        return h


def hashed(texts: list[str | None], known: _Hashes) -> list[np.ndarray]:
    """The word hashes of each text; none is 0 or 1, which stand for what lies beyond an item or a text."""
    odd = suspects([t or "" for t in texts])
    return [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in (words(t, bool(o)) if t else [] for t, o in zip(texts, odd, strict=True))]


def keys_of(h: np.ndarray, g: int) -> np.ndarray:
    """A hash of each ``g`` words in a row."""
    n = max(0, len(h) - g + 1)
    k = np.zeros(n, np.uint64)
    for j in range(g):
        k = (k ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(29)
    return k


def around(h: np.ndarray, at: np.ndarray, g: int, before: int, after: int, beyond: int) -> np.ndarray:
    """A row of words for each place: the ``before`` ones before it, the piece, and the ``after`` ones behind it."""
    padded = np.concatenate([np.full(before, beyond, np.uint64), h, np.full(after + g, beyond, np.uint64)])
    return padded[at[:, None] + np.arange(before + g + after)]


def myers(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For many pairs at once, and each r from 0 to the patterns' length: the least edit distance of a pattern's first r symbols to any prefix of its text.

    Myers' recurrence: a column of the table is two bit vectors of its steps up and down, of one word a pair.
    """
    n, m = patterns.shape
    full = np.uint64((1 << m) - 1)
    one = np.uint64(1)
    bits = one << np.arange(m, dtype=np.uint64)
    plus, minus = np.full(n, full), np.zeros(n, np.uint64)
    best = np.tile(np.arange(m + 1), (n, 1))
    for column in range(texts.shape[1]):
        eq = ((patterns == texts[:, column, None]) * bits).sum(1, dtype=np.uint64)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        up, down = ((up << one) | one) & full, (down << one) & full  # anchored: the text's start is not free
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        steps = ((plus[:, None] & bits) != 0).astype(np.int64) - ((minus[:, None] & bits) != 0)
        np.minimum(best[:, 1:], column + 1 + np.cumsum(steps, 1), out=best[:, 1:])
    return best


class Shape:
    """Lengths that follow from passages of ``least`` words with up to ``budget`` edits."""

    def __init__(self, least: int, budget: int):
        self.least, self.budget = least, budget
        self.g = (least + 1) // (budget + 2)
        if self.g < 1:
            raise ValueError("the budget is too large for such short passages")
        self.reach = least - self.g
        if self.reach > 63:
            raise ValueError("passages of so many words do not fit a machine word")
        self.slack = self.reach + budget

    def of_items(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return around(h, at, self.g, self.reach, self.reach, 0)

    def of_texts(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return around(h, at, self.g, self.slack, self.slack, 1)

    def distances(self, items: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Of each pair of rows of ``of_items`` and ``of_texts``: the distance of the nearest passage over the piece; more than ``budget`` where none is."""
        r, g = self.reach, self.g
        same = (items[:, r : r + g] == texts[:, self.slack : self.slack + g]).all(1)
        right, left = items[:, r + g :], items[:, :r][:, ::-1]
        total = myers(right, texts[:, self.slack + g :])[:, : r + 1] + myers(left, texts[:, : self.slack][:, ::-1])[:, r::-1]
        # a passage ends where its item does
        rights, lefts = (right != 0).sum(1), (left != 0).sum(1)
        k = np.arange(r + 1)
        total = np.where((k <= rights[:, None]) & (r - k <= lefts[:, None]), total, self.least)
        return np.where(same, total.min(1), self.least)


def _cut_items(items: DataFrame, shape: Shape) -> DataFrame:
    """item_id, hash and the words around it of each piece of the grid of each item."""
    kind = items.schema["item_id"].dataType
    tables = items.sparkSession.sparkContext.broadcast(looks())

    def run(batches):
        use(tables.value)
        known = _Hashes()
        for b in batches:
            at, keys, rows = [], [], []
            for i, h in enumerate(hashed(b.column("text").to_pylist(), known)):
                if len(h) >= shape.least:
                    grid = np.arange(0, len(h) - shape.g + 1, shape.g)
                    at.append(np.full(len(grid), i))
                    keys.append(keys_of(h, shape.g)[grid])
                    rows.append(shape.of_items(h, grid))
            if at:
                width = rows[0].shape[1]
                own = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(rows).ravel().view(np.int64)), width).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(keys).view(np.int64)), own], names=["item_id", "key", "own"])

    return items.select("item_id", "text").where("item_id is not null and text is not null").mapInArrow(run, f"item_id {kind.simpleString()}, key bigint, own array<bigint>")


def _table(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)


class Pieces:
    """The pieces of a test set in the order of their hashes."""

    def __init__(self, keys: np.ndarray, items: pa.Array, own: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.items, self.own = keys[order], items.take(pa.array(order)), own[order]

    def find(self, texts: list[np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, piece, distance) of all passages within the budget, candidates of all texts at once."""
        joined = np.concatenate([x for h in texts for x in (h, np.ones(shape.slack, np.uint64))] or [np.zeros(0, np.uint64)])
        k = keys_of(joined, shape.g)
        first = np.searchsorted(self.keys, k, "left")
        hit = np.nonzero((first < len(self.keys)) & (self.keys[np.minimum(first, len(self.keys) - 1)] == k))[0] if len(self.keys) else np.zeros(0, np.int64)
        many = np.searchsorted(self.keys, k[hit], "right") - first[hit]
        place = np.repeat(hit, many)
        piece = np.repeat(first[hit], many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
        ends = np.cumsum([len(h) + shape.slack for h in texts])
        text = np.searchsorted(ends, place, "right")
        out = []
        for a in range(0, len(place), 20_000):
            p, q = place[a : a + 20_000], piece[a : a + 20_000]
            d = shape.distances(self.own[q], shape.of_texts(joined, p))
            good = d <= shape.budget
            out.append((text[a : a + 20_000][good], q[good], d[good]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST, budget: int = BUDGET, shipped: int = SHIPPED) -> DataFrame:
    """doc_id, item_id and distance: the nearest passage of ``least`` words of the item lies in the document with so many word edits.

    ``items``: item_id and text.
    """
    shape = Shape(least, budget)
    pieces = settle(_cut_items(items, shape), "p9-pieces")
    key, kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType
    rows = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    width = shape.g + 2 * shape.reach
    tables = docs.sparkSession.sparkContext.broadcast(looks())
    if pieces.count() * width <= shipped:
        t = pieces.toArrow().combine_chunks()  # within ``shipped`` words
        item_type = to_arrow_type(kind)
        all_items = t.column("item_id").combine_chunks() if t.num_rows else pa.array([], item_type)
        own = docs.sparkSession.sparkContext.broadcast(Pieces(t.column("key").to_numpy().view(np.uint64) if t.num_rows else np.zeros(0, np.uint64), all_items, _table(t.column("own"), width) if t.num_rows else np.zeros((0, width), np.uint64)))

        def run(batches):
            use(tables.value)
            known, index = _Hashes(), own.value
            for b in batches:
                for a in range(0, b.num_rows, 500):
                    s = b.slice(a, 500)
                    text, piece, d = index.find(hashed(s.column("text").to_pylist(), known), shape)
                    yield pa.RecordBatch.from_arrays([s.column("doc_id").take(pa.array(text)), index.items.take(pa.array(piece)).cast(item_type), pa.array(d, pa.int32())], names=["doc_id", "item_id", "distance"])

        found = rows.mapInArrow(run, f"doc_id {key}, item_id {kind.simpleString()}, distance int")
    else:
        found = _joined(rows, pieces, shape, key, kind.simpleString())
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _joined(rows: DataFrame, pieces: DataFrame, shape: Shape, key: str, kind: str) -> DataFrame:
    """The same by a join over piece hashes; a piece that very many documents hold is spread over ``SALTS`` parts.

    A bitmap of the hashes, of ``BITMAP`` bits whatever the test set, keeps most words of the documents out of the shuffle.
    """
    wanted = bits.bitmap(pieces, "key", BITMAP)
    tables = rows.sparkSession.sparkContext.broadcast(looks())

    def cut(batches):
        use(tables.value)
        known, salt = _Hashes(), 0
        for b in batches:
            for a in range(0, b.num_rows, 200):
                s = b.slice(a, 200)
                for i, h in enumerate(hashed(s.column("text").to_pylist(), known)):
                    k = keys_of(h, shape.g)
                    at = np.nonzero(bits.has(wanted, BITMAP, k))[0]
                    if len(at):
                        k, ctx = k[at], shape.of_texts(h, at)
                        salt += 1
                        yield pa.RecordBatch.from_arrays([s.column("doc_id").take(pa.array(np.full(len(k), i))), pa.array(k.view(np.int64)), pa.array((np.arange(len(k)) + salt) % SALTS, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(ctx.ravel().view(np.int64)), ctx.shape[1]).cast(pa.list_(pa.int64()))], names=["doc_id", "key", "salt", "words"])

    def verify(batches):
        for b in batches:
            if b.num_rows:
                d = shape.distances(_table(b.column("own"), shape.g + 2 * shape.reach), _table(b.column("words"), shape.g + 2 * shape.slack))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("item_id"), pa.array(d, pa.int32())], names=["doc_id", "item_id", "distance"]).filter(pa.array(d <= shape.budget))

    parts = rows.mapInArrow(cut, f"doc_id {key}, key bigint, salt int, words array<bigint>")
    spread = pieces.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return parts.join(spread, ["key", "salt"]).select("doc_id", "item_id", "words", "own").mapInArrow(verify, f"doc_id {key}, item_id {kind}, distance int")
