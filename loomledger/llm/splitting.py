"""Problem 7: cutting oversized chunks at natural boundaries by recursive bisection.

A range longer than allowed is cut at the strongest boundary near its midpoint and both halves are
treated alike; afterwards every piece but the first is extended to the left by the overlap.

Defined results: a null or empty text is one piece as it is; a text within the limit is one piece;
a text without any boundary is cut at the midpoint, never between a character and its marks.
Repeated deliveries of a chunk count once (the latest). Columns that are not named below are dropped.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.operators.windows import byte_places
from loomledger.tables import latest

LIMIT = 2400
OVERLAP = 200

#: What a text pauses at, the strongest first: before a heading, blank line, line end, sentence end, clause, white space.
_BOUNDARY = re.compile(
    r"(?P<s6>\n\s*(?=#{1,6} |={2,} ?\S|\\(?:sub)*section|<h[1-6]))|(?P<s5>\n[^\S\n]*\n\s*)|(?P<s4>\n\s*)"
    r"|(?P<s3>[.!?…।]+[\"'”’»)\]]*\s+|[。！？]+[」』”’）]*)|(?P<s2>[,;:–—]\s+|[，；、：])|(?P<s1>\s+)"
)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """The ends of all pieces but the last, before overlaps are attached."""
    if len(text) <= limit:
        return []
    places: list[int] = []
    strength: list[int] = []
    for m in _BOUNDARY.finditer(text):
        places.append(m.end())
        strength.append(int(m.lastgroup[1]))  # type: ignore[index]
    found: list[int] = []
    todo = [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= (limit - overlap if lo else limit):
            continue
        mid, cut = (lo + hi) // 2, 0
        for reach in ((hi - lo) // 6, (hi - lo) // 3, (hi - lo) // 2):
            a, b = bisect_right(places, max(lo, mid - reach)), bisect_left(places, min(hi, mid + reach))
            if a < b:
                cut = places[max(range(a, b), key=lambda k: (strength[k], -abs(places[k] - mid)))]
                break
        if not cut:
            cut = mid
            while cut > lo + 1 and (unicodedata.combining(text[cut]) or unicodedata.category(text[cut])[0] == "M" or text[cut] == "‍" or text[cut - 1] == "‍"):
                cut -= 1
            cut = cut if cut > lo + 1 else mid
        found.append(cut)
        todo += [(lo, cut), (cut, hi)]
    return sorted(found)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, stop, length of the overlap) of each piece, in characters."""
    ends = [*cuts(text, limit, overlap), len(text)]
    out, begin = [], 0
    for k, end in enumerate(ends):
        first = begin
        if k:
            first = max(out[-1][0], begin - overlap)
            if m := re.search(r"\s\S", text[max(0, first - 1) : begin]):  # begin the overlap at a word
                at = max(0, first - 1) + m.end() - 1
                first = at if at < begin else first
            while first < begin and unicodedata.category(text[first])[0] == "M":
                first += 1
        out.append((first, end, begin - first))
        begin = end
    return out


_OUT = "chunk_id string, piece_ix int, n_pieces int, heading_path array<string>, span struct<start:bigint,stop:bigint>, text string, overlap int"


def split_rows(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each row of ``chunks`` (chunk_id, heading_path, span, text), without a shuffle."""

    def run(batches):
        for b in batches:
            at, ix, many, first, last, own, over = [], [], [], [], [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                cut = pieces(text, limit, overlap) if text else [(0, 0, 0)]
                places = byte_places(text) if text else [0]
                for k, (x, y, o) in enumerate(cut):
                    at.append(row)
                    ix.append(k)
                    many.append(len(cut))
                    first.append(int(places[x]))
                    last.append(int(places[y]))
                    own.append(text[x:y] if text else text)
                    over.append(o)
            rows = pa.array(at, pa.int64())
            begin = pa.compute.struct_field(b.column("span"), "start").take(rows)
            start, stop = (pa.compute.add(begin, pa.array(x, pa.int64())) for x in (first, last))
            span = pa.StructArray.from_arrays([start, stop], names=["start", "stop"], mask=begin.is_null())
            yield pa.RecordBatch.from_arrays([b.column("chunk_id").take(rows), pa.array(ix, pa.int32()), pa.array(many, pa.int32()), b.column("heading_path").take(rows), span, pa.array(own, pa.string()), pa.array(over, pa.int32())], names=["chunk_id", "piece_ix", "n_pieces", "heading_path", "span", "text", "overlap"])

    return chunks.select("chunk_id", "heading_path", "span", "text").mapInArrow(run, _OUT)


def split(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All pieces of all chunks, repeated deliveries settled first."""
    return split_rows(latest(chunks.select("chunk_id", "ingested_at", "heading_path", "span", "text"), "chunk_id"), limit, overlap)


def oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The ids of the chunks that the splitter cuts; only texts over the limit are shuffled."""
    last = latest(chunks.select("chunk_id", "ingested_at"), "chunk_id").withColumnRenamed("ingested_at", "_at")
    long = chunks.where(F.char_length("text") > limit).select("chunk_id", "ingested_at", "heading_path", "span", "text")
    own = long.join(last, "chunk_id").where(F.col("ingested_at").eqNullSafe(F.col("_at")))
    return split_rows(own, limit, overlap).where("n_pieces > 1").select("chunk_id").distinct()
