"""Documents made ready: normalised, deduplicated within their group, cut into byte-addressed chunks under their headings."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomledger.config import DEFAULT
from loomledger.functions.ids import content_id
from loomledger.functions.text import normalise_text


def dedup_within_group(docs: DataFrame, group: str | Column, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The first document (by ``order``) of each pair of group and normalised text; the text is replaced by its normal form.

    Null groups are one group, rows with null text are dropped. The text itself is not shuffled: the winners are found by its
    digest with a map-side minimum, so one group may hold any share of the rows.
    """
    g = F.col(group) if isinstance(group, str) else group
    rows = docs.where(F.col(text).isNotNull()).withColumn(text, normalise_text(text)).withColumn("_g", g).withColumn("_h", F.sha2(text, 256))
    first = rows.groupBy("_g", "_h").agg(F.min(order).alias("_first")).select("_first")
    return rows.join(first, F.col(order) == F.col("_first"), "left_semi").drop("_g", "_h")


_HEADING = re.compile(rb"(#{1,6}) (.*)", re.S)


def cut(raw: bytes, max_words: int = DEFAULT.chunk_words) -> list[tuple[int, int, list[str]]]:
    """(start, stop, headings above) of each chunk of a text in UTF-8 bytes.

    A heading line ends the chunk before it and takes the place of all headings of its level or below; it is not text. A blank line ends a
    chunk of ``max_words`` or more. Inside a fence, which only its own mark closes, headings are text.
    """
    out: list[tuple[int, int, list[str]]] = []
    above: dict[int, str] = {}
    start, stop, words, at, fence = -1, 0, 0, 0, b""
    for line in raw.splitlines(keepends=True) if b"\r" not in raw else re.findall(rb"[^\n]*\n|[^\n]+", raw):
        begin, at = at, at + len(line)
        text = line.decode("utf-8", "replace")
        body = text.rstrip()
        mark = body.lstrip()[:3]
        if mark in ("```", "~~~"):
            fence = mark.encode() if not fence else b"" if fence == mark.encode() else fence
        head = None if fence else _HEADING.fullmatch(body.encode())
        if (head or not body.strip() and words >= max_words) and start >= 0:
            out.append((start, stop, [above[k] for k in sorted(above)]))
            start, words = -1, 0
        if head:
            level = len(head[1])
            above = {k: v for k, v in above.items() if k < level} | {level: head[2].decode().strip()}
        elif body.strip():
            if start < 0:
                start = begin + len(body.encode()) - len(body.lstrip().encode())
            stop = begin + len(body.encode())
            words += len(body.split())
    if start >= 0:
        out.append((start, stop, [above[k] for k in sorted(above)]))
    return out


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", max_words: int = DEFAULT.chunk_words) -> DataFrame:
    """key, chunk_ix, span, heading_path and text of the chunks of every document, in one pass without a shuffle.

    Null, empty and blank texts have no chunk.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, chunk_ix int, span struct<start:bigint,stop:bigint>, heading_path array<string>, text string"
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches):
        for b in batches:
            at, ix, spans, paths, texts = [], [], [], [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                raw = (t or "").encode()
                for k, (x, y, path) in enumerate(cut(raw, max_words)):
                    at.append(row)
                    ix.append(k)
                    spans.append({"start": x, "stop": y})
                    paths.append(path)
                    texts.append(raw[x:y].decode())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(ix, pa.int32()), pa.array(spans, span), pa.array(paths, pa.list_(pa.string())), pa.array(texts, pa.string())], names=[key, "chunk_ix", "span", "heading_path", "text"])

    return docs.select(key, text).mapInArrow(run, schema)


def chunk_id(doc: str | Column, start: Column, stop: Column) -> Column:
    """The id of a chunk: document id and byte places."""
    return content_id(F.col(doc) if isinstance(doc, str) else doc, start, stop)


def document_id(connector: Column, locator: Column, text: Column) -> Column:
    return content_id(connector, locator, text)


def source_id(connector: Column, locator: Column) -> Column:
    return content_id(connector, locator)


def shared_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids that documents of different sources share, with the number of sources."""
    source = F.struct(F.coalesce("source_ref.connector", F.lit("")), F.coalesce("source_ref.locator", F.lit("")), F.coalesce("source_ref.independence_group", F.lit("")))
    return docs.groupBy(key).agg(F.count_distinct(source).alias("n_sources")).where("n_sources > 1")
