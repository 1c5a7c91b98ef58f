"""Premise windows: runs of one or two sentences of a chunk, and slices of overlong ones."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomledger.config import DEFAULT, Settings
from loomledger.functions.text import WS


def sentence_spans(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, sent_ix, sentence and its byte places (start, stop) in the text; one Arrow pass without a shuffle. Null and blank texts have none."""
    kind = rows.schema[key].dataType.simpleString()
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        for b in batches:
            at, out = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                places = byte_places(t)
                for i, words in enumerate(sentence_words(t)):
                    a, z = words[0][0], words[-1][1]
                    at.append(k)
                    out.append((i, t[a:z], int(places[a]), int(places[z])))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, ty) for c, ty in zip(cols, types, strict=True)]], names=[key, "sent_ix", "sentence", "start", "stop"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, sent_ix int, sentence string, start bigint, stop bigint")


def slice_places(n_words: int, size: int) -> list[int]:
    """From which words the slices of a sentence of ``n_words`` begin: every half slice, the last one pinned to the end."""
    last = max(0, n_words - size)
    return [*range(0, last, size // 2), last]


_CLASS = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WS)
_END = re.compile(rf"(?<=[.!?])(?={_CLASS}|\Z)")
_WORD = re.compile(_CLASS.replace("[", "[^", 1) + "+")


def sentence_words(text: str) -> list[list[tuple[int, int]]]:
    """The places of the words of each sentence that has any."""
    sents, at = [], 0
    for piece in _END.split(text):
        words = [(m.start() + at, m.end() + at) for m in _WORD.finditer(piece)]
        if words:
            sents.append(words)
        at += len(piece)
    return sents


def premises(text: str, settings: Settings = DEFAULT) -> list[tuple[int, int, int, str, int, int, bool]]:
    """(first sentence, number of sentences, slice, premise, start, stop, whole) of every window of a text; places in characters."""
    sents = sentence_words(text)
    out = []
    for i, own in enumerate(sents):
        for n in range(1, settings.window_sentences + 1):
            if i + n > len(sents):
                break
            words = own if n == 1 else [w for s in sents[i : i + n] for w in s]
            if len(words) <= settings.window_words:
                out.append((i, n, 0, text[words[0][0] : words[-1][1]], words[0][0], words[-1][1], True))
            elif n == 1:
                for k, s in enumerate(slice_places(len(words), settings.window_words)):
                    a, z = words[s][0], words[s + settings.window_words - 1][1]
                    out.append((i, n, k, text[a:z], a, z, False))
    return out


def byte_places(text: str) -> np.ndarray:
    """The byte at which each character begins, and the length, in UTF-8."""
    if text.isascii():
        return np.arange(len(text) + 1)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])


def windows(chunks: DataFrame, key: str = "chunk_id", text: str = "text", settings: Settings = DEFAULT) -> DataFrame:
    """key, first (sentence), n_sents, slice, premise, its byte places in the chunk's text, and whether it is whole (no slice).

    Runs of up to ``window_sentences`` sentences of at most ``window_words`` words; a single longer sentence becomes slices of that many words,
    each beginning half a slice after the one before. A window lies in one row, so one Arrow pass makes them without a shuffle.
    Null and blank texts have no window.
    """
    kind = chunks.schema[key].dataType.simpleString()
    names = ["first", "n_sents", "slice", "premise", "start", "stop", "whole"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches):
        for b in batches:
            at, rows = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                places = byte_places(t)
                for first, n, s, premise, a, z, whole in premises(t, settings):
                    rows.append((first, n, s, premise, int(places[a]), int(places[z]), whole))
                    at.append(k)
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[key, *names])

    return chunks.select(key, text).mapInArrow(run, f"`{key}` {kind}, first int, n_sents int, slice int, premise string, start bigint, stop bigint, whole boolean")
