"""Problem 8: token ids of the whole corpus by a public byte-level BPE.

Every text is taken in overlapping chunks of ``CHUNK`` characters. Each chunk is pre-tokenised on its own; two neighbours are
stitched at the first pre-token boundary of their overlap on which both agree, from where on their
boundaries are the same, and the text between two stitches is encoded as a piece. Two chunks that agree on no boundary (a pre-token
longer than the overlap) become one, and as long as that goes on each union is twice as long, so the work stays linear. The chunks of all texts of a batch
are one list; texts are read once and nothing is shuffled. Decoding concatenates the tokens' bytes.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text; a repeated or null id changes nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of this vocabulary, as its public description gives it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 10
OVERLAP = 1 << 7


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    import tiktoken

    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    return b"".join(encoder(path).decode_tokens_bytes(ids)).decode("utf-8")


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(chunk: str, last: bool) -> list[int]:
    """Where pre-tokens begin inside a chunk, as far as the text after it cannot change them.

    None right behind white space: a run of it is cut by what follows it, which a piece that ends there does not show.
    """
    at = [m.start() for m in _pattern().finditer(chunk)]
    return [x for x in (at if last else at[:-1]) if x and not chunk[x - 1].isspace()]


def chunk_places(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, stop) of the chunks of a text; each but the first begins ``overlap`` before the end of the one before."""
    step = chunk - overlap
    return [(a, min(n, a + chunk)) for a in range(0, max(1, n - overlap), step)]


def stitches(text: str, places: list[tuple[int, int]]) -> Iterator[int]:
    """Where the pieces of a text end: a boundary for each two neighbours that agree on one, and the end of the text."""
    n = len(text)
    own = boundaries(text[slice(*places[0])], places[0][1] == n) if len(places) > 1 else []
    (begin, stop), k, more = places[0], 1, 1
    while k < len(places):
        a, z = places[k]
        following = boundaries(text[a:z], z == n)
        heads = {x + a for x in following}
        at = next((x + begin for x in own if x + begin > a and x + begin in heads), None)
        if at is not None:
            yield at
            (begin, stop), own, k, more = (a, z), following, k + 1, 1
        else:
            k = min(len(places), k + more)
            more *= 2
            stop = places[k - 1][1]
            own = boundaries(text[begin:stop], stop == n)
    yield n


def encode(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids of every row of ``docs`` (doc_id, text)."""
    if chunk <= 2 * overlap or overlap < 1:
        raise ValueError("a chunk must be longer than two overlaps")
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode_piece = encoder(path).encode_ordinary
        for b in batches:
            ids = []
            for text in b.column("text").to_pylist():
                own: list[int] = []
                begin = 0
                for end in stitches(text, chunk_places(len(text), chunk, overlap)) if text else ():
                    own += encode_piece(text[begin:end])
                    begin = end
                ids.append(own)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, ids array<int>")
