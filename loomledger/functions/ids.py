"""Identities by content, and scores in per mille."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(*parts: Column) -> Column:
    """SHA-256 in hex over the parts, each preceded by its length in eight little-endian bytes.

    A null part counts as empty. The length prefix keeps ('ab', 'c') apart from ('a', 'bc').
    """
    pieces = []
    for p in parts:
        raw = F.encode(F.coalesce(p.cast("string"), F.lit("")), "utf-8")
        hex_len = F.lpad(F.hex(F.octet_length(raw)), 16, "0")
        little = F.concat(*[F.substring(hex_len, 15 - 2 * i, 2) for i in range(8)])
        pieces += [F.unhex(little), raw]
    return F.sha2(F.concat(*pieces), 256)


def per_mille(p: Column) -> Column:
    """A probability as an integer from 0 to 1000, rounded half away from zero; null stays null, NaN is 0."""
    x = F.when(F.isnan(p), F.lit(0.0)).otherwise(p)
    return F.when(p.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 1000).cast("int"))


_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTE = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8


def _compress(cv, block, counter, length, flags):
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*cv, *_IV[:4], counter & 0xFFFFFFFF, counter >> 32, length, flags]
    for _ in range(7):
        for q, (a, b, c, d) in enumerate(_QUARTERS):
            for x, turn, back in ((m[2 * q], 16, 12), (m[2 * q + 1], 8, 7)):
                v[a] = (v[a] + v[b] + x) & 0xFFFFFFFF
                t = v[d] ^ v[a]
                v[d] = (t >> turn | t << (32 - turn)) & 0xFFFFFFFF
                v[c] = (v[c] + v[d]) & 0xFFFFFFFF
                t = v[b] ^ v[c]
                v[b] = (t >> back | t << (32 - back)) & 0xFFFFFFFF
        m = [m[i] for i in _PERMUTE]
    return [v[i] ^ v[i + 8] for i in range(8)]


def blake3(data: bytes) -> str:
    """BLAKE3 of some bytes in hex, after the published specification; for checking ids of small fixtures only."""

    def node(part: bytes, index: int):
        if len(part) <= 1024:
            blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
            cv = list(_IV)
            for k, b in enumerate(blocks[:-1]):
                cv = _compress(cv, b, index, 64, _START if k == 0 else 0)
            return cv, blocks[-1], index, len(blocks[-1]), _END | (_START if len(blocks) == 1 else 0)
        half = 1024
        while half * 2 < len(part):
            half *= 2
        left, right = node(part[:half], index), node(part[half:], index + half // 1024)
        return list(_IV), struct.pack("<16I", *_compress(*left), *_compress(*right)), 0, 64, _PARENT

    cv, block, counter, length, flags = node(data, 0)
    return struct.pack("<8I", *_compress(cv, block, counter, length, flags | _ROOT)).hex()


def parts_id_blake3(*parts: bytes) -> str:
    """The id of length-prefixed parts by BLAKE3."""
    return blake3(b"".join(struct.pack("<Q", len(p)) + p for p in parts))
