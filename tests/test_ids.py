import hashlib
import struct

from pyspark.sql import functions as F

from loomledger.functions import ids


def test_content_id(spark):
    want = hashlib.sha256(b"".join(struct.pack("<Q", len(p)) + p for p in ("aß".encode(), b"", b"x" * 300))).hexdigest()
    df = spark.createDataFrame([("aß", None, "x" * 300)], "a string, b string, c string")
    assert df.select(ids.content_id(F.col("a"), F.col("b"), F.col("c"))).first()[0] == want
    two = spark.createDataFrame([("ab", "c"), ("a", "bc")], "a string, b string").select(ids.content_id(F.col("a"), F.col("b"))).collect()
    assert two[0] != two[1]


def test_per_mille(spark):
    df = spark.createDataFrame([(0.0005,), (0.9995,), (-1.0,), (2.0,), (float("nan"),), (None,)], "p double")
    assert [r[0] for r in df.select(ids.per_mille(F.col("p"))).collect()] == [1, 1000, 0, 1000, 0, None]


def test_blake3_published_vectors():
    # inputs are the bytes 0, 1, ... 250, 0, 1, ...
    data = bytes(i % 251 for i in range(4096))
    assert ids.blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert ids.blake3(data[:1]) == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert ids.blake3(data[:1025]).startswith("d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444")
    assert ids.blake3(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert ids.parts_id_blake3(b"ab", b"c") != ids.parts_id_blake3(b"a", b"bc")
