from pyspark.sql import functions as F

from loomledger.functions import text


def one(spark, value, column):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(column(F.col("t")).alias("x")).first()["x"]


def test_sentences(spark):
    assert one(spark, "Dr. X saw 7.14 m. It fell! Why? \n\n Done", text.sentences) == ["Dr.", "X saw 7.14 m.", "It fell!", "Why?", "Done"]
    assert one(spark, 'He said "no." Then left.', text.sentences) == ['He said "no." Then left.']
    assert one(spark, "A. B.", text.sentences) == ["A.", "B."]
    assert one(spark, "", text.sentences) == [] and one(spark, None, text.sentences) is None and one(spark, " \n ", text.sentences) == []


def test_content_words(spark):
    assert one(spark, "The fire of 1,176 men in July, and 7 OAKS", text.content_words) == ["1", "176", "7", "fire", "july", "men", "oaks"]
    assert one(spark, "in 1908 and 30th", text.numbers) == ["1908", "30th"]
    assert one(spark, "a b", text.content_words) == []


def test_quotations(spark):
    assert one(spark, 'x "one two three" y “four five six seven” "no no"', text.quotations) == ["one two three", "four five six seven"]
    assert one(spark, 'open "one two three', text.quotations) == []
    assert one(spark, '“a b "c d e” f"', text.quotations) == ['a b "c d e']
    assert one(spark, 'a "b c" d', text.stray_mark) is False and one(spark, 'a "b c', text.stray_mark) is True and one(spark, "a ” b", text.stray_mark) is True


def test_small_functions(spark):
    assert one(spark, "  The\n RIVER  ", text.normalise_claim) == "the river"
    assert one(spark, "﻿﻿a\r\nb\rc", text.normalise_text) == "a\nb\nc"
    assert one(spark, "x" * 81, text.echo) == "x" * 80 + "…" and one(spark, "x" * 80, text.echo) == "x" * 80
    assert one(spark, "a “b” \"c\"", text.strip_marks) == "a b c"
    assert one(spark, "a b c", text.word_count) == 3
    assert one(spark, " Mill_House ", text.fold_group) == "mill-house"
    df = spark.createDataFrame([("T", ["Part one?", " ", None]), (None, None)], "title string, h array<string>")
    assert [r[0] for r in df.select(text.names_prefix("title", "h")).collect()] == ["T. Part one? ", ""]


def test_byte_slice(spark):
    df = spark.createDataFrame([("aßc", 1, 3), ("aßc", 1, 2), ("aßc", 0, 9), ("aßc", -1, 1), (None, 0, 1), ("", 0, 0)], "t string, a int, b int")
    assert [r[0] for r in df.select(text.byte_slice("t", F.col("a"), F.col("b"))).collect()] == ["ß", None, None, None, None, ""]
