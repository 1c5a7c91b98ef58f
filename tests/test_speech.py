from pyspark.sql import functions as F

from loomledger.functions import speech


def test_digits():
    cases = {
        "nineteen oh eight": "1908", "nineteen hundred and eight": "1908", "one thousand nine hundred eight": "1908", "twenty twenty four": "2024", "one two three": "1 2 3", "80 million trees": "80000000 trees",
        "a hundred men": "100 men", "a dog": "a dog", "thirtieth": "30", "five and six": "5 and 6", "two million and five": "2000005", "oh no": "oh no", "": "", "nineteen eighty four": "1984",
    }
    for said, want in cases.items():
        assert " ".join(speech.digits(said.split())) == want, said


def test_spoken_words(spark):
    df = spark.createDataFrame([("It’s 1,908 kilometres: 7.5% & the 30th HARBOUR",), ("Twenty-one grey men",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(speech.spoken_words("t")).collect()]
    assert got == ["its 1908 kilometers 7 point 5 percent and the 30 harbor".split(), "21 gray men".split(), None, []]


def test_lexicon(spark):
    df = spark.createDataFrame([("Kulik and Kulikov met Kulik",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(speech.names_in("t", ["Kulik", "Kulikov", "met"])).collect()] == [["Kulik", "Kulikov", "met"], [], None]
    assert [r[0] for r in df.select(speech.respell("t", {"Kulik": "KOO-lik", "Kulikov": "KOO-li-kov"})).collect()] == ["KOO-lik and KOO-li-kov met KOO-lik", None, None]
    tokens = spark.createDataFrame([(["coo", "lick", "saw", "cool"],), (None,)], "t array<string>")
    assert [r[0] for r in tokens.select(speech.hear("t", {"Kulik": ["coo lick", "cool"]})).collect()] == [["kulik", "saw", "kulik"], None]
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "x map<string,string>, y map<string,string>")
    assert maps.select(speech.merge_lexicons("x", "y")).first()[0] == {"a": "1", "b": "3"}
    assert len(speech.BRITISH_AMERICAN) == 64


def test_empty_lexicon(spark):
    df = spark.createDataFrame([("Kulik",)], "t string")
    assert df.select(speech.names_in("t", []), speech.respell("t", {})).first() == ([], None)
    assert F is not None
