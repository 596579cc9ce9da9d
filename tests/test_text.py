from pyspark.sql import functions as F

from sievelight.functions import text
from sievelight.functions.tokenizers import decode, tokenize, vocabulary


def cleaned(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(text.clean_text(F.col("t"))).collect()]


def test_clean_text(spark):
    assert cleaned(spark, "Hello, World!", "  a\t\tb\n c ", "A—B “c” d’e", "x y　z", "", "!!!") == ["hello world", "a b c", "a b c d e", "x y z", "", ""]


def test_tokens_and_shingles(spark):
    df = spark.createDataFrame([("a b c d",), ("a",), ("",), (None,)], "t string").withColumn("w", text.word_tokens(F.col("t")))
    rows = df.select("w", text.shingles(F.col("w"), 3).alias("g"), text.shingles(F.col("w"), 3, short=True).alias("s")).collect()
    assert [r["w"] for r in rows] == [["a", "b", "c", "d"], ["a"], [], []]
    assert [r["g"] for r in rows] == [["a b c", "b c d"], [], [], []]
    assert [r["s"] for r in rows] == [["a b c", "b c d"], ["a"], [], []]


def test_nested_text_takes_strings_only(spark):
    raws = ['{"a": {"b": "x"}}', '{"a": {"b": 7}}', '{"a": 1}', "not json", None]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    assert [r[0] for r in df.select(text.nested_text(F.col("raw"), "a.b")).collect()] == ["x", None, None, None, None]


def test_fingerprint_takes_nulls_for_empty(spark):
    import hashlib

    df = spark.createDataFrame([("p", "q", None)], "p string, q string, a string")
    assert df.select(text.fingerprint(F.col("p"), F.col("q"), F.col("a"))).first()[0] == hashlib.sha256(b"pq").hexdigest()[:16]


def test_tokenizers(spark):
    df = spark.createDataFrame([("hello world",), ("abc",)], "t string")
    assert df.select(tokenize(F.col("t"), "r50k")).first()[0] == [23748, 995]
    assert df.select(tokenize(F.col("t"), "uniseg")).first()[0] == ["hello", " ", "world"]
    assert df.select(tokenize(F.col("t"), "no such")).collect()[1][0] == [97, 98, 99]
    assert df.select(decode(tokenize(F.col("t"), "r50k"), "r50k")).first()[0] == " hello world"
    assert len(vocabulary("r50k")) > 5


def test_highlight(spark):
    df = spark.createDataFrame([([str(i) for i in range(100)], 40, 44)], "w array<string>, s int, e int")
    out = df.select(text.highlight(F.col("w"), F.col("s"), F.col("e"), before=2, after=3)).first()[0]
    assert out == "... 38 39 【40 41 42 43 44】 45 46 47 ..."
