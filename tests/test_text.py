import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from trendspark.functions import text

SAMPLES = [
    "Hello World! 123?", "Привет, мир!", "漢字テスト", "ひらがな", "مرحبا", "नमस्ते १२३", "😀 Wow!!", "", None, "²③Ⅷ Ⓐ x",
]


def test_features_agree_with_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "id int, t string")
    cols = [c.alias(n) for n, c in text.text_features(F.col("t")).items()]
    for row, s in zip(df.select("id", *cols).orderBy("id").collect(), SAMPLES):
        if s is None:
            assert row.length is None
            continue
        n = max(1, len(s))
        assert row.length == len(s)
        assert row.question_marks == s.count("?") and row.exclamation_marks == s.count("!")
        assert row.uppercase_ratio == pytest.approx(sum(c.isupper() for c in s) / n)
        assert row.digit_ratio == pytest.approx(sum(c.isdigit() for c in s) / n)
        assert row.has_cyrillic == int(any("Ѐ" <= c <= "ӿ" for c in s))
        assert row.has_cjk == int(any("一" <= c <= "鿿" or "぀" <= c <= "ヿ" for c in s))
        assert row.has_arabic == int(any("؀" <= c <= "ۿ" for c in s))
        assert row.has_devanagari == int(any("ऀ" <= c <= "ॿ" for c in s))


def test_classes_cover_all_of_unicode(spark):
    # Characters assigned since the Java in use was made may differ; there are few of them.
    points = [i for i in range(1, sys.maxunicode) if not 0xD800 <= i <= 0xDFFF and unicodedata.category(chr(i)) != "Cn"]
    df = spark.createDataFrame([(chr(i),) for i in points], "c string")
    up = {r.c for r in df.where(F.rlike("c", F.lit(text.UPPER_CLASS))).collect()}
    digit = {r.c for r in df.where(text.digit_count(F.col("c")) == 1).collect()}
    assert len(up ^ {chr(i) for i in points if chr(i).isupper()}) < 100
    assert len(digit ^ {chr(i) for i in points if chr(i).isdigit()}) < 100
    white = {chr(i) for i in points if chr(i).isspace()}
    assert white == set(text.WHITESPACE)


def test_language(spark):
    cases = [
        ("The cat is in the house with the dog", "en"), ("Le chat est dans la maison et elle est une reine", "fr"),
        ("Der Hund ist nicht mit dem Ball auf der Wiese", "de"), ("El perro y los gatos en la casa con una flor", "es"),
        ("Это русский текст", "ru"), ("これは日本語です", "ja"), ("这是中文文本", "zh"), ("안녕하세요 여러분", "ko"),
        ("هذا نص عربي", "ar"), ("यह हिंदी है", "hi"), ("abc", "en"), ("   \n ab  ", "en"), (None, "en"), ("qqqq wwww", "en"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, t string")
    got = [r.l for r in df.select("id", text.detect_language(F.col("t")).alias("l")).orderBy("id").collect()]
    assert got == [want for _, want in cases]
    groups = df.select(text.language_group(F.lit("uk")), text.language_group(F.lit("xx")), text.prefix_group(F.lit("t"), F.lit("ja"))).first()
    assert tuple(groups) == ("slavic", "other", "[cjk] t")


def test_small_helpers(spark):
    df = spark.createDataFrame([("  a\nb 　", "x" * 120)], "t string, long string")
    row = df.select(
        text.strip(F.col("t")), text.text_key(F.col("t")), text.truncate_text(F.col("long"), 100, 97),
        text.truncate_text(F.col("long"), 50), text.truncate_text(F.col("t"), 50),
        text.response_text(F.lit(None).cast("string"), F.lit("  ")),
        text.response_text(F.lit("T"), F.lit(" " + "d" * 400)),
    ).first()
    assert row[0] == "a\nb" and row[1] == "a b"
    assert row[2] == "x" * 97 + "..." and row[3] == "x" * 50 + "..." and row[4] == "  a\nb 　"
    assert row[5] == "" and row[6] == "T\nDescription: " + "d" * 300
