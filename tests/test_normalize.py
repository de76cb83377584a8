import random

from pyspark.sql import functions as F

from lexaprox.functions.normalize import SourceMap, decode_symbols, normalize, normalize_text, utf8_offset, utf16_offset


def test_foldings():
    assert normalize_text("São Paulo") == "sao paulo"
    assert normalize_text("Straße") == "strasse" and normalize_text("ÆŒßŁøÞŉ") == "aeoesslothʼn".replace("ʼn", "'n")
    assert normalize_text("ß", fold_diacritics=False) == "ss" and normalize_text("İ", fold_diacritics=False) == "i̇"
    assert normalize_text("ÀÉ", fold_case=False) == "AE" and normalize_text("é") == "e"
    assert normalize_text("ΩЖ×÷") == "ΩЖ×÷" and normalize_text("ﬁ") == "fi" and normalize_text("ſ", fold_diacritics=False) == "s"
    assert normalize_text("ÀÉ", False, False) == "ÀÉ"


def test_column_is_the_python_form_and_idempotent(spark):
    rng = random.Random(1)
    chars = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x330), *range(0xFB00, 0xFB07), 0x3A9, 0x416, 0x1F600]]
    rows = [("".join(rng.choice(chars) for _ in range(30)),) for _ in range(60)] + [("",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    for case in (True, False):
        for marks in (True, False):
            for r in df.select("s", normalize(F.col("s"), case, marks).alias("n"), normalize(normalize(F.col("s"), case, marks), case, marks).alias("nn")).collect():
                assert r["n"] == (None if r["s"] is None else normalize_text(r["s"], case, marks)) == r["nn"]


def test_source_map():
    m = SourceMap("cafés")
    assert m.text == "cafes" and m.to_source(3, 4) == (3, 5) and m.to_source(0, 5) == (0, 6) and m.to_source(2, 2) == (2, 2)
    assert m.to_source(4, 9) is None and m.to_source(3, 2) is None and m.source_of(4) == 5 and m.source_of(5) is None
    assert SourceMap("́").is_empty() and len(SourceMap("ß")) == 2 and SourceMap("ß").to_source(0, 1) == (0, 1)


def test_offsets(spark):
    r = spark.createDataFrame([("aé\U0001f600b",)], "s string").select(*[f(F.col("s"), F.lit(k)).alias(f"{f.__name__}{k}") for f in (utf8_offset, utf16_offset) for k in (0, 2, 3, 4, 5)]).first()
    assert list(r) == [0, 3, 7, 8, None, 0, 2, 4, 5, None]


def test_invalid_utf8():
    assert decode_symbols(b"a\xffb") == ([97, 0x1100FF, 98], 3) and decode_symbols(b"abcd", 2) == ([97, 98, 99], 4)
