"""Cleaning functions on single values."""

from pyspark.sql import functions as F

from factloom.functions import text as T


def value(spark, make, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args)))).select(make(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first()
    return row["v"]


def values(spark, make, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", make(F.col("x")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_entities(spark):
    given = ["a &#038; b &#8211; c", "&#x41;&#66;", "&amp;lt;", "&#38;lt;", "&unknown; &EACUTE;", "&#99999999;x", "&#xD800;", "plain", None]
    assert values(spark, T.decode_entities, given) == ["a & b – c", "AB", "&lt;", "<", "&unknown; é", "&#99999999;x", "&#xD800;", "plain", ""]


def test_clean_output(spark):
    assert values(spark, T.clean_output, [" “Wow” – it’s 2×3… ﻿ ok ", None]) == ['"Wow" - it\'s 2x3... ok', ""]


def test_normalize(spark):
    given = ["Croială!", "<b>Ünder</b>  mid-century, É", " a b ", ""]
    assert values(spark, T.normalize, given) == ["croiala", "Ünder".replace("Ü", "ü") + " mid-century é", "a b", ""]


def test_prepare(spark):
    assert value(spark, T.prepare, "Masă &amp; <b>x</b>", "<p>Din <b>LEMN</b>\n</p>") == "masă & <b>x</b>. din lemn"


def test_first_sentence(spark):
    assert value(spark, lambda x: T.first_sentence(x, 3), "<p>One two three four. Five.</p>") == "One two three..."
    assert value(spark, lambda x: T.first_sentence(x, 9), "Wow! Five.") == "Wow!"
    assert value(spark, lambda x: T.first_sentence(x, 9), "<p></p>") == ""


def test_identifiers(spark):
    yes = ["B6ADC692-C01B-4229-8956-100A9AFB8C46", "3ba7dee8f7bd4e14", "abcdefghij1234567"]
    no = ["160x80", "M8x40", "IP65", "DDR4", "USB-C", "18k", "5G", "OLED", "12345678", "deadbeef"]
    assert values(spark, T.looks_like_identifier, yes + no) == [True] * len(yes) + [False] * len(no)


def test_file_names_and_machine_alts(spark):
    assert values(spark, T.looks_like_filename, ["DSC_4471.jpg", "image_123", "Screenshot 2", "p1234567", "A red chair", ".png"]) == [True, True, True, True, False, True]
    assert values(spark, T.looks_like_machine_alt, ["", "Set - Photoroom_20260527", "a &amp; b", "serial 123456789", "A red chair by the window"]) == [False, True, True, True, False]


def test_truncate(spark):
    long = "word " * 40
    short = value(spark, T.truncate, long)
    assert len(short) <= 125 and short.endswith("word...")
    assert value(spark, T.truncate, "x" * 200) == "x" * 122 + "..."
    assert value(spark, T.truncate, "same") == "same"


def test_addresses(spark):
    assert values(spark, T.profile_url, ["https://a.example/x", "http://a.example", "a.example", "https://", None]) == [True, False, False, False, False]
    assert values(spark, T.path_handle, ["/a/b/", "/", "x"]) == ["b", "", "x"]
    assert values(spark, T.json_length, ["[1,2]", "{}", "bad", None]) == [2, 0, 0, 0]
