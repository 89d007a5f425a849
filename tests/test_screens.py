"""Forms, panels, lookups and collection pages on small inputs with nulls and empties."""

import json

from pyspark.sql import functions as F

from factloom.functions.dictionary import DEFAULT_DICTIONARY, PRESETS, parse_dictionary
from factloom.functions.text import decode_entities
from factloom.operators import screens as S


def test_ids_and_panels(spark):
    df = spark.createDataFrame([("gid://shop/Product/7",), ("7",), (None,), ("",)], "x string")
    got = [tuple(r) for r in df.select(S.gid_tail(F.col("x")), S.gid(F.col("x"), "Product"), S.panel_cut(F.col("x"), 3)).collect()]
    assert got == [("7", "gid://shop/Product/7", "gid..."), ("7", "gid://shop/Product/7", "7"), (None, None, None), ("", "gid://shop/Product/", "")]


def test_business_record(spark):
    rows = [(" 2 days ", "", None, " card", " 14 "), (None, " ", "x", "", "-1"), ("", "", "", "", "NaN"), ("", "", "", "", None), ("", "", "", "", "Infinity"), ("", "", "", "", "many")]
    got = S.business_record(spark.createDataFrame(rows, "delivery_time string, delivery_cost string, warranty string, payment_methods string, return_days string")).collect()
    assert tuple(got[0]) == ("2 days", None, None, "card", 14.0, True)
    assert [r["valid"] for r in got] == [True, False, False, True, False, False] and all(r["return_days"] is None for r in got[1:])


def test_forms_and_headers(spark):
    pairs = spark.range(1).select(S.form_pairs(F.array(F.lit(" q "), F.lit(None), F.lit("r")), F.array(F.lit("a"), F.lit("b"))).alias("p")).first()["p"]
    assert [tuple(x) for x in pairs] == [("q", "a")]
    headers = spark.createDataFrame([({"forwarded": "f", "x-forwarded-for": "1.2.3.4", "x": "y"},), ({"x-real-ip": ""},), ({},), (None,)], "h map<string,string>")
    got = [r[0] for r in headers.select(S.forwarding_headers(F.col("h"))).collect()]
    assert list(json.loads(got[0])) == ["x-forwarded-for", "forwarded"] and got[1:] == [None, None, None]


def test_collection_page(spark):
    pages = spark.createDataFrame([("a", "A", "u", "All.", ["Size: 1"]), ("b", "B", "v", "None.", None), ("c", "C", "w", " ", [])], "collection_id string, title string, url string, summary string, criteria array<string>")
    members = spark.createDataFrame([("a", k, f"p{k}", f"T{k}", f"x/{k}") for k in range(5)], "collection_id string, pos int, product_id string, title string, url string")
    got = {r["collection_id"]: r["jsonld"] and json.loads(r["jsonld"]) for r in S.collection_jsonld(pages, members, 3).collect()}
    assert got["a"]["mainEntity"]["numberOfItems"] == 5 and [x["position"] for x in got["a"]["mainEntity"]["itemListElement"]] == [1, 2, 3]
    assert got["b"]["mainEntity"] == {"@type": "ItemList", "numberOfItems": 0, "itemListElement": []} and "additionalProperty" not in got["b"] and got["c"] is None


def test_append_and_lookup(spark, tmp_path):
    rows = spark.createDataFrame([(1, [*range(200)]), (2, [])], "id int, variants array<int>")
    for _ in range(2):
        S.append_log(rows, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and {len(r["variants"]) for r in S.lookup(log, 1).collect()} == {100}
    nodes = spark.createDataFrame([(([1],),), (None,)], "c struct<nodes:array<int>>")
    assert [r[0] for r in nodes.select(S.flatten_nodes(F.col("c"))).collect()] == [[1], []]


def test_presets_and_entities(spark):
    assert len(PRESETS) > 12 and all(parse_dictionary(x) for k, x in PRESETS.items() if k != "custom") and parse_dictionary(DEFAULT_DICTIONARY)[-1].fallback == "outdoors"
    df = spark.createDataFrame([("&AMP;lt; &LT;b&gt; &#65;&#x42; &eacute; &#38;lt; & &bogus;",), (None,)], "x string")
    assert [r[0] for r in df.select(decode_entities(F.col("x"))).collect()] == ["&lt; <b> AB é < & &bogus;", ""]
