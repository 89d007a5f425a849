"""Variants, collections, derivations, monitoring, sources and streaming on small inputs."""

import json

from pyspark.sql import functions as F

from factloom.operators import collections as C
from factloom.operators import coverage as V
from factloom.operators import derive as D
from factloom.operators import extract as X
from factloom.operators import monitor as O
from factloom.operators import variants as L
from factloom.sources.catalogue import facts_of, fold_children
from factloom.streaming import freshness as S

FACTS = "array<struct<k:string,v:string>>"


def test_variants(spark):
    option = lambda n, v: {"name": n, "value": v}
    variants = [{"id": "v1", "title": "", "selected_options": [option("Colour", "Grey"), option("Fit", "slim")]}, {"id": "v2", "title": "", "selected_options": [option(" colour ", "beige"), option("Fit", "Slim ")]}]
    single = [{"id": "v1", "title": "", "selected_options": [option("Title", "Default Title")]}]
    facts = [("Colour", "grey"), ("Kind", "chair"), ("Colour", "beige")]
    df = spark.createDataFrame([(1, facts, variants), (2, facts, single)], f"id int, facts {FACTS}, variants array<struct<id:string,title:string,selected_options:array<struct<name:string,value:string>>>>")
    a, b = L.split_levels(df).orderBy("id").collect()
    assert [f["k"] for f in a["product_facts"]] == ["Kind"] and a["moved_labels"] == ["Colour"]
    assert [(v["id"], len(v["facts"])) for v in a["variant_facts"]] == [("v1", 2), ("v2", 2)]
    assert len(b["product_facts"]) == 3 and b["variant_facts"] == []


def members(spark):
    rows = [("c", 1, "p1", "One", [("Material", "oak, pine"), ("Size", "10 cm")]), ("c", 2, "p2", "Two", [("Material", "Oak."), ("Size", "12 cm")]), ("c", 3, "p3", "Three", [("Material", "ash"), ("Rare", "x")]), ("c", 4, "p4", "Four", [])]
    return spark.createDataFrame(rows, f"collection_id string, pos int, product_id string, title string, facts {FACTS}")


def test_collections(spark):
    labels = C.comparable_labels(members(spark)).orderBy("rank").collect()
    assert [(r["k"], r["n_products"], r["label_values"]) for r in labels] == [("Material", 3, ["oak", "pine", "ash"]), ("Size", 2, ["10 cm", "12 cm"])]
    collections = spark.createDataFrame([("c", "Tables", "Wow! Ours."), ("empty", "None", None)], "collection_id string, title string, description_html string")
    found = {r["collection_id"]: r for r in C.capsules(collections, members(spark)).collect()}
    assert found["c"]["summary"] == "Wow!. Tables has 4 products. They differ by material: oak, pine, ash; size: 10 cm, 12 cm."
    assert found["c"]["criteria"] == ["Material: oak, pine, ash", "Size: 10 cm, 12 cm"]
    assert [r["cells"] for r in found["c"]["table"]["rows"]] == [["oak, pine", "10 cm"], ["Oak.", "12 cm"], ["ash", ""]]
    assert found["empty"]["summary"] == "None has 0 products." and found["empty"]["questions"] == [] and found["empty"]["table"] is None
    html = C.capsules(collections, members(spark)).filter("collection_id = 'c'").select(C.table_html(F.col("table")).alias("h")).first()["h"]
    assert html.count("<tr>") == 4


def product(spark, facts, **more):
    row = {"title": "Chair &amp; co", "body": "<p>Nice chair</p>", "price": "10.00", "currency": "EUR", "available": False, "vendor": "V", "kind": "chair", "url": "https://s.example/p"} | more
    df = spark.createDataFrame([(row["title"], row["body"], facts, row["price"], row["currency"], row["available"], row["vendor"], row["kind"], row["url"])], f"title string, body string, facts {FACTS}, price string, currency string, available boolean, vendor string, kind string, url string")
    return df, {c: F.col(c) for c in df.columns}


def test_summary_and_questions(spark):
    df, c = product(spark, [("Colour", "red"), ("Material", "oak"), ("Seats", "4 people"), ("Capacity", "9")])
    row = df.select(D.summary(c["title"], c["body"], c["facts"], c["price"], c["currency"], c["available"], c["vendor"], c["kind"]).alias("s"), D.questions(c["title"], c["facts"], c["price"], c["currency"], c["available"]).alias("q")).first()
    assert row["s"] == "Nice chair. Key details: material: oak; colour: red; capacity: 9; seats: 4 people. Priced at 10.00 EUR from V, currently out of stock."
    assert [x["q"] for x in row["q"]] == ["What is Chair & co made of?", "How many people does Chair & co seat?", "How much does Chair & co cost?"]
    df, c = product(spark, [], body=None, price=None, available=None)
    assert df.select(D.summary(c["title"], c["body"], c["facts"], c["price"], c["currency"], c["available"], c["vendor"], c["kind"])).first()[0] == "Chair & co is a chair."


def test_alt_answer_mirror_jsonld(spark):
    df, c = product(spark, [("Colour", "red, blue"), ("Material", "oak"), ("Style", "3ba7dee8f7bd4e14")])
    row = df.select(*[D.alt_text(c["title"], c["facts"], F.lit(i)).alias(f"a{i}") for i in range(3)], D.answer_preview(c["title"], c["facts"], F.lit(None).cast("string"), F.lit(None).cast(D.QA), c["price"], c["currency"]).alias("p"), D.mirror(c["title"], c["url"], c["body"], F.lit(""), c["facts"], c["price"], c["currency"], c["available"], c["vendor"]).alias("m"), D.product_jsonld(c["title"], c["url"], F.lit('say "hi"'), c["facts"], F.lit("")).alias("j")).first()
    assert [row["a0"], row["a1"], row["a2"]] == ["Chair & co - oak, red", "Chair & co - red, oak, view 2", "Chair & co - red, oak, view 3"]
    assert row["p"]["question"] == "What is Chair & co made of, and what size is it?" and row["p"]["with_app"] == "Chair & co is made of oak, in red, blue." and row["p"]["sources"] == ["Material", "Colour"]
    assert "availability: out of stock" in row["m"] and "| Material | oak |" in row["m"]
    assert json.loads(row["j"])["description"] == 'say "hi"' and "audience" not in json.loads(row["j"])
    df, c = product(spark, [])
    assert df.select(D.answer_preview(c["title"], c["facts"], F.lit(""), F.lit(None).cast(D.QA), c["price"], c["currency"]).alias("p")).first()["p"] is None


def test_ld_scan(spark):
    block = lambda x: f"<script type='application/ld+json'>{x}</script>"
    pages = [(1, block('{"@type":"Product","@id":"a"}')), (2, block('[{"@graph":[{"@type":["Product","Thing"]},{"@type":"Organization"}]}]')), (3, block("{bad")), (4, '<input name="password">'), (5, None)]
    got = {r["id"]: r for r in O.ld_scan(spark.createDataFrame(pages, "id int, html string")).collect()}
    assert (got[1]["node_count"], got[1]["emitters"]) == (1, ["a"])
    assert (got[2]["node_count"], got[2]["organization_emitters"]) == (1, [""])
    assert not got[3]["has_product_ld"] and got[4]["password_protected"] and got[5]["node_count"] == 0


def test_embed_and_limits(spark):
    block = lambda t, off="false": json.dumps({"current": {"blocks": {"x": {"type": t, "disabled": off == "true"}}}})
    rows = [(1, "/* c */" + block("apps/a/blocks/h/uid")), (2, block("apps/a/blocks/h/uid", "true")), (3, block("apps/a/blocks/h/other")), (4, "nope"), (5, '{"current": "preset"}')]
    got = {r["id"]: (r["active"], r["present_but_disabled"], r["stale_reference"], r["unreadable"]) for r in O.embed_check(spark.createDataFrame(rows, "id int, settings string"), "h", "uid").collect()}
    assert got == {1: (True, False, False, False), 2: (False, True, False, False), 3: (False, False, True, False), 4: (False, False, False, True), 5: (False, False, False, False)}


def test_fold(spark):
    lines = ['{"id":"g/Product/1","title":"Old"}', "", '{"id":"g/ProductVariant/7","title":"v","__parentId":"g/Product/1","selectedOptions":[{"name":"C","value":"r"}]}', '{"key":"facts","value":"[]","__parentId":"g/Product/1"}', '{"key":"state","value":"x","__parentId":"g/ProductVariant/7"}', '{"id":"g/ProductVariant/8","__parentId":"g/Product/9"}', "broken", '{"id":"g/Product/1","title":"New","inventory":0}']
    rows = fold_children(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")).collect()
    assert len(rows) == 1 and rows[0]["title"] == "New" and rows[0]["ord"] == 0 and rows[0]["available"] is False
    assert rows[0]["metafields"][0]["key"] == "facts" and rows[0]["variants"][0]["metafields"][0]["key"] == "state"
    assert spark.range(1).select(facts_of(F.lit("bad"))).first()[0] == []


def test_reports(spark):
    df = spark.createDataFrame([(1, "a", [("A", "x")]), (2, "b", []), (3, "c", [("A", "y"), ("B", "z")])], f"id int, title string, facts {FACTS}")
    assert {r["label"]: r["n_products"] for r in V.coverage(df).collect()} == {"A": 2, "B": 1}
    assert V.coverage_totals(df).first().asDict() == {"sampled": 3, "none": 1, "percent": 67}
    assert V.coverage_totals(df.limit(0)).first()["percent"] == 0
    dry = V.dry_run(df, F.col("id") != 2).first()
    assert (dry["would_skip"], len(dry["examples"])) == (1, 2)


def test_stream_equals_batch(spark, tmp_path):
    products = spark.createDataFrame([(i, f"oak chair {i}", "<p>x</p>", "1.00", "EUR", True, "V", "chair") for i in range(6)], "id long, title string, description_html string, price string, currency string, available boolean, vendor string, product_type string").cache()
    empty = spark.createDataFrame([], "owner_id long, key string, type string, value string, source string, at string, engine string")
    events = spark.createDataFrame([(i % 4, "update") for i in range(8)], "product_id long, kind string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    out = {"rows": []}

    def handle(batch, _):
        out["rows"] += S.refresh_changed(products, batch, empty, F.lit("t"), "1", "Material: oak").collect()

    stream = S.distinct_changes(S.changes(spark, str(tmp_path / "events"), events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")))
    S.poll(stream, str(tmp_path / "ck"), handle).awaitTermination()
    batch = S.refresh_changed(products, events, empty, F.lit("t"), "1", "Material: oak").collect()
    key = lambda rows: sorted((r["owner_id"], r["key"], r["value"]) for r in rows)
    assert key(out["rows"]) == key(batch) and len({r["owner_id"] for r in batch}) == 4
    assert S.sweep_missing(products, spark.createDataFrame(batch)).count() == 2


def test_sweep_tests_values_above_what_computes_them(spark):
    """The optimizer doesn't write the extraction into the sweep's filter, where it would run once for each step that reads it."""
    products = spark.createDataFrame([(1, "red bolt"), (2, "")], "id long, title string").withColumn("description_html", F.lit(""))
    properties = X.extract(products, "Colour: red").select(F.col("id").alias("owner_id"), F.lit("facts").alias("key"), F.to_json("facts").alias("value"))
    swept = S.sweep_missing(products, properties.withColumn("value", F.nullif("value", F.lit("[]"))))
    assert [r["id"] for r in swept.select("id").collect()] == [2]
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" in plan and not [line for line in plan.splitlines() if " Filter " in f" {line.lstrip(' :+-')} " and "regexp" in line]


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([(1, '{"id":"gid://x/Product/1","title":"a"}'), (2, '{"id":"gid://x/ProductVariant/2","title":"b","__parentId":"gid://x/Product/1"}'), (3, '{"key":"k","value":"v","__parentId":"gid://x/ProductVariant/2"}')], "line_no int, line string")
    folded = fold_children(lines)
    row = folded.first()
    assert (row["id"], row["metafields"], row["variants"][0]["metafields"][0]["value"]) == ("gid://x/Product/1", [], "v")
    assert "from_json" not in folded._jdf.queryExecution().optimizedPlan().toString()


def test_option_names_are_bound(spark):
    """Names of options are listed once, not again for each option."""
    df = spark.createDataFrame([([("S", "a"), ("R", "x")], [("s ", "b"), ("R", "X")])], "a array<struct<name:string,value:string>>, b array<struct<name:string,value:string>>")
    names = df.select(L.varying_names(F.array(F.struct(F.col("a").alias("selected_options")), F.struct(F.col("b").alias("selected_options")))).alias("n"))
    assert names.first()["n"] == ["s"] and names._jdf.queryExecution().optimizedPlan().toString().count("flatten") == 1


def test_visual_values_are_ranked_once_a_product(spark):
    from factloom.plans import registry

    plan = registry.queries()["alt_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan[: plan.index("Generate explode")] and "array_sort" in plan


def test_only_members_that_are_spoken_of_are_described(spark):
    shops = spark.createDataFrame([("c", "Chairs", "")], "collection_id string, title string, description_html string")
    rows = spark.range(100).selectExpr("'c' AS collection_id", "id AS pos", "id AS product_id", "concat('chair ', id) AS title")
    described = []

    def describe(capped):
        described.append(capped.count())
        return capped.withColumn("facts", F.expr("array(named_struct('k', 'Wood', 'v', IF(pos % 2 = 0, 'oak', 'ash')))"))

    out = C.capsules(shops, rows, describe=describe).first()
    assert described == [60] and (out["n_products"], out["true_count"]) == (60, 100) and out["criteria"] == ["Wood: oak, ash"]


def asked_by_hand(title, rows):
    """Questions about rows (pos, product, facts), with one loop over all of them."""
    values, have = {}, {}
    for _, product_id, facts in sorted(rows, key=lambda r: r[0]):
        for k, v in facts or []:
            have.setdefault(k, set()).add(product_id)
            for part in v.split(","):
                shown = " ".join(part.split())
                if shown:
                    values.setdefault(k, {}).setdefault(shown.lower().rstrip(".;:"), shown)
    labels = [k for k in have if len(have[k]) >= max(2, -(-len(rows) // 2)) and len(values.get(k, {})) > 1]
    out = [(f"How many products are in {title}?", "1 product." if len(rows) == 1 else f"{len(rows)} products.")] if rows else []
    for k in sorted(labels, key=lambda k: (-len(have[k]), -len(values[k])))[:5][:4]:
        shown = list(values[k].values())
        out.append((f"What {k.lower()} options are there in {title}?", ", ".join(shown[:6]) + (f" and {len(shown) - 6} more" if len(shown) > 6 else "") + "."))
    return out


def test_questions_are_of_all_members(spark):
    """Collections of 0 to 500 members, some listed twice, with labels and values that only come after the 60th."""
    said = {
        "all": [(i, f"p{i % 450}", [("Size", f"{i} cm, {i % 7} cm"), ("Wood", "oak" if i < 100 else "Ash."), ("Same", "x"), *([("Late", f"v{i % 3}, V{i % 3};")] if i >= 60 else []), *([("Wood", "pine,")] if i % 9 == 0 else [])]) for i in range(500)],
        "early": [(i, f"p{i}", [("Early", f"e{i}"), ("Much", f"m{i}")] if i < 60 else [("Much", f"m{i % 2}")] if i % 2 else None if i % 4 else []) for i in range(130)],
        "half": [(i, f"p{i}", [("K", f"k{i}")] if i < 31 else []) for i in range(62)],
        "less": [(i, f"p{i}", [("K", f"k{i}")] if i < 31 else []) for i in range(63)],
        "one": [(1, "p", [("K", "a, b")])],
        "none": [],
    }
    shops = spark.createDataFrame([(c, f"All {c}") for c in said], "collection_id string, title string")
    rows = spark.createDataFrame([(c, pos, p, f) for c, m in said.items() for pos, p, f in m], f"collection_id string, pos int, product_id string, facts {FACTS}")
    out = {r["collection_id"]: r for r in C.asked(shops, rows.repartition(3)).collect()}
    assert {c: r["n_products"] for c, r in out.items()} == {c: len(m) for c, m in said.items()}
    for c, m in said.items():
        assert [(x["q"], x["a"]) for x in out[c]["questions"]] == asked_by_hand(f"All {c}", m), c
    assert [x["q"].split()[1] for x in out["all"]["questions"]] == ["many", "size", "wood", "late"] and len(out["half"]["questions"]) == 2 and len(out["less"]["questions"]) == 1


def test_collection_questions_counts_beyond_the_cap_of_the_other_texts(spark):
    from factloom.plans import registry

    at = "/root/testdata/sf0.01"
    n = {r["p_brand"]: r["count"] for r in spark.read.parquet(f"{at}/part.parquet").groupBy("p_brand").count().collect()}
    told = {r["collection_id"]: r["questions"] for r in registry.queries()["collection_questions"](spark, at).collect()}
    assert max(n.values()) > C.MEMBERS and told.keys() == n.keys() and all(told[c].startswith(f"How many products are in Parts of {c}? {n[c]} products.") for c in n)
    assert "QUALIFY rn" not in registry.oracle_sql()["collection_questions"] and "QUALIFY rn <= 60" in registry.oracle_sql()["collection_summary"]
