"""Dictionary extraction: term kinds, qualifiers, assembly, and both plans."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from factloom.functions import patterns as P
from factloom.functions.dictionary import colliding_terms, normalize_py, parse_dictionary, parse_stopwords, stopword_set, term_base, term_kind
from factloom.operators.extract import dictionary_rows, dictionary_table, extract, extract_with_table, measurements


def facts(spark, texts, dictionary, **options):
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "id long, title string, description_html string")
    return [{f["k"]: f["v"] for f in r["facts"]} for r in extract(df, dictionary, **options).orderBy("id").collect()]


def test_parser():
    groups = parse_dictionary("A: x, y * | default: z\nbad\n: t\nB: #size\nA: w\n")
    assert [(g.label, g.terms, g.fallback) for g in groups] == [("A", ("w",), ""), ("B", ("#size",), "")]
    assert parse_dictionary("A: x | default: none here")[0].fallback == "none here"
    assert [term_kind(t) for t in ("#Size", "* to *", "x *", "x")] == ["measure", "count", "prefix", "plain"]
    assert colliding_terms(parse_dictionary("M: in, oak\nN: * in")) == [("M", "in")]
    assert parse_stopwords("a, b\nc\n") == ["a", "b", "c"]


def test_plain_terms_and_qualifiers(spark):
    texts = ["solid oak top", "oak-look top", "oak look", "faux oak but also real oak", "aspect de oak", "oakwood", "oiled oak finish", "an oak style veneer"]
    found = facts(spark, texts, "Material: oak")
    assert [bool(f) for f in found] == [True, False, False, True, False, False, True, False]


def test_marks_are_ignored(spark):
    assert facts(spark, ["fotoliu din catifea și piele", "masa"], "M: piele, catifeă\nN: masă") == [{"M": "piele, catifeă"}, {"N": "masă"}]


def test_prefix_count_and_fallback(spark):
    texts = ["mechanism relaxa and, 6 chairs, 12 chairsets", "mechanism are bun", "mechanism 5 cm", "mechanism AB12CD34EF56GH78"]
    found = facts(spark, texts, "Mech: mechanism *\nIn: * chairs\nR: den | default: any")
    assert found == [{"Mech": "mechanism relaxa", "In": "6 chairs", "R": "any"}, {"R": "any"}, {"R": "any"}, {"R": "any"}]


def test_measures(spark):
    texts = ["80x200 cm wide", "L 130, l 80, h 79 cm", "weighs 5 kg", "160 X 80 cm and 3 kg", "code x 3", "înălțime 5 cm"]
    found = [f.get("D") for f in facts(spark, texts, "D: #size")]
    assert found == ["80x200 cm", "L 130, l 80, h 79 cm", "5 kg", "160 X 80 cm", None, "5 cm"]


def test_subsumed_and_capped(spark):
    found = facts(spark, ["chantilly lace and lace, a b c d e"], "F: lace, chantilly lace\nG: b, c, d, e, ee", extra_stopwords=("q",))
    assert found == [{"F": "chantilly lace", "G": "b, c, d"}]  # e is a stopword


def test_blank_and_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "")], "id long, title string, description_html string")
    assert [r["facts"] for r in extract(df, "A: x").collect()] == [[], []]
    assert extract(df.limit(0), "A: x").count() == 0


@pytest.mark.parametrize("partitions", [1, 8])
def test_both_plans_agree(spark, partitions):
    dictionary = "Material: oak, faux leather, leather\nSize: #size\nIn: * chairs\nMech: mechanism *\nRoom: hall | default: any"
    texts = ["oak table 80x200 cm with 4 chairs", "faux leather sofa, mechanism relaxa plus", "leather", "nothing here", "oak, leather; h 79 cm"]
    df = spark.createDataFrame([(i, "T", t, "s") for i, t in enumerate(texts)], "id long, title string, description_html string, shop string").repartition(partitions)
    a = {r["id"]: r["facts"] for r in extract(df, dictionary).select("id", "facts").collect()}
    terms = dictionary_table(spark, {"s": dictionary})
    b = {r["id"]: r["facts"] for r in extract_with_table(df, terms).collect()}
    assert a == b
    assert all(0 < len(f["v"].split(", ")) <= 4 and f["v"] for fs in a.values() for f in fs)


def test_no_shuffle(spark):
    df = spark.range(4).select("id", F.lit("t").alias("title"), F.lit("oak").alias("description_html"))
    plan = extract(df, "A: oak")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


WORDS = ("oak", "red", "steel", "faux", "masă", "masa", "piele", "țesut", "usb-c", "c++", "ip67", "(new)", "5", "12", "3,5", "%", "look", "effect", "effectively", "style", "tip", "aspect", "de", "finish", "matt", "gloss", "and", "with", "in", "chairs", "chair", "a/b", "x", "été", "-", "don't", "AB12CD34EF56GH78", "imitation", "made")


def fold(x):
    return x.translate(str.maketrans(P.MARKED, P.UNMARKED))


def by_patterns(text, groups):
    """Facts of one text by a search for each term, with the patterns of the compiled plan."""
    stops, facts = set(stopword_set()), {}
    low = " ".join(text.split()).lower()
    for g in groups:
        hits = []
        for term in g.terms:
            kind, base = term_kind(term), term_base(term)
            if not base or kind == "plain" and normalize_py(base) in stops or fold(base.lower()) not in fold(low):
                continue
            if kind == "plain":
                hits += [term] if regex.search(P.plain_pattern(base), low) else []
            elif kind == "count":
                hits += [f"{n} {base}" for n in regex.findall(P.count_pattern(base), low)]
            else:
                for found in regex.findall(P.prefix_pattern(base), low):
                    words = found.split()
                    if normalize_py(words[0]) in stops or normalize_py(words[0])[:1].isdigit():
                        continue
                    keep = [i for i, w in enumerate(words) if normalize_py(w) and normalize_py(w) not in stops]
                    phrase = regex.sub(r"^[\s,.;:-]+|[\s,.;:-]+$", "", " ".join(words[keep[0] : keep[-1] + 1])) if keep else ""
                    odd = lambda w: (b := w.replace("-", "")) and regex.search("[0-9]", b) and (regex.fullmatch("(?i)[0-9a-f]{8,4096}", b) and regex.search("(?i)[a-f]", b) or regex.fullmatch("(?i)[0-9a-z]{16,}", b) and regex.search("(?i)[a-z]", b))
                    if phrase.strip() and not regex.fullmatch(r"[\d\s.,-]+", phrase) and not any(normalize_py(w) in stops or odd(w) for w in phrase.split()):
                        hits.append(f"{base} {phrase}")
        seen = {}
        for h in hits:
            if normalize_py(h):
                seen.setdefault(normalize_py(h), h)
        kept = [h for n, h in seen.items() if not any(len(m) > len(n) and n in m for m in map(normalize_py, hits))]
        value = ", ".join(kept[:4]) or g.fallback
        if value:
            facts[g.label] = value
    return facts


def test_many_shops(spark):
    """50 shops with 20 to 2,000 terms: the join gives what a search for each term gives."""
    rng = random.Random(8)
    phrase = lambda most: " ".join(rng.choices(WORDS, k=rng.randint(1, most)))
    dictionaries, rows = {}, []
    for k in range(50):
        n = int(20 * 100 ** (k / 49))
        lines = []
        for label in range(max(2, n // 40)):
            terms = {rng.choice(["{}", "{}", "{} *", "* {}"]).format(phrase(3)).replace(",", "") for _ in range(n // max(2, n // 40))}
            lines.append(f"L{label}: " + ", ".join(sorted(terms)) + rng.choice(["", " | default: none"]))
        dictionaries[f"s{k}"] = "\n".join(lines)
        rows += [(f"s{k}-{i}", f"s{k}", phrase(60) + rng.choice(["", ".", " 4 chairs 5 chairs"])) for i in range(2)]
    df = spark.createDataFrame(rows, "id string, shop string, description_html string").withColumn("title", F.lit(""))
    got = {r["id"]: {f["k"]: f["v"] for f in r["facts"]} for r in extract_with_table(df, dictionary_table(spark, dictionaries)).collect()}
    for name, shop, text in rows:
        assert got[name] == by_patterns(". " + text, parse_dictionary(dictionaries[shop])), (name, text)


def test_dictionary_rows(spark):
    """As the driver's parser reads them, with what has no usable term."""
    raw = "A: x, y * | default: z\r\nbad\n: t\nB: #size\nC : in , * | Default :  some \nA: w\n D: * to"
    rows = dictionary_rows(spark.createDataFrame([("s", raw), ("blank", " \n"), ("none", None)], "shop string, raw string")).collect()
    own = sorted((r for r in rows if r["shop"] == "s"), key=lambda r: (r["group_ord"], r["term_ord"]))
    assert [(r["label"], r["fallback"], r["kind"], r["base"]) for r in own] == [("A", "", "plain", "w"), ("B", "", "measure", "#size"), ("C", "some", "none", "in"), ("C", "some", "none", ""), ("D", "", "count", "to")]
    labels = lambda shop: {r["label"] for r in rows if r["shop"] == shop}
    assert labels("blank") == labels("none") == {g.label for g in parse_dictionary(None) or dictionary_default()}


def dictionary_default():
    from factloom.functions.dictionary import dictionary_for

    return dictionary_for(None)


def test_table_cases(spark):
    """Null texts, ids and shops, a shop without terms, an empty table, clashing names; no nested loops in the plan."""
    rows = [(1, "oak", "s"), (2, None, "s"), (3, "oak", "unknown"), (4, "oak", None), (None, "oak", "s")]
    df = spark.createDataFrame(rows, "id long, description_html string, shop string").withColumns({"title": F.lit(None).cast("string"), "word": F.lit(1), "hits": F.lit("x"), "gram": F.lit("y")})
    terms = dictionary_table(spark, {"s": "M: oak, ash\nR: hall | default: any\nStop: in | default: yes"})
    out = extract_with_table(df, terms)
    got = {r["id"]: {f["k"]: f["v"] for f in r["facts"]} for r in out.collect()}
    rest = {"R": "any", "Stop": "yes"}
    assert got == {1: {"M": "oak"} | rest, 2: rest, 3: {}, 4: {}, None: rest}
    assert extract_with_table(df.limit(0), terms).count() == 0 and extract_with_table(df, terms.limit(0)).filter("size(facts) > 0").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_extraction_is_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """Rows of one small file are many tasks' work, and tasks grow in number with the rows."""
    from factloom.plans import registry, testmap

    part = spark.range(100).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'Brand#1' AS p_brand", "'SMALL' AS p_type", "1 AS p_size", "9.5D AS p_retailprice")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = registry.extract_kinds(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 4 and {tuple(r)[1:] for r in found.filter("id < 2").collect()} == {("width 1 cm", f"{n} screws", "finish matt grey") for n in (2, 3)}
    monkeypatch.setattr(testmap, "TASK_ROWS", 10)
    assert registry.extract_kinds(spark, str(tmp_path)).rdd.getNumPartitions() == 10


def test_named_dimensions_are_searched_once(spark):
    df = spark.createDataFrame([("Height: 5,5 mm and xînălțime=3 inch, L 4\" H2 iN",), ("3 kg înălțime 4",)], "c string").select(measurements(F.col("c")).alias("m"))
    assert [r["m"] for r in df.collect()] == [["height 5,5 mm", "înălțime 3 inch", 'L 4 "', "H 2 iN"], ["3 kg"]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count(P.NAMED[:60]) == 1


def test_facts_are_made_in_generated_code(spark):
    df = spark.createDataFrame([(1, "red bolt", "finish matt grey and 3 screws"), (2, "redder", "finish and"), (3, "small", "★")], "id long, title string, description_html string")
    found = extract(df, "Colour: red, blue\nFinish: finish *\nSigns: ★\nSize: small, blue")
    assert [[tuple(f) for f in r["facts"]] for r in found.orderBy("id").collect()] == [[("Colour", "red"), ("Finish", "finish matt grey")], [], [("Size", "small")]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert " AS facts" in plan and not [x for x in plan.splitlines() if "filter(array(" in x and " AS facts" in x]
