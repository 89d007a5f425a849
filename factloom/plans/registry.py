"""All queries of the reference's operators, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import collections as C
from factloom.operators import coverage as V
from factloom.operators import derive as D
from factloom.operators import extract as X
from factloom.operators import merge as M
from factloom.operators import monitor as O
from factloom.operators import variants as L
from factloom.plans import kept, more
from factloom.plans.testmap import DICTIONARY, NOW, SQL_C, SQL_C_ALL, SQL_P, candidates, collections, described, hits, jobs, members, products, properties, stored, table, with_facts
from factloom.sources.catalogue import fold_rows
from factloom.streaming.freshness import sweep_missing

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        name = f.__name__.strip("_")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return _QUERIES | more.QUERIES | kept.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | more.SQL | kept.SQL


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def shown_facts(facts: Column) -> Column:
    return F.array_join(F.transform(facts, lambda f: F.concat_ws("=", f["k"], f["v"])), " | ")


def shown_qa(qa: Column) -> Column:
    return F.array_join(F.transform(qa, lambda x: F.concat_ws(" ", x["q"], x["a"])), " | ")


SHOWN_FACTS = "array_to_string([x.k || '=' || x.v FOR x IN facts], ' | ')"

# ---------------------------------------------------------------- extraction and coverage


@query(SQL_P + "SELECT u.k AS label, count(*) AS n_products FROM (SELECT unnest(facts) AS u FROM f) GROUP BY 1")
def coverage(spark, sf_dir):
    return V.coverage(with_facts(spark, sf_dir))


@query(SQL_P + "SELECT count(*) AS sampled, count(*) FILTER (len(facts) = 0) AS none, CAST(100 AS BIGINT) AS percent FROM f")
def coverage_totals(spark, sf_dir):
    return V.coverage_totals(with_facts(spark, sf_dir))


@query(SQL_P + f"SELECT id, {SHOWN_FACTS} AS facts FROM f")
def extract_facts(spark, sf_dir):
    return with_facts(spark, sf_dir).select("id", shown_facts(F.col("facts")).alias("facts"))


@query(SQL_P + f"SELECT id, {SHOWN_FACTS} AS facts FROM f")
def extract_table(spark, sf_dir):
    """The same facts by dictionaries that are rows, one of each brand."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("shop"), F.lit(DICTIONARY).alias("raw")).distinct()
    out = X.extract_with_table(products(spark, sf_dir, apart=True), X.dictionary_rows(brands), shop="vendor")
    return out.select("id", shown_facts(F.col("facts")).alias("facts"))


@query(
    SQL_P + ", b AS (SELECT *, CAST(regexp_extract(vendor, '[0-9]+') AS INTEGER) AS n FROM f) "
    "SELECT id, concat_ws(' | ', CASE WHEN n % 2 = 0 THEN 'Shade=' || coalesce(colour, 'plain') END, CASE WHEN n % 3 = 0 AND list_contains(w, ['widget','bolt','rod','anvil','gizmo','ring','plate','gear'][n % 8 + 1]) THEN 'Own=' || ['widget','bolt','rod','anvil','gizmo','ring','plate','gear'][n % 8 + 1] END, "
    "CASE WHEN n % 5 = 0 THEN 'Extra=finish matt grey, ' || includes END, CASE WHEN n % 7 = 0 THEN 'Size=' || dimensions END, 'Made of=' || CASE WHEN list_contains(w, 'steel') THEN 'part' ELSE 'part' END) AS facts FROM b"
)
def extract_brands(spark, sf_dir):
    """Facts by dictionaries that differ from brand to brand: labels, terms, defaults and kinds of terms."""
    n = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    kinds = F.array(*map(F.lit, ("widget", "bolt", "rod", "anvil", "gizmo", "ring", "plate", "gear")))
    lines = [F.when(n % 2 == 0, "Shade: red, blue | default: plain"), F.when(n % 3 == 0, F.concat(F.lit("Own: "), F.element_at(kinds, n % 8 + 1))), F.when(n % 5 == 0, "Extra: finish *, * screws"), F.when(n % 7 == 0, "Size: #size"), F.lit("Made of: in, part, faux part")]
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("shop"), F.concat_ws("\n", *lines).alias("raw")).distinct()
    out = X.extract_with_table(products(spark, sf_dir, apart=True), X.dictionary_rows(brands), shop="vendor")
    return out.select("id", shown_facts(F.col("facts")).alias("facts"))


@query(
    "SELECT p_brand AS shop, 'Material' AS label, 'in' AS term FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'Style', 'made' FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'Kind', lower(split_part(p_brand, '#', 1)) FROM part WHERE p_brand LIKE '%7' GROUP BY 1 "
)
def colliding_terms_(spark, sf_dir):
    """Plain terms of the brands' dictionaries that are stopwords there; some brands add their own."""
    raw = F.concat(F.lit("Material: oak, in, pine\nStyle: made, in *, * an\nKind: "), F.lower(F.split("p_brand", "#")[0]))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("shop"), raw.alias("raw"), F.when(F.col("p_brand").endswith("7"), F.lower(F.split("p_brand", "#")[0])).alias("extra")).distinct()
    return X.colliding_rows(brands)


DOC_TERMS = ("the", "und", "licensed", "mit license", "para")


@query(
    "SELECT doc_id, coalesce(nullif(array_to_string([t FOR t IN ['the','und','licensed','mit license','para'] IF regexp_matches(lower(regexp_replace(text, '\\s+', ' ', 'g')), "
    "'(^|[^\\p{L}\\p{N}])' || t || '([^\\p{L}\\p{N}]|$)')][1:4], ', '), ''), 'none') AS found FROM documents"
)
def extract_documents(spark, sf_dir):
    """Plain terms in long texts; the titles are empty. Stopwords are found only under another spelling, so the terms are matched as they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.prepare(F.lit(""), F.col("text")).alias("t"))
    hit = F.concat(*[X.plain_term(F.col("t"), t, t) for t in DOC_TERMS])
    return docs.select("doc_id", F.coalesce(F.nullif(F.array_join(F.slice(X.distinct_hits(hit), 1, 4), ", "), F.lit("")), F.lit("none")).alias("found"))


@query(SQL_P + "SELECT id, dimensions AS measure, includes AS counted, finish AS captured FROM f")
def extract_kinds(spark, sf_dir):
    """Measures, counts and captures of each product."""
    p = products(spark, sf_dir, apart=True).select("id", T.prepare_cased(F.col("title"), F.col("description_html")).alias("cased")).withColumn("t", F.lower("cased"))
    stops = ["and", "with", "of"]
    return p.select("id", F.array_join(X.measurements(F.col("cased")), ", ").alias("measure"), F.array_join(X.counted(F.col("t"), "screws"), ", ").alias("counted"), F.array_join(X.prefix_capture(F.col("t"), "finish", stops), ", ").alias("captured"))


# ---------------------------------------------------------------- text

FOLD = "translate(%s, 'ăâîșşțţĂÂÎȘŞȚŢáéíóúüöñ', 'aaissttAAISSTTaeiouuon')"
STRIPPED = "replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&quot;', '\"'), '&amp;', '&')"


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(lower(" + FOLD % STRIPPED + "), '[^\\p{L}\\p{N}\\s-]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.normalize(F.col("html"))).alias("digest"))


@query("SELECT page_id, md5(trim(regexp_replace(" + STRIPPED + ", '\\s+', ' ', 'g'))) AS digest FROM pages")
def strip_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_output(T.strip_tags(F.col("html")))).alias("digest"))


STRIPPED_TEXT = "replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query(
    f"WITH c AS (SELECT doc_id, trim(regexp_replace({STRIPPED_TEXT}, '\\s+', ' ', 'g')) AS t FROM documents), "
    "s AS (SELECT doc_id, CASE WHEN regexp_matches(t, '[.!?]\\s') THEN regexp_extract(t, '^(.*?[.!?])\\s', 1) ELSE t END AS s FROM c) "
    "SELECT doc_id, CASE WHEN len(string_split(s, ' ')) <= 40 THEN s ELSE array_to_string(string_split(s, ' ')[1:40], ' ') || '...' END AS sentence FROM s"
)
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence(F.col("text"), 40).alias("sentence"))


@query(
    "WITH t AS (SELECT doc_id, unnest(list_concat(regexp_split_to_array(coalesce(text, ''), '\\s+'), [md5(CAST(doc_id AS VARCHAR))[1:doc_id % 24 + 1]])) AS w FROM documents), b AS (SELECT doc_id, replace(w, '-', '') AS w FROM t) "
    "SELECT doc_id, count(*) AS n FROM b WHERE (regexp_full_match(w, '(?i)[0-9a-f]{8,1000}') AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '(?i)[a-f]')) OR (regexp_full_match(w, '(?i)[0-9a-z]{16,}') AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '(?i)[a-z]')) GROUP BY 1"
)
def identifier_tokens(spark, sf_dir):
    """Of the texts with a hexadecimal word of 1 to 24 digits added to each."""
    more_ = F.array(F.substring(F.md5(F.col("doc_id").cast("string")), F.lit(1), (F.col("doc_id") % 24 + 1).cast("int")))
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.concat(F.split(F.coalesce("text", F.lit("")), r"\s+"), more_)).alias("w"))
    return words.filter(T.looks_like_identifier(F.col("w"))).groupBy("doc_id").agg(F.count("*").alias("n"))


ALTS = "CASE p_partkey % 6 WHEN 0 THEN 'DSC_4471.jpg' WHEN 1 THEN '' WHEN 2 THEN 'A photo of a ' || p_name WHEN 3 THEN 'Set - Photoroom_20260527_163158' WHEN 4 THEN 'a &amp; b' ELSE '3ba7dee8f7bd4e14' END"


@query(f"SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 1 THEN 'missing' WHEN 2 THEN 'written' ELSE 'filename' END AS state FROM part WHERE {ALTS} IS NOT NULL")
def alt_class(spark, sf_dir):
    images = table(spark, sf_dir, "part").withColumn("alt", F.expr(ALTS)).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "alt", F.lit(0).alias("position"), F.array().cast(X.FACTS).alias("facts"))
    return D.image_report(images).select("id", "state")


@query("SELECT page_id, regexp_extract(url, '([^/]+)/*$', 1) AS handle FROM pages")
def path_handle(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.path_handle(F.col("url")).alias("handle"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN 'fallback' END AS ip FROM events")
def client_ip(spark, sf_dir):
    first = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("10.0.0."), F.col("user_id"), F.lit(", 192.168.0.1"))).when(F.col("event_id") % 3 == 2, "")
    return table(spark, sf_dir, "events").select("event_id", T.client_ip(first, F.lit("fallback")).alias("ip"))


@query("SELECT s_suppkey, 'https://x.example/' || s_suppkey AS x FROM supplier")
def social_profiles(spark, sf_dir):
    """Only the valid address of a known platform stays."""
    x = F.concat(F.lit(" https://x.example/"), F.col("s_suppkey"))
    record = F.create_map(F.lit("x"), x, F.lit("facebook"), F.lit("http://facebook.example"), F.lit("myspace"), F.lit("https://m.example"), F.lit("youtube"), F.lit("not an address"))
    kept = V.profiles(record)
    return table(spark, sf_dir, "supplier").filter(F.size(kept) == 1).select("s_suppkey", kept["x"].alias("x"))


# ---------------------------------------------------------------- derivations

C_ = F.col
KEY_FACTS = "[x FOR x IN [{'k': 'finish', 'v': finish}, {'k': 'colour', 'v': colour}, {'k': 'dimensions', 'v': dimensions}, {'k': 'room', 'v': room}, {'k': 'size class', 'v': size_class}, {'k': 'age', 'v': age}, {'k': 'temperature', 'v': temperature}, {'k': 'kind', 'v': kind}] IF x.v IS NOT NULL][1:4]"
STOCK = "CASE WHEN available = FALSE THEN ', currently out of stock' ELSE '' END"
SUMMARY = f"opener || ' Key details: ' || array_to_string([x.k || ': ' || x.v FOR x IN {KEY_FACTS}], '; ') || '. Priced at ' || price || ' EUR from ' || vendor || {STOCK} || '.'"


def told(spark, sf_dir) -> DataFrame:
    p = with_facts(spark, sf_dir)
    return p.withColumn("summary", D.summary(*[C_(c) for c in ("title", "description_html", "facts", "price", "currency", "available", "vendor", "product_type")]))


@query(SQL_P + f"SELECT id, {SUMMARY} AS summary FROM f")
def summary(spark, sf_dir):
    return told(spark, sf_dir).select("id", "summary")


QUESTIONS = (
    "'What are the dimensions of ' || title || '? ' || dimensions || '. | What does ' || title || ' include? ' || includes || '. | How much does ' || title || ' cost? ' || price || ' EUR' || "
    f"{STOCK} || '. | Where is ' || title || ' used? workshop. | How long does delivery take for ' || title || '? 2-4 days. Delivery costs from 25 EUR. | Can I return ' || title || '? Yes, within 14 days. | How can I pay? card.'"
)


@query(SQL_P + f"SELECT id, {QUESTIONS} AS questions FROM f")
def questions(spark, sf_dir):
    business = F.from_json(F.lit('{"delivery_time":"2-4 days","delivery_cost":"25 EUR","delivery_cost_is_from":true,"return_days":14,"payment_methods":"card"}'), D.BUSINESS)
    qa = D.questions(*[C_(c) for c in ("title", "facts", "price", "currency", "available")], business)
    return with_facts(spark, sf_dir).select("id", shown_qa(qa).alias("questions"))


@query(SQL_P + "SELECT id, room AS fit_for FROM f")
def fit_for(spark, sf_dir):
    return with_facts(spark, sf_dir).select("id", D.fit_for(C_("facts")).alias("fit_for"))


@query(
    SQL_P + "SELECT id, pos, title || ' - ' || array_to_string((v[(pos % len(v)) + 1:] || v[1:pos % len(v)])[1:2], ', ') || CASE WHEN pos = 0 THEN '' ELSE ', view ' || (pos + 1) END AS alt "
    "FROM (SELECT id, title, unnest(range(3)) AS pos, [x FOR x IN [finish, string_split(colour, ',')[1], dimensions] IF x IS NOT NULL] AS v FROM f)"
)
def alt_text(spark, sf_dir):
    # what is the same at all positions is computed once a product
    p = with_facts(spark, sf_dir).select("id", T.clean_output(C_("title")).alias("base"), D.visual_values(C_("facts")).alias("values"))
    p = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    return p.select("id", F.col("pos").cast("long").alias("pos"), D.alt_of(C_("base"), C_("values"), C_("pos")).alias("alt"))


@query(SQL_P + f"SELECT id, 'Tell me about ' || title || '.' AS question, {SUMMARY} || ' ' || includes || '.' AS with_app, title || ', ' || price || ' EUR. No stated material, size or colour an assistant could compare.' AS without_app, 'summary, Dimensions' || CASE WHEN colour IS NULL THEN '' ELSE ', Colour' END || ', questions' AS sources FROM f")
def answer_preview(spark, sf_dir):
    p = told(spark, sf_dir).withColumn("qa", D.questions(*[C_(c) for c in ("title", "facts", "price", "currency", "available")]))
    p = p.withColumn("a", D.answer_preview(C_("title"), C_("facts"), C_("summary"), C_("qa"), C_("price"), C_("currency")))
    return p.select("id", "a.question", "a.with_app", "a.without_app", F.array_join("a.sources", ", ").alias("sources"))


@query(
    SQL_P + "SELECT id, concat('---\ntitle: \"', title, '\"\nurl: \"', url, '\"\nbrand: \"', vendor, '\"\nprice: \"', price, ' EUR\"\n', CASE WHEN available IS NULL THEN '' WHEN available THEN 'availability: in stock\n' ELSE 'availability: out of stock\n' END, "
    f"'---\n\n# ', title, '\n\n', {SUMMARY}, '\n\n| Attribute | Value |\n| --- | --- |\n', array_to_string(['| ' || x.k || ' | ' || x.v || ' |' FOR x IN facts], '\n'), '\n\n## Description\n\n', opener, ' ', rest, '\n\nSource: ', url, '\n') AS md FROM f"
)
def mirror_md(spark, sf_dir):
    p = told(spark, sf_dir)
    return p.select("id", D.mirror(*[C_(c) for c in ("title", "url", "description_html", "summary", "facts", "price", "currency", "available", "vendor")]).alias("md"))


@query(
    SQL_P + "SELECT id, '{\"@context\":\"https://schema.org\",\"@type\":\"Product\",\"@id\":\"' || url || '#product\",\"description\":\"' || " + SUMMARY + " || '\",\"audience\":{\"@type\":\"Audience\",\"audienceType\":\"workshop\"},\"additionalProperty\":[' || "
    "array_to_string(['{\"@type\":\"PropertyValue\",\"name\":\"' || x.k || '\",\"value\":\"' || x.v || '\"}' FOR x IN facts], ',') || ']}' AS jsonld FROM f"
)
def product_jsonld(spark, sf_dir):
    p = told(spark, sf_dir)
    return p.select("id", D.product_jsonld(C_("title"), C_("url"), C_("summary"), C_("facts"), D.fit_for(C_("facts"))).alias("jsonld"))


# ---------------------------------------------------------------- collections


@query(SQL_C + "SELECT collection_id, k AS label, array_to_string(label_values, '; ') AS label_values FROM vals")
def values_by_label(spark, sf_dir):
    found = C.values_by_label(C.member_facts(described(C.cap_members(members(spark, sf_dir)))))
    return found.select("collection_id", F.col("k").alias("label"), F.array_join("label_values", "; ").alias("label_values"))


@query(SQL_C + "SELECT collection_id, rank, k AS label, n_products FROM comp")
def comparable_labels(spark, sf_dir):
    return C.comparable_labels(described(C.cap_members(members(spark, sf_dir)))).select("collection_id", F.col("rank").cast("long").alias("rank"), F.col("k").alias("label"), "n_products")


LABELS = "l AS (SELECT collection_id, list({'k': k, 'v': label_values} ORDER BY rank) AS labels FROM comp GROUP BY 1)"


def listed(most: int, x: str = "x.v") -> str:
    return f"array_to_string({x}[1:{most}], ', ') || CASE WHEN len({x}) > {most} THEN ' and ' || (len({x}) - {most}) || ' more' ELSE '' END"


@query(SQL_C + "SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY id) AS row, id AS product_id, title, cells FROM (SELECT collection_id, id, title, array_to_string([coalesce([y.v FOR y IN facts IF y.k = c][-1], '') FOR c IN cs], ' | ') AS cells FROM m JOIN (SELECT collection_id, list(k ORDER BY rank) AS cs FROM comp GROUP BY 1) USING (collection_id)) QUALIFY row <= 50")
def comparison_table(spark, sf_dir):
    capped = described(C.cap_members(members(spark, sf_dir)))
    rows = C.comparison_rows(capped, C.comparable_labels(capped))
    return rows.select("collection_id", F.col("row").cast("long").alias("row"), "product_id", "title", F.array_join("cells", " | ").alias("cells"))


@query(SQL_C + ", " + LABELS + " SELECT collection_id, 'Hand picked & ready!. Parts of ' || collection_id || CASE WHEN n = 1 THEN ' has 1 product.' ELSE ' has ' || n || ' products.' END || coalesce(' They differ by ' || array_to_string([lower(x.k) || ': ' || " + listed(4) + " FOR x IN labels[1:3]], '; ') || '.', '') AS summary FROM n LEFT JOIN l USING (collection_id)")
def collection_summary(spark, sf_dir):
    return C.capsules(collections(spark, sf_dir), members(spark, sf_dir), describe=described).select("collection_id", "summary")


@query(SQL_C + ", " + LABELS + " SELECT collection_id, coalesce(array_to_string([x.k || ': ' || " + listed(6) + " FOR x IN labels], ' | '), '') AS criteria FROM n LEFT JOIN l USING (collection_id)")
def collection_criteria(spark, sf_dir):
    return C.capsules(collections(spark, sf_dir), members(spark, sf_dir), describe=described).select("collection_id", F.array_join("criteria", " | ").alias("criteria"))


@query(
    SQL_C_ALL + ", " + LABELS + " SELECT collection_id, 'How many products are in Parts of ' || collection_id || '? ' || CASE WHEN n = 1 THEN '1 product.' ELSE n || ' products.' END || "
    "coalesce(array_to_string([' | What ' || lower(x.k) || ' options are there in Parts of ' || collection_id || '? ' || " + listed(6) + " || '.' FOR x IN labels[1:4]], ''), '') AS questions FROM n LEFT JOIN l USING (collection_id)"
)
def collection_questions(spark, sf_dir):
    """Of all members; they are read once, so their facts aren't stored."""
    return C.asked(collections(spark, sf_dir), X.extract(members(spark, sf_dir), DICTIONARY)).select("collection_id", shown_qa(F.col("questions")).alias("questions"))


@query(SQL_C + "SELECT count(DISTINCT collection_id) AS with_table, (SELECT count(*) FROM n) - count(DISTINCT collection_id) AS without_table FROM comp")
def collection_outcomes(spark, sf_dir):
    return V.collection_outcomes(C.capsules(collections(spark, sf_dir), members(spark, sf_dir), describe=described)).select("with_table", "without_table")


# ---------------------------------------------------------------- variants and the fold


@query("SELECT l_orderkey AS id, 'status' AS name, count(DISTINCT l_linestatus) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1 UNION ALL SELECT l_orderkey, 'return', count(DISTINCT l_returnflag) FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def varying_options(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.explode(F.create_map(F.lit("Status"), F.col("l_linestatus"), F.lit(" Return"), F.col("l_returnflag"))).alias("name", "value"))
    return L.varying_options(item, ["id"])


@query(
    "WITH v AS (SELECT l_orderkey AS id, count(DISTINCT l_linestatus) > 1 AS s, count(DISTINCT l_returnflag) > 1 AS r, count(*) AS n FROM lineitem GROUP BY 1) "
    "SELECT id, CASE WHEN s THEN '' ELSE 'Status=O | ' END || CASE WHEN r THEN '' ELSE 'Return=N | ' END || 'Kind=bolt' AS product_facts, concat_ws(', ', CASE WHEN s THEN 'Status' END, CASE WHEN r THEN 'Return' END) AS moved, CASE WHEN s OR r THEN n ELSE 0 END AS n_variants FROM v"
)
def split_facts(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    option = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).alias("value"))
    variant = F.struct(F.col("l_linenumber").cast("string").alias("id"), F.col("l_partkey").cast("string").alias("title"), F.array(option("Status", "l_linestatus"), option("Return", "l_returnflag")).alias("selected_options"))
    facts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("Status", "O"), ("Return", "N"), ("Kind", "bolt"))])
    p = items.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(variant).alias("variants")).withColumn("facts", facts)
    return L.split_levels(p).select("id", shown_facts(F.col("product_facts")).alias("product_facts"), F.array_join("moved_labels", ", ").alias("moved"), F.size("variant_facts").cast("long").alias("n_variants"))


@query("SELECT o_orderkey AS id, coalesce(c.children, '') AS children FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS children FROM lineitem GROUP BY 1) c ON l_orderkey = o_orderkey")
def fold_children(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    folded = fold_rows(orders, items, "id", ["l_linenumber", "l_partkey", "l_returnflag"], ["l_partkey", "l_returnflag"], "items")
    return folded.select("id", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), x["l_returnflag"])), ",").alias("children"))


@query("SELECT l_orderkey AS id, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS n_offers FROM lineitem GROUP BY 1")
def price_range(spark, sf_dir):
    return L.price_range(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price")))


# ---------------------------------------------------------------- the property store

ACTION = "CASE WHEN p_partkey % 6 IN (0) THEN 'skipped' WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 6 IN (1, 2, 4) THEN 'removed' ELSE 'none' END WHEN p_partkey % 6 = 1 THEN 'unchanged' ELSE 'written' END"


@query(f"SELECT p_partkey AS owner_id, 'facts' AS key, {ACTION} AS action FROM part")
def merge_actions(spark, sf_dir):
    p = stored(with_facts(spark, sf_dir).select("id", "facts"), "facts")  # one extraction for both sides
    return M.merge_actions(candidates(p), properties(p)).select("owner_id", "key", "action")


@query(f"SELECT p_partkey AS owner_id, CASE WHEN {ACTION} = 'written' OR p_partkey % 6 IN (1, 2, 4) THEN 'auto' WHEN p_partkey % 6 = 0 THEN 'human' END AS source FROM part WHERE NOT ({ACTION} = 'removed') AND NOT ({ACTION} = 'none' AND p_partkey % 6 = 3)")
def merge_apply(spark, sf_dir):
    p = stored(with_facts(spark, sf_dir).select("id", "facts"), "facts")
    return M.apply_actions(properties(p), M.merge_actions(candidates(p), properties(p)), F.lit("2024-02-01"), "2").select("owner_id", "source")


@query("SELECT p_partkey AS id, p_partkey % 6 <> 0 AS may_write FROM part")
def may_write(spark, sf_dir):
    p = products(spark, sf_dir).select("id").join(properties(with_facts(spark, sf_dir)).withColumnRenamed("owner_id", "id"), "id", "left")
    return p.select("id", M.may_write(F.col("source"), F.col("value")).alias("may_write"))


@query("SELECT count(*) AS sampled, CAST(0 AS BIGINT) AS none, count(*) FILTER (p_partkey % 6 = 0) AS would_skip, least(20, count(*)) AS n_examples FROM part")
def dry_run(spark, sf_dir):
    p = stored(with_facts(spark, sf_dir).select("id", "title", "facts"), "facts")
    p = p.join(properties(p).withColumnRenamed("owner_id", "id"), "id", "left")
    out = V.dry_run(p, M.may_write(F.col("source"), F.col("value")))
    return out.select("sampled", "none", "would_skip", F.size("examples").cast("long").alias("n_examples"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 6 IN (3, 5)")
def sweep_missing_(spark, sf_dir):
    return sweep_missing(products(spark, sf_dir), properties(with_facts(spark, sf_dir))).select("id")


@query("SELECT p_partkey AS id, EXISTS (SELECT 1 FROM events WHERE user_id = p_partkey AND event_type <> 'error') AS mirrored FROM part")
def mirrored_flag(spark, sf_dir):
    have = hits(spark, sf_dir).filter("status = 200").select("handle", F.lit(True).alias("m")).distinct()
    return products(spark, sf_dir).join(have, "handle", "left").select("id", F.col("m").isNotNull().alias("mirrored"))


# ---------------------------------------------------------------- screens and monitoring


@query(SQL_P + "SELECT id, len(facts) AS n_facts, n_images, n_described, p_partkey % 6 = 0 AS edited FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS n_images, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS n_described FROM f) WHERE vendor = 'Brand#1' OR contains(lower(title), 'brand#1') OR contains(lower(vendor), 'brand#1')")
def catalogue_screen(spark, sf_dir):
    p = stored(V.search(with_facts(spark, sf_dir), 'Brand#1"'), "screen")
    images = products(spark, sf_dir).filter("id % 2 = 0").select("id", F.explode(F.array(F.lit("one"), F.lit(" "), F.lit("three"))).alias("alt"))
    mirrors = hits(spark, sf_dir).select("handle")
    rows = V.catalogue_rows(p, images, properties(with_facts(spark, sf_dir)).withColumnRenamed("owner_id", "id"), mirrors)
    return rows.select("id", F.col("n_facts").cast("long").alias("n_facts"), F.col("n_images").cast("long").alias("n_images"), F.col("n_described").cast("long").alias("n_described"), "edited")


@query("SELECT event_type AS agent, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 25)) WHERE n = 1")
def latest_per_agent(spark, sf_dir):
    return O.latest_per_agent(hits(spark, sf_dir)).select("agent", "event_id")


@query("SELECT event_type AS agent, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_agent_all(spark, sf_dir):
    return O.latest_per_agent(hits(spark, sf_dir), window_rows=None).select("agent", "event_id")


@query("SELECT o_orderpriority AS kind, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END DESC NULLS FIRST, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_job(spark, sf_dir):
    return O.latest_job(jobs(spark, sf_dir), per="kind").select("kind", "id")


@query("SELECT o_orderkey AS id, CAST(floor((epoch(TIMESTAMP '1998-06-01') - epoch(o_orderdate)) / 60) AS BIGINT) AS minutes FROM orders WHERE o_orderstatus IN ('P', 'O') AND epoch(TIMESTAMP '1998-06-01') - epoch(o_orderdate) > 180")
def stalled_jobs(spark, sf_dir):
    return O.stalled(jobs(spark, sf_dir), F.lit("1998-06-01").cast("timestamp")).select("id", F.col("minutes").cast("long").alias("minutes"))


BOTS = ("click", "view", "error")


@query("SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type IN ('click', 'view', 'error') THEN event_type ELSE 'other' END AS bot, 'part-' || user_id AS handle, count(*) FILTER (event_type <> 'error') AS hits, count(*) FILTER (event_type = 'error') AS misses FROM events GROUP BY 1, 2, 3")
def hits_daily(spark, sf_dir):
    return O.hits_daily(hits(spark, sf_dir), BOTS)


@query("SELECT event_type AS agent, max(ts) < TIMESTAMP '2024-02-01' - INTERVAL 2 DAY AS absent FROM events GROUP BY 1")
def bot_absence(spark, sf_dir):
    return O.bot_absence(hits(spark, sf_dir), now(), 2).select("agent", "absent")


@query("SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = p_partkey AND event_type <> 'error')")
def never_read(spark, sf_dir):
    return O.never_read(products(spark, sf_dir), hits(spark, sf_dir)).select("id")


@query("SELECT event_type AS path, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate FROM events GROUP BY 1")
def latency_p95(spark, sf_dir):
    m = hits(spark, sf_dir).select(F.col("agent").alias("path"), F.col("value").alias("ms"), (F.col("status") == 200).alias("ok"))
    return O.latency(m).select("path", "n", F.round("p95", 6).alias("p95"), F.round("failure_rate", 6).alias("failure_rate"))


@query(
    "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'password_page' WHEN 2 THEN 'cloudflare' WHEN 3 THEN 'bot_protection' WHEN 4 THEN 'bot_protection' WHEN 5 THEN 'server_error' WHEN 6 THEN 'unknown' WHEN 7 THEN 'unreachable' ELSE 'cloudflare' END AS cause FROM events"
)
def classify_http(spark, sf_dir):
    k = F.col("event_id") % 9
    status = F.when(k.isin(0, 1), 200).when(k.isin(2, 3, 8), 403).when(k == 4, 429).when(k == 5, 503).when(k == 6, 302)
    server = F.when(k == 2, "CloudFlare-nginx").when(k == 3, "nginx")
    names = F.when(k == 8, F.array(F.lit("CF-RAY"))).otherwise(F.array(F.lit("date")))
    body = F.when(k == 1, "<input name='password'>").otherwise("<input name='password'><script type='application/ld+json'>")
    return table(spark, sf_dir, "events").select("event_id", O.classify_http(status, server, names, body).alias("cause"))


@query(
    "SELECT c_custkey AS id, unnest(CASE WHEN c_mktsegment = 'BUILDING' THEN ['GPTBot', 'OAI-SearchBot', 'ChatGPT-User', 'Claude-SearchBot', 'PerplexityBot'] WHEN c_nationkey % 3 = 0 THEN ['GPTBot'] WHEN c_nationkey % 3 = 1 THEN ['PerplexityBot', 'ChatGPT-User'] ELSE [] END) AS agent FROM customer"
)
def robots_disallow(spark, sf_dir):
    """Of customers' robots texts by segment and nation: all agents, one, two by several blocks, or none."""
    n = F.col("c_nationkey") % 3
    text = (
        F.when(F.col("c_mktsegment") == "BUILDING", "User-agent: *\r\nDisallow: /\r\n")
        .when(n == 0, F.concat(F.lit("User-agent: gptbot\nDisallow: /\n\nUser-agent: *\nDisallow: /"), F.lower("c_name"), F.lit("\n")))
        .when(n == 1, "user-agent: PERPLEXITYBOT\nAllow: /x\nDisallow:/ \nUser-agent: ChatGPT-User\ndisallow: /\nUser-agent: PerplexityBot\nDisallow: /\n")
        .otherwise("User-agent: PerplexityBot\nAllow: /\n")
    )
    return O.robots_disallowed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("text"))).select("id", "agent")


@query(
    "SELECT page_id, k IN (1, 2, 4) AS has_product_ld, CAST(CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS INTEGER) AS node_count, CASE k WHEN 1 THEN 'p' || page_id WHEN 2 THEN 'a,b' ELSE '' END AS emitters, k IN (2, 3) AS has_organization_ld "
    "FROM (SELECT page_id, page_id % 6 AS k FROM pages)"
)
def ld_scan(spark, sf_dir):
    """Of pages with blocks of every shape added: one node, an array with a graph, an organization, a list of types, a broken block, none."""
    k, block = F.col("page_id") % 6, lambda x: F.concat(F.lit('<script type="application/ld+json">'), x, F.lit("</script>"))
    shapes = (
        F.when(k == 1, block(F.format_string('{"@type": "Product", "@id": "p%d"}', "page_id")))
        .when(k == 2, block(F.lit('[{"@graph": [{"@type": "Product", "@id": "a"}, {"@type": "Organization"}]}, {"@type": ["Product"], "@id": "b"}]')))
        .when(k == 3, F.concat(block(F.lit("{broken")), block(F.lit('{"@type": "Organization", "@id": "o"}'))))
        .when(k == 4, block(F.lit('{"@type": ["Thing", "Product"]}')))
        .when(k == 5, block(F.lit('{"@type": "Product"')))
        .otherwise("")
    )
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), shapes))
    return O.ld_scan(pages).select("page_id", "has_product_ld", "node_count", F.array_join("emitters", ",").alias("emitters"), "has_organization_ld")


@query("SELECT s_suppkey AS id, n > 600 AS over, n > 600 AND s_suppkey % 2 = 0 AS grace_expired FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def limit_state(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n_products"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).join(n, "id")
    begun = F.when(F.col("id") % 2 == 0, F.lit("2024-01-01").cast("timestamp"))
    return O.limit_state(s.withColumns({"plan_limit": F.lit(600), "grace_started_at": begun}), now()).select("id", "over", "grace_expired")


@query("SELECT 'shop.example' AS host, substr(sha256('indexnow:shop.example:s3'), 1, 32) AS key, len(l) AS n_urls, l[1] AS first FROM (SELECT list(DISTINCT url ORDER BY url) AS l FROM (SELECT DISTINCT url FROM pages WHERE starts_with(url, 'http') ORDER BY url LIMIT 10000))")
def index_payload(spark, sf_dir):
    out = V.index_payload(table(spark, sf_dir, "pages"), "shop.example", V.tenant_key(F.lit("shop.example"), "s3"))
    urls = F.from_json("url_list", "array<string>")
    return out.select("host", "key", F.size(urls).cast("long").alias("n_urls"), urls[0].alias("first"))


@query("SELECT c_custkey AS id, substr(sha256('indexnow:' || c_name || ':s3'), 1, 32) AS key FROM customer")
def key_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), V.tenant_key(F.col("c_name"), "s3").alias("key"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def incremental_poll(spark, sf_dir):
    from factloom.sources.catalogue import changed_since

    return changed_since(hits(spark, sf_dir), F.lit("2024-01-20").cast("timestamp"), "at").select("event_id")


@query(
    "WITH i AS (SELECT event_id, user_id % 50 AS media_id, event_id // 4 AS product_id, event_id % 4 AS position, event_type NOT IN ('error', 'click') AS human FROM events), "
    "o AS (SELECT *, last_value(CASE WHEN NOT human THEN product_id END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY product_id, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM i) "
    "SELECT event_id, CASE WHEN NOT human THEN 'written' WHEN owner IS NOT NULL AND owner <> product_id THEN 'shared' ELSE 'kept' END AS action FROM o"
)
def alt_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    alt = F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "click", "IMG_1234").otherwise("A person wrote this")
    images = e.select("event_id", (F.col("user_id") % 50).alias("media_id"), F.floor(F.col("event_id") / 4).alias("product_id"), F.floor(F.col("event_id") / 4).alias("product_ord"), (F.col("event_id") % 4).alias("position"), alt.alias("alt"), F.lit("suggested").alias("suggestion"))
    return O.alt_merge(images).select("event_id", "action")
