"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.chat_format import chat_report
from factloom.llm.chat_repair import repair_report
from factloom.llm.decontaminate import contaminated
from factloom.llm.html_extract import extract_pages
from factloom.llm.line_dedup import BANDS, KEPT, LEADING_TOKENS, MIN_DOCS, MIN_FIXED, MIN_TOKENS, dedup_lines
from factloom.llm.ngram_join import jaccard_components
from factloom.llm.quality_classifier import score_quality
from factloom.llm.quality_rules import quality_report
from factloom.llm.secret_scan import secret_report
from factloom.llm.sentencepieces import encoding_report
from factloom.llm.source_audit import MIN_DOCS as MIN_TERM_DOCS
from factloom.llm.source_audit import SCALE, TOP, divergences
from factloom.llm.toxicity import score_toxicity
from factloom.llm.warc import warc_report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat_report(turns.select("conv_id", "turn", "role", "text").unionByName(more))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_report(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(table(spark, sf_dir, "documents"))


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ALL = (
    op1_quality_rules,
    op2_quality_classifier,
    op3_secret_scan,
    op4_decontamination,
    op5_chat_format,
    op6_warc,
    op7_line_dedup,
    op8_ngram_join,
    op9_html_extraction,
    op10_sentencepiece,
    op11_chat_repair,
    op12_source_audit,
    op13_toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


#: Base32 of the hex digest h: five hex digits are four characters.
BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '')"

WARC_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

#: The tokens of band k of a line t of n tokens, and the bands that each template keeps.
BAND = "array_to_string(t[{lead} + ({k} * (n - {lead})) // {bands} + 1:{lead} + (({k} + 1) * (n - {lead})) // {bands}], ' ')"
TEMPLATES = [tuple(range(BANDS)), *KEPT]


def _template_sql(kept: tuple[int, ...]) -> str:
    key = " || chr(1) || ".join([f"'{kept} ' || n", f"array_to_string(t[1:{LEADING_TOKENS}], ' ')", *[BAND.format(k=k, lead=LEADING_TOKENS, bands=BANDS) for k in kept]])
    sizes = " + ".join(f"(({k} + 1) * (n - {LEADING_TOKENS})) // {BANDS} - ({k} * (n - {LEADING_TOKENS})) // {BANDS}" for k in kept)
    return key if len(kept) == BANDS else f"CASE WHEN {LEADING_TOKENS} - masked + {sizes} >= {MIN_FIXED} THEN {key} END"


LINES_SQL = f"""
WITH lines AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
tokens AS (
  SELECT doc_id, text, line, [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END FOR t IN regexp_split_to_array(trim(string_split(text, chr(10))[line + 1], ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[ \\t\\v\\f\\r]+')] AS t FROM lines
),
parts AS (SELECT *, len(t) AS n, len([x FOR x IN t IF x = '<*>']) AS masked FROM tokens WHERE len(t) >= {MIN_TOKENS}),
keys AS (SELECT doc_id, text, line, unnest([{", ".join(map(_template_sql, TEMPLATES))}]) AS key FROM parts),
common AS (
  SELECT key, min(doc_id) AS first FROM (SELECT DISTINCT doc_id, text, key FROM keys WHERE key IS NOT NULL) GROUP BY key HAVING count(*) >= {MIN_DOCS}
),
gone AS (SELECT doc_id, text, list(DISTINCT line) AS gone FROM keys JOIN common USING (key) WHERE doc_id > first GROUP BY doc_id, text)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN d.text ELSE array_to_string([l FOR l, i IN string_split(d.text, chr(10)) IF NOT list_contains(gone, i - 1)], chr(10)) END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.text = g.text
"""


#: Cells of the fold as structs of cost, audit and repaired text, in the order of which the least is taken; null where a state can't be reached.
CELL = "{{'c': {c}, 'a': {a}, 't': {t}}}"


def _least(*cells: str) -> str:
    return f"list_min([{', '.join(cells)}])"


def _inserted(s: str, role: str) -> str:
    return f"CASE WHEN {s} IS NOT NULL THEN " + CELL.format(c=f"{s}.c + 3", a=f"{s}.a || 'I'", t=f"{s}.t || chr(10) || '{role}:'") + " END"


def _edited(s: str, role: str) -> str:
    same = f"ini = '{role[0]}'"
    cell = CELL.format(c=f"{s}.c + CASE WHEN {same} THEN 0 ELSE 3 END + CASE WHEN trunc THEN 3 ELSE 0 END", a=f"{s}.a || CASE WHEN {same} THEN 'K' ELSE 'R' END", t=f"{s}.t || chr(10) || CASE WHEN {same} THEN role ELSE '{role}' END || ':' || text")
    return f"CASE WHEN {s} IS NOT NULL AND NOT must THEN {cell} END"


def _gone(s: str) -> str:
    return f"CASE WHEN {s} IS NOT NULL THEN " + CELL.format(c=f"{s}.c + 4", a=f"{s}.a || 'D'", t=f"{s}.t") + " END"


REPAIR_SQL = f"""
WITH RECURSIVE bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295], [CAST(ord(x) AS BIGINT) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, bits),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) FROM marked WHERE k > 0)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
firsts AS (SELECT *, n > min(n) OVER (PARTITION BY conv_id, role, text) AS again FROM numbered),
flagged AS (
  SELECT *, substr(role, 1, 1) AS ini, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS trunc, bare = '' OR again AS must,
    coalesce(lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au'), FALSE) AS illegal FROM firsts),
fold AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {CELL.format(c="CAST(0 AS BIGINT)", a="''", t="''")} AS e, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS u, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS a FROM (SELECT DISTINCT conv_id FROM damaged)
  UNION ALL
  SELECT conv_id, n, {_gone("e")}, {_least(_gone("s"), f"CASE WHEN ini = 's' THEN {_edited('e', 'system')} END")}, {_least(_gone("iu"), *[_edited(x, "user") for x in "esa"], _edited("ia", "user"))}, {_least(_gone("ia"), _edited("iu", "assistant"))}
  FROM (SELECT g.*, {_least("f.u", *[_inserted(f"f.{x}", "user") for x in "esa"])} AS iu, {_least("f.a", _inserted("f.u", "assistant"))} AS ia, f.e, f.s, f.a FROM fold f JOIN flagged g ON g.conv_id IS NOT DISTINCT FROM f.conv_id AND g.n = f.n + 1)),
done AS (SELECT conv_id, {_least("e", "a", _inserted("u", "assistant"))} AS best FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (illegal) AS illegal FROM flagged GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _probability(n: str, total: str) -> str:
    return f"CAST(1 + (CAST({SCALE} AS HUGEINT) * ({n} + 2)) // ({total} + 2 * v) AS HUGEINT)"


SOURCES_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
e AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_TERM_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
counts AS (SELECT lang, source, term, count(*) AS n FROM e JOIN (SELECT lang, term FROM kept) USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2),
groups AS (SELECT g.lang, g.source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN totals USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_probability("coalesce(c.n, 0)", "g.total")} AS p, {_probability("k.n", "l.total")} AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS f FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(f AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item) AS INTEGER) AS rank FROM parts QUALIFY part = 'pair' OR rank <= {TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": WARC_SQL, "op7_line_dedup": LINES_SQL, "op11_chat_repair": REPAIR_SQL, "op12_source_audit": SOURCES_SQL}
