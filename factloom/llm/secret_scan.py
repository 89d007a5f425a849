"""Secret scan over an incremental blob ledger, in DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its text. The ledger, a Parquet table, holds the
findings of each (blob, rule version) pair scanned so far, pairs without a finding too. A run scans the blobs
that the ledger lacks for its rule version, one copy of each, appends what it found, and joins the findings
back to all paths that have the blob.

Defined cases: a null text counts as empty; an empty text has no spans; equal versions share one scan; rows
with a null path are scanned and returned; repeated rows come back repeated; paths may be of any type that can be
compared. Other columns pass through, own ones named blob or spans as <name>_own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Workspace, by_ids, packed, put_aside, unpacked


@dataclass(frozen=True)
class Rule:
    """kind; Java pattern; the capture group whose length counts; the least length; what a text must match to be tried."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str | None = None


#: The base kinds. A pattern that would hit at most letters names its least length, which finds the same runs.
BASE_RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
#: What the method adds.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, ".eyJ"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "2"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Matches that are summed up one by one; a text of more has its sums put together from blocks of so many.
BLOCK = 128


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule, leftmost and non-overlapping, in code points.

    The text between the matches (split) and the matches themselves give each start as a running sum of lengths.
    """
    pattern = F.lit(rule.pattern)
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else hits
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    empty = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["hit"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), (x["counted"] >= rule.least).alias("ok")))).alias("out"))

    def spans(found: Column) -> Column:
        # arrays grow inside a block only, so that the time is in proportion to the matches
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(found, k * BLOCK + 1, F.lit(BLOCK)), zero, step))
        return F.transform(F.array(blocks), lambda b: F.flatten(F.zip_with(b, offsets(b), moved)))[0]

    def offsets(blocks: Column) -> Column:
        begin = F.array(F.lit(0))
        return F.aggregate(blocks, begin, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])), lambda acc: F.slice(acc, F.lit(1), F.size(blocks)))

    def moved(block: Column, by: Column) -> Column:
        span = lambda s: F.struct((s["start"] + by).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (s["end"] + by).alias("end"))
        return F.transform(F.filter(block["out"], lambda s: s["ok"]), span)

    found = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), counted.alias("counted"))
    found = F.transform(F.array(F.filter(found, lambda x: x["hit"].isNotNull())), spans)[0]
    tried = text.rlike(rule.pattern) if rule.hint is None else text.contains(rule.hint) & text.rlike(rule.pattern)
    return F.when(tried, found).otherwise(F.array().cast(SPAN))


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then by the rule's place in the list."""
    return F.array_sort(F.concat(*[rule_spans(text, r, i) for i, r in enumerate(rules)]))


def render_spans(spans: Column) -> Column:
    """kind:start:end, joined by commas; end is exclusive."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_versions(spark: SparkSession, versions: DataFrame, path: str = "path", text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """versions with the columns blob and spans; scans only blobs that the ledger at that path lacks.

    Without a ledger a new one is begun in the shared folder.
    """
    work = Workspace(spark, "secrets")
    ledger = ledger or f"{work.path}/ledger"
    versions = put_aside(versions, "blob", "spans")
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = versions.select(packed(versions), F.col(f"`{path}`").alias("path"), content.alias("text"), F.sha2(content, 256).alias("blob"))
    unseen = named.groupBy("blob").agg(F.min("path").alias("path"))
    known = _read_ledger(spark, ledger)
    if known is not None:
        unseen = unseen.join(known.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    # one path stands for each blob, so no text is shuffled to find the copies; a blob of null paths only has its own way
    unseen = work.table(unseen.select("path", F.xxhash64("blob").alias("key")), "unseen")
    todo = named.select("path", F.xxhash64("blob").alias("key"), "blob", "text")
    one = by_ids(todo.filter("path is not null"), unseen.filter("path is not null"), ["path", "key"], "left_semi")
    nameless = by_ids(todo.filter("path is null"), unseen.filter("path is null").select("key").distinct(), "key", "left_semi").dropDuplicates(["blob"])
    scanned = one.unionByName(nameless.select(*one.columns)).select("blob", F.lit(rule_version).alias("rule_version"), find_spans(F.col("text"), rules).alias("spans"))
    scanned.write.mode("append").parquet(ledger)
    work.drop("unseen")
    findings = spark.read.schema(scanned.schema).parquet(ledger).filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
    findings = findings.groupBy("blob").agg(F.first("spans").alias("spans"))  # repeated rows may have been scanned twice
    return named.join(findings, "blob", "left").select(*unpacked(versions), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(f"blob string, rule_version string, spans {SPAN}").parquet(ledger)


def secret_report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """The digest of op3: counts and spans per document."""
    found = scan_versions(docs.sparkSession, docs.select("doc_id", "text"), "doc_id", ledger=ledger)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(render_spans(base), 256).alias("base_sha256"),
        render_spans(F.col("spans")).alias("spans"),
    )
