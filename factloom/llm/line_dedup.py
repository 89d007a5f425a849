"""Line dedup with a log-template tree, in DataFrame functions only.

A line is parsed to a fixed depth: its token count, then its leading tokens, tokens with a digit masked as <*>. That
is its leaf. The tokens after the leading ones fall into BANDS runs of nearly equal length. Two lines of a leaf fit
the same template if they agree on all but half of the bands, wherever those lie; what the bands left out hold are the
template's variable fields. So lines that differ in up to half as many fields as there are bands share a template,
fields of one band counting once, if the fields lie below the leaf and enough tokens are left. Lines that differ in a
word among the leading tokens are of different leaves and share none. A template with a variable band needs MIN_FIXED
unmasked tokens or more that are the same in all its lines, so that prose of a few common words isn't taken for a
template; without one, the lines are equal but for masked tokens, so short lines whose field is a word aren't found. (A sentence of which half the bands, and seven words or more, are
the same in three documents is a template here, whoever wrote it.) Each line is given the keys of all its templates, which makes the tree
independent of the order of lines. A template found in min_docs documents or more is boilerplate: its lines go from
every document but the one with the smallest doc_id.

Only lines of leaves that themselves occur in min_docs documents can recur, so the keys are made for those alone. All
groups are counted by aggregation with partial sums: no leaf, template or document group is collected anywhere.

With distinct_texts, which the pipeline sets, min_docs counts different texts: the copies of a text count as one
document, that of their smallest doc_id, and all of them keep or lose the same lines, so that they stay copies.
With long_tokens, which the pipeline sets too, a line of so many tokens or more that is found entirely equal, variable
tokens included, in two documents is boilerplate as well; min_docs holds for templates only.

Defined cases: a null text stays null and an empty text empty; lines of under min_tokens tokens always stay;
rows without doc_id count as documents but lose nothing, repeated rows count as documents and keep or lose the
same lines; a line repeated inside one document only stays; ties on doc_id both keep. Other columns pass through, own
ones named n_lines or n_dropped as <name>_own. Tokens and lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Workspace, packed, put_aside, unpacked, with_small

MIN_TOKENS = 5
LEADING_TOKENS = 3
MIN_DOCS = 3
#: Runs of tokens below a leaf, of which any half may be variable; tokens that a template with a variable run must fix.
BANDS, MIN_FIXED = 6, 7
#: Tokens from which on an equal line of two documents is a repeated passage.
LONG_TOKENS = 50
#: White space between tokens; a token with a digit, possessive, so that the engine tries each word once.
BLANK = " \t\x0b\f\r"
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*"
#: The bands that a template keeps: half of them, or one more, which matters where half of them have too few tokens.
KEPT = (*combinations(range(BANDS), BANDS // 2), *combinations(range(BANDS), BANDS // 2 + 1))


def masked(line: Column) -> Column:
    """A line with <*> for its tokens with a digit; most lines have none and are left as they are."""
    return F.btrim(F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line), F.lit(BLANK))


def parsed_line(line: Column, min_tokens: int = MIN_TOKENS, leading: int = LEADING_TOKENS, whole: Column | None = None) -> Column:
    """Leaf, hashes of the bands, number of tokens and of masked ones; null for a short line."""

    def of(shown: Column) -> Column:
        return F.transform(F.array(F.split(shown, f"[{BLANK}]+")), lambda toks: parse(toks, shown.contains("<*>")))[0]

    def parse(toks: Column, some: Column) -> Column:
        n = F.size(toks)
        cut = lambda k: leading + F.floor(k * (n - leading) / BANDS).cast("int")
        bands = F.array(*[F.xxhash64(F.slice(toks, cut(k) + 1, cut(k + 1) - cut(k))) for k in range(BANDS)])
        hidden = F.when(some, F.size(F.filter(toks, lambda t: t == "<*>"))).otherwise(0)
        fields = {"leaf": F.xxhash64(n, F.slice(toks, 1, leading)), "bands": bands, "n": n, "masked": hidden, "whole": F.lit(None).cast("bigint") if whole is None else whole}
        return F.when(n >= min_tokens, F.struct(*[v.alias(k) for k, v in fields.items()]))

    return F.transform(F.array(masked(line)), of)[0]


def template_keys(x: Column, leading: int = LEADING_TOKENS) -> Column:
    """Hashes of a parsed line's templates: the one without a variable band, and those with up to half of the bands variable."""
    size = lambda k: F.floor((k + 1) * (x["n"] - leading) / BANDS) - F.floor(k * (x["n"] - leading) / BANDS)
    keys = [F.xxhash64(F.lit(-1), x["leaf"], x["bands"])]
    for number, kept in enumerate(KEPT):
        fixed = F.lit(leading) - x["masked"]
        for k in kept:
            fixed = fixed + size(k)
        keys.append(F.when(fixed >= MIN_FIXED, F.xxhash64(F.lit(number), x["leaf"], *[x["bands"][k] for k in kept])))
    return F.array_compact(F.array(*keys))


def _one_of_copies(work: Workspace, parsed: DataFrame) -> DataFrame:
    """One row of each text, with the smallest doc_id of its copies."""
    least = F.min(F.struct(F.col("id").isNull(), "id", "at")).alias("m")
    copied = parsed.groupBy("row").agg(F.count("*").alias("n"), least).filter("n > 1")
    copied = work.table(copied.select("row", F.col("m.at").alias("one")), "copied")
    return with_small(parsed, copied, "row", "left", F.lit(16)).filter("one is null or one = at").drop("one")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, leading: int = LEADING_TOKENS, distinct_texts: bool = False, long_tokens: int | None = None) -> DataFrame:
    """docs with the recurring lines taken out of text, and the columns n_lines and n_dropped."""
    if leading >= min_tokens:
        raise ValueError("a template needs a token beyond the leading ones")
    work = Workspace(docs.sparkSession, "lines")
    docs = put_aside(docs, "n_lines", "n_dropped")
    given = docs.select(packed(docs, text), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(text).alias("row"))
    parse = lambda line: parsed_line(line, min_tokens, leading, None if long_tokens is None else F.xxhash64(F.trim(line)))
    parsed = given.filter("text is not null").select(F.monotonically_increasing_id().alias("at"), "id", "row", F.transform(F.split("text", "\n"), parse).alias("lines"))
    parsed = work.table(parsed, "parsed")  # one pass over the texts; all that follows reads hashes
    on = ["id", "row"]
    if distinct_texts:
        parsed, on = _one_of_copies(work, parsed), ["row"]
    once = lambda keys: F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))
    often = lambda each, least, name: work.table(each.groupBy("key").agg(F.count("*").alias("docs"), F.min("id").alias("first")).filter(F.col("docs") >= least).select("key", "first"), name)
    leaves = often(parsed.select("id", once(F.transform("lines", lambda x: x["leaf"])).alias("key")), min_docs, "leaves").select(F.col("key").alias("leaf"))
    lines = parsed.select("at", "id", "row", F.posexplode("lines").alias("line", "x")).filter("x is not null")
    here = with_small(lines.withColumn("leaf", F.col("x.leaf")), leaves, "leaf", "left_semi", F.lit(16))
    here = work.table(here.select("at", "id", "row", "line", template_keys(F.col("x"), leading).alias("keys")), "keys")
    # a document counts once for a key, however many of its lines have it
    each = here.select("at", "id", F.explode("keys").alias("key")).groupBy("key", "at").agg(F.min("id").alias("id"))
    found = [(here.select("id", "row", "line", F.explode("keys").alias("key")), often(each, min_docs, "common"))]
    if long_tokens is not None:
        long = lambda x: F.when(x["n"] >= max(long_tokens, min_tokens), x["whole"])
        each = parsed.select("id", once(F.transform("lines", long)).alias("key"))
        found.append((lines.select("id", "row", "line", long(F.col("x")).alias("key")).filter("key is not null"), often(each, 2, "passages")))
    dropped = None
    for placed, common in found:
        hit = with_small(placed, common, "key", "inner", F.lit(32)).filter("id > first").select(*on, "line")
        dropped = hit if dropped is None else dropped.unionByName(hit)
    dropped = work.table(dropped.groupBy(*on).agg(F.collect_set("line").alias("gone")), "dropped")
    work.drop("parsed", "copied", "leaves", "keys", "common", "passages")
    placed = given.withColumn("row", F.when(F.col("id").isNotNull(), F.col("row")))
    joined = with_small(placed, dropped, on, "left", 40 + 4 * F.size("gone"))
    left = lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), "gone"), lambda i: F.get(all_, i)), "\n")
    whole = F.split("text", "\n")
    return joined.select(
        *[c if name != text else F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.transform(F.array(whole), left)[0]).alias(text) for name, c in zip(docs.columns, _placed(docs, text), strict=True)],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(whole)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def _placed(docs: DataFrame, text: str) -> list[Column]:
    """The own columns of docs in their order, the text's place held by itself."""
    own = iter(unpacked(docs, text))
    return [F.col("text") if c == text else next(own) for c in docs.columns]
