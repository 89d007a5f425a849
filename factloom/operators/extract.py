"""Dictionary extraction: products to label/value facts.

The dictionary is compiled into one projection per label: no explode, no shuffle, and patterns that are literals.
extract_with_table does the same for dictionaries that are rows of a table, one for each shop.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import patterns as P
from factloom.functions import text as T
from factloom.functions.dictionary import DEFAULT_DICTIONARY, Group, dictionary_for, normalize_py, stopword_set, term_base, term_kind
from factloom.functions.joins import sized_join

FACTS = "array<struct<k:string,v:string>>"
EMPTY = "array<string>"


def measurements(cased: Column) -> Column:
    """Chained, then named dimensions; bare numbers with a unit only where neither is found."""

    def named(hit: Column) -> Column:
        name, number, unit = (F.regexp_extract(hit, P.NAMED_PARTS, k) for k in (1, 2, 3))
        label = T.let(name, lambda n: F.when(F.length(n) == 1, n).otherwise(F.lower(n)))
        return F.trim(F.concat_ws(" ", label, number, unit))

    chained = F.when(cased.rlike(P.CHAINED), F.regexp_extract_all(cased, F.lit(P.CHAIN), F.lit(0))).otherwise(F.array().cast(EMPTY))
    hits = F.concat(chained, F.transform(F.regexp_extract_all(cased, F.lit(P.NAMED), F.lit(0)), named))
    bare = F.regexp_extract_all(cased, F.lit(P.BARE), F.lit(0))
    # bound once: what a condition and its branch name would be searched for twice
    return F.when(cased.rlike(r"\d"), T.let(hits, lambda h: F.when(F.size(h) > 0, h).otherwise(bare))).otherwise(F.array().cast(EMPTY))


def counted(text: Column, base: str) -> Column:
    numbers = F.regexp_extract_all(text, F.lit(P.count_pattern(base)), F.lit(1))
    return F.transform(numbers, lambda n: F.concat(n, F.lit(f" {base}")))


def is_stop(word: Column, stops: list[str]) -> Column:
    """Whether a captured word is a stopword: it has lower-case letters, digits and hyphens only, so only marks are left to fold."""
    listed = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in stops)
    return T.sql_let(word, "w", f"translate(w, '{T.FOLDED}', '{T.FOLDED_TO}') IN ({listed})") if stops else F.lit(False)


def trim_phrase(words: Column, stops: list[str]) -> Column:
    """Words without the stopwords at both ends, as a phrase without punctuation at its ends."""
    kept = F.transform(words, lambda w: (w != "") & ~is_stop(w, stops))

    def between(kept: Column) -> Column:
        first, back = F.array_position(kept, F.lit(True)), F.array_position(F.reverse(kept), F.lit(True))
        inner = F.slice(words, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(words) - back - first + 2, F.lit(0)).cast("int"))
        return F.when(first > 0, F.array_join(inner, " ")).otherwise("")

    phrase = T.let(kept, between)
    return F.regexp_replace(phrase, r"^[\s,.;:-]+|[\s,.;:-]+$", "")


def usable_phrase(phrase: Column, stops: list[str]) -> Column:
    bad = F.exists(F.split(F.trim(phrase), " +"), lambda w: is_stop(w, stops) | T.looks_like_identifier(w))
    return (F.trim(phrase) != "") & ~phrase.rlike(r"^[\d\s.,-]+$") & ~bad


def captured_phrase(captured: Column, stops: list[str]) -> Column:
    """What words after a term say; null where they don't read as an attribute."""

    def said(words: Column) -> Column:
        return F.when(~is_stop(words[0], stops) & ~words[0].rlike(r"^\d"), T.let(trim_phrase(words, stops), lambda p: F.when(usable_phrase(p, stops), p)))

    return T.let(F.split(F.trim(captured), " +"), said)


def prefix_capture(text: Column, base: str, stops: list[str]) -> Column:
    """The one to three words after a term, where they read as an attribute."""
    words = F.transform(F.regexp_extract_all(text, F.lit(P.prefix_pattern(base)), F.lit(1)), lambda c: F.split(F.trim(c), " +"))
    words = F.filter(words, lambda w: ~is_stop(w[0], stops) & ~w[0].rlike(r"^\d"))
    phrases = F.filter(F.transform(words, lambda w: trim_phrase(w, stops)), lambda p: usable_phrase(p, stops))
    return F.transform(phrases, lambda p: F.concat(F.lit(f"{base} "), p))


def plain_term(text: Column, term: str, base: str) -> Column:
    found = text.rlike(P.plain_pattern(base))
    sure = P.sure_part(base)
    if sure:  # letters in a row that aren't written otherwise: a cheap test for them rules most texts out
        found = text.contains(sure) & found
    return F.when(found, F.array(F.lit(term))).otherwise(F.array().cast(EMPTY))


def group_hits(text: Column, cased: Column, group: Group, stops: list[str]) -> Column:
    """All hits of a label in the order of its terms."""
    parts = []
    for term in group.terms:
        kind, base = term_kind(term), term_base(term)
        if kind == "measure":
            parts.append(measurements(cased))
        elif not base or kind == "plain" and normalize_py(base) in stops:
            continue
        elif kind == "count":
            parts.append(counted(text, base))
        elif kind == "prefix":
            parts.append(prefix_capture(text, base, stops))
        else:
            parts.append(plain_term(text, term, base))
    return F.concat(*parts) if parts else F.array().cast(EMPTY)


#: Of hits: the first spelling of each normal form, without those inside a longer one.
DISTINCT_SQL = f"""
transform(array(transform(hits, h -> named_struct('raw', h, 'norm', {T.fold_sql("h")}))), pairs -> transform(array(transform(pairs, p -> p.norm)), norms ->
  transform(filter(pairs, (p, i) -> p.norm <> '' AND array_position(norms, p.norm) = i + 1 AND NOT exists(norms, n -> length(n) > length(p.norm) AND contains(n, p.norm))), p -> p.raw))[0])[0]
"""


def distinct_hits(hits: Column) -> Column:
    """First spelling of each normal form, without those inside a longer one."""
    return T.sql_let(hits, "hits", DISTINCT_SQL)


def label_value(hits: Column, group: Group, max_values: int) -> Column:
    """The label's value, its default, or null."""
    kept = F.array_join(F.slice(distinct_hits(hits), 1, max_values), ", ")
    if max_values > 0 and all(term_kind(t) != "plain" or re.search("[0-9A-Za-z]", t) for t in group.terms):
        # each hit has a letter or digit, so it has a normal form, and one alone is all there is to say
        kept = F.when(F.size(hits) == 0, "").when(F.size(hits) == 1, hits[0]).otherwise(kept)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(group.fallback or None).cast("string"))


def extract(products: DataFrame, dictionary: str | None = None, extra_stopwords: tuple[str, ...] = (), max_values: int = 4, title: str = "title", body: str = "description_html") -> DataFrame:
    """products with facts, array<struct<k,v>> in dictionary order."""
    groups, stops = dictionary_for(dictionary), stopword_set(extra_stopwords)
    prepared = products.withColumn("__cased", T.prepare_cased(F.col(title), F.col(body))).withColumn("__text", F.lower("__cased"))
    hit = prepared.withColumns({f"__h{i}": group_hits(F.col("__text"), F.col("__cased"), g, stops) for i, g in enumerate(groups)})
    valued = hit.withColumns({f"__v{i}": label_value(F.col(f"__h{i}"), g, max_values) for i, g in enumerate(groups)})
    # put together without a lambda, which would have all that it is given computed outside of generated code
    none = F.array().cast(FACTS)
    facts = [F.when(F.col(f"__v{i}").isNotNull(), F.array(F.struct(F.lit(g.label).alias("k"), F.col(f"__v{i}").alias("v")))).otherwise(none) for i, g in enumerate(groups)]
    return valued.withColumn("facts", F.concat(none, *facts)).drop("__cased", "__text", *[f"__{c}{i}" for c in "hv" for i in range(len(groups))])


# ---------------------------------------------------------------- dictionaries as rows

#: Letters and digits in a row: what a term's key is made of.
TOKEN = rf"{P.LETTER}+"
#: Words before a term that are looked at, and beyond its own after it.
BEFORE, AFTER = 4, 4


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{T.WS}]+|[{T.WS}]+$", "")


def dictionary_rows(settings: DataFrame, extra_stopwords: tuple[str, ...] = ()) -> DataFrame:
    """Terms (shop, group_ord, label, fallback, term_ord, kind, term, base) of dictionaries (shop, raw), as parse_dictionary reads them.

    Blank and null dictionaries are the default one. A label without usable terms has a row of kind none, for its default.
    """
    raw = F.coalesce(F.nullif(_stripped(F.col("raw")), F.lit("")), F.lit(DEFAULT_DICTIONARY))
    line = settings.select("shop", F.posexplode(F.split(raw, "\r\n|\r|\n")).alias("ord", "line")).filter(F.col("line").contains(":"))
    body, options = _stripped(F.split("line", r"\|", 2)[0]), F.try_element_at(F.split("line", r"\|", 2), F.lit(2))
    label, rest = _stripped(F.split(body, ":", 2)[0]), F.try_element_at(F.split(body, ":", 2), F.lit(2))
    terms = F.filter(F.transform(F.split(rest, ","), _stripped), lambda t: t != "")
    fallback = _stripped(F.regexp_extract(_stripped(F.coalesce(options, F.lit(""))), r"(?i)default\s*:\s*(.+)$", 1))
    line = line.select("shop", "ord", label.alias("label"), F.struct(terms.alias("terms"), fallback.alias("fallback")).alias("said")).filter((F.col("label") != "") & (F.size("said.terms") > 0))
    groups = line.groupBy("shop", "label").agg(F.min("ord").alias("group_ord"), F.max_by("said", "ord").alias("said"))
    each = groups.select("shop", "group_ord", "label", "said.fallback", F.posexplode("said.terms").alias("term_ord", "term"))
    kind = F.when(F.lower("term") == "#size", "measure").when(F.col("term").startswith("*"), "count").when(F.col("term").endswith("*"), "prefix").otherwise("plain")
    each = each.withColumns({"kind": kind, "base": _stripped(F.regexp_replace("term", r"^\*+|\*+$", ""))})
    stops = T.words_column(stopword_set(extra_stopwords))
    idle = (F.col("base") == "") | (F.col("kind") == "plain") & F.array_contains(stops, T.fold_plain(F.regexp_replace("base", "<[^>]*>", " ")))
    return each.withColumn("kind", F.when((F.col("kind") != "measure") & idle, "none").otherwise(F.col("kind")))


def colliding_rows(settings: DataFrame) -> DataFrame:
    """Plain terms (shop, label, term) of dictionaries (shop, raw, extra) that are stopwords, or among the shop's extra ones a line or comma apart."""
    terms = dictionary_rows(settings).filter((F.col("kind") == "plain") | (F.col("kind") == "none") & (F.col("base") != "") & ~F.col("term").contains("*"))
    own = settings.select("shop", F.transform(F.split(F.coalesce("extra", F.lit("")), "[\n,]"), T.fold_plain).alias("own"))
    norm, stops = T.fold_plain(F.regexp_replace("base", "<[^>]*>", " ")), T.words_column(stopword_set())
    hit = (F.col("kind") == "none") | F.array_contains(stops, norm) | (norm != "") & F.array_contains("own", norm)
    return sized_join(terms, own, "shop").filter(hit).select("shop", "label", "term")


def dictionary_table(spark: SparkSession, dictionaries: dict[str, str]) -> DataFrame:
    """dictionary_rows of dictionaries that the driver has."""
    return dictionary_rows(spark.createDataFrame(list(dictionaries.items()), "shop string, raw string"))


def _unmarked(x: Column) -> Column:
    return F.translate(x, P.MARKED, P.UNMARKED)


def _places(texts: DataFrame, reach: int) -> DataFrame:
    """A row for each place of texts (key, shop, text) where letters begin: word number and offset, the words before and from there on."""

    def around(words: Column) -> Column:
        before = lambda j: F.array_join(F.slice(words, F.greatest(j - BEFORE + 1, F.lit(1)), F.least(j, F.lit(BEFORE))), " ")
        return F.transform(words, lambda _, j: F.struct(j.alias("word"), before(j).alias("before"), F.array_join(F.slice(words, j + 1, reach), " ").alias("here")))

    words = texts.select("key", "shop", F.explode(T.let(F.split("text", " "), around)).alias("w")).select("key", "shop", "w.*")
    words = words.withColumn("before", F.when(F.col("word") == 0, "").otherwise(F.concat("before", F.lit(" "))))
    return words.withColumn("first", F.split("here", " ", 2)[0])


def _from(places: DataFrame, offset: Column) -> DataFrame:
    """Places at an offset of their word: before has what stands before it, here begins with it."""
    moved = places.withColumn("offset", offset)
    return moved.withColumns({"before": F.concat("before", F.substr("first", F.lit(1), F.col("offset"))), "here": F.substr("here", F.col("offset") + 1)})


def _starts(word: Column) -> Column:
    """Where letters begin in a word."""

    def of(heads: Column) -> Column:
        end = lambda i: F.length(F.array_join(F.slice(heads, 1, i + 1), ""))
        return F.transform(heads, lambda h, i: end(i) - F.length(F.regexp_extract(h, TOKEN, 0)))

    return T.let(F.regexp_extract_all(word, F.lit(rf"[^\p{{L}}\p{{N}}]*{TOKEN}"), F.lit(0)), of)


def _candidates(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Places of texts with the terms whose letters begin there: an equal join on the shop and the letters in a row, as many as terms have."""
    folded = _unmarked(F.lower("base"))
    terms = terms.filter(F.col("kind").isin("plain", "count", "prefix")).withColumn("folded", folded)
    tokens = F.regexp_extract_all("folded", F.lit(TOKEN), F.lit(0))
    terms = terms.withColumns({"gram": F.array_join(tokens, " "), "size": F.size(tokens), "lead": F.length(F.regexp_extract("folded", r"^([^\p{L}\p{N}]*)[\p{L}\p{N}]", 1))})
    terms = terms.select("shop", "group_ord", "term_ord", "kind", "term", "base", "folded", "gram", "size", "lead")
    shape = terms.agg(F.sort_array(F.collect_set("size")).alias("sizes"), F.max(F.size(F.split("folded", " "))).alias("words")).first()
    places = _places(texts, (shape["words"] or 1) + AFTER)
    sizes = [n for n in shape["sizes"] if n]
    each = _from(places.withColumn("offset", F.explode(_starts(F.col("first")))), F.col("offset"))
    grams = lambda run: F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.size(run)), lambda n: F.array_join(F.slice(run, 1, n), " "))
    run = F.regexp_extract_all(_unmarked(F.col("here")), F.lit(TOKEN), F.lit(0))
    found = each.select("key", "shop", "word", "offset", "before", "here", F.explode(T.let(run, grams) if sizes else F.array().cast(EMPTY)).alias("gram"))
    found = sized_join(found, terms.filter("size > 0"), ["shop", "gram"])
    if 0 in shape["sizes"]:  # terms without letters, as a sign after a number: looked for once a word
        signs = sized_join(places, terms.filter("size = 0"), "shop").withColumn("at", F.instr("first", F.split("folded", " ", 2)[0]) - 1).filter("at >= 0")
        found = found.unionByName(_from(signs, F.col("at")).select(*found.columns))
    return found


def _hits(texts: DataFrame, terms: DataFrame, stops: list[str]) -> DataFrame:
    """(key, hits): by label, term and place, what each hit says (null: nothing), and where the next of its term may begin."""
    lead, here, base = F.col("lead"), F.col("here"), F.col("base")
    fits = F.startswith(_unmarked(here), F.substr("folded", lead + 1)) & F.endswith(_unmarked(F.col("before")), F.substr("folded", F.lit(1), lead))
    found = _candidates(texts, terms).filter(fits)
    length = F.length("folded") - lead
    found = found.withColumns({"before": F.substr("before", F.lit(1), F.length("before") - lead), "after": F.substr(here, length + 1)})
    free = ~F.col("before").rlike(rf"{P.LETTER}\z")
    plain = free & ~F.col("after").rlike(f"^{P.LETTER}") & ~F.col("after").rlike(f"^ ?-? ?(?:{P.QUALIFIER_AFTER}){P.END}") & ~F.col("before").rlike(rf"(?:{P.QUALIFIER_BEFORE}) ?\z")
    number = F.when(~F.col("after").rlike(f"^{P.LETTER}"), F.regexp_extract("before", rf"{P.BEGIN}(\d+) \z", 1)).otherwise("")
    phrase = F.when(free, F.regexp_extract("after", P.CAPTURED, 1)).otherwise("")
    kind = F.col("kind")
    got = F.when(kind == "plain", F.when(plain, F.col("term"))).when(kind == "count", F.nullif(number, F.lit(""))).otherwise(F.nullif(phrase, F.lit("")))
    found = found.withColumn("got", got).filter("got is not null")
    # the words from the place on that a match takes; of a plain term one hit is enough
    took = F.when(kind == "prefix", F.concat(F.substr(here, F.lit(1), length + 1), F.col("got"))).otherwise(F.substr(here, F.lit(1), length))
    spaces = F.length(took) - F.length(F.replace(took, F.lit(" "), F.lit("")))
    stop_word = F.when(kind == "plain", 1 << 30).otherwise(F.col("word") + spaces)
    stop_offset = F.when(spaces == 0, F.col("offset") + F.length(took)).otherwise(F.length(F.substring_index(took, " ", -1)))
    says = F.when(kind == "plain", F.col("got")).when(kind == "count", F.concat_ws(" ", "got", base)).otherwise(F.concat(base, F.lit(" "), captured_phrase(F.col("got"), stops)))
    # a match of a count begins with its number
    number_at = F.length(F.substring_index(F.rtrim("before"), " ", -1)) - F.length("got")
    starts = F.struct(F.when(kind == "count", F.col("word") - 1).otherwise(F.col("word")).alias("word"), F.when(kind == "count", number_at).otherwise(F.col("offset") - lead).alias("offset"))
    hit = F.struct("group_ord", "term_ord", starts.alias("start"), F.struct(stop_word.cast("int").alias("word"), stop_offset.alias("offset")).alias("stop"), says.alias("says"))
    return found.groupBy("key").agg(F.sort_array(F.collect_list(hit)).alias("hits"))


def _apart(hits: Column) -> Column:
    """The hits that don't begin inside an earlier one of their term, as (group_ord, term_ord, nth, says)."""
    none = F.struct(F.lit(-1).alias("group_ord"), F.lit(-1).alias("term_ord"), F.lit(0).alias("word"), F.lit(0).alias("offset"), F.array().cast("array<struct<group_ord:int,term_ord:int,nth:int,says:string>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        other = (acc["group_ord"] != h["group_ord"]) | (acc["term_ord"] != h["term_ord"])
        taken = other | (h["start"] >= F.struct(acc["word"].alias("word"), acc["offset"].alias("offset")))
        one = F.array(F.struct(h["group_ord"].alias("group_ord"), h["term_ord"].alias("term_ord"), F.size(acc["out"]).alias("nth"), h["says"].alias("says")))
        new = F.struct(h["group_ord"].alias("group_ord"), h["term_ord"].alias("term_ord"), h["stop"]["word"].alias("word"), h["stop"]["offset"].alias("offset"), F.concat(acc["out"], one).alias("out"))
        return F.when(taken, new).otherwise(acc)

    return F.aggregate(hits, none, step, lambda acc: acc["out"])


def extract_with_table(products: DataFrame, terms: DataFrame, max_values: int = 4, title: str = "title", body: str = "description_html", key: str = "id", shop: str = "shop") -> DataFrame:
    """(key, facts) by the dictionary of each product's shop, rows of terms.

    Each place of a text where letters begin is joined with the terms of the shop by the letters in a row there, so a
    text meets only the terms it may hold, however many the dictionaries have; contexts are looked at there alone.
    Keys are unique; a product of a null key, or of a shop without terms, gets no facts.
    """
    stops = stopword_set()
    cased = products.select(F.col(key).alias("key"), F.col(shop).alias("shop"), T.prepare_cased(F.col(title), F.col(body)).alias("cased"))
    hits = _hits(cased.select("key", "shop", F.lower("cased").alias("text")), terms, stops)
    group = F.struct("group_ord", "label", "fallback")
    shops = terms.groupBy("shop").agg(F.sort_array(F.collect_set(group)).alias("groups"), F.collect_list(F.when(F.col("kind") == "measure", F.struct("group_ord", "term_ord"))).alias("measured"))
    whole = sized_join(cased, shops, "shop", "left").withColumn("sizes", F.when(F.size("measured") > 0, measurements(F.col("cased"))))
    whole = whole.select("key", "groups", "measured", "sizes").join(hits, "key", "left")
    kind = "array<struct<group_ord:int,term_ord:int,nth:int,says:string>>"
    placed = lambda sizes: F.flatten(F.transform("measured", lambda m: F.transform(sizes, lambda x, i: F.struct(m["group_ord"].alias("group_ord"), m["term_ord"].alias("term_ord"), i.alias("nth"), x.alias("says")))))
    sizes = F.when(F.col("sizes").isNull(), F.array().cast(kind)).otherwise(T.let(F.col("sizes"), placed).cast(kind))
    every = F.sort_array(F.concat(sizes, F.coalesce(_apart(F.col("hits")), F.array().cast(kind))))

    def value(hits: Column, g: Column) -> Column:
        said = F.transform(F.filter(hits, lambda h: (h["group_ord"] == g["group_ord"]) & h["says"].isNotNull()), lambda h: h["says"])
        return F.coalesce(F.nullif(F.array_join(F.slice(distinct_hits(said), 1, max_values), ", "), F.lit("")), F.nullif(g["fallback"], F.lit("")))

    # bound once: an expression inside a lambda is computed for each element
    told = T.let(every, lambda hits: F.transform("groups", lambda g: F.struct(g["label"].alias("k"), value(hits, g).alias("v"))))
    facts = F.filter(told, lambda f: f["v"].isNotNull())
    return whole.select(F.col("key").alias(key), F.coalesce(facts, F.array().cast(FACTS)).alias("facts"))
