"""Texts and documents derived from facts, row by row: no shuffle anywhere here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

#: Labels in the order in which they read naturally.
DESCRIPTIVE = (
    "material", "materials", "fabric", "finish", "finisaj", "cut", "silhouette", "shape", "style", "stil", "colour", "color", "culoare", "dimensions", "dimensiuni", "size", "weight",
    "capacity", "capacitate", "features", "functionality", "functionalitate", "room", "camera", "use", "occasion",
)
#: Labels that say how something looks, the most telling first.
VISUAL = (
    "material", "materials", "fabric", "finish", "finisaj", "cut", "silhouette", "shape", "style", "stil", "colour", "color", "culoare", "neckline", "sleeves", "back", "length", "size",
    "dimensions", "dimensiuni", "details", "pattern", "features",
)
BUSINESS = "struct<delivery_time:string,delivery_cost:string,delivery_cost_is_from:boolean,delivery_varies:boolean,return_days:int,warranty:string,payment_methods:string>"
QA = "array<struct<q:string,a:string>>"


def _said(x: Column) -> Column:
    """Whether an optional text is there."""
    return F.coalesce(x, F.lit("")) != ""


def labelled(facts: Column, *names: str) -> Column:
    """The last fact of the first of these labels that occurs."""

    def last(name: str) -> Column:
        return F.try_element_at(F.filter(facts, lambda f: F.lower(f["k"]) == name), F.lit(-1))

    return F.coalesce(*[last(n) for n in names])


def _ranked(facts: Column, order: tuple[str, ...]) -> Column:
    """(rank, place, fact), the rank being len(order) for other labels."""
    names = F.array(*map(F.lit, order))
    rank = lambda f: F.coalesce(F.nullif(F.array_position(names, F.lower(f["k"])), F.lit(0)) - 1, F.lit(len(order)))
    return F.array_sort(F.transform(facts, lambda f, i: F.struct(rank(f).alias("rank"), i.alias("i"), f.alias("f"))))


def ordered_facts(facts: Column) -> Column:
    return F.transform(_ranked(facts, DESCRIPTIVE), lambda x: x["f"])


def _price(price: Column, currency: Column) -> Column:
    return F.concat(price, F.when(_said(currency), F.concat(F.lit(" "), currency)).otherwise(""))


def summary(title: Column, body: Column, facts: Column, price: Column, currency: Column, available: Column, vendor: Column, product_type: Column, max_words: int = 80) -> Column:
    """One paragraph: what it is, its key details and its price."""
    opening = lambda opener: F.when(opener == "", F.concat(T.clean_output(title), F.lit(" is a "), F.when(_said(product_type), product_type).otherwise("product"), F.lit("."))).when(opener.endswith("."), opener).otherwise(F.concat(opener, F.lit(".")))
    first = T.let(T.first_sentence(body, 40), opening)
    clauses = F.transform(F.slice(ordered_facts(facts), 1, 4), lambda f: F.concat(F.lower(f["k"]), F.lit(": "), f["v"]))
    details = F.when(F.size(facts) > 0, F.concat(F.lit("Key details: "), F.array_join(clauses, "; "), F.lit(".")))
    brand = F.when(_said(vendor), F.concat(F.lit(" from "), vendor)).otherwise("")
    stock = F.when(available == F.lit(False), ", currently out of stock").otherwise("")
    cost = F.when(_said(price), F.concat(F.lit("Priced at "), _price(price, currency), brand, stock, F.lit(".")))
    return T.first_words(T.clean_output(F.concat_ws(" ", first, details, cost)), max_words)


def questions(title: Column, facts: Column, price: Column, currency: Column, available: Column, business: Column | None = None, most: int = 8) -> Column:
    """Questions that the facts answer, array<struct<q, a>>."""
    title = T.clean_output(title)

    def ask(when: Column, before: str, after: str, answer: Column) -> Column:
        return F.when(when, F.struct(F.concat(F.lit(before), title, F.lit(after)).alias("q"), answer.alias("a")))

    def from_fact(fact: Column, before: str, after: str, unless: Column | None = None) -> Column:
        found = fact.isNotNull() if unless is None else fact.isNotNull() & ~unless
        return ask(found, before, after, F.concat(fact["v"], F.lit(".")))

    seats, includes = labelled(facts, "seats", "locuri"), labelled(facts, "includes", "continut", "set")
    stock = F.when(available == F.lit(False), ", currently out of stock").otherwise("")
    asked = [
        from_fact(labelled(facts, "material", "materials", "fabric"), "What is ", " made of?"),
        from_fact(labelled(facts, "dimensions", "dimensiuni", "size"), "What are the dimensions of ", "?"),
        from_fact(seats, "How many people does ", " seat?"),
        from_fact(includes, "What does ", " include?"),
        from_fact(labelled(facts, "capacity", "capacitate"), "What does ", " include or seat?", seats.isNotNull() | includes.isNotNull()),
        ask(_said(price), "How much does ", " cost?", F.concat(_price(price, currency), stock, F.lit("."))),
        from_fact(labelled(facts, "room", "camera", "occasion"), "Where is ", " used?"),
    ]
    if business is not None:
        b = business
        starting = F.when(F.coalesce(b["delivery_cost_is_from"], F.lit(False)), "from ").otherwise("")
        cost = F.when(_said(b["delivery_cost"]), F.concat(F.lit(" Delivery costs "), starting, b["delivery_cost"], F.lit("."))).otherwise("")
        asked += [
            ask(_said(b["delivery_time"]) & ~F.coalesce(b["delivery_varies"], F.lit(False)), "How long does delivery take for ", "?", T.clean_output(F.concat(b["delivery_time"], F.lit("."), cost))),
            ask(F.coalesce(b["return_days"], F.lit(0)) > 0, "Can I return ", "?", F.concat(F.lit("Yes, within "), b["return_days"].cast("string"), F.lit(" days."))),
            ask(_said(b["warranty"]), "What warranty does ", " have?", T.clean_output(F.concat(b["warranty"], F.lit(".")))),
            F.when(_said(b["payment_methods"]), F.struct(F.lit("How can I pay?").alias("q"), T.clean_output(F.concat(b["payment_methods"], F.lit("."))).alias("a"))),
        ]
    return F.slice(F.filter(F.array(*asked), lambda x: x.isNotNull()), 1, most)


def fit_for(facts: Column) -> Column:
    """Who or where it suits."""
    return F.concat_ws("; ", labelled(facts, "room", "camera")["v"], labelled(facts, "occasion", "use", "suited to")["v"])


def visual_values(facts: Column) -> Column:
    """Values that say how something looks, the most telling first."""
    return F.transform(F.filter(_ranked(facts, VISUAL), lambda x: x["rank"] < len(VISUAL)), lambda x: x["f"]["v"])


def alt_text(title: Column, facts: Column, position: Column) -> Column:
    """Alternative text of the image at a position (0 is the main one): other facts lead at other positions."""
    return alt_of(T.clean_output(title), visual_values(facts), position)


def alt_of(base: Column, visual: Column, position: Column) -> Column:
    """alt_text of a clean title and its visual values, which are the same for all images of a product."""

    def described(values: Column) -> Column:
        at = F.pmod(position, F.greatest(F.size(values), F.lit(1)))
        rotated = F.concat(F.slice(values, at + 1, F.size(values)), F.slice(values, F.lit(1), at))
        first = F.transform(rotated, lambda v: F.trim(F.split(v, ",")[0]))
        return F.array_join(F.slice(F.filter(first, lambda d: (d != "") & ~F.exists(F.split(d, r"\s+"), T.looks_like_identifier)), 1, 2), ", ")

    detail = T.let(visual, described)
    view = F.when(position == 0, "").otherwise(F.concat(F.lit(", view "), (position + 1).cast("string")))
    shown = T.let(detail, lambda d: F.when(d == "", "").otherwise(F.concat(F.lit(" - "), d)))
    return T.truncate(F.concat(base, shown, view))


def image_report(images: DataFrame, title: str = "title", facts: str = "facts", alt: str = "alt", position: str = "position") -> DataFrame:
    """images with state (missing, filename or written) and a suggestion."""
    state = T.let(F.trim(F.coalesce(F.col(alt), F.lit(""))), lambda own: F.when(own == "", "missing").when(T.looks_like_machine_alt(own), "filename").otherwise("written"))
    return images.withColumns({"state": state, "suggestion": alt_text(F.col(title), F.col(facts), F.col(position))})


def answer_preview(title: Column, facts: Column, summary_text: Column, qa: Column, price: Column, currency: Column) -> Column:
    """struct<question, with_app, without_app, sources>; null without facts and summary."""
    title = T.clean_output(title)
    material, size = labelled(facts, "material", "materials", "fabric", "materiale"), labelled(facts, "dimensions", "dimensiuni", "size", "marime")
    colour = labelled(facts, "colour", "color", "culoare")
    question = F.when(material.isNotNull(), F.concat(F.lit("What is "), title, F.lit(" made of, and what size is it?"))).otherwise(F.concat(F.lit("Tell me about "), title, F.lit(".")))
    details = F.array_compact(F.array(F.concat(F.lit("made of "), material["v"]), size["v"], F.concat(F.lit("in "), colour["v"])))
    told = F.when(_said(summary_text), T.clean_output(summary_text)).when(F.size(details) > 0, T.clean_output(F.concat(title, F.lit(" is "), F.array_join(details, ", "), F.lit("."))))
    said = F.lower(F.coalesce(told, F.lit("")))
    bare = lambda a: F.regexp_replace(F.coalesce(a, F.lit("")), r"\.$", "")
    new = lambda x: (F.trim(F.coalesce(x["a"], F.lit(""))) != "") & ~F.contains(F.lower(x["q"]), F.lit("made of")) & (F.trim(bare(x["a"])) != "") & ~F.contains(said, F.lower(F.trim(bare(x["a"]))))
    extra = F.try_element_at(F.filter(F.coalesce(qa, F.array().cast(QA)), new), F.lit(1))
    more = F.when(extra.isNotNull(), T.clean_output(F.concat(bare(extra["a"]), F.lit("."))))
    alone = F.when(_said(price), F.concat(title, F.lit(", "), _price(price, currency), F.lit("."))).otherwise(F.concat(title, F.lit(".")))
    sources = F.array_compact(F.array(F.when(_said(summary_text), "summary"), material["k"], size["k"], colour["k"], F.when(extra.isNotNull(), "questions")))
    out = F.struct(
        question.alias("question"),
        F.trim(F.concat_ws(" ", told, more)).alias("with_app"),
        T.clean_output(F.concat(alone, F.lit(" No stated material, size or colour an assistant could compare."))).alias("without_app"),
        F.array_distinct(sources).alias("sources"),
    )
    return F.when((F.size(facts) > 0) | _said(summary_text), out)


def mirror(title: Column, url: Column, description: Column, summary_text: Column, facts: Column, price: Column, currency: Column, available: Column, vendor: Column, sku: Column | None = None, updated_at: Column | None = None) -> Column:
    """The product as Markdown with front matter."""
    none = F.lit(None).cast("string")
    sku, updated_at = none if sku is None else sku, none if updated_at is None else updated_at
    head = lambda name, x: F.when(_said(x), F.concat(F.lit(f"{name}: "), T.yaml_escape(x)))
    title = T.clean_output(title)
    rows = F.transform(facts, lambda f: F.concat(F.lit("| "), T.clean_output(f["k"]), F.lit(" | "), T.clean_output(f["v"]), F.lit(" |")))
    table = F.when(F.size(facts) > 0, F.concat(F.lit("| Attribute | Value |\n| --- | --- |\n"), F.array_join(rows, "\n"), F.lit("\n")))
    told = F.when(_said(description), F.concat(F.lit("## Description\n\n"), T.clean_output(F.regexp_replace(description, "<[^>]*>", " ")), F.lit("\n")))
    lines = [
        F.lit("---"),
        F.concat(F.lit("title: "), T.yaml_escape(title)),
        F.concat(F.lit("url: "), T.yaml_escape(url)),
        head("brand", F.when(_said(vendor), T.clean_output(vendor))),
        head("sku", sku),
        head("price", F.when(_said(price), F.trim(F.concat(price, F.lit(" "), F.coalesce(currency, F.lit("")))))),
        F.when(available.isNotNull(), F.when(available, "availability: in stock").otherwise("availability: out of stock")),
        head("updated", updated_at),
        F.lit("---\n"),
        F.concat(F.lit("# "), title, F.lit("\n")),
        F.when(_said(summary_text), F.concat(T.clean_output(summary_text), F.lit("\n"))),
        table,
        told,
        F.concat(F.lit("Source: "), url, F.lit("\n")),
    ]
    return F.concat_ws("\n", *lines)


def product_jsonld(title: Column, url: Column, summary_text: Column, facts: Column, fit: Column) -> Column:
    """What is added to a theme's product node, by reference to it; null where there is nothing to add."""
    properties = F.transform(facts, lambda f: F.struct(F.lit("PropertyValue").alias("@type"), f["k"].alias("name"), f["v"].alias("value")))
    node = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("Product").alias("@type"),
        F.concat(url, F.lit("#product")).alias("@id"),
        F.nullif(summary_text, F.lit("")).alias("description"),
        F.when(_said(fit), F.struct(F.lit("Audience").alias("@type"), fit.alias("audienceType"))).alias("audience"),
        F.when(F.size(facts) > 0, properties).alias("additionalProperty"),
    )
    return F.when((F.size(facts) > 0) | _said(summary_text), F.to_json(node))


def product_jsonld_full(title: Column, url: Column, description: Column, facts: Column, vendor: Column, low: Column, high: Column, n_offers: Column, currency: Column, available: Column) -> Column:
    """A complete product node; a price span where the variants' prices differ."""
    properties = F.transform(facts, lambda f: F.struct(F.lit("PropertyValue").alias("@type"), f["k"].alias("name"), f["v"].alias("value")))
    stock = F.when(available, "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock")
    many = low != high
    offers = F.struct(
        F.when(many, "AggregateOffer").otherwise("Offer").alias("@type"),
        F.when(~many, low).alias("price"),
        F.when(many, low).alias("lowPrice"),
        F.when(many, high).alias("highPrice"),
        currency.alias("priceCurrency"),
        F.when(many, n_offers).alias("offerCount"),
        stock.alias("availability"),
        url.alias("url"),
    )
    node = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), F.concat(url, F.lit("#product")).alias("@id"), title.alias("name"), description.alias("description"), url.alias("url"),
        F.when(_said(vendor), F.struct(F.lit("Brand").alias("@type"), vendor.alias("name"))).alias("brand"), F.when(F.size(facts) > 0, properties).alias("additionalProperty"), offers.alias("offers"),
    )
    return F.to_json(node)


def faq_jsonld(qa: Column) -> Column:
    """A page of questions and answers; null without one."""
    entries = F.transform(qa, lambda x: F.struct(F.lit("Question").alias("@type"), x["q"].alias("name"), F.struct(F.lit("Answer").alias("@type"), x["a"].alias("text")).alias("acceptedAnswer")))
    return F.when(F.size(qa) > 0, F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), entries.alias("mainEntity"))))


def organization_jsonld(org_id: Column, name: Column, url: Column, profiles: Column) -> Column:
    """The shop with its profile addresses, map<string,string>; null without a valid one."""
    valid = F.filter(F.map_values(profiles), T.profile_url)
    node = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Organization").alias("@type"), F.nullif(org_id, F.lit("")).alias("@id"), F.when(~_said(org_id), name).alias("name"), F.when(~_said(org_id), url).alias("url"), valid.alias("sameAs"))
    return F.when(F.size(valid) > 0, F.to_json(node))


def capsule_fields(products: DataFrame, key: str = "id", business: Column | None = None) -> DataFrame:
    """(owner_id, key, type, value) of the derived fields of products with facts; empty ones stay, so that a merge can withdraw."""
    c = F.col
    fields = F.array(
        F.struct(F.lit("facts").alias("key"), F.lit("json").alias("type"), F.to_json("facts").alias("value")),
        F.struct(F.lit("summary").alias("key"), F.lit("multi_line_text").alias("type"), summary(c("title"), c("description_html"), c("facts"), c("price"), c("currency"), c("available"), c("vendor"), c("product_type")).alias("value")),
        F.struct(F.lit("questions").alias("key"), F.lit("json").alias("type"), F.to_json(questions(c("title"), c("facts"), c("price"), c("currency"), c("available"), business)).alias("value")),
        F.struct(F.lit("fit_for").alias("key"), F.lit("single_line_text").alias("type"), fit_for(c("facts")).alias("value")),
    )
    return products.select(F.col(key).alias("owner_id"), F.explode(fields).alias("f")).select("owner_id", "f.*")
