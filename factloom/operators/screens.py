"""Forms, panels and lookups of the product screens, and the structured data of collection pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers in which proxies tell whom they forward for.
FORWARDING_HEADERS = ("x-forwarded-for", "fly-client-ip", "cf-connecting-ip", "true-client-ip", "x-real-ip", "forwarded")
BUSINESS_TEXTS = ("delivery_time", "delivery_cost", "warranty", "payment_methods")


def gid_tail(x: Column) -> Column:
    """What follows the last slash of an id."""
    return F.element_at(F.split(x, "/"), -1)


def gid(x: Column, kind: str) -> Column:
    """x with the prefix of its kind, unless it has one."""
    return F.when(x.startswith("gid://"), x).otherwise(F.concat(F.lit(f"gid://shop/{kind}/"), x))


def panel_cut(x: Column, most: int) -> Column:
    """A panel's text: cut to so many characters and three dots."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def flatten_nodes(x: Column) -> Column:
    """The members of a connection, struct<nodes: array<...>>; none for a null one."""
    return F.coalesce(x["nodes"], F.array())


def lookup(products: DataFrame, key: object, variants: int = 100, fields: int = 10, column: str = "id") -> DataFrame:
    """One product by its id, with no more variants and metafields than a lookup gives."""
    found = products.filter(F.col(column) == key)
    return found.withColumns({c: F.slice(c, 1, n) for c, n in (("variants", variants), ("metafields", fields)) if c in found.columns})


def active_tenants(tenants: DataFrame) -> DataFrame:
    return tenants.filter(F.col("uninstalled_at").isNull())


def form_pairs(questions: Column, answers: Column) -> Column:
    """array<struct<q,a>> of a form's fields, trimmed; pairs with an empty side fall away."""
    side = lambda x: F.trim(F.coalesce(x, F.lit("")))
    pairs = F.transform(questions, lambda q, i: F.struct(side(q).alias("q"), side(F.get(answers, i)).alias("a")))
    return F.filter(pairs, lambda p: (p["q"] != "") & (p["a"] != ""))


def business_record(form: DataFrame) -> DataFrame:
    """form with its texts trimmed, blank ones null, return_days as a number, and valid: null or a finite number of days."""
    days = F.nullif(F.trim(F.coalesce("return_days", F.lit(""))), F.lit(""))
    number = F.expr("try_cast(trim(return_days) AS double)")
    valid = days.isNull() | F.coalesce((number >= 0) & (number < float("inf")), F.lit(False))
    return form.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in BUSINESS_TEXTS} | {"valid": valid, "return_days": F.when(valid & days.isNotNull(), number)})


def forwarding_headers(headers: Column) -> Column:
    """JSON of the forwarding headers that are set, from map<string,string> by lower-case name; null without one."""
    set_ = F.map_filter(headers, lambda k, v: k.isin(*FORWARDING_HEADERS) & (F.coalesce(v, F.lit("")) != ""))
    ordered = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.try_element_at(set_, F.lit(n)).alias("v")) for n in FORWARDING_HEADERS]), lambda x: x["v"].isNotNull()))
    return F.when(F.size(set_) > 0, F.to_json(ordered))


def newest(rows: DataFrame, n: int, per: str | None = None, at: str = "at", key: str = "event_id") -> DataFrame:
    """The newest n rows, of each tenant if per names its column."""
    order = [F.desc(at), F.desc(key)]
    if per is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def handles_of(changed: DataFrame, products: DataFrame) -> DataFrame:
    """(id, handle) of changed products."""
    return products.select("id", "handle").join(changed.select("id").distinct(), "id", "left_semi")


def mirror_of(mirrors: DataFrame, tenants: DataFrame, domain: str, handle: str) -> DataFrame:
    """The text mirror of a handle at a tenant's domain."""
    return mirrors.filter(F.col("handle") == handle).join(tenants.filter(F.col("domain") == domain).select("tenant"), "tenant", "left_semi")


def append_log(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Appends to a log. A run that is repeated under its name replaces what it appended; without a name it appends again."""
    if run is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def collection_jsonld(collections: DataFrame, members: DataFrame, most: int = 60) -> DataFrame:
    """collections (collection_id, title, url, summary, criteria) with jsonld: the page and its first products; null without a summary.

    members: (collection_id, pos, product_id, title, url).
    """
    first = Window.partitionBy("collection_id").orderBy("pos", "product_id")
    item = F.struct(F.lit("ListItem").alias("@type"), F.col("n").alias("position"), F.col("title").alias("name"), F.col("url").alias("url"))
    listed = members.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).groupBy("collection_id").agg(F.sort_array(F.collect_list(F.struct("n", item.alias("item")))).alias("items"))
    counted = members.groupBy("collection_id").agg(F.count("*").alias("n_items"))
    joined = collections.join(listed, "collection_id", "left").join(counted, "collection_id", "left")
    hint = lambda x: F.struct(F.lit("PropertyValue").alias("@type"), F.lit("How to choose").alias("name"), x.alias("value"))
    whole = F.struct(F.lit("ItemList").alias("@type"), F.coalesce("n_items", F.lit(0)).alias("numberOfItems"), F.coalesce(F.transform("items", lambda x: x["item"]), F.array()).alias("itemListElement"))
    node = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("CollectionPage").alias("@type"), F.concat("url", F.lit("#collection")).alias("@id"), F.col("title").alias("name"),
        F.col("summary").alias("description"), F.col("url").alias("url"), F.when(F.size("criteria") > 0, F.transform("criteria", hint)).alias("additionalProperty"), whole.alias("mainEntity"),
    )
    return joined.withColumn("jsonld", F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.to_json(node))).drop("items", "n_items")

