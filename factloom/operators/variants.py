"""Facts between a product and its variants. A variant is struct<id, title, selected_options: array<struct<name, value>>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T


def _real(o: Column) -> Column:
    return ~((o["name"] == "Title") & (o["value"] == "Default Title"))


def variant_facts(options: Column) -> Column:
    """Option pairs as facts, without blank ones and the placeholder."""
    kept = F.filter(options, lambda o: (o["name"] != "") & (o["value"] != "") & _real(o))
    return F.transform(kept, lambda o: F.struct(T.clean_output(o["name"]).alias("k"), T.clean_output(o["value"]).alias("v")))


def _label(x: Column) -> Column:
    return F.lower(F.trim(x))


def varying_names(variants: Column) -> Column:
    """Names of options that have several values across the variants, sorted."""
    pairs = F.flatten(F.transform(variants, lambda v: F.transform(F.filter(v["selected_options"], _real), lambda o: F.struct(_label(o["name"]).alias("n"), _label(o["value"]).alias("v")))))
    names = F.transform(F.array_distinct(pairs), lambda p: p["n"])
    # bound: an expression inside a lambda is computed for each element
    return T.let(names, lambda all_: F.array_sort(F.array_distinct(F.filter(all_, lambda n: F.size(F.filter(all_, lambda m: m == n)) > 1))))


def varying_options(options: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, n_values) of options with several values, from rows (keys, name, value): one aggregation."""
    real = options.filter(~((F.col("name") == "Title") & (F.col("value") == "Default Title")))
    return real.groupBy(*keys, _label(F.col("name")).alias("name")).agg(F.countDistinct(_label(F.col("value"))).alias("n_values")).filter("n_values > 1")


def split_levels(products: DataFrame, facts: str = "facts", variants: str = "variants") -> DataFrame:
    """products with product_facts, moved_labels and variant_facts, array<struct<id, facts>>.

    Labels that the variants contradict leave the product; then each variant gets all of its options.
    """
    out = products.withColumn("__varying", varying_names(F.col(variants)))
    moved = lambda f: F.array_contains("__varying", _label(f["k"]))
    own = F.transform(F.col(variants), lambda v: F.struct(v["id"].alias("id"), variant_facts(v["selected_options"]).alias("facts")))
    none = F.array().cast("array<struct<id:string,facts:array<struct<k:string,v:string>>>>")
    return out.withColumns(
        {
            "product_facts": F.filter(facts, lambda f: ~moved(f)),
            "moved_labels": F.array_distinct(F.transform(F.filter(facts, moved), lambda f: f["k"])),
            "variant_facts": F.when(F.size("__varying") > 0, F.filter(own, lambda v: F.size(v["facts"]) > 0)).otherwise(none),
        }
    ).drop("__varying")


def price_range(offers: DataFrame, by: str = "id", price: str = "price") -> DataFrame:
    """(by, low, high, n_offers) of a product's offers; an offer without a price counts as one but sets no bound."""
    return offers.groupBy(by).agg(F.min(price).alias("low"), F.max(price).alias("high"), F.count("*").alias("n_offers"))
