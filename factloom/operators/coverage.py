"""Reports over the catalogue: coverage, dry runs, screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T


def coverage(products: DataFrame, facts: str = "facts") -> DataFrame:
    """(label, n_products): facts per label, the most frequent first; sort by n_products descending to present it."""
    # explode_outer: the optimizer would push size(facts) > 0, which an inner one implies, below the extraction, again and again
    each = products.select(F.explode_outer(facts).alias("f")).filter(F.col("f").isNotNull())
    return each.groupBy(F.col("f.k").alias("label")).agg(F.count("*").alias("n_products"))


def label_deltas(old: DataFrame, new: DataFrame, by: list[str] | None = None, facts: str = "facts") -> DataFrame:
    """(by, label, n_products): what counts of labels change by when products (id, facts) of old become those of new.

    old has the changed and removed products as they were, new the changed and added ones as they are; a label that a
    product has several times counts once where by names collections, as often as it is there otherwise, as in coverage.
    """
    by = by or []

    def signed(products: DataFrame, sign: int) -> DataFrame:
        labels = F.transform(facts, lambda f: f["k"])
        return products.select(*by, F.explode_outer(F.array_distinct(labels) if by else labels).alias("label"), F.lit(sign).alias("n")).filter(F.col("label").isNotNull())

    changed = signed(old, -1).unionByName(signed(new, 1)).groupBy(*by, "label").agg(F.sum("n").alias("n_products"))
    return changed.filter("n_products <> 0")


def merge_counts(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Stored counts after deltas; a count of nothing is left out."""
    keys = [c for c in counts.columns if c != "n_products"]
    return counts.unionByName(deltas).groupBy(*keys).agg(F.sum("n_products").cast("long").alias("n_products")).filter("n_products <> 0")


def coverage_totals(products: DataFrame, facts: str = "facts") -> DataFrame:
    """One row: sampled, none, and the share in percent of products with facts."""
    none = F.count_if(F.size(facts) == 0)
    percent = F.when(F.count("*") == 0, 0).otherwise(F.round(100 * (F.count("*") - none) / F.count("*"))).cast("long")
    return products.agg(F.count("*").alias("sampled"), none.alias("none"), percent.alias("percent"))


def dry_run(products: DataFrame, may_write: Column, facts: str = "facts", order: str = "id", examples: int = 20) -> DataFrame:
    """One row: totals, products that wouldn't be written (with or without facts), and the first examples with facts."""
    totals = products.agg(F.count("*").alias("sampled"), F.count_if(F.size(facts) == 0).alias("none"), F.count_if(~may_write).alias("would_skip"))
    shown = products.orderBy(F.size(facts) == 0, order).limit(examples).filter(F.size(facts) > 0)
    shown = shown.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "title", facts))), lambda x: F.struct(x["title"], x[facts])).alias("examples"))
    return totals.join(shown, F.lit(True))  # one row each


def catalogue_rows(products: DataFrame, images: DataFrame, state: DataFrame, mirrors: DataFrame) -> DataFrame:
    """products with the counts that a screen shows: n_facts, n_images, n_described, edited, mirrored."""
    described = images.groupBy("id").agg(F.count("*").alias("n_images"), F.count_if(F.trim(F.coalesce("alt", F.lit(""))) != "").alias("n_described"))
    human = state.groupBy("id").agg(F.max((F.col("source") == "human").cast("int")).alias("human"))
    out = products.join(described, "id", "left").join(human, "id", "left").join(mirrors.select("handle", F.lit(True).alias("mirrored")).distinct(), "handle", "left")
    return out.withColumns(
        {
            "n_facts": F.size("facts"),
            "n_images": F.coalesce("n_images", F.lit(0)),
            "n_described": F.coalesce("n_described", F.lit(0)),
            "edited": F.coalesce("human", F.lit(0)) == 1,
            "mirrored": F.coalesce("mirrored", F.lit(False)),
        }
    ).drop("human")


def page_after(products: DataFrame, cursor: tuple | None = None, size: int = 25) -> DataFrame:
    """A page of the catalogue, the newest first, after a cursor (updated_at, id)."""
    if cursor is not None:
        at, key = F.lit(cursor[0]), F.lit(cursor[1])
        products = products.filter((F.col("updated_at") < at) | ((F.col("updated_at") == at) & (F.col("id") < key)))
    return products.orderBy(F.desc("updated_at"), F.desc("id")).limit(size)


def page_before(products: DataFrame, cursor: tuple, size: int = 25) -> DataFrame:
    """The page that ends before a cursor (updated_at, id), the newest first: read in reversed order, then put back."""
    at, key = F.lit(cursor[0]), F.lit(cursor[1])
    newer = products.filter((F.col("updated_at") > at) | ((F.col("updated_at") == at) & (F.col("id") > key)))
    return newer.orderBy("updated_at", "id").limit(size).orderBy(F.desc("updated_at"), F.desc("id"))


def paged_layout(products: DataFrame, path: str, rows: int = 1_000_000) -> None:
    """Writes products in files that are ranges of (updated_at, id), sorted, so that pages skip files by their statistics."""
    products.repartitionByRange("updated_at", "id").sortWithinPartitions("updated_at", "id").write.option("maxRecordsPerFile", rows).parquet(path)


def search(products: DataFrame, query: str, members: DataFrame | None = None, collection: str | None = None) -> DataFrame:
    """Products whose title, sku or vendor has the words; quotes and backslashes don't count.

    With members (collection_id, product_id) and a collection only that collection's products.
    """
    if members is not None and collection is not None:
        inside = members.filter(F.col("collection_id") == collection).select(F.col("product_id").alias("id"))
        products = products.join(inside, "id", "left_semi")
    q = F.lower(F.lit(query.replace('"', "").replace("\\", "").replace("'", "").strip()))
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q) for c in ("title", "sku", "vendor") if c in products.columns]
    found = fields[0]
    for f in fields[1:]:
        found = found | f
    return products.filter(found)


def screen_filter(rows: DataFrame, kind: str) -> DataFrame:
    """no_attributes, edited, missing_alt or all; on a page it filters the page, on the catalogue all of it."""
    conditions = {"no_attributes": F.col("n_facts") == 0, "edited": F.col("edited"), "missing_alt": F.col("n_described") < F.col("n_images")}
    return rows.filter(conditions[kind]) if kind in conditions else rows


def collection_outcomes(capsules: DataFrame) -> DataFrame:
    """One row: collections with and without a table, and the items shown."""
    n = F.coalesce(F.size("table.rows"), F.lit(0))
    return capsules.agg(F.count_if(n > 0).alias("with_table"), F.count_if(n <= 0).alias("without_table"), F.sum(F.greatest(n, F.lit(0))).alias("rows"))


def index_payload(urls: DataFrame, host: str, key: Column, most: int = 10_000, url: str = "url") -> DataFrame:
    """(host, key, key_location, url_list as JSON) of distinct addresses for a change ping; nothing is sent."""
    chosen = urls.filter(F.col(url).startswith("http")).select(url).distinct().orderBy(url).limit(most)
    listed = chosen.agg(F.sort_array(F.collect_list(url)).alias("list"))
    return listed.select(F.lit(host).alias("host"), key.alias("key"), F.concat(F.lit(f"https://{host}/"), key, F.lit(".txt")).alias("key_location"), F.to_json("list").alias("url_list"))


def tenant_key(domain: Column, secret: str) -> Column:
    """A key per tenant: 32 hex digits of a hash."""
    return F.substring(F.sha2(F.concat(F.lit("indexnow:"), domain, F.lit(f":{secret}")), 256), 1, 32)


def profiles(record: Column) -> Column:
    """Valid profile addresses of the known platforms, map<string,string>."""
    platforms = F.array(*map(F.lit, ("facebook", "instagram", "tiktok", "youtube", "linkedin", "x", "pinterest")))
    return F.map_filter(F.transform_values(record, lambda _, v: F.trim(v)), lambda k, v: F.array_contains(platforms, k) & T.profile_url(v))


TABLE = "columns array<string>, rows array<string>"


def collection_rows(collections: DataFrame, properties: DataFrame) -> DataFrame:
    """collections with what a screen shows of their published fields: columns, table_rows, summary and written.

    properties: (owner_id, key, value), the last by key of several. A malformed table counts as none.
    """
    fields = properties.filter(F.col("key").isin("summary", "table")).groupBy("owner_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("summary", "table")])
    fields = fields.select(F.col("owner_id").alias("collection_id"), F.col("summary").alias("said"), F.from_json("table", TABLE).alias("t"))
    none = F.array().cast("array<string>")
    return collections.join(fields, "collection_id", "left").withColumns(
        {"columns": F.coalesce("t.columns", none), "table_rows": F.coalesce(F.size(F.coalesce("t.rows", none)), F.lit(0)), "summary": F.coalesce("said", F.lit("")), "written": F.coalesce("said", F.lit("")) != ""}
    ).drop("said", "t")


def collection_totals(rows: DataFrame) -> DataFrame:
    """One row: collections, those with a summary and those with a table."""
    return rows.agg(F.count("*").alias("n"), F.count_if("written").alias("written"), F.count_if(F.size("columns") > 0).alias("with_table"))
