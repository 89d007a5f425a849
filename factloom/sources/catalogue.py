"""Catalogue exports: flat JSON lines of products, variants and metafields, folded into nested products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.shared import new_dir

LINE = "id string, __parentId string, title string, handle string, descriptionHtml string, vendor string, productType string, onlineStoreUrl string, price string, currency string, inventory long, updatedAt timestamp, selectedOptions array<struct<name:string,value:string>>, key string, value string"
FACTS = "array<struct<k:string,v:string>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text export of one file or several: line_no orders lines by file name and place.

    A large file is read by several tasks, each a stretch of it; numbers rise inside a stretch, stretches by where they begin.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"))
    return spark.read.text(path).select(at.alias("line_no"), F.col("value").alias("line"))


def fold_children(lines: DataFrame) -> DataFrame:
    """Products with variants and metafields, from (line_no, line).

    Lines are told apart by their ids and keys. Blank and malformed lines and orphans fall away; of a repeated
    product id the later line counts, in the first one's place; a metafield belongs to the product of its parent id
    or else to the variant. Parsed lines are written to the shared folder: they are read four times, and conditions on
    their fields would be pushed below the parser and run it for each field they name.
    """
    parsed, at = lines.filter(F.trim("line") != "").select("line_no", F.from_json("line", LINE).alias("x")).select("line_no", "x.*"), new_dir(lines.sparkSession, "lines")
    parsed.write.parquet(at)
    parsed = lines.sparkSession.read.schema(parsed.schema).parquet(at)
    kind = F.coalesce("id", F.lit(""))  # metafields may have none
    is_product = kind.contains("/Product/") & F.col("title").isNotNull()
    is_variant = kind.contains("/ProductVariant/") & F.col("__parentId").isNotNull()
    products = parsed.filter(is_product).groupBy("id").agg(F.min("line_no").alias("ord"), F.max_by(F.struct("title", "handle", "descriptionHtml", "vendor", "productType", "onlineStoreUrl", "price", "currency", "inventory", "updatedAt"), "line_no").alias("p"))
    fields = parsed.filter(F.col("key").isNotNull() & F.col("__parentId").isNotNull() & ~is_product & ~is_variant).groupBy("__parentId").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "key", "value"))), lambda m: F.struct(m["key"].alias("key"), m["value"].alias("value"))).alias("metafields"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    variants = parsed.filter(is_variant).select("line_no", "id", "title", "__parentId", "selectedOptions").join(fields.withColumnRenamed("__parentId", "id"), "id", "left")
    variant = F.struct("line_no", "id", "title", F.coalesce("selectedOptions", F.array().cast("array<struct<name:string,value:string>>")).alias("selected_options"), F.coalesce("metafields", none).alias("metafields"))
    grouped = variants.groupBy("__parentId").agg(F.transform(F.sort_array(F.collect_list(variant)), lambda v: F.struct(v["id"].alias("id"), v["title"].alias("title"), v["selected_options"].alias("selected_options"), v["metafields"].alias("metafields"))).alias("variants"))
    out = products.join(fields.withColumnRenamed("__parentId", "id"), "id", "left").join(grouped.withColumnRenamed("__parentId", "id"), "id", "left")
    return out.select(
        "ord", "id", "p.handle", "p.title", F.col("p.descriptionHtml").alias("description_html"), "p.vendor", F.col("p.productType").alias("product_type"), F.col("p.onlineStoreUrl").alias("online_store_url"),
        "p.price", "p.currency", (F.col("p.inventory") > 0).alias("available"), F.col("p.updatedAt").alias("updated_at"), F.coalesce("metafields", none).alias("metafields"), "variants",
    )


def fold_rows(parents: DataFrame, children: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """parents with their child rows as an ordered array of structs; parents without one get an empty array."""
    folded = children.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("__f")))), lambda x: x["__f"]).alias(name))
    kind = dict(folded.dtypes)[name]
    return parents.join(folded, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def facts_of(raw: Column) -> Column:
    """Published facts; none for anything malformed."""
    return F.coalesce(F.from_json(raw, FACTS), F.array().cast(FACTS))


def changed_since(products: DataFrame, cursor: Column, column: str = "updated_at") -> DataFrame:
    return products.filter(F.col(column) > cursor)


def setting(settings: DataFrame, tenant: str, key: str) -> str | None:
    """One value of a tenant's settings, which are configuration."""
    row = settings.filter((F.col("tenant") == tenant) & (F.col("key") == key)).select("value").first()
    return row["value"] if row else None


def with_settings(tenants: DataFrame, settings: DataFrame, keys: list[str]) -> DataFrame:
    """tenants with a column for each key of their settings (tenant, key, value), null where they have none: one join for all tenants."""
    chosen = settings.filter(F.col("key").isin(*keys)).groupBy("tenant").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
    return tenants.join(chosen, "tenant", "left")
