"""Adapters from the star-schema tables to the catalogue's records, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.extract import extract
from factloom.sources.shared import new_dir

DICTIONARY = """\
Colour: red, blue
Size class: large, small
Age: old, new
Temperature: hot, cold
Kind: widget, bolt, rod, anvil, gizmo, ring, plate, gear
Dimensions: #size
Includes: * screws
Finish: finish *
Room: cellar | default: workshop
"""
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """part as products, with a description made of its columns; apart: on many tasks, before the columns are made."""
    part = table(spark, sf_dir, "part")
    part = spread(part, "p_partkey") if apart else part
    key = F.col("p_partkey")
    body = F.concat(F.lit("<p>A "), F.lower("p_type"), F.lit(" part &amp; fitting, width "), F.col("p_size"), F.lit(" cm.</p><p>Comes with finish matt grey and "), key % 5 + 2, F.lit(" screws.</p>"))
    return part.select(
        key.alias("id"),
        F.concat(F.lit("part-"), key).alias("handle"),
        F.col("p_name").alias("title"),
        body.alias("description_html"),
        F.col("p_brand").alias("vendor"),
        F.lower("p_type").alias("product_type"),
        F.concat(F.lit("https://shop.example/products/part-"), key).alias("url"),
        F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"),
        F.lit("EUR").alias("currency"),
        F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("available"),
    )


#: Rows that a task extracts from, at most about.
TASK_ROWS = 50_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df on as many partitions as there are cores, and on more where it has many rows, if it has fewer files: these are small and each row is much work.

    Rows are dealt by a unique key; dealt in turn, they would be sorted first in the few tasks that read them.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(n, key) if len(df.inputFiles()) < n else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what reads it more than once: it outlives executors, and plans on it are short."""
    at = new_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def with_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(products(spark, sf_dir, apart=True), DICTIONARY)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of each brand, in order of their ids; described gives them facts."""
    return products(spark, sf_dir, apart=True).select(F.col("vendor").alias("collection_id"), F.col("id").alias("pos"), F.col("id").alias("product_id"), "title", "description_html")


def described(capped: DataFrame) -> DataFrame:
    """The members that collections speak of with facts, as a table: it is read for the labels and again for the rows."""
    return stored(extract(capped, DICTIONARY).drop("description_html"), "members")


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("collection_id")).distinct()
    return brands.select("collection_id", F.concat(F.lit("Parts of "), F.col("collection_id")).alias("title"), F.lit("<p>Hand picked &amp; ready! More soon.</p>").alias("description_html"))


def properties(p: DataFrame) -> DataFrame:
    """Stored facts of products with facts: by people, by the engine (stale or equal), of unknown origin, or absent."""
    kind = F.col("id") % 6
    source = F.when(kind == 0, "human").when(kind.isin(1, 2, 4), "auto")
    value = F.when(kind == 1, F.to_json("facts")).when(kind == 5, "").otherwise("old")
    return p.filter(kind != 3).select(F.col("id").alias("owner_id"), F.lit("facts").alias("key"), F.lit("json").alias("type"), value.alias("value"), source.alias("source"), F.lit("2024-01-01").alias("at"), F.lit("1").alias("engine"))


def candidates(p: DataFrame) -> DataFrame:
    """New facts; of every fourth product none, as an empty array."""
    return p.select(F.col("id").alias("owner_id"), F.lit("facts").alias("key"), F.lit("json").alias("type"), F.when(F.col("id") % 4 == 0, "[]").otherwise(F.to_json("facts")).alias("value"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("agent"), F.concat(F.lit("part-"), F.col("user_id")).alias("handle"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"), "value")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: pending ones are queued and have no start."""
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.when(status == "P", "queued").when(status == "O", "running").otherwise("done").alias("status"), F.when(status != "P", F.col("o_orderdate")).alias("started_at"), F.col("o_orderdate").alias("updated_at"))


#: The same records for DuckDB: p has the products, f their facts by label and as a list of texts.
SQL_P = """
WITH p AS (SELECT p_partkey AS id, 'part-' || p_partkey AS handle, p_name AS title,
  'A ' || lower(p_type) || ' part & fitting, width ' || p_size || ' cm.' AS opener,
  'Comes with finish matt grey and ' || (p_partkey % 5 + 2) || ' screws.' AS rest,
  p_brand AS vendor, lower(p_type) AS product_type, 'https://shop.example/products/part-' || p_partkey AS url,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price, 'EUR' AS currency,
  CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS available,
  string_split(p_name || ' ' || lower(p_type), ' ') AS w, p_size, p_partkey FROM part),
g AS (SELECT *, nullif(array_to_string([x FOR x IN ['red','blue'] IF list_contains(w, x)], ', '), '') AS colour,
  nullif(array_to_string([x FOR x IN ['large','small'] IF list_contains(w, x)], ', '), '') AS size_class,
  nullif(array_to_string([x FOR x IN ['old','new'] IF list_contains(w, x)], ', '), '') AS age,
  nullif(array_to_string([x FOR x IN ['hot','cold'] IF list_contains(w, x)], ', '), '') AS temperature,
  nullif(array_to_string([x FOR x IN ['widget','bolt','rod','anvil','gizmo','ring','plate','gear'] IF list_contains(w, x)], ', '), '') AS kind,
  'width ' || p_size || ' cm' AS dimensions, (p_partkey % 5 + 2) || ' screws' AS includes, 'finish matt grey' AS finish, 'workshop' AS room FROM p),
f AS (SELECT *, [x FOR x IN [{'k': 'Colour', 'v': colour}, {'k': 'Size class', 'v': size_class}, {'k': 'Age', 'v': age}, {'k': 'Temperature', 'v': temperature}, {'k': 'Kind', 'v': kind}, {'k': 'Dimensions', 'v': dimensions}, {'k': 'Includes', 'v': includes}, {'k': 'Finish', 'v': finish}, {'k': 'Room', 'v': room}] IF x.v IS NOT NULL] AS facts FROM g)
"""

#: Members of the collections, the first 60, one row for each fact; and the labels worth comparing, as an ordered list.
SQL_C = (
    SQL_P
    + """,
m AS (SELECT vendor AS collection_id, id, title, facts, row_number() OVER (PARTITION BY vendor ORDER BY id) AS rn FROM f QUALIFY rn <= 60),
n AS (SELECT collection_id, count(*) AS n FROM m GROUP BY 1),
x AS (SELECT collection_id, id, u.k AS k, u.v AS v, u.i AS i FROM (SELECT collection_id, id, unnest([{'k': facts[i].k, 'v': facts[i].v, 'i': i} FOR i IN range(1, len(facts) + 1)]) AS u FROM m)),
cov AS (SELECT collection_id, k, count(DISTINCT id) AS n_products, min(id * 100 + i) AS first FROM x GROUP BY 1, 2),
part_ AS (SELECT collection_id, k, trim(u.t) AS shown, id * 10000 + i * 100 + u.j AS o FROM (SELECT collection_id, k, id, i, unnest([{'t': string_split(v, ',')[j], 'j': j} FOR j IN range(1, len(string_split(v, ',')) + 1)]) AS u FROM x)),
val AS (SELECT collection_id, k, lower(shown) AS key, arg_min(shown, o) AS shown, min(o) AS o FROM part_ WHERE shown <> '' GROUP BY 1, 2, 3),
vals AS (SELECT collection_id, k, list(shown ORDER BY o) AS label_values FROM val GROUP BY 1, 2),
comp AS (SELECT collection_id, k, n_products, label_values, row_number() OVER (PARTITION BY collection_id ORDER BY n_products DESC, len(label_values) DESC, first) AS rank
  FROM cov JOIN vals USING (collection_id, k) JOIN n USING (collection_id) WHERE n_products >= greatest(2, ceil(n * 0.5)) AND len(label_values) > 1 QUALIFY rank <= 5)
"""
)

#: The same of all members.
SQL_C_ALL = SQL_C.replace(" QUALIFY rn <= 60)", ")")
