"""Monitoring: crawler access, structured data of pages, jobs, request logs and limits."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

#: Crawlers whose access is checked.
AGENTS = ("GPTBot", "OAI-SearchBot", "ChatGPT-User", "Claude-SearchBot", "PerplexityBot")
#: Severity of each cause.
TONES = {"ok": "success", "password_page": "critical", "bot_protection": "critical", "cloudflare": "critical", "robots_disallow": "warning", "server_error": "critical", "unreachable": "warning", "unknown": "warning"}


def is_password_page(body: Column) -> Column:
    return body.rlike("(?i)name=[\"']password[\"']") & ~body.rlike(r"(?i)ld\+json")


def classify_http(status: Column, server: Column, header_names: Column, body: Column) -> Column:
    """What a crawler's request met: a cause. header_names: array<string>; a null status is unreachable."""
    cloudflare = F.lower(F.coalesce(server, F.lit(""))).contains("cloudflare") | F.exists(header_names, lambda h: F.lower(h).contains("cf-ray"))
    return (
        F.when(status.isNull(), "unreachable")
        .when(status == 200, F.when(is_password_page(F.coalesce(body, F.lit(""))), "password_page").otherwise("ok"))
        .when(status.isin(401, 403), F.when(cloudflare, "cloudflare").otherwise("bot_protection"))
        .when(status == 429, "bot_protection")
        .when(status >= 500, "server_error")
        .otherwise("unknown")
    )


def tone(cause: Column) -> Column:
    tones = F.create_map(*[F.lit(x) for pair in TONES.items() for x in pair])
    return F.coalesce(F.try_element_at(tones, cause), F.lit("warning"))


def robots_disallowed(robots: DataFrame, text: str = "text", agents: tuple[str, ...] = AGENTS) -> DataFrame:
    """robots with agent, for each agent that a block disallows from everything; repeated blocks count once."""
    blocks = robots.withColumn("__block", F.explode(F.split(F.col(text), r"(?i)\n(?=user-agent:)")))
    named = blocks.withColumn("__agent", F.lower(F.trim(F.regexp_extract("__block", r"(?i)user-agent:\s*([^\n\r]+)", 1)))).filter(F.col("__block").rlike(r"(?im)disallow:\s*/\s*$"))
    every = F.explode(F.array(*map(F.lit, agents))).alias("agent")
    out = named.select("*", every).filter((F.col("__agent") == "*") | (F.col("__agent") == F.lower("agent")))
    return out.drop("__block", "__agent").distinct()


def with_robots(results: DataFrame, disallowed: DataFrame, keys: list[str]) -> DataFrame:
    """results with cause robots_disallow where an agent is served but told not to read."""
    hit = results.join(disallowed.select(*keys, "agent", F.lit(True).alias("__no")), [*keys, "agent"], "left")
    return hit.withColumn("cause", F.when((F.col("cause") == "ok") & F.col("__no").isNotNull(), "robots_disallow").otherwise(F.col("cause"))).drop("__no")


def _nodes(parsed) -> list[dict]:
    """Objects of a document: lists and graphs are opened."""
    todo, out = [parsed], []
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            if isinstance(x.get("@graph"), list):
                todo.append(x["@graph"])
            else:
                out.append(x)
    return out


def _scan_blocks(blocks: pd.Series) -> pd.DataFrame:
    rows = []
    for page in blocks:
        products, organizations, n = [], [], 0
        for block in page if page is not None else []:
            try:
                parsed = json.loads(block.strip())
            except ValueError:
                continue
            for node in _nodes(parsed):
                kind, ident = node.get("@type"), str(node.get("@id") or "")
                kinds = [str(x) for x in kind] if isinstance(kind, list) else [str(kind)] if kind else []
                if "Product" in kinds:
                    n += 1
                    products += [ident] if ident else []
                if "Organization" in kinds:
                    organizations.append(ident)
        rows.append((n, products, organizations))
    return pd.DataFrame(rows, columns=["node_count", "emitters", "organization_emitters"])


IDS = Ty.ArrayType(Ty.StringType())
SCANNED = Ty.StructType([Ty.StructField("node_count", Ty.IntegerType()), Ty.StructField("emitters", IDS), Ty.StructField("organization_emitters", IDS)])


@F.pandas_udf(SCANNED)
def _scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for blocks in batches:
        yield _scan_blocks(blocks)


def ld_scan(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with what structured data they publish. Blocks are found JVM-side; only they reach Python."""
    page = F.coalesce(F.col(html), F.lit(""))
    blocks = F.regexp_extract_all(page, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    blocks = F.when(page.rlike(r"(?i)ld\+json"), blocks).otherwise(F.array().cast("array<string>"))
    out = pages.withColumn("__s", _scanned(blocks))
    return out.withColumns(
        {
            "has_product_ld": F.col("__s.node_count") > 0,
            "node_count": F.col("__s.node_count"),
            "emitters": F.col("__s.emitters"),
            "has_organization_ld": F.size("__s.organization_emitters") > 0,
            "organization_emitters": F.col("__s.organization_emitters"),
            "password_protected": is_password_page(page),
        }
    ).drop("__s")


def embed_check(settings: DataFrame, handle: str, uid: str, text: str = "settings") -> DataFrame:
    """settings with active, present_but_disabled, stale_reference and unreadable, from a theme's settings JSON."""
    body = F.regexp_replace(F.col(text), r"(?s)^\s*/\*.*?\*/", "")
    parsed = F.from_json(body, "current string")
    current = F.from_json(parsed["current"], "blocks map<string,struct<type:string,disabled:boolean>>")
    blocks = F.coalesce(F.map_values(current["blocks"]), F.array().cast("array<struct<type:string,disabled:boolean>>"))
    ours = F.filter(blocks, lambda b: b["type"].contains(f"/blocks/{handle}/") | b["type"].contains(uid))
    on = F.filter(ours, lambda b: ~F.coalesce(b["disabled"], F.lit(False)))
    enabled, stale = F.exists(on, lambda b: b["type"].contains(uid)), F.exists(on, lambda b: ~b["type"].contains(uid))
    unreadable = F.try_parse_json(body).isNull()
    return settings.withColumns({"active": enabled, "present_but_disabled": (F.size(ours) > 0) & ~enabled & ~stale, "stale_reference": stale & ~enabled, "unreadable": unreadable})


def latest_per_agent(checks: DataFrame, window_rows: int | None = 25, at: str = "at", key: str = "event_id", agent: str = "agent") -> DataFrame:
    """The newest check of each agent among the newest rows, or (window_rows=None) among all."""
    rows = checks.orderBy(F.desc(at), F.desc(key)).limit(window_rows) if window_rows else checks
    newest = Window.partitionBy(agent).orderBy(F.desc(at), F.desc(key))
    return rows.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def latest_job(jobs: DataFrame, per: str | None = None, started: str = "started_at", key: str = "id") -> DataFrame:
    """The newest job; one that is queued, without a start, comes before all."""
    order = [F.col(started).desc_nulls_first(), F.desc(key)]
    if per is None:
        return jobs.orderBy(*order).limit(1)
    return jobs.withColumn("__n", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter("__n = 1").drop("__n")


def stalled(jobs: DataFrame, now: Column, seconds: int = 180) -> DataFrame:
    """Queued or running jobs that nothing has touched for some time, with the minutes since."""
    age = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    return jobs.filter(F.col("status").isin("queued", "running") & (age > seconds)).withColumn("minutes", F.floor(age / 60))


def hits_daily(hits: DataFrame, bots: tuple[str, ...] = AGENTS) -> DataFrame:
    """(day, bot, handle, hits, misses): a miss is a 404; agents that aren't known are other."""
    known = F.array(*map(F.lit, bots))
    bot = F.when(F.array_contains(known, F.col("agent")), F.col("agent")).otherwise("other")
    return hits.groupBy(F.to_date("at").alias("day"), bot.alias("bot"), "handle").agg(F.count_if(F.col("status") != 404).alias("hits"), F.count_if(F.col("status") == 404).alias("misses"))


def bot_absence(hits: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """(agent, last_seen, absent) for agents that have been seen."""
    seen = hits.groupBy("agent").agg(F.max("at").alias("last_seen"))
    return seen.withColumn("absent", F.col("last_seen") < now - F.make_interval(days=F.lit(days)))


def never_read(products: DataFrame, hits: DataFrame, handle: str = "handle") -> DataFrame:
    """Products that no served request has asked for."""
    return products.join(hits.filter(F.col("status") != 404).select(handle), handle, "left_anti")


def latency(metrics: DataFrame, by: str = "path") -> DataFrame:
    """(by, n, p50, p95, failure_rate)."""
    return metrics.groupBy(by).agg(F.count("*").alias("n"), F.percentile("ms", F.lit(0.5)).alias("p50"), F.percentile("ms", F.lit(0.95)).alias("p95"), F.avg((~F.col("ok")).cast("double")).alias("failure_rate"))


def limit_state(tenants: DataFrame, now: Column, grace_days: int = 14) -> DataFrame:
    """tenants (n_products, plan_limit, grace_started_at) with over, grace_ends_at and grace_expired; under the limit grace is cleared."""
    over = F.coalesce(F.col("n_products") > F.col("plan_limit"), F.lit(False))
    ends = F.when(over, F.coalesce("grace_started_at", now) + F.make_interval(days=F.lit(grace_days)))
    return tenants.withColumns({"over": over, "grace_ends_at": ends, "grace_expired": F.coalesce(now > ends, F.lit(False))})


#: Products of a media file that one task looks at.
MEDIA_BLOCK = 4096


def _generated(images: DataFrame) -> DataFrame:
    """images with human: whether a person wrote the alt text."""
    from factloom.functions.text import looks_like_machine_alt

    own = F.trim(F.coalesce(F.col("alt"), F.lit("")))
    return images.withColumn("human", (own != "") & ~looks_like_machine_alt(own))


def media_owners(images: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(media_id, product_id): of each media file the product that last got a generated alt text, for the next run's owners."""
    made = _generated(images.select("alt", "media_id", "product_id", "product_ord", "position")).filter("not human and media_id is not null")
    last = made.groupBy("media_id").agg(F.max_by("product_id", F.struct("product_ord", "position", "product_id")).alias("product_id"))
    return last if owners is None else owners.join(last, "media_id", "left_anti").select("media_id", "product_id").unionByName(last)


def alt_merge(images: DataFrame, suggestion: str = "suggestion", owners: DataFrame | None = None, block: int = MEDIA_BLOCK) -> DataFrame:
    """images (product_ord, position, media_id, product_id, alt) with action kept, shared or written, and alt_out.

    An alt text that a person wrote stays; it is shared if the same file got a generated one for another product
    before, in the order of products and positions, or in an earlier run (owners: media_owners of it). Blocks of block
    products of a file are looked at alone, then the last owner before each block is handed on, so that a file of many
    products is many tasks' work. An image without a file is shared with nothing; columns of any name pass through.
    """
    packed = images.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(images.columns)]).alias("rest"), "alt", "media_id", "product_id", "product_ord", "position", F.col(suggestion).alias("suggested"))
    rows = _generated(packed).withColumn("block", F.floor(F.col("product_ord") / block))
    filed, loose = rows.filter("media_id is not null"), rows.filter("media_id is null")
    # of equal places the order is that of products
    before = Window.partitionBy("media_id", "block").orderBy("product_ord", "position", "product_id").rowsBetween(Window.unboundedPreceding, -1)
    filed = filed.withColumn("here", F.last(F.when(~F.col("human"), F.col("product_id")), ignorenulls=True).over(before))
    # null blocks, of products without an order, come first as their rows do
    last = rows.filter("media_id is not null").groupBy("media_id", "block").agg(F.max(F.when(~F.col("human"), F.struct("product_ord", "position", "product_id"))).alias("last"))
    earlier = Window.partitionBy("media_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("media_id", "block", F.last(F.col("last.product_id"), ignorenulls=True).over(earlier).alias("handed"))
    if owners is not None:
        last = last.join(owners.select("media_id", F.col("product_id").alias("old")), "media_id", "left").select("media_id", "block", F.coalesce("handed", "old").alias("handed"))
    last = last.select(F.col("media_id").alias("m"), F.coalesce("block", F.lit(-(1 << 62))).alias("b"), "handed")
    filed = filed.withColumn("own", F.coalesce("block", F.lit(-(1 << 62)))).join(last, (F.col("media_id") == F.col("m")) & (F.col("own") == F.col("b")), "left")
    owner = F.coalesce("here", "handed")
    filed = filed.select("rest", "human", "suggested", "alt", (owner.isNotNull() & (owner != F.col("product_id"))).alias("others"))
    every = filed.unionByName(loose.select("rest", "human", "suggested", "alt", F.lit(False).alias("others")))
    own = [F.col("rest")[f"c{i}"].alias(c) for i, c in enumerate(images.columns) if c not in ("action", "alt_out")]
    return every.select(*own, F.when(~F.col("human"), "written").when(F.coalesce("others", F.lit(False)), "shared").otherwise("kept").alias("action"), F.when(F.col("human"), F.col("alt")).otherwise(F.col("suggested")).alias("alt_out"))
