"""URL filters as a sort-merge range join: hosts written backwards, rules as nested intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "(?s)^[^/?#]*", 0),
                                  "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """`www.example.org` as `org.example.www.`: subdomains of a host share its key as a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _boundaries(rules: DataFrame) -> DataFrame:
    """Two rows per host with rules: the stack of rules active from there on.

    A key's interval ends before the key with its last `.` raised to `/`, the next byte. Intervals
    of hosts nest or are disjoint, so the rules active after a start are those of the host and its
    parents, and after an end those of its parents.
    """
    rule = F.struct("host", "path", "action")
    labels = F.split("host", r"\.", -1)
    hosts = (rules.where("host IS NOT NULL AND path IS NOT NULL AND action IS NOT NULL")
             .groupBy("host").agg(F.collect_set(rule).alias("own")))
    depth = F.size(labels)
    parents = hosts.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), depth), lambda n: F.struct(
            F.array_join(F.slice(labels, depth - n + 1, n), ".").alias("parent"),
            (n == depth).alias("itself")))).alias("up")).select("host", "up.*")
    active = (parents.join(hosts.select(F.col("host").alias("parent"), "own"), "parent")
              .groupBy("host").agg(
                  F.flatten(F.collect_list("own")).alias("inner"),
                  F.flatten(F.collect_list(F.when(~F.col("itself"), F.col("own")))).alias("outer")))
    key = host_key(F.col("host"))
    edges = F.array(
        F.struct(key.alias("at"), F.lit(1).alias("turn"), F.col("inner").alias("stack")),
        F.struct(F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("/")).alias("at"),
                 F.lit(0).alias("turn"), F.col("outer").alias("stack")))
    return active.select(F.element_at(F.split("host", r"\."), -1).alias("top"),
                         F.explode(edges).alias("edge")).select("top", "edge.*")


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id",
               url_column: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of `pages`.

    A rule (host, path, action) fits a URL whose host is the rule's or a subdomain of it and whose
    path starts with the rule's. The longest fitting rule, host and path together, decides; equal
    lengths: the longer host, then `block`. No fit: rule null, verdict `default`.

    One sort-merge sweep: URLs and rule boundaries are sorted together by reversed-host key, and each
    URL takes the stack of rules left by the last boundary before it. The sweep runs per last host
    label and salt, so a busy one (`com`) is spread over `salts` tasks; only the boundaries, never the
    URLs, are copied to every salt. Null and odd URLs have empty host and path and get the default;
    repeated rows stay; rules with a null are ignored; empty tables give no rows or defaults; other
    columns of `pages` are not read.
    """
    spread = salts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_column)
    host = host_of(url)
    urls = pages.select(F.col(id_column).alias("id"), host.alias("host"), path_of(url).alias("path"),
                        url.alias("_url"))
    urls = urls.select(
        F.element_at(F.split("host", r"\."), -1).alias("top"),
        F.pmod(F.xxhash64("_url", "id"), F.lit(spread)).cast("int").alias("salt"),
        host_key(F.col("host")).alias("at"), F.lit(2).alias("turn"), "id", "host", "path",
        F.lit(None).cast("array<struct<host:string,path:string,action:string>>").alias("stack"))
    edges = _boundaries(rules).select(
        "top", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"), "at", "turn",
        F.lit(None).cast(urls.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"), "stack")
    sweep = (Window.partitionBy("top", "salt").orderBy("at", "turn")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = (urls.unionByName(edges).withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
             .where("turn = 2"))
    fits = F.filter(F.coalesce("active", F.array().cast(
        "array<struct<host:string,path:string,action:string>>")),
        lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(
        (F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["host"]).alias("hosts"),
        (r["action"] == "block").alias("blocks"), F.concat(r["host"], r["path"]).alias("rule"),
        r["action"].alias("action"))))
    return swept.withColumn("best", best).select(
        F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"))
