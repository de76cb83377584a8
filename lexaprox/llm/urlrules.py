"""URL filters as a sort-merge range join, by DataFrame functions only.

A host's key is the host reversed label by label, each label closed by the
character of code 0 (com0example0www0), which sorts below every other; where a
label itself holds the characters of code 0 or 1, they are written as 1 1 and
1 2. The hosts that a rule fits, its own and all subdomains, so are an interval
of keys: from its key up to, but not including, its key with 1 for the last 0.
Such intervals nest or are disjoint, whatever characters a host holds.

Distinct host keys and the rules' keys are sorted together by range partitions
and swept: each rule's key pushes the stack of the rules that hold there (its
own and those of the hosts around it, found by a join on host suffixes), a host
takes the stack last pushed and pops what has ended before it. What a partition
needs of those before it is the last stack that they pushed: one row each. Then
urls take the stack of their host, and of its rules the longest whose path
begins theirs. So the sweep costs what distinct hosts cost, and a host with a
third of all urls is one row of it. Hosts with more than one in HOT of all urls,
of which there are fewer than HOT, are dealt over WAYS tasks in that join.

Defined results: a null url, or one without `://`, has an empty host and path
and no rule; so has an empty host; no rule fits an empty path; repeated rows
are repeated; of two rules with the same host and path the smaller verdict
counts; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, release

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The verdict of urls that no rule fits.
DEFAULT = "allow"
HOT, WAYS = 64, 16
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_and_path(url: str = "url") -> tuple[F.Column, F.Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased.
    Path: from there up to `?`, `#` or the end."""
    has = F.coalesce(F.locate("://", F.col(url)) > 0, F.lit(False))
    rest = F.when(has, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    path = F.substring_index(F.substring_index(F.substr(rest, F.length(host) + 1), "?", 1), "#", 1)
    return F.translate(host, _UPPER, _SMALL), path


def host_key(host: F.Column) -> F.Column:
    """The host's labels from the last to the first, each closed by character 0."""
    plain = F.replace(F.replace(host, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.concat(F.array_join(F.reverse(F.split(plain, "[.]")), "\x00"), F.lit("\x00"))


def _stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): at each host with rules, those of all hosts around it too."""
    own = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    own = own.groupBy("host").agg(F.collect_list(F.struct(F.col("host").alias("host"), "path", "verdict")).alias("rules")).withColumn("key", host_key(F.col("host")))
    labels = F.split("host", "[.]")
    around = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("host"))
    held = around.join(own.select("host", "rules", F.col("key").alias("from")), "host")
    level = F.struct("from", F.concat(F.expr("substring(`from`, 1, length(`from`) - 1)"), F.lit("\x01")).alias("to"), "rules")
    return held.groupBy("key").agg(F.sort_array(F.collect_list(level)).alias("stack"))


def _swept(hosts: DataFrame, stacks: DataFrame) -> DataFrame:
    """(key, stack): the rules that hold at each host key."""
    events = hosts.select("key", F.lit(1).alias("is_host"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")).unionByName(stacks.select("key", F.lit(0).alias("is_host"), "stack"))
    # Written, so that a row stays in its partition whatever task runs again.
    events = materialize(events.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "events")
    pushed = events.filter("is_host = 0").groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = events.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(pushed, "part", "left")
    # A row for each partition: their number bounds what is broadcast.
    carried = F.broadcast(parts.select("part", F.last("stack", ignorenulls=True).over(upto).alias("carried")))
    within = Window.partitionBy("part").orderBy("key", "is_host").rowsBetween(Window.unboundedPreceding, 0)
    now = events.withColumn("last", F.last("stack", ignorenulls=True).over(within)).filter("is_host = 1").join(carried, "part")
    return now.select("key", F.filter(F.coalesce("last", "carried"), lambda x: x["to"] > F.col("key")).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each of pages (page_id,
    url). rules has (host, path, verdict): a rule fits its host and all its
    subdomains where its path begins the url's; the longest decides."""
    host, path = host_and_path()
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    stacks = _stacks(rules.select(F.translate("host", _UPPER, _SMALL).alias("host"), "path", "verdict").filter("host <> '' AND path <> ''"))
    hosts = materialize(urls.filter("host <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "hosts")
    total = hosts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("key").isin([r["key"] for r in hosts.filter(F.col("n") * HOT > total).select("key").collect()])
    swept = _swept(hosts.select("key"), stacks)
    # Hosts under a rule only; the others need no stack.
    active = materialize(swept.filter("size(stack) > 0"), "stacks")
    release(hosts)
    ways = F.when(hot, F.pmod(F.xxhash64("page_id", "path"), F.lit(WAYS)).cast("int")).otherwise(0)
    dealt = active.withColumn("way", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))))
    both = urls.withColumn("way", ways).join(dealt, ["key", "way"], "left")
    fitting = F.filter(F.flatten(F.transform("stack", lambda x: x["rules"])), lambda r: F.startswith(F.col("path"), r["path"]))
    size = lambda r: F.length(r["host"]) + F.length(r["path"])
    best = F.array_max(F.transform(fitting, lambda r: F.struct(size(r).alias("size"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    out = both.withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
