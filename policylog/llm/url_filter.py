"""Allow/block URL rules as a sort-merge range join, in DataFrame operations only.

A host is turned into a canonical key with its labels reversed (``www.example.com`` -> ``com.example.www.``), so
that a rule host with all its subdomains is one key interval ``[com.example. , com.example/)``. Intervals of rule
hosts are nested or disjoint. The rule side is small: it becomes one boundary event per interval end, which carries
the stack of rules active from there on. Pages and events are then sorted together and swept once; each page takes
the stack of the last event before it and the longest rule on the stack whose path prefixes the page's path.

Pages are dealt to the sweeps by a hash of the row, never by host, so a host with a third of all pages is spread
evenly; the events are repeated once per sweep (rules x partitions short rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylog.llm.common import shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit(".")))


def boundary_events(rules: DataFrame) -> DataFrame:
    """key, stack: from key on (up to the next event's key) the rules on the stack are active, longest first."""
    stated = rules.where("host is not null and host <> '' and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    stated = stated.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block wins over allow
    stated = stated.withColumn("owner", host_key(F.col("host")))
    labels = F.split(F.rtrim(F.col("key"), F.lit(".")), "\\.", -1)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    keys = stated.select(F.col("owner").alias("key")).distinct()
    above = keys.select("key", F.explode(ancestors).alias("owner"))
    active = above.join(stated, "owner")
    entry = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "path", "verdict")

    def stack(of: DataFrame) -> DataFrame:
        return of.groupBy("key").agg(F.reverse(F.array_sort(F.collect_list("entry"))).alias("stack"))

    active = active.select("key", "owner", entry.alias("entry"))
    opened = stack(active)
    outer = stack(active.where("owner <> key"))
    closed = keys.join(outer, "key", "left").select(F.expr("concat(substring(key, 1, length(key) - 1), '/')").alias("key"), F.coalesce("stack", F.array().cast(opened.schema["stack"].dataType)).alias("stack"))
    return opened.unionByName(closed)


def match_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", sweeps: int | None = None) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict (the rule's, else default).

    rules: host, path, verdict. A rule fits its host and all subdomains if the page's path starts with the rule's
    path; the longest rule wins (host and path characters together), then the one with the longer host. Rules
    without host or verdict are ignored, a null path is empty, and of repeated rules the verdict that sorts last
    (block) wins. A null url, or one without ``://``, has empty host and path and gets the default. Repeated pages
    are each judged; an empty table gives no rows; other columns are ignored.
    """
    n = sweeps or shuffle_partitions(pages.sparkSession)
    events = boundary_events(rules).select("key", F.lit(0).alias("kind"), "stack", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sweep"))
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("_id"), url_host(url).alias("host"), url_path(url).alias("path"),
                          F.pmod(F.xxhash64(F.col(id_col), url), F.lit(n)).cast("int").alias("sweep"))
    judged = judged.withColumn("key", host_key(F.col("host"))).withColumn("kind", F.lit(1))
    along = Window.partitionBy("sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = judged.unionByName(events, allowMissingColumns=True).withColumn("active", F.last("stack", ignorenulls=True).over(along)).where("kind = 1")
    best = F.get(F.filter("active", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    swept = swept.withColumn("best", best)
    return swept.select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
