"""URL filters by a sort-merge range join, on DataFrame functions alone.

A rule (host, path) fits its host and all subdomains of it where the url's path starts with the rule's.
Canonical key of a rule or url: host labels reversed, then path (``com.example`` + ``/en/``). Among keys of one
host, a rule's path prefix is an interval of the sorted keys, and the intervals of two rules are disjoint or
nested. Each url gives one point for each suffix of its host that is a rule's host. Points and rule starts are
sorted together; the sweep carries the stack of rules that are active at the last start, and a point pops the
rules that it has left behind (their intervals are over), so the first left is the longest that fits.

Rules are laid beside points once for every slice of a host, and a host gets one slice for each
``rows_per_slice`` points, so a host that holds a third of all urls is swept by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; empty for null or no ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(url, "://", 1))
    tail = F.substr(url, F.char_length(rest) + 4)
    return F.coalesce(F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end; empty for null or no ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(url, "://", 1))
    tail = F.substr(url, F.char_length(rest) + 4)
    return F.coalesce(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = "allow", rows_per_slice: int = 4_000) -> DataFrame:
    """Judge each row of ``urls`` by ``rules`` (host, path, verdict).

    Returns ``id_col``, host, path, rule (host and path of the rule that wins, else null) and verdict (the rule's,
    else ``default``), one row for each row of ``urls``. The longest rule (most characters of host and path) wins;
    of equally long ones that with the longer host. Null urls and ids are kept, a null url has empty host and path;
    repeated rows give repeated rows; further columns are ignored; two equal rules with different verdicts: block wins.
    Empty ``rules``: every row gets ``default``.
    """
    rules = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null and r_verdict is not null")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    depth = rules.agg(F.max(F.size(F.split("r_host", r"\.")))).first()[0] or 0
    rows = urls.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).groupBy("id", "host", "path").agg(F.count("*").alias("copies"))
    if not depth:
        return _rows(rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}), id_col)

    # points: one for each host suffix of at most `depth` labels, the host's own included
    labels = F.reverse(F.split("host", r"\."))
    heads = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda k: F.array_join(F.slice(labels, 1, k), "."))
    points = rows.select("id", "host", "path", "copies", F.explode(heads).alias("key"))
    hosts = rules.select(reversed_host(F.col("r_host")).alias("key")).distinct()
    slices = staged(points.join(hosts, "key").groupBy("key").agg(F.ceil(F.count("*") / rows_per_slice).cast("int").alias("slices")), "hosts")
    points = points.join(slices, "key").select("key", F.pmod(F.xxhash64("id", "host", "path"), F.col("slices")).cast("int").alias("slice"), "path", F.lit(1).alias("kind"), F.struct("id", "host", "path", "copies").alias("row"), F.lit(None).cast("array<struct<path:string,verdict:string>>").alias("stack"))

    # the stack at a rule's start: itself on top, then every rule of its host whose path begins its own
    outer = rules.select("r_host", F.col("r_path").alias("o_path"), F.col("r_verdict").alias("o_verdict"))
    prefixes = F.transform(F.sequence(F.lit(0), F.char_length("r_path")), lambda n: F.substr(F.col("r_path"), F.lit(1), n))
    starts = rules.withColumn("o_path", F.explode(prefixes)).join(outer, ["r_host", "o_path"]).groupBy("r_host", "r_path").agg(F.collect_list(F.struct(F.char_length("o_path").alias("n"), F.col("o_path").alias("path"), F.col("o_verdict").alias("verdict"))).alias("found"))
    starts = starts.select(reversed_host(F.col("r_host")).alias("key"), "r_path", F.transform(F.sort_array("found", asc=False), lambda x: F.struct(x["path"].alias("path"), x["verdict"].alias("verdict"))).alias("stack"))
    starts = starts.join(slices, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("r_path").alias("path"), F.lit(0).alias("kind"), F.lit(None).cast(points.schema["row"].dataType).alias("row"), "stack")

    sweep = Window.partitionBy("key", "slice").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    active = starts.unionByName(points).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    top = F.get(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    hits = active.select("row.*", F.array_join(F.reverse(F.split("key", r"\.")), ".").alias("r_host"), top.alias("top")).where("top is not null")
    hits = hits.select("id", "host", "path", "copies", F.struct((F.char_length("r_host") + F.char_length("top.path")).alias("n"), F.char_length("r_host").alias("h"), F.concat("r_host", "top.path").alias("rule"), F.col("top.verdict").alias("verdict")).alias("best"))
    best = rows.withColumn("best", F.lit(None).cast(hits.schema["best"].dataType)).unionByName(hits).groupBy("id", "host", "path").agg(F.first("copies").alias("copies"), F.max("best").alias("best"))
    return _rows(best.select("id", "host", "path", "copies", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")), id_col)


def _rows(judged: DataFrame, id_col: str) -> DataFrame:
    """As many rows as ``copies`` says."""
    each = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
