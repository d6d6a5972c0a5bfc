"""URL filters by host-suffix and path-prefix expressions.

A URL stands for every pair of a suffix of its host and a prefix of its path
(of lengths that some rule's host and path have, as others can meet no rule).
These pairs are joined with the rules on the first four bytes of a SHA-256
digest, then the full digests are compared, and of the rules that fit the most
specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES_BROADCAST = 200_000  # rules up to which each task holds them all
SALTS = 32  # copies of each rule beyond that, so that a rule that fits a third of the URLs meets them in many tasks


def _digest(x: Column) -> Column:
    return F.sha2(x, 256)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path then up to ``?``, ``#`` or the end.  Null or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", rules_broadcast: int = RULES_BROADCAST) -> DataFrame:
    """Verdict on every page: page_id, host, path, rule, verdict, and how many rules fit.

    pages: page_id, url; rules: host, path, verdict.  A rule fits its host and
    all hosts under it when the URL's path starts with the rule's path.  The
    longest fitting rule wins (host and path together; on equal length the
    longer host, then block before allow).  No rule: ``default``.  Null URLs and URLs without
    ``://`` have an empty host and path and fit no rule.  Pages with the same
    page_id are judged row by row; empty tables are fine on either side; rules
    with a null host or path are left out.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select("host", "path", "verdict").distinct()
    rules = rules.select(F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "verdict", F.concat("host", "path").alias("rule")).alias("of"), _digest(F.concat_ws("\x00", "host", "path")).alias("digest"), F.length("path").alias("path_size"), F.endswith(F.col("path"), F.lit("/")).alias("folder"))
    # lengths of rules' hosts, of folder paths and of other paths: at most some thousands, however many rules there are
    by_size = rules.select(F.col("of.host_size").alias("h"), "path_size", "folder").distinct().collect()
    host_sizes, folders, others = sorted({r.h for r in by_size}), sorted({r.path_size for r in by_size if r.folder}), sorted({r.path_size for r in by_size if not r.folder})
    small = rules.limit(rules_broadcast + 1).count() <= rules_broadcast

    host, path = split_url(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    ints = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    host_size, path_size = F.length("host"), F.length("path")
    before = lambda n: F.substring(F.col("host"), host_size - n, F.lit(1)) == "."
    suffixes = F.transform(F.filter(ints(host_sizes), lambda n: (n == host_size) | (n < host_size) & before(n)), lambda n: F.right(F.col("host"), n))
    ends = F.filter(ints(folders), lambda n: (n <= path_size) & (F.substring(F.col("path"), n, F.lit(1)) == "/"))
    cuts = F.concat(ends, F.filter(ints(others), lambda n: n <= path_size))
    prefixes = F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(F.concat_ws("\x00", h, p)))))
    asked = seen.where(F.col("host") != "").select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(pairs)).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    rules = rules.withColumn("short", F.substring("digest", 1, 8)).withColumnRenamed("digest", "full")
    if small:
        met = asked.join(F.broadcast(rules), "short")
    else:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        met = asked.join(rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["short", "salt"])
    won = met.where(F.col("digest") == F.col("full")).groupBy("host", "path").agg(F.max("of").alias("of"), F.count("*").alias("n_rules"))
    result = ["page_id", "host", "path", F.col("of.rule").alias("rule"), F.coalesce("of.verdict", F.lit(default)).alias("verdict"), F.coalesce("n_rules", F.lit(0)).alias("n_rules")]
    # URLs without a host meet nothing, and would meet in one task
    none = seen.where(F.col("host") == "").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).cast("long").alias("n_rules"))
    return seen.where(F.col("host") != "").join(won, ["host", "path"], "left").select(*result).unionByName(none)
