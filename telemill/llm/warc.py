"""WARC: resolve not-modified revisits.

A revisit record says that a server answered 304.  It is joined, as of its own
time, with the latest earlier full response of the same canonical URL; their
validators are compared, and the headers that a 304 may renew are merged into
the stored response's.  The as-of join works in two steps, so that no URL meets
all its captures in one task: the last response of each URL and time bucket is
carried to later buckets, and inside a bucket a window looks back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 86_400

#: Header fields that a 304 never renews in the stored response.
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a closing slash, query without ``utm_`` fields; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.startswith(x, F.lit("utm_"))))
    return F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(""))


def _weak(etag: Column) -> Column:
    """An entity tag without its mark of weakness: 304s compare weakly."""
    return F.regexp_replace(etag, r"^W/", "")


def resolve(captures: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit: record_id, url_key, the response it stands for, outcome, merged headers.

    captures: record_id, url, ts (timestamp), kind (``response`` or
    ``revisit``), status (int), headers (map, names in lower case), digest.
    Only responses with status 200 count as full.  outcome is ``resolved`` if
    the tags agree (weakly), or, where one side has no tag, the modification
    dates do; ``unchecked`` if neither can be compared; ``mismatch`` if they
    differ; ``missing`` without an earlier response.  Earlier means strictly
    before; of responses with one time the greater record_id counts as later.
    Captures without url or ts resolve to ``missing`` and serve no one.  Null
    headers are empty.  Repeated records give repeated rows.  No rows: no rows.
    """
    empty = F.create_map().cast("map<string,string>")
    base = captures.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "ts", "kind", F.when(F.col("ts").isNotNull(), canonical_url(F.col("url"))).alias("url_key"), "status", F.coalesce("headers", empty).alias("headers"), "digest"
    )
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("url_key").isNotNull()
    base = base.withColumn("bucket", F.floor(F.unix_seconds("ts") / bucket_seconds)).withColumn("response", F.when(full, F.struct("ts", "record_id", "headers", "digest")))
    last = F.max_by("response", F.when(full, F.struct("ts", "record_id")))
    per_bucket = base.where(full).groupBy("url_key", "bucket").agg(last.alias("last"))
    # (url, bucket) pairs that ask, and what each inherits from the buckets before it
    asked = base.where((F.col("kind") == "revisit") & F.col("url_key").isNotNull()).select("url_key", "bucket").distinct()
    steps = asked.join(per_bucket, ["url_key", "bucket"], "full")
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("carried", F.last("last", ignorenulls=True).over(before)).select("url_key", "bucket", "carried")
    # inside the bucket: responses of a strictly earlier microsecond
    inside = Window.partitionBy("url_key", "bucket").orderBy(F.unix_micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    near = base.where(F.col("url_key").isNotNull()).withColumn("near", last.over(inside)).where(F.col("kind") == "revisit")
    found = near.join(carried, ["url_key", "bucket"], "left").withColumn("got", F.coalesce("near", "carried"))
    lost = base.where((F.col("kind") == "revisit") & F.col("url_key").isNull()).select("record_id", "ts", "url_key", "headers", "digest", F.lit(None).cast(base.schema["response"].dataType).alias("got"))
    both = found.select("record_id", "ts", "url_key", "headers", "digest", "got").unionByName(lost)
    tag, stored_tag = _weak(F.col("headers")["etag"]), _weak(F.col("got.headers")["etag"])
    when, stored_when = F.col("headers")["last-modified"], F.col("got.headers")["last-modified"]
    outcome = (
        F.when(F.col("got").isNull(), "missing")
        .when(tag.isNotNull() & stored_tag.isNotNull(), F.when(tag == stored_tag, "resolved").otherwise("mismatch"))
        .when(when.isNotNull() & stored_when.isNotNull(), F.when(when == stored_when, "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    renewed = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT_HEADERS))
    kept = F.map_filter("got.headers", lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    return both.withColumn("outcome", outcome).select(
        "record_id", "ts", "url_key", "outcome", F.col("got.record_id").alias("response_id"), F.col("got.ts").alias("response_ts"), F.col("got.digest").alias("response_digest"),
        F.when(F.col("outcome").isin("resolved", "unchecked"), F.map_concat(kept, renewed)).alias("headers"),
    )

