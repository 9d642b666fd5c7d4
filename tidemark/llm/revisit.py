"""Not-modified revisits of web archives: an as-of join to the full response they confirm.

A 304 record stands for the latest earlier full response of the same canonical URL.  Its
validators are checked against that response (an entity tag decides if both have one, else
the date of the last change), and the headers that a 304 may update are merged.

The join is a timeline: one row for each URL and time (aggregated before the shuffle, so a
URL that is fetched a million times in a second is one row), cut into spans of time.  What a
span inherits is the last response of the spans before it, so a URL with a third of all
records is spread over all spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stage

#: Headers that describe the stored body, which a 304 never replaces (RFC 9110, 15.4.5, and RFC 9111, 3.2),
#: and those of one connection, which are not stored at all (RFC 9110, 7.6.1, and RFC 9111, 3.1).
BODY = ["content-encoding", "content-length", "content-range", "content-type"]
CONNECTION = ["connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Without scheme, www., default port, fragment, tracking parameters and closing slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z]+://", "")
    bare = F.regexp_replace(bare, r"([?&])(?:utm_[a-z]+|ref|gclid|fbclid)=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"&&+", "&"), r"\?&+", "?")
    bare = F.regexp_replace(bare, r"[?&]+$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", ""), r":(?:80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1), r"/+$", "")
    return F.concat(host, rest)


def resolve(records: DataFrame, spans: int = 64) -> DataFrame:
    """The 304 records of ``records``, each with the response that it confirms.

    ``records``: record_id, url, time (long), status, etag, last_modified (strings) and headers
    (map of lower-case names).  Columns of the result: record_id, canonical_url, response_id,
    resolution and headers.  resolution: resolved; mismatch (the validators differ);
    unchecked (they share no validator); missing (no earlier response, or no URL or time).
    Headers are merged only where resolved; else they are the revisit's own.  Earlier means a
    smaller time; of responses with one time the largest record_id counts.  Of responses that
    share a record_id the one with the greatest hash of its validators and headers gives them all.
    Headers of the 304's connection, and those that its ``connection`` header lists, are not merged.
    A null time is never earlier.  Other statuses than 200 and 304 take no part.  Repeated
    rows are resolved each.  Other columns are not read, whatever their names.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "time", "status", "etag", "last_modified", "headers")
    rows = stage(rows.filter("status in (200, 304)"), "revisit-records")
    borders = rows.approxQuantile("time", [k / spans for k in range(1, spans)], 0.002)  # a few numbers
    span = F.array_size(F.filter(F.array(*(F.lit(float(b)) for b in sorted(set(borders)))), lambda b: b < F.col("time"))) if borders else F.lit(0)
    timed = rows.filter("canonical_url is not null and time is not null").withColumn("span", span)
    full = F.when(F.col("status") == 200, F.struct("record_id"))
    line = stage(timed.groupBy("canonical_url", "span", "time").agg(F.max(full).alias("full")), "revisit-timeline")
    last = line.groupBy("canonical_url", "span").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.col("time"))).alias("last"))
    earlier = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    inherited = stage(last.withColumn("inherited", F.last("last", ignorenulls=True).over(earlier)).drop("last"), "revisit-inherited")
    inside = Window.partitionBy("canonical_url", "span").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    before = line.withColumn("within", F.last("full", ignorenulls=True).over(inside)).join(inherited, ["canonical_url", "span"])
    before = stage(before.select("canonical_url", "time", F.coalesce("within", "inherited")["record_id"].alias("response_id")), "revisit-before")
    asked = rows.filter("status = 304").join(before, ["canonical_url", "time"], "left").withColumn("span", span)
    asked = stage(asked, "revisit-asked")
    response = rows.filter("status = 200").select(
        F.col("record_id").alias("response_id"), F.col("etag").alias("r_etag"), F.col("last_modified").alias("r_modified"), F.col("headers").alias("r_headers")
    )
    # A response that very many records confirm is copied to each span of time that asks for it, so no key holds them all.
    needed = asked.filter("response_id is not null").select("response_id", "span").distinct()
    order = F.xxhash64("r_etag", "r_modified", F.to_json("r_headers"))
    response = response.join(needed.select("response_id").distinct(), "response_id", "left_semi")
    response = response.groupBy("response_id").agg(F.max_by(F.struct("r_etag", "r_modified", "r_headers"), order).alias("r"))
    response = stage(needed.join(response, "response_id").select("response_id", "span", "r.*"), "revisit-responses")
    both = asked.join(response, ["response_id", "span"], "left")
    tag = lambda c: F.regexp_replace(F.col(c), r"^W/", "")  # noqa: E731  weak comparison
    resolution = (
        F.when(F.col("response_id").isNull(), "missing")
        .when(F.col("etag").isNotNull() & F.col("r_etag").isNotNull(), F.when(tag("etag") == tag("r_etag"), "resolved").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull() & F.col("r_modified").isNotNull(), F.when(F.col("last_modified") == F.col("r_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own, stored = F.coalesce("headers", none), F.coalesce("r_headers", none)
    listed = F.coalesce(F.transform(F.split(F.lower(own["connection"]), ","), lambda name: F.trim(name)), F.array().cast("array<string>"))
    update = F.map_filter(own, lambda k, _: ~k.isin(BODY + CONNECTION) & ~F.array_contains(listed, k))
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    both = both.withColumn("resolution", resolution)
    discard(rows, line, inherited, before)
    return both.select(
        "record_id", "canonical_url", "response_id", "resolution", F.when(F.col("resolution") == "resolved", merged).otherwise(F.col("headers")).alias("headers")
    )
