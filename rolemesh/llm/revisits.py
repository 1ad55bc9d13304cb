"""Not-modified captures of a web archive, resolved to the response they stand for.

A revisit says that a page had not changed. It is joined as of its time to the latest
earlier full response of the same canonical URL; their validators are compared and the
headers that a not-modified answer may renew are merged into the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header names that a 304 answer may renew, and parameters that do not name a page.
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"

BUCKET = 86_400  # time units of a piece of a URL's history


def canonical_url(url: Column) -> Column:
    """Host in lower case, no scheme, fragment, default port, tracking parameter or closing slash."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    base = F.regexp_replace(F.substring_index(plain, "?", 1), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.substring_index(base, "/", 1)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(base, "^[^/]*", ""), "/+$", "")
    query = F.when(plain.contains("?"), F.regexp_replace(plain, "^[^?]*[?]", "")).otherwise("")
    kept = F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _tag(entries: Column) -> Column:
    return F.regexp_replace(entries["etag"], "^W/", "")


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Every revisit of ``records`` (record_id, url, ts, status, headers) with what it resolves to.

    status 200 is a full response, 304 a revisit; other rows are left out. Output:
    record_id, url_key, ts, response_id, response_ts, outcome, headers. outcome is
    ``resolved`` (validators agree), ``mismatch`` (they differ), ``unverified`` (there is
    nothing to compare) or ``missing`` (no earlier response); headers are merged where
    resolved or unverified, else null. An ETag counts before a date, weak and strong tags
    compare equal. Of responses at one time the largest record_id counts; a response at
    the revisit's own time is not earlier. Rows with a null url or ts have no partner:
    null revisits come out as missing. Header names are lower case; a null map is empty.

    A URL's history is cut into pieces of ``bucket`` time units. Within a piece the latest
    response runs along the rows; between pieces only each piece's last one does, so a URL
    with very many captures is spread over its pieces.
    """
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    rows = records.where("status in (200, 304)").select(
        "record_id", "ts", "status", canonical_url(F.col("url")).alias("url_key"), headers.alias("headers"),
        F.floor(F.col("ts") / bucket).alias("piece"),
    )
    # Rows without a key or time would meet in one group.
    lost = rows.where("status = 304 and (url_key is null or ts is null)").select(
        "record_id", "url_key", "ts", "headers", F.lit(None).cast("struct<ts:bigint,id:string,entries:array<struct<key:string,value:string>>>").alias("found")
    )
    rows = rows.where("url_key is not null and ts is not null")
    entries = F.sort_array(F.map_entries("headers"))
    full = F.when(F.col("status") == 200, F.struct(F.col("ts").cast("long").alias("ts"), F.col("record_id").cast("string").alias("id"), entries.alias("entries")))
    rows = rows.withColumn("full", full)
    earlier = Window.partitionBy("url_key", "piece").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    last = rows.where("status = 200").groupBy("url_key", "piece").agg(F.max("full").alias("last"))
    pieces = rows.select("url_key", "piece").distinct().join(last, ["url_key", "piece"], "left")
    before = Window.partitionBy("url_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select("url_key", "piece", F.max("last").over(before).alias("carried"))
    found = (
        rows.withColumn("near", F.max("full").over(earlier))
        .where("status = 304")
        .join(carried, ["url_key", "piece"])
        .select("record_id", "url_key", "ts", "headers", F.coalesce("near", "carried").alias("found"))
        .unionByName(lost)
    )
    stored = F.map_from_entries(F.col("found.entries"))
    mine, theirs = F.col("headers"), stored
    compared = (
        F.when(_tag(mine).isNotNull() & _tag(theirs).isNotNull(), _tag(mine) == _tag(theirs))
        .when(mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull(), mine["last-modified"] == theirs["last-modified"])
    )
    outcome = (
        F.when(F.col("found").isNull(), "missing")
        .when(compared.isNull(), "unverified")
        .when(compared, "resolved")
        .otherwise("mismatch")
    )
    renewed = F.map_filter(mine, lambda k, v: k.isin(RENEWED))
    kept = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(renewed, k))
    return found.select(
        "record_id",
        "url_key",
        "ts",
        F.col("found.id").alias("response_id"),
        F.col("found.ts").alias("response_ts"),
        outcome.alias("outcome"),
        F.when(outcome.isin("resolved", "unverified"), F.map_concat(kept, renewed)).alias("headers"),
    )


def header_text(headers: Column) -> Column:
    """Headers as lines ``name: value``, by name."""
    lines = F.transform(F.sort_array(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(lines, "\n")
