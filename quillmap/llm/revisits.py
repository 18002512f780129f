"""Not-modified revisit records resolved to the full responses they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of one slice of a URL's history; a much captured URL spreads over its slices.
SLICE = 3_600
#: Query parameters that only track where a visitor came from.
TRACKING = r"(?i)(?<=[?&])(?:utm_[^=&]*|gclid|fbclid|ref)=[^&]*(?:&|$)"
#: Fields of a 304 that do not update a stored response, by the HTTP caching
#: rules: those of the message it came in, and those that describe the stored body.
NOT_MERGED = (
    "connection keep-alive proxy-authenticate proxy-authentication-info proxy-authorization proxy-connection te trailer "
    "transfer-encoding upgrade content-encoding content-length content-range content-type"
).split()


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path, and parameters in order.

    Scheme, fragment, tracking parameters and a slash at the path's end do not count.
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^(?i:[a-z][a-z0-9+.-]*:)?//", "")
    rest = F.regexp_replace(rest, TRACKING, "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.array_remove(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), "")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def field(headers: Column, name: str) -> Column:
    """The value of a header, whatever the case of its name."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.trim(F.get(found, F.lit(0))["value"])


def lower_names(headers: Column) -> Column:
    """Headers with names in lower case; of names that then agree the first stays."""
    entries = F.map_entries(headers)
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def merge_headers(stored: Column, new: Column) -> Column:
    """The stored fields, replaced or joined by the permitted ones of the 304."""
    permitted = F.map_filter(new, lambda k, _: ~k.isin(NOT_MERGED))
    kept = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(permitted), k))
    return F.map_concat(kept, permitted)


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE) -> DataFrame:
    """One row for every revisit: record_id, url_key, outcome, response_id, headers, digest.

    `records` has record_id, url, captured_at (seconds), kind (`response` or `revisit`),
    headers (map) and digest of the body. A revisit belongs to the latest response of its
    canonical URL before it, in order of captured_at, then record_id. An entity tag decides
    if both sides name one (weak marks do not count), else the modification date, else
    nothing can be checked. Outcomes: `resolved`, `mismatch`, `unchecked`, `no_response`;
    headers are merged and digest is filled for `resolved` only. A null URL or time finds no response.
    Repeated rows repeat; other columns are not read.

    As-of join: histories are cut into slices of time. In a slice the last response before
    a row comes from a window; what precedes the slice comes from one row a slice.
    """
    events = records.select(
        "record_id",
        canonical_url(F.col("url")).alias("url_key"),
        "captured_at",
        (F.col("kind") == "response").alias("full"),
        lower_names(F.coalesce("headers", F.create_map().cast("map<string,string>"))).alias("headers"),
        "digest",
    ).withColumn("slice", F.floor(F.col("captured_at") / slice_seconds))
    known = events.where("url_key IS NOT NULL AND captured_at IS NOT NULL")
    response = F.struct("captured_at", "record_id", F.to_json("headers").alias("headers"), "digest")
    before = (
        Window.partitionBy("url_key", "slice")
        .orderBy("captured_at", "record_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = known.withColumn("inside", F.last(F.when(F.col("full"), response), ignorenulls=True).over(before)).where("NOT full")
    # one row for each slice in which a URL was captured
    last = known.groupBy("url_key", "slice").agg(F.max(F.when(F.col("full"), response)).alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("url_key", "slice", F.last("last", ignorenulls=True).over(earlier).alias("outside"))
    found = (
        seen.join(carried, ["url_key", "slice"])
        .withColumn("response", F.coalesce("inside", "outside"))
        .select("record_id", "url_key", "headers", "response")
    )
    lost = events.where("NOT full AND (url_key IS NULL OR captured_at IS NULL)").select(
        "record_id", "url_key", "headers", F.lit(None).cast(found.schema["response"].dataType).alias("response")
    )
    rows = found.unionByName(lost).withColumn(
        "stored", F.from_json(F.col("response.headers"), "map<string,string>")
    )
    tag = [F.regexp_replace(field(F.col(h), "etag"), "^W/", "") for h in ("headers", "stored")]
    date = [field(F.col(h), "last-modified") for h in ("headers", "stored")]
    agrees = F.coalesce(tag[0] == tag[1], date[0] == date[1])
    outcome = (
        F.when(F.col("response").isNull(), "no_response")
        .when(agrees.isNull(), "unchecked")
        .when(agrees, "resolved")
        .otherwise("mismatch")
    )
    resolved = F.col("outcome") == "resolved"
    return rows.withColumn("outcome", outcome).select(
        "record_id",
        "url_key",
        "outcome",
        F.col("response.record_id").alias("response_id"),
        F.when(resolved, merge_headers(F.col("stored"), F.col("headers"))).alias("headers"),
        F.when(resolved, F.col("response.digest")).alias("digest"),
    )


def capture_history(pages: DataFrame) -> DataFrame:
    """A capture history made from the pages: each page's response and two revisits of its URL.

    The first revisit comes three days later and names an entity tag, a wrong one for
    every fifth page; the second comes between two days earlier and eight days later and
    names a modification date, a wrong one for every fourth page.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    at = F.col("page_id") * 600
    age = F.concat(F.lit("max-age="), (F.col("page_id") % 7 * 60).cast("string"))
    changed = F.concat(F.lit("version "), (F.col("page_id") % 3).cast("string"))
    length = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")

    def headers(**fields: Column) -> Column:
        return F.create_map(*(x for n, v in fields.items() for x in (F.lit(n.replace("_", "-")), v)))

    def record(number: int, kind: str, time: Column, fields: Column, digest: Column) -> Column:
        return F.struct(
            (F.col("page_id") * 3 + number).alias("record_id"),
            time.alias("captured_at"),
            F.lit(kind).alias("kind"),
            fields.alias("headers"),
            digest.alias("digest"),
        )

    wrong = F.when(F.col("page_id") % 5 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    own = headers(ETag=tag, Last_Modified=changed, Content_Type=F.lit("text/html"), Content_Length=length, Cache_Control=age)
    later = headers(etag=wrong, cache_control=F.lit("no-cache"), content_length=F.lit("0"), date=(at + 259_200).cast("string"))
    other = at + (F.col("page_id") % 11 - 2) * 86_400
    dated = F.when(F.col("page_id") % 4 == 0, F.lit("version x")).otherwise(changed)
    plain = headers(last_modified=dated, content_type=F.lit("text/plain"), Connection=F.lit("close"), date=other.cast("string"))
    nothing = F.lit(None).cast("string")
    return pages.select(
        "url",
        F.inline(
            F.array(
                record(0, "response", at, own, F.sha2("html", 256)),
                record(1, "revisit", at + 259_200, later, nothing),
                record(2, "revisit", other, plain, nothing),
            )
        ),
    )
