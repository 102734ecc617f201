"""Operator 6: resolving not-modified revisit records of a web archive.

A revisit record with the server-not-modified profile holds only the headers
of a 304 answer.  It stands for the latest earlier full response of the same
canonical URL, if the validators agree; the headers a 304 may update then
replace the stored ones.

As-of join without sorting a URL in one task: captures are first reduced to
one row per (URL, microsecond), these are windowed per (URL, ``SPAN`` seconds), and
the last response of each span is carried over the spans of a URL.  A URL
with a third of all records is added up on the map side and split over its
spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SPAN = 86_400
PROFILE = "server-not-modified"

# fixed values: fields a 304 answer must not change in a stored response (HTTP caching rules):
# those that belong to one connection, and those that describe the stored body
KEPT_FIELDS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization",
               "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
               "content-encoding", "content-length", "content-range", "content-type")
# fixed values: query parameters that identify a visit, not a page
VISIT_FIELDS = "utm_[a-z]+|gclid|fbclid|phpsessid|jsessionid|sid"


def canonical_url(url: Column) -> Column:
    """Scheme, user, default port, ``www.``, fragment, visit parameters and a
    final slash go; host in lower case, remaining parameters in order."""
    url = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(url, "^(?i:https?)://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{VISIT_FIELDS})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _opaque(tag: Column) -> Column:
    """An entity tag without its weakness mark (weak comparison)."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _permitted(headers: Column) -> Column:
    """The fields of a 304 answer that may update a stored response."""
    listed = F.transform(F.split(F.lower(F.coalesce(F.try_element_at(headers, F.lit("connection")), F.lit(""))), ","), F.trim)
    return F.map_filter(headers, lambda k, v: ~k.isin(*KEPT_FIELDS) & ~F.array_contains(listed, k) & v.isNotNull())


def latest_earlier(records: DataFrame) -> DataFrame:
    """(url, micros) of every record with ``found``: (record_id, row) of the
    latest full response of that URL at an earlier time (of two at one time,
    the larger id).  Rows without a URL or a date are left out."""
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    points = records.where("url is not null and micros is not null").groupBy("url", "micros").agg(
        F.max(F.when(full, F.struct("record_id", "row"))).alias("full"))
    points = points.withColumn("span", F.floor(F.col("micros") / (SPAN * 1_000_000)))
    inside = Window.partitionBy("url", "span").orderBy("micros").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = points.groupBy("url", "span").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.col("micros"))).alias("full")) \
        .select("url", "span", F.last("full", ignorenulls=True).over(before).alias("carried"))
    return (points.withColumn("near", F.last("full", ignorenulls=True).over(inside)).join(carried, ["url", "span"])
            .select("url", "micros", F.coalesce("near", "carried").alias("found")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolves the not-modified revisits among ``records``.

    ``records``: record_id long, warc_type, profile, target_uri, warc_date
    timestamp, status int, headers map<string,string> (lower-case names),
    payload string; other columns are ignored.

    Returns one row per revisit of the profile: record_id, url (canonical),
    warc_date, response_id (the latest earlier full response, null without
    one), outcome, headers (merged) and payload (both null unless resolved).
    Outcomes: ``resolved``; ``no_response``; ``changed`` (the entity tags
    differ, or, without two tags, the Last-Modified dates); ``unverified``
    (no validator in common).  A null URL or date has no response; a null
    header map counts as empty; an empty table gives no rows.  Records that
    repeat an id are records of their own: each revisit row gives one row, and
    takes one response row (of several at one time with one id, any).

    The records are read once and stored with their canonical URL, for the
    as-of join to read its few columns.  Revisits without a response, whose
    keys are null, go round the joins; the payload comes last, by the row of
    the response, for resolved revisits only.
    """
    rows = materialize(records.select(
        F.monotonically_increasing_id().alias("row"), "record_id", "warc_type", "profile", "warc_date", "status",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "payload",
        canonical_url(F.col("target_uri")).alias("url"), F.unix_micros("warc_date").alias("micros")), "records")
    revisits = rows.where(F.col("warc_type") == "revisit").where(F.col("profile").endswith(PROFILE)) \
        .select("record_id", "url", "micros", "warc_date", "headers")
    dated = F.col("url").isNotNull() & F.col("micros").isNotNull()
    linked = materialize(revisits.where(dated).join(latest_earlier(rows), ["url", "micros"], "left").unionByName(
        revisits.where(~dated), allowMissingColumns=True).drop("micros"), "linked")
    stored = rows.where("warc_type = 'response' and status = 200").select("row", F.col("headers").alias("stored"))
    tag, old_tag = (_opaque(F.try_element_at(c, F.lit("etag"))) for c in ("headers", "stored"))
    date, old_date = (F.trim(F.try_element_at(c, F.lit("last-modified"))) for c in ("headers", "stored"))
    agrees = F.coalesce(tag == old_tag, date == old_date)
    outcome = F.when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("changed")
    fresh = _permitted(F.col("headers"))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    judged = materialize(linked.where("found is not null").select(
        "record_id", "url", "warc_date", "headers", F.col("found.record_id").alias("response_id"), F.col("found.row").alias("row"))
        .join(stored, "row").select("row", "record_id", "url", "warc_date", "response_id", outcome.alias("outcome"),
                                    F.when(outcome == "resolved", merged).alias("headers")), "judged")
    bodies = rows.where("warc_type = 'response' and status = 200").select("row", "payload")
    nothing = [F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("payload")]
    columns = ["record_id", "url", "warc_date", "response_id", "outcome"]
    alone = linked.where("found is null").select("record_id", "url", "warc_date", F.lit(None).cast("long").alias("response_id"),
                                                 F.lit("no_response").alias("outcome"), *nothing)
    other = judged.where("outcome <> 'resolved'").select(*columns, *nothing)
    resolved = judged.where("outcome = 'resolved'").join(bodies, "row").select(*columns, "headers", "payload")
    return resolved.unionByName(other).unionByName(alone)
