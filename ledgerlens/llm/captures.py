"""Web archive records derived from ``pages``, for the revisit query.

Every page gives: a full response; for every third page a later response with
another body; up to two not-modified revisits under another spelling of the
URL, some with a stale entity tag, some without a validator in common, some
earlier than any response; and a revisit of its host's ``/robots.txt``, which
many pages share.  All values come from the page's id, URL and HTML, with
functions that Spark and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

COLUMNS = ("record_id", "warc_type", "profile", "target_uri", "second", "status", "etag", "modified", "cache", "length", "payload")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
_TAG = "concat('\"', substr(digest, {at}, 16), '\"')"
_PAGES = """
  select page_id as id, url, html, md5(html) as digest, regexp_extract(url, '^(https?)://([^/?#]+)', 2) as host,
         1700000000 + (page_id * 7919) % 2000000 as t
  from {pages} where page_id is not null and url is not null and html is not null
"""
#: Which pages give a record of the kind, and its values in the order of COLUMNS.
_KINDS = (
    ("true", "id * 8", "'response'", "''", "url", "t", "200", _TAG.format(at=1), "concat('day ', cast(id % 28 as varchar(10)))",
     "'max-age=60'", "cast(length(html) as varchar(20))", "html"),
    ("id % 3 = 0", "id * 8 + 1", "'response'", "''", "url", "t + 400000", "200", f"concat('W/', {_TAG.format(at=9)})",
     "concat('day ', cast(id % 28 as varchar(10)))", "'max-age=90'", "cast(length(html) as varchar(20))", "concat(html, '<!-- again -->')"),
    ("id % 2 = 0", "id * 8 + 2", "'revisit'", f"'{_PROFILE}'", "replace(replace(url, 'http://', 'HTTPS://'), '?utm_source=feed', '')",
     "t + 1000 + id % 90000", "304", f"concat('W/', {_TAG.format(at=1)})", "cast(null as varchar(20))", "'max-age=3600'", "'0'",
     "cast(null as varchar(10))"),
    ("true", "id * 8 + 3", "'revisit'", f"'{_PROFILE}'", "concat(url, '#part')", "t + 500000", "304",
     f"case when id % 5 = 0 then '\"stale\"' when id % 5 = 1 then null else {_TAG.format(at='case when id % 3 = 0 then 9 else 1 end')} end",
     "case when id % 10 = 1 then concat('day ', cast(id % 28 as varchar(10))) end", "'no-cache'", "'0'", "cast(null as varchar(10))"),
    ("id % 7 = 0", "id * 8 + 4", "'revisit'", f"'{_PROFILE}'", "url", "t - 5000", "304", _TAG.format(at=1), "cast(null as varchar(20))",
     "'no-cache'", "'0'", "cast(null as varchar(10))"),
    ("id % 4 < 2", "id * 8 + 5", "'response'", "''", "concat('http://', host, '/robots.txt')", "t", "200",
     "concat('\"', substr(md5(concat(host, cast(id % 4 as varchar(5)))), 1, 16), '\"')", "'day 1'", "'max-age=60'", "'12'",
     "concat('User-agent: ', cast(id % 4 as varchar(5)))"),
    ("true", "id * 8 + 6", "'revisit'", f"'{_PROFILE}'", "concat('https://', host, ':443/robots.txt')", "t + 30", "304",
     "concat('\"', substr(md5(concat(host, '0')), 1, 16), '\"')", "cast(null as varchar(20))", "'no-cache'", "'0'", "cast(null as varchar(10))"),
)
#: For DuckDB, one SELECT per kind; the first one's columns are named by the caller.
RECORDS_SQL = "with p as (" + _PAGES.format(pages="pages") + ")\n" + "\nunion all\n".join(
    f"select {', '.join(values)} from p where {which}" for which, *values in _KINDS)


def _struct(values: list[str]) -> str:
    types = ("bigint", "string", "string", "string", "bigint", "int", "string", "string", "string", "string", "string")
    return "named_struct(" + ", ".join(f"'{c}', cast({v} as {t})" for c, v, t in zip(COLUMNS, values, types, strict=True)) + ")"


def capture_records(pages: DataFrame) -> DataFrame:
    """The derived records in the form ``resolve_revisits`` takes; ``pages``
    is read once, every page gives its records as an array."""
    kinds = ", ".join(f"case when {which} then {_struct(values)} end" for which, *values in _KINDS)
    found = pages.sparkSession.sql(_PAGES, pages=pages)
    rows = found.selectExpr(f"inline(filter(array({kinds}), r -> r is not null))")
    return rows.selectExpr(
        "record_id", "warc_type", "profile", "target_uri", "timestamp_seconds(second) as warc_date", "status",
        """map_filter(map('etag', etag, 'last-modified', modified, 'cache-control', cache, 'content-length', length,
                          'connection', if(status = 304, 'keep-alive', null)), (k, v) -> v is not null) as headers""",
        "payload")
