"""Not-modified revisits of a web archive, resolved to the full responses they stand for.

A revisit record says that a server answered "not modified".  It is joined, as of its time, to the latest earlier full
response of the same canonical URL.  The join is exact however many records one URL has: the records of a URL with more
than ``hot`` of them are parted by time, each part is ordered for itself, and the last response of each part is handed on
to the later ones.  Records without their payloads are light, so nothing else is moved.

Then validators are checked: entity tags (compared weakly, without W/) if both records have one, else dates of last
modification, else payload digests.  Where all that both have agree, the revisit takes the response's status, payload and
headers, updated by those of its own headers that a not-modified answer may change: not those that describe the stored
payload or the connection.

A full response is a record of kind response whose status is null or from 200 to 299, but for 206 (a part); responses of
other statuses and records of other kinds are no sources and have no result rows.

outcome: resolved, no_earlier_response, validator_mismatch, no_validator (nothing to compare), or bad_record (url or
time is null).  Ties: of responses of one time the largest record_id counts, of one record_id the largest entity tag, date, digest,
status and headers (as JSON), in this order; one of the revisit's own time isn't earlier.  Header names are compared in lower case; of one name given twice the last counts; a null header map is empty.
Repeated rows give repeated result rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, saved, table

#: Headers of a not-modified answer that don't replace stored ones (RFC 9110, RFC 9111).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
HOT = 100_000
PARTS = 64


def canonical(url: Column) -> Column:
    """Host in lower case, without www. and default port; path without its last slash; query without trackers, its
    parts in order; no scheme, user or fragment."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def tidy(headers: Column) -> Column:
    """Entries with lower-case names, the last of each name."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers updated by the permitted ones of fresh; both tidy entries. A map in order of names."""
    allowed = F.filter(fresh, lambda e: ~e["key"].isin(*NOT_MERGED))
    kept = F.filter(stored, lambda e: ~F.exists(allowed, lambda x: x["key"] == e["key"]))
    return F.map_from_entries(F.array_sort(F.concat(kept, allowed)))


def resolve(records: DataFrame, hot: int = HOT) -> DataFrame:
    """records: record_id, url, kind (response or revisit), at (bigint), status, etag, last_modified, digest (strings), headers
    (map).  One row per revisit: record_id, url_key, at, outcome, source_id, status, digest, headers."""
    rows = records.withColumn("url_key", canonical(F.col("url")))
    fine = F.col("url").isNotNull() & F.col("at").isNotNull()
    full = (F.col("kind") == "response") & F.coalesce(F.col("status").between(200, 299) & (F.col("status") != 206), F.lit(True))
    rows = rows.where(full | (F.col("kind") == "revisit")).withColumn("tie", F.struct("etag", "last_modified", "digest", "status", F.to_json("headers").alias("headers")))
    # A response is not earlier than a revisit of its own time, so revisits go first in order.
    answer = F.when(F.col("kind") == "response", F.struct("at", "record_id", "etag", "last_modified", "digest", "status", "headers"))
    light = saved(rows.where(fine & F.col("kind").isin("response", "revisit")).select("url_key", "at", "record_id", "kind", "etag", "last_modified", "digest", "headers", "tie", answer.alias("answer")), "records")
    # Borders in time are looked for only where a URL has too many records.
    many = saved(light.groupBy("url_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("url_key"), "many")
    of_many = light.join(broadcast_if(many, many.count(), 10_000), "url_key", "left_semi")
    crowded = saved(of_many.groupBy("url_key").agg(F.percentile_approx("at", [k / PARTS for k in range(1, PARTS)], 1000).alias("cuts")), "crowded")
    light = light.join(broadcast_if(crowded, crowded.count(), 10_000), "url_key", "left")
    light = light.withColumn("part", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("at"))))).drop("cuts")
    w = Window.partitionBy("url_key", "part").orderBy("at", (F.col("kind") == "response").cast("int"), "record_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = light.withColumn("source", F.last("answer", ignorenulls=True).over(w)).where("kind = 'revisit'")
    # Last responses of earlier parts: maps aren't ordered, so the latest is found by time and id.
    last = light.where("answer is not null").join(F.broadcast(crowded.select("url_key")) if crowded.count() <= 10_000 else crowded.select("url_key"), "url_key", "left_semi")
    last = last.groupBy("url_key", "part").agg(F.max_by("answer", F.struct("at", "record_id", "tie")).alias("final"))
    span = light.select("url_key", "part").join(last.select("url_key").distinct(), "url_key", "left_semi").distinct().join(last, ["url_key", "part"], "left")
    v = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = span.select("url_key", "part", F.last("final", ignorenulls=True).over(v).alias("carried"))
    if not crowded.isEmpty():
        seen = seen.join(carry, ["url_key", "part"], "left").withColumn("source", F.coalesce("source", "carried")).drop("carried")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    s = F.col("source")
    tags = F.col("etag").isNotNull() & s["etag"].isNotNull()
    dates = F.col("last_modified").isNotNull() & s["last_modified"].isNotNull()
    digests = F.col("digest").isNotNull() & s["digest"].isNotNull()
    agree = F.when(tags, weak(F.col("etag")) == weak(s["etag"])).when(dates, F.col("last_modified") == s["last_modified"]).otherwise(F.lit(True)) & F.when(digests, F.col("digest") == s["digest"]).otherwise(F.lit(True))
    outcome = F.when(s.isNull(), "no_earlier_response").when(~(tags | dates | digests), "no_validator").when(agree, "resolved").otherwise("validator_mismatch")
    found = seen.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    found = found.select("record_id", "url_key", "at", "outcome", F.when(ok, s["record_id"]).alias("source_id"), F.when(ok, s["status"]).alias("status"), F.when(ok, s["digest"]).alias("digest"), F.when(ok, merged(tidy(s["headers"]), tidy(F.col("headers")))).alias("headers"))
    bad = rows.where(~fine & (F.col("kind") == "revisit")).select("record_id", "url_key", "at", F.lit("bad_record").alias("outcome"), *[F.lit(None).cast(t).alias(n) for n, t in (("source_id", "bigint"), ("status", "int"), ("digest", "string"), ("headers", "map<string,string>"))])
    return found.unionByName(bad)


def archive(pages: DataFrame) -> DataFrame:
    """Captures made of pages, in the order of page_id: an early revisit, the full response, and a later revisit, whose
    server reports another entity tag if the page's length is a multiple of five and none if it's one of seven."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", F.md5(html).alias("digest"), F.length(html).cast("bigint").alias("n"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    none = F.lit(None).cast("string")
    later = F.when(F.col("n") % 5 == 0, F.concat(F.lit('"x'), F.substring("digest", 1, 15), F.lit('"'))).when(F.col("n") % 7 == 0, none).otherwise(F.concat(F.lit("W/"), tag))
    kinds = F.array(
        F.struct((F.col("page_id") * 3).alias("record_id"), F.lit("revisit").alias("kind"), (F.col("page_id") * 4).alias("at"), F.lit(304).alias("status"), tag.alias("etag"), none.alias("digest"), F.create_map(F.lit("Date"), F.lit("early")).alias("headers")),
        F.struct((F.col("page_id") * 3 + 1).alias("record_id"), F.lit("response").alias("kind"), (F.col("page_id") * 4 + 1).alias("at"), F.lit(200).alias("status"), tag.alias("etag"), F.col("digest"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("n").cast("string"), F.lit("Date"), F.lit("first"), F.lit("ETag"), tag).alias("headers")),
        F.struct((F.col("page_id") * 3 + 2).alias("record_id"), F.lit("revisit").alias("kind"), (F.col("page_id") * 4 + 6).alias("at"), F.lit(304).alias("status"), later.alias("etag"), none.alias("digest"), F.create_map(F.lit("Date"), F.lit("later"), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers")),
    )
    return p.select("url", F.explode(kinds).alias("r")).select("url", "r.*", F.lit(None).cast("string").alias("last_modified"))


def op2_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve(archive(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "url_key", "at", "outcome", "source_id", "status", "digest", F.when(F.col("headers").isNotNull(), lines).alias("headers"))


OP2_SQL = r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '', 's') AS bare FROM pages),
c AS (SELECT *, '"' || digest[1:16] || '"' AS tag, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^.*@', ''), ':(80|443)$', ''), '^www\.', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS k0,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS q FROM p),
k AS (SELECT *, k0 || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_key FROM c),
resp AS (SELECT url_key, page_id * 3 + 1 AS source_id, page_id * 4 + 1 AS "at", digest, n, tag FROM k),
rev AS (SELECT url_key, page_id * 3 AS record_id, page_id * 4 AS "at", tag AS etag, 0 AS late FROM k
    UNION ALL SELECT url_key, page_id * 3 + 2, page_id * 4 + 6, CASE WHEN n % 5 = 0 THEN '"x' || digest[1:15] || '"' WHEN n % 7 = 0 THEN NULL ELSE 'W/' || tag END, 1 FROM k),
j AS (SELECT rev.*, resp.source_id, resp."at" AS rat, resp.digest, resp.n, resp.tag, row_number() OVER (PARTITION BY record_id ORDER BY resp."at" DESC NULLS LAST, resp.source_id DESC) AS rn FROM rev LEFT JOIN resp ON rev.url_key = resp.url_key AND resp."at" < rev."at"),
o AS (SELECT *, CASE WHEN url_key IS NULL THEN 'bad_record' WHEN source_id IS NULL THEN 'no_earlier_response' WHEN etag IS NULL THEN 'no_validator' WHEN regexp_replace(etag, '^W/', '') = tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM j WHERE rn = 1)
SELECT record_id, url_key, "at", outcome, CASE WHEN outcome = 'resolved' THEN source_id END AS source_id, CASE WHEN outcome = 'resolved' THEN CAST(200 AS INTEGER) END AS status, CASE WHEN outcome = 'resolved' THEN digest END AS digest,
    CASE WHEN outcome = 'resolved' THEN CASE WHEN late = 1 THEN 'cache-control: max-age=60' || chr(10) ELSE '' END || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || CASE WHEN late = 1 THEN 'later' ELSE 'early' END || chr(10) || 'etag: ' || tag END AS headers FROM o
"""
