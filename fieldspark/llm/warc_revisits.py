"""Resolving not-modified revisit records of a web archive.

Method. A revisit (an answer 304 without a body) is joined to the latest earlier full response of the same
canonical URL: an as-of join. Its validators are checked against that response: entity tags by weak
comparison if both have one, else dates of last modification, else payload digests. Where they agree the
record is resolved to that response, whose header fields it takes; of its own it merges only the fields that a
304 may update.

Scale. Time is cut into buckets of ``bucket`` seconds. Inside (URL, bucket) a window finds the latest
earlier response; for what has none there, the last response of each earlier bucket is carried on over one
row for each bucket of a URL. So a URL with a third of all records is spread over its buckets.
Only header fields and digests move; bodies stay where they are.

Edge cases. A null URL, time or kind never matches: such a revisit has outcome no_response. A response at
the very time of a revisit is not earlier. Of responses at one time the one with the greatest id counts. Empty headers
and null values are allowed; of fields that differ in case only, the last counts. Repeated rows are resolved each. Extra columns
are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fields of a 304 that update a stored response, and parameters that only track visitors.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z_]+|gclid|fbclid|mc_eid|ref|sessionid)(=|$)"
DAY = 86_400


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, user, www and standard port; path without a last slash; sorted parameters without tracking; no fragment."""
    plain = F.regexp_replace(F.regexp_extract(url, r"^[^#]*", 0), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(plain, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www[0-9]*\.", "")
    rest = F.regexp_replace(plain, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"\?.*$", 0), r"^\?", "")
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Entries of a header map with names in lower case, the last of equal ones, without nulls."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    entries = F.filter(entries, lambda e: e["value"].isNotNull())
    names = F.transform(entries, lambda e: e["key"])
    single = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), e["key"]))
    return F.coalesce(F.map_from_entries(single), F.create_map().cast("map<string,string>"))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], r"^W/", "")


def _same(x: Column, y: Column) -> Column:
    return x.isNotNull() & y.isNotNull()


def resolve(records: DataFrame, bucket: int = DAY) -> DataFrame:
    """(record_id, canon_url, response_id, outcome, headers, digest) for each revisit.

    records has record_id long, url string, ts long (seconds), kind string (response or revisit), headers map<string,string>,
    digest string. outcome is resolved, mismatch (validators differ), unchecked (none to compare; nothing is merged) or no_response.
    """
    rows = records.select(
        "record_id",
        canonical_url(F.col("url")).alias("canon_url"),
        F.col("ts").cast("long").alias("ts"),
        F.coalesce(F.col("kind") == "response", F.lit(False)).alias("full"),
        F.coalesce(F.col("kind") == "revisit", F.lit(False)).alias("revisit"),
        _lowered(F.col("headers")).alias("h"),
        "digest",
    ).where("full or revisit")
    usable = F.col("canon_url").isNotNull() & F.col("ts").isNotNull()
    lost = rows.where(F.col("revisit") & ~usable).withColumn("found", F.lit(None).cast("struct<ts:bigint,record_id:bigint,h:map<string,string>,digest:string>"))
    rows = rows.where(usable).withColumn("bucket", F.floor(F.col("ts") / bucket))
    response = F.struct("ts", F.col("record_id").cast("long").alias("record_id"), "h", "digest")
    earlier = W.partitionBy("canon_url", "bucket").orderBy("ts", F.col("full").cast("int"), "record_id").rowsBetween(W.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last(F.when(F.col("full"), response), ignorenulls=True).over(earlier)).where("revisit")
    last = rows.where("full").groupBy("canon_url", "bucket").agg(F.max_by(response, F.struct("ts", "record_id")).alias("last"))
    stops = last.unionByName(near.where("near is null").select("canon_url", "bucket").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType)))
    stops = stops.groupBy("canon_url", "bucket").agg(F.first("last", ignorenulls=True).alias("last"))
    before = W.partitionBy("canon_url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = stops.withColumn("carried", F.last("last", ignorenulls=True).over(before)).select("canon_url", "bucket", "carried")
    found = near.join(carried, ["canon_url", "bucket"], "left").withColumn("found", F.coalesce("near", "carried"))
    columns = ["record_id", "canon_url", "h", "digest", "found"]
    found = found.select(*columns).union(lost.select(*columns))

    theirs, mine = F.col("found.h"), F.col("h")
    tags, dates, sums = _same(_tag(mine), _tag(theirs)), _same(mine["last-modified"], theirs["last-modified"]), _same(F.col("digest"), F.col("found.digest"))
    agree = F.when(tags, _tag(mine) == _tag(theirs)).when(dates, mine["last-modified"] == theirs["last-modified"]).when(sums, F.col("digest") == F.col("found.digest"))
    outcome = F.when(F.col("found").isNull(), "no_response").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    new = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    old = F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    lines = F.array_sort(F.transform(F.map_entries(F.map_concat(old, new)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    good = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "canon_url",
        F.when(F.col("outcome") != "no_response", F.col("found.record_id")).alias("response_id"),
        "outcome",
        F.when(good, F.array_join(lines, "\n")).alias("headers"),
        F.when(good, F.col("found.digest")).alias("digest"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records that follow from a table of pages: every page as a full response and a later revisit of its URL.

    A minute lies between pages and up to two days between a page and its revisit, which may have another
    form of the URL, a weak or another entity tag, or none.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    modified = F.concat(F.lit("day "), (p % 1000).cast("string"))
    full = F.struct(
        (2 * p).alias("record_id"),
        F.col("url").alias("url"),
        (60 * p).alias("ts"),
        F.lit("response").alias("kind"),
        F.create_map(
            F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=600")
        ).alias("headers"),
        F.md5("html").alias("digest"),
    )
    form = F.when(p % 4 == 1, F.regexp_replace("url", "^http", "HTTP")).when(p % 4 == 2, F.concat("url", F.lit("#again"))).otherwise(F.col("url"))
    mine = F.when(p % 6 == 2, F.lit(None)).when(p % 7 == 3, F.lit('"other"')).when(p % 5 == 1, F.concat(F.lit("W/"), tag)).otherwise(tag)
    revisit = F.struct(
        (2 * p + 1).alias("record_id"),
        form.alias("url"),
        (60 * p + 3600 * (p % 48) + 30).alias("ts"),
        F.lit("revisit").alias("kind"),
        F.create_map(F.lit("etag"), mine, F.lit("Last-Modified"), modified, F.lit("Date"), p.cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return pages.select(F.explode(F.array(full, revisit)).alias("r")).select("r.*")


#: The same rows as resolve(records_of_pages(pages)).
RESOLVE_SQL = r"""
WITH p AS (
  SELECT page_id, url, md5(html) AS digest, strlen(html) AS n, '"' || md5(html)[1:16] || '"' AS tag, 'day ' || (page_id % 1000) AS modified FROM pages
), forms AS (
  SELECT *, url AS full_url,
         CASE page_id % 4 WHEN 1 THEN regexp_replace(url, '^http', 'HTTP') WHEN 2 THEN url || '#again' ELSE url END AS again_url,
         CASE WHEN page_id % 6 = 2 THEN NULL WHEN page_id % 7 = 3 THEN '"other"' ELSE tag END AS again_tag
  FROM p
), urls AS (
  SELECT 2 * page_id AS record_id, full_url AS url, 60 * page_id AS ts, page_id FROM forms
  UNION ALL SELECT 2 * page_id + 1, again_url, 60 * page_id + 3600 * (page_id % 48) + 30, page_id FROM forms
), cut AS (
  SELECT *, regexp_replace(regexp_extract(url, '^[^#]*'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain FROM urls
), parts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[^/?]*')), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
         regexp_replace(plain, '^[^/?]*', '') AS rest FROM cut
), canon AS (
  SELECT *, list_sort(list_filter(string_split(regexp_replace(regexp_extract(rest, '\?.*$'), '^\?', ''), '&'),
              lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z_]+|gclid|fbclid|mc_eid|ref|sessionid)(=|$)'))) AS params FROM parts
), records AS (
  SELECT record_id, ts, page_id, host || regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') ||
         CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canon_url FROM canon
), found AS (
  SELECT v.record_id, v.canon_url, v.page_id AS own, arg_max(r.page_id, r.ts) AS other
  FROM records v LEFT JOIN records r ON v.canon_url = r.canon_url AND r.record_id % 2 = 0 AND r.ts < v.ts
  WHERE v.record_id % 2 = 1 GROUP BY ALL
), checked AS (
  SELECT f.*, o.digest, o.n, o.tag, a.again_tag, a.modified,
         CASE WHEN other IS NULL THEN 'no_response'
              WHEN CASE WHEN a.again_tag IS NOT NULL THEN a.again_tag = o.tag ELSE a.modified = o.modified END THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM found f JOIN forms a ON a.page_id = f.own LEFT JOIN forms o ON o.page_id = f.other
)
SELECT record_id, canon_url, 2 * other AS response_id, outcome,
       CASE outcome WHEN 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || n, 'content-type: text/html', 'date: ' || own,
         'etag: ' || CASE WHEN again_tag IS NOT NULL AND own % 5 = 1 AND own % 7 <> 3 THEN 'W/' || again_tag ELSE coalesce(again_tag, tag) END, 'last-modified: ' || modified) END AS headers,
       CASE outcome WHEN 'resolved' THEN digest END AS digest
FROM checked
"""
