"""Operator 2: not-modified revisits resolved by an as-of join to the latest earlier full response of the same URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import stash

#: Fields that a 304 answer may update (fixed values: those that RFC 9110, 15.4.5 lists, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: End of the profile's name in WARC 1.0 and 1.1 (fixed value).
PROFILE = "server-not-modified"
#: Query parameters that do not tell pages apart.
TRACKING = r"(?i)^(utm_[a-z]+|jsessionid|phpsessid|sid)(=|$)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def canonical(url: Column) -> Column:
    """Host in lower case without www and usual ports, path without closing slashes, other parameters in order.

    Scheme, user, fragment and TRACKING parameters go. Null where url is null or has no scheme and host.
    """
    whole = F.regexp_replace(F.trim(url), r"#[\s\S]*$", "")
    host = F.lower(F.regexp_extract(whole, SCHEME + r"(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www[0-9]*\.", "")
    rest = F.regexp_replace(whole, SCHEME + r"[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?([\s\S]*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")))


def field(headers: Column, name: str) -> Column:
    """Value of the first field of that name, trimmed; null if there is none."""
    return F.trim(F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), 0)["value"])


def merged(old: Column, new: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """Fields of old, with those that new has and may update replaced by new's."""
    may = F.filter(new, lambda h: F.lower(h["name"]).isin(*permitted))
    return F.concat(F.filter(old, lambda h: ~F.coalesce(F.exists(may, lambda m: F.lower(m["name"]) == F.lower(h["name"])), F.lit(False))), may)


def _matched(etag: Column, modified: Column, base_etag: Column, base_modified: Column) -> Column:
    """The validator that ties a 304 answer to the stored response, or null: ETag leads, then Last-Modified.

    ETags are compared weakly (a leading W/ is left out) where the answer's is weak, else exactly. Without validators
    on either side there is nothing to contradict the join: 'none'.
    """
    bare = lambda tag: F.regexp_replace(tag, "^W/", "")
    tags = F.when(etag.startswith("W/"), bare(etag) == bare(base_etag)).otherwise(etag == base_etag)
    dates = modified == base_modified
    free = etag.isNull() & modified.isNull() & base_etag.isNull() & base_modified.isNull()
    return F.when(etag.isNotNull() & base_etag.isNotNull(), F.when(tags, "etag")).when(dates, "last-modified").when(free, "none")


def resolve(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """record_id, url_key, outcome, base_id, matched_by, status, headers and payload of every record.

    records: record_id long, uri string, date (any ordered type), type string, profile string, status int, headers
    array<struct<name,value>>, payload string or binary; other columns are ignored. A full response is of type
    `response` with status 200; a revisit is of type `revisit` with a profile ending in PROFILE. A revisit takes the
    full response of its canonical URL with the latest date before its own (of one date: the greatest record_id). If
    validators agree, its outcome is `resolved`, with status and payload of that response and merged() headers. Else
    it is `mismatch` (base_id tells the response), `no_response`, `no_url` or `no_date`, and the record's own fields
    stay, as they do for all other records: `response` and `other`. Null headers count as none. Full responses
    without URL or date serve no revisit. Repeated rows each give a row; an empty table gives none.

    Rows are dealt by range of (URL, date, ...), so a hot URL spreads over many partitions; each cell of one URL and
    one partition is scanned by itself, and only the last full response of each cell is carried to later ones. The
    payload is left out until the end, and joined by response and cell, so a hot response is spread in the same way.
    """
    own = records.select(
        "record_id", canonical(F.col("uri")).alias("url_key"), "date", F.lower("type").alias("type"),
        F.coalesce(F.col("profile").rlike(PROFILE + r"/?$"), F.lit(False)).alias("ours"), "status",
        F.coalesce(F.filter("headers", lambda h: h["name"].isNotNull()), F.array().cast(records.schema["headers"].dataType)).alias("headers"), "payload",
    )
    own = own.withColumn("full", F.coalesce((F.col("type") == "response") & (F.col("status") == 200), F.lit(False)))
    # names a row: equal in rows that are equal in all that counts
    own = own.withColumn("tie", F.md5(F.to_json(F.struct("record_id", "url_key", "date", "headers", F.col("payload").isNull(), F.md5(F.col("payload").cast("binary")))).cast("binary")))
    order = ["date", "serves", "record_id", "tie"]
    keys = own.withColumn("serves", F.col("full") & F.col("url_key").isNotNull() & F.col("date").isNotNull()).drop("payload")
    # of one date responses come after revisits: what precedes a revisit is earlier than it
    keys = stash(keys.repartitionByRange("url_key", *order).withColumn("cell", F.spark_partition_id()))
    base = F.when(F.col("serves"), F.struct("record_id", "tie", "status", "headers"))
    ends = keys.filter("serves").groupBy("url_key", "cell").agg(F.max(F.struct("date", "record_id", "tie", "status", "headers")).alias("end"))
    cells = keys.groupBy("url_key", "cell").agg(F.lit(1).alias("one")).join(ends, ["url_key", "cell"], "left")
    before = Window.partitionBy("url_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(F.col("url_key").alias("u"), F.col("cell").alias("c"), F.last("end", ignorenulls=True).over(before).alias("end")).filter("end is not null")
    here = F.last(base, ignorenulls=True).over(Window.partitionBy("url_key", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    seen = keys.withColumn("base", here).join(carried, (F.col("url_key") == F.col("u")) & (F.col("cell") == F.col("c")), "left")
    seen = seen.withColumn("base", F.coalesce("base", F.when(F.col("end").isNotNull(), F.struct("end.record_id", "end.tie", "end.status", "end.headers"))))
    revisit = (F.col("type") == "revisit") & F.col("ours")
    seen = seen.withColumn("base", F.when(revisit & F.col("url_key").isNotNull() & F.col("date").isNotNull(), F.col("base")))
    held = [field(F.col(h), n) for h in ("headers", "base.headers") for n in ("etag", "last-modified")]
    seen = seen.withColumn("matched_by", F.when(F.col("base").isNotNull(), _matched(*held)))
    outcome = (
        F.when(F.col("full"), "response").when(~F.coalesce(revisit, F.lit(False)), "other").when(F.col("url_key").isNull(), "no_url")
        .when(F.col("date").isNull(), "no_date").when(F.col("base").isNull(), "no_response").when(F.col("matched_by").isNull(), "mismatch").otherwise("resolved")
    )
    seen = seen.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    seen = stash(seen.select(
        "record_id", "url_key", "outcome", F.col("base.record_id").alias("base_id"), "matched_by", F.when(done, F.col("base.status")).otherwise(F.col("status")).alias("status"),
        F.when(done, merged(F.col("base.headers"), F.col("headers"), permitted)).otherwise(F.col("headers")).alias("headers"), F.when(done, F.col("base.tie")).otherwise(F.col("tie")).alias("from"), "cell",
    ))
    # the payload of each row named in `from`, once for each cell that wants it
    bodies = own.groupBy(F.col("tie").alias("t")).agg(F.first("payload").alias("payload"))
    wanted = seen.select(F.col("from").alias("f"), F.col("cell").alias("c")).distinct()
    bodies = wanted.join(bodies, F.col("f") == F.col("t")).select("f", "c", "payload")
    out = seen.join(bodies, (F.col("from") == F.col("f")) & (F.col("cell") == F.col("c")))
    return out.select("record_id", "url_key", "outcome", "base_id", "matched_by", "status", "headers", "payload")


def crawl(pages: DataFrame) -> DataFrame:
    """Records made from pages, which hold no WARC headers: a response and two revisits of every page.

    The response is at date 10 * page_id. The first revisit comes 5 to 65 later by another spelling of the URL, with
    the same ETag, its weak form, another one, or only Last-Modified, by page_id; the second comes 3 earlier.
    Null htmls give null payloads, repeated rows repeated records; an empty table gives none; other columns are ignored.
    """
    h = lambda name, value: F.struct(F.lit(name).alias("name"), F.coalesce(value.cast("string"), F.lit("")).alias("value"))
    i, at = F.col("page_id"), F.col("page_id") * 10
    tag, day = F.concat(F.lit('"'), F.substring(F.md5(F.col("html")), 1, 16), F.lit('"')), F.concat(F.lit("day "), i % 1000)
    kind = F.pmod(i, F.lit(4))
    full = F.array(h("Content-Type", F.lit("text/html")), h("Content-Length", F.octet_length("html")), h("ETag", tag), h("Last-Modified", day), h("Set-Cookie", F.lit("a")), h("Set-Cookie", F.lit("b")), h("Date", at))
    sent = F.when(kind == 0, tag).when(kind == 1, F.concat(F.lit("W/"), tag)).otherwise('"other"')
    later, sooner = at + 5 + F.pmod(i, F.lit(7)) * 10, at - 3
    answer = lambda date: F.array(F.when(kind == 3, h("last-modified", day)).otherwise(h("etag", sent)), h("Date", date), h("Content-Length", F.lit("0")), h("Cache-Control", F.lit("max-age=60")))
    none, profile = F.lit(None).cast("string"), F.lit("http://netpreserve.org/warc/1.1/revisit/server-not-modified")
    rows = lambda k, uri, date, kind, prof, status, head, body: F.struct((i * 3 + k).alias("record_id"), uri.alias("uri"), date.alias("date"), F.lit(kind).alias("type"), prof.alias("profile"), F.lit(status).alias("status"), head.alias("headers"), body.alias("payload"))
    three = F.array(
        rows(0, F.col("url"), at, "response", none, 200, full, F.col("html")),
        rows(1, F.concat(F.regexp_replace("url", "^http:", "https:"), F.lit("#again")), later, "revisit", profile, 304, answer(later), none),
        rows(2, F.col("url"), sooner, "revisit", profile, 304, answer(sooner), none),
    )
    return pages.select(F.inline(three))


def digests(resolved: DataFrame) -> DataFrame:
    """Each record with its headers as lines and the MD5 of its payload (null where it has none); a row for each row of resolve()."""
    lines = F.array_join(F.transform("headers", lambda x: F.concat(x["name"], F.lit(": "), x["value"])), "\n")
    return resolved.select("record_id", "url_key", "outcome", "base_id", "matched_by", "status", lines.alias("headers"), F.md5("payload").alias("payload_md5"))


#: DuckDB: the same records, joined by ASOF, with the same digests.
SQL = r"""
WITH p AS (SELECT page_id AS i, url, html, page_id * 10 AS born, '"' || md5(html)[1:16] || '"' AS tag, 'day ' || (page_id % 1000) AS day, page_id % 4 AS kind,
                  page_id * 10 + 5 + (page_id % 7) * 10 AS later, page_id * 10 - 3 AS sooner FROM pages),
r AS (
  SELECT i * 3 AS record_id, url AS uri, born AS date, true AS is_full, tag AS etag, day AS modified, html,
         ['Content-Type: text/html', 'Content-Length: ' || octet_length(encode(html)), 'ETag: ' || tag, 'Last-Modified: ' || day, 'Set-Cookie: a', 'Set-Cookie: b', 'Date: ' || born] AS headers FROM p
  UNION ALL
  SELECT i * 3 + k, u, d, false, CASE WHEN kind < 3 THEN sent END, CASE WHEN kind = 3 THEN day END, NULL,
         [CASE WHEN kind = 3 THEN 'last-modified: ' || day ELSE 'etag: ' || sent END, 'Date: ' || d, 'Content-Length: 0', 'Cache-Control: max-age=60']
  FROM (SELECT *, 1 AS k, regexp_replace(url, '^http:', 'https:') || '#again' AS u, later AS d, CASE kind WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag ELSE '"other"' END AS sent FROM p
        UNION ALL SELECT *, 2, url, sooner, CASE kind WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag ELSE '"other"' END FROM p)),
w AS (SELECT *, regexp_replace(trim(uri), '#[\s\S]*$', '') AS whole FROM r),
v AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(whole, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
             regexp_replace(whole, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM w),
x AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?([\s\S]*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '(?i)^(utm_[a-z]+|jsessionid|phpsessid|sid)(=|$)'))) AS params FROM v),
c AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(regexp_extract(rest, '^[^?]*', 0), '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS url_key FROM x),
f AS (SELECT url_key AS u, date AS d, record_id AS base_id, etag AS be, modified AS bm, html AS bh, headers AS bheaders FROM c WHERE is_full QUALIFY row_number() OVER (PARTITION BY url_key, date ORDER BY record_id DESC) = 1),
j AS (SELECT c.*, f.*, CASE WHEN etag IS NOT NULL THEN CASE WHEN CASE WHEN etag LIKE 'W/%' THEN etag[3:] = be ELSE etag = be END THEN 'etag' END WHEN modified = bm THEN 'last-modified' END AS m
      FROM (SELECT * FROM c WHERE NOT is_full) c ASOF LEFT JOIN f ON c.url_key = f.u AND c.date > f.d)
SELECT record_id, url_key, 'response' AS outcome, CAST(NULL AS BIGINT) AS base_id, CAST(NULL AS VARCHAR) AS matched_by, 200 AS status, array_to_string(headers, chr(10)) AS headers, md5(html) AS payload_md5 FROM c WHERE is_full
UNION ALL
SELECT record_id, url_key, CASE WHEN url_key IS NULL THEN 'no_url' WHEN base_id IS NULL THEN 'no_response' WHEN m IS NULL THEN 'mismatch' ELSE 'resolved' END, base_id, m, CASE WHEN m IS NULL THEN 304 ELSE 200 END,
       CASE WHEN m IS NULL THEN array_to_string(headers, chr(10)) ELSE array_to_string(
         list_filter(bheaders, lambda b: len(list_filter(headers, lambda n: lower(split_part(n, ':', 1)) = lower(split_part(b, ':', 1)) AND lower(split_part(n, ':', 1)) <> 'content-length')) = 0)
         || list_filter(headers, lambda n: lower(split_part(n, ':', 1)) <> 'content-length'), chr(10)) END,
       CASE WHEN m IS NOT NULL THEN md5(bh) END
FROM j"""
