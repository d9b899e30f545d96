"""Not-modified revisit resolution over web captures.

An as-of join by canonical URL gives each revisit the latest full response captured before it.  If the
revisit's validators agree with that response (the entity tag where both have one, else the date of the last
change), the revisit stands for its content, with those headers replaced that a not-modified answer may
replace; otherwise it stays unresolved.

The join is windows over (URL, slice of time), then a carry of each slice's last response to later slices of
its URL.  The slices are bounded by quantiles of all times, so a URL that holds a third of all captures is
spread over a third of SLICES tasks or more, whatever its times and however odd some are.  Payloads take no
part in it; they are joined to what is resolved at the end.

A capture has id, url, ts, revisit (boolean), etag, modified, payload, headers (map).  Null times and URLs
match nothing; of responses at the same time the greatest id counts; a response at the very time of a revisit
is not earlier.  Header names compare without case and keep the case they came in.  Repeated revisits are resolved each; extra columns are ignored; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.sources.scratch import stage

SLICES = 256
# Headers that a 304 answer carries for its stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that name a visit's origin and not a page.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, leading www, default port, closing slash and tracking parameters; the host
    in lower case, the other parameters in order."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def resolve_revisits(captures: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit: id, canonical_url, response_id, status (resolved, changed or missing), payload,
    headers (``name: value`` lines in order of the name; of the revisit alone if unresolved)."""
    fields = captures.select(
        F.monotonically_increasing_id().alias("uid"), F.col("id").cast("long").alias("id"), canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"),
        F.coalesce("revisit", F.lit(False)).alias("revisit"), "etag", "modified", "payload", "headers",
    )
    staged = stage(fields, "captures")
    fields = staged.drop("payload")
    marks = fields.agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)], 20 * slices)).first()[0] if slices > 1 else None  # slices numbers
    bounds = [float("-inf"), *sorted({float(x) for x in marks or (0,)}), float("inf")]
    in_slice = Bucketizer(splits=bounds, inputCol="time", outputCol="slice", handleInvalid="keep")
    sliced = in_slice.transform(fields.withColumn("time", F.coalesce(F.col("ts").cast("double"), F.lit(0.0)))).drop("time")
    response = F.when(~F.col("revisit"), F.struct("ts", "id", "uid", "etag", "modified", "headers"))
    within = W.partitionBy("canonical_url", "slice").orderBy("ts", F.desc("revisit"), "id", "uid").rowsBetween(W.unboundedPreceding, -1)
    able = F.col("ts").isNotNull() & F.col("canonical_url").isNotNull()
    timed = sliced.filter(able).withColumn("near", F.last(response, ignorenulls=True).over(within)).filter("revisit")
    newest = sliced.filter(able & ~F.col("revisit")).groupBy("canonical_url", "slice").agg(F.max_by(F.struct("ts", "id", "uid", "etag", "modified", "headers"), F.struct("ts", "id", "uid")).alias("newest"))
    # a row for each slice of a URL: at most ``slices`` of them
    places = timed.select("canonical_url", "slice").distinct().withColumn("newest", F.lit(None).cast(newest.schema["newest"].dataType))
    before = W.partitionBy("canonical_url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = newest.unionByName(places).groupBy("canonical_url", "slice").agg(F.first("newest", ignorenulls=True).alias("newest"))
    carried = carried.select("canonical_url", "slice", F.last("newest", ignorenulls=True).over(before).alias("carried"))
    found = timed.join(carried, ["canonical_url", "slice"], "left").withColumn("r", F.coalesce("near", "carried")).select("id", "canonical_url", "etag", "modified", "headers", "r")
    lost = sliced.filter(~able & F.col("revisit")).select("id", "canonical_url", "etag", "modified", "headers", F.lit(None).cast(found.schema["r"].dataType).alias("r"))
    both = found.unionByName(lost)
    same = F.when(F.col("etag").isNotNull() & F.col("r.etag").isNotNull(), F.col("etag") == F.col("r.etag")).otherwise(F.coalesce(F.col("modified") == F.col("r.modified"), F.lit(False)))
    status = F.when(F.col("r").isNull(), "missing").when(same, "resolved").otherwise("changed")
    none = F.create_map().cast("map<string,string>")
    sent = F.map_filter(F.coalesce("headers", none), lambda k, _: F.lower(k).isin(*PERMITTED))
    sent_names = F.transform(F.map_keys(sent), F.lower)
    stored = F.map_filter(F.coalesce("r.headers", none), lambda k, _: ~F.array_contains(sent_names, F.lower(k)))
    lines = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    resolved = F.col("status") == "resolved"
    answers = both.withColumn("status", status).select(
        "id", "canonical_url", F.when(F.col("status") != "missing", F.col("r.id")).alias("response_id"), "status",
        F.when(resolved, F.col("r.uid")).alias("of_uid"), F.when(resolved, lines(F.map_concat(sent, stored))).otherwise(lines(F.coalesce("headers", none))).alias("headers"),
    )
    # a body that many revisits stand for is a hot key; both sides come straight from a shuffle, so Spark splits it
    answers, bodies = stage(answers, "answers"), staged.filter("not revisit").select(F.col("uid").alias("of_uid"), "payload")
    held = answers.filter("of_uid is not null").join(bodies, "of_uid", "left")
    bare = answers.filter("of_uid is null").withColumn("payload", F.lit(None).cast(bodies.schema["payload"].dataType))
    return held.unionByName(bare).select("id", "canonical_url", "response_id", "status", "payload", "headers")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of a page table: a full response with each page's html and, some time later, a revisit by each page.

    Revisits send the entity tag they know but for every fourth page, and every eleventh a stale one.
    """
    p = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.md5("html"))
    tag = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    changed = F.concat(F.lit("day "), (F.col("id") % 97).cast("string"))
    responses = p.select(
        "id", "url", (2 * F.col("id")).alias("ts"), F.lit(False).alias("revisit"), tag(F.col("digest")).alias("etag"), changed.alias("modified"), F.col("html").alias("payload"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag(F.col("digest")), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    known = F.when(F.col("id") % 11 == 0, tag(F.lit("stale"))).when(F.col("id") % 4 != 0, tag(F.col("digest")))
    revisits = p.select(
        "id", "url", (2 * F.col("id") + 1 + 2 * (F.col("id") % 50)).alias("ts"), F.lit(True).alias("revisit"), known.alias("etag"), changed.alias("modified"), F.lit(None).cast("string").alias("payload"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0"), F.lit("date"), F.concat(F.lit("t"), F.col("id").cast("string"))).alias("headers"),
    )
    return responses.unionByName(revisits)


ORACLE = r"""
with p as (
  select cast(page_id as bigint) as id, url, md5(coalesce(html, '')) as digest,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from pages),
q as (
  select *, list_sort(list_filter(string_split(case when strpos(bare, '?') > 0 then substr(bare, strpos(bare, '?') + 1) else '' end, '&'),
    lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) as params from p),
c as (
  select id, digest,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^www[0-9]*[.]', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
    || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as canonical_url from q),
r as (
  select id, canonical_url, digest, 2 * id as ts, 'day ' || cast(id % 97 as varchar) as modified from c),
v as (
  select id, canonical_url, 2 * id + 1 + 2 * (id % 50) as ts, 'day ' || cast(id % 97 as varchar) as modified,
    case when id % 11 = 0 then 'stale' when id % 4 <> 0 then digest end as known from c),
j as (
  select v.id, v.canonical_url, v.known, v.modified, r.id as response_id, r.digest, r.modified as response_modified,
    row_number() over (partition by v.id order by r.ts desc nulls last, r.id desc nulls last) as k
  from v left join r on v.canonical_url = r.canonical_url and r.ts < v.ts),
s as (
  select *, case when response_id is null then 'missing'
    when case when known is not null then known = digest else coalesce(modified = response_modified, false) end then 'resolved'
    else 'changed' end as status from j where k = 1)
select id, canonical_url, response_id, status, case when status = 'resolved' then digest end as payload,
  'cache-control: max-age=600' || chr(10)
  || case when status = 'resolved' then 'content-type: text/html' || chr(10) || 'date: t' || cast(id as varchar) || chr(10) || 'etag: "' || digest || '"'
     else 'content-length: 0' || chr(10) || 'date: t' || cast(id as varchar) end as headers
from s
"""
