"""Revisit records of a web archive, resolved to the response they stand for."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadline.llm.common import partitions
from treadline.session import materialise

#: Fields of a 304 answer that don't replace those of the stored response (RFC 9111, section 3.2, and hop-by-hop fields).
NOT_UPDATED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
               "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Scheme, leading ``www.``, default port, fragment and ``utm_`` parameters go, the host is in lower case, an empty path is ``/``."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    given = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    kept = F.array_join(F.filter(given, lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored fields, replaced and completed by those of the 304 answer that may update them. Names are in lower case."""
    stored = F.coalesce(stored, F.expr("cast(map() as map<string,string>)"))
    new = F.map_filter(F.coalesce(update, F.expr("cast(map() as map<string,string>)")), lambda k, _: ~k.isin(*NOT_UPDATED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id``, ``url_key``, ``status``, ``refers_to``, ``headers``, ``payload``.

    ``records`` has ``record_id``, ``url``, ``at`` (time), ``kind`` ('response' or 'revisit'), ``etag``, ``last_modified``, ``headers`` (map, names in lower
    case) and ``payload``. An as-of join finds the latest response with the same canonical URL strictly before the revisit; of several at one time the largest
    ``record_id``. It is accepted if the entity tags agree, or, where one of the two has none, the times of modification. ``status`` is 'resolved', 'mismatch'
    (a response is there, but its validators differ or are missing) or 'missing'; only resolved rows have ``payload`` and merged ``headers``.

    Records are sorted by URL and time over all partitions, without their payloads. Inside a partition the last response is carried along; across
    partitions one row per URL and partition is. A URL with a third of all captures lies in many partitions, each scanned alone. Payloads
    are fetched at the end for the responses in use. Null URLs match nothing; null times precede all others; repeated records count each.
    """
    key, is_answer = canonical_url(F.col("url")).alias("url_key"), F.col("kind") == "response"
    narrow = records.where(F.col("kind").isin("response", "revisit")).select("record_id", key, "at", is_answer.alias("answer"), "etag", "last_modified", "headers")
    order = ["url_key", "at", "answer", "record_id"]
    placed = narrow.repartitionByRange(partitions(records.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialise(placed.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    answer = F.when(F.col("answer"), F.struct("record_id", "etag", "last_modified", "headers", "at"))
    running = Window.partitionBy("part", "url_key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("here", F.last(answer, ignorenulls=True).over(running)).where(~F.col("answer"))
    tails = placed.where("answer").groupBy("url_key", "part").agg(F.max_by(answer, "place").alias("tail"))
    # A row per URL and partition: at most one per partition for a URL.
    wanted = rows.where("here is null").select("url_key", "part").distinct().select("url_key", "part", F.lit(None).cast(tails.schema["tail"].dataType).alias("tail"))
    both = tails.union(wanted).groupBy("url_key", "part").agg(F.first("tail", ignorenulls=True).alias("tail"))
    before = F.last("tail", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carry = both.select(F.col("url_key").alias("carry_key"), F.col("part").alias("carry_part"), before.alias("carried"))
    found = rows.join(carry, (F.col("url_key") == F.col("carry_key")) & (F.col("part") == F.col("carry_part")), "left")
    origin = F.when(F.col("url_key").isNotNull(), F.coalesce("here", "carried"))
    found = found.withColumn("origin", origin).select("record_id", "url_key", "etag", "last_modified", "headers", "origin")
    tags = F.col("etag").isNotNull() & F.col("origin.etag").isNotNull()
    agree = F.when(tags, F.col("etag") == F.col("origin.etag")).otherwise(F.coalesce(F.col("last_modified") == F.col("origin.last_modified"), F.lit(False)))
    found = found.withColumn("status", F.when(F.col("origin").isNull(), "missing").when(agree, "resolved").otherwise("mismatch"))
    ok = F.col("status") == "resolved"
    found = found.select("record_id", "url_key", "status", F.col("origin.record_id").alias("refers_to"),
                         F.when(ok, F.col("origin.record_id")).alias("_oid"),
                         F.when(ok, merged_headers(F.col("origin.headers"), F.col("headers"))).alias("headers"))
    bodies = records.where(is_answer).select(F.col("record_id").alias("_bid"), "payload").groupBy("_bid").agg(F.max("payload").alias("payload"))
    return found.join(bodies, F.col("_oid") == F.col("_bid"), "left").select("record_id", "url_key", "status", "refers_to", "headers", "payload")


def captures(pages: DataFrame) -> DataFrame:
    """Records made of crawled pages: a section of a site is captured again and again, a feed reader's visit finds it unchanged.

    A page's path is cut after its first part, so that pages of a section are captures of one URL, at the time ``page_id``; query string and fragment stay. The language
    of the markup is the entity tag, where there is one; the number of list entries is the time of modification. Null markup counts as empty.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    etag = F.nullif(F.regexp_extract(html, '<html lang="([^"]*)"', 1), F.lit(""))
    feed = F.coalesce(F.col("url").contains("utm_source=feed"), F.lit(False))
    modified = F.regexp_count(html, F.lit("<li>")).cast("long")
    fields = {"etag": etag, "date": F.col("page_id").cast("string"), "content-length": F.octet_length(html).cast("string"), "x-items": modified.cast("string")}
    headers = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return pages.select(F.col("page_id").alias("record_id"), F.regexp_replace("url", r"(://[^/?#]*/[^/?#]*)[^?#]*(.*)$", "$1$2").alias("url"), F.col("page_id").alias("at"),
                        F.when(feed, "revisit").otherwise("response").alias("kind"), etag.alias("etag"), modified.alias("last_modified"), headers.alias("headers"),
                        F.col("html").alias("payload"))
