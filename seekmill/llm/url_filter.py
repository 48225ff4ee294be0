"""URL filters as a temporal list join, with DataFrame functions only.

Dated list entries (kind, value, action, day) become validity intervals [day, day of the next
entry of that key). An as-of join evaluates every capture against the entries active on its fetch
day. Kind ``domain`` matches a host and all below it; kind ``url`` matches one address without
scheme, user, port, fragment and trailing slash. List values are brought to the same form as captures,
with or without a scheme, so entries that differ in form only are one.

Captures are first reduced to distinct (host, day), so a hot host costs a row a day; only those are
expanded to domain suffixes, of as many labels as the longest listed domain has. Both joins are plain equi-joins that AQE can split or broadcast by size.

Cases: entries of one key and day count once, and ``remove`` wins over ``add``; a null or
unparsable URL or a null fetch day matches nothing and is not blocked; an entry without a host counts for nothing; repeated captures are each answered; an empty list blocks nothing. Of
several active entries the URL's own is reported, else the longest domain. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(F.length(host) > 0, host)


def address_of(url: Column) -> Column:
    """Host plus path and query, the key of ``url`` entries."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(rest, "/$", ""))


def entry_key(kind: Column, value: Column) -> Column:
    """The host or address that a list value stands for; null if there is none."""
    url = F.when(value.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), value).otherwise(F.concat(F.lit("http://"), F.regexp_replace(value, r"^\.", "")))
    return F.when(kind == "domain", host_of(url)).when(kind == "url", address_of(url))


def intervals(entries: DataFrame) -> DataFrame:
    """kind, value, valid_from, valid_to (null: still active) for the periods on the list."""
    keyed = entries.select("kind", entry_key(F.col("kind"), F.btrim(F.col("value"))).alias("value"), "day", "action")
    one = keyed.where(F.col("value").isNotNull() & F.col("day").isNotNull()).groupBy("kind", "value", "day").agg(F.max("action").alias("action"))
    by_key = Window.partitionBy("kind", "value").orderBy("day")
    before = one.withColumn("was", F.lag("action").over(by_key)).where(F.col("was").isNull() | (F.col("was") != F.col("action")))
    return before.withColumn("valid_to", F.lead("day").over(by_key)).where(F.col("action") == "add").select("kind", "value", F.col("day").alias("valid_from"), "valid_to")


def _active(day: Column) -> Column:
    return (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """One row per capture: its id, url and day, blocked, and the kind, value and valid_from of the entry."""
    caps = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(day_col).alias("fetch_day"))
    caps = caps.withColumns({"host": host_of(F.col("url")), "address": address_of(F.col("url"))})
    listed = intervals(entries)

    labels = F.split("host", r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - F.col("most") + 1)
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    seen = caps.where(F.col("host").isNotNull() & F.col("fetch_day").isNotNull()).select("host", "fetch_day").distinct()
    domains = listed.where(F.col("kind") == "domain").select(F.col("value").alias("suffix"), "valid_from", "valid_to")
    most = domains.agg(F.max(F.size(F.split("suffix", r"\."))).alias("most"))  # one row
    verdicts = (
        seen.crossJoin(F.broadcast(most)).where(F.col("most").isNotNull()).select("host", "fetch_day", F.explode(suffixes).alias("suffix"))
        .join(domains, "suffix")
        .where(_active(F.col("fetch_day")))
        .groupBy("host", "fetch_day")
        .agg(F.max(F.struct(F.length("suffix").alias("n"), "suffix", "valid_from")).alias("d"))
    )
    urls = listed.where(F.col("kind") == "url").select(F.col("value").alias("u_value"), F.col("valid_from").alias("u_from"), F.col("valid_to").alias("u_to"))
    on_url = (F.col("address") == F.col("u_value")) & (F.col("u_from") <= F.col("fetch_day")) & (F.col("u_to").isNull() | (F.col("fetch_day") < F.col("u_to")))
    out = caps.join(verdicts, ["host", "fetch_day"], "left").join(urls, on_url, "left")
    by_url, by_domain = F.col("u_value").isNotNull(), F.col("d").isNotNull()
    return out.select(
        "page_id", "url", "fetch_day",
        (by_url | by_domain).alias("blocked"),
        F.when(by_url, "url").when(by_domain, "domain").alias("entry_kind"),
        F.coalesce("u_value", "d.suffix").alias("entry_value"),
        F.coalesce("u_from", "d.valid_from").alias("entry_from"),
    )
