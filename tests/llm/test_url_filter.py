import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from seekmill.llm import queries, url_filter

D = date
ENTRIES = [
    ("domain", "Example.COM", "add", D(2024, 1, 10)), ("domain", "example.com", "remove", D(2024, 3, 1)), ("domain", ".example.com.", "add", D(2024, 5, 1)),
    ("domain", "sub.example.com", "add", D(2024, 1, 1)), ("domain", "http://schemed.org/any", "add", D(2024, 1, 1)), ("domain", "both.org", "add", D(2024, 1, 5)),
    ("domain", "both.org", "remove", D(2024, 1, 5)), ("url", "http://a.org/x/", "add", D(2024, 1, 1)), ("url", "A.org:80/y?q=1#f", "add", D(2024, 1, 1)),
    ("url", "a.org/x", "add", D(2024, 2, 1)), ("domain", None, "add", D(2024, 1, 1)), ("domain", "nodate.org", "add", None), ("domain", "", "add", D(2024, 1, 1)), ("url", "example.com/listed", "add", D(2024, 1, 1)),
]
URLS = [
    "http://example.com/p", "https://www.Example.com:8080/p", "http://user@sub.example.com", "http://notexample.com", "http://schemed.org/z", "http://both.org/", "http://a.org/x", "https://A.ORG/x/",
    "http://a.org/x/z", "http://a.org/y?q=1", "http://a.org/y?q=2", "http://example.com./", "http://example.com/listed", "ftp://nodate.org", "example.com/p", "", None, "http://", "http:///p", "http://" + "a" * 300 + ".example.com/", "http://example.com/p",
]
DAYS = [D(2024, 1, 9), D(2024, 1, 10), D(2024, 2, 29), D(2024, 3, 1), D(2024, 6, 1), None]


def parts(url):
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\\]*)([^#]*)", url or "")
    if not m:
        return None, None
    host = re.sub(r"\.$", "", re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", m[2])).lower())
    return (host, host + re.sub("/$", "", m[3])) if host else (None, None)


def brute(captures):
    keys = {}
    for kind, value, action, day in ENTRIES:
        if value is None or day is None:
            continue
        host, address = parts(value if "://" in value else "http://" + value.removeprefix("."))
        key = host if kind == "domain" else address
        if key:
            keys.setdefault((kind, key), {}).setdefault(day, set()).add(action)
    out = []
    for i, url, day in captures:
        host, address = parts(url)
        hits = []
        for (kind, key), days in keys.items():
            if not host or not day or not (address == key if kind == "url" else host == key or host.endswith("." + key)):
                continue
            since = None
            for d in sorted(x for x in days if x <= day):
                if "remove" in days[d]:
                    since = None
                elif since is None:
                    since = d
            if since:
                hits.append((kind == "url", len(key), kind, key, since))
        best = max(hits, default=None)
        out.append((i, url, day, bool(best), *(best[2:] if best else (None, None, None))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([(*e, "x") for e in ENTRIES], "kind string, value string, action string, day date, host string")


def test_against_a_plain_loop(spark, entries):
    captures = [(k, u, d) for k, (u, d) in enumerate((u, d) for u in URLS for d in DAYS)]
    captures += [(None, URLS[0], DAYS[1]), captures[0], captures[0]]
    df = spark.createDataFrame([(*c, "x", "y") for c in captures], "page_id long, url string, fetch_day date, host string, suffix string")
    assert sorted((tuple(r) for r in url_filter.url_filter(df, entries).collect()), key=str) == brute(captures)


def test_the_query_meets_both_kinds_of_entries(spark):
    found = {r["page_id"]: r for r in queries.op1_url_filters(spark, "/root/testdata/sf0.01").collect()}
    assert {r["entry_kind"] for r in found.values()} == {"domain", "url", None}
    assert [found[k]["entry_value"] for k in (3, 7, 20)] == ["therha.example.com/en/676", "m.therou.example.com/en/474.html", None]


def test_empty_tables(spark, entries):
    df = spark.createDataFrame([(1, "http://example.com", D(2024, 1, 20))], "page_id long, url string, fetch_day date")
    assert [r["blocked"] for r in url_filter.url_filter(df, entries.limit(0)).collect()] == [False]
    assert url_filter.url_filter(df.limit(0), entries).collect() == []


def test_listed_addresses_of_the_table(spark):
    """Addresses of pages that the table has are blocked while they are listed."""
    pages = queries.table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url").withColumn("fetch_day", F.lit("2024-06-01").cast("date"))
    some = [r["url"] for r in pages.orderBy("page_id").limit(5).collect()]
    listed = spark.createDataFrame([("url", u, "add", D(2024, 1, 1)) for u in some], "kind string, value string, action string, day date")
    found = {r["url"] for r in url_filter.url_filter(pages, listed).where("blocked").collect()}
    assert found >= set(some) and {parts(u)[1] for u in found} == {parts(u)[1] for u in some}
