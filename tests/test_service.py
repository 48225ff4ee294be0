import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seekmill.plans import catalogue
from seekmill.plans.cache import LruCache
from seekmill.plans.embedding import embed_documents
from seekmill.plans.service import SearchService, build
from seekmill.sources import readers, sinks
from seekmill.streaming.clicks import windowed_counts

DOCS = [(1, "u1", "Apple pie", "how to bake an apple pie with cinnamon"), (2, "u2", "Pear", "pears are green and sweet fruit"), (3, "u3", "Pie", "a pie chart shows shares of a whole"), (4, "u4", "Fig", "figs grow on trees in the south")]


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    path = "file://" + str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame(DOCS, "doc_id long, link string, title string, content string")
    texts = {"en": docs.select(F.col("content").alias("text"))}
    build(docs, path, texts=texts, distance=1)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "vec_id long, embedding array<float>")
    return SearchService(spark, path, vectors, lambda q: [0.0, 1.0] if "pear" in q else None)


def test_sparse_and_hybrid(service):
    assert service.total_docs() == 4
    rows = service.search("Pie").collect()
    assert [r["doc_id"] for r in rows] == [1, 3] or [r["doc_id"] for r in rows] == [3, 1]
    assert all(r["dense_score"] == 0 and r["final_score"] == r["sparse_score"] for r in rows)
    rows = service.search("pears").collect()
    assert rows[0]["doc_id"] == 2 and rows[0]["final_score"] > rows[1]["final_score"]
    assert {r["doc_id"] for r in rows} == {1, 2, 3}
    assert rows[0]["abstract"].startswith("pears are")
    assert service.search("").collect() == [] and service.search("pie", 0).collect() == []


def test_a_failing_embedder_degrades(service):
    service.embed, was = lambda q: 1 / 0, service.embed
    assert {r["doc_id"] for r in service.search("pears").collect()} == {2}
    service.embed = was


def test_json_and_cache(service):
    first = service.search_json(" PIE ")
    assert {x["id"] for x in json.loads(first)} == {1, 3}
    assert service.search_json("pie") == first and service.cache_stats()["hits"] == 1
    assert json.loads(service.suggest_json("pea"))[0]["word"] == "pears" and service.suggest_json("") == "[]"
    assert service.health() == {"status": "ok", "docs": 4}


def test_clicks(service):
    for d in (1, 3, 3, 77):
        service.record_click(d)
    assert [(r["rank"], r["doc_id"], r["title"]) for r in service.hot_pages().collect()] == [(1, 3, "Pie"), (2, 77, ""), (3, 1, "Apple pie")]
    assert service.hot_stats() == {"uniqueDocs": 3, "totalClicks": 4}
    service._clicks.clear()


def test_cache():
    now = [0.0]
    c = LruCache(2, 10, lambda: now[0])
    c.put("a", 1), c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("b") is None and len(c) == 2
    now[0] = 11
    assert c.get("a") is None and len(c) == 1
    assert c.stats() == {"size": 1, "hits": 1, "misses": 2, "hit_rate": 1 / 3}
    c.set_max_size(0)
    assert len(c) == 0
    c.clear()
    assert c.stats()["hit_rate"] == 0.0


def test_embeddings(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, link string, title string, content string")
    rows = embed_documents(docs, lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), batch=3).collect()
    assert {r["vec_id"] for r in rows} == {1, 2, 3, 4}
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6 for r in rows)


RSS = """<?xml version="1.0"?><rss><channel><title>c</title><description>channel</description>
<item><title>One</title><link>l1</link><content>&amp;lt;b&amp;gt; body one</content></item>
<item><title>Two</title><link>l2</link><description>two &lt;i&gt;described&lt;/i&gt;</description></item>
<item><title>None</title><link>l3</link></item>
<item><title>Markup</title><link>l4</link><content>&lt;p&gt;</content></item></channel></rss>"""


def test_readers(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    rows = {(r["link"], r["content"].strip()) for r in readers.read_rss(spark, str(tmp_path / "a.xml")).collect()}
    assert rows == {("l1", "body one"), ("l2", "two described")}
    assert readers.read_files(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "stop.txt").write_bytes("the\r\nand\r\n\r\nthe".encode())
    assert {r["word"] for r in readers.read_stopwords(spark, str(tmp_path / "stop.txt")).collect()} == {"the", "and"}
    (tmp_path / "dict.dat").write_text("cat\t5\nbroken\ndog\t2\n")
    assert {tuple(r) for r in readers.read_dictionary(spark, str(tmp_path / "dict.dat")).collect()} == {("cat", 5), ("dog", 2)}
    (tmp_path / "inv.dat").write_text("cat\t1\t0.5\t2\t0.25\t3\nx\n")
    assert {tuple(r) for r in readers.read_postings(spark, str(tmp_path / "inv.dat")).collect()} == {("cat", 1, 0.5), ("cat", 2, 0.25)}
    (tmp_path / "off.dat").write_text("1\t0\t10\n2\t10\n")
    assert [tuple(r) for r in readers.read_offsets(spark, str(tmp_path / "off.dat")).collect()] == [(1, 0, 10)]
    (tmp_path / "pages.dat").write_text("<doc>\n  <id>1</id>\n  <link>l</link>\n  <title>t</title>\n  <content>c\nd</content>\n</doc>\n")
    assert [tuple(r) for r in readers.read_pages(spark, str(tmp_path / "pages.dat")).collect()] == [(1, "l", "t", "c\nd")]


def test_binary_files(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>").coalesce(1)
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.dat").write_bytes(bytes(sinks.vector_blocks(v).first()["data"]))
    (tmp_path / "v" / "bad.dat").write_bytes(b"nonsense nonsense")
    assert {(r["vec_id"], tuple(r["embedding"])) for r in readers.read_vectors(spark, str(tmp_path / "v")).collect()} == {(1, (1.0, 2.0)), (2, (3.0, 4.0))}
    words = [("cat", 5), ("增", 2)]
    data = b"TRIE" + struct.pack("<IQ", 1, len(words)) + b"".join(struct.pack("<I", len(w.encode())) + w.encode() + struct.pack("<Q", f) for w, f in words)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "trie.dat").write_bytes(data + b"\0" * 13)
    (tmp_path / "t" / "short.dat").write_bytes(data[:20])
    assert {tuple(r) for r in readers.read_trie(spark, str(tmp_path / "t")).collect()} == set(words)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.23456789), ("a", None)], "word string, w double")
    sinks.write_sorted(df, str(tmp_path / "p"), "word")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_tsv(df.select("word", F.lit(3).alias("freq")), str(tmp_path / "t"))
    assert {tuple(r) for r in readers.read_dictionary(spark, str(tmp_path / "t")).collect()} == {("a", 3), ("b", 3)}
    assert json.loads(sinks.json_array(df.orderBy("word"))) == [{"word": "a", "w": None}, {"word": "b", "w": 1.23456789}]
    assert df.where("word = 'b'").select(sinks.six_digits(F.col("w")).alias("w")).first()["w"] == 1.23457


def test_windows(spark):
    clicks = spark.sql("select 1L doc_id, timestamp'2024-01-01 00:10:00' ts union all select 1L, timestamp'2024-01-01 00:50:00' union all select 1L, timestamp'2024-01-01 01:10:00'")
    assert sorted(r["click_count"] for r in windowed_counts(clicks).collect()) == [1, 2]


def test_catalogue_has_sql_for_all_but_two():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"snippet", "segment"}
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_streamed_counts_equal_batch_counts(spark, sf):
    batch = [tuple(r) for r in catalogue.QUERIES["hot_docs"](spark, sf).collect()]
    assert [tuple(r) for r in catalogue.QUERIES["hot_docs_streaming"](spark, sf).collect()] == batch


def test_snippet_query(spark, sf):
    rows = catalogue.QUERIES["snippet"](spark, sf).collect()
    assert 0 < len(rows) <= 20 and all(len((r["abstract"] or "").encode()) <= 310 for r in rows)
