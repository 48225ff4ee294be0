import json
import struct
import threading
import time
import urllib.error
import urllib.request

import numpy as np
import pytest
from test_service import DOCS, service  # noqa: F401

from seekmill.operators import lexicon
from seekmill.plans.embedding import embedding_server, query_embedder
from seekmill.plans.server import answer, page_file, server
from seekmill.sources import readers, sinks


def test_answers(service):  # noqa: F811
    status, body = answer(service, "GET", "/search?q=pie&k=1")
    (one,) = json.loads(body)
    assert status == 200 and list(one) == ["id", "title", "link", "abstract", "sparseScore", "denseScore", "finalScore"]
    assert one["denseScore"] == 0 and one["finalScore"] == one["sparseScore"] > 0
    assert answer(service, "GET", "/search") == (200, "[]")
    assert json.loads(answer(service, "GET", "/suggest?q=pea")[1])[0]["word"] == "pears"
    assert answer(service, "POST", "/click?id=2") == (200, '{"ok": true}')
    assert json.loads(answer(service, "GET", "/hot?k=1")[1]) == [{"rank": 1, "id": 2, "title": "Pear", "link": "u2", "clickCount": 1}]
    assert json.loads(answer(service, "GET", "/health")[1]) == {"status": "ok", "docs": len(DOCS)}
    stats = json.loads(answer(service, "GET", "/stats")[1])
    assert "hit_rate" in stats and stats["uniqueDocs"] == 1 and stats["totalClicks"] == 1
    assert answer(service, "POST", "/click?id=x")[0] == 400
    assert answer(service, "POST", "/click") == answer(service, "POST", "/click?id=") == (200, '{"ok": true}')
    assert service.hot_stats()["totalClicks"] == 1
    assert answer(service, "GET", "/none")[0] == 404


def test_embedding_over_http(service):  # noqa: F811
    def model(texts):
        if "slow" in texts[0]:
            time.sleep(1.5)
        return np.array([[0.0, 2.0]])

    s = embedding_server(model, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"
    with urllib.request.urlopen(f"{base}/health") as r:
        assert json.load(r) == {"status": "ok"}
    embed = query_embedder(f"{base}/embed", 0.7)
    assert embed("pears") == [0.0, 1.0]
    began = time.monotonic()
    assert embed("slow") is None and time.monotonic() - began < 1.2
    service.embed, was = embed, service.embed
    assert {r["doc_id"] for r in service.search("pears").collect()} == {1, 2, 3}
    service.embed = query_embedder("http://127.0.0.1:9/embed", 0.7)
    assert {r["doc_id"] for r in service.search("pears").collect()} == {2}
    service.embed = was
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{base}/embed", b"{}")
    s.shutdown()


def test_documents_come_from_the_cache(service):  # noqa: F811
    first = service.documents([1, 2, 99])
    assert set(first) == {1, 2} and first[2]["title"] == "Pear"
    hits = service.doc_cache.stats()["hits"]
    docs, service.docs = service.docs, None
    assert service.documents([1, 2]) == first and service.doc_cache.stats()["hits"] == hits + 2
    service.docs = docs


def test_over_http(service, tmp_path):  # noqa: F811
    (tmp_path / "index.html").write_text("<p>page</p>")
    s = server(service, 0, static=str(tmp_path))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"
    with urllib.request.urlopen(f"{base}/suggest?q=pea") as r:
        assert json.load(r)[0]["word"] == "pears" and r.headers["Access-Control-Allow-Origin"] == "*"
    with urllib.request.urlopen(f"{base}/") as r:
        assert r.read() == b"<p>page</p>" and r.headers["Content-Type"] == "text/html"
    assert page_file(tmp_path, "/../" + tmp_path.name + "/../x") is None
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{base}/none")
    s.shutdown()


def test_trie_and_page_files(spark, tmp_path):
    words = {"car": 2, "cat": 5, "增长": 3}
    data = sinks.trie_bytes(words)
    (tmp_path / "trie.dat").write_bytes(data)
    assert {tuple(r) for r in readers.read_trie(spark, str(tmp_path / "trie.dat")).collect()} == set(words.items())
    nodes = data[16 + sum(12 + len(w.encode()) for w in words) :]
    assert nodes[:13] == struct.pack("<BQI", 0, 0, 2) and len(nodes) == 7 * 13 + 4 * 3 + 2 * 5
    docs = spark.createDataFrame([(1, "l", "a < b", "c & d")], "doc_id long, link string, title string, content string")
    row = sinks.page_blocks(docs).first()
    assert "a &lt; b" in row["block"] and row["size"] == len(row["block"].encode())


def test_page_store_by_offset(spark, tmp_path):
    docs = [(k, f"u{k}", f"title <{k}> & é", "line one\nline two " + "日" * k) for k in range(40)]
    store = str(tmp_path / "store")
    sinks.write_page_store(spark.createDataFrame(docs, "doc_id long, link string, title string, content string").repartition(5), store)
    offsets = {r["doc_id"]: (r["offset"], r["size"]) for r in readers.read_offsets(spark, f"{store}/offsets").collect()}
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "store" / "pages").glob("part-*")))
    at = 0
    for k, link, title, content in docs:
        assert offsets[k][0] == at
        block = data[at : at + offsets[k][1]].decode()
        assert readers.document_of(block) == {"id": str(k), "link": link, "title": title, "content": content} and block.endswith("</doc>\n")
        at += offsets[k][1]
    assert at == len(data)
    assert readers.read_document(spark, store, 17)["content"] == docs[17][3] and readers.read_document(spark, store, 99) is None


def test_postings_and_character_files(spark, tmp_path):
    rows = [("pie", 3, 0.123456789), ("pie", 1, 1.0), ("apple", 2, -0.5)]
    sinks.write_postings(spark.createDataFrame(rows, "term string, doc_id long, weight double"), str(tmp_path / "inv"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "inv").glob("part-*"))).splitlines()
    assert lines == ["apple\t2\t-0.5", "pie\t1\t1.0\t3\t0.123457"]
    assert {tuple(r) for r in readers.read_postings(spark, str(tmp_path / "inv")).collect()} == {("apple", 2, -0.5), ("pie", 1, 1.0), ("pie", 3, 0.123457)}
    words = spark.createDataFrame([("ab", 1), ("b", 2)], "word string, freq long")
    sinks.write_character_index(lexicon.character_lists(words), str(tmp_path / "chars"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "chars").glob("part-*"))).splitlines() == ["a\tab", "b\tab\tb"]


def test_a_malformed_feed_goes_as_a_whole(spark, tmp_path):
    item = "<item><title>t</title><link>l{}</link><description>text {}</description></item>"
    (tmp_path / "good.xml").write_text("<?xml version='1.0'?><rss><channel>" + item.format(1, 1) + "<item><title>x</title></item></channel></rss>")
    (tmp_path / "bad.xml").write_text("<rss><channel>" + item.format(2, 2) + "<item><title>open</channel></rss>")
    (tmp_path / "other.xml").write_text("<feed>" + item.format(3, 3) + "</feed>")
    assert [r["link"] for r in readers.read_rss(spark, str(tmp_path)).collect()] == ["l1"]


def test_feeds_without_content_give_no_documents(spark, tmp_path):
    items = "".join(f"<item>\r\n<title><![CDATA[n {k}]]></title><news_id>{k}</news_id><link>http://x/{k}</link><guid>{k}</guid><pubDate>d</pubDate></item>" for k in range(50))
    (tmp_path / "edu.xml").write_text(f"<?xml version='1.0' encoding='UTF-8'?><rss version='2.0'><channel><title>c</title>{items}</channel></rss>")
    assert len(readers._items((tmp_path / "edu.xml").read_text())) == 50
    assert readers.read_rss(spark, str(tmp_path)).collect() == []
