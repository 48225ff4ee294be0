import hashlib
from collections import Counter

import numpy as np
import pytest

from seekmill.plans.embedding import hashed_embeddings, hashing_embedder
from seekmill.plans.service import SearchService, build
from seekmill.streaming.clicks import ClickTable


def clicks(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id long")


def counts(table):
    return {r["doc_id"]: r["click_count"] for r in table.totals().collect()}


def test_a_repeated_batch_counts_once(spark, tmp_path):
    table = ClickTable(spark, f"file://{tmp_path}/clicks", fold=3)
    assert counts(table) == {}
    batches = [[1, 1, 2], [2], [], [7, None], [1], [1, 9], [9]]
    for k, ids in enumerate(batches):
        for _ in range(2):
            table.add_batch(clicks(spark, ids), k)
        table.add_batch(clicks(spark, batches[0]), 0)  # long counted: a sum has it, or its folder is the same
        assert counts(table) == Counter(i for b in batches[: k + 1] for i in b)
    assert table._committed("sums") == [2, 5] and table._committed("deltas") == [3, 4, 5, 6]
    (tmp_path / "clicks" / "deltas" / f"{7:020d}").mkdir()  # a write that never was committed
    assert counts(ClickTable(spark, f"file://{tmp_path}/clicks")) == Counter(i for b in batches for i in b)


DOCS = [(1, "u1", "Apple pie", "how to bake an apple pie"), (2, "u2", "Pear", "pears are green"), (3, "u3", "Pie", "a pie chart")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = "file://" + str(tmp_path_factory.mktemp("index"))
    build(spark.createDataFrame(DOCS, "doc_id long, link string, title string, content string"), path, distance=1)
    return path


def test_clicks_survive_a_restart(spark, index, tmp_path):
    path = f"file://{tmp_path}/clicks"
    first = SearchService(spark, index, clicks=ClickTable(spark, path, batch=2))
    for i in (3, 1, 3, 77):
        first.record_click(i)
    assert first.hot_stats() == {"uniqueDocs": 3, "totalClicks": 4}
    first.record_click(3), first.record_click(1)  # in the log, and not counted yet
    again = SearchService(spark, index, clicks=ClickTable(spark, path, batch=100))
    assert [tuple(r) for r in again.hot_pages(2).collect()] == [(1, 3, "Pie", "u3", 3), (2, 1, "Apple pie", "u1", 2)]
    again.record_click(1), again.record_click(1)
    assert '"clickCount": 4' in again.hot_json(1) and again.hot_stats() == {"uniqueDocs": 3, "totalClicks": 8}


def brute_vector(terms, dim=64):
    v = [0] * dim
    for term, n in terms.items():
        h = hashlib.md5(term.encode()).hexdigest()
        v[int(h[:8], 16) % dim] += n if h[8] < "8" else -n
    norm = sum(x * x for x in v) ** 0.5
    return [float(np.float32(x / norm)) for x in v] if norm else None


def test_hashed_embeddings(spark, index):
    docs = {1: {"apple": 2, "pie": 1, "é": 3}, 2: {"pear": 1}, 3: {}}
    rows = [(d, t, n) for d, ts in docs.items() for t, n in ts.items()]
    df = spark.createDataFrame(rows, "doc_id long, term string, n long")
    assert {r["vec_id"]: list(r["embedding"]) for r in hashed_embeddings(df).collect()} == {d: brute_vector(ts) for d, ts in docs.items() if ts}
    same = [f"w{k}" for k in range(200)]
    place = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 2
    sign = lambda t: hashlib.md5(t.encode()).hexdigest()[8] < "8"
    plus, minus = next((a, b) for a in same for b in same if place(a) == place(b) and sign(a) and not sign(b))
    assert hashed_embeddings(spark.createDataFrame([(1, plus, 1), (1, minus, 1)], "doc_id long, term string, n long"), 2).collect() == []

    service = SearchService(spark, index)
    counted = spark.read.parquet(f"{index}/documents").selectExpr("doc_id", "concat(title, ' ', content) text")
    from seekmill.operators.index import term_counts, terms

    service.vectors = hashed_embeddings(term_counts(terms(counted)))
    service.embed = hashing_embedder(service.query_terms)
    assert service.embed("") is None and service.embed("pears green") == pytest.approx(brute_vector({"pears": 1, "green": 1}))
    best = service.search("pears green").first()
    assert best["doc_id"] == 2 and best["dense_score"] > 0.7 and best["sparse_score"] > 0
