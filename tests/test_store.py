import pytest

from seekmill.sources import sinks, store


def test_a_page_of_documents_is_one_plan(spark, tmp_path):
    ids = [*range(0, 3000, 3), -5, 1 << 40]
    rows = [(i, f"l{i}", f"t <{i}> & é" if i % 2 else None, "content\nof " * (i % 7) + str(i)) for i in ids]
    df = spark.createDataFrame([*rows, (None, "x", "x", "x")], "doc_id long, link string, title string, content string").repartition(9)
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little is one file
    sinks.write_page_store(df, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(f.name.startswith("1-") for f in (tmp_path / "store" / "index").iterdir()) > 1
    asked = [0, 3, 2997, 1500, -5, 1 << 40, 1, 2999, -6, 1 << 41, 0, *range(300, 345, 3)]
    page = store.read_documents(spark, path, asked)
    assert page.rdd.getNumPartitions() == -(-len(set(asked)) // store.IDS_A_TASK)
    known = {i: (i, link, title or "", content) for i, link, title, content in rows}
    assert sorted(map(tuple, page.collect())) == sorted(known[i] for i in set(asked) if i in known)
    assert store.read_documents(spark, path, []).collect() == []


def test_odd_stores(spark, tmp_path):
    path = str(tmp_path / "empty")
    sinks.write_page_store(spark.createDataFrame([], "doc_id long, link string, title string, content string"), path)
    assert store.read_documents(spark, path, [1]).collect() == []
    twice = spark.createDataFrame([(1, "a", "a", "a"), (1, "a", "a", "a"), (2, "b", "b", "b")], "doc_id long, link string, title string, content string")
    sinks.write_page_store(twice, path)
    assert sorted(map(tuple, store.read_documents(spark, path, [1, 2]).collect())) == [(1, "a", "a", "a"), (2, "b", "b", "b")]
    next((tmp_path / "empty" / "index").glob("1-*")).write_bytes(b"")
    with pytest.raises(Exception, match="damaged"):
        store.read_documents(spark, path, [1]).collect()
