"""The search service: an index built offline, and the calls that answer from it."""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.functions.snippet import snippet
from seekmill.functions.text import indexed_text, tokenize
from seekmill.operators import blocks, dedup, hot, index, lexicon, search, suggest
from seekmill.plans.cache import LruCache
from seekmill.sources.shared import checkpointed
from seekmill.sources.sinks import json_array, write_sorted
from seekmill.streaming.clicks import ClickTable

NO_DOCUMENT = {"link": "", "title": "", "content": ""}
#: The field names of the JSON answers.
RESULT_FIELDS = ("id", "title", "link", "abstract", "sparseScore", "denseScore", "finalScore")
HOT_FIELDS = ("rank", "id", "title", "link", "clickCount")
RESULT = "doc_id long, title string, link string, abstract string, sparse_score double, dense_score double, final_score double"


def to_json(rows: list[dict[str, object]]) -> str:
    return json.dumps(rows, ensure_ascii=False)


def build(docs: DataFrame, path: str, stopwords: DataFrame | None = None, texts: dict[str, DataFrame] | None = None, tokens: Callable[[Column], Column] = tokenize, distance: int = 3, renumber: bool = False) -> None:
    """Writes documents (without near-duplicates), postings, frequencies, dictionaries and character indexes
    under ``path``. ``renumber`` gives the documents that stay the ids 1..n in order; vectors are then made from those.

    ``docs`` has doc_id, link, title, content; ``texts`` may hold frames ``cn`` and ``en`` with a column text."""
    spark = docs.sparkSession
    whole = docs.withColumn("text", indexed_text(F.col("title"), F.col("content")))
    counts = checkpointed(index.document_terms(whole, stopwords, tokens=tokens))
    hashes = dedup.simhash(docs, dedup.integer_weights(counts, docs.count()), "content")
    kept = docs.join(dedup.keep_first(hashes, distance), "doc_id", "left_semi")
    ids = kept.select("doc_id", F.col("doc_id").alias("new_id"))
    if renumber:
        ids = checkpointed(dedup.renumbered(kept.select("doc_id")).select("doc_id", "new_id"))
    new = lambda df: df.join(ids, "doc_id").drop("doc_id").withColumnRenamed("new_id", "doc_id")
    write_sorted(new(kept).select(*docs.columns), f"{path}/documents", "doc_id")
    kept = spark.read.parquet(f"{path}/documents")
    left = new(counts)
    write_sorted(index.tfidf(left, kept.count()), f"{path}/index", "term", "doc_id")
    blocks.posting_blocks(spark.read.parquet(f"{path}/index")).write.mode("overwrite").parquet(f"{path}/blocks")
    write_sorted(spark.read.parquet(f"{path}/index").groupBy("term").agg(F.count("*").alias("df")), f"{path}/frequencies", "term")
    empty = spark.createDataFrame([], "text string")
    texts = texts or {}
    cn = lexicon.chinese_dictionary(texts.get("cn", empty), stopwords, tokens=tokens)
    en = lexicon.english_dictionary(texts.get("en", empty), stopwords)
    write_sorted(lexicon.merged_dictionary(cn, en), f"{path}/dictionary", "word")
    for name, words in (("cn", cn), ("en", en)):
        write_sorted(lexicon.character_index(words), f"{path}/characters_{name}", "ch", "word")


@dataclass
class SearchService:
    """Answers from what ``build`` wrote. Results are frames; the ``*_json`` calls give JSON.

    ``embed`` turns a query into a vector or None; without it, or where it fails, results are sparse only.
    ``clicks`` keeps clicks beyond this process; without it they are counted in memory.
    """

    spark: SparkSession
    path: str
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float] | None] | None = None
    stopwords: DataFrame | None = None
    tokens: Callable[[Column], Column] = tokenize
    alpha: float = 0.5
    strict: bool = False
    cache: LruCache = field(default_factory=lambda: LruCache(1000, 300.0))
    clicks: ClickTable | None = None
    doc_cache: LruCache = field(default_factory=lambda: LruCache(500))

    def __post_init__(self) -> None:
        self.docs = self.spark.read.parquet(f"{self.path}/documents")
        self.blocks = self.spark.read.parquet(f"{self.path}/blocks")
        self.frequencies = self.spark.read.parquet(f"{self.path}/frequencies")
        self.dictionary = self.spark.read.parquet(f"{self.path}/dictionary")
        self.n_docs = self.docs.count()
        self._clicks: Counter[int] = Counter()
        self._lock = Lock()

    def total_docs(self) -> int:
        return self.n_docs

    def query_terms(self, query: str) -> DataFrame:
        one = self.spark.createDataFrame([(0, query)], "doc_id long, text string")
        return index.terms(one, self.stopwords, tokens=self.tokens)

    def _vector(self, query: str) -> list[float] | None:
        if not self.embed or self.vectors is None:
            return None
        try:
            return self.embed(query) or None
        except Exception:  # a failing embedder degrades the result to sparse scores
            return None

    def _found(self, query: str, k: int) -> list[tuple]:
        """Rows of ``RESULT``, best first. Only the ``k`` ranked rows reach the driver; their documents come by id."""
        words = [r["term"] for r in self.query_terms(query).select("term").distinct().collect()] if self.n_docs else []
        if not words or k <= 0:
            return []
        # the query's few words prune the sorted files
        freq = self.frequencies.where(F.col("term").isin(words))
        vector = search.query_vector(self.query_terms(query), freq, self.n_docs)
        vector = self.spark.createDataFrame(vector.collect(), vector.schema)  # the query's few terms, read once
        q = self._vector(query)
        near = search.dense_search(self.vectors, q, 3 * k).collect() if q else []
        # a document that only its sparse score ranks is among the k best of those that no vector is near
        found = blocks.block_search(self.blocks, vector, k + len(near), self.strict)
        dense = None
        if near:
            dense = self.spark.createDataFrame(near, "vec_id long, score double")
            found = found.unionByName(blocks.scores_of(self.blocks, vector, [r["vec_id"] for r in near], self.strict)).distinct()
        ranked = search.fuse(found, dense, k, self.alpha).collect()
        docs = self.documents([r["doc_id"] for r in ranked])
        rows = [(r["doc_id"], docs.get(r["doc_id"], NO_DOCUMENT), r) for r in sorted(ranked, key=lambda r: (-r["final_score"], r["doc_id"]))]
        return [(i, d["title"], d["link"], snippet(d["content"], words), r["sparse_score"], r["dense_score"], r["final_score"]) for i, d, r in rows]

    def documents(self, doc_ids: list[int]) -> dict[int, dict[str, str]]:
        """link, title, content of the documents that are known; those in the cache aren't read again."""
        held = {i: d for i in doc_ids if (d := self.doc_cache.get(i)) is not None}
        lacking = [i for i in doc_ids if i not in held]
        if lacking:
            for r in self.docs.where(F.col("doc_id").isin(lacking)).select("doc_id", "link", "title", "content").collect():
                held[r["doc_id"]] = {c: r[c] or "" for c in NO_DOCUMENT}
                self.doc_cache.put(r["doc_id"], held[r["doc_id"]])
        return held

    def search(self, query: str, k: int = 20) -> DataFrame:
        """doc_id, title, link, abstract and the three scores of the ``k`` best documents."""
        return self.spark.createDataFrame(self._found(query, k), RESULT)

    def search_json(self, query: str, k: int = 20) -> str:
        key = query.strip(" \t\n\r\f\v").translate({c: c + 32 for c in range(65, 91)}), k
        found = self.cache.get(key)
        if found is None:
            found = to_json([dict(zip(RESULT_FIELDS, row, strict=True)) for row in self._found(query, k)])
            if found != "[]":
                self.cache.put(key, found)
        return found

    def suggest(self, query: str, k: int = 5, order: str = "intended") -> DataFrame:
        return suggest.suggest(self.dictionary, query, k, order)

    def suggest_json(self, query: str, k: int = 5) -> str:
        return json_array(self.suggest(query, k)) if query else "[]"

    def record_click(self, doc_id: int) -> None:
        if self.clicks is not None:
            return self.clicks.record(doc_id)
        with self._lock:
            self._clicks[doc_id] += 1

    def _hot(self, k: int) -> list[tuple]:
        if self.clicks is not None:
            self.clicks.refresh()
            best = [(r["doc_id"], r["click_count"]) for r in hot.hot(self.clicks.totals(), k).collect()]
        else:
            best = self._best_in_memory(k)
        docs = self.documents([i for i, _ in best])
        return [(rank, i, docs.get(i, NO_DOCUMENT)["title"], docs.get(i, NO_DOCUMENT)["link"], n) for rank, (i, n) in enumerate(best, 1)]

    def _best_in_memory(self, k: int) -> list[tuple[int, int]]:
        with self._lock:
            return heapq.nlargest(max(k, 0), self._clicks.items(), key=lambda x: (x[1], x[0]))

    def hot_pages(self, k: int = 10) -> DataFrame:
        """rank, doc_id, title, link, click_count; ties go to the larger id, a document that isn't known has empty fields."""
        return self.spark.createDataFrame(self._hot(k), "rank int, doc_id long, title string, link string, click_count long")

    def hot_json(self, k: int = 10) -> str:
        return to_json([dict(zip(HOT_FIELDS, row, strict=True)) for row in self._hot(k)])

    def hot_stats(self) -> dict[str, int]:
        if self.clicks is not None:
            self.clicks.refresh()
            unique, total = hot.hot_stats(self.clicks.totals()).first()
            return {"uniqueDocs": unique, "totalClicks": total}
        with self._lock:
            return {"uniqueDocs": len(self._clicks), "totalClicks": sum(self._clicks.values())}

    def set_cache_max_size(self, size: int) -> None:
        self.cache.set_max_size(size)

    def set_cache_ttl(self, seconds: float) -> None:
        self.cache.set_ttl(seconds)

    def cache_stats(self) -> dict[str, float]:
        return self.cache.stats()

    def health(self) -> dict[str, object]:
        return {"status": "ok", "docs": self.n_docs}
