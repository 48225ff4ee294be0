"""Queries over the supplied tables, one an operator, and the SQL that gives the same rows.

Documents have no title here; a query's words are picked from the data by document frequency.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.functions import text as tx
from seekmill.functions.segment import segmented
from seekmill.functions.snippet import snippet_column
from seekmill.operators import blocks, dedup, hot, index, lexicon, search, suggest
from seekmill.plans.embedding import hashed_embeddings
from seekmill.sources import binary, sinks, store
from seekmill.sources.shared import checkpointed, new_folder, spread, written
from seekmill.streaming.clicks import ClickTable, count_to_table, stream_clicks

#: A few function words and signs of the four languages.
STOP = ["the", "of", "and", "to", "in", "is", "a", "that", "de", "la", "le", "les", "et", "der", "die", "und", "el", "en", "y", "que", ",", "."]
ABSENT = "zzzzqq"
PICKED = (20, 25)
MARKED = ["the", "de", "und"]

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def _stop(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP], "word string")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_terms(_docs(spark, sf_dir), _stop(spark))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that several parts of a plan read: a table, so each reads its columns only."""
    return written(_counts(spark, sf_dir))


def _size(spark: SparkSession, sf_dir: str) -> int:
    return _read(spark, sf_dir, "documents").count()


def _picked(frequencies: DataFrame) -> list[str]:
    freq = frequencies.where(F.col("term").rlike("^[a-z]{3,}$"))
    best = [r["term"] for r in freq.orderBy(F.desc("df"), "term").limit(max(PICKED) + 1).collect()]
    return [best[min(k, len(best) - 1)] for k in PICKED] if best else []


def _kept_with_frequencies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counts = _kept(spark, sf_dir)
    return counts, written(index.document_frequencies(counts))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.packed_tfidf(_docs(spark, sf_dir), _size(spark, sf_dir), _stop(spark))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.unpacked(_packed(spark, sf_dir))


def _vector(spark: SparkSession, sf_dir: str, absent: bool = True, frequencies: DataFrame | None = None) -> DataFrame:
    freq = checkpointed(index.document_frequencies(_counts(spark, sf_dir))) if frequencies is None else frequencies
    words = _picked(freq) + ([ABSENT] if absent else [])
    query = spark.createDataFrame([(w,) for w in words], "term string")
    return search.query_vector(query, freq, _size(spark, sf_dir))


def _matches(spark: SparkSession, sf_dir: str, absent: bool = True, strict: bool = False, kept: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The query's matches: terms are counted once, and only documents with all terms of the query that any has get weights."""
    counts, freq = kept or _kept_with_frequencies(spark, sf_dir)
    vector = checkpointed(_vector(spark, sf_dir, absent, freq))
    weights = index.tfidf(search.with_all_terms(counts, vector), _size(spark, sf_dir), freq)
    return search.matches(weights, vector, strict)


def _blocks(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The index as blocks, written, so that readers skip the parts they don't need."""
    path = new_folder(spark)
    blocks.posting_blocks(_index(spark, sf_dir) if rows is None else rows).write.parquet(path)
    return spark.read.schema(blocks.BLOCKS).parquet(path)


def _block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, freq = _kept_with_frequencies(spark, sf_dir)
    vector = checkpointed(_vector(spark, sf_dir, frequencies=freq))
    return blocks.block_search(_blocks(spark, sf_dir, index.tfidf(counts, _size(spark, sf_dir), freq)), vector)


def _all_sparse(spark: SparkSession, sf_dir: str, kept: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return _matches(spark, sf_dir, kept=kept).select("doc_id", F.round("score", 9).alias("sparse_score"))


def _sparse(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return search.top(_all_sparse(spark, sf_dir), k, "sparse_score", F.col("doc_id"))


def _dense(spark: SparkSession, sf_dir: str, k: int = 60) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    query = vectors.where("vec_id = 0").first()["embedding"]
    return search.dense_search(vectors, query, k)


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse(_all_sparse(spark, sf_dir), _dense(spark, sf_dir))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(lexicon.english_dictionary(_docs(spark, sf_dir), _stop(spark)))


def _cn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.chinese_dictionary(_docs(spark, sf_dir), _stop(spark))


def _suggested(spark: SparkSession, sf_dir: str, use: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``use`` on the dictionary and its most frequent word of five letters or more."""
    en = _en(spark, sf_dir)
    return use(en, en.where(F.length("word") >= 5).orderBy(F.desc("freq"), "word").first()["word"])


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of benchmark texts, as queries of suggestions."""
    return lexicon.english_dictionary(_read(spark, sf_dir, "benchmark")).select("word")


def _batch_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the first letter, and the first three, of the benchmark's words."""
    words = _asked(spark, sf_dir)
    return suggest.batch_prefix(_en(spark, sf_dir), words.select(F.explode(F.array(*[F.substring("word", 1, n) for n in (1, 3)])).alias("query")))


def _vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, written as a set of files and read back by ranges."""
    path = new_folder(spark)
    binary.write_vectors(_read(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()), path)
    return binary.read_vectors(spark, path).select("vec_id", F.posexplode("embedding").alias("pos", "x"))


def _trie_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    sinks.write_trie(_en(spark, sf_dir), path)
    return binary.read_trie(spark, path)


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, by a dictionary of the words that two documents or more have."""
    docs = _docs(spark, sf_dir).select("doc_id", F.lower("text").alias("text"))
    words = docs.select("doc_id", F.explode(tx.tokenize(F.col("text"), "word")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"), F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))
    cut = segmented(docs, words.where(F.col("least") < F.col("greatest")))
    return cut.select("doc_id", F.posexplode("words").alias("pos", "word"))


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return dedup.simhash(docs, index.document_terms(docs, _stop(spark), most=dedup.features_wanted(F.coalesce("text", F.lit("")))))


def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources of content, each filled in a third of the rows."""
    d = _read(spark, sf_dir, "documents")
    part = lambda k: F.when(F.col("doc_id") % 4 == k, F.col("text")).otherwise("" if k else None)
    return d.select("doc_id", tx.first_filled(part(0), part(1), F.when(F.col("doc_id") % 4 == 2, F.col("source"))).alias("content"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return p.select("page_id", "url", title.alias("title"), tx.clean_html(F.col("html")).alias("text")).where(F.col("text") != "")


def _keyword_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [*_picked(index.document_frequencies(_counts(spark, sf_dir))), ABSENT]
    at = F.array_min(F.array(*[tx.keyword_position(F.col("text"), F.lit(w)) for w in words]))
    return _docs(spark, sf_dir).select("doc_id", at.cast("long").alias("pos"))


def _highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.highlight(F.col("text"), MARKED).alias("text"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("content"))
    return search.with_documents(_hybrid(spark, sf_dir), docs)


def _search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _results(spark, sf_dir).select("doc_id", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"), "sparse_score", "dense_score", "final_score")
    return _rounded(out, "sparse_score", "dense_score", "final_score")


def _store_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a page store, and a result page read from it by ids."""
    path = new_folder(spark)
    sinks.write_page_store(_read(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("link"), F.lit("").alias("title"), F.col("text").alias("content")), path)
    page = store.read_documents(spark, path, [r["doc_id"] for r in _hybrid(spark, sf_dir).collect()])
    return page.select("doc_id", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def _snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _picked(index.document_frequencies(_counts(spark, sf_dir)))
    page = _results(spark, sf_dir)
    return page.select("doc_id", snippet_column(F.col("content"), words).alias("abstract"), F.round("final_score", 6).alias("final_score"))


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot.click_counts(hot.event_clicks(_read(spark, sf_dir, "events")))


def _hot_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # as a pattern, for the stream source takes no path of a single file
    query = count_to_table(stream_clicks(spark, f"{path}*", spark.read.parquet(path).schema), "hot_clicks")
    query.awaitTermination()
    return hot.hot(spark.table("hot_clicks"))


def _hot_durable(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    table = ClickTable(spark, new_folder(spark))
    table.count(stream_clicks(spark, f"{path}*", spark.read.parquet(path).schema)).awaitTermination()
    return hot.hot(table.totals())


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_embeddings(_counts(spark, sf_dir))


def _hybrid_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse and dense scores of the same documents, whose vectors are made of their terms, counted once."""
    kept = _kept_with_frequencies(spark, sf_dir)
    vectors = hashed_embeddings(kept[0])
    words = checkpointed(_vector(spark, sf_dir, False, kept[1]).select("term"))
    query = hashed_embeddings(words.select(F.lit(0).alias("doc_id"), "term", F.lit(1).alias("n"))).first()
    dense = search.dense_search(vectors, query["embedding"]) if query else None
    return search.fuse(_all_sparse(spark, sf_dir, kept), dense)


def _hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


QUERIES: dict[str, Query] = {
    "html_decode": lambda s, d: _read(s, d, "pages").select("page_id", tx.html_decode(F.col("html")).alias("text")),
    "html_strip": lambda s, d: _read(s, d, "pages").select("page_id", tx.html_strip(F.col("html")).alias("text")),
    "clean_html": lambda s, d: _read(s, d, "pages").select("page_id", tx.clean_html(F.col("html")).alias("text")),
    "ingest_pages": _pages,
    "content_fallback": _fallback,
    "tokenize": lambda s, d: index.terms(_docs(s, d), _stop(s)),
    "tokenize_words": lambda s, d: index.terms(_docs(s, d), tokens=lambda c: tx.tokenize(c, "word")),
    "segment": _segmented,
    "stopword_filter": lambda s, d: _counts(s, d).select("doc_id", "term"),
    "en_dict": _en,
    "cn_dict": _cn,
    "en_char_index": lambda s, d: lexicon.character_index(_en(s, d)),
    "cn_char_index": lambda s, d: lexicon.character_index(_cn(s, d)),
    "tf": lambda s, d: _rounded(index.term_frequencies(_kept(s, d)), "tf"),
    "doc_len": lambda s, d: index.document_lengths(_counts(s, d)),
    "df": lambda s, d: index.document_frequencies(_counts(s, d)),
    "idf": lambda s, d: index.document_frequencies(_counts(s, d)).select("term", F.round(index.idf(_docs(s, d).count(), F.col("df")), 6).alias("idf")),
    "vocab": lambda s, d: _counts(s, d).select("term").distinct(),
    "tfidf_index": lambda s, d: _rounded(_index(s, d), "weight"),
    "postings": lambda s, d: index.packed_postings(_packed(s, d)).select("term", F.size("postings").cast("long").alias("n"), F.get("postings", F.lit(0))["doc_id"].alias("first_doc")),
    "postings_blocks": lambda s, d: _rounded(blocks.expand(_blocks(s, d)).select("doc_id", "term", "weight"), "weight"),
    "query_vector": lambda s, d: _rounded(_vector(s, d).select("term", "q_weight"), "q_weight"),
    "and_candidates": lambda s, d: _matches(s, d).select("doc_id"),
    "and_candidates_strict": lambda s, d: _matches(s, d, absent=False, strict=True).select("doc_id"),
    "sparse_search": lambda s, d: _rounded(_sparse(s, d), "sparse_score"),
    "sparse_search_blocks": lambda s, d: _rounded(_block_search(s, d), "sparse_score"),
    "dense_search": lambda s, d: _rounded(_dense(s, d), "score"),
    "score_display": lambda s, d: _dense(s, d).select("vec_id", tx.four_digits(F.col("score")).alias("score")),
    "hybrid_search": lambda s, d: _rounded(_hybrid(s, d), "sparse_score", "dense_score", "final_score"),
    "embed_docs": lambda s, d: _embedded(s, d).select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("pos", "x")),
    "hybrid_docs": lambda s, d: _rounded(_hybrid_docs(s, d), "sparse_score", "dense_score", "final_score"),
    "hybrid_degraded": lambda s, d: _rounded(search.fuse(_all_sparse(s, d), None), "sparse_score", "dense_score", "final_score"),
    "search_results": _search_results,
    "store_page": _store_page,
    "snippet": _snippet,
    "snippet_start": lambda s, d: _docs(s, d).select("doc_id", snippet_column(F.col("text"), [ABSENT]).alias("abstract")),
    "keyword_pos": _keyword_pos,
    "highlight": _highlight,
    "highlight_words": lambda s, d: _docs(s, d).select("doc_id", F.explode(tx.highlight_words(F.col("text"))).alias("word")),
    "normalize_key": lambda s, d: _docs(s, d).select("doc_id", tx.normalize_key(F.col("text")).alias("key")),
    "levenshtein": lambda s, d: suggest.levenshtein_pairs(_en(s, d).select("word"), "thering"),
    "suggest_prefix": lambda s, d: _suggested(s, d, lambda en, word: suggest.by_prefix(en, word[:2])),
    "suggest_corrections": lambda s, d: _suggested(s, d, lambda en, word: suggest.corrections(en, word[:3] + "zz")),
    "suggest_corrections_ref": lambda s, d: _suggested(s, d, lambda en, word: suggest.corrections(en, word[:3] + "zz", order="reference")),
    "suggest": lambda s, d: _suggested(s, d, suggest.suggest),
    "suggest_prefix_batch": _batch_prefix,
    "suggest_corrections_batch": lambda s, d: suggest.batch_corrections(_en(s, d), _asked(s, d).withColumnRenamed("word", "query")),
    "vector_files": _vector_files,
    "trie_words": _trie_words,
    "simhash": lambda s, d: _hashes(s, d).select("doc_id", _hex(F.col("h")).alias("h")),
    "simhash_tfidf": lambda s, d: dedup.simhash(_docs(s, d), dedup.integer_weights(_kept(s, d), _size(s, d))).select("doc_id", _hex(F.col("h")).alias("h")),
    "hamming_pairs": lambda s, d: dedup.near_pairs(_hashes(s, d)),
    "hamming_links": lambda s, d: dedup.near_links(_hashes(s, d)),
    "dedup_greedy": lambda s, d: dedup.keep_first(_hashes(s, d)),
    "hot_docs": lambda s, d: hot.hot(_clicks(s, d)),
    "hot_stats": lambda s, d: hot.hot_stats(_clicks(s, d)),
    "hot_docs_streaming": _hot_streaming,
    "hot_docs_durable": _hot_durable,
}

# --- the same in SQL

_SQL_STOP = ", ".join(f"'{w}'" for w in STOP)
_UP, _LOW = tx.UPPER, tx.LOWER
_TERMS = f"""toks AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{tx.REGEX_TOKENS}', 1) AS l FROM documents)),
lowered AS (SELECT doc_id, pos, translate(raw, '{_UP}', '{_LOW}') AS term FROM toks),
terms AS (SELECT * FROM lowered WHERE regexp_matches(term, '[^{tx.SPACES}]') AND term NOT IN ({_SQL_STOP}))"""
_COUNTS = f"""{_TERMS},
counts AS (SELECT doc_id, term, count(*) AS n FROM terms GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY ALL),
size AS (SELECT count(*)::DOUBLE AS docs FROM documents)"""
_INDEX = f"""{_COUNTS},
raw AS (SELECT doc_id, term, n * log2(docs / (df + 1)) AS w FROM counts JOIN df USING (term), size),
idx AS (SELECT doc_id, term, CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS norm FROM raw))"""
_QUERY = f"""ranked_terms AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS k FROM df WHERE regexp_full_match(term, '[a-z]{{3,}}')),
picked AS (SELECT term FROM ranked_terms WHERE k IN {PICKED})"""


def _vector_sql(absent: bool = True) -> str:
    more = f" UNION ALL SELECT '{ABSENT}'" if absent else ""
    return f"""{_INDEX}, {_QUERY},
q AS (SELECT p.term, df.df, 1.0 / (count(*) OVER ()) * log2(docs / (coalesce(df.df, 0) + 1)) AS w FROM (SELECT term FROM picked{more}) p LEFT JOIN df USING (term), size),
vec AS (SELECT term, df, w / sqrt(sum(w * w) OVER ()) AS q_weight FROM q),
hits AS (SELECT doc_id, count(*) AS found, sum(q_weight * weight) AS score FROM vec JOIN idx USING (term) GROUP BY ALL),
cands AS (SELECT doc_id, round(score, 9) AS sparse_score FROM hits WHERE found = (SELECT count(df) FROM vec))"""


_DENSE = """qv AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0),
dense AS (SELECT vec_id, round(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q), 9) AS score FROM embeddings, qv ORDER BY score DESC, vec_id DESC LIMIT 60)"""
_FUSED = f"""{_vector_sql()}, {_DENSE},
fused AS (SELECT coalesce(c.doc_id, d.vec_id) AS doc_id, coalesce(sparse_score, 0) AS sparse_score, coalesce((d.score + 1) / 2, 0) AS dense_score FROM cands c FULL JOIN dense d ON d.vec_id = c.doc_id),
best AS (SELECT *, round(0.5 * sparse_score + 0.5 * dense_score, 9) AS final_score FROM fused ORDER BY final_score DESC, doc_id LIMIT 20)"""
_EMBEDDED_OF_COUNTS = """places AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS place, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN n ELSE -n END) AS v FROM counts GROUP BY ALL),
squares AS (SELECT doc_id, sum(v * v)::DOUBLE AS squares FROM places GROUP BY doc_id HAVING sum(v * v) > 0),
vectors AS (SELECT s.doc_id AS vec_id, list((coalesce(p.v, 0)::DOUBLE / sqrt(squares))::FLOAT ORDER BY i.place) AS embedding
            FROM squares s CROSS JOIN (SELECT unnest(range(64)) AS place) i LEFT JOIN places p ON p.doc_id = s.doc_id AND p.place = i.place GROUP BY s.doc_id)"""
_EMBEDDED = f"{_COUNTS}, {_EMBEDDED_OF_COUNTS}"
_ROUND3 = "round(sparse_score, 6) AS sparse_score, round(dense_score, 6) AS dense_score, round(final_score, 6) AS final_score"


def _dict_sql(pattern: str, lowered: bool, valid: str = "") -> str:
    source = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')" if lowered else "coalesce(text, '')"
    return f"SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all({source}, '{pattern}', 1)) AS word FROM documents) WHERE word NOT IN ({_SQL_STOP}){valid} GROUP BY ALL"


_EN = _dict_sql("([a-z]+)", True)
_CN = _dict_sql(tx.REGEX_TOKENS, False, f" AND regexp_matches(word, '[A-Za-z0-9{tx.CJK}]')")
_ASKED = f"asked AS (SELECT DISTINCT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '([a-z]+)', 1)) AS word FROM benchmark)"
_CHARS = "SELECT DISTINCT unnest(string_split(word, '')) AS ch, word FROM d"
_ENTITY_CASES = " ".join("WHEN t = '{}' THEN '{}'".format(e, to.replace("'", "''")) for e, to in tx.ENTITIES.items()) + " WHEN starts_with(t, '&#') THEN ''"
_DECODE = f"array_to_string(list_transform(regexp_extract_all(html, '{tx.ENTITY_TOKENS}', 1), lambda t: CASE {_ENTITY_CASES} ELSE t END), '')"
_STRIP = "regexp_replace({}, '<[^>]*>?|>', '', 'g')"
_WORD = f"en AS ({_EN}), w AS (SELECT word AS top FROM en WHERE length(word) >= 5 ORDER BY freq DESC, word LIMIT 1)"
_NEAR = f"{_WORD}, near AS (SELECT word, freq, levenshtein(word, left(top, 3) || 'zz')::INTEGER AS dist FROM en, w)"
_SUM = ", ".join(f"sum(CASE WHEN (fh >> {b}) & 1 = 1 THEN n ELSE -n END) AS b{b}" for b in range(64))
_BITS = " | ".join(f"(CASE WHEN b{b} > 0 THEN (1::UBIGINT << {b}) ELSE 0::UBIGINT END)" for b in range(64))
_HASHES = f"""{_COUNTS},
wanted AS (SELECT doc_id, greatest(5, least(200, octet_length(encode(coalesce(text, ''))) // 120)) AS wanted FROM documents),
feats AS (SELECT doc_id, n, ('0x' || substr(md5(term), 1, 16))::UBIGINT AS fh FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS k FROM counts) JOIN wanted USING (doc_id) WHERE k <= wanted),
sums AS (SELECT doc_id, {_SUM} FROM feats GROUP BY doc_id),
hashes AS (SELECT d.doc_id, coalesce({_BITS}, 0::UBIGINT) AS h FROM documents d LEFT JOIN sums USING (doc_id))"""
_WEIGHED = """weighed AS (SELECT doc_id, term, greatest(1, n * floor(1000 * log2(docs / df) + 1e-6)::BIGINT)::BIGINT AS n FROM counts JOIN df USING (term), size)"""
_CLICKS = "clicks AS (SELECT json_extract_string(props, '$.k')::BIGINT AS doc_id, count(*) AS click_count FROM events WHERE event_type = 'click' GROUP BY ALL)"
_HOT = f"WITH {_CLICKS} SELECT row_number() OVER (ORDER BY click_count DESC, doc_id DESC)::INTEGER AS rank, doc_id, click_count FROM clicks ORDER BY rank LIMIT 10"
_LOWER_TEXT = f"translate(text, '{_UP}', '{_LOW}')"
_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"

ORACLE_SQL: dict[str, str] = {
    "html_decode": f"SELECT page_id, {_DECODE} AS text FROM pages",
    "html_strip": f"SELECT page_id, {_STRIP.format('html')} AS text FROM pages",
    "clean_html": f"SELECT page_id, {_STRIP.format(_DECODE)} AS text FROM pages",
    "ingest_pages": f"SELECT * FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)', 1) AS title, {_STRIP.format(_DECODE)} AS text FROM pages) WHERE text <> ''",
    "content_fallback": "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN text END, ''), nullif(CASE WHEN doc_id % 4 = 1 THEN text ELSE '' END, ''), nullif(CASE WHEN doc_id % 4 = 2 THEN source END, '')) AS content FROM documents",
    "tokenize": f"WITH {_TERMS} SELECT doc_id, pos::INTEGER AS pos, term FROM terms",
    "tokenize_words": f"SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, translate(unnest(l), '{_UP}', '{_LOW}') AS term FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{tx.WORD_TOKENS}', 1) AS l FROM documents)",
    "stopword_filter": f"WITH {_TERMS} SELECT DISTINCT doc_id, term FROM terms",
    "en_dict": _EN,
    "cn_dict": _CN,
    "en_char_index": f"WITH d AS ({_EN}) {_CHARS}",
    "cn_char_index": f"WITH d AS ({_CN}) {_CHARS}",
    "tf": f"WITH {_COUNTS} SELECT doc_id, term, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS tf FROM counts",
    "doc_len": f"WITH {_COUNTS} SELECT doc_id, sum(n)::BIGINT AS total FROM counts GROUP BY ALL",
    "df": f"WITH {_COUNTS} SELECT term, df FROM df",
    "idf": f"WITH {_COUNTS} SELECT term, round(log2(docs / (df + 1)), 6) AS idf FROM df, size",
    "vocab": f"WITH {_TERMS} SELECT DISTINCT term FROM terms",
    "tfidf_index": f"WITH {_INDEX} SELECT doc_id, term, round(weight, 6) AS weight FROM idx",
    "postings": f"WITH {_INDEX} SELECT term, count(*) AS n, min(doc_id) AS first_doc FROM idx GROUP BY ALL",
    "query_vector": f"WITH {_vector_sql()} SELECT term, round(q_weight, 6) AS q_weight FROM vec",
    "and_candidates": f"WITH {_vector_sql()} SELECT doc_id FROM cands",
    "and_candidates_strict": f"WITH {_vector_sql(False)} SELECT doc_id FROM cands",
    "sparse_search": f"WITH {_vector_sql()} SELECT doc_id, round(sparse_score, 6) AS sparse_score FROM (SELECT * FROM cands ORDER BY sparse_score DESC, doc_id LIMIT 20)",
    "dense_search": f"WITH {_DENSE} SELECT vec_id, round(score, 6) AS score FROM dense",
    "score_display": f"WITH {_DENSE} SELECT vec_id, format('{{:.4f}}', score) AS score FROM dense",
    "hybrid_search": f"WITH {_FUSED} SELECT doc_id, {_ROUND3} FROM best",
    "embed_docs": f"WITH {_EMBEDDED} SELECT vec_id AS doc_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos, unnest(embedding) AS x FROM vectors",
    "hybrid_docs": f"""WITH {_vector_sql()}, {_EMBEDDED_OF_COUNTS},
asked AS (SELECT place, sum(s) AS v FROM (SELECT ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS place, CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM picked) GROUP BY place),
qv AS (SELECT list((coalesce(a.v, 0)::DOUBLE / sqrt((SELECT sum(v * v) FROM asked))::DOUBLE)::FLOAT ORDER BY i.place) AS q FROM (SELECT unnest(range(64)) AS place) i LEFT JOIN asked a USING (place)),
dense AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 9) AS score FROM vectors, qv ORDER BY score DESC, vec_id DESC LIMIT 60),
fused AS (SELECT coalesce(c.doc_id, d.vec_id) AS doc_id, coalesce(sparse_score, 0) AS sparse_score, coalesce((d.score + 1) / 2, 0) AS dense_score FROM cands c FULL JOIN dense d ON d.vec_id = c.doc_id),
best AS (SELECT *, round(0.5 * sparse_score + 0.5 * dense_score, 9) AS final_score FROM fused ORDER BY final_score DESC, doc_id LIMIT 20)
SELECT doc_id, {_ROUND3} FROM best""",
    "hybrid_degraded": f"WITH {_vector_sql()} SELECT doc_id, round(sparse_score, 6) AS sparse_score, 0.0::DOUBLE AS dense_score, round(sparse_score, 6) AS final_score FROM (SELECT * FROM cands ORDER BY sparse_score DESC, doc_id LIMIT 20)",
    "search_results": f"WITH {_FUSED} SELECT b.doc_id, '' AS title, md5(coalesce(text, '')) AS content_md5, {_ROUND3} FROM best b LEFT JOIN documents d USING (doc_id)",
    "store_page": f"WITH {_FUSED} SELECT b.doc_id, '' AS title, md5(coalesce(text, '')) AS content_md5 FROM best b JOIN documents d USING (doc_id)",
    "snippet_start": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
heads AS (SELECT *, left(t, list_max(list_filter(range(301), lambda k: octet_length(encode(left(t, k))) <= 300))) AS head FROM d),
ends AS (SELECT *, list_max(list_transform(['。', '，', '！', '？', ',', '.', '!', '?', ' '], lambda m: CASE WHEN strpos(reverse(head), m) > 0 THEN length(head) - strpos(reverse(head), m) ELSE -1 END)) AS soft FROM heads)
SELECT doc_id, CASE WHEN octet_length(encode(t)) <= 300 THEN t
  WHEN soft >= 0 AND octet_length(encode(left(head, soft))) > octet_length(encode(head)) * 2 // 3 THEN left(head, soft) || '...' ELSE head || '...' END AS abstract FROM ends""",
    "keyword_pos": f"""WITH {_COUNTS}, {_QUERY}, words AS (SELECT term FROM picked UNION ALL SELECT '{ABSENT}'),
found AS (SELECT doc_id, text, strpos({_LOWER_TEXT}, term) AS p FROM documents, words)
SELECT doc_id, min(CASE WHEN p > 0 THEN octet_length(encode(left(text, (p - 1)::BIGINT))) END)::BIGINT AS pos FROM found GROUP BY doc_id""",
    "highlight": f"SELECT doc_id, regexp_replace({_ESCAPED}, '(?i)({'|'.join(MARKED)})', '<em>\\1</em>', 'g') AS text FROM documents",
    "highlight_words": r"SELECT DISTINCT doc_id, lower(unnest(list_concat(regexp_extract_all(text, '([a-zA-Z0-9]+)', 1), regexp_extract_all(text, '([\x{4E00}-\x{9FFF}])', 1)))) AS word FROM documents",
    "normalize_key": f"SELECT doc_id, translate(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') AS key FROM documents",
    "levenshtein": f"WITH d AS ({_EN}) SELECT word, levenshtein(word, 'thering')::INTEGER AS dist, levenshtein(word, 'thering') <= 3 AS within FROM d",
    "suggest_prefix": f"WITH {_WORD} SELECT word, freq FROM en, w WHERE starts_with(word, left(top, 2)) ORDER BY freq DESC, word LIMIT 5",
    "suggest_corrections": f"WITH {_NEAR} SELECT * FROM near WHERE dist <= 2 ORDER BY dist, freq DESC, word LIMIT 5",
    "suggest_corrections_ref": f"WITH {_NEAR} SELECT * FROM near WHERE dist <= 2 ORDER BY dist DESC, freq DESC, word DESC LIMIT 5",
    "suggest": f"""WITH {_WORD}, pre AS (SELECT word, freq FROM en, w WHERE starts_with(word, top) ORDER BY freq DESC, word LIMIT 5),
fix AS (SELECT word, freq, row_number() OVER (ORDER BY levenshtein(word, top), freq DESC, word) AS k FROM en, w WHERE levenshtein(word, top) <= CASE WHEN length(top) <= 5 THEN 2 ELSE 3 END)
SELECT word, freq, 'prefix' AS type FROM pre UNION ALL SELECT word, freq, 'correction' FROM fix WHERE k <= 5 - (SELECT count(*) FROM pre) AND word NOT IN (SELECT word FROM pre)""",
    "suggest_prefix_batch": f"""WITH en AS ({_EN}), {_ASKED}, q AS (SELECT DISTINCT left(word, n) AS query FROM asked, (VALUES (1), (3)) AS v(n)),
hits AS (SELECT query, word, freq, row_number() OVER (PARTITION BY query ORDER BY freq DESC, word)::INTEGER AS rank FROM en JOIN q ON starts_with(word, query))
SELECT * FROM hits WHERE rank <= 5""",
    "suggest_corrections_batch": f"""WITH en AS ({_EN}), {_ASKED}, near AS (SELECT a.word AS query, en.word, freq, levenshtein(en.word, a.word)::INTEGER AS dist, CASE WHEN length(a.word) <= 2 THEN 1 WHEN length(a.word) <= 5 THEN 2 ELSE 3 END AS most
FROM en JOIN asked a ON abs(length(en.word) - length(a.word)) <= 3),
ranked AS (SELECT query, word, freq, dist, row_number() OVER (PARTITION BY query ORDER BY dist, freq DESC, word)::INTEGER AS rank FROM near WHERE dist <= most)
SELECT * FROM ranked WHERE rank <= 5""",
    "vector_files": "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos, unnest(embedding) AS x FROM embeddings WHERE embedding IS NOT NULL",
    "trie_words": _EN,
    "simhash": f"WITH {_HASHES} SELECT doc_id, format('{{:016x}}', h) AS h FROM hashes",
    "simhash_tfidf": f"WITH {_HASHES.replace('wanted AS', f'{_WEIGHED}, wanted AS', 1).replace('FROM counts) JOIN', 'FROM weighed) JOIN')} SELECT doc_id, format('{{:016x}}', h) AS h FROM hashes",
    "hamming_pairs": f"""WITH {_HASHES}, first AS (SELECT h, min(doc_id) AS doc_id FROM hashes GROUP BY h)
SELECT a.doc_id AS i, b.doc_id AS j, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM first a JOIN first b ON a.doc_id < b.doc_id AND bit_count(xor(a.h, b.h)) <= 3""",
    "hamming_links": f"""WITH {_HASHES}, named AS (SELECT doc_id, h, min(doc_id) OVER (PARTITION BY h) AS head FROM hashes)
SELECT a.doc_id AS i, b.doc_id AS j, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM named a JOIN named b ON a.doc_id < b.doc_id AND bit_count(xor(a.h, b.h)) <= 3
WHERE a.doc_id = a.head AND (b.doc_id = b.head OR b.head = a.doc_id)""",
    "dedup_greedy": f"""WITH RECURSIVE {_HASHES}, numbered AS MATERIALIZED (SELECT doc_id, h, row_number() OVER (ORDER BY doc_id) AS k FROM hashes),
lower AS MATERIALIZED (SELECT b.k, list(a.doc_id) AS near FROM numbered a JOIN numbered b ON a.k < b.k AND bit_count(xor(a.h, b.h)) <= 3 GROUP BY b.k),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL
SELECT n.k, CASE WHEN l.near IS NOT NULL AND list_has_any(w.kept, l.near) THEN w.kept ELSE list_append(w.kept, n.doc_id) END FROM walk w JOIN numbered n ON n.k = w.k + 1 LEFT JOIN lower l ON l.k = n.k)
SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM walk ORDER BY k DESC LIMIT 1)""",
    "hot_docs": _HOT,
    "hot_stats": f"WITH {_CLICKS} SELECT count(*) AS unique_docs, sum(click_count)::BIGINT AS total_clicks FROM clicks",
    "hot_docs_streaming": _HOT,
    "hot_docs_durable": _HOT,
}
ORACLE_SQL |= {"postings_blocks": ORACLE_SQL["tfidf_index"], "sparse_search_blocks": ORACLE_SQL["sparse_search"]}
