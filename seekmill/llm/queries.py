"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.llm import bpe, chat, exact_dedup, jaccard, langid, line_dedup, packing, periodic, sharding, spelling, token_files, topk, url_filter
from seekmill.llm.storage import new_path

#: Sites of the list, each under three endings, and the days they were added (+) or removed (-).
LISTED_SITES = {
    "adult-x": ["+2024-01-01"],
    "ads-track": ["+2024-01-20", "-2024-05-01", "+2024-09-15"],
    "casino-win": ["+2024-02-10"],
    "cheap-pills": ["+2024-03-01", "-2024-10-01"],
    "free-bets": ["+2023-11-05", "-2024-02-01"],
    "spam-farm": ["+2024-06-30"],
}
ENDINGS = ("example.com", "example.net", "example.org")
#: Addresses of pages: listed still, and taken off before or after the page was fetched.
LISTED_URLS = {
    "blog.tionsh.example.net/en/1": ["+2024-01-01", "-2024-07-01"],
    "tionsh.example.net/de/129652": ["+2024-01-01"],
    "therha.example.com/en/676": ["+2024-03-01"],
    "m.therou.example.com/en/474.html": ["+2024-01-01", "-2024-03-01", "+2024-05-01"],
    "blog.thernd.example.net/de/612?utm_source=feed": ["+2024-01-01", "-2024-02-01"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entry_rows() -> str:
    sign = {"+": "add", "-": "remove"}
    rows = [("domain", f"{site}.{end}", d) for site, days in LISTED_SITES.items() for end in ENDINGS for d in days]
    rows += [("url", url, d) for url, days in LISTED_URLS.items() for d in days]
    return ", ".join(f"('{kind}', '{value}', '{sign[d[0]]}', DATE '{d[1:]}')" for kind, value, d in rows)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch day: page ``i`` counts as fetched on day ``i * 7919 % 366`` of 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetch_day"))
    entries = spark.sql(f"SELECT * FROM VALUES {_entry_rows()} AS t(kind, value, action, day)")
    return url_filter.url_filter(pages, entries)


OP1_SQL = f"""
WITH entries(kind, value, action, day) AS (VALUES {_entry_rows()}),
one AS (SELECT kind, value, day, max(action) AS action FROM entries GROUP BY ALL),
marked AS (SELECT *, lag(action) OVER (PARTITION BY kind, value ORDER BY day) AS was FROM one),
listed AS (SELECT kind, value, action, day AS valid_from, lead(day) OVER (PARTITION BY kind, value ORDER BY day) AS valid_to
           FROM marked WHERE was IS NULL OR was <> action),
caps AS (SELECT page_id, url, (DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER)) AS fetch_day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))
           || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), '/$', '') AS address FROM pages),
hits AS (SELECT c.page_id, l.kind, l.value, l.valid_from,
         row_number() OVER (PARTITION BY c.page_id ORDER BY l.kind DESC, length(l.value) DESC) AS k
         FROM caps c JOIN listed l ON l.action = 'add' AND l.valid_from <= c.fetch_day AND (l.valid_to IS NULL OR c.fetch_day < l.valid_to)
         AND ((l.kind = 'domain' AND (c.host = l.value OR ends_with(c.host, '.' || l.value))) OR (l.kind = 'url' AND c.address = l.value)))
SELECT c.page_id, c.url, c.fetch_day, h.page_id IS NOT NULL AS blocked, h.kind AS entry_kind, h.value AS entry_value, h.valid_from AS entry_from
FROM caps c LEFT JOIN hits h ON h.page_id = c.page_id AND h.k = 1
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.apply_line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, o.keeper IS NOT NULL AND k.doc_id <> o.keeper AS dropped FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    out = langid.identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_char", "rejected")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    out = token_files.read_tokens(spark, path)
    return out.select("doc_id", "start", "n_tokens", token_files.tokens_crc32("tokens").alias("ids_crc32"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents"), change=spelling.respell(199)))


# CRC-32 by its table of 256 remainders; code points up to U+00FF have two bytes at most
OP11_SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END)) AS b FROM runs),
hashed AS (SELECT doc_id, run, n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295::BIGINT)) AS h FROM bytes, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
cuts AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS cut FROM places),
shorter AS (SELECT DISTINCT c.word AS a, c.n AS a_n, w.word AS b, w.n AS b_n FROM cuts c JOIN words w ON c.cut = w.word),
near AS (SELECT a AS word, b AS other, b_n AS other_n FROM shorter UNION ALL SELECT b, a, a_n FROM shorter
         UNION ALL SELECT x.word, y.word, y.n FROM cuts x JOIN cuts y ON x.cut = y.cut AND x.p = y.p AND x.word <> y.word),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n
           FROM words w LEFT JOIN best b ON b.word = w.word AND b.k = 1),
walk AS (SELECT word, word AS at, form AS next FROM formed UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON f.word = w.next)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation -7 says control strings in both of its turns."""
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_and_read(turns.unionByName(extra))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text where each tenth document (by its id's CRC-32) goes on in a period from a word of its own on. A null doc_id has no CRC."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)"))).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    cycle = F.expr("flatten(array_repeat(slice(words, a + 1, p), int(1 + (n - a) div p)))")
    planted = F.array_join(F.slice(F.concat(F.expr("slice(words, 1, a)"), cycle), 1, F.col("n")), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.find_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    # runs ascend by start, then period, so the first of equal exponents stays
    best = F.expr("aggregate(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>), (b, r) -> IF(b IS NULL OR r.length * b.period > b.length * r.period, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_token_files": op7_token_files,
    "op8_sharding": op8_sharding,
    "op9_top_k_search": op9_top_k_search,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op2_line_dedup": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op9_top_k_search": OP9_SQL, "op11_spelling_variants": OP11_SQL}
