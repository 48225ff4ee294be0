"""Line dedup that returns compressed keep bitmaps instead of text.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased. A key
of at least ``min_chars`` code points that at least ``min_docs`` documents hold loses all its lines
except those in the largest doc_id that holds it.

Key hashes (128 bits) are range-partitioned by (hash, doc_id descending), so a hash that a third of
all rows share spans many partitions in order, and each partition is sorted by hash, document and
position. A stream over a partition sees the document that keeps the line first and holds back at
most ``min_docs - 1`` documents' rows of one key. Runs that touch a partition's start, or end it
undecided, stay open: each partition adds at most two summaries, which are broadcast (at most twice
the partition count) and settle the open rows.

Cases: a null or empty text is one empty line; a row with a null doc_id takes no part and keeps all
lines; rows that share a doc_id are one document for the counts, each with its own bitmap; repeated
rows get equal bitmaps; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekmill.llm.storage import materialize

LINES = "h binary, doc_id long, text_key long, pos int"
RUNS = "kind int, h binary, doc_id long, text_key long, pos int, n long"
DROP, OPEN, SUMMARY = 0, 1, 2


def key_of(line: bytes) -> bytes:
    return line.lower().strip(b" \t\n\v\f\r")


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _emit(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _lines(min_chars: int):
    schema = pa.schema([("h", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ids, keys, at = [], [], [], []
        for batch in batches:
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for pos, line in enumerate(text.as_py().lower().split(b"\n")):
                    if len(line) >= min_chars:
                        line = line.strip(b" \t\n\v\f\r")
                        if len(line) >= min_chars and code_points(line) >= min_chars:
                            hs.append(xxhash.xxh3_128_digest(line))
                            ids.append(doc)
                            keys.append(key)
                            at.append(pos)
                if len(hs) >= 20_000:
                    yield _emit(schema, [hs, ids, keys, at])
                    hs, ids, keys, at = [], [], [], []
        if hs:
            yield _emit(schema, [hs, ids, keys, at])

    return run


def stream_runs(rows: Iterator[tuple], min_docs: int) -> Iterator[tuple]:
    """Rows (h, doc_id, text_key, pos) sorted by h and descending doc_id -> rows of ``RUNS``."""
    current, first_run = None, True
    held: list[tuple] = []
    docs, keeper, last = 0, None, None

    def close(at_end: bool) -> Iterator[tuple]:
        if current is None:
            return
        if first_run:
            yield SUMMARY, current, keeper, None, None, docs
        elif at_end and docs < min_docs:  # it may go on in the next partition
            for row in held:
                yield OPEN, *row, None
            yield SUMMARY, current, keeper, None, None, docs
        elif at_end:
            yield SUMMARY, current, keeper, None, None, docs

    for row in rows:
        h, doc = row[0], row[1]
        if h != current:
            yield from close(False)
            first_run = current is None
            current, held, docs, keeper, last = h, [], 0, doc, None
        if doc != last:
            docs, last = docs + 1, doc
            if docs == min_docs and not first_run:
                for r in held:
                    if r[1] != keeper:
                        yield DROP, *r, None
                held = []
        if first_run:
            yield OPEN, *row, None
        elif docs < min_docs:
            held.append(row)
        elif doc != keeper:
            yield DROP, *row, None
    yield from close(True)


def _runs(min_docs: int):
    schema = pa.schema([("kind", pa.int32()), ("h", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in stream_runs(rows(batches), min_docs):
            out.append(row)
            if len(out) >= 20_000:
                yield _emit(schema, list(map(list, zip(*out, strict=True))))
                out = []
        if out:
            yield _emit(schema, list(map(list, zip(*out, strict=True))))

    return run


def pack_bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    """Keep bits of ``n_lines`` lines, first line in the highest bit, deflated."""
    keep = np.ones(n_lines, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bitmap(n_lines: int, bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else pack_bitmap(n, np.asarray(d, np.int64)) for n, d in zip(n_lines, dropped, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    out = []
    for t, b in zip(text, bitmap, strict=True):
        if b is None or t is None:
            out.append(None)
            continue
        lines = t.split("\n")
        keep = unpack_bitmap(len(lines), b)
        out.append("\n".join([x for x, k in zip(lines, keep, strict=True) if k]))
    return pd.Series(out, dtype=object)


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, dropped: the positions that a document loses. Documents without any are absent."""
    spark = docs.sparkSession
    rows = _text_rows(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    lines = rows.select("doc_id", "text_key", F.col("text").cast("binary")).mapInArrow(_lines(min_chars), LINES)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(parts, F.col("h"), F.col("doc_id").desc()).sortWithinPartitions("h", F.col("doc_id").desc(), "text_key", "pos")
    runs = materialize(dealt.mapInArrow(_runs(min_docs), RUNS))
    totals = runs.where(F.col("kind") == SUMMARY).groupBy("h").agg(F.sum("n").alias("docs"), F.max("doc_id").alias("keeper"))
    settled = runs.where(F.col("kind") == OPEN).select("h", "doc_id", "text_key", "pos").join(F.broadcast(totals), "h")
    settled = settled.where((F.col("docs") >= min_docs) & (F.col("doc_id") != F.col("keeper")))
    # a run's tail in the next partition drops its rows there; the rows here that outlived a full run are decided already
    dropped = runs.where(F.col("kind") == DROP).select("doc_id", "text_key", "pos").unionByName(settled.select("doc_id", "text_key", "pos"))
    return dropped.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_lines, n_dropped, keep_bitmap (null: all lines stay)."""
    rows = _text_rows(docs, id_col, text_col)
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    heads = rows.select("doc_id", "text_key", n_lines.alias("n_lines"))
    drops = dropped_lines(docs, min_chars, min_docs, id_col, text_col).withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    out = heads.join(drops, heads["doc_id"].eqNullSafe(drops["_d"]) & (heads["text_key"] == drops["_k"]), "left")
    return out.select("doc_id", "text_key", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), _bitmap("n_lines", "dropped").alias("keep_bitmap"))


def apply_line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, keep_bitmap, kept_text. Text moves once, to meet the bitmaps."""
    rows = _text_rows(docs, id_col, text_col)
    drops = dropped_lines(docs, min_chars, min_docs, id_col, text_col).withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    # the drops grow with the documents, so they are never broadcast, however few they are here
    out = rows.join(drops.hint("merge"), rows["doc_id"].eqNullSafe(drops["_d"]) & (rows["text_key"] == drops["_k"]), "left")
    out = out.withColumn("n_lines", n_lines).withColumn("keep_bitmap", _bitmap("n_lines", "dropped"))
    kept = F.coalesce(_kept(F.when(F.col("keep_bitmap").isNotNull(), F.col("text")), F.col("keep_bitmap")), F.col("text"))
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), "keep_bitmap", kept.alias("kept_text"))
