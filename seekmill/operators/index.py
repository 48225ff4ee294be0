"""Term statistics and the normalised TF-IDF inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekmill.functions.text import LOWER_TOKENS, SPACES, ascii_lower, is_blank, tokenize
from seekmill.operators.lexicon import without_stopwords
from seekmill.sources.shared import written

CARRIED = 1 << 16  # stopwords that travel with a plan
PIECE = 16 << 20  # bytes of text whose counts are packed together


def terms(docs: DataFrame, stopwords: DataFrame | None = None, text_col: str = "text", tokens: Callable[[Column], Column] = tokenize) -> DataFrame:
    """doc_id, pos, term of every token that is neither blank nor a stopword after lower-casing."""
    out = docs.select("doc_id", F.posexplode(F.transform(tokens(F.col(text_col)), ascii_lower)).alias("pos", "term"))
    return without_stopwords(out.where(~is_blank(F.col("term"))), stopwords, "term").select("doc_id", "pos", "term")


def term_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def _bags(stop: list[str]):
    """Rows of (doc_id, tokens, or null, most) -> a row a document and term, those of one document side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, most = batch.columns
            found = lists.flatten().dictionary_encode()
            words = pc.ascii_lower(found.dictionary).dictionary_encode()
            terms = words.dictionary
            dropped = pc.or_(pc.invert(pc.match_substring_regex(terms, f"[^{SPACES}]")), pc.is_in(terms, value_set=pa.array(stop, terms.type)))
            good = np.append(~dropped.to_numpy(zero_copy_only=False), False)  # the last is a null token's
            at = pc.fill_null(words.indices.take(found.indices), len(terms)).to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            key, n = np.unique((row * len(good) + at)[good[at]], return_counts=True)
            row, at = key // len(good), key % len(good)
            if most.null_count < len(most):
                place = np.empty(len(terms), np.int64)
                place[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
                order = np.lexsort((place[at], -n, row))
                begins = np.searchsorted(row, row)  # rows stay in order
                order = order[np.arange(len(row)) - begins < pc.fill_null(most, 0).to_numpy(zero_copy_only=False)[row]]
                row, at, n = row[order], at[order], n[order]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), terms.take(pa.array(at)), pa.array(n, pa.int64())], names=["doc_id", "term", "n"])

    return run


def _counted(stop: list[str]):
    """What ``_bags`` gives, for rows of (doc_id, text, most) and the default tokens: only texts reach Python, not their tokens."""
    find, unwanted = re.compile(LOWER_TOKENS).findall, frozenset(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            cut = whole.column(2).null_count < whole.num_rows
            for begin in range(0, whole.num_rows, 500):
                ids, texts, most = whole.slice(begin, 500).columns
                found = [Counter(find(t)) for t in pc.ascii_lower(texts).to_pylist()]
                for bag in found:
                    for term in [t for t in bag if t in unwanted]:
                        del bag[term]
                if cut:
                    found = [dict(sorted(bag.items(), key=lambda x: (-x[1], x[0]))[: m or 0]) for bag, m in zip(found, most.to_pylist(), strict=True)]
                row = pa.array(np.repeat(np.arange(len(found)), [len(bag) for bag in found]))
                terms, n = (pa.array(list(chain.from_iterable(each)), kind) for each, kind in ((found, pa.string()), ((bag.values() for bag in found), pa.int64())))
                yield pa.RecordBatch.from_arrays([ids.take(row), terms, n], names=["doc_id", "term", "n"])

    return run


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Whole rows of (doc_id, text), in batches of ``most`` bytes and the row that reaches them."""
    held, size = [], 0
    for batch in batches:
        ends = size + np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) + np.int64(16))
        begin = 0
        for end in (np.flatnonzero(np.diff(ends // most, prepend=0)) + 1).tolist():
            yield pa.concat_batches([*held, batch.slice(begin, end - begin)])
            held, begin = [], end
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
        size = int(ends[-1]) % most if batch.num_rows else size
    if held:
        yield pa.concat_batches(held)


def _packed(stop: list[str], most: int):
    """Rows of (doc_id, text) and the default tokens -> rows of (piece, term, docs, n) with a term's documents side by
    side. A piece is a batch of whole documents; each distinct word between its blanks is cut into tokens once."""
    find = re.compile(LOWER_TOKENS).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, batch in enumerate(_cut(batches, most), TaskContext.get().partitionId() << 32):
            ids, texts = batch.columns
            rows = np.int64(len(ids))
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            words = lists.flatten().dictionary_encode()
            row = pc.list_parent_indices(lists).to_numpy()
            key, n = np.unique(words.indices.to_numpy() * rows + row, return_counts=True)
            word, row = key // rows, key % rows
            found = list(map(find, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
            tokens = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
            # a word that a document has n times has each of its tokens n times
            each = np.fromiter(map(len, found), np.int64, len(found))
            begins, each = (np.cumsum(each) - each)[word], each[word]
            ends = np.cumsum(each)
            token = tokens.indices.to_numpy()[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + each, each)]
            key, n = token * rows + np.repeat(row, each), np.repeat(n, each)
            kept = ~pc.is_in(tokens.dictionary, value_set=pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)
            key, n = key[kept[token]], n[kept[token]]
            order = np.argsort(key)
            key, n = key[order], n[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, n = key[first], np.add.reduceat(n, first) if len(first) else n
            terms, lengths = np.unique(key // rows, return_counts=True)
            columns = [pa.array(np.full(len(terms), piece)), tokens.dictionary.take(pa.array(terms))]
            columns += [_lists(lengths, ids.take(pa.array(key % rows))), _lists(lengths, pa.array(n, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "term", "docs", "n"])

    return run


def _few(stopwords: DataFrame | None) -> list[str] | None:
    """The distinct stopwords, or None where they are too many to travel with a plan."""
    stop = [] if stopwords is None else [r["word"] for r in stopwords.select("word").dropna().distinct().limit(CARRIED + 1).collect()]
    return stop if len(stop) <= CARRIED else None


def _repeated(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty()


def _text(text_col: str) -> Column:
    return F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit("")))


def document_terms(docs: DataFrame, stopwords: DataFrame | None = None, text_col: str = "text", tokens: Callable[[Column], Column] = tokenize, most: Column | None = None) -> DataFrame:
    """doc_id, term, n: what ``term_counts`` gives of ``terms``, counted where a document is read. Nothing is shuffled and a
    task holds a batch of texts, unless doc_ids repeat (their counts are summed) or there are very many stopwords.

    With ``most`` only so many terms of a document need to be right and there: those of greatest n, ties by term."""
    stop, repeated = _few(stopwords), _repeated(docs)
    carried = stop is not None
    few = F.lit(None) if most is None or repeated or not carried else most
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    plain = tokens is tokenize
    read = _text(text_col) if plain else tokens(F.col(text_col))
    out = docs.select("doc_id", read.alias("read"), few.cast("long").alias("most")).mapInArrow((_counted if plain else _bags)(stop or []), schema)
    if not carried:
        out = without_stopwords(out, stopwords, "term").select("doc_id", "term", "n")
    return out.groupBy("doc_id", "term").agg(F.sum("n").alias("n")) if repeated else out


def document_lengths(counts: DataFrame) -> DataFrame:
    return counts.groupBy("doc_id").agg(F.sum("n").alias("total"))


def term_frequencies(counts: DataFrame) -> DataFrame:
    return counts.join(document_lengths(counts), "doc_id").select("doc_id", "term", (F.col("n") / F.col("total")).alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def idf(n_docs: int, df: Column) -> Column:
    """Negative for a term in all documents, zero for one in all but one."""
    return F.log2(F.lit(float(n_docs)) / (df + 1))


def tfidf(counts: DataFrame, n_docs: int, frequencies: DataFrame | None = None) -> DataFrame:
    """doc_id, term, weight: tf times idf over its document's norm; zero weights are kept. ``frequencies``
    are those of all documents where ``counts`` has some of them only.

    The document total cancels in the normalised weight, but a document whose weights are all zero
    keeps them, so both norms are taken from the same products. One shuffle by term (document
    frequency) and one by document (norm); no sort is needed, and hot terms split under AQE.
    """
    freq = document_frequencies(counts) if frequencies is None else frequencies
    raw = counts.join(freq, "term").select("doc_id", "term", "n", (F.col("n") * idf(n_docs, F.col("df"))).alias("w"))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "doc_id").select("doc_id", "term", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(F.lit(0.0)).alias("weight"))


def _weigh(piece: pa.Table) -> pa.Table:
    """All terms of some whole documents, as rows of (piece, term, docs, n, idf) -> term, docs, weights."""
    _, terms, docs, n, idfs = (c.combine_chunks() for c in piece.columns)
    lengths = docs.value_lengths().to_numpy()
    ids = docs.flatten()
    found = ids.dictionary_encode()
    at = pc.fill_null(found.indices, len(found.dictionary)).to_numpy()
    w = n.flatten().to_numpy() * np.repeat(idfs.to_numpy(), lengths)
    norm = np.sqrt(np.bincount(at, w * w))[at]
    weights = np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0)
    return pa.Table.from_arrays([terms, _lists(lengths, ids), _lists(lengths, pa.array(weights))], names=["term", "docs", "weights"])


def packed_tfidf(docs: DataFrame, n_docs: int, stopwords: DataFrame | None = None, text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """term, docs, weights: what ``tfidf`` gives of ``document_terms``, a row a term and piece of documents instead of a row a
    term and document. Only such rows are shuffled, by term for document frequencies and by piece for norms; a task
    holds a piece. Where doc_ids repeat or stopwords are very many, a row has one document."""
    stop = _few(stopwords)
    if stop is None or _repeated(docs):
        flat = tfidf(written(document_terms(docs, stopwords, text_col)), n_docs)
        return flat.select("term", F.array("doc_id").alias("docs"), F.array("weight").alias("weights"))
    ids = docs.schema["doc_id"].dataType.simpleString()
    counts = docs.select("doc_id", _text(text_col).alias("read")).mapInArrow(_packed(stop, piece), f"piece long, term string, docs array<{ids}>, n array<int>")
    df = F.sum(F.size("docs")).over(Window.partitionBy("term"))
    counts = counts.withColumn("idf", idf(n_docs, df))
    return counts.groupBy("piece").applyInArrow(_weigh, f"term string, docs array<{ids}>, weights array<double>")


def unpacked(packed: DataFrame) -> DataFrame:
    """doc_id, term, weight, a row a document and term."""
    rows = packed.select("term", F.inline(F.arrays_zip("docs", "weights")))
    return rows.select(F.col("docs").alias("doc_id"), "term", F.col("weights").alias("weight"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (term, docs, weights) in the order of terms -> a row a term, its documents in ascending order."""

    def joined(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, docs, weights = (c.combine_chunks() for c in pa.Table.from_batches(rows).columns)
        if not len(terms):
            return
        new = np.append(True, pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False))
        at = np.repeat(np.cumsum(new) - 1, docs.value_lengths().to_numpy())
        found = pa.table({"at": at, "doc_id": docs.flatten(), "weight": weights.flatten()})
        found = found.take(pc.sort_indices(found, [("at", "ascending"), ("doc_id", "ascending")])).combine_chunks()
        pairs = pa.StructArray.from_arrays([found[c].combine_chunks() for c in ("doc_id", "weight")], ["doc_id", "weight"])
        yield pa.RecordBatch.from_arrays([terms.filter(pa.array(new)), _lists(np.bincount(at), pairs)], names=["term", "postings"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        terms = batch.column(0)
        if not len(terms):
            continue
        last = pc.index(terms, terms[-1]).as_py()  # the last term may go on in the next batch
        if held and last == 0 and held[0].column(0)[0] == terms[0]:
            held.append(batch)
        else:
            yield from joined([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
    if held:
        yield from joined(held)


def packed_postings(packed: DataFrame) -> DataFrame:
    """What ``postings`` gives of the unpacked rows."""
    ids = packed.schema["docs"].dataType.elementType.simpleString()
    rows = packed.select("term", "docs", "weights").repartition("term").sortWithinPartitions("term")
    return rows.mapInArrow(_joined, f"term string, postings array<struct<doc_id:{ids},weight:double>>")


def postings(index: DataFrame) -> DataFrame:
    """term and its (doc_id, weight) list in ascending document order, for export; search uses the flat rows."""
    return index.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "weight"))).alias("postings"))
