"""Spelling variants grouped by a symmetric-delete join.

Every word emits itself and its distinct single deletions. Words that share such a key are candidates:
if one is the other with a code point more, or both are one text with a code point inserted, an
equi-join on keys finds them, and a distance of exactly one is verified on the words themselves. Two words
at distance one share exactly one key, so pairs come once. A word's form is its near word of largest count,
where that is ``ratio`` times its own at least; forms have ever larger counts, so following them ends,
and roots are found by joins that double the steps they take.

Words are counted in their documents and tasks first, so a hot word is no hot group; a key has at most
a word for each place and letter. Pairs carry numbers of words, and keys of over ``SHORT`` code points are
hashes, so a word of many letters is not copied for each of its keys.

Cases: a null text has no words; rows that repeat are counted each; ties of forms go to the word that is
smaller in code-point order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekmill.llm.storage import discard, materialize

#: The letters of a word.
LETTERS = r"A-Za-zÀ-ÿ"
SHORT, HELD = 64, 100_000
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_KEYS = pa.schema([("key", pa.string()), ("id", pa.int64())])
_PRIMES, _BASE = (2147483647, 2147483629), 1000003

Respell = Callable[[int | None, str], str]


def respell(every: int) -> Respell:
    """Deletes a code point of the words of a document whose CRC-32 of ``<doc_id>:<word>`` ``every`` divides: a planted misspelling. A null doc_id has none."""

    def run(doc_id: int | None, word: str) -> str:
        if doc_id is None:
            return word
        h = zlib.crc32(f"{doc_id}:{word}".encode())
        at = h % len(word)
        return word if h % every else word[:at] + word[at + 1 :]

    return run


def _count(min_chars: int, change: Respell | None):
    run_of = re.compile(f"[{LETTERS}]{{{min_chars},}}")

    def emit(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # bytes.lower changes A-Z only
                words = run_of.findall((text.as_py() or b"").lower().decode())
                if change is None:
                    held.update(words)
                else:
                    for word, n in Counter(words).items():
                        word = change(doc_id, word)
                        if len(word) >= min_chars:
                            held[word] += n
                size += sum(map(len, words))
                if len(held) > HELD or size > 256 << 20:
                    yield emit(held)
                    held, size = Counter(), 0
        if held:
            yield emit(held)

    return run


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5, change: Respell | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the maximal runs of letters, A-Z in lower case, with at least ``min_chars`` code points and
    ``min_count`` occurrences in all texts. ``change`` may respell a document's word, and shorten it only."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    counts = rows.mapInArrow(_count(min_chars, change), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _long_key(n: int, hashes: tuple[int, ...]) -> str:
    return f"#{n}:" + ":".join(f"{h:x}" for h in hashes)


def _powers(n: int, p: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(_BASE, len(out), p) % p])
    return out[:n]


def keys_of(word: str) -> list[str]:
    """The word and its distinct single deletions: themselves up to ``SHORT`` code points, else hashed with their length."""
    n = len(word)
    # deleting any code point of a stretch of equal ones gives the same text
    at = [i for i in range(n) if i == 0 or word[i] != word[i - 1]]
    if n <= SHORT:
        return [word, *(word[:i] + word[i + 1 :] for i in at)]
    x = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
    places, whole, cut = np.array(at), [], []
    for p in _PRIMES:
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(x * _powers(n, p) % p)])
        whole.append(int(sums[n] % p))
        back = (sums[n] - sums[places + 1]) % p * pow(_BASE, -1, p) % p
        cut.append(((sums[places] + back) % p).tolist())
    shorter = [_long_key(n - 1, h) for h in zip(*cut, strict=True)] if n - 1 > SHORT else [word[:i] + word[i + 1 :] for i in at]
    return [_long_key(n, tuple(whole)), *shorter]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ids = [], []
        for number, word in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = keys_of(word.as_py())
            keys += found
            ids += [number] * len(found)
            if len(keys) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64())], schema=_KEYS)
                keys, ids = [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64())], schema=_KEYS)


def near_pairs(words: DataFrame) -> DataFrame:
    """id, other: all pairs of distance exactly one, both ways. ``words``: id (unique), word (distinct), from a table that reads the same again."""
    keys = words.select("id", "word").mapInArrow(_keys, "key string, id long")
    a, b = keys.select("key", F.col("id").alias("a")), keys.select("key", F.col("id").alias("b"))
    # hashed keys may meet by chance as well as rightly, so pairs are made distinct
    met = a.join(b, "key").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    met = met.join(words.select(F.col("id").alias("a"), F.col("word").alias("word_a")), "a").join(words.select(F.col("id").alias("b"), F.col("word").alias("word_b")), "b")
    near = met.where(F.levenshtein("word_a", "word_b", 1) == 1)
    return near.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """id, form -> id, root: the last of a chain of forms. Each round doubles the steps; chains end, as counts grow along them."""
    at = materialize(forms.select("id", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        further = materialize(at.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(at)
        at = further
        if not at.where("moved").limit(1).count():
            return at.select("id", "root")


def spelling_variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """``counts``: word, n of distinct words -> word, form, root, n, n_near, form_n."""
    words = materialize(counts.select("word", "n").withColumn("id", F.monotonically_increasing_id()))
    other = words.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    near = near_pairs(words).join(other, "other")
    best = near.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other_word").alias("word"), F.col("other").alias("id"))).alias("best"))
    best = materialize(best.join(words.select("id", "n"), "id").withColumn("has_form", -F.col("best.n") >= ratio * F.col("n")))
    last = roots(best.where("has_form").select("id", F.col("best.id").alias("form")))
    last = last.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = words.join(best.drop("n"), "id", "left").join(last, "id", "left")
    return out.select(
        "word",
        F.when(F.col("has_form"), F.col("best.word")).alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("has_form"), -F.col("best.n")).alias("form_n"),
    )
