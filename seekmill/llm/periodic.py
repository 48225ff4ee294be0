"""Periodic runs of words, by repeated k-gram masking and Main-Lorentz on what survives.

A run is a stretch of consecutive words with smallest period q, at least ``max(min_length, ratio * q)``
words long, that no neighbouring word extends keeping period q. Words q apart are equal in it, so the
run without its last period and the run without its first one are equal texts: their length is at least
``min_overlap``, which gives k. Every word of a run therefore lies in a k-gram that the document has
twice; words outside those k-grams are masked, and the words left form segments that hold whole runs.

A segment is halved again and again. A run over the middle has two periods or more on one side of it,
so it shows as a square that begins or ends there; candidates for its period are filtered by words and
by hashes of prefixes, compared exactly, and extended both ways. Squares of a multiple of a found period
are skipped, so a node costs about its length. Periods of ``SHORT`` words or fewer are
read off the segment at once, by comparing it with itself moved, so halving ends at small blocks.

A document is one row and its work is one document's, so nothing is shuffled. Cases: a null or empty
text has no words and no runs; words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; a null doc_id is
kept; rows that repeat are answered each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 16
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_P, _BASE = 2147483647, 1000003
_POWERS = [np.ones(1, np.int64)]


def min_overlap(min_length: int, ratio: int) -> int:
    """The least number of words that a run shares with itself moved by its period."""
    return min(max(min_length, ratio * q) - q for q in range(1, min_length + 1))


def word_ids(words: list[bytes]) -> np.ndarray:
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def surviving(ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches [start, end) of the words that lie in a k-gram which occurs more than once.

    k-grams meet by hash: a collision lets more words survive and loses none.
    """
    n = len(ids) - k + 1
    if n < 2:
        return []
    x = ids.astype(np.uint64)
    h = x[:n].copy()
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[i : i + n]
    order = np.argsort(h)
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return []
    change = np.zeros(len(ids) + 1, np.int64)
    at = np.unique(np.concatenate([order[same], order[same + 1]]))
    change[at] += 1
    change[at + k] -= 1
    covered = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _powers(n: int) -> np.ndarray:
    while len(_POWERS[0]) < n:
        known = _POWERS[0]
        _POWERS[0] = np.concatenate([known, known * pow(_BASE, len(known), _P) % _P])
    return _POWERS[0]


def _prefix_sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum((x + 1) * _powers(len(x))[: len(x)] % _P)])


def _matches(a: np.ndarray, b: np.ndarray) -> int:
    """The number of equal items before the first difference of two arrays of equal length."""
    at, step = 0, 64
    while at < len(a):
        differ = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return len(a)


def _periods(x: np.ndarray, sums: np.ndarray, mid: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """(q, r) of squares of q words that begin at ``mid`` and whose period goes on to ``r`` <= ``end``, for
    ascending q that are no multiple of a period which goes on as far."""
    most = min(most, (end - mid) // 2)
    q = np.arange(1, most + 1)
    q = q[x[mid + q] == x[mid]]
    q = q[x[mid + 2 * q - 1] == x[mid + q - 1]]
    if len(q) > 4:
        first, second = sums[mid + q] - sums[mid], sums[mid + 2 * q] - sums[mid + q]
        q = q[first % _P * _powers(most + 1)[q] % _P == second % _P]
    done = 0
    for period in q.tolist():
        if 2 * period > done and np.array_equal(x[mid : mid + period], x[mid + period : mid + 2 * period]):
            done = period + _matches(x[mid : end - period], x[mid + period : end])
            yield period, mid + done


def _short(x: np.ndarray, min_length: int, ratio: int) -> dict[tuple[int, int], int]:
    """(start, end) -> period of the runs of periods up to ``SHORT``: a pass over the segment for each."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(SHORT, len(x) // ratio) + 1):
        edge = np.flatnonzero(np.diff((x[:-q] == x[q:]).astype(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2] + q
        long = end - start >= max(min_length, ratio * q)
        for stretch in zip(start[long].tolist(), end[long].tolist(), strict=True):
            found.setdefault(stretch, q)
    return found


def runs_of(x: np.ndarray, min_length: int, ratio: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a segment, ascending by start, then period."""
    n, least = len(x), ratio * (SHORT + 1)
    found = {(a, b, q) for (a, b), q in _short(x, min_length, ratio).items()}
    back = x[::-1]
    sums, back_sums = (_prefix_sums(x), _prefix_sums(back)) if n >= least else (None, None)

    def add(left: int, right: int, q: int, lo: int, hi: int) -> None:
        """A stretch that goes on beyond its block is found where a larger block is halved."""
        if q <= SHORT or right - left < max(min_length, ratio * q):
            return
        if (left == lo and lo > 0 and x[lo - 1] == x[lo - 1 + q]) or (right == hi and hi < n and x[hi] == x[hi - q]):
            return
        found.add((left, right, q))

    blocks = [(0, n)]
    while blocks:
        lo, hi = blocks.pop()
        if hi - lo < max(least, min_length):
            continue
        mid = (lo + hi) // 2
        most = (hi - lo) // ratio
        for q, right in _periods(x, sums, mid, hi, most):
            left = mid - _matches(x[lo:mid][::-1], x[lo + q : mid + q][::-1])
            add(left, right, q, lo, hi)
        for q, far in _periods(back, back_sums, n - mid, n - lo, most):
            right = mid + _matches(x[mid - q : hi - q], x[mid:hi])
            add(n - far, right, q, lo, hi)
        blocks += [(lo, mid), (mid, hi)]
    return sorted((a, b - a, q) for a, b, q in found)


def periodic_runs(ids: np.ndarray, min_length: int = 6, ratio: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document's word numbers."""
    if min_length < 2 or ratio < 4:
        raise ValueError("min_length is 2 at least and ratio 4")
    out = []
    for a, b in surviving(ids, min_overlap(min_length, ratio)):
        if b - a >= min_length:
            out += [(a + start, length, q) for start, length, q in runs_of(ids[a:b], min_length, ratio)]
    return out


def _answer(text: bytes, min_length: int, ratio: int) -> tuple[int, list[dict], bytes]:
    words = text.split()  # at bytes 0x20 and 0x09 to 0x0D, as bytes.split does
    runs = periodic_runs(word_ids(words), min_length, ratio) if len(words) >= min_length else []
    kept = words
    if runs:
        stays = np.ones(len(words), bool)
        for start, length, q in runs:
            stays[start + q : start + length] = False
        kept = [words[i] for i in np.flatnonzero(stays).tolist()]
    return len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(kept)


def _runs(min_length: int, ratio: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, runs, kept = zip(*(_answer(t.as_py() or b"", min_length, ratio) for t in part.column(1)), strict=True)
                text = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), text], schema=_SCHEMA)

    return run


def find_runs(docs: DataFrame, min_length: int = 6, ratio: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (ascending by start, then period) and ``collapsed``, the
    words joined by one space without those that any run contains after its first period."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_runs(min_length, ratio), RUNS)
