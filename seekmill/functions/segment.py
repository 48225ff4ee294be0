"""Segmentation with a dictionary: the most probable path through all words of a text, and, for what the dictionary
lacks, the most probable division by where characters stand in its words.

The second model has four states: a character begins a word, is inside it, ends it, or is one. Its
probabilities are counted from the dictionary.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekmill.sources.shared import checkpointed

BEGIN, MIDDLE, END, SINGLE = range(4)
#: What may follow a state: a word that began goes on or ends, and after its end another begins.
FOLLOW = {BEGIN: (MIDDLE, END), MIDDLE: (MIDDLE, END), END: (BEGIN, SINGLE), SINGLE: (BEGIN, SINGLE)}
UNSEEN = -20.0  # the log probability of what the dictionary never shows
LONG = 64  # characters of a word from which its further beginnings aren't kept
KEYED, SLOTS, CHUNK = 16, 1 << 27, 1 << 20  # characters that words are looked up by, bits that tell absent ones, characters checked at once
MIX = np.uint64(0x9E3779B97F4A7C15)
SIGNS = string.punctuation + "，。、；：？！…”’»）》」』"  # none is a letter or digit
WHOLE = re.compile(r"[^\W_]+|.", re.DOTALL)  # what most pieces of text are cut into: runs of letters and digits, other characters alone


def segment(text: str, log_freq: dict[str, float], longest: int) -> list[str]:
    """Words of ``text`` with the greatest sum of log frequencies; unknown characters stand alone,
    Latin and digit runs stay whole."""
    floor = min(log_freq.values(), default=0.0) - 1.0
    n = len(text)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for i in range(n):
        j = i + 1
        if text[i].isascii() and text[i].isalnum():
            while j < n and text[j].isascii() and text[j].isalnum():
                j += 1
        for e in {j, *(e for e in range(i + 1, min(n, i + longest) + 1) if text[i:e] in log_freq)}:
            score = best[i] + log_freq.get(text[i:e], floor)
            if score > best[e]:
                best[e], back[e] = score, i
    out, at = [], n
    while at:
        out.append(text[back[at] : at])
        at = back[at]
    return out[::-1]


def segmenter(frequencies: dict[str, int]):
    """A column function for ``tokenize``-like use; the dictionary travels with the plan, so keep it to user words."""
    total = sum(frequencies.values()) or 1
    logs = {w: math.log(f / total) for w, f in frequencies.items() if f > 0}
    longest = max(map(len, logs), default=1)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: segment(t or "", logs, longest))

    def tokens(c: Column) -> Column:
        return run(c)

    return tokens


@dataclass
class Segmenter:
    """Words' log frequencies, also of all their beginnings (None), and the four states' log probabilities. Of words of over
    ``LONG`` characters ``words`` has the beginnings up to that many; they themselves stand in ``long`` by the last of those."""

    words: dict[str, float | None]
    start: list[float]
    follow: dict[tuple[int, int], float]
    shown: list[dict[str, float]]
    floor: float = field(default=0.0)
    long: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    top: float = 0.0  # no word's log frequency is greater

    def cut(self, text: str) -> list[str]:
        """Words of ``text``, which joined are the text without its white space."""
        return [w for part in text.split() for w in self._cut_part(part)]

    def _cut_part(self, part: str) -> list[str]:
        out, loose = [], ""
        for w in self.path(part):
            if len(w) == 1 and w.isalpha() and not w.isascii() or (loose and len(w) == 1 and w.isalpha()):
                loose += w
                continue
            out += self._divide(loose)
            loose = ""
            out.append(w)
        return out + self._divide(loose)

    def path(self, part: str) -> list[str]:
        """The way through the words that begin at each place, single characters and runs of Latin letters and digits, of
        the greatest sum of log frequencies; of equal ways the one whose last word is longest."""
        n = len(part)
        run_end = {m.start(): m.end() for m in re.finditer("[0-9A-Za-z]+", part)}
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for i in range(n):
            if best[i] == -math.inf or best[i] + self.top <= best[n]:  # no way on from here beats one that is found
                continue
            ends = {run_end.get(i, i + 1): None}
            e = i + 1
            while e <= n and (found := self.words.get(part[i:e], -math.inf)) != -math.inf:
                if found is not None:
                    ends[e] = found
                e += 1
            for w, value in self.long.get(part[i : i + LONG], ()) if self.long else ():
                if part.startswith(w, i):
                    ends[i + len(w)] = value
            for e, value in ends.items():
                score = best[i] + (self.floor if value is None else value)
                if score > best[e]:
                    best[e], back[e] = score, i
        out = []
        while n:
            out.append(part[back[n] : n])
            n = back[n]
        return out[::-1]

    def _divide(self, loose: str) -> list[str]:
        """Single characters side by side: as they are where the dictionary has their text, else divided by states."""
        if len(loose) < 2 or self.words.get(loose) is not None or any(w == loose for w, _ in self.long.get(loose[:LONG], ())):
            return list(loose)
        out, at = [], 0
        for i, state in enumerate(self.states(loose), 1):
            if state in (END, SINGLE):
                out.append(loose[at:i])
                at = i
        return out

    def states(self, loose: str) -> list[int]:
        """The most probable states: a first one that may begin, and a last one that may end."""
        score = {s: self.start[s] + self.shown[s].get(loose[0], UNSEEN) for s in (BEGIN, SINGLE)}
        back: list[dict[int, int]] = []
        for ch in loose[1:]:
            now, came = {}, {}
            for a, value in score.items():
                for b in FOLLOW[a]:
                    total = value + self.follow[a, b] + self.shown[b].get(ch, UNSEEN)
                    if b not in now or total > now[b]:
                        now[b], came[b] = total, a
            score = now
            back.append(came)
        at = max((s for s in (END, SINGLE) if s in score), key=lambda s: score[s])
        out = [at]
        for came in reversed(back):
            at = came[at]
            out.append(at)
        return out[::-1]


def _summed(dictionary: DataFrame) -> DataFrame:
    return dictionary.where((F.length("word") > 0) & (F.col("freq") > 0)).groupBy("word").agg(F.sum("freq").alias("freq"))


def _states(words: DataFrame) -> tuple[Segmenter, float]:
    """The four states' model and the sum of all frequencies; its counts are a row a character and state."""
    n = F.length("word")
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.when(n == 1, SINGLE).when(i == 1, BEGIN).when(i == n, END).otherwise(MIDDLE).alias("state"), F.substring("word", i, F.lit(1)).alias("ch")))
    shown = words.select("freq", F.inline(at)).groupBy("state", "ch").agg(F.sum("freq").alias("n")).collect()
    *sums, least = words.agg(
        F.sum(F.when(n == 1, F.col("freq"))).alias("single"), F.sum(F.when(n > 1, F.col("freq"))).alias("several"), F.sum(F.when(n == 2, F.col("freq"))).alias("two"),
        F.sum(F.when(n > 2, F.col("freq"))).alias("longer"), F.sum(F.when(n > 2, F.col("freq") * (n - 3))).alias("inside"), F.min("freq").alias("least"),
    ).first()
    single, several, two, longer, inside = (float(x or 0) for x in sums)
    log = lambda part, of: math.log(part / of) if part > 0 else UNSEEN
    total = single + several
    word = {BEGIN: log(several, total), SINGLE: log(single, total)}
    follow = {(BEGIN, MIDDLE): log(longer, several), (BEGIN, END): log(two, several), (MIDDLE, MIDDLE): log(inside, inside + longer), (MIDDLE, END): log(longer, inside + longer)}
    follow |= {(a, b): word[b] for a in (END, SINGLE) for b in (BEGIN, SINGLE)}
    held: list[dict[str, float]] = [{}, {}, {}, {}]
    for r in shown:
        held[r["state"]][r["ch"]] = float(r["n"])
    logs = [{ch: math.log(v / of) for ch, v in s.items()} for s, of in ((s, math.fsum(s.values())) for s in held)]
    floor = (0.0 if least is None else math.log(least / total)) - 1.0
    return Segmenter({}, [word[BEGIN], UNSEEN, UNSEEN, word[SINGLE]], follow, logs, floor), total


def _knowing(model: Segmenter, frequencies: dict[str, int], total: float) -> Segmenter:
    """``model`` with the words of ``frequencies``."""
    known: dict[str, float | None] = {w: math.log(f / total) for w, f in frequencies.items() if len(w) <= LONG}
    long: dict[str, list[tuple[str, float]]] = {}
    for w, f in frequencies.items():
        if len(w) > LONG:
            long.setdefault(w[:LONG], []).append((w, math.log(f / total)))
    top = max(chain(known.values(), (value for x in long.values() for _, value in x)), default=model.floor)
    for w in [*known, *(x + " " for x in long)]:
        for e in range(len(w) - 1, 0, -1):
            if w[:e] in known:  # a word, or the beginning of one, whose own beginnings are added with it
                break
            known[w[:e]] = None
    return Segmenter(known, model.start, model.follow, model.shown, model.floor, long, top)


def learn(dictionary: DataFrame, most_bytes: int = 256 << 20) -> Segmenter:
    """From word, freq. Every task gets the dictionary, so one whose words and beginnings would take more than ``most_bytes``
    is refused before any of it is collected; ``segmented`` takes a dictionary of any size."""
    words = _summed(dictionary)
    size = words.agg(F.sum(F.length("word") * (F.octet_length("word") / 2 + 100))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"a dictionary of about {size / 1e6:.0f} MB in memory; {most_bytes / 1e6:.0f} MB are allowed")
    model, total = _states(words)
    return _knowing(model, {r["word"]: r["freq"] for r in words.collect()}, total)


def learned_tokens(dictionary: DataFrame, most_bytes: int = 256 << 20):
    """A column function for ``tokenize``-like use, by a model that ``learn`` makes; it is broadcast once."""
    shared = dictionary.sparkSession.sparkContext.broadcast(learn(dictionary, most_bytes))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shared.value.cut(t or ""))

    return lambda c: run(c)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _beginnings(codes: np.ndarray, fits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, places, slots: for n from 1 to ``KEYED``, the texts of n characters that all fit, each by its place and a checksum."""
    at = np.flatnonzero(fits)
    value = np.ones(len(at), np.uint64)
    for n in range(1, KEYED + 1):
        value = value * MIX + codes[at + n - 1]
        yield n, at, (((value ^ value >> np.uint64(29)) * MIX) >> np.uint64(37)).astype(np.int64)
        on = at + n < len(codes)
        on[on] = fits[at[on] + n]
        at, value = at[on], value[on]


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slot of every key, from 1."""
    for batch in batches:
        keys = batch.column(0).to_pylist()
        size = np.fromiter(map(len, keys), np.int64, len(keys))
        begin, codes = np.cumsum(size) - size, _codes("".join(keys))
        length = np.zeros(len(codes), np.int64)
        length[begin] = size
        found = [slots[length[at] == n] for n, at, slots in _beginnings(codes, np.ones(len(codes), bool))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) + 1)], names=["at"])


def _taken(keys: DataFrame) -> np.ndarray:
    """A bit for each of ``SLOTS`` values of a checksum: whether a key has it. Tasks build it in pieces of 4 KB."""
    at = keys.select("key").mapInArrow(_slots, "at long")
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((SLOTS // 32768, 4096), np.uint8)
    for r in rows.toLocalIterator():
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _asks(buckets: int, signs: str):
    """The texts of a batch -> its distinct pieces of two characters or more, without ``signs`` at their ends, by bucket, joined by
    spaces."""

    def run(table: pa.Table) -> pa.Table:
        dealt: dict[int, list[str]] = {}
        pieces: set[str] = set()
        for t in table.column("text").to_pylist():
            pieces.update(t.split())
        for p in sorted({p.rstrip(signs) for p in pieces}):
            if len(p) > 1:
                dealt.setdefault(zlib.crc32(p.encode()) % buckets, []).append(p)
        batch = pa.array(np.full(len(dealt), table.column("batch")[0].as_py()), pa.int32())
        return pa.table({"bucket": pa.array(dealt, pa.int32()), "batch": batch, "pieces": pa.array([" ".join(x) for x in dealt.values()], pa.string())})

    return run


def _lookups(characters: frozenset[str], taken):
    """The pieces of a bucket -> the keys of at most ``KEYED`` characters in them that words may begin with or be."""

    def run(table: pa.Table) -> pa.Table:
        able = np.zeros(0x110000, bool)
        able[[ord(c) for c in characters if not c.isspace()]] = True
        kept: set[str] = set()
        new: list[str] = []
        held = 0

        def check() -> None:
            text = " ".join(new)
            codes = _codes(text)
            for n, at, slots in _beginnings(codes, able[codes]):
                there = at[taken.value[slots >> 3] >> (slots & 7).astype(np.uint8) & 1 == 1]
                kept.update(text[i : i + n] for i in there.tolist())
            new.clear()

        for p in {p for x in table.column("pieces").to_pylist() for p in x.split(" ")}:
            new.append(p)
            held += len(p)
            if held > CHUNK:
                check()
                held = 0
        check()
        keys = pa.array(list(kept), pa.string())
        return pa.table({"bucket": pa.array(np.full(len(keys), table.column("bucket")[0].as_py()), pa.int32()), "key": keys})

    return run


def _cut(model: Segmenter, total: float):
    """The pieces of a bucket and the words in them -> for every batch that asked, a line for each piece that is not cut as
    ``WHOLE`` does: its words, joined by spaces."""

    def run(asked: pa.Table, words: pa.Table) -> pa.Table:
        able = _knowing(model, dict(zip(words.column("word").to_pylist(), words.column("freq").to_pylist(), strict=True)), total)
        done: dict[str, str | None] = {}
        out = []
        for x in asked.column("pieces").to_pylist():
            lines: list[str] = []
            for p in x.split(" "):
                if p not in done:
                    cut = able._cut_part(p)
                    done[p] = None if cut == WHOLE.findall(p) else " ".join(cut)
                if (line := done[p]) is not None:
                    lines.append(line)
            out.append("\n".join(lines))
        return pa.table({"batch": asked.column("batch"), "lines": pa.array(out, pa.string())})

    return run


def _spelt(signs: str):
    """The texts of a batch with their pieces' words, by the lines that ``_cut`` gave for it. ``signs`` at a piece's end, which no
    word has, stand alone and leave the way to them as it is."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        given: dict[str, list[str]] = {}
        for lines in answers.column("lines").to_pylist():
            for line in lines.split("\n") if lines else ():
                given[line.replace(" ", "")] = line.split(" ")
        number: dict[str, int] = {}
        order: list[int] = []
        ends = [0]
        for t in texts.column("text").to_pylist():
            order += [number.setdefault(p, len(number)) for p in t.split()]
            ends.append(len(order))
        words: list[str] = []
        begins = [0]
        for p in number:
            core = p.rstrip(signs)
            words += given[core] if core in given else WHOLE.findall(core)
            words += p[len(core) :]
            begins.append(len(words))
        at, begin = np.array(order, np.int64), np.array(begins, np.int64)
        upto = np.append(0, np.cumsum(np.diff(begin)[at]))
        taken = np.arange(upto[-1]) + np.repeat(begin[at] - upto[:-1], np.diff(upto))
        lists = pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), pa.array(words, pa.string()).take(pa.array(taken)))
        return pa.table({"doc_id": texts.column("doc_id"), "words": lists})

    return run


def segmented(docs: DataFrame, dictionary: DataFrame, batch: int = 16 << 20) -> DataFrame:
    """doc_id, words of every text: what ``learn(dictionary).cut`` gives, with a dictionary of any size.

    Texts are dealt once, in batches of about ``batch`` bytes. A batch sends its distinct pieces between white space to buckets, so
    that each piece of all texts is cut in one place, and gets back those that are cut otherwise than by ``WHOLE``. Signs at a piece's
    end that no word has aren't sent. A bucket asks for
    the words that begin with a text of its own of ``KEYED`` characters, or are a shorter one, by an equi-join. Keys that no word has
    are mostly left out before, by a bitmap of 16 MB; it, a row a character and the sums are all that the driver holds."""
    context = docs.sparkSession.sparkContext
    words = checkpointed(_summed(dictionary))
    model, total = _states(words)
    characters = frozenset(ch for s in model.shown for ch in s)
    signs = "".join(c for c in SIGNS if c not in characters)
    keyed = words.select(F.substring("word", 1, KEYED).alias("key"), "word", F.col("freq").cast("long").alias("freq"))
    taken = context.broadcast(_taken(keyed))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches, buckets = size // batch + 2, max(size // (4 * batch) + 1, context.defaultParallelism)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.pmod(F.xxhash64("doc_id", text), F.lit(batches)).cast("int").alias("batch")).repartitionById(batches, "batch")
    asks = texts.groupBy("batch").applyInArrow(_asks(buckets, signs), "bucket int, batch int, pieces string").repartitionById(buckets, "bucket")
    keys = asks.groupBy("bucket").applyInArrow(_lookups(characters, taken), "bucket int, key string")
    asked = keys.join(keyed, "key").select("bucket", "word", "freq").repartitionById(buckets, "bucket")
    answers = asks.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_cut(model, total), "batch int, lines string").repartitionById(batches, "batch")
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("words", T.ArrayType(T.StringType()))])
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_spelt(signs), kind)
