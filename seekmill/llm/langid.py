"""Language identification by interpolated Kneser-Ney character models.

One model of ``ORDER`` characters a language. Texts become lower-case letters with single blanks
between runs of them; each character is predicted from the three before it. The n-grams of all
languages share sorted arrays of hashes with a row of log probabilities (one column a language), so
one lookup serves all models; contexts have a row of interpolation weights. The language with the
lowest cross-entropy a character wins, of equal ones the first by name.

Learning uses a bounded sample: per language the ``per_language`` labelled rows of lowest hash,
those of at most ``long`` characters first; a fifth of them is set aside to calibrate. Calibration
picks the sharpness of the score (softmax of the negative cross-entropies) and, per language, the
cross-entropy above which a text is rejected: the median of other languages' texts under that model, so
a rejected text fits its best language no better than a foreign text does, and never below the worst
genuine text with a tenth added. Short texts get ``SLACK / sqrt(characters)`` more, three standard errors.

Cases: a null text or one without letters gets ``und``, score 0 and is rejected; without labelled
rows every text is ``und`` but those with letters are not rejected; rows with null language or id teach nothing; rows that repeat in full teach once and are each
answered; whole texts are read in segments, so long ones need no more memory; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekmill.llm.storage import materialize

ORDER = 4
SEGMENT = 1 << 20
BLANK = 32
MIX = np.uint64(0x9E3779B97F4A7C15)
FLOOR = 1.5
SLACK = 9.0


def _letters() -> np.ndarray:
    """For each code point below 2**16: itself if it is a letter, else a blank."""
    return np.array([c if chr(c).isalpha() else BLANK for c in range(1 << 16)], np.uint16)


_TABLE: list[np.ndarray] = []


def folded(point: int) -> int:
    """The 16-bit code of a letter beyond U+FFFF: its low bits, where these are no letter's place of a blank or zero."""
    low = point & 0xFFFF
    return 1 if low in (0, BLANK) else low


def codes(text: str, last: int = BLANK) -> np.ndarray:
    """Letters and single blanks of ``text`` as 16-bit codes; ``last`` is the code before it."""
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if points.size and points.max() > 0xFFFF:
        low = np.array([c if c <= 0xFFFF else folded(c) if chr(c).isalpha() else BLANK for c in points.tolist()], np.uint32)
        out = np.where(points > 0xFFFF, low, _TABLE[0][np.minimum(points, 0xFFFF)]).astype(np.uint16)
    else:
        out = _TABLE[0][points]
    blank = out == BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    if out.size:
        keep[0] = keep[0] or last != BLANK
    return out[keep]


def grams(text: str) -> Iterator[np.ndarray]:
    """Packed ``ORDER``-grams of a whole text, the last character lowest, in segments."""
    before = np.full(ORDER - 1, BLANK, np.uint16)
    for at in range(0, len(text) + 1, SEGMENT):
        c = codes(text[at : at + SEGMENT], int(before[-1]))
        if at + SEGMENT > len(text) and (c[-1] if c.size else before[-1]) != BLANK:
            c = np.append(c, np.uint16(BLANK))
        if not c.size:
            continue
        full = np.concatenate([before, c]).astype(np.uint64)
        key = full[3:] | full[2:-1] << np.uint64(16) | full[1:-2] << np.uint64(32) | full[:-3] << np.uint64(48)
        before = full[-3:].astype(np.uint16)
        yield key


@dataclass
class HashArray:
    """Sorted hashes of keys with a row of values each, and a directory by leading bits."""

    hashes: np.ndarray
    values: np.ndarray
    first: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> HashArray:
        h = keys * MIX
        order = np.argsort(h)
        h = h[order]
        bits = max(4, int(len(h) * 2).bit_length())
        shift = np.uint64(64 - bits)
        first = np.searchsorted(h >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return cls(h, values[order], first, shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if absent."""
        h = keys * MIX
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -1, np.int32)
        left = np.flatnonzero(at < end)
        at, end, h = at[left], end[left], h[left]
        while left.size:
            hit = self.hashes[at] == h
            out[left[hit]] = at[hit]
            go = ~hit
            go[go] = at[go] + 1 < end[go]
            left, at, end, h = left[go], at[go] + 1, end[go], h[go]
        return out


@dataclass
class Model:
    languages: list[str]
    probs: list[HashArray]  # by order - 1: log2 probabilities
    weights: list[HashArray]  # by context length - 1: log2 interpolation weights
    uniform: np.ndarray
    sharpness: float = 8.0
    limits: np.ndarray | None = None

    def entropy(self, text: str | None) -> np.ndarray | None:
        """Bits a character under each language; None without letters."""
        return self.measure(text)[0]

    def measure(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """The entropies and how many characters they are of."""
        total, n, letters = np.zeros(len(self.languages)), 0, False
        for key in grams(text or ""):
            letters = letters or bool(((key & np.uint64(0xFFFF)) != BLANK).any())
            total += self._bits(key, ORDER) if self.languages else 0
            n += len(key)
        return (total / n if letters else None), n

    def _bits(self, key: np.ndarray, order: int) -> np.ndarray:
        if not order:
            return -self.uniform * len(key)
        row = self.probs[order - 1].find(key)
        seen = row >= 0
        total = -self.probs[order - 1].values[row[seen]].sum(axis=0, dtype=np.float64)
        if not seen.all():
            rest = key[~seen]
            if order > 1:
                context = self.weights[order - 2].find(rest >> np.uint64(16))
                total -= self.weights[order - 2].values[context[context >= 0]].sum(axis=0, dtype=np.float64)
            total += self._bits(rest & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        return total

    def decide(self, bits: np.ndarray | None, n: int) -> tuple[str, float, float | None, bool]:
        """(language, score, cross-entropy, rejected) of a text with these entropies over ``n`` characters."""
        if bits is None or not self.languages:
            return "und", 0.0, None, bits is None
        best = int(bits.argmin())
        score = 1 / np.exp2(-self.sharpness * (bits - bits[best])).sum()
        rejected = self.limits is not None and bits[best] > self.limits[best] + SLACK / np.sqrt(n)
        return self.languages[best], float(score), float(bits[best]), bool(rejected)


def fit(languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Kneser-Ney models from each language's distinct ``ORDER``-grams and their counts."""
    n_lang = len(languages)
    # per language and order: keys and counts; below the top, counts of distinct left extensions
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
    for lang in languages:
        keys, n = counts[lang]
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        for k in range(ORDER, 0, -1):
            tables[k].append((keys, n))
            keys, n = np.unique(keys & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
    size = len(np.unique(np.concatenate([t[0] for t in tables[1]]))) + 1
    uniform = np.full(n_lang, 1 / size)
    probs, weights = [], []
    lower_keys, lower = np.zeros(1, np.uint64), np.tile(uniform, (1, 1))
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([t[0] for t in tables[k]]))
        value, contexts = np.zeros((len(union), n_lang)), np.unique(union >> np.uint64(16))
        weight = np.ones((len(contexts), n_lang))
        base = lower[np.searchsorted(lower_keys, union & np.uint64((1 << 16 * (k - 1)) - 1))] if k > 1 else np.tile(uniform, (len(union), 1))
        in_context = np.searchsorted(contexts, union >> np.uint64(16))
        for i, (keys, n) in enumerate(tables[k]):
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
            at = np.searchsorted(union, keys)
            context = in_context[at]
            total = np.bincount(context, n, len(contexts))
            kinds = np.bincount(context, minlength=len(contexts))
            known = total > 0
            weight[known, i] = discount * kinds[known] / total[known]
            value[at, i] = (n - discount) / total[context]
            value[:, i] += weight[in_context, i] * base[:, i]
        probs.append(HashArray.of(union, np.log2(value).astype(np.float32)))
        weights.append(HashArray.of(contexts, np.log2(weight).astype(np.float32)))
        lower_keys, lower = union, value
    # a new character: what the first order leaves to the uniform distribution
    return Model(languages, probs, weights[1:], np.log2(uniform) + np.log2(np.maximum(weight_of_none(tables[1]), 1e-9)))


def weight_of_none(first: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = []
    for _, n in first:
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        out.append(discount * len(n) / n.sum())
    return np.array(out)


def calibrate(model: Model, truth: list[int], bits: np.ndarray) -> Model:
    """Sets the sharpness and the limits from held-back texts: their language and entropies."""
    n_lang = len(model.languages)
    model.limits = np.full(n_lang, np.inf)
    if not truth:
        return model
    y = np.array(truth)

    def loss(s: float) -> float:
        z = -s * (bits - bits.min(axis=1, keepdims=True))
        return float((np.log2(np.exp2(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    model.sharpness = min((1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=loss)
    for i in range(n_lang):
        own, other = bits[y == i, i], bits[y != i, i]
        if own.size:
            worst = own.max()
            model.limits[i] = max(worst * 1.1, float(np.median(other)) if other.size else worst * FLOOR)
    return model


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).extend(grams(text))
    for lang, parts in held.items():
        if parts:
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _sample(rows: DataFrame, per_language: int, long: int) -> DataFrame:
    """lang, text, aside: the ``per_language`` distinct rows a language of lowest draw, shorter texts first.

    Rows are thinned to about four times that many a language before any are ranked, by approximate
    counts that tasks make where they read, so a language that most rows have sends few rows to its task."""
    rows = rows.withColumns({"hash": F.xxhash64("text"), "long": F.length("text") > long})
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "hash", F.lit("language sample")))
    counts = rows.groupBy("lang").agg(*[F.approx_count_distinct(F.when(F.col("long") == x, F.col("draw"))).alias(n) for x, n in ((False, "short"), (True, "longer"))])
    share = lambda n: F.lit(4.0 * per_language) / F.greatest(F.col(n), F.lit(1))
    shares = counts.select("lang", share("short").alias("short"), F.when(F.col("short") < 2 * per_language, share("longer")).otherwise(0.0).alias("longer"))
    thin = rows.join(F.broadcast(shares), "lang").where(F.pmod("draw", F.lit(1 << 31)) < F.when(F.col("long"), F.col("longer")).otherwise(F.col("short")) * (1 << 31))
    once = thin.dropDuplicates(["doc_id", "lang", "hash"])
    best = Window.partitionBy("lang").orderBy("long", "draw", "doc_id", "hash")
    ranked = once.withColumn("k", F.row_number().over(best)).where(F.col("k") <= per_language)
    return ranked.select("lang", "text", (F.col("k") % 5 == 0).alias("aside"))


def train(docs: DataFrame, per_language: int = 500, long: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A calibrated model from the labelled rows of ``docs``; callers hold out rows by a filter.

    The sample has ``per_language`` distinct rows a language at most, texts of up to ``long`` characters
    first, which bounds what the driver gets (the sample's distinct character n-grams).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sample = materialize(_sample(rows, per_language, long))
    table = sample.where(~F.col("aside")).select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(table.column("lang").to_pylist(), dtype=object)
    keys, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    languages = sorted(set(names.tolist()))
    if not languages:
        return Model([], [], [], np.zeros(0))
    model = fit(languages, {x: (keys[names == x], n[names == x]) for x in languages})
    shared = spark.sparkContext.broadcast(model)
    index = {x: i for i, x in enumerate(languages)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, shared.value.entropy(text)) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            found = [(lang, bits.tolist()) for lang, bits in found if bits is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([b for _, b in found], pa.list_(pa.float64()))], names=["lang", "bits"])

    held = sample.where(F.col("aside")).select("lang", "text").mapInArrow(score, "lang string, bits array<double>").toArrow().to_pylist()
    held = [x for x in held if x["lang"] in index]
    return calibrate(model, [index[x["lang"]] for x in held], np.array([x["bits"] for x in held]))


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Columns ``carry`` of ``docs`` plus lang_pred, score, bits_per_char and rejected, their names
    after ``prefix``. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [prefix + x for x in ("lang_pred", "score", "bits_per_char", "rejected")]
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], *([] if text_col in carry else [F.col(text_col)]))
    at, kept = rows.columns.index(text_col), len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [m.decide(*m.measure(t.as_py())) for t in batch.column(at)]
            lang, score, bits, rejected = zip(*out, strict=True) if out else ((), (), (), ())
            found = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *found], names=[*carry, *new])

    schema = rows.select(*[F.col(f"`{c}`") for c in carry]).schema
    for name, kind in zip(new, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def drop_unrecognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that identification rejects; columns as they were."""
    prefix = "lm_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    found = identify(docs, model, text_col, tuple(docs.columns), prefix)
    return found.where(~F.col(f"{prefix}rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])
