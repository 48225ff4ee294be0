"""Byte-level BPE encoding and decoding with DataFrame functions.

A regular expression cuts texts into words, each encoded alone. A word's bytes are folded: every
step finds the adjacent pair of pieces whose concatenation has the lowest rank (leftmost of equals)
and joins it, until no pair has a rank. The rank map is a literal: an array in which every pair
(left piece, right piece) has a slot of its own, so a lookup is two array reads and no scan.

Before the fold, one pass joins the byte pairs that the fold would join whatever else it does: those
whose rank is below that of every piece that could take their first byte from the left or their second
from the right, and below that of every piece made of theirs and one more. The fold's other
joins, and their order, stay what they were.

The distinct words of all texts are counted, and the most frequent ones, a bounded number, are folded
once each; with the vocabulary's own pieces they form a second literal, whose words are compared whole.
A word outside it is folded where it stands, with the same ids: sending ids of rare words back to their
documents would shuffle the documents too. Decoding joins the pieces' bytes.

Cases: a null or empty text has no ids; very long texts and words are encoded whole; repeated and
null doc_ids are encoded row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.llm.storage import materialize


def java_pattern(pattern: str) -> str:
    """``pattern`` with white space as Unicode defines it, which Java's ``\\s`` is not."""
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def spark_hash(data: bytes) -> int:
    """Spark's ``xxhash64`` of a binary or string value, or of a long's eight bytes."""
    h = xxhash.xxh64_intdigest(data, seed=42)
    return h - (1 << 64) if h >> 63 else h


def pair_slots(pairs: list[tuple[int, int]], pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Moves of left pieces and slots of pairs, ``moves[left] + right``: no two pairs share a slot.

    The left pieces with most pairs come first, each at the first place where its pairs find all slots free.
    """
    moves, slots = np.zeros(pieces, np.int64), np.zeros(len(pairs), np.int64)
    if not pairs:
        return moves, slots
    left, right = np.array(pairs, np.int64).T
    order = np.argsort(left, kind="stable")
    starts = np.flatnonzero(np.diff(left[order], prepend=-1))
    groups = sorted(np.split(order, starts[1:]), key=lambda g: -len(g))
    taken, end = np.zeros(len(pairs) + 2 * pieces, bool), 0
    for group in groups:
        rights = right[group]
        clash = np.zeros(end + 1, bool)  # at ``end`` all are free
        for r in rights:
            clash |= taken[r : r + end + 1]
        move = int(np.argmin(clash))
        moves[left[group]], slots[group] = move, move + rights
        taken[slots[group]] = True
        end = max(end, int(slots[group].max()) + 1)
        if len(taken) < end + pieces + 1:
            taken = np.concatenate([taken, np.zeros(len(taken), bool)])
    return moves, slots


class Literals:
    """Large arrays as literals of one plan. They are scalar subqueries of a local table, whose values Spark
    makes literals when it runs, so neither the plan nor its printed form holds them. Every use is a column
    of its own that is read once, so the optimizer puts it where it is used and no row carries it."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._arrays: dict[int, tuple[str, pa.Array]] = {}
        self._uses: list[tuple[str, str]] = []

    def use(self, values: pa.Array) -> Column:
        name, _ = self._arrays.setdefault(id(values), (f"a{len(self._arrays)}", values))
        self._uses.append((f"_bpe_literal{len(self._uses)}", name))
        return F.col(self._uses[-1][0])

    def attach(self, df: DataFrame) -> DataFrame:
        one = {name: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values) for name, values in self._arrays.values()}
        local = self._spark.createDataFrame(pa.table(one))
        return df.select("*", *[local.select(name).scalar().alias(alias) for alias, name in self._uses])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


BITS = 20  # of a piece's rank, which is its id
MASK = (1 << BITS) - 1
OWNER = 2 * BITS + 1  # where a slot of the pair table names its left piece
NONE = 1 << 62  # in an empty slot
LAST = 1 << BITS  # in place of the rank of a pair that has none
GONE = -1  # in place of a piece that another took in
SHORT = 48  # places up to which a pass over all of them is cheaper than slices


class Ranks:
    """The ranked pieces of a vocabulary, whose ranks are their ids, as columns."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        pairs = [(ranks[p[:i]], ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        self.edge = max(ranks.values(), default=0) + 1  # before the first and after the last piece: no piece, no pair
        moves, slots = pair_slots([(left, right) for left, right, _ in pairs], self.edge + 1)
        joined = np.full(slots.max(initial=-1) + 1, NONE)
        joined[slots] = [left << OWNER | r << BITS | left for left, _, r in pairs]
        self.moves, self.joined = pa.array(moves), pa.array(joined)
        self.of_byte = pa.array([ranks[bytes([b])] for b in range(256)], pa.int64())
        self.of_two = pa.array(self._two_bytes(), pa.int64())
        texts = [""] * (max(ranks.values(), default=0) + 1)
        for p, r in ranks.items():
            texts[r] = p.decode("iso-8859-1")
        self.texts = pa.array(texts, pa.string())

    def _two_bytes(self) -> list[int]:
        """For every two bytes, in fields of ``BITS``: their rank if it is below that of all pieces made of theirs and
        one more, the least rank of a piece of which the second byte is the right part and the first ends the
        left part, and of a piece of which the first is the left part and the second begins the right part."""
        own, right, left, later = ([MASK] * (1 << 16) for _ in range(4))
        at = lambda two: two[0] << 8 | two[1]
        for p, r in self.ranks.items():
            for a, b in ((p[:i], p[i:]) for i in range(1, len(p))):
                if a not in self.ranks or b not in self.ranks:
                    continue
                if len(b) == 1:
                    right[at(a[-1:] + b)] = min(right[at(a[-1:] + b)], r)
                if len(a) == 1:
                    left[at(a + b[:1])] = min(left[at(a + b[:1])], r)
                for part in (a, b):
                    if len(part) == 2:
                        later[at(part)] = min(later[at(part)], r)
            if len(p) == 2:
                own[at(p)] = r
        return [(o if o < x else MASK) << 2 * BITS | r << BITS | l for o, x, r, l in zip(own, later, right, left, strict=True)]

    def _places(self, word: Column, literals: Literals) -> Column:
        """The fold's first state without its edges: the sure joins of bytes are done."""

        def pieces(codes: Column, two: Column) -> Column:
            # a pair's rank above the mask stands for its first byte, and the next byte goes
            from_left = lambda i: F.coalesce(F.shiftright(F.get(two, i - 1), BITS).bitwiseAND(F.lit(MASK)), F.lit(MASK))
            from_right = lambda i: F.get(two, i + 1).bitwiseAND(F.lit(MASK))
            own = lambda x: F.shiftright(x, 2 * BITS)
            sure = lambda x, i: (x < MASK << 2 * BITS) & (own(x) < from_right(i)) & (own(x) < from_left(i))
            byte = lambda i: F.get(literals.use(self.of_byte), F.get(codes, i))
            joined = F.transform(two, lambda x, i: F.when(sure(x, i), own(x).bitwiseOR(F.lit(LAST))).otherwise(byte(i)))
            left = _let(joined, lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) < LAST)))
            return F.transform(left, lambda x: x.bitwiseAND(F.lit(MASK)))

        # the end has neither a rank nor a bound
        none = MASK << 2 * BITS | MASK << BITS | MASK
        two = lambda p: F.transform(p, lambda c, i: F.coalesce(F.get(literals.use(self.of_two), c * 256 + F.get(p, i + 1)), F.lit(none)))
        codes = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.ascii(c))
        joined = _let(codes, lambda p: _let(two(p), lambda t: pieces(p, t)))
        return _let(joined, lambda p: F.transform(p, lambda x, i: self._place(x, F.coalesce(F.get(p, i + 1), F.lit(self.edge)), literals)))

    def _place(self, left: Column, right: Column, literals: Literals) -> Column:
        """The rank of a pair, or ``LAST``, above its left piece."""
        slot = F.get(literals.use(self.moves), left) + right
        # a slot's owner cancels where it is the left piece, and else makes the value too large; no slot is null
        found = F.get(literals.use(self.joined), slot).bitwiseXOR(F.shiftleft(left, OWNER))
        return F.least(found, left.bitwiseOR(F.lit(LAST << BITS)))

    def fold(self, word: Column, literals: Literals) -> Column:
        """Ids of one word (string). The state has a place a piece, with an edge at both ends: the rank of
        the piece with the next one above its own id, so the least place is the pair to join next."""
        edge = F.array(F.lit(LAST << BITS | self.edge))
        first = F.concat(edge, self._places(word, literals), edge)

        made = lambda x: F.shiftright(x, BITS)
        piece = lambda x: x.bitwiseAND(F.lit(MASK))

        def join(s: Column, at: Column) -> Column:
            before = lambda x: self._place(piece(x), made(F.get(s, at - 1)), literals)
            joined = lambda x: self._place(made(x), piece(F.get(s, at + 1)), literals)
            new = lambda x, i: F.when(i == at, F.lit(GONE)).when(i == at - 1, joined(x)).otherwise(before(x))
            passed = F.array_remove(F.transform(s, lambda x, i: F.when(i > at, x).when(i < at - 2, x).otherwise(new(x, i))), F.lit(GONE))
            both = F.array(before(F.get(s, at - 2)), joined(F.get(s, at - 1)))
            sliced = F.concat(F.slice(s, F.lit(1), at - 2), both, F.slice(s, at + 2, F.size(s)))
            return F.when(F.size(s) > SHORT, sliced).otherwise(passed)

        def step(s: Column, _: Column) -> Column:
            joined = lambda least: _let(F.array_position(s, least).cast("int"), lambda at: join(s, at))
            return _let(F.array_min(s), lambda least: F.when(least >= LAST << BITS, s).otherwise(joined(least)))

        ids = lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: piece(x).cast("int"))
        return _let(first, lambda s: F.aggregate(F.sequence(F.lit(1), F.size(s) - 2), s, step, ids))

    def words(self) -> dict[str, int]:
        """The pieces that are text: a word equal to one has its rank as its only id."""
        out = {}
        for p, r in self.ranks.items():
            try:
                out[p.decode()] = r
            except UnicodeDecodeError:
                continue
        return out

    def decode(self, ids: Column, literals: Literals) -> Column:
        """The bytes of ``ids``: their pieces, joined as text of one character a byte."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(literals.use(self.texts), i)), ""), "ISO-8859-1")


@functools.lru_cache(maxsize=4)
def ranks_of(path: str) -> Ranks:
    return Ranks(read_ranks(path))


class Dictionary:
    """Ids of known words as columns. Each word has the slot of its hash in a table; of words with one slot the
    first stays and the others go to a next, smaller table. A word is compared whole, so a hit is exact,
    and a word without a slot is folded where it stands."""

    def __init__(self, words: pa.StringArray, ids: pa.ListArray) -> None:
        hashes = np.array([spark_hash(w.as_py().encode()) for w in words], np.int64)
        left = np.arange(len(words))
        self.tables: list[tuple[int, pa.Array, pa.Array]] = []
        for shift in (0, 20, 40):
            size = 1 << max(3, (2 * len(left) - 1).bit_length() - 1)
            slots, first = np.unique(hashes[left] >> shift & (size - 1), return_index=True)
            held = np.full(size, -1)
            held[slots] = left[first]
            take = pa.array(held, mask=held < 0)
            self.tables.append((shift, words.take(take), ids.take(take)))
            left = np.delete(left, first)

    def find(self, word: Column, literals: Literals, otherwise: Column) -> Column:
        for shift, words, ids in reversed(self.tables):
            h = F.shiftright(F.xxhash64(word), shift) if shift else F.xxhash64(word)
            slot = h.bitwiseAND(F.lit(len(words) - 1)).cast("int")
            otherwise = F.when(F.get(literals.use(words), slot) == word, F.get(literals.use(ids), slot)).otherwise(otherwise)
        return otherwise


def frequent_words(words: DataFrame, most: int, longest: int) -> DataFrame:
    """word, level: values of the column ``word`` that occur at least twice, the most frequent ones, ``most`` at most, of
    ``longest`` bytes at most. Counts are exact; where they end comes from a histogram of few rows."""
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= longest))
    counts = materialize(counts.select("word", F.floor(4 * F.log2("n")).alias("level")))
    levels = counts.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    room, least = most, None
    for row in levels:
        room -= row["words"]
        if room < 0:
            break
        least = row["level"]
    return counts.where(F.col("level") >= least if least is not None else F.lit(False))


def known_words(docs_words: DataFrame, ranks: Ranks, most: int, longest: int) -> Dictionary:
    """The vocabulary's own pieces and the frequent values of the column ``word``, folded once each."""
    spark = docs_words.sparkSession
    pieces = ranks.words()
    words, ids = pa.array(list(pieces), pa.string()), pa.array([[r] for r in pieces.values()], pa.list_(pa.int32()))
    if most:
        literals = Literals(spark)
        fold = ranks.fold(F.col("word"), literals)
        often = frequent_words(docs_words, most, longest).repartition(spark.sparkContext.defaultParallelism)
        table = literals.attach(often).select("word", "level", fold.alias("ids")).toArrow().sort_by([("level", "descending")])
        table = table.filter(pc.invert(pc.is_in(table.column("word"), words)))
        words = pa.concat_arrays([words, *table.column("word").cast(pa.string()).chunks])
        ids = pa.concat_arrays([ids, *table.column("ids").cast(ids.type).chunks])
    return Dictionary(words, ids)


def encode(docs: DataFrame, rank_path: str, pattern: str, dictionary: int = 1 << 18, longest: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row of ``docs``.

    ``dictionary`` words of ``longest`` bytes at most are folded once and go to all tasks.
    """
    ranks = ranks_of(rank_path)
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    known = known_words(docs.select(F.explode(words).alias("word")), ranks, dictionary, longest)
    literals = Literals(docs.sparkSession)
    # the words are read once, else they and the literals would stay columns below the fold
    ids = F.flatten(F.transform("words", lambda w: known.find(w, literals, ranks.fold(w, literals))))
    return literals.attach(docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))).select("doc_id", ids.alias("ids"))


def decode(encoded: DataFrame, rank_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary)."""
    literals = Literals(encoded.sparkSession)
    decoded = ranks_of(rank_path).decode(F.col(ids_col), literals)
    return literals.attach(encoded).select(*encoded.columns, decoded.alias("decoded"))
