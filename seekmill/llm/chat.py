"""Chat formatting by incremental black-box rendering, with a loss mask.

A template is any function from a list of ``{"role", "text"}`` to a string; nothing of it is parsed.
The prefixes of a conversation are rendered one after the other: where a rendering begins with the one
before it, what it adds is the turn's span; where it does not, the template rewrites history, which
``rewrites_at`` reports. A turn's own text is located by rendering its prefix twice more, with two
one-letter texts instead: what both share before and after the letter is the turn's frame. A turn whose
text is not shown exactly once between the two has no text span.

Conversations are cut into blocks of ``block`` turns, so prefixes stay short and no task holds a whole
conversation. A first block is rendered from its first turn on; a later one from the ``context`` turns
before it, which may set how its turns are rendered. A block's last turn is rendered once more after
``context`` turns alone, and ``looks_back`` reports a template for which that differs. The result is a
row a block: pieces that joined in order are the conversation.

Turns meet by conversation and are streamed in order. Conversations of more than one in ``HOT_SHARE`` of
all turns (and of several blocks) are fewer than ``HOT_SHARE``; these are broadcast, their turns are
numbered by range partitions and dealt by block. Reading back streams pieces in order and keeps two
digests only.

Cases: turns of equal number are ordered by role, then by a hash of the text, then by text; repeated rows
are turns of their own; a null turn comes first; null roles and texts count as empty; rows with a null
conv_id are one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekmill.llm.storage import materialize

Template = Callable[[list[dict[str, str]]], str]

BLOCK, CONTEXT, HOT_SHARE = 64, 8, 10_000
PIECES = "conv_id long, block long, formatted string, spans array<struct<start: int, end: int, text_start: int, text_end: int, trained: boolean>>, rewrites_at long, looks_back boolean"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("trained", pa.bool_())])
_PIECE = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(_SPAN)), ("rewrites_at", pa.int64()), ("looks_back", pa.bool_())])

#: The control strings of the template below.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
_ESCAPE = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_TURN = re.compile(r"<<SYS>>\n(.*?)\n<</SYS>>\n\n|\[INST\] (.*?) \[/INST\]|\[ROLE\](.*?)\[/ROLE\](.*?)</s>| (.*?) </s>", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left: a backslash parts its first character from the rest, and is doubled itself."""
    if "\\" not in text and "<" not in text and "[" not in text:
        return text
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def inst_template(messages: list[dict[str, str]]) -> str:
    """``[INST]`` around a user's text, ``</s>`` after an assistant's, ``<<SYS>>`` around a system's, and any other role by its name."""
    frames = {"system": "<<SYS>>\n{}\n<</SYS>>\n\n", "user": "[INST] {} [/INST]", "assistant": " {} </s>"}
    out = ["<s>"]
    for m in messages:
        text = escape(m["text"])
        out.append(frames[m["role"]].format(text) if m["role"] in frames else f"[ROLE]{escape(m['role'])}[/ROLE]{text}</s>")
    return "".join(out)


def inst_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a piece that ``inst_template`` wrote."""
    out, at = [], 3 if formatted.startswith("<s>") else 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        system, user, role, other, assistant = m.groups()
        found = ("system", system) if system is not None else ("user", user) if user is not None else ("assistant", assistant) if assistant is not None else (unescape(role), other)
        out.append((found[0], unescape(found[1])))
        at = m.end()
    return out


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving, so strings are compared whole."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def frame(template: Template, before: list[dict], turn: dict) -> tuple[int, int] | None:
    """Lengths of what stands before and after the text of ``turn`` where it is the last one; None where it is not shown once."""
    a, b = (template([*before, {**turn, "text": letter}]) for letter in "AB")
    head = _common(a, b)
    return (head, len(a) - head - 1) if len(a) == len(b) and a[head : head + 1] == "A" and a[head + 1 :] == b[head + 1 :] else None


def spans(template: Template, turns: list[dict], trained: frozenset[str], shown: int = 0) -> tuple[str, list[dict], int | None]:
    """(what the turns from ``shown`` on add, their spans in it, the first turn that changes what was rendered before it).

    The spans of a template that rewrites history end at that turn; the string is then what the last rendering adds.
    """
    last = template(turns[:shown]) if shown else ""
    base, out = len(last), []
    for i in range(shown, len(turns)):
        now = template(turns[: i + 1])
        if not now.startswith(last):
            return template(turns)[base:], out, i
        span = {"start": len(last) - base, "end": len(now) - base, "text_start": None, "text_end": None, "trained": turns[i]["role"] in trained}
        head, tail = frame(template, turns[:i], turns[i]) or (-1, 0)
        if len(last) <= head <= len(now) - tail:
            span |= {"text_start": head - base, "text_end": len(now) - tail - base}
        out.append(span)
        last = now
    return last[base:], out, None


def _looks_back(template: Template, turns: list[dict], context: int) -> bool:
    """Whether the last turn is rendered in another way after its ``context`` turns than after all."""
    near = turns[-context - 1 :]
    if len(near) == len(turns):
        return False
    return template(turns)[len(template(turns[:-1])) :] != template(near)[len(template(near[:-1])) :]


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


def _cut(rows: Iterator[dict], block: int, context: int) -> Iterator[tuple[int | None, int, int, int, list[dict]]]:
    """(conv_id, block, its first turn's number, how many of the turns are context, turns) of turns in order."""
    for conv, turns in groupby(rows, key=lambda r: r["conv_id"]):
        number, group, before = 0, [], 0
        for r in turns:
            if len(group) - before == block:
                yield conv, number // block, number, before, group
                number += block
                group = group[-context:] if context else []
                before = len(group)
            group.append(r)
        yield conv, number // block, number, before, group


def _dealt(rows: Iterator[dict], block: int) -> Iterator[tuple[int | None, int, int, int, list[dict]]]:
    """The same of turns that came with their blocks."""
    for (conv, k), turns in groupby(rows, key=lambda r: (r["conv_id"], r["block"])):
        group = list(turns)
        before = sum(r["before"] for r in group)
        if before < len(group):  # else the context of a block that does not exist
            yield conv, k, k * block, before, group


def _render(template: Template, trained: frozenset[str], block: int, context: int, dealt: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        rows = _rows(batches)
        for conv, k, first, before, group in _dealt(rows, block) if dealt else _cut(rows, block, context):
            turns = [{"role": r["role"], "text": r["text"]} for r in group]
            formatted, found, rewritten = spans(template, turns, trained, before)
            at = None if rewritten is None else first + rewritten - before
            out.append([conv, k, formatted, found, at, _looks_back(template, turns, context)])
            size += len(formatted) + 100
            if size > 4 << 20:
                yield _batch(out, _PIECE)
                out, size = [], 0
        if out:
            yield _batch(out, _PIECE)

    return run


def _turns(turns: DataFrame) -> DataFrame:
    text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_hot(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """(turns of ordinary conversations, turns of hot ones): hot are those of several blocks and more than one in ``HOT_SHARE`` of all turns."""
    rows = _turns(turns)
    counts = materialize(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > block))
    total = rows.count()
    hot = counts.where(F.col("n") > total / HOT_SHARE).select(F.col("conv_id").alias("_hot"))
    if not hot.limit(1).count():
        return rows, None
    meets = F.col("conv_id").eqNullSafe(F.col("_hot"))
    return rows.join(F.broadcast(hot), meets, "left_anti"), rows.join(F.broadcast(hot), meets, "left_semi")


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, number (from 0 in its conversation), role, text. A conversation may span range partitions: each has two such
    at most, so the counts before them that are broadcast are bounded by twice the partitions."""
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())  # which parts equal rows
    order = ["turn", "role", "hash", "tie"]
    rows = materialize(rows.repartitionByRange(_parts(rows), "conv_id", *order).withColumn("part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    several = counts.groupBy("conv_id").agg(F.count("*").alias("c")).where(F.col("c") > 1).select(F.col("conv_id").alias("_c"))
    spanning = counts.join(F.broadcast(several), F.col("conv_id").eqNullSafe(F.col("_c")))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spanning.select("_c", F.col("part").alias("_p"), before.alias("offset"))
    rows = rows.withColumn("local", local)
    rows = rows.join(F.broadcast(offsets), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left")
    return rows.select("conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).cast("long").alias("number"), "role", "text")


def format_ordinary(rows: DataFrame, template: Template = inst_template, trained: tuple[str, ...] = ("assistant",), block: int = BLOCK, context: int = CONTEXT) -> DataFrame:
    """Pieces of conversations that a task each may stream; a conversation's pieces follow each other in one partition."""
    met = rows.withColumn("hash", F.xxhash64("text")).repartition(_parts(rows), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "hash", "text")
    return met.select("conv_id", "role", "text").mapInArrow(_render(template, frozenset(trained), block, context, False), PIECES)


def format_hot(rows: DataFrame, template: Template = inst_template, trained: tuple[str, ...] = ("assistant",), block: int = BLOCK, context: int = CONTEXT) -> DataFrame:
    """Pieces of conversations that are dealt by block: a block's last turns go along with the next one too."""
    if not 0 <= context <= block:
        raise ValueError("context is a block at most")
    own = F.floor(F.col("number") / block)
    later = F.when(F.col("number") % block >= block - context, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = numbered(rows).withColumn("before", F.explode(later)).withColumn("block", (own + F.col("before")).cast("long"))
    met = dealt.repartition(_parts(rows), "conv_id", "block").sortWithinPartitions("conv_id", "block", "number")
    return met.select("conv_id", "block", "before", "role", "text").mapInArrow(_render(template, frozenset(trained), block, context, True), PIECES)


def format_chats(turns: DataFrame, template: Template = inst_template, trained: tuple[str, ...] = ("assistant",), block: int = BLOCK, context: int = CONTEXT) -> DataFrame:
    """A row a block of a conversation: conv_id, block, formatted, spans (of its turns and their texts in ``formatted``, in
    code points; ``trained`` marks the loss), rewrites_at (the number of the turn that rewrites history, or null), looks_back."""
    ordinary, hot = split_hot(turns, block)
    out = format_ordinary(ordinary, template, trained, block, context)
    return out if hot is None else out.unionByName(format_hot(hot, template, trained, block, context))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _read(parse: Callable[[str], list[tuple[str, str]]], plain: Callable[[str], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        for conv, pieces in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            n, chars, loss_chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for row in pieces:
                formatted = row["formatted"]
                for role, text in parse(formatted):
                    n += 1
                    turns.update(_utf8(f"{role}\n{text}\n"))
                for s in row["spans"]:
                    if s["trained"] and s["text_start"] is not None:
                        text = plain(formatted[s["text_start"] : s["text_end"]])
                        loss_chars += len(text)
                        loss.update(_utf8(text))
                chars += len(formatted)
            out.append([conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars])
            if len(out) >= 4096:
                yield _batch(out, _READ)
                out = []
        if out:
            yield _batch(out, _READ)

    return run


def read_back(pieces: DataFrame, parse: Callable[[str], list[tuple[str, str]]] = inst_turns, plain: Callable[[str], str] = unescape, in_order: bool = False) -> DataFrame:
    """One row a conversation, all from ``formatted`` and ``spans``: conv_id, n_turns, turns_sha256 (role, newline, text,
    newline a turn), loss_chars and loss_sha256 (the texts under the loss mask, unescaped), formatted_chars. ``in_order``:
    each conversation's pieces follow each other in one partition, as ``format_ordinary`` leaves them, so none moves."""
    if not in_order:
        pieces = pieces.select("conv_id", "block", "formatted", "spans").repartition(_parts(pieces), "conv_id").sortWithinPartitions("conv_id", "block")
    return pieces.select("conv_id", "formatted", "spans").mapInArrow(_read(parse, plain), READ)


def format_and_read(turns: DataFrame, block: int = BLOCK, context: int = CONTEXT) -> DataFrame:
    """``read_back`` of ``format_chats`` with its own template; only the pieces of hot conversations move."""
    ordinary, hot = split_hot(turns, block)
    out = read_back(format_ordinary(ordinary, block=block, context=context), in_order=True)
    return out if hot is None else out.unionByName(read_back(format_hot(hot, block=block, context=context)))
