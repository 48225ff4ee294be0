"""Snippets around the first keyword, counted in UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekmill.functions.text import keyword_position

#: Where a snippet without a match may end, and where sentences end.
SOFT_ENDS = tuple(x.encode() for x in ("。", "，", "！", "？", ",", ".", "!", "?", " "))
SENTENCE_ENDS = tuple(x.encode() for x in ("。", "！", "？", "\n", ". ", "! ", "? "))


def _boundary(data: bytes, at: int, step: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return at


def snippet(content: str | None, keywords: list[str], size: int = 300) -> str:
    """Up to ``size`` bytes of ``content``: its start, or a window about the first keyword, cut at
    sentence ends where one is near. A delimiter at the end is kept whole."""
    data = (content or "").encode()
    if len(data) <= size:
        return content or ""
    low = data.lower()
    found = [p for p in (low.find(k.encode().lower()) for k in keywords if k) if p >= 0]
    if not found:
        cut = _boundary(data, size, -1)
        last = max(data[:cut].rfind(d) for d in SOFT_ENDS)
        return data[: last if last > cut * 2 // 3 else cut].decode() + "..."
    start = _boundary(data, max(0, min(found) - size // 3), -1)
    end = min(len(data), _boundary(data, min(len(data), start + size), 1))
    part = data[start:end]
    if start:
        ends = [(p, len(d)) for d in SENTENCE_ENDS if (p := part.find(d)) >= 0]
        if ends and min(ends)[0] < len(part) // 4:
            p, n = min(ends)
            part = part[p + n :]
    if end < len(data):
        p, n = max((part.rfind(d), len(d)) for d in SENTENCE_ENDS)
        if p > len(part) * 2 // 3:
            part = part[: p + n]
    return ("..." if start else "") + part.decode() + ("..." if end < len(data) else "") if part else ""


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _part(data: Column, start: Column, end: Column) -> Column:
    """The text of bytes ``start`` to ``end`` of a binary."""
    return F.substring(data, start + 1, end - start).cast("string")


def _whole(data: Column, at: Column, step: int) -> Column:
    """``at``, moved out of a character by at most the three bytes that follow its first."""
    byte = lambda x: F.conv(F.hex(F.substring(data, x + 1, F.lit(1))), 16, 10).cast("int")
    stands = lambda x: (x <= 0) | (x >= F.octet_length(data)) | (byte(x).bitwiseAND(F.lit(0xC0)) != 0x80)
    return F.when(stands(at), at).when(stands(at + step), at + step).when(stands(at + 2 * step), at + 2 * step).otherwise(at + 3 * step)


def _first(text: Column, mark: bytes) -> Column:
    """The byte at which ``mark`` first stands in a text; null if nowhere."""
    at = F.position(F.lit(mark.decode()), text)
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)))


def _last(text: Column, mark: bytes) -> Column:
    """The byte at which ``mark`` last stands in a text; -1 if nowhere."""
    back = F.reverse(text)
    at = F.position(F.lit(mark.decode()[::-1]), back)
    return F.when(at > 0, F.octet_length(text) - F.octet_length(F.substring(back, F.lit(1), at - 1)) - len(mark)).otherwise(-1)


def snippet_column(content: Column, keywords: list[str], size: int = 300) -> Column:
    """``snippet`` as an expression: windows of bytes of a binary, whose texts are searched for the marks."""
    asked = [k for k in keywords if k]
    found = F.array_min(F.array(*[keyword_position(content, F.lit(k)) for k in asked])) if asked else F.lit(None).cast("int")
    data, length = content.cast("binary"), F.octet_length(content)

    def opening(cut: Column) -> Column:
        head = _part(data, F.lit(0), cut)
        last = F.greatest(*[_last(head, d) for d in SOFT_ENDS])
        return F.concat(_part(data, F.lit(0), F.when(last > F.floor(cut * 2 / 3), last).otherwise(cut).cast("int")), F.lit("..."))

    def skipped(start: Column, part: Column) -> Column:
        """Without what stands before a sentence that begins near the window's start."""
        marks = F.array_min(F.array(*[F.when(_first(part, d).isNotNull(), F.struct(_first(part, d).alias("p"), F.lit(len(d)).alias("n"))) for d in SENTENCE_ENDS]))
        near = (start > 0) & (marks["p"] < F.floor(F.octet_length(part) / 4))
        return F.when(near, _part(part.cast("binary"), marks["p"] + marks["n"], F.octet_length(part))).otherwise(part)

    def ended(end: Column, part: Column) -> Column:
        """Up to a sentence's end near the window's."""
        mark = F.array_max(F.array(*[F.struct(_last(part, d).alias("p"), F.lit(len(d)).alias("n")) for d in SENTENCE_ENDS]))
        near = (end < length) & (mark["p"] > F.floor(F.octet_length(part) * 2 / 3))
        return F.when(near, _part(part.cast("binary"), F.lit(0), mark["p"] + mark["n"])).otherwise(part)

    def window(start: Column) -> Column:
        def cut(end: Column) -> Column:
            dots = F.when(start > 0, "...").otherwise(""), F.when(end < length, "...").otherwise("")
            shown = lambda part: F.when(part == "", "").otherwise(F.concat(dots[0], part, dots[1]))
            return _let(_part(data, start, end), lambda part: _let(skipped(start, part), lambda p: _let(ended(end, p), shown)))

        return _let(F.least(length, _whole(data, F.least(length, start + size), 1)), cut)

    start = lambda at: _whole(data, F.greatest(F.lit(0), at - size // 3), -1)
    whole = F.coalesce(content, F.lit(""))
    cut = F.when(found.isNull(), _let(_whole(data, F.lit(size), -1), opening)).otherwise(_let(found, lambda at: _let(start(at), window)))
    return F.when(F.coalesce(length, F.lit(0)) <= size, whole).otherwise(cut)
