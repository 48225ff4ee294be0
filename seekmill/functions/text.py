"""Scalar text functions as columns: HTML cleaning, tokenizing, normalising, matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code point ranges of Chinese characters, and the white space of tokens.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"
SPACES = r" \t\n\r\f\x0B"
#: Entities with a replacement; all other numeric ones vanish.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&apos;": "'", "&#8211;": "-", "&#8212;": "-", "&#8230;": "."}
NAMED = "|".join(e for e in ENTITIES if "#" not in e)
ENTITY_TOKENS = f"({NAMED}|&#[^;]*;|[^&]+|&)"
#: Token strategies: Latin words, numbers and single other signs; or runs of letters and digits.
REGEX_TOKENS = rf"([A-Za-z][A-Za-z0-9]*|[0-9][0-9.]*|[{CJK}]|[^{SPACES}])"
WORD_TOKENS = r"([\p{L}\p{N}]+)"
#: What the first of these finds in a text whose A-Z are lower-cased, as Python writes it.
LOWER_TOKENS = rf"[a-z][a-z0-9]*|[0-9][0-9.]*|[^{SPACES}]"


def ascii_lower(c: Column) -> Column:
    """A-Z only; all other characters stay."""
    return F.translate(c, UPPER, LOWER)


def html_decode(c: Column) -> Column:
    """Entities decoded in one pass; ``&#...;`` up to the next semicolon vanishes unless it is listed."""

    def one(t: Column) -> Column:
        out = F.when(t == "&nbsp;", " ")
        for entity, to in list(ENTITIES.items())[1:]:
            out = out.when(t == entity, to)
        return out.when(t.startswith("&#"), "").otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(ENTITY_TOKENS), F.lit(1)), one), "")


def html_strip(c: Column) -> Column:
    """Without ``<...>``, an unclosed ``<...`` to the end, and stray ``>``."""
    return F.regexp_replace(c, "<[^>]*>?|>", "")


def clean_html(c: Column) -> Column:
    return html_strip(html_decode(c))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def indexed_text(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def tokenize(c: Column, strategy: str = "regex") -> Column:
    """Array of tokens; the same strategy must serve the index and the query."""
    pattern = {"regex": REGEX_TOKENS, "word": WORD_TOKENS}[strategy]
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1))


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{SPACES}]")


def english_words(c: Column) -> Column:
    """Runs of ASCII letters in lower case; every other byte separates."""
    return F.regexp_extract_all(ascii_lower(c), F.lit("([a-z]+)"), F.lit(1))


def is_cn_token(c: Column) -> Column:
    """Has a Latin letter, a digit or a Chinese character."""
    return c.rlike(f"[A-Za-z0-9{CJK}]")


def characters(c: Column) -> Column:
    """Code points of a string, in order."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def max_distance(c: Column) -> Column:
    """Edits that a query of this length may be away from a word."""
    return F.when(F.length(c) <= 2, 1).when(F.length(c) <= 5, 2).otherwise(3)


def keyword_position(text: Column, keyword: Column) -> Column:
    """Byte offset of the first match, ASCII case ignored; null without one."""
    at = F.position(ascii_lower(keyword), ascii_lower(text))
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)))


def normalize_key(c: Column) -> Column:
    """Cache key of a query: white space trimmed, A-Z in lower case."""
    return ascii_lower(F.btrim(c, F.lit(" \t\n\r\f\x0b")))


def four_digits(c: Column) -> Column:
    """A score as a page shows it: four digits after the point, rounded by the number's exact value, halves away from zero.
    A negative number keeps its sign, as in ``-0.0000``; NaN shows as such; numbers of 2^38 and more are cut by their
    shortest decimal form."""
    size = F.abs(c)
    # twice as many ten-thousandths, and what rounding took from the product
    product = size * 20000.0
    high = size * 134217729.0 - (size * 134217729.0 - size)
    error = (high * 20000.0 - product) + (size - high) * 20000.0
    halves = F.floor(product) - F.when((F.floor(product) == product) & (error < 0), 1).otherwise(0)
    units = F.floor((halves + 1) / 2).cast("long")
    exact = F.concat(F.floor(units / 10000).cast("string"), F.lit("."), F.lpad(F.pmod(units, F.lit(10000)).cast("string"), 4, "0"))
    shown = F.when(size < float(1 << 38), exact).when(size >= float(1 << 38), F.format_string("%.4f", size))
    return F.when(F.isnan(c), "NaN").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), shown))


def escape_html(c: Column) -> Column:
    for sign, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(to))
    return c


def highlight_words(query: Column) -> Column:
    """Words to mark: Latin and digit runs, then single Chinese characters, in lower case, each once."""
    latin = F.regexp_extract_all(query, F.lit("([a-zA-Z0-9]+)"), F.lit(1))
    chinese = F.regexp_extract_all(query, F.lit(r"([\x{4E00}-\x{9FFF}])"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(latin, chinese), F.lower))


def highlight(text: Column, words: list[str]) -> Column:
    """Escaped text with the words marked, case ignored."""
    safe, marked = escape_html(text), "|".join(re.escape(w) for w in words if w)
    return F.regexp_replace(safe, f"(?i)({marked})", "<em>$1</em>") if marked else safe
