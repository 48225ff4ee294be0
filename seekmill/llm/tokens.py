"""Encoders of whole texts that give the ids of the tokenizers library.

Where a vocabulary file's ids are its merge order, tiktoken merges by those ids, several times faster
than the library: a pair is merged by the rank of what it makes, which is the same as by its own rank
because every merged token is made in one way, its own, when no merge reaches over its ends. Any other
file, and any text that tiktoken refuses, goes to the library. Nothing is remembered from text to text,
so memory is the vocabulary and one text.

``added`` says how a vocabulary's added tokens (``<|endoftext|>``) in a text are read: ``True``, as the
library as loaded does, gives their own ids; ``False`` reads them as ordinary characters.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from typing import Any

import numpy as np
import regex

#: Fixed value: how byte-level vocabularies cut texts.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the pieces that the word vocabulary keeps of a lower-cased text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDS_WORD = "</w>"


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary file stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranks(model: dict[str, Any], added: set[str], end: bytes | None) -> dict[bytes, int] | None:
    """Bytes -> id, if ids order the merges; ``end`` stands for the mark at a word's end."""
    symbols, vocab = _bytes_of_symbols(), {t: i for t, i in model["vocab"].items() if t not in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab.get(a + b) for a, b in merges]
    if None in made or made != sorted(set(made)) or min(made, default=0) < len(vocab) - len(made):
        return None
    out = {}
    for token, i in vocab.items():
        bare = token.removesuffix(ENDS_WORD) if end else token
        if not set(bare) <= symbols.keys():
            return None
        out[bytes(symbols[c] for c in bare) + (end if end and bare != token else b"")] = i
    return out if len(out) == len(vocab) else None


class Library:
    """The ids of the tokenizers library itself."""

    def __init__(self, path: str, added: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added

    def ids(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids of a whole text."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


class BytePairs(Library):
    """A byte-level vocabulary: texts are cut by ``BYTE_PATTERN``, all bytes count."""

    def __init__(self, path: str, added: bool, ranks: dict[bytes, int], tokens: dict[str, int]) -> None:
        import tiktoken

        super().__init__(path, added)
        self._merged = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=tokens)
        self._allowed = set(tokens) if added else set()

    def ids(self, text: str) -> np.ndarray:
        try:
            return self._merged.encode_to_numpy(text, allowed_special=self._allowed, disallowed_special=())
        except ValueError:  # a run of blanks too long for its regular expressions
            return super().ids(text)


#: Latin letters up to U+017F, whose case changes in the same way everywhere; the letters among them; digits.
_LATIN = re.compile("[\0-ſ]*").fullmatch
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: What is neither a letter nor white space there, in the pieces of ``WORD_PATTERN``; its first character's class
#: comes first, so that letters are skipped quickly.
_BETWEEN = re.compile(rf"[^\s{_LETTERS}](?:(?<=[{_DIGITS}])|(?<=')(?:[st]|re|ve|m|ll|d)|[^\s{_LETTERS}{_DIGITS}]*)")
#: White space that is not a blank or a line end, and separators that only some take for white space.
_ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0]")
_WORDS = regex.compile(WORD_PATTERN)


@functools.cache
def _unsettled() -> re.Pattern[str]:
    """A character that is new since Unicode 3.2 or of another class since: libraries may differ on it."""
    def settled(c: int) -> bool:
        now, then = unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))
        return now[0] == then[0] and now != "Cn" and not 0x1C <= c <= 0x1F

    good = [c for c in range(1 << 16) if settled(c) and not 0xD800 <= c < 0xE000]
    ends = [c for c, d in zip(good, good[1:] + [1 << 20]) if d != c + 1]
    starts = [c for c, d in zip(good, [-2, *good]) if c != d + 1]
    return re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True)) + "]")


class WordPairs(Library):
    """A lower-casing vocabulary of words with a mark at their ends, which a blank stands for here:
    blanks part the pieces of a text, and every piece is merged with the blank after it."""

    def __init__(self, path: str, added: bool, ranks: dict[bytes, int], tokens: dict[str, int]) -> None:
        import tiktoken

        super().__init__(path, added)
        self._merged = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self._tokens = tokens if added else {}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._tokens, key=len, reverse=True))) + ")").split if self._tokens else None

    def ids(self, text: str) -> np.ndarray:
        if self._cut and any(t in text for t in self._tokens):
            parts = self._cut(text)
            return np.concatenate([np.array([self._tokens[p]], "<u4") if i % 2 else self._plain(p) for i, p in enumerate(parts)])
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        if _LATIN(text) and "İ" not in text and not _ODD_SPACE.search(text):
            return self._of(_BETWEEN.sub(r" \g<0> ", text.lower().replace("\n", " ")))
        # nothing reaches across a blank, so words with unsettled characters go to the library alone
        out, at = [], 0
        for odd in _unsettled().finditer(text):
            if odd.start() >= at:
                lo, hi = text.rfind(" ", at, odd.start()) + 1 or at, text.find(" ", odd.end())
                hi = len(text) if hi < 0 else hi
                out += [self._settled(text[at:lo]), super().ids(text[lo:hi])]
                at = hi
        out.append(self._settled(text[at:]))
        return np.concatenate(out) if len(out) > 1 else out[0]

    def _settled(self, text: str) -> np.ndarray:
        return self._of(" ".join(_WORDS.findall(self.library.normalizer.normalize_str(text))))

    def _of(self, pieces: str) -> np.ndarray:
        return self._merged.encode_to_numpy(pieces + " ", disallowed_special=())


@functools.lru_cache(maxsize=4)
def encoder(path: str, added: bool = True) -> Library:
    """One encoder a worker for the vocabulary file at ``path``."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cut = file["model"], file["pre_tokenizer"] or {}
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"])
    plain &= not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    tokens = {t["content"]: t["id"] for t in file["added_tokens"]}
    kind, suffix = Library, model.get("end_of_word_suffix")
    if model["type"] == "BPE" and plain:
        if file["normalizer"] is None and not suffix and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]:
            kind = BytePairs
        elif suffix == ENDS_WORD and cut.get("type") == "Sequence" and _is_word_cut(file["normalizer"], cut["pretokenizers"]):
            kind = WordPairs
    ranks = _ranks(model, set(tokens), b" " if kind is WordPairs else None) if kind is not Library else None
    return Library(path, added) if ranks is None else kind(path, added, ranks, tokens)


def _is_word_cut(normalizer: dict[str, Any] | None, cuts: list[dict[str, Any]]) -> bool:
    steps = [s["type"] for s in (normalizer or {}).get("normalizers", [])]
    if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return False
    split, level = cuts
    return split["pattern"] == {"Regex": WORD_PATTERN} and split["invert"] and split["behavior"] == "Removed" and not level["use_regex"] and not level["add_prefix_space"]
