"""Keyword dictionaries and character indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekmill.functions.text import characters, english_words, is_cn_token, tokenize


def without_stopwords(words: DataFrame, stopwords: DataFrame | None, column: str = "word") -> DataFrame:
    """Broadcast by its size: Spark does so below its threshold and shuffles beyond it."""
    return words if stopwords is None else words.join(stopwords.select(F.col("word").alias(column)), column, "left_anti")


def english_dictionary(texts: DataFrame, stopwords: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """word, freq: ASCII words in lower case."""
    words = texts.select(F.explode(english_words(F.col(text_col))).alias("word"))
    return without_stopwords(words.groupBy("word").agg(F.count("*").alias("freq")), stopwords)


def chinese_dictionary(texts: DataFrame, stopwords: DataFrame | None = None, text_col: str = "text", tokens: Callable[[Column], Column] = tokenize) -> DataFrame:
    """word, freq of tokens with a letter, digit or Chinese character; case is kept."""
    words = texts.select(F.explode(tokens(F.col(text_col))).alias("word")).where(is_cn_token(F.col("word")))
    return without_stopwords(words.groupBy("word").agg(F.count("*").alias("freq")), stopwords)


def sorted_dictionary(dictionary: DataFrame) -> DataFrame:
    return dictionary.orderBy(F.desc("freq"), "word")


def character_index(dictionary: DataFrame) -> DataFrame:
    """ch, word: every character of every word once. Nested lists come from ``character_lists``."""
    return dictionary.select(F.explode(F.array_distinct(characters(F.col("word")))).alias("ch"), "word")


def character_lists(dictionary: DataFrame) -> DataFrame:
    return character_index(dictionary).groupBy("ch").agg(F.array_sort(F.collect_set("word")).alias("words"))


def merged_dictionary(chinese: DataFrame, english: DataFrame) -> DataFrame:
    """Both word lists, one row a list: lang, word, freq."""
    return chinese.select(F.lit("cn").alias("lang"), "word", "freq").unionByName(english.select(F.lit("en").alias("lang"), "word", "freq"))
