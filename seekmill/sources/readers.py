"""Readers: text folders, RSS feeds, stopwords, and files of the older formats."""

from __future__ import annotations

import re
import xml.parsers.expat
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.functions.text import clean_html, first_filled
from seekmill.sources.binary import read_trie, read_vectors

DOCUMENTS = "doc_id long, link string, title string, content string"


def _or_empty(spark: SparkSession, schema: str, load) -> DataFrame:
    """What ``load`` reads, or no rows if the path doesn't exist."""
    try:
        return load()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Whole files: path, text. A missing folder has none."""
    return _or_empty(spark, "path string, text string", lambda: spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _or_empty(spark, "value string", lambda: spark.read.text(folder))


def read_stopwords(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct words of all files: one a line, a trailing carriage return dropped, blank lines skipped."""
    words = spark.read.text(list(paths)).select(F.regexp_replace("value", "\r$", "").alias("word"))
    return words.where(F.col("word") != "").distinct()


def _items(text: str) -> list[dict[str, str]]:
    """Tags of the items of the first channel of one RSS file, the first of each name, with their first text or CDATA
    section that isn't blank, if it stands before any child; none if any of the file is malformed. Entities that XML
    doesn't know stay as they are written."""
    parser, path, items = xml.parsers.expat.ParserCreate(), [], []
    channels = 0
    held: list[str] | None = None  # the text of the tag that is open, until it ends

    def start(name: str, _: object) -> None:
        nonlocal channels, held
        path.append(name)
        channels += path == ["rss", "channel"]
        if path == ["rss", "channel", "item"] and channels == 1:
            items.append({})
        if len(path) == 4 and path[:3] == ["rss", "channel", "item"] and channels == 1 and name not in items[-1]:
            held = []
            items[-1][name] = ""
        elif len(path) > 4:
            take()

    def end(name: str) -> None:
        if len(path) == 4:
            take()
        path.pop()

    def take() -> None:
        nonlocal held
        if held is not None:
            items[-1][path[3]] = "".join(held)
            held = None

    def between(*_: object) -> None:
        """A comment, or the start of a CDATA section: text before it is all there is."""
        if held is not None and "".join(held).strip():
            take()
        elif held is not None:
            held.clear()

    def add(data: str) -> None:
        if held is not None:
            held.append(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, add
    parser.CommentHandler = parser.StartCdataSectionHandler = between
    parser.EndCdataSectionHandler = take
    # as if a document type were given elsewhere, entities without a definition are reported and not an error
    parser.UseForeignDTD(True)
    parser.SkippedEntityHandler = lambda name, is_parameter: None if is_parameter else add(f"&{name};")
    parser.ExternalEntityRefHandler = lambda *_: 1
    try:
        parser.Parse(text, True)
    except xml.parsers.expat.ExpatError:
        return []
    return items


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: link, title, content. Of content, content:encoded and description the first
    that has text is cleaned; items without text, or whose text is markup only, are dropped, and so is a
    file that is not well-formed, as a whole."""
    fields = ("title", "link", "content", "content:encoded", "description")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [[item.get(f) for f in fields] for text in frame["text"] for item in _items(text)]
            yield pd.DataFrame(rows, columns=list(fields), dtype=object)

    raw = read_files(spark, path).mapInPandas(parse, "title string, link string, content string, `content:encoded` string, description string")
    content = clean_html(first_filled(F.col("content"), F.col("`content:encoded`"), F.col("description")))
    items = raw.select(F.coalesce("link", F.lit("")).alias("link"), F.coalesce("title", F.lit("")).alias("title"), content.alias("content"))
    return items.where(F.col("content") != "")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``word<TAB>freq`` lines; lines without a tab are skipped."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.contains("value", F.lit("\t"))).select(parts[0].alias("word"), parts[1].try_cast("long").alias("freq"))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """``term<TAB>doc<TAB>weight...`` lines as term, doc_id, weight; an odd last field is ignored."""
    fields = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    pairs = F.transform(F.sequence(F.lit(1), ((F.size("f") - 1) / 2).cast("int")), lambda i: F.struct(F.get("f", i * 2 - 1).cast("long").alias("doc_id"), F.get("f", i * 2).cast("double").alias("weight")))
    return fields.select(F.get("f", F.lit(0)).alias("term"), F.explode(pairs).alias("p")).select("term", "p.doc_id", "p.weight")


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) >= 3).select(f[0].cast("long").alias("doc_id"), f[1].cast("long").alias("offset"), f[2].cast("long").alias("size"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a page store: blocks of ``<doc>`` with id, link, title and content."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("(?s)<doc>(.*?)</doc>"), F.lit(1))).alias("b"))
    part = lambda tag: F.regexp_extract("b", f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return blocks.select(part("id").try_cast("long").alias("doc_id"), part("link").alias("link"), part("title").alias("title"), part("content").alias("content"))


def read_document(spark: SparkSession, store: str, doc_id: int) -> dict[str, str] | None:
    """One document of a page store by its offset: its file is opened there and its block alone is read.
    None if the offsets don't have it or the block is no document."""
    found = read_offsets(spark, f"{store}/offsets").where(F.col("doc_id") == doc_id).first()
    if found is None:
        return None
    jvm, at = spark.sparkContext._jvm, found["offset"]
    folder = jvm.org.apache.hadoop.fs.Path(f"{store}/pages")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    for f in files:
        if at < f.getLen():
            stream = system.open(f.getPath())
            stream.seek(at)
            block = bytes(stream.readNBytes(found["size"])).decode()
            stream.close()
            return document_of(block)
        at -= f.getLen()
    return None


def document_of(block: str) -> dict[str, str] | None:
    tags = {t: re.search(f"(?s)<{t}>(.*?)</{t}>", block) for t in ("id", "link", "title", "content")}
    if not all(tags.values()):
        return None
    plain = lambda s: s.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
    return {t: plain(m[1]) for t, m in tags.items()}
