"""Embeddings: by a caller's model, of documents in batches on the executors and of queries over HTTP; and by signed
feature hashing, which needs no model."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekmill.functions.text import indexed_text

log = logging.getLogger("seekmill.embedding")


def embed_documents(docs: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32) -> DataFrame:
    """vec_id, embedding (L2-normalised) of ``title + " " + content``. ``load`` runs once a task and
    returns the model: a function from texts to a matrix."""
    rows = docs.select(F.col("doc_id").alias("vec_id"), indexed_text(F.col("title"), F.col("content")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                m = np.asarray(model(part["text"].tolist()), np.float32)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "embedding": list(m / np.where(norm > 0, norm, 1))})

    return rows.mapInPandas(run, "vec_id long, embedding array<float>")


def hashed_embeddings(counts: DataFrame, dim: int = 64) -> DataFrame:
    """vec_id, embedding (L2-normalised) of documents by their term counts (doc_id, term, n): a term adds its count, or
    takes it away, at a place that its MD5 names. Sums are integers, so the vector is the same in any order; a
    document whose terms cancel has no vector. One shuffle by document, of one row of ``dim`` partial sums a task and document."""
    digest = F.md5(F.col("term").cast("binary"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim
    signed = F.when(F.substring(digest, 9, 1) < "8", F.col("n")).otherwise(-F.col("n"))
    each = counts.select("doc_id", place.alias("place"), signed.alias("v"))
    sums = each.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("place") == i, F.col("v"))), F.lit(0)).alias(f"v{i}") for i in range(dim)])
    sums = sums.select("doc_id", F.array(*[f"v{i}" for i in range(dim)]).alias("at"))
    held = sums.withColumn("squares", F.aggregate("at", F.lit(0).cast("long"), lambda s, v: s + v * v)).where(F.col("squares") > 0)
    # the norm as an array of its own, so that it is taken once a document
    vector = F.zip_with("at", F.array_repeat(F.sqrt("squares"), dim), lambda v, norm: (v.cast("double") / norm).cast("float"))
    return held.select(F.col("doc_id").alias("vec_id"), vector.alias("embedding"))


def hashing_embedder(terms: Callable[[str], DataFrame], dim: int = 64) -> Callable[[str], list[float] | None]:
    """A query's vector as ``hashed_embeddings`` gives it; ``terms`` cuts a query as the index does (``SearchService.query_terms``)."""

    def embed(query: str) -> list[float] | None:
        row = hashed_embeddings(terms(query).groupBy("doc_id", "term").agg(F.count("*").alias("n")), dim).first()
        return None if row is None else list(row["embedding"])

    return embed


def query_embedder(url: str, seconds: float = 3.0) -> Callable[[str], list[float] | None]:
    """A query's vector from an embedding service at ``url``; None if that fails or takes over ``seconds`` in all,
    so that a slow model never holds up a search."""
    pool = ThreadPoolExecutor(8, "embedding")

    def ask(query: str) -> list[float]:
        request = Request(url, json.dumps({"query": query}).encode(), {"Content-Type": "application/json"})
        with urlopen(request, timeout=seconds) as reply:
            return [float(x) for x in json.load(reply)["embedding"]]

    def embed(query: str) -> list[float] | None:
        try:
            return pool.submit(ask, query).result(seconds)
        except Exception as e:  # whatever fails there, the search goes on without it
            log.warning("no embedding for %r: %r", query, e)
            return None

    return embed


def embedding_server(model: Callable[[list[str]], np.ndarray], port: int = 8765, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Serves POST /embed ({"query"} to {"embedding", "dim"}, L2-normalised) and GET /health by ``model``."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, body: dict[str, object]) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._reply(200, {"status": "ok"}) if self.path == "/health" else self._reply(404, {"error": "no such path"})

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/embed":
                return self._reply(404, {"error": "no such path"})
            try:
                query = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))["query"]
            except (ValueError, KeyError, TypeError) as e:
                return self._reply(422, {"error": repr(e)})
            v = np.asarray(model([query])[0], np.float64)
            norm = float(np.linalg.norm(v))
            return self._reply(200, {"embedding": (v / norm if norm else v).tolist(), "dim": len(v)})

        def log_message(self, text: str, *args: object) -> None:
            log.info(text, *args)

    return ThreadingHTTPServer((host, port), Handler)
