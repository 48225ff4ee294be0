"""The service over HTTP: /search, /suggest, /hot, /click, /health and /stats, and files of a page."""

from __future__ import annotations

import json
import logging
import mimetypes
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from seekmill.plans.service import SearchService

log = logging.getLogger("seekmill.server")
JSON = "application/json; charset=utf-8"
MOST = 1000  # rows a client may ask for


def answer(service: SearchService, method: str, target: str) -> tuple[int, str]:
    """(status, JSON body) of one request; a missing query is an empty one, a click without an id counts
    for nothing, a bad number, or one beyond ``MOST``, is a client error."""
    url = urlsplit(target)
    args = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
    try:

        def number(name: str, default: int) -> int:
            n = int(args.get(name) or default)
            if n > MOST:
                raise ValueError(f"{name} is {MOST} at most")
            return n

        routes: dict[tuple[str, str], Callable[[], str]] = {
            ("GET", "/search"): lambda: service.search_json(args["q"], number("k", 20)) if args.get("q") else "[]",
            ("GET", "/suggest"): lambda: service.suggest_json(args.get("q", ""), number("k", 5)),
            ("GET", "/hot"): lambda: service.hot_json(number("k", 10)),
            ("GET", "/health"): lambda: json.dumps(service.health()),
            ("GET", "/stats"): lambda: json.dumps(service.cache_stats() | service.hot_stats()),
            ("POST", "/click"): lambda: _click(service, args.get("id", "")),
        }
        found = routes.get((method, url.path))
        return (200, found()) if found else (404, json.dumps({"error": "no such path"}))
    except ValueError as e:
        return 400, json.dumps({"error": str(e)})


def _click(service: SearchService, doc_id: str) -> str:
    if doc_id:
        service.record_click(int(doc_id))
    return json.dumps({"ok": True})


def page_file(folder: Path | None, target: str) -> Path | None:
    """The file of ``folder`` that a path names; ``/`` is its index page."""
    if folder is None:
        return None
    root = folder.resolve()
    found = (root / (unquote(urlsplit(target).path).lstrip("/") or "index.html")).resolve()
    return found if found.is_file() and root in found.parents else None


def server(service: SearchService, port: int = 8080, host: str = "127.0.0.1", static: str | None = None) -> ThreadingHTTPServer:
    """A server to call ``serve_forever`` on; Spark schedules concurrent requests. ``static`` is a folder of
    files for the other paths."""
    folder = Path(static) if static else None

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            file = page_file(folder, self.path) if method == "GET" else None
            if file:
                status, kind, data = 200, mimetypes.guess_type(file.name)[0] or "application/octet-stream", file.read_bytes()
            else:
                status, body = answer(service, method, self.path)
                kind, data = JSON, body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._reply("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._reply("POST")

        def log_message(self, text: str, *args: object) -> None:
            log.info(text, *args)

    return ThreadingHTTPServer((host, port), Handler)
