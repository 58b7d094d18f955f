"""HTTP server of an engine: ``/health``, ``/search`` and ``/answer``."""

from __future__ import annotations

import json
import time
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .plans.engine import Engine

_FLAGS = {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


def _query(args: dict[str, list[str]]) -> tuple[str, int]:
    if "query" not in args:
        raise Refused(422, "query is required")
    query = args["query"][0]
    if not query.strip():
        raise Refused(400, "query must not be empty")
    try:
        return query, int(args.get("k", ["10"])[0])
    except ValueError:
        raise Refused(422, "k must be a whole number") from None


def respond(engine: Engine, target: str) -> tuple[int, dict]:
    """Status and body for a request target such as ``/search?query=x``."""
    url = urlsplit(target)
    args = parse_qs(url.query, keep_blank_values=True)
    began = time.perf_counter()
    took = lambda: (time.perf_counter() - began) * 1000
    try:
        if url.path == "/health":
            return 200, {"status": "ok"}
        if url.path == "/search":
            query, k = _query(args)
            semantic = _FLAGS.get(args.get("use_semantic", ["false"])[0].lower())
            if semantic is None:
                raise Refused(422, "use_semantic must be true or false")
            before = engine.cache.hits
            found = engine.search(query, k, semantic)
            hit = engine.cache.hits > before
            return 200, {"query": query, "k": k, "cache_hit": hit, "took_ms": took(), "results": [asdict(s) for s in found]}
        if url.path == "/answer":
            query, k = _query(args)
            if not engine.search(query, k):
                raise Refused(404, "no relevant sources found")
            text, sources = engine.answer(query, k)
            return 200, {"query": query, "answer": text, "sources": [asdict(s) for s in sources], "took_ms": took()}
        raise Refused(404, "no such path")
    except FileNotFoundError:
        return 503, {"detail": "No index found: run the index command first."}
    except Refused as e:
        return e.status, {"detail": e.detail}


def make_server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = respond(engine, self.path)
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(engine: Engine, host: str, port: int) -> None:
    make_server(engine, host, port).serve_forever()
