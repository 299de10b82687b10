"""The demo server: POST a text to /api/<language>/extract, get its triples as JSON."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .operators.predict import known_classes


def extract_text(spark, plan, text: str) -> list[dict]:
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    return [r.asDict() for r in known_classes(plan.extract(docs)).collect()]


def make_server(spark, plan, language: str = "en", host: str = "0.0.0.0", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: bytes, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self.answer(200 if self.path == "/" else 404, f"POST a text to /api/{language}/extract".encode(), "text/plain; charset=utf-8")

        def do_POST(self) -> None:
            if self.path != f"/api/{language}/extract":
                return self.answer(404, b"", "text/plain")
            text = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode("utf-8", "ignore")
            try:
                body = json.dumps(extract_text(spark, plan, text)).encode()
            except Exception as e:  # the caller hears of it, the server goes on
                return self.answer(500, str(e)[:300].encode(), "text/plain")
            self.answer(200, body, "application/json")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(spark, plan, language: str = "en", host: str = "0.0.0.0", port: int = 8080) -> None:
    make_server(spark, plan, language, host, port).serve_forever()
