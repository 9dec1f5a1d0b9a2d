"""A page to search from, by the standard library's server: python -m lodestone.serve TABLES [PORT]."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from lodestone.operators.retrieve import STRATEGIES

_PAGE = """<!doctype html><meta charset="utf-8"><title>lodestone</title><h1>Search</h1>
<form><input name="q" size="60" value="{q}"> <select name="strategy">{choices}</select> <input name="k" size="3" value="{k}"> <button>Search</button></form>
<p>{answer}</p><ol>{rows}</ol>"""


def page(query: str, strategy: str, k: int, found: dict | None) -> str:
    choices = "".join(f'<option{" selected" if s == strategy else ""}>{s}</option>' for s in STRATEGIES)
    rows = "".join(f"<li>{escape(str(r['id']))} ({r['score']:.3f}) {escape(r['caption'] or '')}</li>" for r in (found or {}).get("results", []))
    return _PAGE.format(q=escape(query, quote=True), choices=choices, k=k, answer=escape((found or {}).get("answer") or ""), rows=rows)


def server(search: Callable[[str, str, int], dict], port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Answers / with the page and /search with JSON; ``search`` takes text, strategy and k and gives results and answer."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802  the name is the base class's
            at = urlparse(self.path)
            asked = {name: values[0] for name, values in parse_qs(at.query).items()}
            query, strategy = asked.get("q", "").strip(), asked.get("strategy", "adaptive")
            try:
                k = min(100, max(1, int(asked.get("k", 10))))
                if strategy not in STRATEGIES:
                    raise ValueError(f"unknown strategy {strategy!r}")
                found = search(query, strategy, k) if query else None
            except ValueError as e:
                return self._reply(400, "application/json", json.dumps({"error": str(e)}))
            if at.path == "/search":
                return self._reply(200, "application/json", json.dumps(found or {"results": [], "answer": ""}, ensure_ascii=False))
            if at.path == "/":
                return self._reply(200, "text/html", page(query, strategy, k, found))
            return self._reply(404, "application/json", json.dumps({"error": "no such page"}))

        def _reply(self, status: int, kind: str, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def searcher(spark: SparkSession, tables: str) -> Callable[[str, str, int], dict]:
    """Searches the captions of a folder's documents, by an index and vectors that are made once."""
    from pyspark.sql import functions as F

    from lodestone.operators import bm25, services
    from lodestone.operators.retrieve import Retriever
    from lodestone.plans.requests import of_texts
    from lodestone.session import shared_folder, stored, table

    docs, embedder, generator = table(spark, tables, "documents"), services.encoder(), services.generator()
    path = shared_folder(spark)
    bm25.build(docs).save(path)
    items = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("caption"))
    vectors = stored(services.embedded(items, embedder, "caption", "id"))
    retriever = Retriever(vectors, bm25.Bm25Index.load(spark, path))

    def search(text: str, strategy: str, k: int) -> dict:
        asked = spark.createDataFrame([(0, text)], "q_id bigint, text string")
        r = of_texts(retriever, asked, items, embedder, generator, k, strategy).first()
        return {"results": [x.asDict() for x in (r["results"] or [])], "answer": r["answer"], "status": r["status"]}

    return search


if __name__ == "__main__":
    from lodestone.session import build_session

    running = server(searcher(build_session("serve"), sys.argv[1]), int(sys.argv[2]) if len(sys.argv) > 2 else 8080)
    running.serve_forever()
