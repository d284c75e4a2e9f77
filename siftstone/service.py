"""The engine over HTTP, by the standard library alone: health, sources, ask, ask as server-sent events, reload, a page.

One request is one small batch.  It suits an index that one driver serves; batches of questions go through ``Engine`` itself.
"""

from __future__ import annotations

import json
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from siftstone.config import EngineConfig, MissingKey
from siftstone.engine import Engine, EngineNotReady
from siftstone.operators import answer
from siftstone.operators.index import IndexMismatch, IndexMissing

PAGE = """<!doctype html><meta charset="utf-8"><title>Documents</title>
<h1>Ask the documents</h1><p id="state"></p><form><input name="q" size="80" maxlength="2000" required> <button>Ask</button></form><pre id="out"></pre><ol id="cited"></ol>
<script>
const at = id => document.getElementById(id), turns = [];
fetch("/health").then(r => r.json()).then(h => { at("state").textContent = h.status; return fetch("/sources"); })
  .then(r => r.json()).then(s => { at("state").textContent += ` - ${s.document_count} documents, ${s.chunk_count} chunks`; });
const show = e => {
  if (e.type === "sources") at("cited").replaceChildren(...e.sources.map(s => Object.assign(document.createElement("li"), {textContent: s.source, title: s.snippet})));
  if (e.type === "token") at("out").textContent += e.text;
  if (e.type === "replace") at("out").textContent = e.text;
  if (e.type === "error") at("out").textContent = e.message;
};
document.forms[0].onsubmit = async event => {
  event.preventDefault();
  const question = event.target.q.value, body = JSON.stringify({question, history: turns.slice(-6)});
  at("out").textContent = "";
  const answer = await fetch("/ask/stream", {method: "POST", headers: {"Content-Type": "application/json"}, body});
  const parts = (await answer.text()).split("\\n\\n");
  parts.slice(0, -1).forEach(f => show(JSON.parse(f.slice(6))));
  turns.push({role: "user", content: question}, {role: "assistant", content: at("out").textContent});
};
</script>"""


class BadRequest(ValueError):
    """A request that breaks a rule."""


class Service:
    """What the handlers call: the engine, or why there is none."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, origins: tuple[str, ...] = ("*",), **parts) -> None:  # noqa: ANN003
        self.spark, self.config, self.origins, self.parts = spark, config or EngineConfig(), origins, parts
        self.engine: Engine | None = None
        self.reload()

    def reload(self) -> dict:
        try:
            self.engine, self.trouble = Engine(self.spark, self.config, **self.parts), None
            if not self.engine.index:
                self.engine, self.trouble = None, f"no index at {self.config.index_dir}"
        except (IndexMismatch, IndexMissing, MissingKey) as error:
            self.engine, self.trouble = None, str(error)
        return {"status": "ok" if self.engine else "not_ready", "detail": self.trouble}

    def _ready(self) -> Engine:
        if not self.engine:
            raise EngineNotReady(self.trouble)
        return self.engine

    def health(self) -> dict:
        c = self.config
        meta = {k: str(v) if k == "built_at" else v for k, v in self.engine.index.meta.items()} if self.engine else {}
        return {"status": "ok" if self.engine else "not_ready", "detail": self.trouble, "provider": c.chat_provider, "embedding_model": c.embedding_model, "top_k": c.top_k, "hybrid_retrieval": c.use_hybrid, "index": meta}

    def sources(self) -> dict:
        engine = self._ready()
        documents = [r.asDict() for r in engine.sources().collect()]  # one row a file
        return {"documents": documents, "document_count": len(documents), "chunk_count": engine.index.size}

    def ask(self, body: dict) -> dict:
        engine, (question, turns, top_k) = self._ready(), checked(body)
        schema = "qid bigint, question string, turns array<struct<role:string,text:string>>"
        row = engine.ask(self.spark.createDataFrame([(0, question, turns)], schema), top_k).first()
        return {"answer": row.answer.strip(), "sources": [s.asDict() for s in row.sources or ()], "search_query": row.search_query, "latency_ms": row.latency_ms}

    def events(self, body: dict) -> list[dict]:
        """The events of a streamed answer; what fails after the request was accepted is an error event."""
        self._ready()
        checked(body)
        try:
            got = self.ask(body)
            plain = answer.uncited(got["answer"])
            rows = answer.stream_events(self.spark.createDataFrame([(0, got["search_query"], plain, got["answer"])], "qid bigint, search_query string, pieces array<string>, cited string"))
            made = [{k: v for k, v in r.asDict().items() if k in ("type", "text", "search_query") and v is not None} for r in rows.orderBy("seq").collect()]
            return [made[0] | {"sources": got["sources"]}, *made[1:]]
        except Exception as error:  # noqa: BLE001  the client is told
            return [{"type": "error", "message": str(error)}]


def checked(body: dict) -> tuple[str, list[tuple[str, str]], int | None]:
    """Question, turns and top_k of a request, or BadRequest: the rules of ``answer.invalid_reasons``."""
    question, top_k, history = body.get("question"), body.get("top_k"), body.get("history") or []
    if not isinstance(question, str) or not 1 <= len(question) <= 2000:
        raise BadRequest("question: 1 to 2000 characters")
    if top_k is not None and (not isinstance(top_k, int) or not 1 <= top_k <= 20):
        raise BadRequest("top_k: 1 to 20")
    if not all(isinstance(t, dict) and t.get("role") in ("user", "assistant") and isinstance(t.get("content"), str) for t in history):
        raise BadRequest("history: role user or assistant, and content")
    return question, [(t["role"], t["content"]) for t in history], top_k


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server to run by ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, data: bytes, kind: str) -> None:
            self.send_response(status)
            asked = self.headers.get("Origin", "")
            if "*" in service.origins or asked in service.origins:
                self.send_header("Access-Control-Allow-Origin", "*" if "*" in service.origins else asked)
                self.send_header("Access-Control-Allow-Methods", "*")
                self.send_header("Access-Control-Allow-Headers", "*")
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _json(self, make) -> None:  # noqa: ANN001
            try:
                status, made = HTTPStatus.OK, make()
            except EngineNotReady as error:
                status, made = HTTPStatus.SERVICE_UNAVAILABLE, {"detail": str(error)}
            except (BadRequest, json.JSONDecodeError) as error:
                status, made = HTTPStatus.UNPROCESSABLE_ENTITY, {"detail": str(error)}
            if isinstance(made, list):
                self._send(status, "".join(f"data: {json.dumps(e)}\n\n" for e in made).encode(), "text/event-stream")
            else:
                self._send(status, json.dumps(made).encode(), "application/json")

        def _body(self) -> dict:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")
            if not isinstance(body, dict):
                raise BadRequest("an object is asked for")
            return body

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/":
                self._send(HTTPStatus.OK, PAGE.encode(), "text/html; charset=utf-8")
            elif self.path in ("/health", "/sources"):
                self._json(service.health if self.path == "/health" else service.sources)
            else:
                self._send(HTTPStatus.NOT_FOUND, b"{}", "application/json")

        def do_POST(self) -> None:  # noqa: N802
            routes = {"/ask": lambda: service.ask(self._body()), "/ask/stream": lambda: service.events(self._body()), "/reload": service.reload}
            if self.path in routes:
                self._json(routes[self.path])
            else:
                self._send(HTTPStatus.NOT_FOUND, b"{}", "application/json")

        def do_OPTIONS(self) -> None:  # noqa: N802
            self._send(HTTPStatus.NO_CONTENT, b"", "text/plain")

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
