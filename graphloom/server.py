"""A small query endpoint: bounded pages over HTTP, with all state in the token that the client sends back."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from graphloom import engine
from graphloom.functions.terms import parts
from graphloom.plans.parser import ParseError, parse
from graphloom.sources.dataset import Dataset
from graphloom.sources.results import boolean_json, page_json
from graphloom.streaming.paging import Budget, TokenError, run_page


def answer(data: Dataset, query: str, budget: Budget, token: str | None, server: Budget, prefixes: dict[str, str] | None = None) -> str:
    """JSON for one call: a page of a SELECT, a boolean, or the triples of a CONSTRUCT or DESCRIBE up to the row budget."""
    q = parse(query, prefixes)
    if q.form == "select":
        return page_json(run_page(data, q, budget, token, server))
    if q.form == "ask":
        return boolean_json(engine.ask(data, q))
    most = server.within(budget).limit
    found = engine.construct(data, q) if q.form == "construct" else engine.describe(data, q)
    rows = (found if most is None else found.limit(most)).collect()
    return json.dumps({"triples": [[parts(x)[1] for x in r] for r in rows]}, ensure_ascii=False)


def make_server(data: Dataset, port: int = 3330, server: Budget = Budget(100_000, 5000), prefixes: dict[str, str] | None = None, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """GET or POST /query with query, limit, timeout (ms) and token, in the URL or as a form; the lesser of both budgets holds."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, code: int, body: str) -> None:
            raw = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/sparql-results+json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _handle(self, form: dict[str, list[str]]) -> None:
            one = lambda name: form.get(name, [None])[0]
            if urlparse(self.path).path != "/query" or not one("query"):
                return self._reply(404, json.dumps({"error": "ask /query?query=..."}))
            try:
                number = lambda name: int(one(name)) if one(name) else None
                return self._reply(200, answer(data, one("query"), Budget(number("limit"), number("timeout")), one("token"), server, prefixes))
            except (ParseError, TokenError, ValueError) as e:
                return self._reply(400, json.dumps({"error": str(e)}))

        def do_GET(self) -> None:  # noqa: N802
            self._handle(parse_qs(urlparse(self.path).query))

        def do_POST(self) -> None:  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            self._handle(parse_qs(urlparse(self.path).query) | parse_qs(body))

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
