"""HTTP API: search, crawl jobs, sites, items, health, metrics."""

from __future__ import annotations

import hmac
import json
import threading
import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from quarry.engine import Engine
from quarry.sources.export import LATENCY_BOUNDS, without_empty

OPEN = ("/healthz", "/metrics")


@dataclass
class Job:
    """A crawl: queued, running, then succeeded or failed."""

    url: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "queued"
    error: str = ""
    result: dict = field(default_factory=dict)


class Metrics:
    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.seconds: list[int] = [0] * len(LATENCY_BOUNDS)
        self.count, self.sum = 0, 0.0
        self.totals = {"search_requests_total": 0, "search_errors_total": 0, 'crawls_total{status="succeeded"}': 0, 'crawls_total{status="failed"}': 0}

    def add(self, name: str) -> None:
        with self.lock:
            self.totals[name] += 1

    def searched(self, seconds: float) -> None:
        with self.lock:
            self.count += 1
            self.sum += seconds
            for i, b in enumerate(LATENCY_BOUNDS):
                self.seconds[i] += seconds <= b

    def text(self) -> str:
        with self.lock:
            lines = ["quarry_up 1"] + [f"quarry_{k} {v}" for k, v in self.totals.items()]
            lines += [f'quarry_search_duration_seconds_bucket{{le="{b:g}"}} {n}' for b, n in zip(LATENCY_BOUNDS, self.seconds, strict=True)]
            lines += [f'quarry_search_duration_seconds_bucket{{le="+Inf"}} {self.count}', f"quarry_search_duration_seconds_sum {self.sum:g}", f"quarry_search_duration_seconds_count {self.count}"]
        return "\n".join(lines) + "\n"


class Api:
    """Requests in, (status, body) out; the transport is apart."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.jobs, self.metrics = engine, {}, Metrics()
        self.crawling = threading.Lock()  # one crawl writes at a time

    def handle(self, method: str, target: str, body: bytes = b"", token: str = "") -> tuple[int, object]:
        path, query = urlsplit(target).path, {k: v[-1] for k, v in parse_qs(urlsplit(target).query).items()}
        wanted = self.engine.config.token
        if wanted and path not in OPEN and not hmac.compare_digest(token, f"Bearer {wanted}"):
            return 401, {"error": "unauthorized"}
        parts = path.strip("/").split("/")
        if method == "GET" and path == "/healthz":
            return 200, {"status": "ok"}
        if method == "GET" and path == "/metrics":
            gauges = [f'quarry_index_{k}{{site="{r.site}"}} {r[k]}' for r in self.engine.stats().collect() for k in ("pages", "chunks", "products")]
            return 200, self.metrics.text() + "".join(g + "\n" for g in gauges)
        if method == "GET" and path == "/v1/sites":
            return 200, {"sites": [without_empty(_plain(r.asDict()), ("site", "pages", "chunks", "products")) for r in self.engine.stats().orderBy("site").collect()]}
        if method == "GET" and len(parts) == 4 and parts[:2] == ["v1", "sites"] and parts[3] == "items":
            return self._items(unquote(parts[2]), query)
        if method == "GET" and len(parts) == 3 and parts[:2] == ["v1", "crawl"]:
            job = self.jobs.get(parts[2])
            return (200, without_empty(vars(job), ("id", "status"))) if job else (404, {"error": "no such job"})
        if method == "POST" and path in ("/v1/search", "/v1/crawl"):
            try:
                asked = json.loads(body)
            except ValueError:
                asked = None
            if not isinstance(asked, dict):
                return 400, {"error": "the body must be a JSON object"}
            return self._search(asked) if path == "/v1/search" else self._crawl(asked)
        return 404, {"error": "not found"}

    def _search(self, asked: dict) -> tuple[int, object]:
        site, query = asked.get("site"), asked.get("query")
        if not site or not query:
            return 400, {"error": "site and query are required"}
        limit = asked.get("limit") or 0
        if isinstance(limit, bool) or not isinstance(limit, int):
            return 400, {"error": "limit must be an integer"}
        began = time.monotonic()
        self.metrics.add("search_requests_total")
        try:
            out = self.engine.answer(str(site), str(query), limit, str(asked.get("type") or ""), bool(asked.get("fresh")), bool(asked.get("force_cold")))
        except Exception as e:  # a request must be answered, whatever failed below
            self.metrics.add("search_errors_total")
            return 500, {"error": str(e)[:500]}
        finally:
            self.metrics.searched(time.monotonic() - began)
        out["results"] = [without_empty(_plain(r), ("url", "title", "score", "price") if r.get("price") is not None else ("url", "title", "score")) for r in out["results"]]
        if out["source"] == "site-search" and self.engine.config.search.auto_index_on_cold_query:
            self._crawl({"url": str(site)})
        return 200, out

    def _crawl(self, asked: dict) -> tuple[int, object]:
        if not asked.get("url"):
            return 400, {"error": "url is required"}
        job = Job(str(asked["url"]))
        self.jobs[job.id] = job
        threading.Thread(target=self._run, args=(job,), daemon=True).start()
        return 202, {"id": job.id, "status": job.status}

    def _run(self, job: Job) -> None:
        with self.crawling:
            job.status = "running"
            try:
                job.result = self.engine.crawl(job.url)
                job.status = "succeeded"
            except Exception as e:
                job.status, job.error = "failed", str(e)[:500]
        self.metrics.add(f'crawls_total{{status="{job.status}"}}')

    def _items(self, site: str, query: dict[str, str]) -> tuple[int, object]:
        try:
            since, limit = int(query.get("since_seq") or 0), int(query.get("limit") or 0)
        except ValueError:
            return 400, {"error": "since_seq and limit must be integers"}
        rows, cursor = self.engine.items(site, since, limit, query.get("type", ""))
        return 200, {"items": [without_empty(_plain(r), ("url", "seq")) for r in rows], "next_seq": cursor}

    def recrawl(self, stop: threading.Event, tick: float = 300.0) -> None:
        """Every tick, crawls the sites that are due."""
        while not stop.wait(tick):
            for site in self.engine.stale():
                self._run(Job(site))


def _plain(record: dict) -> dict:
    return {k: v.strftime("%Y-%m-%dT%H:%M:%SZ") if isinstance(v, datetime) else v for k, v in record.items()}


def server(api: Api, host: str, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = api.handle(self.command, self.path, body, self.headers.get("Authorization", ""))
            data = (out if isinstance(out, str) else json.dumps(out, ensure_ascii=False)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; version=0.0.4; charset=utf-8" if isinstance(out, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def run(engine: Engine) -> None:
    host, _, port = engine.config.listen.rpartition(":")
    api = Api(engine)
    threading.Thread(target=api.recrawl, args=(threading.Event(),), daemon=True).start()
    server(api, host or "0.0.0.0", int(port)).serve_forever()
