"""Fetching as a scan, from a server of this test's own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from leadloom.sources import http, readers


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            path, _, query = self.path.partition("?")
            status, body = 200, ""
            if path == "/feed":
                at = int(query.split("=")[1])
                body = json.dumps([{"id": str(i), "text": f"Job {i}", "hostedUrl": f"https://x.example/{i}"} for i in range(at, min(at + 2, 5))])
            elif path == "/flaky":
                status = 503 if asked.count(self.path) < 2 else 200
                body = '{"jobs": []}'
            elif path == "/away":
                self.send_response(302)
                self.send_header("Location", "ftp://elsewhere/")
                self.end_headers()
                return
            elif path == "/large":
                body = "x" * 5000
            else:
                status = 404
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_pages_errors_and_filters(spark, server):
    base, asked = server
    http.register(spark)
    plan = lambda name, path, **more: {"source_id": name, "adapter": "lever", "url": base + path, "pause": 0.0, "most_bytes": 1000} | more
    plans = [plan("feed", "/feed?at={offset}", pages=9, size=2, organization="Org"), plan("flaky", "/flaky", adapter="ashby"), plan("gone", "/none", pages=3), plan("away", "/away"), plan("large", "/large"), plan("never", "/feed?at=0")]
    scan = spark.read.format("leadloom-http").option("sources", json.dumps(plans)).option("hosts", '["127.0.0.1"]').load()
    rows = scan.where(F.col("source_id").isin("feed", "flaky", "gone", "away", "large")).collect()
    got = {}
    for r in rows:
        got.setdefault(r["source_id"], []).append((r["page"], r["status"]))
    assert {k: sorted(v) for k, v in got.items()} == {"feed": [(0, 200), (1, 200), (2, 200)], "flaky": [(0, 200)], "gone": [(0, 404)], "away": [(0, 599)], "large": [(0, 413)]}
    # the source that a filter leaves out was not fetched: only the feed asked for its first page
    assert asked.count("/feed?at=0") == 1 and asked.count("/flaky") == 2 and asked.count("/none") == 1
    found, checks = readers.read_all(spark.createDataFrame([r for r in rows if r["source_id"] in ("feed", "gone")], scan.schema))
    assert sorted(r["title"] for r in found.collect()) == [f"Job {i}" for i in range(5)]
    assert {r["source_id"]: r["ok"] for r in checks.collect()} == {"feed": True, "gone": False}


def test_hosts_and_schemes():
    for bad in ("file:///etc/passwd", "http://user@host/", "ftp://host/", "http:///x", "https://other/"):
        with pytest.raises(OSError):
            http.permitted(bad, ("host",))
    http.permitted("https://HOST/x", ("host",))
    http.permitted("https://any/x", ())
