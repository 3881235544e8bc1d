"""The pull source against a local server: pages, errors as rows, retries, offsets."""

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from fieldloom.sources import pull


@pytest.fixture
def server():
    """Page k answers with its number; 3 fails once, 5 is never there, 7 is slow, 9 always fails, pages from ``here.most`` on are absent."""
    asked = Counter()

    lines = Counter()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"  # connections stay open

        def setup(self):
            lines["opened"] += 1
            super().setup()

        def do_GET(self):
            if self.path.startswith("/moved/"):
                self.send_response(302)
                self.send_header("Location", "/p/" + self.path.rpartition("/")[2])
                self.send_header("Content-Length", "0")
                self.end_headers()
                return
            page = int(self.path.rpartition("/")[2])
            asked[page] += 1
            if page == 7:
                time.sleep(1.5)
            code = 404 if page >= here.most or page == 5 else 503 if page == 9 or (page == 3 and asked[3] == 1) else 200
            body = f'{{"page": {page}, "text": "é"}}'.encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            try:
                self.wfile.write(body)
            except OSError:
                pass

        def log_message(self, *args):
            pass

    here = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    here.most, here.asked, here.lines, here.url = 12, asked, lines, f"http://127.0.0.1:{here.server_port}/p/{{page}}"
    threading.Thread(target=here.serve_forever, daemon=True).start()
    yield here
    here.shutdown()


def test_pages_and_failures_are_rows(spark, server):
    df = pull.pull(spark, server.url, 14, partitions=5, timeoutMs=1000, attempts=2, pauseMs=10)
    got = {r.page: r for r in df.collect()}
    assert sorted(got) == list(range(14)) and df.rdd.getNumPartitions() == 5
    assert got[0].status == 200 and got[0].body == '{"page": 0, "text": "é"}' and got[0].attempts == 1 and got[0].error is None
    assert (got[3].status, got[3].attempts, got[3].error) == (200, 2, None)
    assert (got[5].status, got[5].error, got[5].attempts, got[5].body) == (404, "STATUS", 1, None)
    assert (got[7].error, got[7].attempts, got[7].status) == ("TIMEOUT", 2, None)
    assert (got[9].status, got[9].error, got[9].attempts) == (503, "STATUS", 2)
    assert got[13].status == 404


def test_a_worker_keeps_its_connection(spark, server):
    server.most = 60
    asked = [p for p in range(60) if p not in (3, 5, 7, 9)]
    got = pull.pull(spark, server.url.replace("/p/", "/moved/"), 60, partitions=2, attempts=1, timeoutMs=4000, pauseMs=1).collect()
    assert sorted(r.page for r in got if r.status == 200) == sorted({*asked, 7}) and len(got) == 60
    assert server.lines["opened"] <= 4


def test_an_idle_connection_that_was_closed_is_opened_again(server):
    request = pull.Request.of({"url": server.url, "attempts": "1"})
    assert request.fetch(0)[2] == 200
    next(iter(pull._lines.values())).sock.shutdown(2)
    assert request.fetch(1)[2] == 200
    pull._lines.clear()


def test_nobody_answers(spark):
    got = pull.pull(spark, "http://127.0.0.1:9/{page}", 1, attempts=2, pauseMs=1).first()
    assert (got.error, got.attempts, got.status, got.body) == ("UNREACHABLE", 2, None, None)


def test_bounds(spark, server):
    small = pull.pull(spark, server.url, 1, mostBytes=3).first()
    assert small.error == "TOO_LARGE" and small.body is None and small.status == 200
    for bad in ({"timeoutMs": 10}, {"timeoutMs": 130_000}):
        with pytest.raises(Exception, match="timeoutMs"):
            pull.pull(spark, server.url, 1, **bad).collect()
    with pytest.raises(Exception, match="page"):
        pull.pull(spark, "http://127.0.0.1/", 1).collect()
    assert pull.pull(spark, server.url, 0).count() == 0


def test_a_stream_goes_on_where_it_was(spark, server, tmp_path):
    spark.dataSource.register(pull.PullSource)
    server.most = 3
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def run(until):
        stream = spark.readStream.format("pull").options(url=server.url, pagesPerBatch=2, pauseMs=1).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", log).start(out)
        for _ in range(150):
            if sum(p["numInputRows"] for p in query.recentProgress) >= until:
                break
            time.sleep(0.2)
        query.stop()

    run(3)
    assert sorted(r.page for r in spark.read.parquet(out).collect()) == [0, 1, 2]
    server.most = 5
    run(2)
    assert sorted(r.page for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_a_worker_holds_few_bodies(tmp_path):
    """Large bodies are handed on in batches of bounded bytes, and partitions follow the pages."""
    for k in range(40):
        (tmp_path / f"{k}.txt").write_text("é" * 500_000)
    reader = pull.PullReader({"url": f"file://{tmp_path}/{{page}}.txt", "pages": "40", "partitions": "1"})
    batches = list(reader.read(reader.partitions()[0]))
    assert sum(b.num_rows for b in batches) == 40 and max(b.num_rows for b in batches) * 500_000 <= pull.HELD + 500_000
    assert [p for b in batches for p in b.column("page").to_pylist()] == list(range(40))
    assert len(pull.PullReader({"url": "file:///x/{page}", "pages": "100000"}).partitions()) == 391
