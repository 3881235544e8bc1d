"""A source that pulls bodies over URLs: one row per request, failures included.

Registered as a Spark data source, so a pull is ``spark.read.format("pull")`` with pages dealt to partitions, and
``spark.readStream.format("pull")`` with the next page as its offset. A request that times out, is refused or answers with
an error status is a row with that error, never a failed task; what may pass is tried again.
"""

from __future__ import annotations

import http.client
import time
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "page int, url string, status int, error string, attempts int, body string"

# Bounds of the timeout in milliseconds, and its default.
TIMEOUT_MS = (1000, 120_000, 30_000)
#: The same for Arrow, and bytes of bodies that a worker holds before it hands them on.
_ARROW = pa.schema([("page", pa.int32()), ("url", pa.string()), ("status", pa.int32()), ("error", pa.string()), ("attempts", pa.int32()), ("body", pa.string())])
HELD = 4 << 20
#: Pages of a partition where their number isn't given, and partitions at most.
PART, MOST_PARTS = 256, 10_000
#: Statuses that another attempt may mend.
RETRIED = {408, 425, 429, 500, 502, 503, 504}


#: The connections of this process, by scheme and host: a worker keeps one for all the pages that it asks a host for.
_lines: dict[tuple[str, str], http.client.HTTPConnection] = {}


def _connection(scheme: str, host: str, timeout_s: float, fresh: bool = False) -> http.client.HTTPConnection:
    if fresh:
        _drop(scheme, host)
    line = _lines.get((scheme, host))
    if line is None:
        kind = http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection
        line = _lines[scheme, host] = kind(host, timeout=timeout_s)
        line.used = False
    line.timeout = timeout_s
    if line.sock:
        line.sock.settimeout(timeout_s)
    return line


def _drop(scheme: str, host: str) -> None:
    line = _lines.pop((scheme, host), None)
    if line:
        line.close()


@dataclass(frozen=True)
class Request:
    """How pages are asked for; ``url`` holds ``{page}``.

    Other schemes than http and https are recordings in a file system that Arrow opens: a file, or, where the URL ends
    with a slash, the one file of a folder.
    """

    url: str
    timeout_s: float
    attempts: int
    pause_s: float
    most_bytes: int

    @classmethod
    def of(cls, options: dict[str, str]) -> Request:
        if "url" not in options or "{page}" not in options["url"]:
            raise ValueError("option url must hold {page}")
        low, high, usual = TIMEOUT_MS
        wait = int(options.get("timeoutMs", usual))
        if not low <= wait <= high:
            raise ValueError(f"option timeoutMs must lie in {low} .. {high}")
        return cls(options["url"], wait / 1000, max(1, int(options.get("attempts", 3))), float(options.get("pauseMs", 200)) / 1000, int(options.get("mostBytes", 16 << 20)))

    def _answer(self, url: str) -> tuple[int | None, bytes]:
        """Status and body, a byte more of it than is allowed at most; a recording has no status."""
        if urllib.parse.urlsplit(url).scheme in ("http", "https"):
            return self._ask(url)
        files, path = fs.FileSystem.from_uri(url.rstrip("/"))
        if url.endswith("/"):
            there = files.get_file_info(fs.FileSelector(path))
            names = sorted(f.path for f in there if f.is_file and f.base_name[0] not in "._")
            if len(names) != 1:
                raise FileNotFoundError(url)
            path = names[0]
        with files.open_input_stream(path) as answer:
            return None, answer.read(self.most_bytes + 1)

    def _ask(self, url: str, hops: int = 5) -> tuple[int, bytes]:
        """Status and body of an http request over the process's connection to the host; redirects are followed."""
        to = urllib.parse.urlsplit(url)
        for fresh in (False, True):
            line = _connection(to.scheme, to.netloc, self.timeout_s, fresh)
            try:
                line.request("GET", urllib.parse.urlunsplit(("", "", to.path or "/", to.query, "")))
                answer = line.getresponse()
                body = answer.read(self.most_bytes + 1)
            except (http.client.HTTPException, OSError) as e:
                _drop(to.scheme, to.netloc)
                if fresh or isinstance(e, TimeoutError) or not line.used:
                    raise
                continue  # the host has closed a connection that was idle: once more over a new one
            line.used = True
            if len(body) > self.most_bytes or answer.will_close:
                _drop(to.scheme, to.netloc)
            where = answer.getheader("Location")
            if answer.status in (301, 302, 303, 307, 308) and where and hops:
                return self._ask(urllib.parse.urljoin(url, where), hops - 1)
            return answer.status, body
        raise AssertionError

    def fetch(self, page: int) -> tuple:
        """The row of a page."""
        url = self.url.replace("{page}", str(page))
        for attempt in range(1, self.attempts + 1):
            status = error = body = None
            try:
                status, raw = self._answer(url)
                if status is not None and status >= 300:
                    error = "STATUS"
                elif len(raw) > self.most_bytes:
                    error = "TOO_LARGE"
                else:
                    body = raw.decode("utf-8", "replace")
            except (http.client.HTTPException, OSError) as e:
                error = "TIMEOUT" if isinstance(e, TimeoutError) else "UNREACHABLE"
            if error in (None, "TOO_LARGE") or (error == "STATUS" and status not in RETRIED) or attempt == self.attempts:
                return page, url, status, error, attempt, body
            time.sleep(self.pause_s * 2 ** (attempt - 1))
        raise AssertionError


@dataclass
class Pages(InputPartition):
    """Pages ``first`` to ``end`` - 1."""

    first: int
    end: int


class PullReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.request = Request.of(options)
        self.pages = int(options.get("pages", 1))
        self.parts = max(1, int(options.get("partitions", min(MOST_PARTS, max(8, -(-self.pages // PART))))))

    def partitions(self) -> list[Pages]:
        parts = min(self.parts, max(1, self.pages))
        cuts = [self.pages * k // parts for k in range(parts + 1)]
        return [Pages(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        """Batches of HELD bytes of bodies, and the page that passes them: Spark's own hold 10,000 rows, however large."""
        held, size = [], 0
        for page in range(partition.first, partition.end):
            held.append(self.request.fetch(page))
            size += len(held[-1][-1] or "")
            if size >= HELD or len(held) == 10_000 or page == partition.end - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
                held, size = [], 0


class PullStream(SimpleDataSourceStreamReader):
    """Pages in order; the offset is the first page that isn't pulled yet. A page that isn't there yet ends the batch."""

    def __init__(self, options: dict[str, str]) -> None:
        self.request = Request.of(options)
        self.start, self.most = int(options.get("first", 0)), max(1, int(options.get("pagesPerBatch", 16)))

    def initialOffset(self) -> dict:
        return {"page": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, page = [], start["page"]
        while len(rows) < self.most:
            row = self.request.fetch(page)
            if row[2] == 404 or row[3] == "UNREACHABLE":
                break
            rows.append(row)
            page += 1
        return iter(rows), {"page": page}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.request.fetch(p) for p in range(start["page"], end["page"])])


class PullSource(DataSource):
    """Options: ``url`` with ``{page}``; ``pages`` and ``partitions`` (batch); ``first`` and ``pagesPerBatch`` (stream); ``timeoutMs``, ``attempts``, ``pauseMs``, ``mostBytes``."""

    @classmethod
    def name(cls) -> str:
        return "pull"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PullReader:
        return PullReader(self.options)

    def simpleStreamReader(self, schema) -> PullStream:
        return PullStream(self.options)


def pull(spark: SparkSession, url: str, pages: int, partitions: int | None = None, **options) -> DataFrame:
    """The rows of pages 0 to ``pages`` - 1 of ``url``; ``partitions`` follow from the pages if not given."""
    spark.dataSource.register(PullSource)
    if partitions is not None:
        options["partitions"] = partitions
    return spark.read.format("pull").options(url=url, pages=pages, **options).load()
