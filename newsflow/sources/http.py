"""HTTP fetch as a Python data source: one partition per source, failures as rows, retries, a body cap.

``spark.read.format("newsfeeds").option("sources", json).load()`` gives (source_id, url, body, http_status,
error_class, offline, duration_ms); nothing is raised for a source that fails.
"""

from __future__ import annotations

import errno
import http.client
import json
import socket
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from newsflow.ship import ship_package
from newsflow.tables import few

#: Seconds for a connection, for a source with its retry, and before the retry; bytes of a body at most.
CONNECT, BUDGET, RETRY_AFTER, BODY_CAP = 15, 35, 2, 8 << 20
BODY_COLUMNS = "source_id string, url string, body string, http_status int, error_class string, offline boolean, duration_ms long"


class BodyTooLarge(ValueError):
    """A body over the cap: the source fails, nothing of it is parsed."""


def _connecting(base: type) -> type:
    """A connection whose time-out is shorter while it connects than while it reads."""

    class Connection(base):
        def connect(self):
            whole, self.timeout = self.timeout, min(CONNECT, self.timeout or CONNECT)
            super().connect()
            self.timeout = whole
            self.sock.settimeout(whole)

    return Connection


class _Http(urllib.request.HTTPHandler):
    def http_open(self, request):
        return self.do_open(_connecting(http.client.HTTPConnection), request)


class _Https(urllib.request.HTTPSHandler):
    def https_open(self, request):
        return self.do_open(_connecting(http.client.HTTPSConnection), request, context=self._context)


def open_url(request: urllib.request.Request, timeout: float):
    return urllib.request.build_opener(_Http, _Https).open(request, timeout=timeout)


#: What a feed request says that it takes.
ACCEPTED = {"User-Agent": "newsflow", "Accept": "application/rss+xml, application/atom+xml, application/xml, text/xml, */*", "Accept-Language": "ar,en;q=0.8"}


def get(url: str, opener: Callable = open_url, pause: Callable = time.sleep, clock: Callable = time.monotonic, usable: Callable[[str], bool] = lambda body: bool(body.strip())) -> tuple[int, str]:
    """(status, body).  A 403 or a server error is asked for once more; a good answer that is not ``usable``, as one without items, too, and then once only.

    All within the source's budget.
    """
    until = clock() + BUDGET

    def once() -> tuple[int, str]:
        left = until - clock()
        if left <= 0:
            raise TimeoutError("the source's time is over")
        with opener(urllib.request.Request(url, headers=ACCEPTED), timeout=left) as answer:
            raw = _read(answer, until, clock)
            return answer.status, raw.decode(answer.headers.get_content_charset() or "utf-8", "replace")

    try:
        found = once()
    except urllib.error.HTTPError as e:
        if not (e.code == 403 or e.code >= 500):
            raise
        pause(RETRY_AFTER)
        found = once()
    if usable(found[1]):
        return found
    pause(RETRY_AFTER)
    return once()


def _read(answer, until: float, clock: Callable) -> bytes:
    parts, size = [], 0
    while part := answer.read(1 << 16):
        parts.append(part)
        size += len(part)
        if size > BODY_CAP:
            raise BodyTooLarge(f"over {BODY_CAP} bytes")
        if clock() > until:
            raise TimeoutError("the source's time is over")
    return b"".join(parts)


def unreachable(error: BaseException | None) -> bool:
    """Whether the chain of causes, eight deep, says that there was no network: an unknown host, no route, an unreachable network.

    Servers that refuse, reset or don't answer in time are no lack of network.
    """
    for _ in range(8):
        if error is None:
            return False
        if isinstance(error, socket.gaierror) or isinstance(error, OSError) and (error.errno in (errno.EHOSTUNREACH, errno.ENETUNREACH) or "unreachable" in str(error.strerror or "").lower()):
            return True
        reason = getattr(error, "reason", None)
        error = reason if isinstance(reason, BaseException) else error.__cause__
    return False


def error_name(error: BaseException) -> str:
    """The class of what went wrong; of an opener's wrapper, of what it wraps."""
    reason = getattr(error, "reason", None)
    return type(reason if type(error) is urllib.error.URLError and isinstance(reason, BaseException) else error).__name__


def _has_items(body: str) -> bool:
    from newsflow.sources.feeds import parse_feed

    return bool(parse_feed(body)[0])


def fetch(source_id: str, url: str, opener: Callable = open_url, pause: Callable = time.sleep, adapter: str | None = None) -> tuple:
    """One source's row; feeds (any adapter but ``html``) have to hold an item."""
    began = time.monotonic()
    status = body = kind = None
    offline = False
    more = {} if adapter in (None, "html") else {"usable": _has_items}
    try:
        status, body = get(url, opener, pause, **more)
    except urllib.error.HTTPError as e:
        status, kind = e.code, type(e).__name__
    except Exception as e:  # a source that fails never fails the others
        kind, offline = error_name(e), unreachable(e)
    return source_id, url, body, status, kind, offline, int((time.monotonic() - began) * 1000)


# -- redirects -------------------------------------------------------------------------------------

#: Aggregator links that are followed side by side; the aggregator is one host.
LANES = 4


def final_address(url: str, opener: Callable = open_url) -> str | None:
    """Where a HEAD request ends, whatever its status; null where it fails."""
    try:
        with opener(urllib.request.Request(url, method="HEAD", headers=ACCEPTED), timeout=BUDGET) as answer:
            return answer.geturl()
    except urllib.error.HTTPError as e:
        return e.url
    except Exception:  # the link itself is kept
        return None


def follow_redirects(articles: DataFrame, hosts: tuple[str, ...] = ("news.google.com",), lanes: int = LANES) -> DataFrame:
    """``articles`` with addresses that still point at an aggregator replaced by where they lead; each distinct one is asked for once.

    Addresses that fail, or that lead to the aggregator again, stay.
    """
    ship_package(articles.sparkSession)
    inside = lambda url: F.coalesce(F.greatest(*[F.contains(url, F.lit(h)) for h in hosts], F.lit(False)), F.lit(False))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url in b.column("url").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([final_address(url)], pa.string())], names=["url", "_to"])

    asked = articles.where(inside(F.col("url"))).select("url").distinct().repartition(lanes, "url")
    found = asked.mapInArrow(heads, "url string, _to string").where("_to IS NOT NULL").where(~inside(F.col("_to")))
    return articles.join(found, "url", "left").withColumn("url", F.coalesce("_to", "url")).select(*articles.columns)


class _One(InputPartition):
    def __init__(self, source_id: str, url: str, adapter: str | None = None):
        self.source_id, self.url, self.adapter = source_id, url, adapter


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.sources = json.loads(options.get("sources", "[]"))

    def partitions(self):
        return [_One(s["id"], s["url"], s.get("adapter")) for s in self.sources] or [_One("", "")]

    def read(self, partition) -> Iterator[tuple]:
        if partition.source_id:
            yield fetch(partition.source_id, partition.url, adapter=partition.adapter)


class _Host(InputPartition):
    """The due sources of one host: fetched one after the other, beside those of other hosts."""

    def __init__(self, sources: list[tuple]):
        self.sources = sources


#: Seconds between two fetches of a source, and between two sources of a host.
INTERVAL, HOST_PAUSE = 900, 1


def due_ticks(sources: list[dict], now: float, interval: float = INTERVAL) -> dict[str, int]:
    """By source, the number of its last due time; sources are spread over their interval by their id."""
    out = {}
    for s in sources:
        every = float(s.get("interval_s", interval))
        out[s["id"]] = int((now - zlib.crc32(s["id"].encode()) % max(1, int(every))) // every)
    return out


class _StreamReader(DataSourceStreamReader):
    """Offsets are the sources' ticks: a restart goes on from the ticks that were committed and fetches nothing again that is not due."""

    def __init__(self, options):
        self.sources = json.loads(options.get("sources", "[]"))
        self.interval, self.pause = float(options.get("interval_s", INTERVAL)), float(options.get("host_pause_s", HOST_PAUSE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return due_ticks(self.sources, time.time(), self.interval)

    def partitions(self, start: dict, end: dict):
        hosts: dict[str, list[tuple]] = {}
        for s in self.sources:
            if end.get(s["id"], -1) > start.get(s["id"], -1):
                hosts.setdefault(urlsplit(s["url"]).netloc, []).append((s["id"], s["url"], s.get("adapter")))
        return [_Host(sources) for sources in hosts.values()] or [_Host([])]

    def read(self, partition) -> Iterator[tuple]:
        for k, (source_id, url, adapter) in enumerate(partition.sources):
            if k:
                time.sleep(self.pause)
            yield fetch(source_id, url, adapter=adapter)


class NewsFeeds(DataSource):
    @classmethod
    def name(cls):
        return "newsfeeds"

    def schema(self):
        return BODY_COLUMNS

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def read_http(spark: SparkSession, sources: list[dict]) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(NewsFeeds)
    return spark.read.format("newsfeeds").option("sources", json.dumps(sources)).load()


def stream_http(spark: SparkSession, sources: list[dict], interval_s: float = INTERVAL, host_pause_s: float = HOST_PAUSE) -> DataFrame:
    """A stream of fetches: each source once an interval (its own ``interval_s``, where it has one)."""
    ship_package(spark)
    spark.dataSource.register(NewsFeeds)
    return spark.readStream.format("newsfeeds").option("sources", json.dumps(sources)).option("interval_s", str(interval_s)).option("host_pause_s", str(host_pause_s)).load()


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies from files named ``<source_id>.xml`` or ``.html``: the offline form of the source."""
    files = spark.read.text(folder, wholetext=True).withColumn("path", F.input_file_name())
    return files.select(F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1).alias("source_id"), F.col("path").alias("url"), F.col("value").alias("body"),
                        F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error_class"), F.lit(False).alias("offline"), F.lit(0).cast("long").alias("duration_ms"))


def fetch_log(bodies: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per fetched source: succeeded, empty (a good answer without items), status and error."""
    offered = items.groupBy("source_id").agg(F.max("offered").alias("offered"))
    names = few(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")))
    rows = bodies.join(offered, "source_id", "left").join(names, "source_id", "left")
    fetched = F.col("error_class").isNull()
    some = F.coalesce("offered", F.lit(0)) > 0
    return rows.select("source_id", F.coalesce("source_name", "source_id").alias("source_name"), (fetched & some).alias("succeeded"), (fetched & ~some).alias("empty"),
                       F.when(~fetched, F.col("http_status")).alias("http_status"), "offline", "error_class",
                       F.when(fetched & ~some, "empty body").otherwise(F.col("error_class")).alias("error"), "duration_ms")
