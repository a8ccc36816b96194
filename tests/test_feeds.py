"""Feed and listing readers, fetch failures."""

import errno
import http.server
import io
import json
import socket
import threading
import urllib.error

import pytest

from newsflow.operators import funnel
from newsflow.sources import feeds, registry
from newsflow.sources import http as feed_source

RSS = """<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "b&b;">]><rss><channel><image><url>https://logo</url></image>
<item><title>First &amp; <![CDATA[more]]></title><link>https://a/1</link><pubDate>Sun, 02 Aug 2026 10:00:00 +0300</pubDate>
<description>&lt;img src="https://a/i.jpg"&gt;Text&nbsp;here &a_8;</description><category>x</category></item>
<item><title>Second</title><guid>https://a/2</guid><media:content url="https://a/v.mp4" type="video/mp4"/><media:thumbnail url="https://a/t.jpg"/></item>
<item><title>Cut <![CDATA[never closed"""
ATOM = '<feed><entry><title>T</title><link rel="self" href="https://s"/><link href="https://e/1"/><updated>2026-08-02T10:00:00Z</updated><category term="c"/></entry></feed>'


def test_feed_fields():
    items, offered = feeds.parse_feed(RSS)
    assert offered == 3 and [i["title"] for i in items[:2]] == ["First & more", "Second"]
    assert items[0]["image_url"] == "https://a/i.jpg" and items[0]["categories"] == ["x"] and items[0]["link"] == "https://a/1"
    assert items[1]["image_url"] == "https://a/t.jpg" and items[1]["guid"] == "https://a/2"
    atom, _ = feeds.parse_feed(ATOM)
    assert atom[0]["link"] == "https://e/1" and atom[0]["categories"] == ["c"] and atom[0]["date_raw"] == "2026-08-02T10:00:00Z"
    assert feeds.parse_feed(None) == ([], 0)


def test_feed_cap_and_entity_bomb():
    many, offered = feeds.parse_feed("<rss>" + "<item><title>t</title></item>" * 201 + "</rss>")
    assert (len(many), offered) == (200, 201)
    bomb = "<!DOCTYPE b [" + "".join(f'<!ENTITY e{i} "{"&e%d;" % (i - 1) * 10}">' for i in range(1, 9)) + "]><rss><item><title>x &e8;</title></item></rss>"
    assert feeds.parse_feed(bomb)[0][0]["title"] == "x"


def test_articles(spark):
    sources = registry.load_registry(spark, """{"sources": [{"id": "s", "name": "S", "priority": 1, "adapter": "rss", "url": "u", "domain": "d"},
        {"id": "h", "name": "H", "priority": 2, "adapter": "html", "url": "u", "domain": "d"}, {"id": "off", "name": "O", "priority": 3, "adapter": "rss", "url": "u", "domain": "d", "enabled": false}]}""")
    page = """<article><h2>A long enough title</h2><a href="/x/?utm_source=q">go</a><time datetime="2026-08-02T10:00:00Z">t</time><p>Words</p></article>
        <article><h2>A long enough title too</h2><a href="/x/">go</a><time datetime="2026-08-02T10:00:00Z">t</time></article><article><h2>No date at all here</h2><a href="/y">y</a></article>"""
    bodies = spark.createDataFrame([("s", "u", RSS), ("h", "https://site.org/list", page), ("off", "u", RSS)], "source_id string, url string, body string")
    rows = {(r.source_id, r.title): r for r in feeds.articles_of(bodies, sources, 1785672000000).collect()}
    assert set(rows) == {("s", "First & more"), ("h", "A long enough title")}
    assert rows["s", "First & more"].summary == "Text here" and rows["s", "First & more"].published_at == 1785654000000
    assert rows["h", "A long enough title"].url == "https://site.org/x/?utm_source=q" and rows["h", "A long enough title"].summary == "Words"
    feeds.register(spark)
    assert spark.sql("SELECT title FROM feed_items('<item><title>q</title></item>')").first()[0] == "q"
    assert registry.parse_registry("{bad") == []


def test_fetch_failures():
    calls = []

    def refusing(request, timeout):
        calls.append(1)
        raise urllib.error.HTTPError("u", 403, "no", {}, io.BytesIO())

    assert feed_source.fetch("s", "https://u", refusing, lambda _: None)[3:6] == (403, "HTTPError", False) and len(calls) == 2


class _Site(http.server.BaseHTTPRequestHandler):
    """Counts what is asked; empty at first, redirecting, failing or slow by path."""

    seen: list = []

    def _say(self, code, body=b"", **headers):
        self.send_response(code)
        for k, v in headers.items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self.seen.append(self.path)
        n = self.seen.count(self.path)
        item = b"<rss><channel><item><title>A</title><link>https://a/b</link></item></channel></rss>"
        none = b"<rss><channel><title>none</title></channel></rss>"
        if self.path == "/forbidden-then-none":
            return self._say(403) if n == 1 else self._say(200, none) if n == 2 else self._say(500)
        if self.path == "/reset":
            return self.connection.close()
        return self._say(200, item if self.path == "/items" or self.path == "/late" and n > 1 else none)

    def do_HEAD(self):
        self.seen.append(self.path)
        if self.path.startswith("/to/"):
            return self._say(302, Location=f"/end/{self.path[4:]}")
        return self._say(404 if "gone" in self.path else 200)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_a_feed_without_items_is_asked_for_once_more(site):
    fetch = lambda path, adapter="rss": feed_source.fetch("s", site + path, pause=lambda _: None, adapter=adapter)
    _Site.seen.clear()
    assert "<item>" in fetch("/items")[2] and "<item>" in fetch("/late")[2] and "<item>" not in fetch("/none")[2]
    assert _Site.seen == ["/items", "/late", "/late", "/none", "/none"]
    _Site.seen.clear()
    assert "<item>" not in fetch("/late2", "html")[2] and len(_Site.seen) == 1
    _Site.seen.clear()
    # the second retry is not retried: its failure is the source's
    assert fetch("/forbidden-then-none")[3:6] == (500, "HTTPError", False) and len(_Site.seen) == 3


def test_only_a_lack_of_network_is_offline(spark, site):
    def failing(error):
        def opener(*_, **__):
            raise urllib.error.URLError(error)

        return feed_source.fetch("s", "https://u", opener, lambda _: None)[4:6]

    assert failing(socket.gaierror(-2, "unknown")) == ("gaierror", True)
    assert failing(OSError(errno.EHOSTUNREACH, "No route to host")) == ("OSError", True) and failing(OSError(errno.ENETUNREACH, "Network is unreachable"))[1]
    assert failing(ConnectionRefusedError(errno.ECONNREFUSED, "refused")) == ("ConnectionRefusedError", False)
    assert failing(ConnectionResetError(errno.ECONNRESET, "reset")) == ("ConnectionResetError", False)
    assert failing(TimeoutError("timed out")) == ("TimeoutError", False)
    deep = ValueError("top")
    deep.__cause__ = urllib.error.URLError(socket.gaierror(-2, "x"))
    assert feed_source.unreachable(deep)
    rows = feed_source.read_http(spark, [{"id": "a", "url": "http://127.0.0.1:9/none"}, {"id": "b", "url": f"{site}/reset"}, {"id": "c", "url": f"{site}/items", "adapter": "rss"}])
    log = feed_source.fetch_log(rows, feeds.items_of(rows), spark.createDataFrame([("a", "A"), ("c", "C")], "id string, name string"))
    got = {r.source_id: (r.status, r.offline, r.source_name) for r in log.select("source_id", "source_name", "offline", funnel.status_label().alias("status")).collect()}
    assert got["a"] == ("ConnectionRefusedError", False, "A") and got["c"] == ("200", False, "C")
    assert got["b"][0] in ("RemoteDisconnected", "ConnectionResetError", "BadStatusLine") and not got["b"][1]
    state = funnel.refresh_state(funnel.outcome(log.where("source_id <> 'c'"))).first()
    assert state.state == "all_failed"


def test_sources_are_due_once_an_interval():
    sources = [{"id": "a"}, {"id": "b"}, {"id": "c", "interval_s": 60}]
    at = 1_000_000.0
    ticks = [feed_source.due_ticks(sources, at + k * 10, 600) for k in range(61)]
    assert [len({t[s] for t in ticks}) for s in "abc"] == [2, 2, 11]
    reader = feed_source._StreamReader({"sources": json.dumps([{"id": i, "url": u} for i, u in (("a", "https://h/1"), ("b", "https://h/2"), ("c", "https://k/3"))])})
    whole = reader.partitions({}, {"a": 1, "b": 1, "c": 1})
    assert sorted(len(p.sources) for p in whole) == [1, 2]  # a task a host
    assert [p.sources for p in reader.partitions({"a": 1, "b": 1, "c": 1}, {"a": 1, "b": 2, "c": 1})] == [[("b", "https://h/2", None)]]


def test_a_restarted_stream_fetches_nothing_twice(spark, site, tmp_path):
    _Site.seen.clear()
    sources = [{"id": "a", "url": f"{site}/items", "adapter": "rss"}, {"id": "b", "url": f"{site}/none2", "adapter": "html"}]
    got = []

    def run(interval, checkpoint, seconds=0):
        q = feed_source.stream_http(spark, sources, interval, 0).writeStream.foreachBatch(lambda df, n: got.extend((r.source_id, r.http_status) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/{checkpoint}").start()
        q.processAllAvailable() if not seconds else q.awaitTermination(seconds)
        q.stop()

    run(10**8, "one")
    assert sorted(got) == [("a", 200), ("b", 200)] and sorted(_Site.seen) == ["/items", "/none2"]
    run(10**8, "one")
    assert len(got) == 2 and len(_Site.seen) == 2
    run(1, "two", 12)
    assert got.count(("a", 200)) >= 3


def test_redirects_are_followed_once_each(spark, site):
    _Site.seen.clear()
    links = [f"{site}/to/1", f"{site}/to/1", f"{site}/gone", f"{site}/stay", "https://elsewhere/x", "http://127.0.0.1:9/to/2", None]
    rows = spark.createDataFrame([(i, u, "t") for i, u in enumerate(links)], "n int, url string, title string")
    out = {r.n: r.url for r in feed_source.follow_redirects(rows, ("/to/",)).collect()}
    assert out == {0: f"{site}/end/1", 1: f"{site}/end/1", 2: f"{site}/gone", 3: f"{site}/stay", 4: "https://elsewhere/x", 5: "http://127.0.0.1:9/to/2", 6: None}
    assert sorted(_Site.seen) == ["/end/1", "/to/1"]
    # a target at the aggregator again is no target
    assert {r.url for r in feed_source.follow_redirects(rows.where("n = 0"), ("127.0.0.1",)).collect()} == {links[0]}


class _Answer:
    status = 200

    def __init__(self, body):
        self.body, self.headers = body, self

    def get_content_charset(self):
        return None

    def read(self, n):
        out, self.body = self.body[:n], self.body[n:]
        return out

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_fetch_limits():
    answers = [b" \n", b"<rss/>"]
    assert feed_source.get("https://u", lambda *_, **__: _Answer(answers.pop(0)), lambda _: None) == (200, "<rss/>") and not answers
    assert feed_source.get("https://u", lambda *_, **__: _Answer(b""), lambda _: None) == (200, "")
    large = lambda *_, **__: _Answer(b"x" * (feed_source.BODY_CAP + 1))
    assert feed_source.fetch("s", "https://u", large, lambda _: None)[2:6] == (None, None, "BodyTooLarge", False)
    times = iter([0, 0, 36, 36, 36])
    slow = lambda *_, **__: _Answer(b"x" * 100)
    try:
        feed_source.get("https://u", slow, lambda _: None, lambda: next(times))
    except TimeoutError:
        pass
    else:
        raise AssertionError("the budget holds over reads")
