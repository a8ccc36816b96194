"""Feed bodies to items: a tolerant RSS, RDF and Atom reader, an HTML listing reader, and their table functions.

Parsing is the one row-at-a-time part: a body becomes up to 200 rows.  It runs as an Arrow-batched
``mapInArrow`` (``items_of``), and as SQL table functions (``register``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions import dates, text
from newsflow.ship import ship_package
from newsflow.sources.http import follow_redirects
from newsflow.tables import few

ITEMS_PER_FEED = 200
ITEM_COLUMNS = "title string, link string, description_html string, date_raw string, guid string, image_url string, categories array<string>"
PAGE_COLUMNS = "title string, link string, summary_text string, date_raw string, image_url string"

# -- reading XML -----------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"(?P<skip><!--(?:.*?-->|.*\Z)|<\?[^>]*(?:>|\Z))|<!\[CDATA\[(?:(?P<cdata>.*?)\]\]>|(?P<cut>.*\Z))|(?P<decl><![^>]*(?:>|\Z))"
    r"|</(?:(?P<end>[^>]*)>|(?P<cut2>[^>]*\Z))|<(?:(?P<start>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<cut3>.*\Z))|(?P<text>[^<]+)(?=<)", re.S)
_ATTRIBUTE = re.compile(r"\s*([^\s=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_ENTITY, _NUMERIC = re.compile(text.ENTITY), re.compile(text.NUMERIC)
_REFERENCE = re.compile(r"&([^;&]{0,9});")
_DOCTYPE, _ELEMENT = re.compile("<!DOCTYPE", re.I), re.compile("<[A-Za-z]")


def code_point(number: str, radix: int) -> str:
    try:
        code = int(number, radix)
    except ValueError:
        return ""
    if not 1 <= code <= 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return ""
    return chr(code)


def decode_text(raw: str) -> str:
    """Numeric references, then named ones; unknown ones go."""
    if "&" not in raw:
        return raw
    raw = _NUMERIC.sub(lambda m: code_point(m[2], 16 if m[1] else 10), raw)
    return _ENTITY.sub(lambda m: text.BUILT_IN.get(m[1]) or text.NAMED_ENTITIES.get(m[1], text.NAMED_ENTITIES.get(m[1].lower(), "")), raw)


def without_doctype(body: str) -> str:
    """Document type declarations before the first element go, internal subsets and all: nothing is ever expanded."""
    for _ in range(4):
        found, first = _DOCTYPE.search(body), _ELEMENT.search(body)
        if not found or (first and first.start() <= found.start()):
            break
        depth, end = 0, len(body)
        for m in re.compile(r"[\[\]>]").finditer(body, found.start()):
            if m[0] == "[":
                depth += 1
            elif m[0] == "]":
                depth = max(0, depth - 1)
            elif depth == 0:
                end = m.end()
                break
        body = body[:found.start()] + body[end:]
    return body


def sanitized(body: str) -> str:
    """Named entities that XML lacks become characters; unknown ones go."""
    return _ENTITY.sub(lambda m: m[0] if m[1] in text.BUILT_IN else text.NAMED_ENTITIES.get(m[1], text.NAMED_ENTITIES.get(m[1].lower(), "")), without_doctype(body))


def _references(value: str) -> str:
    def one(m: re.Match) -> str:
        name = m[1]
        if name in text.BUILT_IN:
            return text.BUILT_IN[name]
        if name[:1] == "#":
            hexadecimal = name[1:2] in ("x", "X")
            return code_point(name[2:] if hexadecimal else name[1:], 16 if hexadecimal else 10) or m[0]
        return m[0]

    return _REFERENCE.sub(one, value)


def _attributes(source: str) -> dict[str, str]:
    return {m[1]: _references(next((g for g in m.groups()[1:] if g is not None), "")) for m in _ATTRIBUTE.finditer(source)}


def tokens(body: str) -> Iterator[tuple]:
    """("start", name, attributes, closed), ("end", name) and ("text", value).  What is malformed is skipped; an unfinished construct ends it."""
    for m in _TOKEN.finditer(body):
        kind = m.lastgroup
        if kind in ("cut", "cut2", "cut3"):
            return
        if kind == "text":
            value = _references(m[0])
            if value.strip():
                yield "text", value
        elif kind == "cdata":
            yield "text", m["cdata"]
        elif kind == "end" and m["end"].strip():
            yield "end", m["end"].strip()
        elif kind == "start":
            raw = m["start"].strip()
            closed = raw.endswith("/")
            raw = raw[:-1].rstrip() if closed else raw
            name = re.split(r"[ \t\n]", raw, maxsplit=1)[0]
            if name:
                yield "start", name, _attributes(raw[len(name):]), closed


def _inner_text(stream: Iterator[tuple], name: str, closed: bool) -> str | None:
    """Text up to the matching end tag, through nested markup; blank is null."""
    if closed:
        return None
    depth, out = 1, []
    for token in stream:
        if token[0] == "text":
            out.append(token[1])
        elif token[1].lower() == name.lower():
            depth += 1 if token[0] == "start" else -1
            if not depth:
                break
    value = "".join(out)
    return value if value.strip() else None


#: Which tags fill which field.
FIELDS = {"title": "title", "description": "description", "summary": "description", "content:encoded": "content", "content": "content", "pubdate": "date",
          "dc:date": "date", "published": "date", "updated": "date", "guid": "guid", "id": "guid"}


def _item(stream: Iterator[tuple], container: str) -> dict:
    seen: dict[str, str | None] = {}
    categories: list[str] = []
    for token in stream:
        if token[0] == "end" and token[1].lower() == container.lower():
            break
        if token[0] != "start":
            continue
        _, name, attributes, closed = token
        tag, address = name.lower(), attributes.get("url")
        kind, medium = attributes.get("type", "").lower(), attributes.get("medium", "").lower()
        if tag in FIELDS:
            if seen.get(FIELDS[tag]) is None:
                seen[FIELDS[tag]] = _inner_text(stream, name, closed)
        elif tag == "link":
            if "href" in attributes:
                if attributes.get("rel", "alternate") == "alternate":
                    seen.setdefault("link", attributes["href"])
            elif not closed and (value := _inner_text(stream, name, closed)):
                seen.setdefault("link", value)
        elif tag in ("category", "dc:subject"):
            value = attributes["term"] if "term" in attributes else _inner_text(stream, name, closed)
            if value and value.strip():
                categories.append(value.strip())
        elif tag in ("media:content", "media:thumbnail"):
            if (address or "").strip() and (medium == "image" or kind.startswith("image") or not (medium.strip() or kind.strip())):
                seen.setdefault("image", address)
        elif tag == "enclosure":
            if (address or "").strip() and kind.startswith("image"):
                seen.setdefault("image", address)
        elif tag == "image":
            value = _inner_text(stream, name, closed)
            if value and value.startswith("http"):
                seen.setdefault("image", value.strip())
    html = seen.get("description") if seen.get("description") is not None else seen.get("content")
    rich = seen.get("content") if seen.get("content") is not None else seen.get("description")
    clean = lambda v: (v or "").strip() or None
    image = seen.get("image") or first_image(rich)
    strip = lambda v: v.strip() if v is not None else None
    return {"title": clean(seen.get("title")), "link": clean(seen.get("link")), "description_html": html, "date_raw": strip(seen.get("date")),
            "guid": strip(seen.get("guid")), "image_url": strip(image), "categories": categories}


def first_image(html: str | None) -> str | None:
    found = re.search(text.IMAGE_SOURCE, html or "")
    url = decode_text(found[1]).strip() if found else ""
    return url if url.lower().startswith("http") else None


def parse_feed(body: str | None, most: int = ITEMS_PER_FEED) -> tuple[list[dict], int]:
    """(the first items, how many the body offered)."""
    items, offered = [], 0
    stream = tokens(sanitized(body or ""))
    for token in stream:
        if token[0] == "start" and token[1].lower() in ("item", "entry"):
            offered += 1
            if len(items) < most:
                items.append(_item(stream, token[1]))
    return items, offered


# -- reading HTML listings -------------------------------------------------------------------------

class _Node:
    def __init__(self, tag: str, attributes: dict[str, str], parent: _Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def walk(self) -> Iterator[_Node]:
        for c in self.children:
            if isinstance(c, _Node):
                yield c
                yield from c.walk()

    def first(self, *tags: str, having: str | None = None) -> _Node | None:
        return next((n for n in self.walk() if n.tag in tags and (having is None or having in n.attributes)), None)

    def text(self) -> str:
        parts = [c.text() if isinstance(c, _Node) else c for c in self.children if not (isinstance(c, _Node) and c.tag in ("script", "style"))]
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    """A forgiving element tree; a new paragraph ends an open one."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.at.tag == tag:
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_listing(body: str | None, base: str) -> list[dict]:
    """Articles of a listing page: title, absolute link, first paragraph, raw date and image, in page order."""
    tree = _Tree()
    tree.feed(body or "")
    tree.close()
    root = tree.root
    found = [n for n in root.walk() if n.tag == "article"] or [
        a for h in root.walk() if h.tag in ("h1", "h2", "h3") for a in h.walk() if a.tag == "a" and "href" in a.attributes]
    meta = next((n for n in root.walk() if n.tag == "meta" and n.attributes.get("property") == "article:published_time"), None)
    out = []
    for n in found:
        anchor = n if n.tag == "a" else n.first("a", having="href")
        link = urljoin(base, anchor.attributes["href"]) if anchor is not None else ""
        if not link.startswith("http"):
            continue
        heading, stamp, any_time = n.first("h1", "h2", "h3"), n.first("time", having="datetime"), n.first("time")
        names = [heading.text() if heading else "", anchor.attributes.get("title", ""), anchor.text()]
        title = next((t.strip() for t in names if t.strip()), "")
        date = stamp.attributes["datetime"] if stamp else any_time.text() if any_time else meta.attributes.get("content") if meta else None
        paragraph, image = n.first("p"), n.first("img", having="src")
        image = urljoin(base, image.attributes["src"]) if image else ""
        summary = paragraph.text() if paragraph else None
        if len(title) >= 10:
            out.append({"title": title, "link": link, "summary_text": summary if summary != title else None, "date_raw": date, "image_url": image if image.startswith("http") else None})
    return out


# -- table functions -------------------------------------------------------------------------------

def _rows(parse, columns: list[str], kinds: list[pa.DataType]):
    schema = pa.schema([("source_id", pa.string()), ("pos", pa.int32()), ("offered", pa.int32()), *zip(columns, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, url, body in zip(*(b.column(c).to_pylist() for c in ("source_id", "url", "body")), strict=True):
                items, offered = parse(body, url)
                yield pa.RecordBatch.from_pylist([{"source_id": source, "pos": k, "offered": offered, **i} for k, i in enumerate(items)], schema=schema)

    return run


def items_of(bodies: DataFrame) -> DataFrame:
    """(source_id, pos, offered, item fields) of feed bodies (source_id, url, body): the first 200 items of each."""
    ship_package(bodies.sparkSession)
    kinds = [pa.string()] * 6 + [pa.list_(pa.string())]
    names = [c.split()[0] for c in ITEM_COLUMNS.split(", ")]
    return bodies.select("source_id", "url", "body").mapInArrow(_rows(lambda body, _: parse_feed(body), names, kinds), f"source_id string, pos int, offered int, {ITEM_COLUMNS}")


def listings_of(bodies: DataFrame) -> DataFrame:
    ship_package(bodies.sparkSession)
    names = [c.split()[0] for c in PAGE_COLUMNS.split(", ")]

    def parse(body, url):
        found = parse_listing(body, url)
        return found, len(found)

    return bodies.select("source_id", "url", "body").mapInArrow(_rows(parse, names, [pa.string()] * 5), f"source_id string, pos int, offered int, {PAGE_COLUMNS}")


class FeedItems:
    def eval(self, body: str):
        for i in parse_feed(body)[0]:
            yield tuple(i[c.split()[0]] for c in ITEM_COLUMNS.split(", "))


class ListingItems:
    def eval(self, body: str, url: str):
        for i in parse_listing(body, url):
            yield tuple(i[c.split()[0]] for c in PAGE_COLUMNS.split(", "))


def register(spark: SparkSession) -> None:
    """SQL: ``LATERAL feed_items(body)`` and ``LATERAL listing_items(body, url)``."""
    ship_package(spark)
    spark.udtf.register("feed_items", F.udtf(FeedItems, returnType=ITEM_COLUMNS))
    spark.udtf.register("listing_items", F.udtf(ListingItems, returnType=PAGE_COLUMNS))


# -- items to articles -----------------------------------------------------------------------------

def rewritten(image: Column) -> Column:
    """The source's image rewrite, where it has one."""
    pattern = F.col("imageRewrite.pattern")
    return F.when(pattern.isNotNull(), F.regexp_replace(image, pattern, F.col("imageRewrite.replacement"))).otherwise(image)


def _with_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    return items.join(few(sources.select(F.col("id").alias("source_id"), "imageRewrite", "adapter")), "source_id")


ARTICLE = ("source_id", "title", "summary", "url", "published_at", "image_url", "categories", "pos")


def feed_articles(items: DataFrame, sources: DataFrame, now_ms: int) -> DataFrame:
    """Valid articles of RSS, Atom and aggregator items: those with title, address and date."""
    rows = _with_source(items, sources).withColumn("title", text.truncate(text.plain_text(F.col("title")), text.TITLE_CHARS))
    url = F.coalesce(text.valid_url(F.col("link")), text.valid_url(F.col("guid")))
    summary = text.truncate(text.plain_text(F.col("description_html")), text.SUMMARY_CHARS)
    image = text.valid_url(rewritten(text.valid_url(F.col("image_url"), True)), True)
    rows = rows.withColumns({"url": url, "published_at": dates.parse_date(F.col("date_raw"), now_ms), "summary": summary, "image_url": image})
    rows = rows.where("title IS NOT NULL AND url IS NOT NULL AND published_at IS NOT NULL").withColumn("summary", F.when(F.lower("summary") != F.lower("title"), F.col("summary")))
    aggregated = F.col("adapter") == "googlenews"
    return rows.withColumns({"title": F.when(aggregated, text.without_outlet(F.col("title"))).otherwise(F.col("title")),
                             "url": F.when(aggregated, text.embedded_url(F.col("url"))).otherwise(F.col("url"))}).select(*ARTICLE)


def listing_articles(items: DataFrame, sources: DataFrame, now_ms: int) -> DataFrame:
    """Articles of listing pages, the first of each canonical URL."""
    from newsflow.operators.dedupe import distinct_first

    rows = _with_source(items, sources).withColumns({
        "url": F.col("link"), "published_at": dates.parse_date(F.col("date_raw"), now_ms), "summary": text.truncate(F.col("summary_text"), text.SUMMARY_CHARS),
        "image_url": rewritten(F.col("image_url")), "categories": F.expr("cast(array() as array<string>)")}).where("published_at IS NOT NULL")
    keyed = rows.withColumn("_key", F.struct("source_id", text.canonical_url(F.col("url"))))
    return distinct_first(keyed, F.col("_key"), F.col("pos")).select(*ARTICLE)


def articles_of(bodies: DataFrame, sources: DataFrame, now_ms: int, follow: bool = True) -> DataFrame:
    """Adapter dispatch: every enabled source's bodies through its reader.  Aggregator links that do not hold their target are followed, if so wanted."""
    kind = bodies.join(few(sources.where("enabled").select(F.col("id").alias("source_id"), "adapter")), "source_id")
    feed = feed_articles(items_of(kind.where("adapter <> 'html'")), sources, now_ms)
    feed = follow_redirects(feed) if follow else feed
    return feed.unionByName(listing_articles(listings_of(kind.where("adapter = 'html'")), sources, now_ms))
