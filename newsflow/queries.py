"""Queries over the driver's tables, one or more per operator group, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions import arabic, dates, similarity, text
from newsflow.operators import classify as scoring
from newsflow.operators import dedupe as stories
from newsflow.operators import funnel as funnels
from newsflow.operators import store
from newsflow.plans import views
from newsflow.plans.views import FIRST, STEP, read
from newsflow.sources import feeds
from newsflow.streaming import live
from newsflow.sources.vocabulary import Vocabulary, Weights
from newsflow.tables import materialize, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CLOCK = FIRST + 1000 * STEP  # the sync time of these queries


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# -- SQL of shared views -----------------------------------------------------------------------------

def _sql_truncate(c: str, n: int) -> str:
    cut = f"left({c}, {n})"
    space = f"({n} - instr(reverse({cut}), ' '))"
    body = f"CASE WHEN instr(reverse({cut}), ' ') > 0 AND {space} > {n // 2} THEN left({cut}, {space}) ELSE {cut} END"
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(regexp_replace({body}, '[ \\t\\n\\r]+$', ''), '[،,.؛;]+$', '') || '…' END"


def _sql_normalize(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[\\x{{064B}}-\\x{{0655}}\\x{{0670}}\\x{{0640}}]', '', 'g')".replace("{{", "{").replace("}}", "}")
    return f"lower(trim(regexp_replace(regexp_replace(translate({bare}, '{arabic.FOLD_FROM}', '{arabic.FOLD_TO}'), '[^\\p{{Arabic}}a-zA-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')))".replace("{{", "{").replace("}}", "}")


def _sql_tokens(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


def _sql_stem(t: str) -> str:
    return f"regexp_replace({t}, '{arabic.STEM}', '\\1')"


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


LABELS = "|".join(arabic.normalize_text(x) for x in arabic.OUTLET_LABELS)


def _sql_dedupe_tokens(normalized: str) -> str:
    bare = f"regexp_replace({normalized}, '^(?:(?:{LABELS}) +){{1,3}}', '')"
    stems = f"list_transform(string_split({bare}, ' '), lambda t: {_sql_stem('t')})"
    return f"list_filter({stems}, lambda t: length(t) > 1 AND NOT list_contains({_sql_list(arabic.STOPWORDS)}, t))"


def _sql_canonical(u: str) -> str:
    """For addresses with a scheme; others in lower case."""
    part = lambda k: f"regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/:?#]+)(?::(\\d+))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$', {k})"
    pairs = f"list_filter(list_transform(string_split({part(5)}, '&'), lambda p, i: {{'name': split_part(p, '=', 1), 'at': i, 'value': CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END}}), lambda p: NOT list_contains({_sql_list(text.TRACKING)}, lower(p.name)))"
    query_ = f"array_to_string(list_transform(list_sort({pairs}), lambda p: p.name || '=' || p.value), '&')"
    out = (f"'https://' || lower(regexp_replace({part(2)}, '^www\\.', '')) || CASE WHEN {part(3)} <> '' THEN ':' || {part(3)} ELSE '' END || {part(4)} "
           f"|| CASE WHEN {part(5)} <> '' AND len({pairs}) > 0 THEN '?' || {query_} ELSE '' END")
    return f"regexp_replace({out}, '/$', '')"


ARTICLES = f"""raw AS (
  SELECT source AS source_id, left(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g'), 120) AS title, {_sql_truncate('text', 200)} AS summary,
         'https://www.' || source || '.example.com/' || lang || '/' || doc_id || '/?utm_source=x' AS url,
         'https://' || source || '.example.com/' || lang || '/' || doc_id AS canonical_url,
         {FIRST} + doc_id * {STEP} AS published_at, lang, doc_id AS seq FROM documents)"""

V = views.LATIN.prepared()


def _sql_hits(surface: str, phrases, whole: bool = True) -> str:
    pad = "' ' || p || ' '" if whole else "p"
    return f"len(list_filter({_sql_list(phrases)}, lambda p: contains({surface}, {pad})))"


def _sql_classified(w: Weights = views.WEIGHTS, V: Vocabulary = V, articles: str = ARTICLES) -> str:
    surface = f"' ' || array_to_string(list_transform({_sql_tokens(_sql_normalize('concat_ws(chr(32), title, summary, lang)'))}, lambda t: {_sql_stem('t')}), ' ') || ' '"
    opening = f"' ' || array_to_string(list_transform({_sql_tokens(_sql_normalize('title'))}, lambda t: {_sql_stem('t')}), ' ') || ' '"
    urgent = "surface"
    for idiom in V.breaking_exclusions:
        urgent = f"replace({urgent}, ' {idiom} ', ' ')"
    return f"""{articles},
shown AS (SELECT *, {surface} AS surface, lower(url) || ' ' || lower(lang) AS paths, {opening} AS opening, greatest({CLOCK} - published_at, 0) AS age FROM raw),
signs AS (SELECT *, {_sql_hits('urgent', V.breaking)} > 0 AS marked, {_sql_hits('paths', V.breaking_paths, False)} > 0 OR {_sql_hits('urgent', V.breaking_paths)} > 0 AS path_marked,
    {_sql_hits('surface', V.event_verbs)} > 0 AS verb, {_sql_hits('surface', V.politics)} + {_sql_hits('surface', V.economy)} AS hits,
    {_sql_hits('paths', V.topic_paths, False)} > 0 AS topic_path, {_sql_hits('surface', V.negative)} AS neg, {_sql_hits('paths', V.negative_paths, False)} AS negp,
    regexp_matches(title, '[؟?]\\s*$') AS question, len(list_filter({_sql_list(V.analysis_prefixes)}, lambda p: starts_with(opening, ' ' || p || ' '))) > 0 AS analysis
  FROM (SELECT *, {urgent} AS urgent FROM shown)),
scores AS (SELECT *,
    CASE WHEN marked THEN {w.breaking_keyword} ELSE 0 END + CASE WHEN age <= 1800000 THEN {w.fresh_30m} WHEN age <= 7200000 THEN {w.fresh_2h} WHEN age <= 21600000 THEN {w.fresh_6h} ELSE 0 END
      + CASE WHEN path_marked THEN {w.breaking_path} ELSE 0 END + CASE WHEN neg > 0 THEN {w.negative_breaking} ELSE 0 END + CASE WHEN negp > 0 THEN {w.negative_breaking} ELSE 0 END AS breaking_score,
    CASE WHEN hits > 0 THEN least({w.topic_first} + (hits - 1) * {w.topic_more}, {w.topic_most}) ELSE 0 END + CASE WHEN topic_path THEN {w.topic_path} ELSE 0 END
      + neg * {w.negative_keyword} + negp * {w.negative_path} + CASE WHEN question THEN {w.question} ELSE 0 END + CASE WHEN analysis THEN {w.analysis} ELSE 0 END AS topic_score,
    marked OR path_marked OR verb AS event FROM signs),
classified AS (SELECT *, breaking_score >= {w.min_breaking} AS breaking_pass, topic_score >= {w.min_topic} AS topic_pass,
    breaking_score >= {w.min_breaking} AND topic_score >= {w.min_topic} AND event AS accepted FROM scores)"""


TABLE = f"""{_sql_classified()},
articles AS (SELECT md5(canonical_url) AS id, source_id, title, canonical_url, published_at, CAST(breaking_score AS INTEGER) AS breaking_score, CAST(topic_score AS INTEGER) AS topic_score,
    published_at // 43200000 AS day_bucket, seq % 7 = 0 AS notified, seq % 3 = 0 AS seen_in_feed FROM classified)"""

SOURCES = """sources AS (SELECT DISTINCT source AS id, 'Outlet ' || source AS name, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS priority,
    CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) <> 19 AS enabled, source || '.example.com' AS domain FROM documents WHERE source IS NOT NULL)"""


def _docs(spark, d):
    return read(spark, d, "documents")


def _articles(spark, d):
    return views.raw_articles(_docs(spark, d))


def _table(spark, d):
    return views.article_table(_docs(spark, d), CLOCK)


# -- flagship and projections ------------------------------------------------------------------------

@query(f"WITH {TABLE}, {SOURCES} SELECT a.id, a.title, a.published_at, coalesce(s.name, a.source_id) AS source_name, coalesce(s.domain, '') AS source_domain, left(coalesce(s.name, a.source_id), 1) AS monogram FROM (SELECT * FROM articles WHERE id IN (SELECT md5(canonical_url) FROM classified WHERE accepted) ORDER BY published_at DESC, id DESC LIMIT 200) a LEFT JOIN sources s ON s.id = a.source_id")
def q02_timeline_latest(spark, d):
    """Accepted articles, newest 200, with their outlets."""
    rows = scoring.accepted(views.classified(_docs(spark, d), CLOCK)).select(F.md5(text.canonical_url(F.col("url"))).alias("id"), "source_id", "title", "published_at", F.expr("cast(array() as array<string>)").alias("duplicate_source_ids"))
    return store.displayed(store.latest(rows), views.sources(_docs(spark, d))).select("id", "title", "published_at", "source_name", "source_domain", "monogram")


@query(f"WITH {ARTICLES} SELECT seq, source_id, title, summary, url, published_at FROM raw")
def p1_raw_articles(spark, d):
    return _articles(spark, d).select("seq", "source_id", "title", "summary", "url", "published_at")


@query(f"SELECT page_id, {_sql_canonical('url')} AS canonical_url, regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1), '^www\\.', '') AS host, length(url) <= 2048 AND regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') AS valid FROM pages")
def f06_canonical_url(spark, d):
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", text.canonical_url(url).alias("canonical_url"), text.display_host(url).alias("host"), text.valid_url(url).isNotNull().alias("valid"))


def _sql_fnv(c: str) -> str:
    """FNV-1a of 64 bits over ASCII text, as signed hexadecimal."""
    # unsigned arithmetic on 128 bits, modulo 2^64
    step = "lambda h, b: CAST((CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS HUGEINT) * 1099511628211) % 18446744073709551616 AS HUGEINT)"
    h = f"list_reduce(list_transform(generate_series(1, length({c})), lambda i: CAST(ascii(substr({c}, i, 1)) AS HUGEINT)), {step}, CAST(14695981039346656037 AS HUGEINT))"
    return f"(SELECT CASE WHEN h >= 9223372036854775808 THEN '-' || lower(to_hex(CAST(18446744073709551616 - h AS UBIGINT))) ELSE lower(to_hex(CAST(h AS UBIGINT))) END FROM (SELECT {h} AS h))"


@query(f"SELECT page_id, {_sql_fnv('url')} AS hash, {_sql_fnv('canonical')} AS id FROM (SELECT page_id, url, {_sql_canonical('url')} AS canonical FROM pages)")
def f07_stable_hash(spark, d):
    return read(spark, d, "pages").select("page_id", text.stable_hash(F.col("url")).alias("hash"), text.article_id(F.col("url")).alias("id"))


_SQL_BLANK = "\\t\\n\\x0B\\f\\r "
_SQL_SPACE = f"[{_SQL_BLANK}\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+"


def _sql_trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_SQL_SPACE}', ''), '{_SQL_SPACE}$', '')"


def _sql_references(c: str, pattern: str, value: str) -> str:
    """``c`` with each match m of a pattern replaced by ``value``: pieces between the matches and values, joined."""
    pairs = f"list_zip(string_split_regex({c}, '{pattern}'), regexp_extract_all({c}, '{pattern}'))"
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE array_to_string(list_transform(list_transform({pairs}, lambda z: {{'t': z[1], 'm': z[2]}}), lambda z: z.t || coalesce({value}, '')), '') END"


def _sql_decode(c: str) -> str:
    digits = "regexp_extract(z.m, '([0-9a-fA-F]+);', 1)"
    number = f"CASE WHEN z.m LIKE '&#x%' THEN CASE WHEN length(ltrim({digits}, '0')) BETWEEN 1 AND 6 THEN CAST('0x' || ltrim({digits}, '0') AS INTEGER) ELSE 0 END ELSE CASE WHEN regexp_matches(ltrim({digits}, '0'), '^[0-9]{{1,7}}$') THEN CAST(ltrim({digits}, '0') AS INTEGER) ELSE 0 END END"
    numeric = _sql_references(c, "&#x?[0-9a-fA-F]+;", f"CASE WHEN z.m IS NOT NULL AND {number} BETWEEN 1 AND 1114111 AND NOT {number} BETWEEN 55296 AND 57343 THEN chr({number}) END")
    return numeric


def _sql_named(c: str) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    table = lambda names: "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in names.items()) + "}"
    name = "substr(z.m, 2, length(z.m) - 2)"
    value = f"CASE WHEN z.m IS NOT NULL THEN coalesce({table(text.BUILT_IN | text.NAMED_ENTITIES)}[{name}], {table(text.NAMED_ENTITIES)}[lower({name})], '') END"
    return _sql_references(c, f"&[^#;&<>{_SQL_BLANK}][^;&<>{_SQL_BLANK}]{{1,63}};", value)


_SQL_TAG = "<" + "[^>]{0,1000}" * 4 + ">"
_SQL_IMAGE = r"""(?i)<img[^>]{0,600}?[\t\n\x0B\f\r ]src[\t\n\x0B\f\r ]*=[\t\n\x0B\f\r ]*["'']([^"'']+)["'']"""


@query(f"""WITH a AS (SELECT page_id, regexp_replace(html, '{_SQL_TAG}', ' ', 'g') AS t, regexp_extract(html, '{_SQL_IMAGE}', 1) AS i FROM pages),
b AS (SELECT page_id, {_sql_decode('t')} AS t, {_sql_decode('i')} AS i FROM a), c AS (SELECT page_id, {_sql_named('t')} AS t, {_sql_named('i')} AS i FROM b),
d AS (SELECT page_id, {_sql_decode('t')} AS t, {_sql_trim('i')} AS i FROM c), e AS (SELECT page_id, {_sql_named('t')} AS t, i FROM d)
SELECT page_id, nullif({_sql_trim(f"regexp_replace(t, '[{_SQL_BLANK}]+', ' ', 'g')")}, '') AS plain, CASE WHEN starts_with(lower(i), 'http') THEN i END AS image FROM e""")
def f02_plain_text(spark, d):
    return read(spark, d, "pages").select("page_id", text.plain_text(F.col("html")).alias("plain"), text.first_image(F.col("html")).alias("image"))


@query(f"SELECT doc_id, {_sql_truncate('text', 200)} AS summary FROM documents")
def f04_truncate(spark, d):
    return _docs(spark, d).select("doc_id", text.truncate(F.col("text"), 200).alias("summary"))


@query(f"WITH {ARTICLES} SELECT doc_id, CASE WHEN length(trim(source)) BETWEEN 1 AND 40 AND length(t) >= 15 THEN t ELSE t || ' - ' || source END AS title FROM (SELECT seq AS doc_id, source_id AS source, trim(title) AS t FROM raw WHERE source_id IS NOT NULL)")
def f13_without_outlet_titles(spark, d):
    """Over the titles of ``raw_articles``."""
    rows = _articles(spark, d).where("source_id IS NOT NULL")
    return rows.select(F.col("seq").alias("doc_id"), text.without_outlet(F.concat(F.trim("title"), F.lit(" - "), "source_id")).alias("title"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(replace(text, chr(9), ' '), chr(10)), lambda x: trim(x) <> ''), '|') AS lines FROM documents")
def f11_list_codec_whole(spark, d):
    """Over all lines of every text."""
    values = text.decode_list(F.translate("text", "\t", " "))
    return _docs(spark, d).select("doc_id", F.array_join(text.decode_list(text.encode_list(values)), "|").alias("lines"))


@query("""SELECT doc_id, CASE WHEN source IS NULL OR lang IS NULL THEN NULL WHEN doc_id % 2 = 0 THEN 'https://www.' || source || '.example.com/' || lang || '/story/' || doc_id ELSE 'https://news.google.com/rss/articles/' || 'plain' || doc_id END AS url FROM documents""")
def f14_embedded_url(spark, d):
    """Aggregator links made of the documents' addresses: even ones hold theirs, odd ones are opaque."""
    target = F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), "lang", F.lit("/story/"), F.col("doc_id").cast("string"))
    packed = F.concat(F.unhex(F.lit("0813")), F.encode(F.lit('"'), "UTF-8"), F.encode(target, "UTF-8"), F.unhex(F.lit("D20100")))
    token = F.regexp_replace(F.translate(F.base64(packed), "+/", "-_"), "[=\\r\\n]", "")
    link = F.concat(F.lit("https://news.google.com/rss/articles/"), F.when(F.col("doc_id") % 2 == 0, token).otherwise(F.concat(F.lit("plain"), F.col("doc_id").cast("string"))))
    return _docs(spark, d).select("doc_id", text.embedded_url(F.when(target.isNotNull(), link)).alias("url"))


@query("SELECT doc_id, CASE WHEN n = 1 THEN 'خبر جديد' WHEN n = 2 THEN 'خبران جديدان' WHEN n <= 10 THEN n || ' أخبار جديدة' ELSE n || ' خبرًا جديدًا' END AS label FROM (SELECT doc_id, doc_id % 15 + 1 AS n FROM documents)")
def f12_count_label(spark, d):
    return _docs(spark, d).select("doc_id", text.count_label(F.col("doc_id") % 15 + 1).alias("label"))


# -- feeds -----------------------------------------------------------------------------------------------

_FEEDS = f"""{ARTICLES}, fed AS (SELECT seq, 'feed' || seq // {views.FEED_DOCUMENTS} AS source_id, seq // {views.FEED_DOCUMENTS} AS feed, CAST(row_number() OVER (PARTITION BY seq // {views.FEED_DOCUMENTS} ORDER BY seq) - 1 AS INTEGER) AS pos,
    nullif(trim(title), '') AS title, url, text, raw.lang, published_at FROM raw JOIN documents ON doc_id = seq)"""


@query(f"WITH {_FEEDS} SELECT source_id, pos, title, url AS link, CASE WHEN trim(text, ' \n\t') <> '' THEN text END AS description, 'https://guid.example.com/' || seq AS guid, coalesce(lang, '') AS categories, CAST(count(*) OVER (PARTITION BY source_id) AS INTEGER) AS offered FROM fed")
def x1_feed_items(spark, d):
    """What the reader takes from RSS and Atom feeds made of the documents."""
    rows = feeds.items_of(views.feed_bodies(_docs(spark, d)))
    return rows.select("source_id", "pos", "title", "link", F.col("description_html").alias("description"), "guid", F.array_join("categories", ",").alias("categories"), "offered")


@query(f"""WITH {_FEEDS}, a AS (SELECT *, regexp_replace(title, '{_SQL_TAG}', ' ', 'g') AS t, regexp_replace(text, '{_SQL_TAG}', ' ', 'g') AS s FROM fed WHERE feed % 7 <> 6),
b AS (SELECT * REPLACE ({_sql_decode('t')} AS t, {_sql_decode('s')} AS s) FROM a), c AS (SELECT * REPLACE ({_sql_named('t')} AS t, {_sql_named('s')} AS s) FROM b),
e AS (SELECT * REPLACE ({_sql_decode('t')} AS t, {_sql_decode('s')} AS s) FROM c), f AS (SELECT * REPLACE ({_sql_named('t')} AS t, {_sql_named('s')} AS s) FROM e),
g AS (SELECT source_id, pos, nullif({_sql_trim(f"regexp_replace(t, '[{_SQL_BLANK}]+', ' ', 'g')")}, '') AS title, nullif({_sql_trim(f"regexp_replace(s, '[{_SQL_BLANK}]+', ' ', 'g')")}, '') AS plain,
  coalesce(url, 'https://guid.example.com/' || seq) AS url, published_at, coalesce(lang, '') AS categories FROM f),
h AS (SELECT *, {_sql_truncate('plain', 200)} AS s FROM g)
SELECT source_id, pos, title, CASE WHEN lower(s) <> lower(title) THEN s END AS summary, url, published_at, categories FROM h WHERE title IS NOT NULL""")
def p1_feed_articles(spark, d):
    """Articles of the enabled feeds, by adapter: plain titles and summaries, validated addresses or the guid's, parsed dates."""
    docs = _docs(spark, d)
    rows = feeds.articles_of(views.feed_bodies(docs), views.feed_sources(docs), 4_000_000_000_000)
    return rows.select("source_id", "pos", "title", "summary", "url", "published_at", F.array_join("categories", ",").alias("categories"))


# -- Arabic ----------------------------------------------------------------------------------------------

@query(f"WITH {ARTICLES}, n AS (SELECT seq, {_sql_normalize('title')} AS normalized FROM raw) SELECT seq, normalized, array_to_string({_sql_tokens('normalized')}, ' ') AS tokens, array_to_string(list_transform({_sql_tokens('normalized')}, lambda t: {_sql_stem('t')}), ' ') AS stemmed, array_to_string({_sql_dedupe_tokens('normalized')}, ' ') AS for_dedupe FROM n")
def a01_normalize(spark, d):
    t = F.col("title")
    return _articles(spark, d).select("seq", arabic.normalize(t).alias("normalized"), F.array_join(arabic.tokens(t), " ").alias("tokens"), arabic.stemmed(t).alias("stemmed"), arabic.for_dedupe(t).alias("for_dedupe"))


_ARABIC = ARTICLES.replace("raw AS (", "latin AS (", 1) + f""",
raw AS (SELECT * REPLACE (array_to_string(list_transform(string_split(title, ' '), lambda w, i: ({_sql_list(views.ARABIC_WORDS)})[((length(w) * 37 + (i - 1) * 101 + seq * 11) % {len(views.ARABIC_WORDS)}) + 1])[1:12], ' ') AS title) FROM latin)"""


@query(f"WITH {_ARABIC}, n AS (SELECT seq, {_sql_normalize('title')} AS normalized FROM raw) SELECT seq, normalized, array_to_string({_sql_tokens('normalized')}, ' ') AS tokens, array_to_string(list_transform({_sql_tokens('normalized')}, lambda t: {_sql_stem('t')}), ' ') AS stemmed, array_to_string({_sql_dedupe_tokens('normalized')}, ' ') AS for_dedupe FROM n")
def a02_arabic_normalize(spark, d):
    t = F.col("title")
    return views.arabic_articles(_docs(spark, d)).select("seq", arabic.normalize(t).alias("normalized"), F.array_join(arabic.tokens(t), " ").alias("tokens"), arabic.stemmed(t).alias("stemmed"), arabic.for_dedupe(t).alias("for_dedupe"))


# -- dates -----------------------------------------------------------------------------------------------

@query("SELECT event_id, epoch_ms(date_trunc('second', ts)) AS iso, epoch_ms(date_trunc('second', ts)) - 10800000 AS mail, epoch_ms(date_trunc('minute', ts)) AS short, CAST(NULL AS BIGINT) AS bad FROM events")
def t01_parse_date(spark, d):
    ts = F.col("ts").cast("timestamp")
    far = 4_000_000_000_000
    mail = F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0300"))
    return read(spark, d, "events").select("event_id", dates.parse_date(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), far).alias("iso"), dates.parse_date(mail, far).alias("mail"),
                                           dates.parse_date(F.date_format(ts, "yyyy-MM-dd'T'HH:mm'+03:00'"), far).alias("short"), dates.parse_date(F.lit("2026-02-30T10:00:00Z"), far).alias("bad"))


@query("SELECT event_id, (epoch_us(ts) // 1000) // 43200000 AS day_bucket FROM events")
def t06_bucket(spark, d):
    return read(spark, d, "events").select("event_id", dates.day_bucket(F.unix_millis(F.col("ts").cast("timestamp"))).alias("day_bucket"))


_MONTHS = _sql_list(dates.ARABIC_MONTHS)


@query(f"""WITH e AS (SELECT event_id, greatest(m.now - (epoch_us(ts) // 1000), 0) AS gone, ts FROM events, (SELECT max((epoch_us(ts) // 1000)) AS now FROM events) m)
SELECT event_id, CASE WHEN gone < 60000 THEN 'الآن'
  WHEN gone // 60000 < 60 THEN CASE gone // 60000 WHEN 1 THEN 'قبل دقيقة' WHEN 2 THEN 'قبل دقيقتين' ELSE 'قبل ' || gone // 60000 || CASE WHEN gone // 60000 <= 10 THEN ' دقائق' ELSE ' دقيقة' END END
  WHEN gone // 3600000 < 24 THEN CASE gone // 3600000 WHEN 1 THEN 'قبل ساعة' WHEN 2 THEN 'قبل ساعتين' ELSE 'قبل ' || gone // 3600000 || CASE WHEN gone // 3600000 <= 10 THEN ' ساعات' ELSE ' ساعة' END END
  WHEN gone // 86400000 = 1 THEN 'أمس' WHEN gone // 86400000 = 2 THEN 'قبل يومين' WHEN gone // 86400000 <= 10 THEN 'قبل ' || gone // 86400000 || ' أيام'
  ELSE day(ts) || ' ' || ({_MONTHS})[month(ts)] END AS label FROM e""")
def t07_relative_time(spark, d):
    rows = read(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    now = F.broadcast(rows.agg(F.max("at").alias("now")))  # one row
    return rows.join(now, F.lit(True)).select("event_id", dates.relative_time(F.col("at"), F.col("now")).alias("label"))


# -- scoring ---------------------------------------------------------------------------------------------

@query(f"WITH {_sql_classified()} SELECT seq, CAST(breaking_score AS INTEGER) AS breaking_score, CAST(topic_score AS INTEGER) AS topic_score, event AS has_event_signal, accepted FROM classified")
def k00_classify(spark, d):
    c = "classification"
    return views.classified(_docs(spark, d), CLOCK).select("seq", f"{c}.breaking_score", f"{c}.topic_score", f"{c}.has_event_signal", f"{c}.accepted")


@query(f"WITH {_sql_classified(Weights(), Vocabulary().prepared(), _ARABIC)} SELECT seq, CAST(breaking_score AS INTEGER) AS breaking_score, CAST(topic_score AS INTEGER) AS topic_score, event AS has_event_signal, breaking_pass, topic_pass, accepted FROM classified")
def k01_arabic_classify(spark, d):
    """Arabic titles by the default vocabulary and weights."""
    c = "classification"
    rows = scoring.classify(views.arabic_articles(_docs(spark, d)), CLOCK)
    return rows.select("seq", f"{c}.breaking_score", f"{c}.topic_score", f"{c}.has_event_signal", f"{c}.breaking_pass", f"{c}.topic_pass", f"{c}.accepted")


_W = views.WEIGHTS


@query(f"""WITH {_sql_classified()}, s AS (SELECT *, CASE WHEN age <= 1800000 THEN 'fresh-30m +{_W.fresh_30m}' WHEN age <= 7200000 THEN 'fresh-2h +{_W.fresh_2h}' WHEN age <= 21600000 THEN 'fresh-6h +{_W.fresh_6h}' END AS fresh,
    list_filter({_sql_list(V.event_verbs)}, lambda p: contains(surface, ' ' || p || ' '))[1] AS first_verb,
    list_filter({_sql_list(V.analysis_prefixes)}, lambda p: starts_with(opening, ' ' || p || ' '))[1] AS first_opening,
    {_sql_hits('surface', V.politics)} AS pol, {_sql_hits('surface', V.economy)} AS eco FROM classified)
SELECT seq, array_to_string(list_filter([
    CASE WHEN marked THEN 'breaking-keyword +{_W.breaking_keyword}' END, fresh, CASE WHEN path_marked THEN 'breaking-path +{_W.breaking_path}' END,
    CASE WHEN marked OR path_marked THEN 'event-signal(explicit breaking marker)' WHEN verb THEN 'event-signal(verb ' || chr(39) || first_verb || chr(39) || ')' ELSE 'NO event signal — nothing happened, this is description not news' END,
    CASE WHEN hits > 0 THEN 'topic-keywords(politics=' || pol || ',economy=' || eco || ') +' || least({_W.topic_first} + (hits - 1) * {_W.topic_more}, {_W.topic_most}) END,
    CASE WHEN topic_path THEN 'topic-path +{_W.topic_path}' END, CASE WHEN neg > 0 THEN 'negative-keywords(' || neg || ') ' || neg * {_W.negative_keyword} END,
    CASE WHEN negp > 0 THEN 'negative-path(' || negp || ') ' || negp * {_W.negative_path} END, CASE WHEN question THEN 'question-headline {_W.question}' END,
    CASE WHEN analysis THEN 'analysis-prefix(' || chr(39) || first_opening || chr(39) || ') {_W.analysis}' END], lambda x: x IS NOT NULL), '; ') AS signals FROM s""")
def k14_signals(spark, d):
    return views.classified(_docs(spark, d), CLOCK).select("seq", F.array_join("classification.signals", "; ").alias("signals"))


SWEEP = (Weights(), Weights(min_breaking=5), Weights(min_topic=2, topic_first=3), views.WEIGHTS)


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_sql_classified(w)} SELECT '{w.label}' AS label, count(*) AS n, count_if(breaking_pass) AS breaking_pass, count_if(topic_pass) AS topic_pass, count_if(accepted) AS accepted FROM classified)" for w in SWEEP))
def k16_sweep(spark, d):
    return scoring.sweep(_articles(spark, d), CLOCK, SWEEP, views.LATIN)


# -- two syncs -------------------------------------------------------------------------------------------

FIRST_SYNC = FIRST + 500 * STEP


def _two_syncs(spark, d):
    """(classified rows of the second sync, its outcome): the first takes what was published before ``FIRST_SYNC`` into an empty table, the second is offered everything."""
    docs = _docs(spark, d)
    rows = materialize(views.classified(docs, CLOCK), "funnel-rows")
    scored, known = scoring.accepted(rows), views.sources(docs)
    first = stories.dedupe(scored.where(F.col("published_at") < FIRST_SYNC), spark.createDataFrame([], stories.ARTICLE_COLUMNS), known, FIRST_SYNC)
    return rows, stories.dedupe(scored, materialize(first.to_insert, "stored"), known, CLOCK)


@query()
def d11_resync(spark, d):
    """Rows that the second sync inserts or updates, with the outlets merged into them."""
    out = _two_syncs(spark, d)[1]
    both = out.to_insert.withColumn("outcome", F.lit("insert")).unionByName(out.to_update.withColumn("outcome", F.lit("update")))
    return both.select("outcome", "id", "source_id", "title", "canonical_url", "published_at", "breaking_score", "topic_score", F.array_join("duplicate_source_ids", ",").alias("duplicates"))


@query()
def d09_losses(spark, d):
    """What the second sync loses by outlet: to other outlets' stories, and as fetched before."""
    out = _two_syncs(spark, d)[1]
    return out.merged_away.withColumn("kind", F.lit("merged_away")).unionByName(out.already_stored.withColumn("kind", F.lit("already_stored")))


# -- funnel ----------------------------------------------------------------------------------------------

_FUNNEL = f"""{_sql_classified()}, {SOURCES},
funnel AS (SELECT s.id AS source_id, count(c.seq) AS parsed, count_if(c.accepted) AS accepted, count_if({CLOCK} - c.published_at BETWEEN 0 AND 7200000) AS fresh2h
    FROM sources s LEFT JOIN classified c ON c.source_id = s.id WHERE s.enabled GROUP BY s.id)"""


def _funnel(spark, d):
    """Of the second of two syncs; its losses are what de-duplication found."""
    rows, out = _two_syncs(spark, d)
    on = views.sources(_docs(spark, d)).where("enabled")
    log = on.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.lit(True).alias("succeeded"), F.lit(False).alias("empty"), F.lit(None).cast("int").alias("http_status"),
                    F.lit(False).alias("offline"), F.lit(None).cast("string").alias("error_class"), F.lit(None).cast("string").alias("error"))
    inserted = out.to_insert.groupBy("source_id").agg(F.count("*").alias("n"))
    return funnels.funnel(log, rows, out.merged_away, out.already_stored, inserted, CLOCK)


@query()
def g03_funnel(spark, d):
    return _funnel(spark, d).select("source_id", "parsed", "breaking_pass", "topic_pass", "accepted", "deduped_away", "already_stored", "inserted", "fresh30m", "fresh2h", "newest_age_minutes", "loss_percent")


@query()
def g05_alerts(spark, d):
    """Outlets that lose more than the bar's share of what was accepted."""
    return funnels.alerts(_funnel(spark, d)).select("source_id", "loss_percent")


@query(f"WITH {_FUNNEL} SELECT coalesce(source_id, 'TOTAL') AS source_id, sum(parsed)::BIGINT AS parsed, sum(accepted)::BIGINT AS accepted, sum(fresh2h)::BIGINT AS fresh2h FROM funnel GROUP BY ROLLUP (source_id)")
def g06_totals(spark, d):
    return funnels.with_totals(_funnel(spark, d)).select("source_id", "parsed", "accepted", "fresh2h")


@query(f"WITH {_sql_classified()} SELECT source_id, count_if(breaking_pass) AS breaking_pass, count_if(topic_pass) AS topic_pass, count_if(accepted) AS accepted FROM classified GROUP BY source_id")
def g01_tallies(spark, d):
    return funnels.tallies(views.classified(_docs(spark, d), CLOCK))


@query("""WITH l AS (SELECT source, max(doc_id) AS m FROM documents GROUP BY source),
o AS (SELECT source, m % 5 = 0 AS ok, m % 5 = 1 AS empty, CASE WHEN m % 5 = 2 THEN 403 END AS status, m % 5 = 3 AS offline FROM l)
SELECT source AS source_id, CASE WHEN ok THEN '200' WHEN empty THEN 'empty_body' WHEN status IS NOT NULL THEN CAST(status AS VARCHAR) WHEN offline THEN 'offline' ELSE 'IOError' END AS status FROM o""")
def s12_status(spark, d):
    return _log(spark, d).select("source_id", funnels.status_label().alias("status"))


def _log(spark, d):
    last = _docs(spark, d).groupBy(F.col("source").alias("source_id")).agg((F.max("doc_id") % 5).alias("m"))
    return last.select("source_id", (F.col("m") == 0).alias("succeeded"), (F.col("m") == 1).alias("empty"), F.when(F.col("m") == 2, 403).alias("http_status"),
                       (F.col("m") == 3).alias("offline"), F.when(F.col("m") == 4, "IOError").alias("error_class"))


@query("""WITH l AS (SELECT source, max(doc_id) % 5 AS m FROM documents GROUP BY source),
o AS (SELECT coalesce(bool_or(m = 0), false) AS any_succeeded, count(*) > 0 AND NOT coalesce(bool_or(m = 0), false) AS all_failed, count(*) > 0 AND coalesce(bool_and(m = 3), false) AS offline, count_if(m <> 0) AS failures FROM l)
SELECT *, CASE WHEN offline THEN 'offline' WHEN all_failed THEN 'all_failed' WHEN failures > 0 THEN 'partial' ELSE 'none' END AS state FROM o""")
def s14_outcome(spark, d):
    return funnels.refresh_state(funnels.outcome(_log(spark, d)))


# -- table queries ---------------------------------------------------------------------------------------

_COLUMNS = "id, source_id, published_at, breaking_score, topic_score"
_KEPT = _COLUMNS.split(", ")


def _page_start(spark, d):
    return FIRST + 500 * STEP, "9"


@query(f"WITH {TABLE} SELECT {_COLUMNS} FROM articles WHERE published_at < {FIRST + 500 * STEP} OR (published_at = {FIRST + 500 * STEP} AND id < '9') ORDER BY published_at DESC, id DESC LIMIT 20")
def q01_timeline_page(spark, d):
    return store.timeline(_table(spark, d), _page_start(spark, d)).select(*_KEPT)


@query(f"WITH {TABLE} SELECT count(*) AS n FROM articles")
def q03_count(spark, d):
    return store.count_all(_table(spark, d))


@query(f"WITH {TABLE} SELECT count(*) AS n FROM articles WHERE published_at > {FIRST + 700 * STEP}")
def q04_count_newer(spark, d):
    return store.count_newer(_table(spark, d), FIRST + 700 * STEP)


@query(f"WITH {TABLE} SELECT coalesce(max(published_at), 0) AS published_at FROM articles")
def q05_newest(spark, d):
    return store.newest(_table(spark, d))


@query(f"WITH {TABLE} SELECT {_COLUMNS} FROM articles WHERE id = md5('https://src5.example.com/en/5') OR id = (SELECT min(id) FROM articles)")
def q06_by_id(spark, d):
    rows = _table(spark, d)
    least = rows.join(F.broadcast(rows.agg(F.min("id").alias("id"))), "id", "left_semi")  # one row
    return least.unionByName(store.by_id(rows, F.md5(F.lit("https://src5.example.com/en/5")))).select(*_KEPT).distinct()


@query(f"WITH {TABLE} SELECT {_COLUMNS}, day_bucket FROM articles WHERE day_bucket BETWEEN {(CLOCK - 43_200_000) // 43_200_000 - 1} AND {CLOCK // 43_200_000 + 1}")
def q07_in_buckets(spark, d):
    return store.in_buckets(_table(spark, d), (CLOCK - dates.WINDOW) // dates.WINDOW - 1, CLOCK // dates.WINDOW + 1).select(*_KEPT, "day_bucket")


@query(f"WITH {TABLE} SELECT {_COLUMNS} FROM articles WHERE canonical_url IN (SELECT canonical_url FROM raw WHERE seq % 10 = 3)")
def q08_by_urls(spark, d):
    urls = _articles(spark, d).where("seq % 10 = 3").select(text.canonical_url(F.col("url")).alias("canonical_url"))
    return store.by_urls(_table(spark, d), urls).select(*_KEPT)


@query(f"WITH {TABLE}, old AS (SELECT * FROM articles WHERE published_at % 5 = 0 AND hash_bucket(id) < 8), new AS (SELECT * FROM articles WHERE id NOT IN (SELECT id FROM old) AND canonical_url NOT IN (SELECT canonical_url FROM old)) SELECT {_COLUMNS} FROM new".replace("hash_bucket(id) < 8", "id < '8'"))
def q09_insert_ignore(spark, d):
    rows = _table(spark, d)
    return store.insert_ignore(rows.where("published_at % 5 = 0 AND id < '8'"), rows.unionByName(rows)).select(*_KEPT)


@query(f"WITH {TABLE} SELECT id, source_id, published_at, CAST(CASE WHEN id < '3' THEN 99 ELSE breaking_score END AS INTEGER) AS breaking_score, topic_score FROM articles")
def q10_update(spark, d):
    rows = _table(spark, d)
    return store.updated(rows, rows.where("id < '3'").withColumn("breaking_score", F.lit(99))).select(*_KEPT)


@query(f"WITH {TABLE} SELECT id, notified OR id > 'e' AS notified FROM articles")
def q11_mark_notified(spark, d):
    rows = _table(spark, d)
    return store.marked_notified(rows, rows.where("id > 'e'")).select("id", "notified")


@query(f"WITH {TABLE} SELECT {_COLUMNS} FROM articles WHERE NOT notified AND NOT seen_in_feed AND breaking_score >= 3 AND published_at >= {CLOCK - 86_400_000}")
def q12_pending(spark, d):
    return store.pending(_table(spark, d), 3, CLOCK - 86_400_000).select(*_KEPT)


@query(f"WITH {TABLE} SELECT {_COLUMNS} FROM articles WHERE published_at >= {CLOCK - 172_800_000}")
def q13_prune(spark, d):
    return store.kept(_table(spark, d), CLOCK - store.RETENTION).select(*_KEPT)


@query(f"WITH {TABLE} SELECT * FROM (SELECT id, CAST(row_number() OVER (ORDER BY published_at DESC, id DESC) - 1 AS INTEGER) AS position FROM articles) WHERE position < 200 AND id = (SELECT id FROM articles ORDER BY published_at DESC, id DESC LIMIT 1 OFFSET 50)")
def r07_position(spark, d):
    rows = _table(spark, d)
    wanted = store.latest(rows, 51).orderBy("published_at", "id").limit(1).select("id")
    return store.position(rows, wanted)


# -- joins and similarity --------------------------------------------------------------------------------

@query(f"WITH {ARTICLES}, {SOURCES} SELECT seq, coalesce(s.priority, 99) AS priority FROM raw LEFT JOIN (SELECT * FROM sources WHERE enabled) s ON s.id = raw.source_id")
def j02_priority(spark, d):
    return stories.with_priority(_articles(spark, d), views.sources(_docs(spark, d)).where("enabled")).select("seq", "priority")


@query(f"WITH {ARTICLES}, t AS (SELECT seq, published_at, array_to_string({_sql_dedupe_tokens(_sql_normalize('title'))}, ' ') AS n FROM raw) SELECT a.seq AS a, b.seq AS b FROM t a JOIN t b ON a.n = b.n AND a.seq < b.seq AND abs(a.published_at - b.published_at) <= 43200000")
def j04_same_title(spark, d):
    rows = _articles(spark, d).select("seq", "published_at", arabic.for_dedupe(F.col("title")).alias("n"))
    other = rows.select(F.col("seq").alias("b"), F.col("published_at").alias("at"), "n")
    return rows.join(other, "n").where((F.col("seq") < F.col("b")) & (F.abs(F.col("published_at") - F.col("at")) <= dates.WINDOW)).select(F.col("seq").alias("a"), "b")


def _sql_grams(c: str) -> str:
    return f"list_transform(generate_series(1, greatest(length({c}) - 1, 1)), lambda i: substr(' ' || {c} || ' ', i, 4))"


@query(f"""WITH {ARTICLES}, t AS (SELECT seq, published_at, {_sql_dedupe_tokens(_sql_normalize('title'))} AS words FROM raw),
u AS (SELECT seq, published_at, list_distinct(words) AS words, array_to_string(words, ' ') AS n FROM t),
g AS (SELECT seq, gram, count(*) AS c FROM (SELECT seq, unnest({_sql_grams('n')}) AS gram FROM u) GROUP BY seq, gram),
m AS (SELECT seq, sqrt(sum(c * c)) AS size FROM g GROUP BY seq),
p AS (SELECT a.seq AS a, b.seq AS b, a.words AS w1, b.words AS w2 FROM u a JOIN u b ON a.seq < b.seq AND abs(a.published_at - b.published_at) <= 43200000),
dot AS (SELECT x.seq AS a, y.seq AS b, sum(x.c * y.c) AS dot FROM g x JOIN g y ON x.gram = y.gram AND x.seq < y.seq GROUP BY x.seq, y.seq),
s AS (SELECT p.a, p.b, CASE WHEN len(w1) > 0 AND len(w2) > 0 THEN len(list_intersect(w1, w2)) / len(list_distinct(list_concat(w1, w2))) ELSE 0.0 END AS j, coalesce(dot.dot, 0) / (x.size * y.size) AS c
  FROM p LEFT JOIN dot ON dot.a = p.a AND dot.b = p.b JOIN m x ON x.seq = p.a JOIN m y ON y.seq = p.b)
SELECT a, b, round(j, 9) AS j, round(c, 9) AS c FROM s WHERE j >= 0.55 OR c >= 0.75 OR (j >= 0.40 AND c >= 0.45)""")
def j05_similar_titles(spark, d):
    rows = _articles(spark, d).select(F.col("seq").alias("node"), "published_at", arabic.for_dedupe(F.col("title")).alias("normalized_title"))
    return stories.similar_pairs(rows).select("a", "b", F.round("j", 9).alias("j"), F.round("c", 9).alias("c"))


@query("SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def d01_distinct_first(spark, d):
    return stories.distinct_first(read(spark, d, "pages"), F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1), F.col("page_id")).select("page_id", "url")


@query()
def d03_dedupe(spark, d):
    """The whole pass over an empty table: inserted rows with what was merged into them."""
    docs = _docs(spark, d)
    scored = scoring.accepted(views.classified(docs, CLOCK))
    empty = spark.createDataFrame([], stories.ARTICLE_COLUMNS)
    return stories.dedupe(scored, empty, views.sources(docs), CLOCK).to_insert


@query(f"WITH {TABLE} SELECT {_COLUMNS} FROM articles WHERE published_at BETWEEN {CLOCK - 172_800_000} AND {CLOCK + 3_600_000}")
def r03_timely(spark, d):
    return live.timely(_table(spark, d), CLOCK).select(*_KEPT)


@query(f"""WITH {ARTICLES}, t AS (SELECT seq, title, left(title, 60) AS half FROM raw),
g AS (SELECT seq, gram, count(*) AS c FROM (SELECT seq, unnest({_sql_grams('title')}) AS gram FROM t) GROUP BY seq, gram),
h AS (SELECT seq, gram, count(*) AS c FROM (SELECT seq, unnest({_sql_grams('half')}) AS gram FROM t) GROUP BY seq, gram),
x AS (SELECT seq, sum(g.c * h.c) AS dot FROM g JOIN h USING (seq, gram) GROUP BY seq)
SELECT t.seq, round(CASE WHEN trim(title) = '' OR trim(half) = '' THEN 0.0 ELSE coalesce(dot, 0) / sqrt((SELECT sum(c * c) FROM g WHERE g.seq = t.seq)) / sqrt((SELECT sum(c * c) FROM h WHERE h.seq = t.seq)) END, 9) AS cosine
FROM t LEFT JOIN x USING (seq)""")
def m05_text_cosine(spark, d):
    """Each title with its own first half."""
    return _articles(spark, d).select("seq", F.round(similarity.text_cosine(F.col("title"), F.left("title", F.lit(60))), 9).alias("cosine"))


# -- the table on disk -----------------------------------------------------------------------------------

_STORED = "id string, source_id string, canonical_url string, published_at long, breaking_score int, topic_score int, day_bucket long, notified boolean"
_PRUNE = FIRST + 100 * STEP


def _stored(spark, d):
    """A table that took all articles in two inserts, the second of which was offered everything."""
    table = store.ArticleStore(spark, new_path(spark, "articles"), _STORED)
    rows = materialize(_table(spark, d).select(*table.names), "table-rows")
    table.insert(rows.where(F.col("published_at") < FIRST_SYNC))
    table.insert(rows)
    return table, rows


def _changed(rows):
    return rows.where("id < '3'").withColumn("breaking_score", F.lit(99))


@query(f"WITH {TABLE} SELECT id, source_id, published_at, CAST(CASE WHEN id < '3' THEN 99 ELSE breaking_score END AS INTEGER) AS breaking_score, topic_score, day_bucket, notified OR id > 'e' AS notified FROM articles WHERE published_at >= {_PRUNE}")
def s15_keyed_writes(spark, d):
    """Two inserts, an update, marks and a prune, as the table holds them."""
    table, rows = _stored(spark, d)
    table.update(_changed(rows))
    table.mark_notified(rows.where("id > 'e'"))
    table.prune(_PRUNE)
    return table.read().select("id", "source_id", "published_at", "breaking_score", "topic_score", "day_bucket", "notified")


@query(f"WITH {TABLE} SELECT {_COLUMNS} FROM articles ORDER BY published_at DESC, id DESC LIMIT 200")
def q02_stored_latest(spark, d):
    """The newest 200 from the files that are sure to hold them."""
    return _stored(spark, d)[0].latest().select(*_KEPT)


@query(f"WITH {TABLE} SELECT {_COLUMNS} FROM articles WHERE published_at < {FIRST + 500 * STEP} OR (published_at = {FIRST + 500 * STEP} AND id < '9') ORDER BY published_at DESC, id DESC LIMIT 20")
def q01_stored_page(spark, d):
    return _stored(spark, d)[0].timeline(_page_start(spark, d)).select(*_KEPT)


@query(f"WITH {TABLE}, c AS (SELECT id, breaking_score, 'delete' AS change FROM articles WHERE id < '3' UNION ALL SELECT id, 99, 'insert' FROM articles WHERE id < '3') SELECT id, CAST(breaking_score AS INTEGER) AS breaking_score, change FROM c")
def r01_changes(spark, d):
    """What an update changed, row by row."""
    table, rows = _stored(spark, d)
    table.update(_changed(rows))
    return table.changes(table.versions()[-1]).select("id", "breaking_score", F.col("_change").alias("change"))


# -- events as a timeline --------------------------------------------------------------------------------

@query("SELECT event_id, (epoch_us(ts) // 1000) AS published_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def e02_latest_events(spark, d):
    rows = read(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("published_at"), F.col("event_id").alias("id"))
    return store.latest(rows).select(F.col("id").alias("event_id"), "published_at")


@query("SELECT event_type, count(*) AS n, max((epoch_us(ts) // 1000)) AS newest FROM events WHERE (epoch_us(ts) // 1000) >= (SELECT max((epoch_us(ts) // 1000)) FROM events) - 172800000 GROUP BY event_type")
def e13_recent_by_type(spark, d):
    rows = read(spark, d, "events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("published_at"))
    newest = F.broadcast(rows.agg(F.max("published_at").alias("newest")))  # one row
    return store.kept(rows.join(newest, F.lit(True)), F.col("newest") - store.RETENTION).groupBy("event_type").agg(F.count("*").alias("n"), F.max("published_at").alias("newest"))
