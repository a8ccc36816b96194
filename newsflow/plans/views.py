"""The driver's tables as news data: articles from ``documents``, sources, and a Latin test vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions import arabic, dates, text
from newsflow.operators.classify import classify
from newsflow.sources.vocabulary import ANALYSIS_PREFIXES, BREAKING, BREAKING_EXCLUSIONS, ECONOMY, EVENT_WORDS, NEGATIVE, POLITICS, Vocabulary, Weights

FIRST, STEP = 1_704_067_200_000, 420_000
#: Latin phrases that occur in the test texts, so that every signal fires.
LATIN = Vocabulary(
    breaking=("the of", "que", "und"), breaking_exclusions=("and the of",), breaking_paths=("/fr/",), politics=("the", "la", "die"), economy=("of", "le", "in"),
    topic_paths=("/en/", "/es/"), negative=("with", "sch"), negative_paths=("/de/",), analysis_prefixes=("that", "la"), event_verbs=("is", "en", "zu", "on"), religious_events=("by",))
WEIGHTS = Weights(min_topic=3)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def now_ms(sf_dir_rows: int) -> int:
    return FIRST + sf_dir_rows * STEP


def raw_articles(documents: DataFrame) -> DataFrame:
    """source_id, title, summary, url, published_at, image_url, categories, seq."""
    whole = F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", " ")
    return documents.select(
        F.col("source").alias("source_id"), F.left(whole, F.lit(120)).alias("title"), text.truncate(F.col("text"), text.SUMMARY_CHARS).alias("summary"),
        F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("/?utm_source=x")).alias("url"),
        (F.lit(FIRST) + F.col("doc_id") * STEP).alias("published_at"), F.lit(None).cast("string").alias("image_url"),
        F.array("lang").alias("categories"), F.col("doc_id").alias("seq"))


#: Words that Arabic test titles are made of: the default vocabulary with every tenth event word, and forms that normalization has to fold, cut or leave.
ARABIC_WORDS = (*POLITICS, *ECONOMY, *NEGATIVE, *ANALYSIS_PREFIXES, *BREAKING, *BREAKING_EXCLUSIONS, *EVENT_WORDS[::10], "والحكومة", "بالاتفاق", "فالجيش", "للرئيس", "إسرائيل", "أُمَّة", "مـــدينة",
                "شيء", "مؤتمر", "٢٠٢٦", "۱۲", "ﷺ", "قال،", "؟", "http://a.b/c", "www.x.y", "رويترز", "في", "من", "و", "word", "The")


def arabic_articles(documents: DataFrame) -> DataFrame:
    """``raw_articles`` with titles of at most twelve Arabic words, each chosen by the place and length of a word of the text."""
    rows = raw_articles(documents)
    list_ = F.array(*[F.lit(w) for w in ARABIC_WORDS])
    chosen = F.transform(F.split("title", " "), lambda w, i: F.element_at(list_, ((F.char_length(w) * 37 + i * 101 + F.col("seq") * 11) % len(ARABIC_WORDS) + 1).cast("int")))
    return rows.withColumn("title", F.array_join(F.slice(chosen, 1, 12), " "))


#: Documents of one test feed: a feed's items are all read up to 200.
FEED_DOCUMENTS = 150


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _tag(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<{name}>"), _escaped(value), F.lit(f"</{name}>")), F.lit(""))


def feed_bodies(documents: DataFrame) -> DataFrame:
    """(source_id, url, body): feeds of 150 documents each, RSS and Atom by turns; titles as in ``raw_articles``, whole texts as descriptions."""
    rows = raw_articles(documents).join(documents.select(F.col("doc_id").alias("seq"), "text"), "seq").withColumn("feed", F.floor(F.col("seq") / FEED_DOCUMENTS))
    at, guid = F.timestamp_millis("published_at"), F.concat(F.lit("https://guid.example.com/"), F.col("seq").cast("string"))
    rss = F.concat(F.lit("<item>"), _tag("title", F.col("title")), _tag("link", F.col("url")), _tag("description", F.col("text")), _tag("category", F.col("categories")[0]),
                   F.lit("<pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>"), _tag("guid", guid), F.lit("</item>"))
    link = F.coalesce(F.concat(F.lit('<link rel="self" href="https://self"/><link href="'), _escaped(F.col("url")), F.lit('"/>')), F.lit(""))
    atom = F.concat(F.lit("<entry>"), _tag("id", guid), link, _tag("title", F.col("title")), F.coalesce(F.concat(F.lit('<category term="'), F.col("categories")[0], F.lit('"/>')), F.lit("")),
                    F.lit("<updated>"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated>"), _tag("summary", F.col("text")), F.lit("</entry>"))
    item = F.when(F.col("feed") % 2 == 0, rss).otherwise(atom)
    feeds = rows.select("feed", F.struct("seq", item.alias("item")).alias("x")).groupBy("feed").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    joined = F.array_join(F.transform("xs", lambda x: x["item"]), "\n")
    body = F.when(F.col("feed") % 2 == 0, F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE rss [<!ENTITY a "b">]><rss><channel><title>feed</title>'), joined, F.lit("</channel></rss>"))).otherwise(
        F.concat(F.lit("<feed><title>feed</title>"), joined, F.lit("</feed>")))
    return feeds.select(F.concat(F.lit("feed"), F.col("feed").cast("string")).alias("source_id"), F.lit("https://feeds.example.com/").alias("url"), body.alias("body"))


def feed_sources(documents: DataFrame) -> DataFrame:
    """A registry of the feeds of ``feed_bodies``; every seventh is disabled."""
    feed = documents.select(F.floor(F.col("doc_id") / FEED_DOCUMENTS).alias("feed")).distinct()
    return feed.select(F.concat(F.lit("feed"), F.col("feed").cast("string")).alias("id"), F.when(F.col("feed") % 2 == 0, "rss").otherwise("atom").alias("adapter"), (F.col("feed") % 7 != 6).alias("enabled"),
                       F.lit(None).cast("struct<pattern:string,replacement:string>").alias("imageRewrite"))


def sources(documents: DataFrame) -> DataFrame:
    """Outlets by name: priority is their number, number 19 is disabled."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return documents.select("source").where("source IS NOT NULL").distinct().select(
        F.col("source").alias("id"), F.concat(F.lit("Outlet "), "source").alias("name"), number.alias("priority"), F.lit("rss").alias("adapter"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/feed")).alias("url"), F.concat("source", F.lit(".example.com")).alias("domain"),
        F.lit("#71767B").alias("color"), (number != 19).alias("enabled"))


def classified(documents: DataFrame, clock: int) -> DataFrame:
    return classify(raw_articles(documents), clock, LATIN, WEIGHTS)


def article_table(documents: DataFrame, clock: int) -> DataFrame:
    """Accepted and rejected rows alike in the stored shape, for table queries."""
    rows = classified(documents, clock)
    canonical = text.canonical_url(F.col("url"))
    return rows.select(
        F.md5(canonical).alias("id"), "source_id", "title", canonical.alias("canonical_url"), "published_at", F.lit(clock).cast("long").alias("fetched_at"),
        F.col("classification.breaking_score").alias("breaking_score"), F.col("classification.topic_score").alias("topic_score"),
        arabic.for_dedupe(F.col("title")).alias("normalized_title"), dates.day_bucket(F.col("published_at")).alias("day_bucket"),
        (F.col("seq") % 7 == 0).alias("notified"), (F.col("seq") % 3 == 0).alias("seen_in_feed"))
