"""The article table - files of one 12-hour bucket each, keyed writes, reads by time - and the timeline queries.

Query functions take any article DataFrame; ``ArticleStore`` reads no more files for them than can matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.operators.dedupe import ARTICLE_COLUMNS
from newsflow.operators.table import KeyedTable
from newsflow.tables import few, materialize

RETENTION = 48 * 3_600_000
PAGE, LATEST = 20, 200


# -- queries ---------------------------------------------------------------------------------------

def timeline(articles: DataFrame, after: tuple[int, str] | None = None, page: int = PAGE) -> DataFrame:
    """A page, newest first; ``after`` is the (published_at, id) of the last row seen (a keyset cursor)."""
    rows = articles
    if after is not None:
        at, last = after
        rows = rows.where((F.col("published_at") < at) | ((F.col("published_at") == at) & (F.col("id") < last)))
    return rows.orderBy(F.desc("published_at"), F.desc("id")).limit(page)


def latest(articles: DataFrame, n: int = LATEST) -> DataFrame:
    return articles.orderBy(F.desc("published_at"), F.desc("id")).limit(n)


def count_all(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("n"))


def count_newer(articles: DataFrame, mark_ms: int | None) -> DataFrame:
    """Rows published after the mark; without a mark none is new."""
    if mark_ms is None:
        return articles.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"))
    return articles.where(F.col("published_at") > mark_ms).agg(F.count("*").alias("n"))


def newest(articles: DataFrame) -> DataFrame:
    return articles.agg(F.coalesce(F.max("published_at"), F.lit(0)).alias("published_at"))


def by_id(articles: DataFrame, id_: str | Column) -> DataFrame:
    return articles.where(F.col("id") == id_)


def in_buckets(articles: DataFrame, lowest: int, highest: int) -> DataFrame:
    """A partition-pruned range."""
    return articles.where(F.col("day_bucket").between(lowest, highest))


def by_urls(articles: DataFrame, urls: DataFrame) -> DataFrame:
    return articles.join(urls.select("canonical_url"), "canonical_url", "left_semi")


def pending(articles: DataFrame, min_breaking: int, since_ms: int) -> DataFrame:
    """Rows to announce: not announced, not seen in the feed, urgent enough, recent enough."""
    return articles.where(~F.col("notified") & ~F.col("seen_in_feed") & (F.col("breaking_score") >= min_breaking) & (F.col("published_at") >= since_ms)).orderBy(F.desc("published_at"))


def insert_ignore(articles: DataFrame, rows: DataFrame, order: Column | None = None) -> DataFrame:
    """The rows that are new: neither id nor canonical URL stored, and the first of their kind among ``rows``."""
    order = F.col("published_at") if order is None else order
    once = rows
    for key in ("id", "canonical_url"):
        once = once.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order, "id", "canonical_url"))).where("_n = 1").drop("_n")
    return once.join(articles.select("id"), "id", "left_anti").join(articles.select("canonical_url"), "canonical_url", "left_anti").select(*rows.columns)


def updated(articles: DataFrame, rows: DataFrame) -> DataFrame:
    """``articles`` with rows of the same id replaced; unknown ids change nothing."""
    known = rows.join(articles.select("id"), "id", "left_semi").select(*articles.columns)
    return articles.join(rows.select("id"), "id", "left_anti").select(*articles.columns).unionByName(known)


def marked_notified(articles: DataFrame, ids: DataFrame) -> DataFrame:
    hit = articles.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("notified", F.col("notified") | F.coalesce("_hit", F.lit(False))).select(*articles.columns)


def kept(articles: DataFrame, cutoff_ms: int | Column) -> DataFrame:
    return articles.where(F.col("published_at") >= cutoff_ms)


def position(articles: DataFrame, id_: str | DataFrame, n: int = LATEST) -> DataFrame:
    """Index of a row in the timeline (from 0); of one id, or of those of a few rows."""
    order = Window.orderBy(F.desc("published_at"), F.desc("id"))  # over at most n rows
    placed = latest(articles, n).withColumn("position", F.row_number().over(order) - 1)
    placed = placed.where(F.col("id") == id_) if isinstance(id_, str) else placed.join(id_.select("id"), "id", "left_semi")
    return placed.select("id", "position")


def displayed(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their outlet: name, colour and domain by default where the source is unknown."""
    known = few(sources.select(F.col("id").alias("source_id"), F.col("name").alias("_name"), F.col("color").alias("_color"), F.col("domain").alias("_domain")))
    rows = articles.join(known, "source_id", "left")
    name = F.coalesce("_name", "source_id")
    return rows.withColumns({
        "source_name": name, "source_color": F.coalesce("_color", F.lit("#71767B")), "source_domain": F.coalesce("_domain", F.lit("")),
        "extra_sources": F.size("duplicate_source_ids"), "monogram": F.substring(F.trim(name), 1, 1)}).drop("_name", "_color", "_domain")


# -- the table -------------------------------------------------------------------------------------

class ArticleStore(KeyedTable):
    """The article table; ``columns`` may be fewer than an article's, with id, canonical_url, published_at and day_bucket among them."""

    def __init__(self, spark: SparkSession, path: str, columns: str = ARTICLE_COLUMNS, **more):
        super().__init__(spark, path, columns, **more)

    def insert(self, rows: DataFrame) -> DataFrame:
        """Insert what is new, as files of their own; returns those rows."""
        base = self.manifest()
        fresh = materialize(insert_ignore(self.read(base["files"]), rows), "inserted")
        self.append(fresh, base)
        return fresh

    def update(self, rows: DataFrame) -> None:
        """Rows of the same id are replaced, in the files that hold them and, where their time has changed, in their new bucket."""
        self.rewrite(rows, lambda held: updated(held, rows), "update")

    def mark_notified(self, ids: DataFrame) -> None:
        self.rewrite(ids, lambda held: marked_notified(held, ids), "notify")

    def latest(self, n: int = LATEST) -> DataFrame:
        """The newest rows, from the files that are sure to hold them."""
        return latest(self.read(self.newest_files(n)), n)

    def timeline(self, after: tuple[int, str] | None = None, page: int = PAGE) -> DataFrame:
        return timeline(self.read(self.newest_files(page, after)), after, page)

    def position(self, id_: str, n: int = LATEST) -> DataFrame:
        return position(self.read(self.newest_files(n)), id_, n)
