"""Structured Streaming: micro-batches as syncs, and live views of the table.

State across batches is the article table itself, so a restarted query goes on from it; event time only
bounds what Spark keeps (``late_rows``), while the rules drop future-dated items and prune old ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsflow.functions.dates import SKEW
from newsflow.operators.store import LATEST, RETENTION, ArticleStore, count_newer
from newsflow.plans.sync import SyncOutcome, sync
from newsflow.sources.vocabulary import Vocabulary, Weights


def timely(articles: DataFrame, now_ms: int) -> DataFrame:
    """Rows dated at most an hour ahead and within retention."""
    return articles.where(F.col("published_at").between(now_ms - RETENTION, now_ms + SKEW))


def late_rows(articles: DataFrame, delay: str = "48 hours") -> DataFrame:
    """A stream with its event time and the delay after which Spark may forget it."""
    return articles.withColumn("event_time", F.timestamp_millis("published_at")).withWatermark("event_time", delay)


def distinct_urls(articles: DataFrame, delay: str = "48 hours") -> DataFrame:
    """A stream without repeats of a canonical URL inside the delay (the equal-URL rule alone)."""
    return late_rows(articles, delay).dropDuplicatesWithinWatermark(["canonical_url"])


def start_sync(articles: DataFrame, store: ArticleStore, sources: DataFrame, clock: Callable[[], int], checkpoint: str,
               vocabulary: Vocabulary | None = None, weights: Weights | None = None, on_outcome: Callable[[int, SyncOutcome], None] | None = None) -> StreamingQuery:
    """Sync every micro-batch of ``articles`` into ``store``; N batches equal N syncs at the same clock."""

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("seq", F.monotonically_increasing_id()) if "seq" not in batch.columns else batch
        log = rows.select("source_id").distinct().select(
            "source_id", F.col("source_id").alias("source_name"), F.lit(True).alias("succeeded"), F.lit(False).alias("empty"), F.lit(None).cast("int").alias("http_status"),
            F.lit(False).alias("offline"), F.lit(None).cast("string").alias("error_class"), F.lit(None).cast("string").alias("error"))
        outcome = sync(rows, log, store, sources, clock(), False, vocabulary, weights)
        if on_outcome:
            on_outcome(number, outcome)

    return articles.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def commits(store: ArticleStore) -> DataFrame:
    """A stream of the table's versions (version, operation), read from its manifests; Spark keeps which were seen."""
    return (store.spark.readStream.schema("version long, operation string").option("pathGlobFilter", "v*.json").option("ignoreMissingFiles", True).json(f"{store.path}/manifest")
            .where("version IS NOT NULL"))


class LiveLatest:
    """The newest ``n`` rows, kept up to date by the changes of each version.

    A version whose changed rows all lie outside reads its own new and dropped files only and emits nothing.  One that adds rows is merged
    with the rows held; one that takes rows away from them looks the newest up by the files' times.
    """

    def __init__(self, store: ArticleStore, emit: Callable[[int, list], None], n: int = LATEST):
        self.store, self.emit, self.n = store, emit, n
        self.version, self.rows = None, []

    def _look_up(self, version: int) -> list:
        return self.store.latest(self.n).collect()

    def see(self, version: int) -> None:
        """Takes in one version; versions that were seen, or whose files are gone, change nothing or start anew."""
        if self.version is not None and version <= self.version:
            return
        known = self.store.versions()
        if self.version is None or version != self.version + 1 or version not in known:
            now = self._look_up(version)
        else:
            changes = self.store.changes(version)
            if len(self.rows) == self.n:
                edge = self.rows[-1]
                changes = changes.where((F.col("published_at") > edge.published_at) | ((F.col("published_at") == edge.published_at) & (F.col("id") >= edge.id)))
            held = {r.id for r in self.rows}
            came = changes.where("_change = 'insert'").drop("_change").orderBy(F.desc("published_at"), F.desc("id")).limit(self.n).collect()
            left = {r.id for r in changes.where("_change = 'delete'").select("id").where(F.col("id").isin(*held) if held else F.lit(False)).collect()}
            if left - {r.id for r in came} and len(self.rows) == self.n:
                now = self._look_up(version)
            else:
                merged = {r.id: r for r in self.rows if r.id not in left} | {r.id: r for r in came}
                now = sorted(merged.values(), key=lambda r: (r.published_at, r.id), reverse=True)[:self.n]
        first, self.version = self.version is None, version
        if first or now != self.rows:
            self.rows = now
            self.emit(version, now)

    def start(self, checkpoint: str) -> StreamingQuery:
        def batch(seen: DataFrame, _: int) -> None:
            for r in seen.select("version").orderBy("version").toLocalIterator():
                self.see(r.version)

        return commits(self.store).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


class NewCounter:
    """How many stories are newer than a mark that the reader sets; none before the first mark."""

    def __init__(self, store: ArticleStore):
        self.store, self.mark = store, None

    def mark_seen(self) -> None:
        self.mark = self.store.read().agg(F.coalesce(F.max("published_at"), F.lit(0))).first()[0]

    def count(self) -> int:
        return count_newer(self.store.read(), self.mark).first()["n"]
