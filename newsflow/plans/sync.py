"""The sync pipeline: fetch log and articles in, table and funnel out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.functions.dates import WINDOW
from newsflow.operators import funnel as funnels
from newsflow.operators.classify import accepted, classify
from newsflow.operators.dedupe import Resolved, dedupe
from newsflow.operators.store import RETENTION, ArticleStore
from newsflow.sources.vocabulary import Vocabulary, Weights
from newsflow.tables import materialize


@dataclass
class SyncOutcome:
    """Counts of one sync, the rows it inserted and its funnel; ``resolved`` is None if no source answered."""

    fetched: int
    accepted: int
    inserted: DataFrame | None
    n_inserted: int
    updated: int
    pruned: int
    funnel: DataFrame | None
    resolved: Resolved | None = None


def bucket(ms: int) -> int:
    return int(ms / WINDOW)


#: How long a sync may hold the table before another takes over.
LEASE_MS = 10 * 60_000


def sync_once(owner: str, store: ArticleStore, run: Callable[[], SyncOutcome], now_ms: int | None = None, lease_ms: int = LEASE_MS) -> SyncOutcome | None:
    """``run`` under the table's lease; None, and nothing run, while another owner holds it.

    A dead owner's lease runs out and is taken over; what the dead one still tries to write is refused.
    """
    if not store.acquire(owner, lease_ms, now_ms):
        return None
    try:
        return run()
    finally:
        store.release()


def sync(articles: DataFrame, fetch_log: DataFrame, store: ArticleStore, sources: DataFrame, now_ms: int, foreground: bool = False,
         vocabulary: Vocabulary | None = None, weights: Weights | None = None) -> SyncOutcome:
    """Classify, de-duplicate against the stored window, insert, update and prune.

    ``articles`` has source_id, title, summary, url, published_at, image_url, categories and ``seq``, the fetch
    order.  Without any source that answered nothing is touched.
    """
    if not funnels.outcome(fetch_log).first()["any_succeeded"]:
        return SyncOutcome(0, 0, None, 0, 0, 0, None)
    classified = materialize(classify(articles, now_ms, vocabulary, weights), "classified")
    scored = accepted(classified)
    window = store.read_buckets(bucket(now_ms - WINDOW) - 1, bucket(now_ms) + 1)
    resolved = dedupe(scored, window, sources, now_ms, foreground)
    to_insert, to_update = materialize(resolved.to_insert, "to-insert"), materialize(resolved.to_update, "to-update")
    inserted = store.insert(to_insert)
    n_updated = to_update.count()
    if n_updated:
        store.update(to_update)
    pruned = store.prune(now_ms - RETENTION)
    store.compact()
    by_source = to_insert.groupBy("source_id").agg(F.count("*").alias("n"))
    table = funnels.funnel(fetch_log, classified, resolved.merged_away, resolved.already_stored, by_source, now_ms)
    n = classified.agg(F.count("*").alias("fetched"), F.count_if("classification.accepted").alias("accepted")).first()
    return SyncOutcome(n["fetched"], n["accepted"], inserted, inserted.count(), n_updated, pruned, table, resolved)


def summary(outcome: SyncOutcome, spark) -> DataFrame:
    row = (outcome.fetched, outcome.accepted, outcome.n_inserted, outcome.updated, outcome.pruned)
    return spark.createDataFrame([row], "fetched long, accepted long, inserted long, updated long, pruned long")
