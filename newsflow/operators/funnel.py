"""Per-source funnel: stage tallies, freshness, losses, totals, alerts and a fixed-width rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE = 60_000
LOSS_ALERT = 60
COUNTS = ("parsed", "breaking_pass", "topic_pass", "accepted", "deduped_away", "already_stored", "inserted", "fresh30m", "fresh2h")


def tallies(classified: DataFrame) -> DataFrame:
    """(source_id, breaking_pass, topic_pass, accepted); the first two ignore the event gate."""
    c = "classification"
    return classified.groupBy("source_id").agg(F.count_if(f"{c}.breaking_pass").alias("breaking_pass"), F.count_if(f"{c}.topic_pass").alias("topic_pass"),
                                               F.count_if(f"{c}.accepted").alias("accepted"))


def freshness(articles: DataFrame, now_ms: int) -> DataFrame:
    """(source_id, parsed, fresh30m, fresh2h, newest_age_minutes); bands are cumulative and leave future items out."""
    age = F.lit(now_ms) - F.col("published_at")
    least = F.min(age)
    return articles.groupBy("source_id").agg(
        F.count("*").alias("parsed"), F.count_if(age.between(0, 30 * MINUTE)).alias("fresh30m"), F.count_if(age.between(0, 120 * MINUTE)).alias("fresh2h"),
        ((least - least % MINUTE) / MINUTE).cast("long").alias("newest_age_minutes"))


def status_label(log: Column | None = None) -> Column:
    """What came of a fetch, from a fetch log's columns succeeded, empty, http_status, offline and error_class."""
    return (F.when(F.col("succeeded"), "200").when(F.col("empty"), "empty_body").when(F.col("http_status").isNotNull(), F.col("http_status").cast("string"))
            .when(F.col("offline"), "offline").otherwise(F.coalesce("error_class", F.lit(""))))


def outcome(fetch_log: DataFrame) -> DataFrame:
    """(any_succeeded, all_failed, offline, failures) over all sources; false of no sources."""
    some = F.count("*") > 0
    any_ok = F.coalesce(F.bool_or("succeeded"), F.lit(False))
    return fetch_log.agg(any_ok.alias("any_succeeded"), (some & ~any_ok).alias("all_failed"),
                         (some & F.coalesce(F.bool_and(~F.col("succeeded") & F.col("offline")), F.lit(False))).alias("offline"), F.count_if(~F.col("succeeded")).alias("failures"))


def refresh_state(fetch_outcome: DataFrame) -> DataFrame:
    """What a reader is told: offline, all failed, partly failed or nothing."""
    return fetch_outcome.withColumn("state", F.when(F.col("offline"), "offline").when(F.col("all_failed"), "all_failed").when(F.col("failures") > 0, "partial").otherwise("none"))


def loss_percent(away: Column, accepted: Column) -> Column:
    return F.when(accepted == 0, F.lit(0)).otherwise(F.floor(away * 100 / F.greatest(accepted, F.lit(1))).cast("int"))


def stages(classified: DataFrame, now_ms: int) -> DataFrame:
    """Tallies and freshness of one table in one pass."""
    c = "classification"
    age = F.lit(now_ms) - F.col("published_at")
    least = F.min(age)
    return classified.groupBy("source_id").agg(
        F.count("*").alias("parsed"), F.count_if(age.between(0, 30 * MINUTE)).alias("fresh30m"), F.count_if(age.between(0, 120 * MINUTE)).alias("fresh2h"),
        ((least - least % MINUTE) / MINUTE).cast("long").alias("newest_age_minutes"), F.count_if(f"{c}.breaking_pass").alias("breaking_pass"),
        F.count_if(f"{c}.topic_pass").alias("topic_pass"), F.count_if(f"{c}.accepted").alias("accepted"))


def funnel(fetch_log: DataFrame, classified: DataFrame, merged_away: DataFrame, already_stored: DataFrame, inserted: DataFrame, now_ms: int) -> DataFrame:
    """One row per fetched source, zero rows included.  Every joined side is an aggregate by source."""
    named = lambda df, name: df.select("source_id", F.col("n").alias(name))
    out = fetch_log.select("source_id", "source_name", status_label().alias("status"), "error")
    for side in (stages(classified, now_ms), named(merged_away, "deduped_away"), named(already_stored, "already_stored"), named(inserted, "inserted")):
        out = out.join(side, "source_id", "left")
    out = out.na.fill(0, [*COUNTS, "newest_age_minutes"])
    return out.select("source_id", "source_name", "status", *COUNTS, "newest_age_minutes", "error", loss_percent(F.col("deduped_away"), F.col("accepted")).alias("loss_percent"))


def alerts(rows: DataFrame, over: int = LOSS_ALERT) -> DataFrame:
    """Sources that lose more than ``over`` percent of what was accepted."""
    return rows.where((F.col("accepted") > 0) & (F.col("loss_percent") > over))


def with_totals(rows: DataFrame) -> DataFrame:
    """The counts by source and a row TOTAL."""
    return rows.rollup("source_id").agg(*[F.sum(c).alias(c) for c in COUNTS]).withColumn("source_id", F.coalesce("source_id", F.lit("TOTAL")))


#: Heading, column and width of the rendered table; negative widths pad on the right.
LAYOUT = (("source", "source_id", -13), ("status", "status", -7), ("parsed", "parsed", 6), ("<30m", "fresh30m", 6), ("<2h", "fresh2h", 6), ("newest", "newest", 6),
          ("brk", "breaking_pass", 5), ("top", "topic_pass", 5), ("accept", "accepted", 6), ("lost", "deduped_away", 6), ("ins", "inserted", 5))


def render(rows: DataFrame) -> str:
    """The funnel as fixed-width text (a row per source: small by nature)."""
    def line(values: dict) -> str:
        return " ".join(str(values.get(c, "")).ljust(-w) if w < 0 else str(values.get(c, "")).rjust(w) for _, c, w in LAYOUT)

    data = [r.asDict() | {"newest": f"{r['newest_age_minutes']}m"} for r in rows.orderBy("source_id").collect()]
    head = line({c: title for title, c, _ in LAYOUT})
    total = {c: sum(d[c] for d in data) for c in COUNTS} | {"source_id": "TOTAL"}
    rule = "-" * len(head)
    return "\n".join([head, rule, *[line(d) + (f"  <- {d['error']}" if d["error"] else "") for d in data], rule, line(total)])
