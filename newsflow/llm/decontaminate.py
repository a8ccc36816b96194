"""Benchmark decontamination: a prefix-filtered set join.  DataFrame functions only.

An item's windows are sets of word shingles, all of which a document must hold, so one necessary
shingle per window - its rarest in the corpus - is enough to find every candidate.

1. One pass over the documents keeps the positions of benchmark shingles ("postings"): a row per
   position is made and joined with the benchmark's distinct shingles, in the same stage where these
   are few (a checked bound), else by shuffle.  No text is shuffled.
2. Shingle frequencies are counted over all postings; each window's rarest shingle is its prefix token.
3. Postings of prefix tokens propose (document, item, offset); length and position bounds drop those
   whose window can't fit.
4. Proposed offsets are verified: runs of consecutive matching item shingles at one offset are found, and
   a run holds a window where it spans the window's words.  Their words are hit.

Defined cases: null texts have no words; a null ``item_id`` is no item; items of one id are windowed
apart and counted once; repeated documents are judged row by row; no items or no documents give zero
hits or no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.runtime import materialize

#: What is no word, after A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, SHINGLE = 13, 5
#: Up to so many distinct benchmark shingles (16 bytes each) they are sent to every executor.
BROADCAST_SHINGLES = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD, -1), lambda w: w != "")


def shingle_hashes(words_: Column, length: int) -> Column:
    """The hash of every run of ``length`` words, by position."""
    at = F.when(F.size(words_) >= length, F.sequence(F.lit(1), F.size(words_) - (length - 1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(length), F.slice(words_, i, length)))


def item_shingles(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(b, item_id, n_item, q, span, ipos, h): q words a shingle, span words a window."""
    items = (benchmark.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w"))
             .withColumn("n_item", F.size("w")).where("n_item > 0").withColumn("b", F.xxhash64("item_id", "w")).distinct())
    items = items.withColumn("span", F.least("n_item", F.lit(window))).withColumn("q", F.least("span", F.lit(shingle)))
    pick = F.coalesce(*[F.when(F.col("q") == q, shingle_hashes(F.col("w"), q)) for q in range(1, shingle + 1)])
    return items.select("b", "item_id", "n_item", "q", "span", F.posexplode(pick).alias("ipos", "h"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(rid, doc_id, n_words, n_hit, n_items, item_ids): one row per document."""
    if window < shingle:
        shingle = window
    items = materialize(item_shingles(benchmark, window, shingle), "bench-items")
    facts = items.agg(F.collect_set("q").alias("qs"), F.countDistinct("h").alias("n")).first()
    wanted = items.select("h").distinct()
    if facts["n"] <= broadcast_shingles:
        wanted = F.broadcast(wanted)

    split = documents.select("doc_id", F.monotonically_increasing_id().alias("rid"), words(F.col("text")).alias("w"))
    hashed = [F.transform(shingle_hashes(F.col("w"), q), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for q in sorted(facts["qs"])]
    nothing = F.expr("cast(array() as array<struct<pos:int,h:bigint>>)")
    # the position -1 carries a document's length, so that the text is read once
    length = F.array(F.struct(F.lit(-1).alias("pos"), F.size("w").cast("long").alias("h")))
    rows = split.select("rid", "doc_id", F.explode(F.concat(length, *hashed) if hashed else F.concat(length, nothing)).alias("s"))
    rows = rows.select("rid", "doc_id", F.col("s.pos").alias("pos"), F.col("s.h").alias("h"))
    kept = rows.join(wanted.withColumn("hit", F.lit(True)), "h", "left").where("hit OR pos = -1").select("rid", "doc_id", "pos", "h")
    kept = materialize(kept, "bench-postings")
    docs = kept.where("pos = -1").select("rid", "doc_id", F.col("h").alias("n_words"))
    postings = kept.where("pos >= 0").select("rid", "pos", "h")

    hits = _verified(postings, docs, items)
    per_doc = _union_length(hits)
    matched = hits.groupBy("rid").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    return (docs.join(per_doc, "rid", "left").join(matched, "rid", "left")
            .select("rid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce(F.array_sort("item_ids"), F.expr("cast(array() as array<string>)")).alias("item_ids")))


def _verified(postings: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(rid, item_id, first, last): runs of document words that windows of an item cover."""
    frequency = postings.groupBy("h").agg(F.count("*").alias("df"))
    ranked = items.join(frequency, "h")
    # a window's shingles are the next span - q + 1; the rarest of them, ties to the first, is its prefix token
    by_place = Window.partitionBy("b").orderBy("ipos")
    starts = F.col("span") - F.col("q")
    tokens = []
    for places in (window_places for window_places in sorted({r[0] for r in items.select(starts).distinct().collect()})):
        ahead = by_place.rangeBetween(0, places)
        part = ranked.where(starts == places)
        best = F.min(F.struct("df", "ipos")).over(ahead)
        complete = F.count("*").over(ahead) == places + 1
        tokens.append(part.withColumn("best", best).withColumn("complete", complete).where("complete").select("b", F.col("best.ipos").alias("ipos")).distinct())
    if not tokens:
        return postings.limit(0).select("rid", F.lit("").alias("item_id"), F.col("pos").alias("first"), F.col("pos").alias("last"))
    prefix = tokens[0]
    for more in tokens[1:]:
        prefix = prefix.unionByName(more)
    prefix = ranked.join(prefix, ["b", "ipos"], "left_semi").select("h", "b", "n_item", "span", "q", "ipos")

    diagonal = (F.col("pos") - F.col("ipos")).alias("diag")
    fits = (F.col("diag") + F.col("n_item") >= F.col("span")) & (F.col("n_words") - F.col("diag") >= F.col("span"))
    proposed = (postings.join(prefix, "h").select("rid", "b", "n_item", "span", diagonal).distinct()
                .join(docs.select("rid", "n_words"), "rid").where(fits).select("rid", "b", "diag"))
    matches = postings.join(ranked.select("h", "b", "item_id", "span", "q", "ipos"), "h").select("rid", "b", diagonal, "item_id", "span", "q", "ipos", "pos")
    matches = matches.join(proposed, ["rid", "b", "diag"], "left_semi")
    along = Window.partitionBy("rid", "b", "diag").orderBy("ipos")
    runs = matches.withColumn("run", F.col("ipos") - F.row_number().over(along))
    runs = runs.groupBy("rid", "b", "diag", "run", "item_id", "span", "q").agg(F.min("pos").alias("first"), F.max("pos").alias("at"))
    return runs.withColumn("last", F.col("at") + F.col("q") - 1).where("last - first + 1 >= span").select("rid", "item_id", "first", "last")


def _union_length(hits: DataFrame) -> DataFrame:
    """(rid, n_hit): positions covered by at least one run."""
    before = Window.partitionBy("rid").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    seen = hits.select("rid", "first", "last").distinct().withColumn("seen", F.coalesce(F.max("last").over(before), F.lit(-1)))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first"), F.col("seen") + 1) + 1)
    return seen.groupBy("rid").agg(F.sum(fresh).alias("n_hit"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                         ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
