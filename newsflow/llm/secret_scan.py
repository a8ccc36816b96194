"""Secret scans with corpus-wide ownership frequency.  DataFrame functions only.

Three base kinds are found by pattern.  The method adds a fourth, ``owned``: tokens that look random
and that the whole corpus holds in few repositories of one owner only.  Every candidate string is hashed and its
distinct repositories (documents; copies of one text are one) and owners (sources) are counted over all rows.
A candidate in more than ``max_repos`` repositories or under more than ``max_owners`` owners, or a well-known filler,
is a copied example.  A text that several sources hold may be any one's, so a source that holds all of
a candidate's repositories is its only owner.  Base spans always stay; their class (live or example) is reported
beside them.

Spans are in code points, end exclusive.  Defined cases: a null text is empty; a null source is an
owner of its own; near copies are repositories of their own; documents with the same id are scanned row by row; a value in equally many repositories
of several owners is an example; very long texts are scanned whole; an empty table gives no rows; further columns are ignored, and kept by redaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm.runtime import free_name, materialize

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs of [0-9a-f] are maximal, so the bound may stand in the pattern
#: What the method looks at besides: long runs of token characters.
RANDOM_RUN = r"[A-Za-z0-9+/_=-]{20,}"

#: Values that documentation uses for secrets: telling words, runs in order, short units repeated.
FILLER = r"(?i)example|sample|dummy|placeholder|change_?me|your_|deadbeef|xxxxx|12345678|abcdefgh|^(.{1,4})\1{2,}.{0,3}$"

KINDS = {"assign": 0, "access": 1, "hex": 2, "owned": 3}
REDACTED = "[SECRET]"
#: Up to so many documents with spans these are sent to every executor; more are joined by shuffle.
BROADCAST_SPANS = 200_000


def _matches(text: Column, pattern: str, kind: str, keep, value=None) -> Column:
    """array<struct<start,rank,end,kind,value>> of the leftmost non-overlapping matches.

    The pieces between matches come from ``split`` by the same pattern, so running lengths of pieces
    and matches are the positions.  Only texts that hold a match are split.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), F.char_length(b).alias("gap")))
    empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,rank:int,end:int,kind:string,value:string>>))")

    def step(acc, x):
        first = acc["at"] + x["gap"]
        last = first + F.char_length(x["m"])
        hit = F.struct(first.cast("int").alias("start"), F.lit(KINDS[kind]).alias("rank"), last.cast("int").alias("end"),
                       F.lit(kind).alias("kind"), (value(x["m"]) if value else x["m"]).alias("value"))
        return F.struct(last.cast("int").alias("at"), F.when(keep(x["m"]), F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"))

    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,value:string>>)")
    return F.when(text.rlike(pattern), F.aggregate(steps, empty, step, lambda acc: acc["out"])).otherwise(none)


def _looks_random(value: Column) -> Column:
    """At least one digit, one lower and one upper case letter, and 10 different characters."""
    return (value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
            & (F.size(F.array_distinct(F.split(value, ""))) >= 10))


def find_candidates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, rid, source, base spans, further candidates.  No text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    group2 = lambda m: F.regexp_extract(m, ASSIGN, 2)
    base = F.concat(
        _matches(text, ASSIGN, "assign", lambda m: F.char_length(group2(m)) >= 12, group2),
        _matches(text, ACCESS, "access", lambda m: F.char_length(m) >= 18),
        _matches(text, HEX, "hex", lambda m: F.char_length(m) >= 16))
    more = _matches(text, RANDOM_RUN, "owned", _looks_random)
    rows = documents.select("doc_id", F.coalesce("source", F.lit("\x00")).alias("source"), F.monotonically_increasing_id().alias("rid"),
                            F.xxhash64(text).alias("text_hash"),
                            F.array_sort(base).alias("base"), more.alias("more"))
    return rows.withColumn("more", F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))


def ownership(candidates: DataFrame) -> DataFrame:
    """(h1, h2, n_repos, n_owners) of every candidate value, over the whole corpus."""
    each = candidates.select("text_hash", "source", F.explode(F.concat("base", "more")).alias("c")).select(
        "text_hash", "source", *_hashes()).distinct()
    repos = each.select("h1", "h2", "text_hash").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_repos"))
    by_owner = each.groupBy("h1", "h2", "source").agg(F.count("*").alias("n"))
    owners = by_owner.groupBy("h1", "h2").agg(F.max("n").alias("most"), F.count("*").alias("n_sources"))
    # beside the source that holds the most, each other repository takes one owner at most
    return owners.join(repos, ["h1", "h2"]).select("h1", "h2", "n_repos", F.least("n_sources", 1 + F.col("n_repos") - F.col("most")).alias("n_owners"))


def _hashes():
    return F.xxhash64("c.value").alias("h1"), F.xxhash64(F.lit(7), "c.value").alias("h2")


def scan_secrets(documents: DataFrame, max_owners: int = 1, max_repos: int = 3) -> DataFrame:
    """(doc_id, rid, text_hash, base, added, n_live, n_example): spans of each document and their classes."""
    found = materialize(find_candidates(documents), "secret-candidates")
    verdict = materialize(ownership(found).withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)), "secret-owners")
    each = found.select("rid", F.explode(F.concat("base", "more")).alias("c")).select("rid", "c", *_hashes())
    judged = each.join(verdict, ["h1", "h2"]).withColumn("live", F.col("live") & ~F.col("c.value").rlike(FILLER)).groupBy("rid").agg(
        F.collect_list(F.when((F.col("c.kind") == "owned") & F.col("live"), F.col("c"))).alias("added"),
        F.count_if((F.col("c.kind") != "owned") & F.col("live")).alias("n_live"),
        F.count_if((F.col("c.kind") != "owned") & ~F.col("live")).alias("n_example"))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,value:string>>)")
    return found.join(judged, "rid", "left").select(
        "doc_id", "rid", "text_hash", "base", F.coalesce("added", none).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_text(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced; overlapping spans are replaced together."""
    start = F.expr("named_struct('at', 0, 'out', '')")

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.lit(REDACTED))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, 2**31 - 1)))


def redact_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with every reported span replaced; a column ``n_chars`` follows a changed text.  All other columns, whatever their names, stay."""
    doc, hash_, spans, clean = (free_name(documents, c) for c in ("_span_doc", "_span_hash", "_spans", "_clean"))
    found = scan_secrets(documents.select("doc_id", "text", "source")).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(hash_), F.concat("base", "added").alias(spans))
    found = materialize(found.where(F.size(spans) > 0).dropDuplicates([doc, hash_]), "secret-spans")
    if found.count() <= BROADCAST_SPANS:
        found = F.broadcast(found)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(hash_))
    out = documents.join(found, same, "left").withColumn(clean, F.when(F.col(spans).isNotNull(), redact_text(F.col("text"), F.col(spans))))
    changed = {"text": F.coalesce(clean, "text")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.col(clean).isNull(), F.col("n_chars")).otherwise(F.char_length(clean)).cast(documents.schema["n_chars"].dataType)
    return out.withColumns(changed).select(*documents.columns)
