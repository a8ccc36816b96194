"""Windowed fuzzy de-duplication: who tells the same story, who owns it, what is merged into it.

The greedy pass depends on order, so it runs exactly, but only inside units of rows that can influence each other:

* equal canonical URLs, equal title hashes and similar titles tie rows that lie within the window.  Sketches of both titles bound their similarity
  before a pair is made. Where buckets are crowded, candidate pairs share a rare token or a rare gram besides: a pair's first common term in order of rarity lies in both prefixes,
  beyond which the rest is too light for the threshold, so nothing is lost and no common term is joined on.
* a unit is swept in order of time by one streaming pass over sorted rows, which holds the rows of the window and no more; a title that
  recurs all year is many units, or one that is swept.
* what one unit has to know of others is which keys (URLs, title hashes) an older row took: such a key leads to a row out of reach, so the fuzzy
  scan decides.  The sweep first assumes that every older row took its keys; units for which this proves wrong are swept again, until all agree.

Rows tied to nothing are inserted by a filter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions import arabic, similarity, text
from newsflow.functions.dates import WINDOW, day_bucket
from newsflow.ship import ship_package
from newsflow.tables import components, few, materialize, n_parts

DEFAULT_PRIORITY = 99

ARTICLE_COLUMNS = (
    "id string, source_id string, title string, summary string, url string, canonical_url string, image_url string, published_at long, fetched_at long, "
    "breaking_score int, topic_score int, normalized_title string, title_hash string, day_bucket long, duplicate_source_ids array<string>, notified boolean, seen_in_feed boolean")
_NAMES = [c.split()[0] for c in ARTICLE_COLUMNS.split(", ")]


@dataclass
class Resolved:
    """What a pass decided."""

    to_insert: DataFrame
    to_update: DataFrame
    merged_away: DataFrame  # source_id, n: stories lost to another outlet
    already_stored: DataFrame  # source_id, n: re-fetches of a stored article


def with_priority(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Left join of the sources' priority; unknown sources come last."""
    rank = few(sources.select(F.col("id").alias("source_id"), "priority"))
    return rows.join(rank, "source_id", "left").withColumn("priority", F.coalesce("priority", F.lit(DEFAULT_PRIORITY)))


def candidates(scored: DataFrame, sources: DataFrame, now_ms: int, seen_in_feed: bool) -> DataFrame:
    """Accepted rows (with ``seq``, their fetch order) as article rows to be."""
    # one row in, one out: addresses and titles are normalized once, not wherever they are used
    once = F.explode(F.array(F.struct(text.canonical_url(F.col("url")).alias("canonical_url"), arabic.for_dedupe(F.col("title")).alias("normalized_title"))))
    rows = with_priority(scored, sources).withColumn("_x", once).withColumns({"canonical_url": F.col("_x.canonical_url"), "normalized_title": F.col("_x.normalized_title")})
    return rows.select(
        text.stable_hash(F.col("canonical_url")).alias("id"), "source_id", "title", "summary", "url", "canonical_url", "image_url", "published_at",
        F.lit(now_ms).cast("long").alias("fetched_at"), F.col("classification.breaking_score").alias("breaking_score"),
        F.col("classification.topic_score").alias("topic_score"), "normalized_title", text.stable_hash(F.col("normalized_title")).alias("title_hash"),
        day_bucket(F.col("published_at")).alias("day_bucket"), F.expr("cast(array() as array<string>)").alias("duplicate_source_ids"),
        F.lit(False).alias("notified"), F.lit(seen_in_feed).alias("seen_in_feed"), "priority", F.col("seq").cast("long").alias("seq"), F.lit(False).alias("stored"))


def pool(incoming: DataFrame, existing: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored rows and candidates with a node number."""
    old = with_priority(existing, sources).select(*_NAMES, "priority", F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("stored"))
    return old.unionByName(incoming).withColumn("node", F.monotonically_increasing_id())


def _twins(rows: DataFrame, key: str) -> DataFrame:
    """(a, b): ties that join the rows of a key that lie within the window of each other, directly or in a chain."""
    at = F.struct("published_at", "node")
    slim = rows.select(F.col(key).alias("key"), "published_at", "node", day_bucket(F.col("published_at")).alias("bucket"))
    each = slim.groupBy("key", "bucket").agg(F.min("node").alias("head"), F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    inside = slim.join(each.where("n > 1").select("key", "bucket", "head"), ["key", "bucket"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    after = each.select("key", (F.col("bucket") - 1).alias("bucket"), F.col("first").alias("next"))
    beside = each.join(after, ["key", "bucket"]).where(F.col("next.published_at") - F.col("last.published_at") <= WINDOW)
    return inside.unionByName(beside.select(F.col("last.node").alias("a"), F.col("next.node").alias("b")))


def _prefixes(rows: DataFrame, terms: Column, light: float, cosine: bool) -> DataFrame:
    """(node, term) of the rarest terms, up to where the rest alone can't reach the threshold."""
    each = rows.select("node", F.explode(terms).alias("term")).groupBy("node", "term").agg(F.count("*").alias("c"))
    frequency = each.groupBy("term").agg(F.count("*").alias("df"))
    ranked = each.join(frequency, "term").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "term", "c"))).alias("t"))
    if not cosine:
        need = F.ceil(F.size("t") * light - 1e-9)
        return ranked.select("node", F.explode(F.slice("t", 1, (F.size("t") - need + 1).cast("int"))).alias("x")).select("node", "x.term")
    total = F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x["c"].cast("double") * x["c"])
    # a term is in the prefix while what is left with it weighs the threshold or more
    start = F.struct(F.col("total").alias("left"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(
        (acc["left"] - x["c"].cast("double") * x["c"]).alias("left"),
        F.when(acc["left"] >= F.col("total") * light * light * (1 - 1e-9), acc["n"] + 1).otherwise(acc["n"]).alias("n"))
    many = F.aggregate("t", start, step, lambda acc: acc["n"])
    return ranked.withColumn("total", total).select("node", F.explode(F.slice("t", F.lit(1), many)).alias("x")).select("node", "x.term")


TOKEN_WORDS, GRAM_WORDS = 2, 8


def _sketch(terms: Column, words: int) -> list[Column]:
    """A bit for each of ``terms`` (their places, by ``_places``), in so many longs."""
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)))
    none = F.lit(0).cast("long")

    def word(k: int) -> Column:
        return F.aggregate(terms, none, lambda acc, p: F.when(F.shiftright(p, 6) == k, acc.bitwiseOR(bit(p))).otherwise(acc))

    return [word(k) for k in range(words)]


def _places(terms: Column, words: int) -> Column:
    """Which bit of a sketch of so many longs each term has."""
    return F.array_distinct(F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(64 * words)).cast("int")))


def _square(terms: Column) -> Column:
    """The squared length of the profile of ``terms``: of equal terms in a row the k-th adds 2k - 1."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(acc, t):
        run = F.when(acc["last"] == t, acc["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), (acc["sum"] + run * 2 - 1).alias("sum"))

    return F.aggregate(F.sort_array(terms), start, step, lambda acc: acc["sum"].cast("double"))


def _apart(one: str, two: str, words: int) -> Column:
    """At least so many terms are in one set and not in the other: the bits in which sketches differ."""
    each = [F.bit_count(F.col(f"{one}{k}").bitwiseXOR(F.col(f"{two}{k}"))) for k in range(words)]
    return sum(each[1:], each[0])


def _may_be_similar() -> tuple[Column, Column]:
    """Whether sizes and sketches of sides 1 and 2 allow similar titles, and whether by cosine alone: ``t`` of tokens, ``n`` their number, ``g`` of grams, ``q`` the squared length of the profile."""
    tokens, grams = _apart("t1_", "t2_", TOKEN_WORDS), _apart("g1_", "g2_", GRAM_WORDS)
    # |A - B| + |B - A| <= (1 - j) / (1 + j) * (|A| + |B|); |a - b|^2 = |a|^2 + |b|^2 - 2 c |a| |b|, and each gram of one side only adds 1 to it at least;
    # common grams alone give the product, so c^2 <= (1 - |A - B| / |a|^2) * (1 - |B - A| / |b|^2), also where a gram recurs many times
    j = lambda least: tokens <= (F.col("n1") + F.col("n2")) * ((1 - least) / (1 + least)) + 1e-6
    only = lambda one, two: sum((F.bit_count(F.col(f"g{one}_{k}").bitwiseAND(F.bitwise_not(F.col(f"g{two}_{k}")))) for k in range(GRAM_WORDS)), F.lit(0))
    common = (F.col("q1") - only(1, 2)) * (F.col("q2") - only(2, 1))
    c = lambda least: (grams <= F.col("q1") + F.col("q2") - F.sqrt(F.col("q1") * F.col("q2")) * (2 * least) + 1e-6) & (common >= F.col("q1") * F.col("q2") * (least * least * (1 - 1e-9)))
    return j(similarity.JACCARD) | c(similarity.COSINE) | (j(similarity.BOTH_JACCARD) & c(similarity.BOTH_COSINE)), c(similarity.COSINE)


#: Rows of two neighbouring buckets up to which all their pairs are compared by sketch; of more, those that share a rare term.
CROWD = 4_000


def _crowds(slim: DataFrame, most: int) -> DataFrame:
    """(bucket): those that hold more than ``most`` rows with the bucket before."""
    each = slim.groupBy("bucket").agg(F.count("*").alias("n"))
    return each.select(F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), "n").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("bucket")


def _terms(slim: DataFrame) -> DataFrame:
    """(node, kind, term): the rare terms of each title, one of which two similar titles share."""
    by_token = _prefixes(slim.where("normalized_title <> ''"), F.col("tokens"), similarity.BOTH_JACCARD, False).withColumn("kind", F.lit(0))
    by_gram = _prefixes(slim, similarity.grams(F.col("normalized_title")), similarity.COSINE, True).withColumn("kind", F.lit(1))
    return by_token.unionByName(by_gram)


def _near(rows: DataFrame, keys: list[str], within: Callable[[DataFrame], DataFrame] = lambda left: left) -> DataFrame:
    """(a, b, by_cosine): nodes, a < b, of equal ``keys`` within the window that may be similar; the earlier one meets the rows of its own bucket and of the next.

    ``within`` keeps some of the buckets in which they meet.
    """
    side = lambda node, k: [*keys, F.col("node").alias(node), F.col("published_at").alias(f"at{k}"), F.col("n").alias(f"n{k}"), F.col("q").alias(f"q{k}"),
                            *[F.col(f"t_{w}").alias(f"t{k}_{w}") for w in range(TOKEN_WORDS)], *[F.col(f"g_{w}").alias(f"g{k}_{w}") for w in range(GRAM_WORDS)]]
    left = rows.select(*side("x", 1), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = rows.select(*side("y", 2), "bucket")
    similar, by_cosine = _may_be_similar()
    earlier = (F.col("at1") < F.col("at2")) | ((F.col("at1") == F.col("at2")) & (F.col("x") < F.col("y")))
    both = within(left).join(right, [*keys, "bucket"]).where(earlier & (F.col("at2") - F.col("at1") <= WINDOW) & similar)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), by_cosine.alias("by_cosine"))


def similar_pairs(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b, j, c): nodes, a < b, whose titles are similar within the window; ``rows`` has node, normalized_title, published_at."""
    title = F.col("normalized_title")
    tokens = F.array_distinct(F.filter(F.split(title, " "), lambda t: t != ""))
    slim = rows.select("node", "normalized_title", "published_at", day_bucket(F.col("published_at")).alias("bucket"), tokens.alias("tokens"), similarity.grams(title).alias("each"))
    slim = slim.withColumns({"n": F.size("tokens"), "q": _square(F.col("each")), "_t": _places(F.col("tokens"), TOKEN_WORDS), "_g": _places(F.col("each"), GRAM_WORDS)})
    slim = slim.withColumns({f"t_{k}": c for k, c in enumerate(_sketch(F.col("_t"), TOKEN_WORDS))} | {f"g_{k}": c for k, c in enumerate(_sketch(F.col("_g"), GRAM_WORDS))})
    slim = materialize(slim.drop("each", "_t", "_g"), "titles")
    light = slim.drop("normalized_title", "tokens")
    crowds = materialize(_crowds(slim, crowd), "crowds")
    near = _near(light, [])
    if crowds.limit(1).count():
        # a pair belongs to the bucket of its later row
        near = _near(light, [], lambda left: left.join(crowds, "bucket", "left_anti"))
        inside = crowds.unionByName(crowds.select((F.col("bucket") - 1).alias("bucket"))).distinct()
        terms = materialize(_terms(slim.join(inside, "bucket", "left_semi")).join(light, "node"), "terms")
        near = near.unionByName(_near(terms, ["kind", "term"], lambda left: left.join(crowds, "bucket", "left_semi")))
    whole = lambda name, k: slim.select(F.col("node").alias(name), F.col("tokens").alias(f"t{k}"), F.col("normalized_title").alias(f"w{k}"), F.col("q").alias(f"q{k}"))
    # by number, as adaptive execution would take pairs of two longs for little work
    near = near.repartition(n_parts(rows.sparkSession), "a", "b").distinct()
    both = near.join(whole("a", 1), "a").join(whole("b", 2), "b")
    # one row in, one out: the filters read what is computed once; most pairs end at their tokens
    both = both.withColumn("j", F.explode(F.array(similarity.jaccard(F.col("t1"), F.col("t2"))))).where(F.col("by_cosine") | (F.col("j") >= similarity.BOTH_JACCARD))
    # |a + b|^2 = |a|^2 + |b|^2 + 2 ab, so a profile of both sides' grams gives the dot product
    dot = (_square(F.concat(similarity.grams(F.col("w1")), similarity.grams(F.col("w2")))) - F.col("q1") - F.col("q2")) / 2
    size = F.sqrt("q1") * F.sqrt("q2")
    c = F.when(size > 0, dot / size).otherwise(F.lit(0.0))
    both = both.select("a", "b", "j", F.explode(F.array(c)).alias("c"))
    return both.where(similarity.duplicates(F.col("j"), F.col("c")))


class _Row:
    """A pool row while its component is resolved."""

    def __init__(self, record: dict):
        self.__dict__.update(record)
        self.duplicates = dict.fromkeys(record["duplicate_source_ids"] if record["duplicate_source_ids"] is not None else ())
        self.dirty = False
        self.read_title()

    def read_title(self):
        self.tokens = {t for t in self.normalized_title.split(" ") if t}
        padded = f" {self.normalized_title} "
        self.grams = Counter(padded[i:i + similarity.GRAM] for i in range(max(1, len(padded) - similarity.GRAM + 1)))
        self.size = math.sqrt(sum(c * c for c in self.grams.values()))

    def near(self, other: _Row) -> bool:
        return abs(self.published_at - other.published_at) <= WINDOW

    def similar(self, other: _Row) -> bool:
        common = len(self.tokens & other.tokens)
        j = common / (len(self.tokens) + len(other.tokens) - common) if self.tokens and other.tokens else 0.0
        if j >= similarity.JACCARD:
            return True
        small, large = sorted((self.grams, other.grams), key=len)
        dot = float(sum(c * large[g] for g, c in small.items() if g in large))
        c = dot / (self.size * other.size) if dot else 0.0
        return c >= similarity.COSINE or (j >= similarity.BOTH_JACCARD and c >= similarity.BOTH_COSINE)

    #: What a winning copy brings along; identity, fetch time and flags stay with the row.
    SHOWN = ("title", "summary", "url", "canonical_url", "published_at", "source_id", "priority", "normalized_title", "title_hash")

    def absorb(self, other: _Row) -> None:
        owner = self.source_id
        if (other.published_at, other.priority) < (self.published_at, self.priority):
            for name in self.SHOWN:
                setattr(self, name, getattr(other, name))
            self.read_title()
            self.breaking_score = max(self.breaking_score, other.breaking_score)
            self.topic_score = max(self.topic_score, other.topic_score)
            self.duplicates[owner] = None
        else:
            self.duplicates[other.source_id] = None
        self.duplicates.pop(self.source_id, None)
        if not (self.image_url or "").strip() and (other.image_url or "").strip():
            self.image_url = other.image_url
        self.dirty = True


class Sweep:
    """The greedy pass over one unit, row by row in order of arrival: stored rows a window before their time, candidates by time, priority and fetch order.

    Held are the rows of the window and, of keys that were taken, when.
    """

    def __init__(self, unit: int):
        self.unit = unit
        self.stored: list[_Row] = []  # by time and id
        self.found: list[_Row] = []  # in order of insertion
        self.by_node: dict[int, _Row] = {}
        self.taken: tuple[dict, dict] = ({}, {})  # by URL and by title hash: (order, row)
        self.lost: Counter = Counter()

    @staticmethod
    def order(row: _Row) -> tuple:
        return row.published_at, row.priority, row.seq

    def _settled(self, rows: list[_Row], until: int) -> tuple[list[_Row], Iterator]:
        kept, gone = [], []
        for r in rows:
            (kept if r.published_at >= until else gone).append(r)
        for r in gone:
            self.by_node.pop(r.node, None)
        return kept, ((("update" if r.stored else "insert"), r) for r in gone if r.dirty or not r.stored)

    def _probe(self, kind: int, key: str, first_stored: int | None, outside: tuple | None, now: tuple) -> _Row | None:
        """The row that a key leads to: the first stored one, else the first that took it, if it is of this unit and at hand."""
        if first_stored is not None:
            return self.by_node.get(first_stored)
        mine = self.taken[kind].get(key)
        if mine is None or outside is not None and outside < mine[0]:
            return None
        return self.by_node.get(mine[1])

    def take(self, new: _Row) -> Iterator[tuple[str, object]]:
        if new.stored:
            self.stored.append(new)
            self.by_node[new.node] = new
            return
        # rows that are too old for one candidate are for all later ones, also after taking in another, which only makes them older
        until = new.published_at - WINDOW
        self.stored, out = self._settled(self.stored, until)
        yield from out
        self.found, out = self._settled(self.found, until)
        yield from out
        now = self.order(new)
        probes = (self._probe(0, new.canonical_url, new.url_stored, new.url_outside, now), self._probe(1, new.title_hash, new.title_stored, new.title_outside, now))
        match = next((p for p in probes if p is not None and p.near(new)), None) or next((p for rows in (self.stored, self.found) for p in rows if p.near(new) and p.similar(new)), None)
        if match is None:
            self.found.append(new)
            self.by_node[new.node] = new
            for kind, (key, first_stored, outside, shared) in enumerate(((new.canonical_url, new.url_stored, new.url_outside, new.url_shared),
                                                                         (new.title_hash, new.title_stored, new.title_outside, new.title_shared))):
                if first_stored is None and (outside is None or now < outside):
                    self.taken[kind].setdefault(key, (now, new.node))
                if shared:
                    yield "taken", (kind, key, now)
        elif (match.source_id, match.canonical_url) == (new.source_id, new.canonical_url):
            self.lost["already_stored", new.source_id] += 1
        else:
            owner = match.source_id
            match.absorb(new)
            if match.source_id != new.source_id:
                self.lost["merged_away", new.source_id] += 1
            elif owner != new.source_id:
                self.lost["merged_away", owner] += 1

    def end(self) -> Iterator[tuple[str, object]]:
        for rows in (self.stored, self.found):
            yield from self._settled(rows, 2**63 - 1)[1]
        for (outcome, source), n in self.lost.items():
            yield outcome, (source, n)


_ALONE = {"unit": 0, "url_stored": None, "title_stored": None, "url_outside": None, "title_outside": None, "url_shared": False, "title_shared": False}


def resolve_rows(records: list[dict]) -> Iterator[tuple[str, _Row | str]]:
    """The pass over a few rows: ("insert" | "update", row) and ("already_stored" | "merged_away", source)."""
    rows = [_Row(_ALONE | {"node": k} | r) for k, r in enumerate(records)]
    first: tuple[dict, dict] = ({}, {})
    for r in sorted((r for r in rows if r.stored), key=lambda r: (r.published_at, r.id)):
        first[0].setdefault(r.canonical_url, r.node)
        first[1].setdefault(r.title_hash, r.node)
    for r in rows:
        r.url_stored, r.title_stored = first[0].get(r.canonical_url), first[1].get(r.title_hash)
    sweep = Sweep(0)
    for row in sorted(rows, key=lambda r: (r.published_at - WINDOW * r.stored, not r.stored, 0 if r.stored else r.priority, r.seq, r.id)):
        yield from sweep.take(row)
    for outcome, what in sweep.end():
        if isinstance(what, tuple):
            yield from [(outcome, what[0])] * what[1]
        else:
            yield outcome, what


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_MORE = "unit long, outcome string, kind int, key string, taken_at long, taken_priority int, taken_seq long, n long"
_RESOLVED = f"{_MORE}, {ARTICLE_COLUMNS}"
_SCHEMA = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in _RESOLVED.split(", ")])


def _record(unit: int, outcome: str, what) -> dict:
    if isinstance(what, _Row):
        return {"unit": unit, "outcome": outcome, **{c: getattr(what, c) for c in _NAMES}, "duplicate_source_ids": list(what.duplicates), "day_bucket": int(what.published_at / WINDOW)}
    if outcome == "taken":
        kind, key, (at, priority, seq) = what
        return {"unit": unit, "outcome": outcome, "kind": kind, "key": key, "taken_at": at, "taken_priority": priority, "taken_seq": seq}
    return {"unit": unit, "outcome": outcome, "source_id": what[0], "n": what[1]}


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit and arrival: each unit's sweep, one after the other."""
    sweep, out = None, []
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            for record in whole.slice(at, 1024).to_pylist():
                for side in ("url_outside", "title_outside"):
                    record[side] = tuple(record[side].values()) if record[side] else None
                row = _Row(record)
                if sweep is None or sweep.unit != row.unit:
                    out += [_record(sweep.unit, *x) for x in sweep.end()] if sweep else []
                    sweep = Sweep(row.unit)
                out += [_record(sweep.unit, *x) for x in sweep.take(row)]
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                out = []
    out += [_record(sweep.unit, *x) for x in sweep.end()] if sweep else []
    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


#: Keys that rows take: kind, column, prefix of what is known of it.
_KEYS = ((0, "canonical_url", "url"), (1, "title_hash", "title"))


def _outside(taken: DataFrame) -> DataFrame:
    """(kind, key, unit, outside): of ``taken`` (kind, key, unit, t: an order), the first of other units."""
    first = taken.groupBy("kind", "key", "unit").agg(F.min("t").alias("t"))
    least = first.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "key").orderBy("t"))).where("_n <= 2")
    least = least.groupBy("kind", "key").agg(F.min("t").alias("one"), F.min_by("unit", "t").alias("of"), F.max("t").alias("two"), F.count("*").alias("k"))
    # the first for the units of all others, the second for its own
    return least.select("kind", "key", "of", "one", F.when(F.col("k") > 1, F.col("two")).alias("two"))


_ORDER = "struct<taken_at:bigint,taken_priority:int,taken_seq:bigint>"


def _sweep(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Outcomes of the units of ``rows``, given what ``taken`` (kind, key, of, one, two) says of other units."""
    for kind, key, side in _KEYS:
        other = taken.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("of").alias("_of"), F.col("one").alias("_one"), F.col("two").alias("_two"))
        rows = rows.join(other, key, "left").withColumn(f"{side}_outside", F.when(F.col("_of") == F.col("unit"), F.col("_two")).otherwise(F.col("_one")).cast(_ORDER)).drop("_of", "_one", "_two")
    arrival = [F.col("unit"), F.col("published_at") - F.when(F.col("stored"), WINDOW).otherwise(0), (~F.col("stored")), F.when(F.col("stored"), 0).otherwise(F.col("priority")), F.col("seq"), F.col("id")]
    return rows.repartition("unit").sortWithinPartitions(*arrival).mapInArrow(_swept, _RESOLVED)


def resolve(rows: DataFrame) -> DataFrame:
    """Outcomes of the units of more than one row among ``rows``: pool rows with their ``unit`` and whether they are ``tied`` to another."""
    # the first stored row of a key decides for it, wherever it is
    for _, key, side in _KEYS:
        first = rows.where("stored").groupBy(key).agg(F.min_by("node", F.struct("published_at", "id")).alias(f"{side}_stored"))
        rows = rows.join(first, key, "left")
    rows = materialize(rows, "units")
    order = F.struct(F.col("published_at").alias("taken_at"), F.col("priority").alias("taken_priority"), F.col("seq").alias("taken_seq"))
    keys = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(f"{side}_stored").isNull().alias("free")) for kind, key, side in _KEYS]))
    new = rows.where("NOT stored").select("unit", "tied", order.alias("t"), keys.alias("x")).where("x.free").select("unit", "tied", "t", "x.kind", "x.key")
    several = materialize(new.groupBy("kind", "key").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi")).where("lo <> hi").select("kind", "key"), "shared-keys")
    some = several.limit(1).count() > 0
    tied = rows.where("tied")
    for kind, key, side in _KEYS:
        marked = several.where(F.col("kind") == kind).select(F.col("key").alias(key), F.lit(True).alias(f"{side}_shared"))
        tied = tied.join(marked, key, "left").withColumn(f"{side}_shared", F.coalesce(f"{side}_shared", F.lit(False)))
    new = new.join(several, ["kind", "key"], "left_semi")
    if some:
        tied, new = materialize(tied, "tied"), materialize(new, "takers")
    # rows tied to nothing take their keys for certain
    alone = new.where("NOT tied").select("unit", "t", "kind", "key")
    assumed = materialize(_outside(new.select("unit", "t", "kind", "key")), "assumed")
    done = materialize(_sweep(tied, assumed), "resolved")
    while some:
        took = done.where("outcome = 'taken'").select("unit", F.struct("taken_at", "taken_priority", "taken_seq").alias("t"), "kind", "key")
        actual = materialize(_outside(took.unionByName(alone)), "taken")
        before = assumed.select("kind", "key", *[F.col(c).alias(f"{c}_before") for c in ("of", "one", "two")])
        differs = several.join(actual, ["kind", "key"], "left").join(before, ["kind", "key"], "left").where("NOT (of <=> of_before AND one <=> one_before AND two <=> two_before)")
        wrong = materialize(new.join(differs, ["kind", "key"], "left_semi").select("unit").distinct(), "wrong-units")
        if not wrong.limit(1).count():
            break
        again = _sweep(tied.join(wrong, "unit", "left_semi"), actual)
        done = materialize(done.join(wrong, "unit", "left_anti").unionByName(again), "resolved")
        assumed = actual
    return done


def dedupe(scored: DataFrame, existing: DataFrame, sources: DataFrame, now_ms: int, seen_in_feed: bool = False) -> Resolved:
    """Resolve accepted rows against each other and against stored ones."""
    return settle(materialize(pool(candidates(scored, sources, now_ms, seen_in_feed), existing, sources), "pool"))


def settle(rows: DataFrame) -> Resolved:
    """Resolve the rows of a written pool."""
    ship_package(rows.sparkSession)
    ties = _twins(rows, "canonical_url").unionByName(_twins(rows, "title_hash")).unionByName(similar_pairs(rows).select("a", "b"))
    # two titles without tokens have one hash, so they are tied already
    joined = components(ties, "stories")
    heads = joined.select("component").distinct().select(F.col("component").alias("node"), "component")
    rows = rows.join(joined.unionByName(heads).withColumnRenamed("component", "unit"), "node", "left").withColumn("tied", F.col("unit").isNotNull()).withColumn("unit", F.coalesce("unit", "node"))
    rows = materialize(rows, "members")
    resolved = resolve(rows)
    alone = rows.where("NOT stored AND NOT tied").select(*_NAMES)
    count = lambda outcome: resolved.where(F.col("outcome") == outcome).groupBy("source_id").agg(F.sum("n").alias("n"))
    return Resolved(alone.unionByName(resolved.where("outcome = 'insert'").select(*_NAMES)), resolved.where("outcome = 'update'").select(*_NAMES), count("merged_away"), count("already_stored"))


def distinct_first(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
