"""Ranked lexical search: dual-sorted wavelet trees per shard, best-first search for the exact top k.

A shard holds the postings of all terms of some documents as one sequence of document numbers, term after term, within a
term by falling impact.  A wavelet matrix over the sequence keeps the second order: at each level a stable partition by the next bit of the document
number, so a term's range splits into a left and a right range by rank, and the first posting of any range has its highest impact.
A search starts with the ranges of an item's terms at the root.  A node's bound is the sum of its ranges' first impacts, weighted; nodes are taken best first, in
batches, and dropped where the bound can't beat the current k-th document.  A leaf's ranges hold one document, so its bound is its score.

1. One pass counts documents and terms.  2. Shards are written from the input's partitions, without a shuffle, by bytes of text.  3. Items come in blocks of a stated number of
terms; document frequencies are counted from the shards' dictionaries.  4. A task searches its shards one after the other, taking along the best k of each item,
and a window merges what the tasks found.

Scores are whole numbers: sum of w * ((10^9 * tf) div (1000 * tf + 20 * m)), m = 50 + (50 * n * N) div L, w = floor(1000 * ln((2N + 2) / (2df + 1))).

Defined cases: a null text has no terms and a document without terms is counted nowhere and found by nothing; very long texts are a shard of their own; items of one id
are one item, a null item_id is none, terms count once; repeated documents are ranked row by row, ranks stay unique; equal scores go by doc_id, null ids last; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.runtime import materialize, release_memory, ship_package

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 if b < 128 else b for b in range(256))

TOP = 50
#: A shard is closed at so many bytes of text or documents; a block of items at so many terms in the mean.
SHARD_BYTES, SHARD_DOCUMENTS, BLOCK_TERMS = 8 << 20, 1 << 14, 50_000
#: Numbers that a batch of nodes holds at most, and beyond which the deepest nodes are taken first, so that a long item needs no more memory.
BATCH_NUMBERS, FRONTIER_NUMBERS, BATCH_NODES = 1 << 15, 1 << 22, 96


def terms(text: str | None) -> list[bytes]:
    """All terms in order, as UTF-8."""
    return text.encode().translate(_BYTES).split() if text else []


def term_column(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_TERM, -1), lambda t: t != "")


# -- the wavelet matrix ----------------------------------------------------------------------------

class Postings:
    """Ranges of a sequence of document numbers with impacts, level by level."""

    def __init__(self, planes: np.ndarray, impacts: np.ndarray):
        """``planes``: (bits, words) of 64 places each, with a word to spare."""
        self.bits, self.words = len(planes), planes
        counts = np.bitwise_count(planes).astype(np.int32)
        self.before = np.concatenate([np.zeros((self.bits, 1), np.int32), np.cumsum(counts, axis=1, dtype=np.int32)[:, :-1]], axis=1)
        size = len(impacts)
        self.zeros = np.full(self.bits, size, np.int32) - counts.sum(axis=1, dtype=np.int32)
        self.impacts = np.empty((self.bits + 1, max(1, size)), np.int32)
        self.impacts[0] = 0
        self.impacts[0, :size] = impacts
        for level in range(self.bits):
            bit = np.unpackbits(planes[level].view(np.uint8), bitorder="little", count=size).view(bool)
            here = self.impacts[level, :size]
            self.impacts[level + 1, :self.zeros[level]] = here[~bit]
            self.impacts[level + 1, self.zeros[level]:size] = here[bit]

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits of a level before a place."""
        word = at >> 6
        masked = self.words[level, word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[level, word] + np.bitwise_count(masked)

    def bound(self, level: np.ndarray, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> np.ndarray:
        first = self.impacts[level, np.minimum(lo, self.impacts.shape[1] - 1)]
        return np.where(hi > lo, first, 0).astype(np.int64) @ weights

    def top(self, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray, k: int, least: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, nodes opened): the best ``k`` with a score above 0, by falling score and document; only what beats the score
        ``least``, or equals it with a document up to ``last``."""
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        lo, hi = lo[None, :].astype(np.int32), hi[None, :].astype(np.int32)
        bound = self.bound(level[:, None], lo, hi, weights)
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        batch = max(1, min(BATCH_NODES, BATCH_NUMBERS // max(1, len(weights))))
        opened = 0
        while True:
            first = prefix << (self.bits - level)
            keep = (bound > max(least, 0)) if last is None else (bound > 0) & ((bound > least) | ((bound == least) & (first <= last)))
            if not keep.all():
                level, prefix, lo, hi, bound, first = (a[keep] for a in (level, prefix, lo, hi, bound, first))
            leaf = level == self.bits
            if leaf.any():
                found, scores = np.concatenate([found, prefix[leaf]]), np.concatenate([scores, bound[leaf]])
                best = np.lexsort((found, -scores))[:k]
                found, scores = found[best], scores[best]
                if len(found) == k:
                    least, last = int(scores[-1]), int(found[-1])
                level, prefix, lo, hi, bound = (a[~leaf] for a in (level, prefix, lo, hi, bound))
                continue
            if not len(level):
                return found, scores, opened
            if len(level) > batch:
                order = -bound if lo.size <= FRONTIER_NUMBERS else -level
                split = np.argpartition(order, batch)
                now, rest = split[:batch], split[batch:]
            else:
                now, rest = np.arange(len(level)), np.arange(0)
            opened += len(now)
            at = level[now][:, None]
            ones_lo, ones_hi = self.ones(at, lo[now]), self.ones(at, hi[now])
            zeros = self.zeros[level[now]][:, None]
            new_lo = np.concatenate([lo[now] - ones_lo, zeros + ones_lo]).astype(np.int32)
            new_hi = np.concatenate([hi[now] - ones_hi, zeros + ones_hi]).astype(np.int32)
            new_level = np.tile(level[now] + 1, 2)
            new_prefix = np.concatenate([prefix[now] * 2, prefix[now] * 2 + 1])
            new_bound = self.bound(new_level[:, None], new_lo, new_hi, weights)
            level, prefix, lo, hi, bound = (np.concatenate([a[rest], b]) for a, b in ((level, new_level), (prefix, new_prefix), (lo, new_lo), (hi, new_hi), (bound, new_bound)))


def planes_of(numbers: np.ndarray, bits: int) -> np.ndarray:
    """The wavelet matrix of a sequence: a plane for each bit, highest first."""
    out = np.zeros((bits, len(numbers) // 64 + 1), np.uint64)
    for level in range(bits):
        bit = (numbers >> (bits - 1 - level)) & 1 == 1
        packed = np.packbits(bit, bitorder="little")
        out[level].view(np.uint8)[:len(packed)] = packed
        numbers = np.concatenate([numbers[~bit], numbers[bit]])
    return out


# -- shards ----------------------------------------------------------------------------------------

_SHARD = "n_all long, l_all long, n_ids int, ids binary, bits int, dictionary binary, starts binary, impacts binary, planes binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = total = 0
    for b in batches:
        for text in b.column("text").to_pylist():
            n = len(terms(text))
            documents += n > 0
            total += n
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([total])], names=["n", "l"])


def make_shard(documents: list[tuple[int | None, int, Counter]], n_all: int, l_all: int) -> dict:
    """A row of the index from (doc_id, number of terms, terms with counts)."""
    documents = sorted(documents, key=lambda d: (d[0] is None, d[0] or 0))
    number: dict[bytes, int] = {}
    which, counts, owner = [], [], []
    for k, (_, _, bag) in enumerate(documents):
        which += [number.setdefault(t, len(number)) for t in bag]
        counts += bag.values()
        owner.append((k, len(bag)))
    m = np.array([50 + 50 * n * n_all // l_all for _, n, _ in documents], np.int64)
    doc = np.repeat(np.array([k for k, _ in owner]), [n for _, n in owner])
    tf, term = np.array(counts, np.int64), np.array(which, np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])  # below 10^6
    # one number orders by term, falling impact, document
    key = np.sort((term << 40) | ((1_048_575 - impact) << 20) | doc)
    sequence, impact = key & 1_048_575, 1_048_575 - ((key >> 20) & 1_048_575)
    starts = np.concatenate([[0], np.cumsum(np.bincount(key >> 40, minlength=len(number)))])
    bits = max(1, (len(documents) - 1).bit_length())
    known = [d for d, _, _ in documents if d is not None]
    return {"n_all": n_all, "l_all": l_all, "n_ids": len(known), "ids": np.array(known, np.int64).tobytes(), "bits": bits, "dictionary": b" ".join(number),
            "starts": starts.astype(np.int32).tobytes(), "impacts": impact.astype(np.int32).tobytes(), "planes": planes_of(sequence, bits).tobytes()}


def _index(n_all: int, l_all: int, shard_bytes: int, shard_documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_pylist([make_shard(held, n_all, l_all)], schema=_ARROW)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = terms(text)
                if not words:
                    continue
                if held and (size + len(text) > shard_bytes or len(held) >= shard_documents):
                    yield out()
                    held, size = [], 0
                held.append((doc_id, len(words), Counter(words)))
                size += len(text)
        if held:
            yield out()
        held.clear()
        release_memory()

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_ARROW = pa.schema([(c.split(" ")[0], _KINDS[c.split(" ")[1]]) for c in _SHARD.split(", ")])


def build_index(documents: DataFrame, shard_bytes: int = SHARD_BYTES, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """The written shards of ``documents`` (doc_id, text)."""
    ship_package(documents.sparkSession)
    if shard_documents > 1 << 20:
        raise ValueError("a shard holds at most 2^20 documents")
    counted = documents.select("text").mapInArrow(_count, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(_index(counted["n"] or 0, counted["l"] or 0, shard_bytes, shard_documents), _SHARD), "search-shards")


# -- search ----------------------------------------------------------------------------------------

def _frequencies(sent):
    """(term, df) of a block's vocabulary over the shards of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, _ = sent.value
        total = np.zeros(len(number), np.int64)
        for b in batches:
            for row in b.to_pylist():
                starts = np.frombuffer(row["starts"], np.int32)
                for at, t in enumerate(row["dictionary"].split(b" ")):
                    if t in number:
                        total[number[t]] += starts[at + 1] - starts[at]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "df"])

    return run


def _rank(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weights, items = sent.value  # items: (number, array of term numbers)
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # scores, no id, id
        for b in batches:
            for row in b.to_pylist():
                place = np.full(len(number), -1, np.int64)
                for at, t in enumerate(row["dictionary"].split(b" ")):
                    if t in number:
                        place[number[t]] = at
                starts = np.frombuffer(row["starts"], np.int32)
                planes = np.frombuffer(row["planes"], np.uint64).reshape(row["bits"], -1)
                postings = Postings(planes, np.frombuffer(row["impacts"], np.int32))
                ids, n_ids = np.frombuffer(row["ids"], np.int64), row["n_ids"]
                for item, asked in items:
                    at = place[asked]
                    here = (at >= 0) & (weights[asked] > 0)
                    if not here.any():
                        continue
                    at, w = at[here], weights[asked][here]
                    least, last = 0, None
                    held = best.get(item)
                    if held is not None and len(held[0]) == k:
                        least = int(held[0][-1])
                        # documents up to the held one's place in this shard's order may win a tie
                        last = len(ids) + (1 << 20) if held[1][-1] else int(np.searchsorted(ids, held[2][-1], side="right")) - 1
                    doc, score, _ = postings.top(starts[at], starts[at + 1], w, k, least, last)
                    if not len(doc):
                        continue
                    no_id = doc >= n_ids
                    new = (score, no_id, np.where(no_id, 0, ids[np.minimum(doc, max(0, n_ids - 1))] if n_ids else 0))
                    if held is not None:
                        new = tuple(np.concatenate([x, y]) for x, y in zip(held, new, strict=True))
                        order = np.lexsort((new[2], new[1], -new[0]))[:k]
                        new = tuple(x[order] for x in new)
                    best[item] = new
        for item, (score, no_id, ids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item)), pa.array(ids, mask=no_id), pa.array(score)], names=["item", "doc_id", "score"])
        best.clear()
        release_memory()

    return run


def search(index: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each of ``items`` (item_id, text)."""
    spark = index.sparkSession
    ship_package(spark)
    asked = materialize(items.where("item_id IS NOT NULL").select("item_id", F.explode(term_column(F.col("text"))).alias("term")).distinct(), "search-terms")
    named = materialize(asked.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "search-items")
    n_blocks = max(1, -(-asked.count() // block_terms))
    asked = asked.join(named, "item_id").select("item", "term", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).alias("block"))
    n_all = (index.agg(F.max("n_all")).first()[0] or 0)
    found = None
    for block in range(n_blocks if n_all else 0):
        by_item: dict[int, list[bytes]] = {}
        for r in asked.where(F.col("block") == block).select("item", "term").collect():
            by_item.setdefault(r["item"], []).append(r["term"].encode())
        number = {t: i for i, t in enumerate(sorted({t for ts in by_item.values() for t in ts}))}
        sent = spark.sparkContext.broadcast((number, None))
        df = index.select("dictionary", "starts").mapInArrow(_frequencies(sent), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        weights = np.zeros(len(number), np.int64)
        for r in df:
            weights[r["term"]] = math.floor(1000 * math.log((2 * n_all + 2) / (2 * r["df"] + 1)))
        packed = [(item, np.array([number[t] for t in ts])) for item, ts in sorted(by_item.items())]
        part = index.mapInArrow(_rank(spark.sparkContext.broadcast((number, weights, packed)), k), "item long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
