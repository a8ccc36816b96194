"""Embedding near-dedup: an inverted multi-index over vector halves, multi-sequence traversal, verification.

Vectors are compared within a label.  Equal vectors are one entry with a count from the start.  Each half of a normalised
vector has a codebook of its own; the pair of nearest centroids is a vector's cell on the product grid.  For a
vector, the distance to the border of a half's cell bounds from below how far any vector of that cell is
in that half; the multi-sequence traversal visits cells by ascending sum of the halves' squared bounds and
stops beyond a reach: the bound that linked pairs of a bounded sample need at the target recall, at least a
sixteenth and at most all of the squared distance that the cosine threshold allows (a target of 1 takes all, and is exact).  Cells are met in one direction - from
the lesser cell number to the greater - so each pair is verified once, in double precision, and counts for both ends.

A cell's entries and its visitors are both dealt to chunks, packed many to a row; each chunk of visitors meets each chunk of entries in a group of its
own, so a crowded cell is no one task's work and no group is larger than two chunks.  A
group reports counts and a spanning set of its links, never all pairs.  Vectors stay in the precision that they come in, and are compared in double precision.

Defined cases: null labels and vectors that are null, zero or hold null or non-finite components link with nothing; so do vectors of
different lengths; repeated ``vec_id`` rows are rows of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.llm.runtime import components, materialize, ship_package

THRESHOLD = 0.98
#: Rows that codebooks are fitted on at most, and centroids of a half at most.
FIT_ROWS, MAX_CENTROIDS = 8_000, 1_000
TARGET_RECALL = 0.999
LEAST_REACH = 1 / 16
#: Entries or visitors of a chunk, and rows of a cell that one task packs, about.
CHUNK, PART = 512, 4_096


def usable(embedding):
    """Finite, no null component, not all zero."""
    return (embedding.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists(embedding, lambda x: x != 0))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = squared(x, centres).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def spaced(centres: np.ndarray, gap: float) -> np.ndarray:
    """``centres`` without those closer than ``gap`` to one kept before: in a crowd, cells finer than links reach would all visit each other."""
    kept: list[int] = []
    apart = squared(centres, centres)
    for i in range(len(centres)):
        if not kept or apart[i, kept].min() >= gap * gap:
            kept.append(i)
    return centres[kept]


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :])


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the two halves of ``width``-long vectors."""

    width: int
    first: np.ndarray
    second: np.ndarray
    reach: float  # largest sum of squared bounds that is visited

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Own cells, and per half the squared lower bound to each centroid's region."""
        half = self.width // 2
        own, lower = [], []
        for part, centres in ((x[:, :half], self.first), (x[:, half:], self.second)):
            d = squared(part, centres)
            near = d.argmin(axis=1)
            apart = np.sqrt(squared(centres, centres))
            gap = d - d[np.arange(len(x)), near][:, None]
            border = np.divide(gap, 2 * apart[near], out=np.zeros_like(gap), where=apart[near] > 0)
            own.append(near)
            lower.append(np.maximum(0, border - 1e-7) ** 2)
        return own[0] * len(self.second) + own[1], (lower[0], lower[1])

    def visited(self, one: np.ndarray, two: np.ndarray) -> list[int]:
        """Multi-sequence traversal of one vector: cells by ascending bound, while it is within reach."""
        i_order, j_order = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        i_order, j_order = i_order[one[i_order] <= self.reach], j_order[two[j_order] <= self.reach]
        cells = []
        for i in i_order.tolist():
            inside = j_order[two[j_order] <= self.reach - one[i]]
            if not len(inside):
                break
            cells += [(float(one[i] + two[j]), i * len(self.second) + j) for j in inside.tolist()]
        return [c for _, c in sorted(cells)]


def fit(sample: np.ndarray, total: int, threshold: float, target_recall: float = TARGET_RECALL, seed: int = 3) -> MultiIndex:
    """Codebooks from a sample of unit vectors; ``total`` rows will be indexed."""
    rng = np.random.default_rng(seed)
    k = int(min(MAX_CENTROIDS, max(4, round((total / 16) ** 0.5)), max(1, len(sample) // 8)))
    half = sample.shape[1] // 2
    exact = 2 - 2 * threshold
    book = lambda x: spaced(kmeans(x, k, rng), exact**0.5 / 2)
    index = MultiIndex(sample.shape[1], book(sample[:, :half]), book(sample[:, half:]), exact + 1e-9)
    if target_recall >= 1:
        return index
    # the bound that linked sample pairs need, at the target quantile
    needs = []
    own, (one, two) = index.bounds(sample)
    for at in range(0, len(sample), 512):
        near = np.argwhere(sample[at:at + 512] @ sample.T >= threshold)
        for a, b in near[near[:, 0] + at < near[:, 1]]:
            i, j = divmod(int(own[b]), len(index.second))
            needs.append(one[at + a, i] + two[at + a, j])
    reach = max(LEAST_REACH * exact, float(np.quantile(needs, target_recall)) if needs else exact)
    return MultiIndex(index.width, index.first, index.second, reach + 1e-9)


_SENT = "label string, cell long, home long, visitor boolean, entry long, copies long, vector binary"


def _spread(sent, kind: str):
    schema = pa.schema([("label", pa.string()), ("cell", pa.int64()), ("home", pa.int64()), ("visitor", pa.bool_()), ("entry", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rows: list[list] = [[] for _ in schema]
                columns = [b.column(c).to_pylist() for c in ("label", "entry", "copies", "embedding")]
                by_width: dict[int, list] = {}
                for row in zip(*columns, strict=True):
                    by_width.setdefault(len(row[3]), []).append(row)
                for width, some in by_width.items():
                    raw = np.array([r[3] for r in some], kind)
                    index = indexes[width]
                    own, (one, two) = index.bounds(unit(raw)) if index else (np.zeros(len(some), np.int64), (None, None))
                    for k, (label, entry, copies, _) in enumerate(some):
                        base = width << 32
                        mine, data = int(own[k]), raw[k].tobytes()
                        seen = index.visited(one[k], two[k]) if index else [0]
                        for cell, visitor in [(mine, False), *((c, True) for c in seen if c >= mine)]:
                            for column, v in zip(rows, (label, base + cell, base + mine, visitor, entry, copies, data), strict=True):
                                column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


_PACKED = "label string, cell long, visitor boolean, width int, homes binary, entries binary, copies binary, vectors binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by label, cell and side, up to ``CHUNK`` to a row."""
    held: list[tuple] = []
    key = None

    def row() -> pa.RecordBatch:
        label, cell, visitor, size = key
        whole = lambda at: np.array([r[at] for r in held], np.int64).tobytes()
        return pa.RecordBatch.from_pydict({"label": [label], "cell": [cell], "visitor": [visitor], "width": pa.array([size], pa.int32()), "homes": [whole(0)], "entries": [whole(1)],
                                           "copies": [whole(2)], "vectors": [b"".join(r[3] for r in held)]})

    for b in batches:
        for label, cell, home, visitor, entry, copies, vector in zip(*(b.column(c).to_pylist() for c in ("label", "cell", "home", "visitor", "entry", "copies", "vector")), strict=True):
            now = (label, cell, visitor, len(vector))
            if held and (now != key or len(held) == CHUNK):
                yield row()
                held = []
            key = now
            held.append((home, entry, copies, vector))
    if held:
        yield row()


def _meet(threshold: float, kind: str):
    """Verify a chunk of visitors against a chunk of a cell's entries: counts for both ends and spanning links."""

    def unpack(r: dict, side: str) -> tuple:
        whole = lambda name: np.frombuffer(r[f"{side}_{name}"], np.int64)
        return whole("homes"), whole("entries"), whole("copies"), unit(np.frombuffer(r[f"{side}_vectors"], kind).reshape(-1, r["width"] // np.dtype(kind).itemsize))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                home, out, out_copies, x = unpack(r, "v")
                _, inside, in_copies, y = unpack(r, "e")
                a, b = np.nonzero(x @ y.T >= threshold)
                # entries of this very cell visit it too: their pairs count from the lesser entry only
                keep = np.where(home[a] == r["cell"], out[a] < inside[b], True)
                a, b = a[keep], b[keep]
                if not len(a):
                    continue
                tree = spanning(np.stack([out[a], inside[b]], axis=1))
                who = np.concatenate([out, inside])
                total = np.concatenate([np.bincount(a, weights=in_copies[b], minlength=len(out)), np.bincount(b, weights=out_copies[a], minlength=len(inside))]).astype(np.int64)
                hit = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([who[hit], tree[:, 0]])), pa.array(np.concatenate([total[hit], np.zeros(len(tree), np.int64)])),
                                                  pa.array([None] * len(hit) + tree[:, 1].tolist(), pa.int64())], names=["a", "links", "b"])

    return run


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Links (member, least member) with the same components as ``pairs``."""
    if not len(pairs):
        return pairs
    names, flat = np.unique(pairs, return_inverse=True)
    ends = flat.reshape(pairs.shape)
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[ends[:, 0]], label[ends[:, 1]])
        new = label.copy()
        np.minimum.at(new, ends[:, 0], low)
        np.minimum.at(new, ends[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(names)))
    return np.stack([names[other], names[label[other]]], axis=1)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector."""
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = embeddings.select("vec_id", "label", "embedding")
    good = F.col("label").isNotNull() & usable(F.col("embedding"))
    single = isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType)
    element, kind = ("float", "<f4") if single else ("double", "<f8")
    named = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.when(good, F.col("embedding").cast(f"array<{element}>")).alias("embedding"))
    key = F.when(F.col("embedding").isNotNull(), F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x + F.lit(0.0).cast(element)).cast("string"))), 256))
    named = materialize(named.withColumn("key", key), "vectors")
    # copies: one entry per label and vector, named by its least vec_id
    entries = materialize(named.where("embedding IS NOT NULL").groupBy("label", "key").agg(
        F.min("vec_id").alias("entry"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "entries")
    widths = entries.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).collect()
    indexes = {}
    for w in widths:
        share = fit_rows / w["n"]
        pick = entries.where(F.size("embedding") == w["w"])
        if share < 1:
            pick = pick.where(F.pmod(F.xxhash64("entry", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))
        sample = np.array([r["embedding"] for r in pick.orderBy("entry").select("embedding").limit(fit_rows).collect()], kind)
        indexes[w["w"]] = fit(unit(sample), w["n"], threshold, target_recall) if w["w"] >= 2 and len(sample) else None
    spread = entries.mapInArrow(_spread(spark.sparkContext.broadcast(indexes), kind), _SENT)
    spread = materialize(spread, "spread")
    # crowded cells are dealt to several tasks; there a cell's rows are sorted together and packed
    crowd = spread.groupBy("label", "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    dealt = spread.join(crowd, ["label", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("entry"), F.coalesce("parts", F.lit(1))))
    place = ["label", "cell", "part", "visitor", F.length("vector"), "entry"]
    packed = materialize(dealt.repartition("label", "cell", "part").sortWithinPartitions(*place).mapInArrow(_pack, _PACKED), "cells")
    side = lambda name, visitor: packed.where(F.col("visitor") == visitor).select("label", "cell", "width", *[F.col(c).alias(f"{name}_{c}") for c in ("homes", "entries", "copies", "vectors")])
    met = side("v", True).join(side("e", False), ["label", "cell", "width"])
    return _finish(named, met.mapInArrow(_meet(threshold, kind), "a long, links long, b long"))


def _finish(named: DataFrame, links: DataFrame) -> DataFrame:
    found = materialize(links, "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("entry")).agg(F.sum("links").alias("links"))
    component = components(found.where("b IS NOT NULL").select("a", "b"))
    entry = named.where("key IS NOT NULL").groupBy("label", "key").agg(F.min("vec_id").alias("entry"), F.count("*").alias("copies"))
    entry = (entry.join(counts, "entry", "left").join(component.withColumnRenamed("node", "entry"), "entry", "left")
             .select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "entry").alias("component_id")))
    out = named.select("vec_id", "label", "key").join(entry, ["label", "key"], "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"),
                      (F.col("vec_id") == component_id).alias("kept"))
