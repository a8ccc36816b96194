"""Best-fit packing by a grouping genetic algorithm, on islands with elite migration.

Every document is encoded where it is read; only lengths and checksums travel.  Pieces of the full
length are sequences of their own.  The rest is dealt to blocks of about ``block_pieces`` pieces by a hash of the row, and
each block is packed on several islands:

* a chromosome is a set of bins; the fitness is Falkenauer's mean of squared fills;
* crossover injects whole well-filled bins of one parent into the other, removes the bins that hold
  duplicates of their pieces, and puts the displaced pieces back best fit, longest first;
* after a round the islands' elites migrate to the next island, which evolves its own and the newcomers;
  the block's best chromosome wins.  Islands stop at the bound ceil(total / capacity), below which no packing is: where the first
  chromosome, plain best fit by falling length, is there already, no generation runs.

Blocks' badly filled bins are dissolved and packed again together, until they fit one block or dealing them anew saves no bin, twice in a row.

Defined cases: a null text is empty (its one id is the end id); very long texts are cut into full pieces and a rest; equal lengths go by row;
repeated rows are packed row by row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.encoding import CACHE_ENTRIES, IDLE_ENTRIES, encoder
from newsflow.llm.runtime import drop_kept, materialize, release_memory, ship_package

CAPACITY = 4096
BLOCK_PIECES = 2048
ISLANDS = 2
POPULATION = 6
GENERATIONS = 8
#: Bins filled less than this are dissolved between levels.
WELL_FILLED = 0.995

Bins = list[list[int]]


def best_fit(lengths: list[int], order: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """Put pieces, in the order given, where they leave least room; opens bins as needed."""
    bins = [list(b) for b in bins or []]
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at < len(room):
            free, k = room.pop(at)
            bins[k].append(i)
        else:
            free, k = capacity, len(bins)
            bins.append([i])
        bisect.insort(room, (free - lengths[i], k))
    return bins


def fitness(bins: Bins, lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(into: Bins, donor: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    full = sorted(donor, key=lambda b: -sum(lengths[i] for i in b))
    take = full[: max(1, len(full) // 2)]
    injected = rng.sample(take, max(1, len(take) // 2))
    there = {i for b in injected for i in b}
    kept = [b for b in into if there.isdisjoint(b)]
    displaced = [i for b in into if not there.isdisjoint(b) for i in b if i not in there]
    displaced.sort(key=lambda i: (-lengths[i], i))
    return best_fit(lengths, displaced, capacity, [*injected, *kept])


def evolve(lengths: list[int], population: list[Bins], capacity: int, generations: int, size: int, rng: random.Random) -> Bins:
    """The best chromosome after ``generations`` of one island."""
    bound = -(-sum(lengths) // capacity)
    score = lambda c: fitness(c, lengths, capacity)
    population = sorted(population, key=score, reverse=True)
    for _ in range(generations):
        if len(population[0]) <= bound:
            break
        while len(population) < size:
            shaken = sorted(range(len(lengths)), key=lambda i: (-lengths[i] * rng.uniform(0.8, 1.0), i))
            population.append(best_fit(lengths, shaken, capacity))
        children = [crossover(*rng.sample(population[: max(2, size // 2)], 2), lengths, capacity, rng) for _ in range(size // 2)]
        population = sorted([*population, *children], key=score, reverse=True)[:size]
    return population[0]


def _pieces(path: str, end_id: int, capacity: int, entries: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("encoding")
        enc = encoder(path, entries)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out: list[list] = [[], [], [], [], []]
                for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                    all_ids = np.append(np.frombuffer(ids, enc.dtype), end_id).astype("<u4")
                    raw = memoryview(all_ids).cast("B")
                    for k, s in enumerate(range(0, len(all_ids), capacity)):
                        e = min(s + capacity, len(all_ids))
                        for column, v in zip(out, (d, k, s, e - s, zlib.crc32(raw[4 * s:4 * e])), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        enc.shrink(min(entries, IDLE_ENTRIES))
        release_memory()

    return run


def cut_pieces(documents: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, rid): one row per piece, written once."""
    ship_package(documents.sparkSession)
    rows = documents.select("doc_id", "text").mapInArrow(
        _pieces(tokenizer_path, end_id, capacity, cache_entries), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "pieces")


def _island(round_: int, capacity: int, generations: int, size: int):
    """One island: pieces of a block, with the bins of chromosomes that came to it (chromosome null: none)."""

    def run(table: pa.Table) -> pa.Table:
        block, island = table.column("block")[0].as_py(), table.column("island")[0].as_py()
        rng = random.Random(block * 1_000_003 + island * 7919 + round_)
        rid = table.column("rid").to_numpy()
        named, at = np.unique(rid, return_index=True)
        length = table.column("length").to_numpy()[at]
        falling = np.lexsort((named, -length))
        rids, lengths = named[falling].tolist(), length[falling].tolist()
        if round_ == 1:
            order = list(range(len(rids)))
            if island:
                order.sort(key=lambda i: (-lengths[i] * rng.uniform(0.9, 1.0), i))
            population = [best_fit(lengths, order, capacity)]
        else:
            place = np.empty(len(rids), np.int64)
            place[falling] = np.arange(len(rids))
            origin, bin_ = table.column("origin").to_numpy(), table.column("bin").to_numpy()
            sort = np.lexsort((bin_, origin))
            at, origin, bin_ = place[np.searchsorted(named, rid[sort])], origin[sort], bin_[sort]
            chromosomes: dict[int, Bins] = {}
            for part in np.split(np.arange(len(at)), np.flatnonzero((origin[1:] != origin[:-1]) | (bin_[1:] != bin_[:-1])) + 1):
                chromosomes.setdefault(int(origin[part[0]]), []).append(at[part].tolist())
            population = list(chromosomes.values())
        best = evolve(lengths, population, capacity, generations, size, rng)
        flat = [i for b in best for i in b]
        n = len(flat)
        out = pa.table([np.full(n, block, np.int64), np.full(n, island, np.int32), np.array(rids, np.int64)[flat], np.array(lengths, np.int64)[flat],
                        np.repeat(np.arange(len(best), dtype=np.int32), [len(b) for b in best]), np.full(n, len(best), np.int32),
                        np.full(n, fitness(best, lengths, capacity)[1])], names=["block", "island", "rid", "length", "bin", "n_bins", "fill"])
        release_memory()
        return out

    return run


_ISLAND = "block long, island int, rid long, length long, bin int, n_bins int, fill double"


def pack_level(pieces: DataFrame, level: int, n_blocks: int, capacity: int, islands: int, generations: int, size: int) -> DataFrame:
    """(rid, length, bin_key, used) of pieces(rid, length)."""
    dealt = pieces.select("rid", "length", F.pmod(F.xxhash64(F.lit(level), "rid"), F.lit(n_blocks)).alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    first = dealt.groupBy("block", "island").applyInArrow(_island(1, capacity, generations, size), _ISLAND)
    first = materialize(first, "islands")
    # elite migration: every island's best stays and also goes to the next island
    moved = first.withColumn("origin", F.col("island"))
    if islands > 1:
        moved = moved.unionByName(first.withColumn("origin", F.col("island")).withColumn("island", ((F.col("island") + 1) % islands).cast("int")))
    second = materialize(moved.groupBy("block", "island").applyInArrow(_island(2, capacity, generations, size), _ISLAND), "islands")
    best = (second.groupBy("block", "island").agg(F.min("n_bins").alias("n"), F.max("fill").alias("fill"))
            .groupBy("block").agg(F.min(F.struct("n", -F.col("fill"), "island")).alias("best")).select("block", F.col("best.island").alias("island")))
    won = second.join(best, ["block", "island"])
    used = F.sum("length").over(Window.partitionBy("block", "bin"))
    return won.select("rid", "length", ((F.lit(level).cast("long") * n_blocks + F.col("block")) * (1 << 24) + F.col("bin")).alias("bin_key"), used.alias("used"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS,
         generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    narrow = pieces.select("rid", "length")
    alone = narrow.where(F.col("length") >= capacity).select("rid", "length", (-1 - F.col("rid")).alias("sequence_id"))
    open_ = narrow.where(F.col("length") < capacity)
    done = [alone]
    offset = 0
    dissolved, idle, level = None, 0, 0
    while n := open_.count():
        n_blocks = -(-n // block_pieces)
        packed = materialize(pack_level(open_, level, n_blocks, capacity, islands, generations, population)
                             .withColumn("bin_key", F.col("bin_key") + F.lit(offset)), "packed")
        # one block holds all that is left, or dealing it anew saved no bin twice in a row
        bins = packed.groupBy("bin_key").agg(F.first("used").alias("used")).agg(F.count("*").alias("n"), F.count_if(F.col("used") < WELL_FILLED * capacity).alias("bad")).first()
        idle = idle + 1 if dissolved is not None and bins["n"] >= dissolved else 0
        last = n_blocks == 1 or idle == 2
        dissolved = bins["bad"]
        settled = packed if last else packed.where(F.col("used") >= WELL_FILLED * capacity)
        done.append(settled.select("rid", "length", F.col("bin_key").alias("sequence_id")))
        if last:
            break
        open_ = packed.where(F.col("used") < WELL_FILLED * capacity).select("rid", "length")
        offset += (level + 1) * n_blocks * (1 << 24) + (1 << 40)
        level += 1
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    before = Window.partitionBy("sequence_id").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("rid", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    return pieces.join(placed, "rid").drop("rid")


def pack_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, cache_entries: int = CACHE_ENTRIES, **how) -> DataFrame:
    return pack(cut_pieces(documents, tokenizer_path, end_id, capacity, cache_entries), capacity, **how)
