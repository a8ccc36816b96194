"""Hard-negative mining: ball trees over parts of the vectors, searched by branch and bound.

Vectors are integers and a score is an inner product.  An anchor's positives are its best other rows of the same label; for each positive, its
hard negatives are the best rows of other labels whose scores lie in a window below the positive's.

* Rows go to parts by label and nearest coarse centroid, crowded parts are dealt to chunks, and each chunk becomes a ball tree of at most some ``TREE_ROWS`` rows:
  a row of the written forest.  Of equal vectors of a label only as many as can ever be asked for, those of least id, are indexed; this is exact and
  makes a widely copied vector small.
* A ball of centre c and radius r holds scores within q.c - |q|r and q.c + |q|r, so a node goes if its upper bound is below the window or strictly below the current
  k-th score, or its lower bound above the window.  Equal scores are decided by id, so nodes that may tie are visited.  Scores are verified in integers.
* Anchors come in blocks of a stated size, each sent to the tasks that read the forest; a task keeps the best of a block over all its trees and a
  window over (anchor, score) merges what the tasks found.

Defined cases: rows with a null id, label or vector, with null or non-finite components, or so long that scores could leave 64 bits (squared length of
2^62 or more) take no part; vectors of different lengths never meet; empty vectors score 0; repeated ids are rows of their own, of which one may be the other's positive; equal scores go by id;
an anchor without positives or without negatives in the window has no rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.embedding_dedup import kmeans, squared
from newsflow.llm.runtime import materialize, release_memory, ship_package

#: Rows of a tree, rows of a leaf, anchors of a block, and rows that coarse centroids are fitted on (at most, each).
TREE_ROWS, LEAF_ROWS, BLOCK, FIT_ROWS = 4_096, 64, 2_048, 8_000
POSITIVES, NEGATIVES = 5, 5
LOW_PERCENT, HIGH_PERCENT = 80, 100
_NONE = np.iinfo(np.int64).min + 1


def finite(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantized(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


# -- trees -----------------------------------------------------------------------------------------

def build_tree(points: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """``order`` of the points; per node its range in that order, children (0: leaf), centre and radius.  The root is node 0."""
    x = points.astype(np.float64)
    order = np.arange(len(x))
    ranges, children, centres, radii = [(0, len(x))], [0], [], []
    at = 0
    while at < len(ranges):
        lo, hi = ranges[at]
        part = x[order[lo:hi]]
        centre = part.mean(axis=0)
        apart = np.sqrt(((part - centre) ** 2).sum(axis=1))
        centres.append(centre)
        radii.append(apart.max())
        if hi - lo > leaf and radii[-1] > 0:
            one = part[apart.argmax()]
            two = part[((part - one) ** 2).sum(axis=1).argmax()]
            middle = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(part @ (one - two), middle)]
            children[at] = len(ranges)
            ranges += [(lo, lo + middle), (lo + middle, hi)]
            children += [0, 0]
        at += 1
    return {"order": order, "ranges": np.array(ranges, np.int64), "children": np.array(children, np.int64), "centres": np.array(centres), "radii": np.array(radii)}


class Block:
    """Queries of one vector length: vectors, score windows and the best ``k`` rows so far."""

    def __init__(self, vectors: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.vectors, self.own, self.low, self.high = vectors, own, low, high
        self.exact = vectors.astype(np.float64)
        self.norms = np.sqrt((self.exact**2).sum(axis=1))
        self.scores = np.full((len(vectors), k), _NONE)
        self.ids = np.full((len(vectors), k), np.iinfo(np.int64).max)
        self.rows = np.full((len(vectors), k), -1, np.int64)

    def products(self, some: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Scores as integers; doubles are exact while lengths multiply to less than 2^53."""
        longest = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
        if longest * self.norms[some].max(initial=0) < 2**52:
            return (self.exact[some] @ points.astype(np.float64).T).astype(np.int64)
        return self.vectors[some].astype(np.int64) @ points.astype(np.int64).T

    def take(self, some: np.ndarray, points: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merges the rows of a leaf into the best of the queries ``some``."""
        s = self.products(some, points)
        out = (s < self.low[some, None]) | (s > self.high[some, None]) | (rows[None, :] == self.own[some, None]) | (s < self.scores[some, -1:])
        s[out] = _NONE
        live = ~out.all(axis=1)
        some, s = some[live], s[live]
        if not len(some):
            return
        k = self.scores.shape[1]
        if s.shape[1] > k:
            # what can be among the k best: scores from the k-th on, ties included
            least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            some_columns = ((s >= least[:, None]) & (s > _NONE)).any(axis=0)
            s, ids, rows = s[:, some_columns], ids[some_columns], rows[some_columns]
        wide = lambda a: np.broadcast_to(a, s.shape)
        scores = np.concatenate([self.scores[some], s], axis=1)
        names = np.concatenate([self.ids[some], np.where(s > _NONE, wide(ids), np.iinfo(np.int64).max)], axis=1)
        places = np.concatenate([self.rows[some], np.where(s > _NONE, wide(rows), -1)], axis=1)
        best = np.lexsort((places, names, -scores), axis=-1)[:, :k]
        self.scores[some], self.ids[some], self.rows[some] = (np.take_along_axis(a, best, axis=1) for a in (scores, names, places))


def search(tree: dict[str, np.ndarray], points: np.ndarray, ids: np.ndarray, rows: np.ndarray, block: Block, some: np.ndarray) -> int:
    """Branch and bound over one tree for the queries ``some`` together; points, ids and rows in tree order.  Returns how many (query, leaf row) scores were taken."""
    scored = 0
    stack = [(0, some)]
    while stack:
        node, q = stack.pop()
        centre, radius = tree["centres"][node], tree["radii"][node]
        middle = block.exact[q] @ centre
        reach = block.norms[q] * radius
        slack = 0.5 + 1e-11 * (block.norms[q] * (np.sqrt(centre @ centre) + radius))
        upper, lower = middle + reach + slack, middle - reach - slack
        q = q[(upper >= block.low[q]) & (lower <= block.high[q]) & (upper >= block.scores[q, -1])]
        if not len(q):
            continue
        child = tree["children"][node]
        if child == 0:
            lo, hi = tree["ranges"][node]
            for at in range(lo, hi, 1024):
                end = min(hi, at + 1024)
                block.take(q, points[at:end], ids[at:end], rows[at:end])
                scored += len(q) * (end - at)
        else:
            # the child whose centre scores higher in the mean is popped first
            towards = block.exact[q].mean(axis=0) @ (tree["centres"][child] - tree["centres"][child + 1])
            stack += [(child + 1, q), (child, q)] if towards >= 0 else [(child, q), (child + 1, q)]
    return scored


# -- the forest ------------------------------------------------------------------------------------

_TREE = "label string, width int, points binary, ids binary, rows binary, ranges binary, children binary, centres binary, radii binary"


def _vectors(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(column), width)


def _plant(table: pa.Table) -> pa.Table:
    width = table.column("width")[0].as_py()
    table = table.sort_by([("id", "ascending"), ("row", "ascending")])
    points = _vectors(table.column("vector"), width)
    tree = build_tree(points)
    order = tree["order"]
    packed = {"points": points[order], "ids": table.column("id").to_numpy()[order].astype(np.int64), "rows": table.column("row").to_numpy()[order].astype(np.int64),
              **{k: tree[k] for k in ("ranges", "children", "centres", "radii")}}
    return pa.table({"label": pa.array([table.column("label")[0].as_py()], pa.string()), "width": pa.array([width], pa.int32()),
                     **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in packed.items()}})


def _unpack(row: dict) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    width = row["width"]
    radii = np.frombuffer(row["radii"])
    tree = {"radii": radii, "children": np.frombuffer(row["children"], np.int64), "ranges": np.frombuffer(row["ranges"], np.int64).reshape(-1, 2),
            "centres": np.frombuffer(row["centres"]).reshape(len(radii), width)}
    ids = np.frombuffer(row["ids"], np.int64)
    return tree, np.frombuffer(row["points"], np.int32).reshape(len(ids), width), ids, np.frombuffer(row["rows"], np.int64)


def plant_forest(rows: DataFrame, most_equal: int, tree_rows: int = TREE_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The written forest of ``rows`` (row, id, label, width, vector)."""
    spark = rows.sparkSession
    # as many of equal vectors as can be asked for; the limit works before the shuffle, too
    equal = Window.partitionBy("label", "vector").orderBy("id", "row")
    entries = materialize(rows.withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= most_equal).drop("_n"), "ball-entries")
    total = entries.count()
    share = min(1.0, fit_rows / max(1, total))
    sample = entries.where(F.pmod(F.xxhash64("row", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20))).select("width", "vector").limit(fit_rows).collect()
    by_width: dict[int, list] = {}
    for r in sample:
        by_width.setdefault(r["width"], []).append(r["vector"])
    rng = np.random.default_rng(7)
    books = {w: kmeans(np.array(v, np.float64), max(1, min(len(v) // 8, total // (4 * tree_rows))), rng) for w, v in by_width.items() if w}
    sent = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = b.column("width").to_numpy()
            cell = np.zeros(b.num_rows, np.int32)
            for w in np.unique(widths).tolist():
                if w in sent.value:
                    at = np.flatnonzero(widths == w)
                    cell[at] = squared(_vectors(b.column("vector").take(pa.array(at)), w).astype(np.float64), sent.value[w]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    placed = materialize(entries.mapInArrow(place, "row long, id long, label string, width int, vector array<int>, cell int"), "ball-cells")
    part = ["label", "width", "cell"]
    crowd = placed.groupBy(*part).agg(F.ceil(F.count("*") / tree_rows).alias("chunks"))
    dealt = placed.join(crowd, part).withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks")).drop("chunks")
    return materialize(dealt.groupBy(*part, "chunk").applyInArrow(_plant, _TREE), "ball-trees")


_FOUND = "query long, row long, id long, score long"


def _visit(sent, k: int, same_label: bool):
    """Searches every tree of a task for a block of queries; emits the best of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = []  # one block by label and width
        for (label, width), g in sent.value.items():
            groups.append((label, width, g["query"], Block(g["vectors"], g["own"], g["low"], g["high"], k)))
        for b in batches:
            for row in b.to_pylist():
                unpacked = None
                for label, width, _, block in groups:
                    if width == row["width"] and (label == row["label"]) == same_label:
                        unpacked = unpacked or _unpack(row)
                        search(*unpacked, block, np.arange(len(block.vectors)))
        for _, _, query, block in groups:
            q, place = np.nonzero(block.scores > _NONE)
            for at in range(0, len(q), 50_000):
                i, j = q[at:at + 50_000], place[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(query[i]), pa.array(block.rows[i, j]), pa.array(block.ids[i, j]), pa.array(block.scores[i, j])], names=["query", "row", "id", "score"])
        release_memory()

    return run


def _best(forest: DataFrame, queries: DataFrame, n_blocks: int, k: int, same_label: bool, label: str) -> DataFrame:
    """(query, row, id, score, place): the ``k`` best rows of each of ``queries`` (query, block, own, label, width, vector, low, high)."""
    spark = forest.sparkSession
    found = None
    for block in range(n_blocks):
        groups: dict[tuple, list] = {}
        for r in queries.where(F.col("block") == block).orderBy("query").collect():
            groups.setdefault((r["label"], r["width"]), []).append(r)
        if not groups:
            continue
        packed = {key: {"vectors": np.array([r["vector"] for r in g], np.int32).reshape(len(g), key[1]), **{c: np.array([r[c] for r in g], np.int64) for c in ("query", "own", "low", "high")}}
                  for key, g in groups.items()}
        part = forest.mapInArrow(_visit(spark.sparkContext.broadcast(packed), k, same_label), _FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    return materialize(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k), label)


def mine_hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT,
                        block: int = BLOCK, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has id (a whole number), label, vector (whole numbers) and anchor (boolean).
    """
    spark = vectors.sparkSession
    ship_package(spark)
    length = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()) & (length < float(2**62))
    rows = vectors.where(whole).select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
                                       F.size("vector").alias("width"), F.col("vector").cast("array<int>").alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    rows = materialize(rows, "mined-vectors")
    forest = plant_forest(rows.drop("anchor"), max(positives + 1, negatives), tree_rows)
    anchors = rows.where("anchor")
    n_blocks = -(-anchors.count() // block)
    number = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(max(1, n_blocks)))
    anchors = materialize(anchors.withColumn("block", number).drop("anchor"), "mined-anchors")
    far = 2**63 - 1
    asked = anchors.select(F.col("row").alias("query"), "block", F.col("row").alias("own"), "label", "width", "vector", F.lit(-far).alias("low"), F.lit(far).alias("high"))
    found = _best(forest, asked, n_blocks, positives, True, "mined-positives")
    # positives of one score share their negatives; a query is an anchor's row and the place of its first positive of that score
    first = found.groupBy(F.col("query").alias("anchor_row"), "score").agg(F.min("place").alias("place"))
    percent = lambda p: F.col("score").cast("decimal(38,0)") * F.lit(p).cast("decimal(10,0)") / F.lit(100).cast("decimal(10,0)")
    windows = first.select("anchor_row", (F.col("anchor_row") * positives + F.col("place") - 1).alias("query"), F.ceil(percent(low_percent)).cast("long").alias("low"), F.floor(percent(high_percent)).cast("long").alias("high"), "score")
    windows = materialize(windows, "mined-windows")
    asked = windows.join(anchors.withColumnRenamed("row", "anchor_row"), "anchor_row").select("query", "block", F.lit(-1).cast("long").alias("own"), "label", "width", "vector", "low", "high")
    hard = _best(forest, asked, n_blocks, negatives, False, "mined-negatives")
    pairs = found.select(F.col("query").alias("anchor_row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.join(windows.select("anchor_row", "query", F.col("score").alias("positive_score")), ["anchor_row", "positive_score"])
    pairs = pairs.join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    hard = hard.select("query", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(hard, "query").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
