"""Hard negatives against brute force: ties, copies, extreme values, lengths, blocks; and that whole nodes go unvisited."""

import numpy as np
import pytest

from newsflow.llm import hard_negatives as hn
from newsflow.llm import queries


def brute(rows, k=5):
    """rows: (id, label, vector, anchor), usable ones."""
    out = []
    for i, (a, la, va, anchor) in enumerate(rows):
        if not anchor:
            continue
        scored = [(-sum(x * y for x, y in zip(va, vb, strict=True)), b, lb) for j, (b, lb, vb, _) in enumerate(rows) if j != i and len(vb) == len(va)]
        for s, p, _ in sorted((x for x in scored if x[2] == la))[:k]:
            window = sorted(x for x in scored if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(a, p, n + 1, b, -s, -t) for n, (t, b, _) in enumerate(window)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "id long, label string, vector array<long>, anchor boolean")
    return sorted(tuple(r) for r in hn.mine_hard_negatives(df, **more).collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        v = rng.integers(-3, 4, 4) if i % 3 else np.array([2, 1, 0, 1])  # a third are copies, and small whole numbers tie
        rows.append((i, str(rng.integers(0, 3)), v.tolist(), i % 20 == 0))
    assert mined(spark, rows, tree_rows=64, block=7) == brute(rows)


def test_long_vectors_lengths_and_unusable_rows(spark):
    big = 2**30
    rows = [(0, "a", [big, 3], True), (1, "a", [big, 2], False), (2, "b", [big - 1, 5], False), (3, "b", [big, 2], False), (3, "b", [big, 2], False),
            (4, "a", [1, 2, 3], True), (5, "a", [1, 2, 4], False), (6, "c", [1, 2, 3], False), (7, "a", [], True), (8, "a", [], False), (9, "b", [], False), (10, "x", [5, 5, 5], True)]
    bad = [(None, "a", [1, 2], True), (20, None, [1, 2], True), (21, "a", None, True), (22, "a", [1, None], True), (23, "a", [2**40, 1], True), (24, "a", [1, 2], None)]
    usable = [*rows, (24, "a", [1, 2], False)]
    assert mined(spark, [*rows, *bad]) == brute(usable)
    assert mined(spark, []) == []


def test_whole_nodes_go_unvisited():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 100
    x = (centres[np.arange(4000) % 20] + rng.normal(size=(4000, 16)) * 3).astype(np.int32)
    tree = hn.build_tree(x)
    order = tree["order"]
    q = x[:50]
    far = 2**62
    block = hn.Block(q, np.arange(50), np.full(50, -far), np.full(50, far), 5)
    scored = hn.search(tree, x[order], order, order, block, np.arange(50))
    exact = q.astype(np.int64) @ x.T.astype(np.int64)
    exact[np.arange(50), np.arange(50)] = -far
    for i in range(50):
        best = np.lexsort((np.arange(4000), -exact[i]))[:5]
        assert block.ids[i].tolist() == best.tolist() and block.scores[i].tolist() == exact[i][best].tolist()
    assert scored < 0.5 * 50 * 4000
    # both bounds: a narrow window far from the best scores
    top = np.sort(exact, axis=1)[:, -1]
    block = hn.Block(q, np.full(50, -1), (0.4 * top).astype(np.int64), (0.45 * top).astype(np.int64), 5)
    scored = hn.search(tree, x[order], order, order, block, np.arange(50))
    exact = q.astype(np.int64) @ x.T.astype(np.int64)
    for i in range(50):
        inside = np.flatnonzero((exact[i] >= block.low[i]) & (exact[i] <= block.high[i]))
        best = inside[np.lexsort((inside, -exact[i][inside]))][:5]
        assert [v for v, s in zip(block.ids[i].tolist(), block.scores[i].tolist(), strict=True) if s > hn._NONE] == best.tolist()
    assert scored < 0.5 * 50 * 4000


@pytest.mark.parametrize("kind", ["float", "double"])
def test_query_over_nulls_and_labels(spark, tmp_path, kind):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 10)), [float(x) for x in rng.integers(-40, 41, 6) / 16], "extra") for i in range(400)]
    rows += [(1000, None, [1.0] * 6, None), (1100, 3, None, None), (1200, 3, [1.0, None] * 3, None), (1300, 3, [float("nan")] * 6, None), (1400, 3, [float("inf")] * 6, None), (None, 3, [9.0] * 6, None)]
    folder = str(tmp_path / kind)
    spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>, row string").write.parquet(f"{folder}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op11_hard_negatives(spark, folder).collect())
    usable = [(i, str((lab + 1) % 10 if i % 7 == 0 else lab), [int(np.floor(256 * x)) for x in v], i % 100 == 0) for i, lab, v, _ in rows if i is not None and i < 1000]
    assert got == brute(usable)
