"""Ranked search against scoring every document: statistics, ties, shards, long items, and the defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np

from newsflow.llm import queries
from newsflow.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(rs.UPPER, rs.LOWER)


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    bags = [(d, Counter(split(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_all, l_all = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(split(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in ts if b[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms_equal_the_pattern():
    rng = random.Random(2)
    for _ in range(5_000):
        text = "".join(rng.choice(["a", "B", "é", "İ", "1", "_", "-", " ", "\n", "\x00", "\x7f", " ", " ", "😀", "ẞ", "@", "[", "{", "z", "Z"]) for _ in range(rng.randint(0, 20)))
        assert [t.decode() for t in rs.terms(text)] == split(text)


def test_equals_scoring_every_document(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.expovariate(0.08))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(700)]
    docs += [(i + 1000, "Same text w1 w2, w300.") for i in range(200)] + [(5, docs[5][1]), (None, "w1 w2 w3 w300"), (None, "w1 w2 w3 w300"), (2000, None), (2001, ""), (2002, "... --"), (2003, "w7 " * 30_000 + "w300")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(25)]
    items += [(25, "same TEXT"), (26, None), (27, ""), (None, "w1"), (28, "nowhere"), (29, "w1"), (29, "w2"), (30, " ".join({*words}))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", rs.F.lit(1)).repartition(3)
    q = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", rs.F.lit("x"))
    index = rs.build_index(d, shard_bytes=4_000, shard_documents=64)
    assert index.count() > 20
    want = brute(docs, items)
    assert rows(rs.search(index, q)) == want
    assert rows(rs.search(index, q, block_terms=30)) == want
    assert rows(rs.search(rs.build_index(d), q, k=7)) == brute(docs, items, 7)


def test_best_first_opens_few_nodes_and_long_items_stay_small(monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices([f"c{j}" for j in range(50)], k=30)) + (f" rare{i // 4}" if i % 4 else "")) for i in range(4_000)]
    bags = [(i, len(t.split()), Counter(rs.terms(t))) for i, t in docs]
    shard = rs.make_shard(bags, 4_000, sum(n for _, n, _ in bags))
    postings = rs.Postings(np.frombuffer(shard["planes"], np.uint64).reshape(shard["bits"], -1), np.frombuffer(shard["impacts"], np.int32))
    starts, names = np.frombuffer(shard["starts"], np.int32), shard["dictionary"].split(b" ")
    place = {t: i for i, t in enumerate(names)}
    asked = np.array([place[b"rare77"], place[b"c3"], place[b"c9"]])
    doc, score, opened = postings.top(starts[asked], starts[asked + 1], np.array([9000, 30, 20]), 3)
    assert set(doc) <= {309, 310, 311} and list(score) == sorted(score, reverse=True) and opened < 1_000
    everything = np.arange(len(names))
    whole = postings.top(starts[everything], starts[everything + 1], np.ones(len(names), np.int64), 10)
    monkeypatch.setattr(rs, "FRONTIER_NUMBERS", 10_000)  # the deepest nodes first
    deep = postings.top(starts[everything], starts[everything + 1], np.ones(len(names), np.int64), 10)
    assert whole[0].tolist() == deep[0].tolist() and whole[1].tolist() == deep[1].tolist()


def test_query_over_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = spark.createDataFrame([(1, "one two")], "doc_id long, text string"), spark.createDataFrame([(1, "two")], "item_id long, text string")
    for d, q, n in ((docs, items, 1), (docs.limit(0), items, 0), (docs, items.limit(0), 0)):
        d.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        q.write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
        out = queries.op12_ranked_search(spark, folder)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == n
