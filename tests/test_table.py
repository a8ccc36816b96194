"""The keyed table: which files a write touches, failed and concurrent writes, reads by time, changes, leases, live results."""

import pytest
from pyspark.sql import functions as F

from newsflow.operators import store, table
from newsflow.plans.sync import sync_once
from newsflow.streaming.live import LiveLatest

HOUR, WINDOW = 3_600_000, 43_200_000
NOW = 41_000 * WINDOW + 5 * HOUR
COLUMNS = "id string, canonical_url string, title string, published_at long, day_bucket long, notified boolean"


def frame(spark, *rows):
    return spark.createDataFrame([(f"id{i:04d}", f"u{i}", t, at, at // WINDOW, False) for i, t, at in rows], COLUMNS)


@pytest.fixture
def articles(spark, tmp_path):
    t = store.ArticleStore(spark, f"file://{tmp_path}/t", COLUMNS)
    t.insert(frame(spark, *[(i, f"t{i}", NOW - i * HOUR) for i in range(60)]))
    return t


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_a_write_touches_only_its_buckets(spark, articles):
    before = articles.files()
    assert len({s["bucket"] for s in before.values()}) == len(before) == 6
    assert ids(articles.insert(frame(spark, (100, "x", NOW - 20 * HOUR), (5, "y", NOW)))) == ["id0100"]
    after = articles.files()
    assert set(before) < set(after) and [s["bucket"] for f, s in after.items() if f not in before] == [(NOW - 20 * HOUR) // WINDOW]
    articles.update(frame(spark, (3, "changed", NOW - 3 * HOUR), (777, "unknown", NOW)))
    last = articles.manifest()
    assert {after[f]["bucket"] for f in last["removed"]} == {(NOW - 3 * HOUR) // WINDOW} and set(after) - set(last["removed"]) < set(last["files"])
    assert store.by_id(articles.read(), "id0003").first().title == "changed" and articles.read().count() == 61
    # a row may move to another bucket
    articles.update(frame(spark, (4, "moved", NOW - 50 * HOUR)))
    assert {s["bucket"] for s in articles.files().values() if s["rows"]} and store.by_id(articles.read(), "id0004").first().published_at == NOW - 50 * HOUR
    n = articles.versions()[-1]
    articles.update(frame(spark, (777, "unknown", NOW)))
    articles.insert(frame(spark, (5, "y", NOW)))
    articles.mark_notified(spark.createDataFrame([("none",)], "id string"))
    assert articles.versions()[-1] == n
    articles.mark_notified(spark.createDataFrame([("id0007",)], "id string"))
    assert [r.id for r in articles.read().where("notified").collect()] == ["id0007"]
    data = table._Folder(spark, f"{articles.path}/data")
    named = {f for v in articles.versions() for f in articles.files(v)}
    assert len(articles.versions()) == 2 and all(data.fs.exists(data.at(f"{articles.path}/data/{f}")) for f in named)
    assert not any(data.fs.exists(data.at(f"{articles.path}/data/{f}")) for f in set(before) - named)


def test_prune_drops_whole_buckets_unread(spark, articles, monkeypatch):
    before = articles.files()
    edge = (NOW // WINDOW - 2) * WINDOW
    with monkeypatch.context() as m:
        m.setattr(articles, "read", lambda *_: pytest.fail("read"))
        assert articles.prune(edge) == sum(s["rows"] for s in before.values() if s["newest"] < edge) > 0
    read = []
    whole = articles.read
    monkeypatch.setattr(articles, "read", lambda files=None: read.append(sorted(files)) or whole(files))
    assert articles.prune(edge + HOUR) == 1 and [len(r) for r in read] == [1]
    assert articles.prune(edge + HOUR) == 0


def test_a_failed_write_is_unseen_and_one_of_two_writers_wins(spark, articles, monkeypatch):
    version, base = articles.versions(), articles.manifest()
    broken = frame(spark, (200, "x", NOW)).withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        articles.append(broken, base)
    assert articles.versions() == version and articles.read().count() == 60
    other = store.ArticleStore(spark, articles.path, COLUMNS)
    other.insert(frame(spark, (201, "x", NOW)))
    with pytest.raises(table.Conflict):
        articles.append(frame(spark, (202, "x", NOW)), base)
    assert articles.read().count() == 61
    assert articles.vacuum(HOUR) == 0 and articles.vacuum(-HOUR) == 1 and articles.read().count() == 61


def test_hot_buckets_are_parted_and_crowded_ones_compacted(spark, tmp_path):
    t = store.ArticleStore(spark, f"file://{tmp_path}/hot", COLUMNS, file_rows=100)
    t.insert(frame(spark, *[(i, "t", NOW - i) for i in range(1000)]))
    assert max(s["rows"] for s in t.files().values()) <= 100
    small = store.ArticleStore(spark, f"file://{tmp_path}/small", COLUMNS)
    for k in range(4):
        small.insert(frame(spark, (k, "t", NOW - k), (k + 10, "t", NOW - 13 * HOUR * (k == 0))))
    assert small.compact(3) == 1 and small.compact(3) == 0 and small.read().count() == 8
    assert small.changes(small.versions()[-1]).count() == 0


def test_files_go_with_rows_and_not_with_buckets(spark, tmp_path):
    rows = spark.range(3000).select(F.format_string("id%04d", "id").alias("id"), F.concat(F.lit("u"), "id").alias("canonical_url"), F.lit("t").alias("title"), (NOW - F.col("id") * 4 * HOUR).alias("published_at"))
    rows = rows.select("*", F.floor(F.col("published_at") / WINDOW).alias("day_bucket"), F.lit(False).alias("notified"))
    t = store.ArticleStore(spark, f"file://{tmp_path}/wide", COLUMNS)
    t.insert(rows)
    files = t.files()
    assert len(files) <= table.WRITE_FILES + 1 and sum(s["rows"] for s in files.values()) == 3000 == t.read().count()
    spans = sorted((s["bucket"], s["last"]) for s in files.values())
    assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
    some = NOW // WINDOW - 500
    assert ids(t.read_buckets(some, some + 1)) == ids(t.read().where(F.col("day_bucket").between(some, some + 1))) and len(t.read_buckets(some, some).inputFiles()) == 1
    assert len(t.latest(20).inputFiles()) == 1 and [r.id for r in t.latest(20).collect()] == [f"id{i:04d}" for i in range(20)]
    t.update(rows.where("id = 'id0700'").withColumn("title", F.lit("changed")))
    assert len(t.manifest()["removed"]) == len(t.manifest()["added"]) == 1 and t.read().where("title = 'changed'").count() == 1
    for k in range(3):
        t.insert(frame(spark, (5000 + k, "t", NOW - 100 * 4 * HOUR)))
    assert t.compact(3) == 1 and t.compact(3) == 0 and t.read().count() == 3003
    assert t.prune(NOW - 1000 * 4 * HOUR) == 1999 and t.read().count() == 1004


def test_reads_by_time_take_few_files(spark, articles):
    everything = articles.read()
    newest = [r.id for r in store.latest(everything, 7).collect()]
    assert [r.id for r in articles.latest(7).collect()] == newest
    assert len(articles.latest(3).inputFiles()) == 1 and len(articles.latest(7).inputFiles()) == 2 < len(articles.files())
    page, seen = articles.timeline(None, 9), []
    while rows := page.collect():
        seen += [r.id for r in rows]
        assert len(page.inputFiles()) <= 3
        page = articles.timeline((rows[-1].published_at, rows[-1].id), 9)
    assert seen == [r.id for r in store.latest(everything, 100).collect()] and len(seen) == 60
    assert articles.position("id0004", 10).first().position == 4 and articles.position("id0040", 10).count() == 0
    assert len(articles.read_buckets(NOW // WINDOW, NOW // WINDOW).inputFiles()) == 1


def test_changes_and_live_results(spark, articles, tmp_path):
    out = []
    live = LiveLatest(articles, lambda v, rows: out.append((v, [r.id for r in rows], [r.title for r in rows])), 5)
    q = live.start(f"file://{tmp_path}/cp")

    def after(*ids_, title=None):
        q.processAllAvailable()
        want = [f"id{i:04d}" for i in ids_]
        assert out[-1][1] == want and (title is None or title in out[-1][2]) and out[-1][1] == [r.id for r in articles.latest(5).collect()]

    after(0, 1, 2, 3, 4)
    articles.insert(frame(spark, (300, "old", NOW - 30 * HOUR)))
    q.processAllAvailable()
    assert len(out) == 1  # outside: nothing is emitted
    articles.insert(frame(spark, (301, "new", NOW + 1), (302, "mid", NOW - HOUR - 1)))
    after(301, 0, 1, 302, 2)
    articles.update(frame(spark, (1, "other", NOW - HOUR)))
    after(301, 0, 1, 302, 2, title="other")
    assert [(r.id, r._change) for r in articles.changes(articles.versions()[-1]).orderBy("_change").collect()] == [("id0001", "delete"), ("id0001", "insert")]
    articles.update(frame(spark, (0, "gone down", NOW - 40 * HOUR)))
    after(301, 1, 302, 2, 3)
    n = len(out)
    articles.prune(NOW - 20 * HOUR)
    q.processAllAvailable()
    assert len(out) == n
    articles.prune(NOW - HOUR)
    after(301, 1)
    articles.clear()
    after()
    q.stop()
    again = LiveLatest(articles, lambda v, rows: out.append((v, [r.id for r in rows], [])), 5)
    articles.insert(frame(spark, (400, "x", NOW)))
    q = again.start(f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert out[-1][1] == ["id0400"] and [v for v, _, _ in out] == sorted({v for v, _, _ in out})


def test_one_of_two_syncs_runs_and_a_dead_owner_is_fenced_off(spark, articles):
    other = store.ArticleStore(spark, articles.path, COLUMNS)
    inside = []

    def run():
        inside.append(sync_once("two", other, lambda: "ran", NOW))
        return "ran"

    assert sync_once("one", articles, run, NOW) == "ran" and inside == [None]
    assert sync_once("two", other, lambda: "ran", NOW) == "ran"
    assert articles.acquire("one", HOUR, NOW) and not other.acquire("two", HOUR, NOW + HOUR - 1)
    base = articles.manifest()
    assert other.acquire("two", HOUR, NOW + HOUR)  # the first owner is taken for dead
    with pytest.raises(table.Conflict):
        articles.append(frame(spark, (500, "x", NOW)), base)
    articles.release()
    assert other.append(frame(spark, (501, "x", NOW)), base) == base["version"] + 1
    other.release()
    assert ids(articles.read().where("id >= 'id05'")) == ["id0501"]


def test_scratch_tables_go_and_lasting_ones_stay(spark):
    from newsflow.tables import materialize, scratch

    with scratch(spark):
        one = materialize(spark.range(3), "one")
        kept = materialize(one.where("id > 0"), "kept", lasting=True)
        with scratch(spark):
            two = materialize(one, "two")
        assert one.count() == 3
        inner = two.inputFiles()
    assert kept.count() == 2
    fs = table._Folder(spark, kept.inputFiles()[0])
    assert not any(fs.fs.exists(fs.at(f)) for f in inner + one.inputFiles())
