"""Scoring, de-duplication, the table, sync and streaming."""

import random

import pytest
from pyspark.sql import functions as F

from newsflow.operators import classify as scoring
from newsflow.operators import dedupe, funnel, store
from newsflow.plans.sync import sync
from newsflow.sources.vocabulary import EVENT_WORDS, Vocabulary, Weights, load_vocabulary
from newsflow.streaming.live import NewCounter, start_sync

HOUR = 3_600_000
NOW = 500_000 * HOUR
RAW = "source_id string, title string, summary string, url string, published_at long, image_url string, categories array<string>, seq long"


def scores(spark, title, age=7 * HOUR, summary=None, url="https://x/y", categories=()):
    rows = spark.createDataFrame([("s", title, summary, url, NOW - age, None, list(categories), 0)], RAW)
    return scoring.classify(rows, NOW).first()["classification"]


def test_vocabulary():
    assert len(EVENT_WORDS) == len(set(EVENT_WORDS)) == 300
    v = Vocabulary().prepared()
    assert [len(x) for x in (v.breaking, v.breaking_exclusions, v.politics, v.economy, v.negative, v.analysis_prefixes, v.event_verbs)] == [5, 6, 25, 26, 44, 15, 300]
    assert load_vocabulary("{").breaking == () and load_vocabulary('{"eventVerbs": ["a"], "x": 1}').event_verbs == ("a",)


def test_scoring(spark):
    assert scores(spark, "عاجل قصف")["breaking_score"] == 5 + 3  # the marker is a path word too
    assert scores(spark, "الحرائق مستمرة حتى الآن")["breaking_score"] == 0
    assert [scores(spark, "x", age)["breaking_score"] for age in (30 * 60_000, 2 * HOUR, 6 * HOUR, 6 * HOUR + 1, -300_000)] == [5, 5, 4, 0, 5]
    assert scores(spark, "قصف جيش؟")["topic_score"] == 3 - 6
    assert scores(spark, "لماذا قصف جيش")["topic_score"] == 3 - 6
    gate = scores(spark, "رئيس حكومة", HOUR, url="https://x/politics/1")
    assert not gate["has_event_signal"] and not gate["accepted"]
    assert scores(spark, "أعلن رئيس حكومة", HOUR, url="https://x/politics/1")["accepted"]
    sport = scores(spark, "مباراة", HOUR, url="https://x/sport/1")
    assert sport["topic_score"] == -4 - 6 and sport["breaking_score"] == 5 - 3 - 3


def test_phrases_equal_contains_on_arabic_rows(spark):
    """Look-ups by token against one ``contains`` a phrase, over rows made of the default vocabulary."""
    v = Vocabulary().prepared()
    rng = random.Random(9)
    pool = [*v.event_verbs, *v.politics, *v.economy, *v.negative, *v.breaking, *v.breaking_exclusions, "كلمة", "word", "في"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(600)] + [""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", F.concat(F.lit(" "), "t", F.lit(" "))).withColumn("w", F.split(F.trim("s"), " "))
    for phrases in (v.event_verbs, v.politics, v.economy, v.negative, v.breaking):
        p = scoring._Phrases(phrases)
        out = frame.select(scoring._found(F.col("s"), phrases).alias("a"), p.found(F.col("s"), F.col("w")).alias("b"), p.first(F.col("s"), F.col("w")).alias("first")).collect()
        assert all(sorted(r.a) == sorted(r.b) and r.first == (r.a[0] if r.a else None) for r in out)
        assert any(len(r.a) > 1 for r in out)


def test_sweep(spark):
    rows = spark.createDataFrame([("s", "أعلن رئيس حكومة", None, "https://x/politics/1", NOW - HOUR, None, [], 0)], RAW)
    got = {r.label: r.accepted for r in scoring.sweep(rows, NOW, [Weights(), Weights(min_topic=9)]).collect()}
    assert sorted(got.values()) == [0, 1]


def _entry(i, source, title, at, url, stored=False, priority=1, image=None):
    return {"id": f"id{i}", "source_id": source, "title": title, "summary": None, "url": url, "canonical_url": url, "image_url": image, "published_at": at, "fetched_at": NOW,
            "breaking_score": i % 5, "topic_score": 4, "normalized_title": title, "title_hash": title, "day_bucket": at // dedupe.WINDOW, "duplicate_source_ids": [],
            "notified": stored, "seen_in_feed": stored, "priority": priority, "seq": i, "stored": stored}


def test_resolution_rules():
    twelve = 12 * HOUR
    base = _entry(0, "a", "one two three four", NOW, "u0", True)
    same = [*dedupe.resolve_rows([dict(base), _entry(1, "a", "one two three four", NOW + 5, "u0")])]
    assert same == [("already_stored", "a")]
    for late, want in ((twelve, {"merged_away", "update"}), (twelve + 1, {"insert"})):
        assert {k for k, _ in dedupe.resolve_rows([dict(base), _entry(1, "b", "one two three five", NOW + late, "u1")])} == want
    out = dict(dedupe.resolve_rows([dict(base), _entry(7, "b", "one two three four", NOW - HOUR, "u1", image="https://i")]))
    row = out["update"]
    assert (out["merged_away"], row.id, row.source_id, row.notified, list(row.duplicates), row.image_url, row.breaking_score) == ("a", "id0", "b", True, ["a"], "https://i", 2)
    # an old twin of equal hash does not stop the fuzzy scan
    old = _entry(0, "a", "p q r s", NOW - 3 * twelve, "u0", True)
    near = _entry(1, "c", "p q r s t", NOW, "u1", True)
    assert {k for k, _ in dedupe.resolve_rows([old, near, _entry(2, "b", "p q r s", NOW, "u2")])} == {"merged_away", "update"}
    # titles without tokens merge
    assert {k for k, _ in dedupe.resolve_rows([_entry(0, "a", "", NOW, "u0"), _entry(1, "b", "", NOW, "u1")])} == {"merged_away", "insert"}


def test_components_equal_one_pass(spark):
    rng = random.Random(5)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg"]
    raw, entries = [], []
    for i in range(60):
        title = " ".join(rng.sample(words, rng.randint(2, 5)))
        raw.append((f"s{i % 3}", title, None, f"https://h/{rng.randint(0, 40)}", NOW - rng.randint(0, 30) * HOUR, None, [], i))
    sources = spark.createDataFrame([("s0", 2), ("s1", 1)], "id string, priority int")
    scored = scoring.classify(spark.createDataFrame(raw, RAW), NOW)
    out = dedupe.dedupe(scored, spark.createDataFrame([], dedupe.ARTICLE_COLUMNS), sources, NOW)
    got = sorted((r.id, r.source_id, tuple(sorted(r.duplicate_source_ids))) for r in out.to_insert.collect())
    pool = dedupe.candidates(scored, sources, NOW, False).collect()
    entries = [r.asDict() for r in pool]
    want, lost = [], {}
    for kind, what in dedupe.resolve_rows(entries):
        if kind == "insert":
            want.append((what.id, what.source_id, tuple(sorted(what.duplicates))))
        elif kind == "merged_away":
            lost[what] = lost.get(what, 0) + 1
    assert got == sorted(want) and len(got) < 60
    assert {r.source_id: r.n for r in out.merged_away.collect()} == lost


def test_table(spark, tmp_path):
    table = store.ArticleStore(spark, f"file://{tmp_path}/t")
    names = [c.split()[0] for c in dedupe.ARTICLE_COLUMNS.split(", ")]
    frame = lambda rows: spark.createDataFrame([{k: r[k] for k in names} for r in rows], dedupe.ARTICLE_COLUMNS)
    rows = [_entry(i, "a", f"t{i}", NOW - i * HOUR, f"u{i}") for i in range(60)]
    assert table.read().count() == 0 and table.insert(frame(rows)).count() == 60
    assert table.insert(frame([rows[0], _entry(99, "b", "x", NOW, "u1"), _entry(98, "b", "x", NOW, "new"), _entry(97, "b", "y", NOW, "new")])).count() == 1
    table.update(frame([rows[3] | {"title": "changed"}, _entry(500, "b", "x", NOW, "no")]))
    assert store.by_id(table.read(), "id3").first().title == "changed" and table.read().count() == 61
    first = store.timeline(table.read()).collect()
    second = store.timeline(table.read(), (first[-1].published_at, first[-1].id)).collect()
    assert len({r.id for r in first + second}) == 40
    assert store.position(table.read(), second[0].id).first().position == 20
    table.mark_notified(spark.createDataFrame([("id1",)], "id string"))
    wanted = [r.id for r in store.pending(table.read(), 1, NOW - 2 * HOUR).collect()]
    assert "id1" not in wanted and "id2" in wanted
    assert table.prune(NOW - store.RETENTION) == 11 and table.prune(NOW - store.RETENTION) == 0
    assert store.newest(table.read()).first()[0] == NOW and store.count_newer(table.read(), None).first().n == 0
    table.clear()
    assert table.read().count() == 0


def _log(spark, *rows):
    return spark.createDataFrame(rows, "source_id string, source_name string, succeeded boolean, empty boolean, http_status int, offline boolean, error_class string, error string")


def _batch(spark, at, numbers):
    return spark.createDataFrame([(f"s{i % 2}", f"أعلن رئيس حكومة رقم {i} {'abcdefghij'[i % 10] * 8}", None, f"https://x/politics/{i}", at - i * 60_000, None, [], i) for i in numbers], RAW)


def test_sync_and_stream_agree(spark, tmp_path):
    sources = spark.createDataFrame([("s0", 1), ("s1", 2)], "id string, priority int")
    log = _log(spark, ("s0", "S0", True, False, None, False, None, None), ("s1", "S1", True, False, None, False, None, None), ("s2", "S2", False, False, 403, False, "HTTPError", "no"))
    one = store.ArticleStore(spark, f"file://{tmp_path}/one")
    outcome = sync(_batch(spark, NOW, range(6)), log, one, sources, NOW)
    again = sync(_batch(spark, NOW, range(6)), log, one, sources, NOW)
    assert outcome.n_inserted >= 1 and (again.n_inserted, again.pruned) == (0, 0)
    table = {r.source_id: r for r in outcome.funnel.collect()}
    assert table["s2"].status == "403" and table["s2"].parsed == 0 and table["s0"].accepted == 3
    assert "TOTAL" in funnel.render(outcome.funnel)
    nothing = sync(_batch(spark, NOW, range(1)), _log(spark, ("s2", "S2", False, False, None, True, "X", "x")), one, sources, NOW)
    assert nothing.funnel is None
    _batch(spark, NOW, range(6)).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    two = store.ArticleStore(spark, f"file://{tmp_path}/two")
    counter = NewCounter(two)
    stream = spark.readStream.schema(RAW).parquet(f"{tmp_path}/in/*")
    q = start_sync(stream, two, sources, lambda: NOW, f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    key = lambda t: sorted((r.id, r.source_id) for r in t.read().collect())
    assert key(one) == key(two) and counter.count() == 0
    counter.mark_seen()
    assert counter.count() == 0


def test_outcomes(spark):
    empty = funnel.outcome(_log(spark).limit(0)).first()
    assert (empty.any_succeeded, empty.all_failed, empty.offline) == (False, False, False)
    out = funnel.refresh_state(funnel.outcome(_log(spark, ("a", "A", False, False, None, True, None, None)))).first()
    assert (out.state, out.all_failed) == ("offline", True)
    assert funnel.loss_percent(F.lit(1), F.lit(0)) is not None


@pytest.mark.parametrize("name", ["q02_timeline_latest", "k00_classify", "j05_similar_titles", "g06_totals", "f06_canonical_url", "s15_keyed_writes", "q02_stored_latest", "q01_stored_page", "r01_changes", "t07_relative_time"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from newsflow.queries import QUERIES, SQL

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "events"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    frame = QUERIES[name](spark, d)
    columns = sorted(frame.columns)
    got = sorted(repr([r[c] for c in columns]) for r in frame.collect())
    result = con.execute(SQL[name])
    at = [[x[0] for x in result.description].index(c) for c in columns]
    assert got == sorted(repr([r[i] for i in at]) for r in result.fetchall())


def test_list_and_title_queries_take_whole_inputs(spark, tmp_path):
    from newsflow.queries import QUERIES

    lines = [f"line {k} of a long text" for k in range(100)]
    rows = [(1, "\n".join([*lines[:50], " ", *lines[50:]]), "en", "src1", 0), (2, "short", "en", "src2", 0), (3, None, "en", "src3", 0), (4, "x", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.lines for r in QUERIES["f11_list_codec_whole"](spark, str(tmp_path)).collect()} == {1: "|".join(lines), 2: "short", 3: None, 4: "x"}
    titles = {r.doc_id: r.title for r in QUERIES["f13_without_outlet_titles"](spark, str(tmp_path)).collect()}
    assert titles == {1: " ".join(lines)[:120].strip(), 2: "short - src2", 3: " - src3"}
