"""Scalar rules on fixed inputs."""

import base64

import pytest
from pyspark.sql import functions as F

from newsflow.functions import arabic, dates, similarity, text

NOW = 1_785_672_000_000 + 10**9


@pytest.fixture
def one(spark):
    def run(f, *values):
        kinds = ", ".join(f"c{i} {'long' if isinstance(v, int) else 'string'}" for i, v in enumerate(values))
        return spark.createDataFrame([values], kinds).select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]

    return run


def test_arabic(one):
    assert [one(arabic.stem, w) for w in ("والوزير", "وزير", "والد", "الان")] == ["وزير", "زير", "الد", "الان"]
    assert one(arabic.normalize, "أَعْلَنَتْ الحكومة ٣") == "اعلنت الحكومه 3" == arabic.normalize_text("أَعْلَنَتْ الحكومة ٣")
    assert one(arabic.dedupe_tokens, "عاجل: قصف غزة") == one(arabic.dedupe_tokens, "قصف غزة")
    assert one(arabic.normalize, "see https://x.y/z now!") == "see now"


def test_urls(one):
    want = {"http://www.BBC.com/a/?utm_source=x&b=2&a=1#f": "https://bbc.com/a/?a=1&b=2", "https://x.com/a/b/": "https://x.com/a/b", "HTTPS://WWW.x.com/": "https://www.x.com",
            "http://x.com?a": "https://x.com?a=", " Foo ": "foo", "http://x.com:80/p": "https://x.com:80/p"}
    assert {u: one(text.canonical_url, u) for u in want} == want
    inner = base64.urlsafe_b64encode(b'\x08\x13"\x20https://example.com/some/article\xd2\x01').decode().rstrip("=")
    assert one(text.embedded_url, f"https://news.google.com/rss/articles/{inner}?oc=5") == "https://example.com/some/article"
    assert one(text.valid_url, "httpfoo/x") is None and one(lambda c: text.valid_url(c, True), "http://x/y") is None


def test_hash(one):
    def fnv(s):
        h = 14695981039346656037
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return format(h - 2**64 if h >> 63 else h, "x")

    for s in ["", "a", "foobar", "عاجل", *[f"k{i}" for i in range(8)]]:
        assert one(text.stable_hash, s) == fnv(s)


def test_text(one):
    assert one(text.plain_text, "<p>&amp;quot;x&amp;quot;</p> &#1593; &a_8;") == '"x" ع'
    assert one(text.plain_text, "<p> </p>") is None
    long = one(lambda c: text.truncate(c, 200), "word " * 50)
    assert len(long) <= 201 and long.endswith("…")
    assert one(text.without_outlet, "Headline long enough - رويترز") == "Headline long enough" and one(text.without_outlet, "a - b") == "a - b"
    assert [one(text.count_label, n) for n in (1, 2, 10, 11)] == ["خبر جديد", "خبران جديدان", "10 أخبار جديدة", "11 خبرًا جديدًا"]


def test_dates(one):
    want = {"Sun, 02 Aug 2026 10:00:00 +0300": 1785654000000, "2026-08-02T10:00+03:00": 1785664800000, "2026-02-30T10:00:00Z": None, "2026-08-02 10:00:00": 1785664800000,
            "02 Aug 26 10:00 EST": 1785682800000, "": None, "soon": None}
    assert {d: one(lambda c: dates.parse_date(c, NOW), d) for d in want} == want
    assert one(lambda c: dates.parse_date(c, 1785664800000 - 61 * 60_000), "2026-08-02T10:00:00Z") is None


def test_relative_time(one):
    n, minute, hour = 1_785_672_000_000, 60_000, 3_600_000
    ages = {59_000: "الآن", minute: "قبل دقيقة", 2 * minute: "قبل دقيقتين", 5 * minute: "قبل 5 دقائق", 25 * minute: "قبل 25 دقيقة", hour: "قبل ساعة", 11 * hour: "قبل 11 ساعة",
            24 * hour: "أمس", 48 * hour: "قبل يومين", 240 * hour: "قبل 10 أيام", 264 * hour: "22 يوليو"}
    assert {a: one(lambda c: dates.relative_time(c, n), n - a) for a in ages} == ages


def test_similarity(one):
    assert one(similarity.profile, "") == {"  ": 1}
    assert one(lambda a, b: similarity.cosine(similarity.profile(a), similarity.profile(b)), "", "") == pytest.approx(1.0)
    assert one(similarity.text_cosine, "", "x") == 0.0
    words = lambda c: F.split(c, " ")
    assert one(lambda a, b: similarity.jaccard(words(a), words(b)), "a b c", "b c d") == 0.5


def test_entities_equal_the_feed_readers_own_decoding(spark):
    """The column against the reader's plain function, and no Python in the plan."""
    import random

    from newsflow.sources import feeds

    rng = random.Random(3)
    parts = ["&", "#", "x", "amp;", "&amp;", "&AMP;", "&nbsp;", "&#65;", "&#x41;", "&#x1F600;", "&#55296;", "&#0065;", "&#00;", "&#x110000;", "&#99999999999;", "&#12ab;", ";", "a", " ", "&Dagger;",
             "&DAGGER;", "&shy;", "&zz;", "&a b;", "é", "😀", "&" + "y" * 64 + ";", "&" + "y" * 65 + ";", "\n", "<", ">", "&Eacute;", "&lt;", "&#38;"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))),) for _ in range(4_000)] + [(None,), ("",), ("&amp;" * 5_000,)]
    out = spark.createDataFrame(rows, "t string").select("t", text.decode_entities(F.col("t")).alias("d"))
    assert "Python" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        assert r.d == (None if r.t is None else feeds.decode_text(r.t)), r.t


def test_date_patterns_are_matched_once_a_form(spark):
    from pyspark.sql import functions as F

    from newsflow.functions import dates

    frame = spark.createDataFrame([("2026-01-02T03:04:05-0230",)], "t string").select(dates.parse_date(F.col("t"), 4_000_000_000_000).alias("ms"))
    assert frame.first()["ms"] == 1_767_332_045_000
    assert "regexp_extract" not in frame._jdf.queryExecution().analyzed().toString()
