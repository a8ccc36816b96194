"""Personal data: base spans against plain patterns, disguises, offsets, and the cases that the docstring defines."""

import hashlib
import random
import re

import pytest

from newsflow.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in digits(m[0])]
        doubled = [x if k % 2 == len(d) % 2 - 1 or (len(d) - 1 - k) % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for k, x in enumerate(d)]
        if 12 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    parts = ["a@b.c", "1", "22", "255", "256", "0007", ".", "@", "+", "-", " ", "(", ")", "a", "B", "%", "_", "12.3.4.5", "4111111111111111", "é", "😀", "\n", "--"]
    rng = random.Random(5)
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.find_plain(text) == brute(text), text


DISGUISED = [
    ("write john dot smith at example dot com now", "john dot smith at example dot com", "email", "john.smith@example.com"),
    ("😀 a.b [at] example.com x", "a.b [at] example.com", "email", "a.b@example.com"),
    ("foo@example[.]com", "foo@example[.]com", "email", "foo@example.com"),
    ("call plus one five five five one two three four five six seven ok", "plus one five five five one two three four five six seven", "phone", "+15551234567"),
    ("ip one nine two dot one six eight dot one dot four", "one nine two dot one six eight dot one dot four", "ip", "192.168.1.4"),
    ("192[.]168[.]1[.]44", "192[.]168[.]1[.]44", "ip", "192.168.1.44"),
    ("jоhn@exаmple.cоm", "jоhn@exаmple.cоm", "email", "john@example.com"),
    ("x ｊｏｈｎ＠ｅｘ.com", "ｊｏｈｎ＠ｅｘ.com", "email", "john@ex.com"),
    ("j​ohn@exam​ple.com", "j​ohn@exam​ple.com", "email", "john@example.com"),
    ("+٩٧١ ٥٠ ١٢٣ ٤٥٦٧", "+٩٧١ ٥٠ ١٢٣ ٤٥٦٧", "phone", "+971 50 123 4567"),
    ("más cinco cinco uno dos tres cuatro cinco seis siete ocho", "más cinco cinco uno dos tres cuatro cinco seis siete ocho", "phone", "+5512345678"),
    ("+49 triple five one two three double four", "+49 triple five one two three double four", "phone", "+49 55512344"),
]


@pytest.mark.parametrize(("text", "source", "kind", "value"), DISGUISED)
def test_disguises_map_back_to_the_source(text, source, kind, value):
    base = pii.find_plain(text)
    found = {(text[a:e], pii.KINDS[k], v) for a, k, e, v in pii.find_disguised(text, base)}
    assert base == [] and (source, kind, value) in found


@pytest.mark.parametrize("text", ["look at example.com", "meet me at noon", "nine nine, one two three four", "foo@bar.com point de vue", "Россия 2024", "one two three four five", "[at] [dot]", "a [at] b"])
def test_clean_texts_get_nothing_more(text):
    assert pii.find_disguised(text, pii.find_plain(text)) == []


def test_offsets_through_the_chain():
    """Every span of a text between other disguises ends where its source ends."""
    rng = random.Random(8)
    for _ in range(300):
        text, wanted = "", []
        for _ in range(rng.randint(1, 6)):
            text += rng.choice(["lorem ​", "абв ", "one two \n", "\U0001f600 ipsum ", "dot. ", "12 apples; "])
            case = rng.choice(DISGUISED)
            if case[0] == case[1]:
                wanted.append((len(text), len(text) + len(case[1]), case[3]))
                text += case[1] + "; "
        found = {(a, e, v) for a, _, e, v in pii.find_disguised(text, pii.find_plain(text))}
        assert set(wanted) <= found, text


def test_long_texts_are_linear():
    import time

    began = time.perf_counter()
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "+1" * 100_000, "1 " * 200_000, "at " * 100_000, "one " * 50_000, "a at b dot " * 20_000, "1.1.1.1." * 30_000, "[at]" * 50_000):
        pii.find_disguised(text, pii.find_plain(text))
    assert time.perf_counter() - began < 30


def test_query_columns_nulls_repeats_and_masking(spark, tmp_path):
    long = "x " * 100_000 + "me@mail.example.com"
    rows = [(1, "a b.c@d.ef and +1 (017) 555-7713", 5, "t"), (1, "a b.c@d.ef and +1 (017) 555-7713", 5, "t"), (2, None, None, "u"), (3, "", 0, None), (None, "me at site dot org", 18, "v"), (4, long, len(long), "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, base string")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    out = queries.op13_pii(spark, folder).collect()
    assert len(out) == len(rows)
    one = [r for r in out if r["doc_id"] == 1]
    assert len(one) == 2 and one[0] == one[1]
    assert (one[0]["n_email"], one[0]["n_phone"], one[0]["n_card"], one[0]["n_ip"]) == (1, 1, 0, 0)
    assert one[0]["spans"] == "email:2:10,phone:15:32" and one[0]["base_sha256"] == hashlib.sha256(one[0]["spans"].encode()).hexdigest()
    empty = [r for r in out if r["doc_id"] in (2, 3)]
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in empty)
    hidden = next(r for r in out if r["doc_id"] is None)
    assert hidden["spans"] == "email:0:18" and hidden["n_email"] == 0 and hidden["n_added"] == 1
    masked = {(r["doc_id"], r["base"]): r for r in pii.mask_pii(docs).collect()}
    assert masked[1, "t"]["text"] == "a [EMAIL] and [PHONE]" and masked[1, "t"]["n_chars"] == 21
    assert masked[2, "u"]["text"] is None and masked[2, "u"]["n_chars"] is None and masked[3, None]["n_chars"] == 0
    assert masked[None, "v"]["text"] == "[EMAIL]" and masked[4, "w"]["text"].endswith("x [EMAIL]")
    none = docs.limit(0)
    none.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert queries.op13_pii(spark, folder).count() == 0 and pii.mask_pii(none).count() == 0
