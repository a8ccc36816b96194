"""The pipeline's stages and its whole run on a small fixture, and operators against independent versions."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsflow.llm import language_id, license_scan, secret_scan
from newsflow.llm.queries import tokenizer_path

SYLLABLES = {"en": ["th", "er", "on", "an", "re", "he", "in"], "fr": ["eau", "oui", "éch", "tre", "ou", "ier"], "de": ["sch", "ung", "heit", "ver", "zu", "ö"]}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(i, invented(rng, lang, rng.randint(30, 90)), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(240))]
    question = invented(rng, "en", 20)
    rows += [(500, rows[0][1], "en"), (501, rows[1][1] + " und", None), (502, question, "en"), (503, invented(rng, "en", 30) + " " + question + " yy", "en"), (504, None, "en"), (505, "12 34 !!", None),
             (506, invented(rng, "en", 40) + " password = hunter2hunter2x", "en"), (507, invented(rng, "en", 6000), "en"), (None, invented(rng, "de", 50), "de")]
    frame = spark.createDataFrame([(i, t, lang, f"s{(i or 0) % 3}", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.withColumns({c: F.lit("kept") for c in ("language", "_gone", "_spans", "_clean", "node")})
    place = tmp_path_factory.mktemp("tables")
    frame.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([("q1", question), ("q2", None)], "item_id string, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place), question


def test_pipeline(spark, folder):
    place, question = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], place)
        assert out.columns == columns
        kept.append(out.cache())
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert {504, 505} <= ids[0] - ids[1] and len(ids[0] - ids[1]) <= 4 and {r.language for r in kept[1].collect()} == {"kept"}
    assert ids[1] - ids[2] == {500, 501} and ids[2] - ids[3] == {502, 503} and ids[3] == ids[4]
    redacted = {r.doc_id: r for r in kept[4].collect()}
    assert redacted[506].text.endswith(" [SECRET]") and redacted[506].n_chars == len(redacted[506].text)
    assert all(redacted[i].text == t for i, t in ((r.doc_id, r.text) for r in kept[3].collect()) if i != 506)
    from tokenizers import Tokenizer

    fresh, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}
    for i, r in redacted.items():
        encoded = np.array(fresh.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(encoded), 4096):
            want[i, k // 4096] = (k, len(encoded[k:k + 4096]), zlib.crc32(encoded[k:k + 4096].tobytes()))
    packed = corpus_pipeline.run(spark, place).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == want
    assert len({r.sequence_id for r in packed}) == -(-sum(r.length for r in packed) // 4096)


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_model(spark):
    """Held-out accuracy on a whole table, finite scores, snippets that are less sure, rejection of what is no known language."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(language_id.training_rows(docs))
    assert np.isfinite(model.scores).all() and 0 < model.threshold < 1
    held = docs.where(language_id.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()
    langs, score = language_id.score_texts(model, [r.text for r in held])
    assert np.isfinite(score).all() and score.min() >= 0 and score.max() <= 1
    assert np.mean([x == r.lang for x, r in zip(langs, held)]) >= 0.98 and np.mean(score < model.threshold) < 0.01
    _, snippets = language_id.score_texts(model, [" ".join(r.text.split()[:2]) for r in held])
    assert np.mean(snippets > 0.999) < 0.5 and np.median(snippets) < np.median(score) + 1e-9
    rng = random.Random(1)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(rng.randint(30, 900))) for _ in range(200)]
    other = ["Всем привет, это текст на русском языке.", "Tämä on suomenkielinen teksti jota malli ei tunne", "Ez egy magyar nyelvű szöveg, amelyet a modell nem ismer"]
    assert (language_id.score_texts(model, junk)[1] < model.threshold).mean() > 0.95 and (language_id.score_texts(model, other)[1] < model.threshold).all()


def test_license_pruning_loses_nothing():
    rng = random.Random(9)
    index = license_scan.TemplateIndex()
    texts = [t for some in license_scan.TEMPLATES.values() for t in some]
    for _ in range(400):
        words = license_scan._NO_WORD.sub(" ", rng.choice(texts).lower()).split()
        for _ in range(rng.randint(0, 6)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(words))
        words = words[rng.randint(0, 2):]
        grams, want = license_scan.bigrams(" ".join(words)), {}
        for size, name, theirs in index.rows:
            rest, common = list(grams), 0
            for g in theirs.elements():
                if g in rest:
                    rest.remove(g)
                    common += 1
            dice = 2 * common / (len(grams) + size) if grams else 0
            if dice >= 0.8:
                want[name] = max(dice, want.get(name, 0))
        assert index.match(words) == pytest.approx(want)


def test_base_secrets_against_plain_patterns(spark):
    rng = random.Random(12)
    parts = ["password = ", "API_KEY:", "token\"='", "secret", " ", "\n", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "deadbeefdeadbeef", "é😀", "x", "=", "AbC123xyz+/_.=-", "passwd: ", "apikey='"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    want = {}
    for i, t in enumerate(texts):
        spans = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        want[i] = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0]))))
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.s for r in secret_scan.scan_secrets(rows).select("doc_id", secret_scan.span_string(F.col("base")).alias("s")).collect()}
    assert got == want
