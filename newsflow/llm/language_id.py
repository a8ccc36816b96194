"""Language ID: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's features are its byte n-grams of 2, 3 and 4 bytes (lower-cased UTF-8), hashed to ``BUCKETS``
rows of an embedding table; the average embedding goes through a linear softmax.  Both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows.  Steps are normalised (by the squares of what
they multiply), so they stay bounded whatever the texts' length; texts with shuffled letters are
trained towards no language, so that n-grams of any text tell nothing.

A fifth of the sample is held back for calibration.  The temperature falls with the text's length (one word tells less than a page;
snippets of the held-back texts stand for short ones).  It minimises the log loss of held-back texts, against their labels,
and of negatives, against the uniform distribution.  Negatives are held-back texts with shuffled letters, and texts of a
language under a model trained without it.  The threshold lies between the confidence of negatives and that of held-back texts, and rejects at most
``REJECT_SHARE`` of the latter.  For prediction, table and softmax are multiplied out to one score row per
bucket, so a text of any length costs one look-up per byte and order.

The sample: at most ``per_language`` rows of each label, chosen by a hash of ``doc_id`` (the documented bound).
Prediction reads every whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; without labelled
rows (as in an empty table) every text is; repeated rows are predicted row by row; very long texts go through in pieces of their batch; further
columns are kept, but one named as the new column is replaced; training that gives no finite numbers is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.runtime import drop_kept, release_memory, ship_package

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
DIM = 16
EPOCHS = 3
RATE = 1.0
PER_LANGUAGE = 800
#: Rows of a language for the models that leave one language out.
PER_LANGUAGE_OUT = 100
REJECT_SHARE = 0.001
UNKNOWN = "und"
#: Letters, number signs such as ½ and ², and some marks.
_LETTER_LIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text has a letter (Unicode category L)."""
    return any(m[0].isalpha() for m in _LETTER_LIKE.finditer(text))


def feature_rows(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of every n-gram of ``order`` bytes, by its first byte's place; data ends in padding."""
    h = np.full(len(data) - order + 1, order, np.uint32)
    for k in range(order):
        h *= np.uint32(0x01000193)
        h ^= data[k:len(data) - order + 1 + k]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.intp)


def _bytes(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace") + b"   "


def document_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    data = np.frombuffer(_bytes(text), np.uint8).astype(np.uint32)
    rows, counts = np.unique(np.concatenate([feature_rows(data, n)[: len(data) - 3] for n in ORDERS]), return_counts=True)
    return rows, (counts / counts.sum()).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages
    temperature: tuple[float, float]  # a floor, and what is divided by the root of the number of bytes
    threshold: float


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, np.float64)
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def shuffled(text: str, rng: np.random.Generator) -> str:
    """The text's characters in random order: its letters and lengths, but no language."""
    return "".join(rng.permutation(list(text))) if text else text


def _fit(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], k: int, junk: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator, epochs: int) -> np.ndarray:
    """Score rows (BUCKETS x k) by SGD on (features, label) rows; ``junk`` features are trained towards the uniform distribution."""
    table = rng.normal(0, 1e-3, (BUCKETS, DIM)).astype(np.float32)
    weights = rng.normal(0, 1 / np.sqrt(DIM), (DIM, k))
    examples = [(f, y) for f, y in rows] + [(f, -1) for f in junk]
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for at in rng.permutation(len(examples)):
            (ids, share), y = examples[at]
            own = table[ids]
            hidden = share @ own
            slope = _softmax(hidden @ weights)
            if y < 0:
                slope -= 1 / k
            else:
                slope[y] -= 1
            back = weights @ slope
            step = RATE * (1 - done / steps) / (1 + hidden @ hidden + (weights * weights).sum())
            weights -= step * np.outer(hidden, slope)
            # shares are tiny on long texts: divided by their squares' sum, the average moves by one step along its gradient
            table[ids] = own - np.outer(share, (step / (share @ share) * back).astype(np.float32))
            done += 1
    scores = (table @ weights).astype(np.float32)
    if not np.isfinite(scores).all():
        raise ArithmeticError("training gave no finite numbers")
    return scores


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model of (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), (1.0, 0.0), 0.0)
    rng = np.random.default_rng(seed)
    known = {lang: k for k, lang in enumerate(languages)}
    rows = [rows[k] for k in rng.permutation(len(rows))]
    held = rows[: len(rows) // 5] if len(rows) >= 50 else []
    fit = [(document_counts(text), known[lang]) for text, lang in rows[len(held):]]
    junk = [document_counts(shuffled(text, rng)) for text, _ in rows[len(held)::4]]
    scores = _fit(fit, len(languages), junk, rng, EPOCHS)
    held = [(text, known[lang]) for text, lang in held]
    temperature, threshold = _calibrate(scores, held, _negatives(scores, fit, held, rng), rng) if held else ((1.0, 0.0), 0.0)
    return Model(languages, scores, temperature, threshold)


def _logits(scores: np.ndarray, texts: list[str]) -> np.ndarray:
    return np.array([share.astype(np.float64) @ scores[ids] for ids, share in map(document_counts, texts)]).reshape(len(texts), scores.shape[1])


def _sizes(texts: list[str]) -> np.ndarray:
    return np.array([len(_bytes(t)) - 4 for t in texts])


def _negatives(scores: np.ndarray, fit: list, held: list[tuple[str, int]], rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """(logits, sizes) of texts in no known language: shuffled ones, and each language's under a model without it."""
    mixed = [shuffled(t, rng) for t, _ in held]
    out = [(_logits(scores, mixed), _sizes(mixed))]
    k = scores.shape[1]
    for left in range(k) if k > 2 else ():
        count: dict[int, int] = {}
        some = []
        for f, y in fit:
            count[y] = count.get(y, 0) + 1
            if y != left and count[y] <= PER_LANGUAGE_OUT:
                some.append((f, y - (y > left)))
        texts = [t for t, y in held if y == left]
        if texts and some:
            # one language fewer: its column counts as the least likely one
            z = _logits(_fit(some, k - 1, [], rng, 2), texts)
            out.append((np.concatenate([z, z.min(axis=1, keepdims=True)], axis=1), _sizes(texts)))
    return out


def _tempered(z: np.ndarray, sizes: np.ndarray, temperature: tuple[float, float]) -> np.ndarray:
    return _softmax(z / (temperature[0] + temperature[1] / np.sqrt(np.maximum(sizes, 1)))[:, None])


def _calibrate(scores: np.ndarray, held: list[tuple[str, int]], negatives: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator) -> tuple[tuple[float, float], float]:
    """The temperature with the least log loss, and the threshold."""
    texts = list(held)
    for text, label in held:
        words = text.split()
        for n in (1, 2, 4, 8):
            at = int(rng.integers(0, max(1, len(words) - n + 1)))
            texts.append((" ".join(words[at:at + n]), label))
    whole = [has_letter(t) for t, _ in texts]
    n_held = sum(whole[: len(held)])
    texts = [x for x, ok in zip(texts, whole, strict=True) if ok]
    z, sizes, y = _logits(scores, [t for t, _ in texts]), _sizes([t for t, _ in texts]), np.array([label for _, label in texts])
    none, none_sizes = (np.concatenate(x) for x in zip(*negatives, strict=True))
    at = np.arange(len(y))

    def loss(t: tuple[float, float]) -> float:
        unknown = -np.log(_tempered(none, none_sizes, t) + 1e-12).mean()
        return -np.log(_tempered(z, sizes, t)[at, y] + 1e-12).mean() + unknown

    best = min(((a, b) for a in np.geomspace(0.02, 50, 18) for b in (0, *np.geomspace(0.1, 1000, 18))), key=loss)
    sure = np.sort(_tempered(z[:n_held], sizes[:n_held], best).max(axis=1))
    most = sure[int(REJECT_SHARE * len(sure))]
    unsure = np.quantile(_tempered(none, none_sizes, best).max(axis=1), 0.99)
    return (float(best[0]), float(best[1])), float(min(most, (most + unsure) / 2))


def training_rows(documents: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """The ``per_language`` labelled rows of each language outside the held-out fold that come first by a hash of their id, in two jobs whatever the number of partitions."""
    eligible = documents.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in eligible.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    spread = (F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30))
    wanted = None
    for lang, n in counts.items():
        # a little more than needed is shuffled, and cut to the bound there
        one = (F.col("lang") == lang) & (spread < min(1.0, (1.2 * per_language + 50) / n))
        wanted = one if wanted is None else wanted | one
    if wanted is None:
        return []
    first = Window.partitionBy("lang").orderBy("spread", "doc_id", "text")
    some = eligible.where(wanted).select("doc_id", "lang", "text", spread.alias("spread")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language)
    return [(text, lang) for _, text, lang in sorted((r["doc_id"], r["text"], r["lang"]) for r in some.select("doc_id", "text", "lang").collect())]


def held_out():
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)


def score_texts(model: Model, texts: list[str | None], piece: int = 1 << 18) -> tuple[list[str], np.ndarray]:
    """(languages, calibrated confidence); texts go through in pieces of about ``piece`` bytes."""
    k = len(model.languages)
    sums = np.zeros((len(texts), k))
    counts = np.ones(len(texts))
    known = [bool(k and t and has_letter(t)) for t in texts]
    i = 0
    while i < len(texts):
        group, size = [], 0
        while i < len(texts) and size < piece:
            if known[i]:
                b = _bytes(texts[i])
                group.append((i, b))
                size += len(b)
            i += 1
        if not group:
            continue
        data = np.frombuffer(b"".join(b for _, b in group), np.uint8).astype(np.uint32)
        ends = np.cumsum([len(b) for _, b in group])
        starts = ends - [len(b) for _, b in group]
        total = np.zeros(len(data))
        per = np.zeros((len(group), k))
        for order in ORDERS:
            rows = feature_rows(data, order)
            for lang in range(k):
                total[: len(rows)] = model.scores[:, lang][rows]
                total[len(rows):] = 0
                # the last three places of a text have no whole n-gram of each order
                sums_to = np.concatenate([[0.0], np.cumsum(total)])
                per[:, lang] += sums_to[ends - 3] - sums_to[starts]
        for g, (j, b) in enumerate(group):
            sums[j] = per[g]
            counts[j] = len(ORDERS) * (len(b) - 3)
    if not k:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    p = _tempered(sums / counts[:, None], counts / len(ORDERS) - 1, model.temperature)
    best = p.argmax(axis=1)
    score = np.where(known, p.max(axis=1), 0.0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], score


def predictor(spark, model: Model):
    """A column function text -> struct(lang_pred, score, rejected)."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predict(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_kept()
        model = sent.value
        for batch in text:
            langs, score = [], []
            for at in range(0, len(batch), 512):
                some, sure = score_texts(model, batch.slice(at, 512).to_pylist())
                langs += some
                score += sure.tolist()
            rejected = [lang == UNKNOWN or not s >= model.threshold for lang, s in zip(langs, score, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], fields=list(kind))
        release_memory()

    return predict


def identify(documents: DataFrame, per_language: int = PER_LANGUAGE, into: str = "language") -> DataFrame:
    """``documents`` with the column ``into`` = struct(lang_pred, score, rejected)."""
    model = train(training_rows(documents, per_language))
    return documents.withColumn(into, predictor(documents.sparkSession, model)("text"))
