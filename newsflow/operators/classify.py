"""Rule-based additive scoring with explanations, and the acceptance gate.  All of it is one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.arabic import stemmed
from newsflow.functions.text import trim_all
from newsflow.sources.vocabulary import Vocabulary, Weights

MINUTE = 60_000
FRESH_30M, FRESH_2H, FRESH_6H = 30 * MINUTE, 120 * MINUTE, 360 * MINUTE


def text_surface(title: Column, summary: Column, categories: Column) -> Column:
    """Title, summary and categories, stemmed, between spaces."""
    names = F.array_join(categories, " ")
    return F.concat(F.lit(" "), stemmed(F.concat_ws(" ", title, summary, F.when(trim_all(names) != "", names))), F.lit(" "))


def path_surface(url: Column, categories: Column) -> Column:
    return F.concat(F.lower(url), F.lit(" "), F.lower(F.array_join(categories, " ")))


def _list(phrases: Sequence[str]) -> Column:
    return F.array(*[F.lit(p) for p in phrases]) if phrases else F.expr("cast(array() as array<string>)")


def _padded(phrase: Column) -> Column:
    return F.concat(F.lit(" "), phrase, F.lit(" "))


def _found(surface: Column, phrases: Sequence[str], whole: bool = True) -> Column:
    """The phrases that a surface has, in order."""
    return F.filter(_list(phrases), lambda p: F.contains(surface, _padded(p) if whole else p))


#: From so many words of one token each a list is looked up token by token.
MANY_WORDS = 8


class _Phrases:
    """Phrases matched on a surface and its tokens: single words by one hash look-up a token, longer ones by ``contains`` where their first word occurs."""

    def __init__(self, phrases: Sequence[str]):
        self.phrases = list(phrases)
        self.words = [p for p in self.phrases if " " not in p]
        self.longer = [p for p in self.phrases if " " in p]

    def _longer(self, surface: Column, tokens: Column) -> Column:
        if not self.longer:
            return _list(())
        firsts = sorted({p.split(" ")[0] for p in self.longer})
        return F.when(F.exists(tokens, lambda t: t.isin(*firsts)), _found(surface, self.longer)).otherwise(_list(()))

    def found(self, surface: Column, tokens: Column) -> Column:
        """The phrases that a surface has, each once, in no order."""
        if len(self.words) < MANY_WORDS:
            return _found(surface, self.phrases)
        words = F.array_distinct(F.filter(tokens, lambda t: t.isin(*self.words)))
        return F.concat(words, self._longer(surface, tokens)) if self.longer else words

    def first(self, surface: Column, tokens: Column) -> Column:
        """The first of the list that a surface has, or null."""
        if len(self.words) < MANY_WORDS:
            return F.try_element_at(_found(surface, self.phrases), F.lit(1))
        places = F.transform(self.found(surface, tokens), lambda p: F.array_position(_list(self.phrases), p))
        return F.try_element_at(_list(self.phrases), F.array_min(places).cast("int"))


def without_idioms(surface: Column, idioms: Sequence[str]) -> Column:
    return F.aggregate(_list(idioms), surface, lambda text, idiom: F.replace(text, _padded(idiom), F.lit(" ")))


def evidence(articles: DataFrame, vocabulary: Vocabulary, now_ms: int) -> DataFrame:
    """What scoring looks at, as columns; independent of weights, so a sweep computes it once.

    ``articles`` has title, summary, url, published_at and categories.
    """
    v = vocabulary.prepared()
    surface, paths = F.col("_text"), F.col("_paths")
    shown = articles.withColumns({
        "_text": text_surface(F.col("title"), F.col("summary"), F.col("categories")),
        "_paths": path_surface(F.col("url"), F.col("categories")),
        "_opening": _padded(stemmed(F.col("title")))})
    shown = shown.withColumns({"_urgent": without_idioms(surface, v.breaking_exclusions), "_words": F.split(F.trim(surface), " ")})
    words = F.col("_words")
    count = lambda phrases: F.size(_Phrases(phrases).found(surface, words))
    age = F.greatest(F.lit(now_ms) - F.col("published_at"), F.lit(0))
    signs = {
        "marked": F.size(_found(F.col("_urgent"), v.breaking)) > 0,
        "band": F.when(age <= FRESH_30M, 1).when(age <= FRESH_2H, 2).when(age <= FRESH_6H, 3).otherwise(0),
        "path_marked": (F.size(_found(paths, v.breaking_paths, False)) > 0) | (F.size(_found(F.col("_urgent"), v.breaking_paths)) > 0),
        "event_verb": _Phrases(v.event_verbs).first(surface, words),
        "politics": count(v.politics), "economy": count(v.economy),
        "topic_path": F.size(_found(paths, v.topic_paths, False)) > 0,
        "negative": count(v.negative), "negative_paths": F.size(_found(paths, v.negative_paths, False)),
        "question": trim_all(F.col("title")).rlike("[؟?]$"),
        "opening": F.try_element_at(F.filter(_list(v.analysis_prefixes), lambda p: F.startswith(F.col("_opening"), _padded(p))), F.lit(1))}
    # one row in, one out: what is filtered later on scores can't be pushed below, so the evidence is found once a row
    once = F.explode(F.array(F.struct(*[c.alias(k) for k, c in signs.items()])))
    return shown.select("*", once.alias("signs")).drop("_text", "_paths", "_opening", "_urgent", "_words")


def weights_column(weights: Weights) -> Column:
    return F.struct(*[F.lit(getattr(weights, f.name)).alias(f.name) for f in fields(Weights)])


def score(shown: DataFrame, weights: Column) -> DataFrame:
    """``shown`` with ``classification``: breaking_score, topic_score, signals, has_event_signal, accepted."""
    s, w = F.col("signs"), weights
    band = F.when(s["band"] == 1, w["fresh_30m"]).when(s["band"] == 2, w["fresh_2h"]).when(s["band"] == 3, w["fresh_6h"]).otherwise(0)
    hits = s["politics"] + s["economy"]
    keyword = F.when(hits > 0, F.least(w["topic_first"] + (hits - 1) * w["topic_more"], w["topic_most"])).otherwise(0)
    off_words, off_paths = s["negative"] * w["negative_keyword"], s["negative_paths"] * w["negative_path"]
    times = F.when(s["negative"] > 0, 1).otherwise(0) + F.when(s["negative_paths"] > 0, 1).otherwise(0)
    if_ = lambda test, value: F.when(test, value).otherwise(0)
    breaking = if_(s["marked"], w["breaking_keyword"]) + band + if_(s["path_marked"], w["breaking_path"]) + times * w["negative_breaking"]
    topic = (keyword + if_(s["topic_path"], w["topic_path"]) + off_words + off_paths + if_(s["question"], w["question"])
             + if_(s["opening"].isNotNull(), w["analysis"]))
    explicit = s["marked"] | s["path_marked"]
    event = explicit | s["event_verb"].isNotNull()
    put = lambda text, value: F.concat(F.lit(text), value.cast("string"))
    # fixed values: the wording of signals
    signals = F.filter(F.array(
        F.when(s["marked"], put("breaking-keyword +", w["breaking_keyword"])),
        F.when(s["band"] > 0, F.concat(F.element_at(F.array(F.lit("fresh-30m +"), F.lit("fresh-2h +"), F.lit("fresh-6h +")), F.greatest(s["band"], F.lit(1))), band.cast("string"))),
        F.when(s["path_marked"], put("breaking-path +", w["breaking_path"])),
        F.when(explicit, F.lit("event-signal(explicit breaking marker)"))
        .when(s["event_verb"].isNotNull(), F.concat(F.lit("event-signal(verb '"), s["event_verb"], F.lit("')")))
        .otherwise(F.lit("NO event signal — nothing happened, this is description not news")),
        F.when(hits > 0, F.concat(F.lit("topic-keywords(politics="), s["politics"].cast("string"), F.lit(",economy="), s["economy"].cast("string"), put(") +", keyword))),
        F.when(s["topic_path"], put("topic-path +", w["topic_path"])),
        F.when(s["negative"] > 0, F.concat(F.lit("negative-keywords("), s["negative"].cast("string"), put(") ", off_words))),
        F.when(s["negative_paths"] > 0, F.concat(F.lit("negative-path("), s["negative_paths"].cast("string"), put(") ", off_paths))),
        F.when(s["question"], put("question-headline ", w["question"])),
        F.when(s["opening"].isNotNull(), F.concat(F.lit("analysis-prefix('"), s["opening"], put("') ", w["analysis"])))), lambda x: x.isNotNull())
    accepted = (breaking >= w["min_breaking"]) & (topic >= w["min_topic"]) & (event | ~w["need_event"])
    return shown.withColumn("classification", F.struct(
        breaking.cast("int").alias("breaking_score"), topic.cast("int").alias("topic_score"), signals.alias("signals"), event.alias("has_event_signal"),
        accepted.alias("accepted"), (breaking >= w["min_breaking"]).alias("breaking_pass"), (topic >= w["min_topic"]).alias("topic_pass")))


def classify(articles: DataFrame, now_ms: int, vocabulary: Vocabulary | None = None, weights: Weights | None = None) -> DataFrame:
    return score(evidence(articles, vocabulary or Vocabulary(), now_ms), weights_column(weights or Weights())).drop("signs")


def accepted(classified: DataFrame) -> DataFrame:
    """Rows that pass, before anything is stored or shuffled."""
    return classified.where("classification.accepted")


def sweep(articles: DataFrame, now_ms: int, candidates: Sequence[Weights], vocabulary: Vocabulary | None = None) -> DataFrame:
    """(label, n, breaking_pass, topic_pass, accepted) for each set of weights; evidence is computed once a row."""
    shown = evidence(articles, vocabulary or Vocabulary(), now_ms)
    each = F.explode(F.array(*[F.struct(F.lit(w.label).alias("label"), weights_column(w).alias("w")) for w in candidates]))
    scored = score(shown.select("signs").withColumn("c", each), F.col("c.w"))
    return scored.groupBy(F.col("c.label").alias("label")).agg(
        F.count("*").alias("n"), F.count_if("classification.breaking_pass").alias("breaking_pass"),
        F.count_if("classification.topic_pass").alias("topic_pass"), F.count_if("classification.accepted").alias("accepted"))


def weights_frame(spark: SparkSession, candidates: Sequence[Weights]) -> DataFrame:
    return spark.createDataFrame([(w.label, *(getattr(w, f.name) for f in fields(Weights))) for w in candidates], ["label", *(f.name for f in fields(Weights))])
