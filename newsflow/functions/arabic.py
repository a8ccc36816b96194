"""Arabic-aware text normalization, tokens, light stemming and de-duplication surfaces, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that are folded, and what to; both digit sets become ASCII.
FOLD_FROM = "أإآٱىئةؤ" + "٠١٢٣٤٥٦٧٨٩" + "۰۱۲۳۴۵۶۷۸۹"
FOLD_TO = "ااااييهو" + "0123456789" + "0123456789"
#: Leading clitics, longest alternatives first.
CLITICS = ("وال", "بال", "كال", "فال", "لل", "ال", "و", "ف", "ب", "ك", "ل")
#: Labels that outlets put before a headline.
OUTLET_LABELS = ("عاجل", "خبر عاجل", "الآن", "حصري", "متابعة", "مباشر", "تحديث", "رويترز", "الجزيرة", "العربية", "بي بي سي", "فرانس",
                 "سي ان ان", "دويتشه فيله", "breaking", "urgent", "update", "exclusive")
#: Function words left out of similarity.
STOPWORDS = ("في", "من", "على", "الى", "عن", "ان", "مع", "هذا", "هذه", "ذلك", "التي", "الذي", "ما", "لا", "لم", "لن", "قد", "كان", "كانت", "يكون",
             "بعد", "قبل", "بين", "عند", "او", "ثم", "حتى", "كل", "بعض", "غير", "بها", "به", "له", "لها", "هو", "هي", "هم", "هن", "نحن", "انا", "انت",
             "كما", "اذا", "الا", "ايضا", "حول", "خلال", "ضد", "دون", "منذ", "لدى", "وفق", "نحو", "الي", "و", "ب", "ل", "ك", "ف",
             "the", "a", "an", "of", "in", "on", "to", "for", "and", "or", "is", "are", "at")

URL = r"https?://\S+|www\.\S+"
MARKS = "[ً-ٰٕـ]"  # vowel signs, hamza marks, superscript alef, tatweel
STEM = "^(?:" + "|".join(CLITICS) + ")(.{3,})$"


def normalize(text: Column) -> Column:
    """Letters, digits and single spaces; null stays null, blank is empty."""
    bare = F.regexp_replace(F.regexp_replace(text, URL, " "), MARKS, "")
    kept = F.regexp_replace(F.translate(bare, FOLD_FROM, FOLD_TO), r"[^\p{IsArabic}a-zA-Z0-9 ]", " ")
    return F.lower(F.trim(F.regexp_replace(kept, " +", " ")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def stem(token: Column) -> Column:
    """One leading clitic less, if three letters stay."""
    return F.regexp_replace(token, STEM, "$1")


def stemmed(text: Column) -> Column:
    """The surface that keywords are matched on."""
    return F.array_join(F.transform(tokens(text), stem), " ")


def without_labels(normalized: Column) -> Column:
    """Up to three outlet labels less at the start."""
    labels = "|".join(re.escape(normalize_text(x)) for x in OUTLET_LABELS)
    return F.regexp_replace(normalized, f"^(?:(?:{labels}) +){{1,3}}", "")


def dedupe_tokens(text: Column) -> Column:
    """Stemmed tokens without labels, stopwords and single letters; order and repeats stay."""
    stems = F.transform(F.split(without_labels(normalize(text)), " "), stem)
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(stems, lambda t: (F.char_length(t) > 1) & ~F.array_contains(stop, t))


def for_dedupe(text: Column) -> Column:
    return F.array_join(dedupe_tokens(text), " ")


# The same rules for configuration values, which are prepared on the driver.

_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def normalize_text(text: str) -> str:
    bare = re.sub(MARKS, "", re.sub(URL, " ", text)).translate(_FOLD)
    return " ".join(re.sub(r"[^؀-؋؍-ؚ؜-؞ؠ-ؿف-يٖ-ٯٱ-ۜ۞-ۿݐ-ݿa-zA-Z0-9 ]", " ", bare).split()).lower()


def stemmed_text(text: str) -> str:
    return " ".join(re.sub(STEM, r"\1", t) for t in normalize_text(text).split())
