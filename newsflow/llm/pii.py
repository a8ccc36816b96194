"""Personal data, plain and disguised: offset-preserving transducers, detection, spans in source characters.

Four kinds are found by pattern in the text as it is (the base spans).  Disguised ones are found in a normalised
text that a chain of transducers makes; each transducer keeps its edits, so a span found behind the chain is mapped back, edit by edit,
to the source characters that made it:

1. look-alikes: letters, digits and signs of other scripts and widths that look like ASCII ones; characters of no width go;
2. spelled digits: runs of four or more number words (English, Spanish, French, German; ``double``, ``triple``), with ``plus`` before them;
3. at and dot: bracketed (``[at]``, ``(dot)``, ``[.]``) and as words, inside what can be an address.  An unbracketed ``at`` counts only with a
   disguised dot after it and a known last label; dots between digits make addresses of the other kind.

A span is added where its source differs from its normalised form and it touches no base span.

Spans are in code points, end exclusive.  Defined cases: a null text is empty; texts are scanned whole, in time linear in their length;
documents of one id, and rows that repeat, are scanned row by row, as are those without an id; an empty table gives no rows; further columns are
ignored, and kept by masking.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.llm.runtime import free_name, ship_package

#: Kinds as listed, and their base patterns.  A digit run is read from its start and an address from its sign, which
#: finds the same leftmost matches and keeps long runs linear.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, rank of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_plain(text: str) -> list[Span]:
    """The base spans, by start and kind."""
    out: list[Span] = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# -- transducers -----------------------------------------------------------------------------------

@dataclass
class Rewritten:
    """A text with the edits that made it from another: (start here, end here, start there, end there), in order."""

    text: str
    edits: list[tuple[int, int, int, int]]

    def __post_init__(self):
        self.starts = [e[0] for e in self.edits]

    def _place(self, at: int) -> tuple[int, int]:
        """First and end of the source characters of one character."""
        k = bisect_right(self.starts, at) - 1
        if k < 0:
            return at, at + 1
        start, end, source, source_end = self.edits[k]
        if at < end:
            return source, source_end
        return source_end + at - end, source_end + at - end + 1

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self._place(start)[0], self._place(end - 1)[1]


def rewrite(text: str, pieces: list[tuple[int, int, str]]) -> Rewritten:
    """``text`` with ``pieces`` (start, end, new text; in order, apart) put in."""
    out, edits, at, length = [], [], 0, 0
    for start, end, new in pieces:
        out.append(text[at:start])
        length += start - at
        edits.append((length, length + len(new), start, end))
        out.append(new)
        length += len(new)
        at = end
    out.append(text[at:])
    return Rewritten("".join(out), edits)


#: Cyrillic and Greek letters drawn as Latin ones, in pairs.
DRAWN_ALIKE = ("аa еe оo рp сc уy хx іi јj ѕs ԁd ԛq ԝw һh АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS "
               "αa οo νv ιi κk ρp ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX")
#: Signs drawn as ASCII ones, in pairs.
SIGNS_ALIKE = "‐- ‑- ‒- –- −- 。. ․. ｡. ⁺+ ⁽( ⁾)"
#: Characters of no width.
NO_WIDTH = "­​‌‍⁠﻿"
_UNUSUAL = re.compile("[­Ͱ-\U0010ffff]")
_NO_WIDTH = re.compile(f"[{NO_WIDTH}]+")


class _Alike(dict):
    """Code point to the ASCII character that it looks like, or to itself; found on first use."""

    def __missing__(self, point: int) -> int:
        found = point
        if point >= 0x370:
            plain = unicodedata.normalize("NFKC", chr(point))
            digit = unicodedata.decimal(chr(point), None)
            if digit is not None:
                found = 48 + digit
            elif len(plain) == 1 and plain.isascii():
                found = ord(plain)
        self[point] = found
        return found


_alike = _Alike({ord(pair[0]): ord(pair[1]) for pair in (DRAWN_ALIKE + " " + SIGNS_ALIKE).split(" ")})


def look_alikes(text: str) -> Rewritten:
    pieces = []
    if _UNUSUAL.search(text):
        text = text.translate(_alike)  # one character for one: no place moves
        pieces = [(m.start(), m.end(), "") for m in _NO_WIDTH.finditer(text)]
    return rewrite(text, pieces)


#: Number words by digit.
NUMBER_WORDS = {
    "0": "zero oh cero zéro null", "1": "one uno un eins", "2": "two dos deux zwei", "3": "three tres trois drei", "4": "four cuatro quatre vier",
    "5": "five cinco cinq fünf", "6": "six seis sechs", "7": "seven siete sept sieben", "8": "eight ocho huit acht", "9": "nine nueve neuf neun"}
_DIGIT = {word: digit for digit, words in NUMBER_WORDS.items() for word in words.split(" ")}
_TIMES = {"double": 2, "triple": 3}
_PLUS = ("plus", "más")
_SPELLED = frozenset([*_DIGIT, *_TIMES, *_PLUS])
LEAST_RUN = 4
_NUMBER = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, [*_DIGIT, *_TIMES, *_PLUS]), key=len, reverse=True)) + r")(?!\w)|(?<!\w)[0-9]+(?!\w)")
_TOKEN = re.compile(r"\w+")
_WORDS = frozenset(_DIGIT)

_DOT_NAMES = "dot|punto|point|punkt"
_AT_NAMES = "at|arroba"
#: Gaps are bounded, so that long blanks are read once.
_BRACKETED_DOT = rf"[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}(?:{_DOT_NAMES}|\.)[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}"
_NAMED_DOT = rf"[ \t]{{1,3}}(?:{_DOT_NAMES})[ \t]{{1,3}}"
#: How other words stand in a row: multipliers and plus count, names of dots are skipped.
_LINKS = {**dict.fromkeys([*_TIMES, *_PLUS], "x"), **dict.fromkeys(_DOT_NAMES.split("|"), "")}
_RUN = re.compile(f"[wdx]{{{LEAST_RUN},}}")
_GAP = re.compile(rf"(?:[ \t,]|[ \t,]?-[ \t]?|[ \t,][ \t]|{_NAMED_DOT}|{_BRACKETED_DOT})")


def lowered(text: str) -> str:
    """``text`` in lower case, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(d := c.lower()) != 1 else d for c in text)


def _has_run(low: str) -> bool:
    """Whether number words and digits stand in a row anywhere, at most a dot's name apart; one look at each word."""
    words = _TOKEN.findall(low)
    if _WORDS.isdisjoint(words):
        return False
    marks = "".join(["w" if w in _WORDS else "d" if w[0] in "0123456789" else _LINKS.get(w, " ") for w in words])
    return _RUN.search(marks) is not None


def spelled_digits(text: str) -> Rewritten:
    pieces: list[tuple[int, int, str]] = []
    low = lowered(text)
    if _has_run(low):
        run: list[re.Match] = []
        for m in _NUMBER.finditer(low):
            if run and not _GAP.fullmatch(low, run[-1].end(), m.start()):
                pieces += _spelled(low, run)
                run = []
            run.append(m)
        pieces += _spelled(low, run)
    return rewrite(text, pieces)


def _spelled(text: str, run: list[re.Match]) -> list[tuple[int, int, str]]:
    """The edits of one run of number words and digits."""
    words = [m[0] for m in run]
    if sum(w in _DIGIT or w[0].isdigit() for w in words) < LEAST_RUN or not any(w in _DIGIT for w in words):
        return []
    out, times = [], 1
    for k, (m, word) in enumerate(zip(run, words, strict=True)):
        # what stands between a spelled number and the next goes
        if k and (words[k - 1] in _SPELLED and (word in _DIGIT or word in _TIMES) or words[k - 1] in _TIMES):
            gap = text[run[k - 1].end():m.start()]
            if not re.search("[a-z.]", gap):
                out.append((run[k - 1].end(), m.start(), ""))
        if word in _TIMES:
            times = _TIMES[word]
            out.append((m.start(), m.end(), ""))
            continue
        if word in _PLUS:
            out.append((m.start(), m.end(), "+"))
        elif word in _DIGIT:
            out.append((m.start(), m.end(), _DIGIT[word] * times))
        times = 1
    return out


#: Last labels that an address with an unbracketed ``at`` may have.
LAST_LABELS = frozenset("com org net edu gov mil int info biz io co dev app ai me tv eu us uk ca au nz de at ch fr be es pt it nl pl se no fi dk ie cz gr ru ua tr in cn jp kr br mx ar".split(" "))
_AT = re.compile(rf"@|(?<=[a-z0-9_%+-])(?:[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}(?:{_AT_NAMES}|@)[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}|[ \t]{{1,3}}(?:{_AT_NAMES}|@)[ \t]{{1,3}})(?=[a-z0-9])")
_NEXT_LABEL = re.compile(rf"(\.|{_BRACKETED_DOT}|{_NAMED_DOT})([a-z0-9-]{{1,63}})")
_LABEL = re.compile(r"[a-z0-9-]{1,63}")
_BEFORE = re.compile(rf"({_BRACKETED_DOT}|{_NAMED_DOT})[a-z0-9_%+.-]+\Z")
_BRACKETED = re.compile(rf"[\[({{<][ \t]{{0,3}}(?:{_AT_NAMES}|@|{_DOT_NAMES}|\.)")
_DOT_IN_NUMBER = re.compile(rf"(?<=[0-9])(?:{_BRACKETED_DOT}|{_NAMED_DOT})(?=[0-9])")
#: So many characters before an at are looked at for a disguised dot.
NAME_REACH = 100


def at_and_dot(text: str) -> Rewritten:
    low = lowered(text)
    # every edit needs a disguised dot or a bracketed at
    if not _BRACKETED.search(low) and not any(name in low for name in _DOT_NAMES.split("|")):
        return rewrite(text, [])
    pieces = {(m.start(), m.end(), ".") for m in _DOT_IN_NUMBER.finditer(low)}
    free = 0
    for m in _AT.finditer(low):
        sign = m[0].strip(" \t")
        bracketed = sign[0] in "[({<"
        first = _LABEL.match(low, m.end())
        if not first:
            continue
        dots, at, last = [], first.end(), first[0]
        good = None
        while (more := _NEXT_LABEL.match(low, at)) is not None:
            dots.append((more.start(1), more.end(1)))
            at, last = more.end(), more[2]
            if last in LAST_LABELS or more[1] == ".":
                good = (len(dots), at, last)
        if good is None:
            continue
        dots, at, last = dots[:good[0]], *good[1:]
        disguised = [(a, b) for a, b in dots if b - a > 1]
        if m[0] != "@" and not bracketed and (not disguised or last not in LAST_LABELS):
            continue
        if disguised and last not in LAST_LABELS:
            continue
        if m[0] != "@":
            pieces.add((m.start(), m.end(), "@"))
        pieces |= {(a, b, ".") for a, b in disguised}
        head, end = max(free, m.start() - NAME_REACH), m.start()
        while (d := _BEFORE.search(low[head:end])) is not None:
            pieces.add((head + d.start(1), head + d.end(1), "."))
            end = head + d.start(1)
        free = at
    ordered: list[tuple[int, int, str]] = []
    for p in sorted(pieces):
        if not ordered or p[0] >= ordered[-1][1]:
            ordered.append(p)
    return rewrite(text, ordered)


TRANSDUCERS = (look_alikes, spelled_digits, at_and_dot)


def find_disguised(text: str, base: list[Span]) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, normalised value) of what only the normalised text shows, apart from ``base``."""
    chain, now = [], text
    for step in TRANSDUCERS:
        chain.append(step(now))
        now = chain[-1].text
    if now == text:
        return []
    out = []
    taken = sorted((a, b) for a, _, b in base)
    starts = [a for a, _ in taken]
    reach = []  # the furthest end so far
    for _, b in taken:
        reach.append(max(b, reach[-1]) if reach else b)
    for start, rank, end in find_plain(now):
        value = now[start:end]
        for step in reversed(chain):
            start, end = step.source(start, end)
        k = bisect_right(starts, end - 1) - 1
        if value != text[start:end] and not (k >= 0 and reach[k] > start):
            out.append((start, rank, end, value))
    return out


# -- tables ----------------------------------------------------------------------------------------

_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        base, added = [], []
        for text in b.column(1).to_pylist():
            plain = find_plain(text) if text else []
            base.append([{"start": a, "rank": k, "end": e, "kind": KINDS[k], "value": text[a:e]} for a, k, e in plain])
            added.append([{"start": a, "rank": k, "end": e, "kind": KINDS[k], "value": v} for a, k, e, v in find_disguised(text, plain)] if text else [])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(added, pa.list_(_SPAN))], names=["doc_id", "base", "added"])


def scan_pii(documents: DataFrame) -> DataFrame:
    """(doc_id, base, added): one row per document; spans with their kind and normalised value."""
    ship_package(documents.sparkSession)
    id_type = documents.schema["doc_id"].dataType
    span = T._parse_datatype_string(SPANS)
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("base", span), T.StructField("added", span)])
    return documents.select("doc_id", "text").mapInArrow(_scan, schema)


def _masked(text: str) -> str:
    plain = find_plain(text)
    spans = sorted([*plain, *((a, k, e) for a, k, e, _ in find_disguised(text, plain))])
    out, at = [], 0
    for start, rank, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[rank].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_pii(documents: DataFrame) -> DataFrame:
    """``documents`` with every span replaced by its kind, overlapping ones by the first's; a column ``n_chars`` follows a changed text.  Null texts stay null."""
    ship_package(documents.sparkSession)
    changed, schema = free_name(documents, "_changed"), documents.schema
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(place).to_pylist()
            new = [t and _masked(t) for t in old]
            columns = [pa.array(new, pa.string()) if k == place else b.column(k) for k in range(b.num_columns)]
            differs = pa.array([x != y for x, y in zip(old, new, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*columns, differs], names=[*b.schema.names, changed])

    out = documents.mapInArrow(run, T.StructType([*schema.fields, T.StructField(changed, T.BooleanType())]))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(changed), F.char_length("text")).otherwise(F.col("n_chars")).cast(schema["n_chars"].dataType))
    return out.drop(changed)


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
