"""HTML, URL and string functions as columns, all of them Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.similarity import bound

TITLE_CHARS, SUMMARY_CHARS, URL_CHARS = 300, 200, 2048

#: Named entities and their characters.
NAMED_ENTITIES = {
    "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ", "shy": "", "ndash": "–", "mdash": "—", "hellip": "…", "middot": "·", "bull": "•",
    "lsquo": "‘", "rsquo": "’", "sbquo": "‚", "ldquo": "“", "rdquo": "”", "bdquo": "„", "laquo": "«", "raquo": "»", "lsaquo": "‹", "rsaquo": "›",
    "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "copy": "©", "reg": "®", "trade": "™",
    "sect": "§", "para": "¶", "dagger": "†", "Dagger": "‡", "permil": "‰", "prime": "′", "Prime": "″", "eacute": "é", "egrave": "è", "ecirc": "ê",
    "agrave": "à", "acirc": "â", "ccedil": "ç", "ocirc": "ô", "ouml": "ö", "uuml": "ü", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "iacute": "í",
    "oacute": "ó", "uacute": "ú", "aacute": "á", "rlm": "‏", "lrm": "‎", "zwnj": "‌", "zwj": "‍",
}
BUILT_IN = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "at_medium", "at_campaign", "at_custom1", "at_custom2",
            "at_custom3", "at_custom4", "traffic_source", "maca", "ref", "referrer", "source", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ncid",
            "smid", "cmpid", "ito", "oc", "xtor", "ceid", "_ga")

#: References, tags, image sources and the parts of an address.
ENTITY = r"&([^#;&<>\s][^;&<>\s]{1,63});"
NUMERIC = r"&#(x?)([0-9a-fA-F]+);"
TAG = r"<[^>]{0,4000}>"
IMAGE_SOURCE = r"""(?i)<img[^>]{0,600}?\ssrc\s*=\s*["']([^"']+)["']"""
URL_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/:?#]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Unicode white space, as trim() of the JVM languages sees it
SPACE = r"[\s\u0085   -     　\u001C-\u001F]+"


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def _rewritten(text: Column, reference: str, value) -> Column:
    """``text`` with each match of ``reference`` replaced by ``value`` of a piece that starts with it: cut before the matches, one look at each piece."""
    whole = f"(?s)^{reference}(.*)$"
    groups = reference.count("(") + 1
    piece = lambda p: F.when(p.rlike(f"^{reference}"), F.concat(value(p), F.regexp_extract(p, whole, groups))).otherwise(p)
    return F.array_join(F.transform(F.split(text, f"(?={reference})", -1), piece), "")


def character(code: Column) -> Column:
    """The character of a code point; empty for what is none."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")


def _numeric(piece: Column) -> Column:
    part = lambda k: F.regexp_extract(piece, f"^{NUMERIC}", k)
    digits = F.regexp_replace(part(2), "^0+", "")
    code = F.when((part(1) == "x") & (F.char_length(digits) <= 6), F.conv(digits, 16, 10).cast("long")).when((part(1) == "") & digits.rlike("^[0-9]{1,7}$"), F.conv(digits, 10, 10).cast("long"))
    return character(F.coalesce(code, F.lit(0).cast("long")))


def _named(piece: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in (NAMED_ENTITIES | BUILT_IN).items() for x in pair])
    name = F.regexp_extract(piece, f"^{ENTITY}", 1)
    # the five of XML are known as they are written only
    loose = F.when(F.lower(name).isin(*BUILT_IN), F.lit(None).cast("string")).otherwise(F.try_element_at(known, F.lower(name)))
    return F.coalesce(F.try_element_at(known, name), loose, F.lit(""))


def decode_entities(text: Column) -> Column:
    """Numeric references, then named ones; unknown ones go."""
    return bound(text, lambda t: F.when(F.contains(t, F.lit("&")), _rewritten(_rewritten(t, NUMERIC, _numeric), ENTITY, _named)).otherwise(t))


def plain_text(html: Column) -> Column:
    """Markup out, entities decoded twice, white space collapsed; empty is null."""
    bare = decode_entities(decode_entities(F.regexp_replace(html, TAG, " ")))
    return bound(trim_all(F.regexp_replace(bare, r"\s+", " ")), lambda out: F.when(out != "", out))


def first_image(html: Column) -> Column:
    """The first image address of a fragment, if it begins with http."""
    raw = F.regexp_extract(html, IMAGE_SOURCE, 1)
    return bound(trim_all(decode_entities(raw)), lambda url: F.when(F.lower(url).startswith("http"), url))


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a word, and an ellipsis."""
    return bound(text, lambda t: _cut(t, most))


def _cut(text: Column, most: int) -> Column:
    cut = F.left(text, F.lit(most))
    back = F.instr(F.reverse(cut), " ")
    last_space = F.lit(most) - back  # counted from 0; most if there is none
    body = F.when((back > 0) & (last_space > most // 2), F.left(cut, last_space)).otherwise(cut)
    trimmed = F.regexp_replace(F.regexp_replace(body, f"{SPACE}$", ""), "[،,.؛;]+$", "")
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(trimmed, F.lit("…")))


def canonical_url(url: Column) -> Column:
    """One form per article: https, no ``www.``, no tracking, parameters by name, no fragment or last slash."""
    bare = trim_all(url)
    part = lambda k: F.regexp_extract(bare, URL_PARTS, k)
    host = F.lower(F.regexp_replace(part(2), r"^www\.", ""))
    port = F.when(part(3) != "", F.concat(F.lit(":"), part(3))).otherwise("")
    pairs = F.transform(F.split(part(5), "&"), lambda p, i: F.struct(
        F.substring_index(p, "=", 1).alias("name"), i.alias("at"),
        F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, 2**31 - 1)).otherwise("").alias("value")))
    tracked = F.array(*[F.lit(t) for t in TRACKING])
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.array_contains(tracked, F.lower(p["name"]))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    query = F.when((part(5) != "") & (F.size(kept) > 0), F.concat(F.lit("?"), query)).otherwise("")
    out = F.concat(F.lit("https://"), host, port, part(4), query)
    out = F.when(out.endswith("/") & ~out.endswith("://"), F.left(out, F.char_length(out) - 1)).otherwise(out)
    return F.when(bare.rlike(URL_PARTS), out).otherwise(F.lower(bare))


def stable_hash(text: Column) -> Column:
    """FNV-1a of 64 bits over UTF-8 bytes as signed hexadecimal.

    The product is taken on two 32-bit halves, so nothing overflows under ANSI rules: the prime is
    2^40 + 435, so low' = low * 435 and high' = high * 435 + low * 2^8 + carry, each modulo 2^32.
    """
    mask = F.lit(0xFFFFFFFF)
    # the bytes read as Latin-1 are one character each
    letters = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    octets = F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(acc, b):
        lo = acc["lo"].bitwiseXOR(b)
        low = lo * 435
        return F.struct((acc["hi"] * 435 + lo * 256 + F.shiftright(low, 32)).bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    def done(acc):
        negative = acc["hi"] >= 0x80000000
        low = F.when(negative, (F.lit(0x100000000) - acc["lo"]).bitwiseAND(mask)).otherwise(acc["lo"])
        high = F.when(negative, (F.lit(0xFFFFFFFF) - acc["hi"] + F.when(acc["lo"] == 0, 1).otherwise(0)).bitwiseAND(mask)).otherwise(acc["hi"])
        digits = F.lower(F.regexp_replace(F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0")), "^0+(?=.)", ""))
        return F.concat(F.when(negative, F.lit("-")).otherwise(""), digits)

    return F.aggregate(octets, start, step, done)


def article_id(url: Column) -> Column:
    return stable_hash(canonical_url(url))


def display_host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1), r"^www\.", "")


def first_filled(*columns: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[F.when(trim_all(c) != "", c) for c in columns])


def encode_list(values: Column) -> Column:
    return F.array_join(values, "\n")


def decode_list(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: trim_all(x) != "")


def valid_url(url: Column, https_only: bool = False) -> Column:
    """The address if it is short enough and has a scheme (https where asked for), else null."""
    fits = (F.char_length(url) <= URL_CHARS) & url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")
    return F.when(fits & url.rlike("(?i)^https://") if https_only else fits, url)


def without_outlet(title: Column) -> Column:
    """A headline without `` - outlet`` at its end."""
    head = trim_all(F.regexp_extract(title, r"(?s)^(.*) - (.*)$", 1))
    tail = trim_all(F.regexp_extract(title, r"(?s)^(.*) - (.*)$", 2))
    return F.when((F.char_length(tail).between(1, 40)) & (F.char_length(head) >= 15), head).otherwise(title)


def embedded_url(url: Column) -> Column:
    """The article's own address inside an aggregator's link; the link itself where there is none."""
    token = F.regexp_extract(url, r"/rss/articles/([A-Za-z0-9_-]+)", 1)
    padded = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.char_length(token) / 4) * 4).cast("int"), F.lit("="))
    raw = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")
    found = F.regexp_extract(raw, r"https?://[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]{10,}", 0)
    usable = F.contains(url, F.lit("news.google.com")) & (token != "") & (found != "") & ~F.contains(found, F.lit("news.google.com"))
    return F.when(usable, found).otherwise(url)


#: Arabic forms for counts of new stories - one, two, few, many.
NEW_STORIES = ("خبر جديد", "خبران جديدان", "%d أخبار جديدة", "%d خبرًا جديدًا")


def count_label(n: Column, forms: tuple[str, str, str, str] = NEW_STORIES) -> Column:
    one, two, few, many = forms
    put = lambda form: F.replace(F.lit(form), F.lit("%d"), n.cast("string"))
    return F.when(n == 1, one).when(n == 2, two).when(n <= 10, put(few)).otherwise(put(many))
