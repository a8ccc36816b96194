"""Encoding whole texts with a ``tokenizers`` file, with a per-process cache of encoded words.

The library encodes about 1 MB a second; most words of a corpus repeat.  Texts are cut where no token
can span the cut - before a single space for byte-level files, at spaces for files with word ends -
and each distinct piece is encoded once per process.  Texts for which the cut isn't safe, as those that
hold an added token such as ``<|endoftext|>``, are encoded whole.  Results equal ``Tokenizer.encode`` of
the whole text by the file as loaded.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import islice

import numpy as np

from newsflow.llm.runtime import kept

_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")
#: A line break between characters that are no spaces is a pre-token of its own.
_LONE_BREAK = re.compile(r"(?<=\S)\n(?=\S)")
#: Pieces of these characters (no apostrophe) are cut by the files' pre-tokenizers into runs of letters, of digits and of signs.
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F"
_PLAIN = re.compile(rf"[{_LETTERS}0-9!-&(-/:-@\[-`{{-~]+")
_RUNS = re.compile(rf"[{_LETTERS}]+|[0-9]+|[^{_LETTERS}0-9]+")
#: Entries kept per process; the cache then starts anew.
CACHE_ENTRIES = 600_000
#: Entries that an idle process keeps: the first ones, as common words come early.
IDLE_ENTRIES = 250_000


def _byte_letters() -> dict[str, str]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): chr(b) for b in plain} | {chr(b): chr(256 + k) for k, b in enumerate(others)}


_SPELLED = str.maketrans(_byte_letters())
_encoders: dict[str, "CachedEncoder"] = {}


kept["encoding"] = _encoders.clear


def encoder(path: str, entries: int = CACHE_ENTRIES) -> "CachedEncoder":
    """One encoder per process and file; Python workers are reused between tasks.  ``entries`` bounds its cache."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    _encoders[path].entries = entries
    return _encoders[path]


class CachedEncoder:
    entries = CACHE_ENTRIES

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        before = rules.get("pre_tokenizer") or {}
        self.cut = None
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not rules.get("normalizer"):
            self.cut = "before space"
        elif rules["model"].get("end_of_word_suffix"):
            self.cut = "at space"
        added = rules.get("added_tokens") or []
        self.added = [a["content"] for a in added]
        if rules.get("normalizer") and any(a["normalized"] for a in added):
            self.cut = None  # such tokens are found in the normalized text only
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = "<u2" if self.width == 2 else "<u4"
        self.folds = "Lowercase" in json.dumps(rules.get("normalizer"))
        self.inner = _Pieces(self, " " if self.cut == "before space" else "")
        self.first = _Pieces(self, "") if self.cut == "before space" else self.inner
        self.code = "H" if self.width == 2 else "I"
        self.line_break = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        batch = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in batch]

    def _encode_piece(self, piece: str, lead: str) -> bytes:
        """One piece; Latin words are one pre-token each and go straight to the library's model."""
        if piece.isalpha() and (piece.isascii() or max(piece) < "\u0130"):
            spelled = lead + (piece.lower() if self.folds else piece)
            spelled = spelled.replace(" ", "\u0120") if piece.isascii() else spelled.encode().decode("latin-1").translate(_SPELLED)
            return array(self.code, [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
        return self._encode([lead + piece])[0]

    def shrink(self, most: int = IDLE_ENTRIES) -> None:
        """Leaves the first ``most`` entries of the cache."""
        for known in (self.inner, self.first):
            if len(known) > most:
                kept = list(islice(known.items(), most))
                known.clear()
                known.update(kept)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of ``self.width`` bytes; null is empty."""
        if self.cut is None:
            return self._encode([t or "" for t in texts])
        inner, first = self.inner, self.first
        for known in (inner, first):
            if len(known) > self.entries:
                known.clear()
        led = self.cut == "before space"
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif any(a in t for a in self.added):
                out.append(self._encode([t])[0])
            elif not led:
                out.append(b"".join(map(inner.__getitem__, t.split(" "))))
            elif _LOOSE_SPACE.search(t):
                out.append(self._encode([t])[0])
            else:
                head, _, rest = t.partition(" ")
                out.append(first[head] + b"".join(map(inner.__getitem__, rest.split(" "))) if _ else first[head])
        return out


class _Pieces(dict):
    """Encoded pieces by their text.  A missing one is taken apart where no token can span, then encoded."""

    def __init__(self, owner: CachedEncoder, lead: str):
        self.owner, self.lead = owner, lead

    def __missing__(self, piece: str) -> bytes:
        ids = None
        if len(piece) > 1 and not piece.isalpha():
            if _PLAIN.fullmatch(piece):
                runs = _RUNS.findall(piece)
                if len(runs) > 1:
                    ids = self[runs[0]] + b"".join(map(self.owner.first.__getitem__, runs[1:]))
            elif len(lines := _LONE_BREAK.split(piece)) > 1:
                ids = self.owner.line_break.join([self[lines[0]], *map(self.owner.first.__getitem__, lines[1:])])
        if ids is None:
            ids = self.owner._encode_piece(piece, self.lead)
        self[piece] = ids
        return ids
