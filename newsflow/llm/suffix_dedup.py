"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that a document of lesser id holds too.

Every string of LENGTH bytes has a minimizer: the run of K bytes with the least hash in it (the
leftmost of equals).  Equal strings have equal minimizers, so strings meet by minimizer and a run of
neighbouring strings with one minimizer - a stretch of at most 2 LENGTH - K bytes - travels as one piece.

1. Minimizer hashes of all documents are grouped; those of one document only go.
2. Stretches around the rest are grouped by minimizer.  Where all of a minimizer's stretches are equal, as in exact copies, they are one string and
   its least document keeps it.  The distinct stretches of all others are joined to one text; its
   suffix array is sorted as far as LENGTH, and on its Burrows-Wheeler transform intervals are extended backward,
   breadth first: an interval of strings of length l is met when its border has the common prefix l - 1, so common
   prefixes are derived by increasing value.  At LENGTH the expansion stops; suffixes that no border parts share LENGTH bytes.
   Each such class has a least document, and its strings are removed from all others.
3. Removed stretches are united per document and applied to its bytes.

Within one batch of texts, equal minimizers or stretches of different documents are settled at once and one
of them travels, so a passage that a third of the corpus shares makes a row per batch, not per document.  Between the steps a
place is an offset in its batch's bytes.  Groups hold the minimizers of about ``PART_BYTES`` of text, however much text there is.

Defined cases: a null text has no bytes; texts below LENGTH bytes keep all; very long texts go through in overlapping pieces; overlapping and adjacent stretches are
one span; rows of one ``doc_id`` never remove each other; a null ``doc_id`` neither removes nor loses bytes; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.runtime import materialize, n_parts, ship_package
from newsflow.llm.shingles import mix, powers

LENGTH, K = 50, 22
#: Bytes of text that are handled at once.
BATCH = 3 << 20
#: A longer text goes through in pieces.
LONG = 1 << 23
#: Bytes of text whose minimizers meet in one group, about.
PART_BYTES = 4 << 20
#: Up to so many ids (8 bytes each) are sent to every executor; beyond, all texts are shuffled.
BROADCAST_IDS = 2_000_000

_PACKED = "kind int, key long, batch long, a binary, b binary, c binary, d binary"
_PACKED_SCHEMA = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("batch", pa.int64()), *((x, pa.binary()) for x in "abcd")])
GROUPED, SETTLED, DOCS = 0, 1, 2


def _row(kind: int, key: int, batch: int, *arrays: np.ndarray) -> tuple:
    blobs = [x.tobytes() for x in arrays]
    return (kind, key, batch, *blobs, *[b""] * (4 - len(blobs)))


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PACKED_SCHEMA)], schema=_PACKED_SCHEMA)


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K):
    """(place of the minimizer, first string's start, last string's start, minimizer hash) of every run.

    ``data`` holds documents at [starts, ends); strings never cross documents.
    """
    n = len(data)
    nothing = np.zeros(0, np.int64)
    if n < length:
        return nothing, nothing, nothing, np.zeros(0, np.uint64)
    forward, back = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[:n], out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * back[:n - k + 1])
    least = (h & np.uint64(0xFFFFFFFFFF000000)) if n < 1 << 24 else None
    if least is None:
        raise ValueError("a batch is too long")
    least = least | np.arange(len(h), dtype=np.uint64)
    span, reach = length - k + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach:])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    long_ = ends - starts >= length
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, ends[long_] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(place)])
    if not len(at):
        return nothing, nothing, nothing, np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (place[at[1:]] != place[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    where = place[at[first]]
    return where, at[first], at[last], h[where]


def _batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Slices of documents of about BATCH bytes."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends


def _batch_id(doc_ids: np.ndarray, hashes: np.ndarray) -> int:
    x = mix(mix(doc_ids.view(np.uint64)) ^ hashes.view(np.uint64)) + np.arange(len(doc_ids), dtype=np.uint64)
    return int(mix(np.array([mix(x).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])


def _by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(parts, kind="stable")
    edges = np.flatnonzero(np.diff(parts[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(parts[order[a]]), order[a:b]


def _layouts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, documents' starts and ends, and the offset in the batch: all texts at once, or a long one in overlapping pieces."""
    if max(map(len, texts)) <= LONG:
        yield *_laid_out(texts), 0
        return
    step, base = LONG - LENGTH, 0
    for t in texts:
        for at in range(0, max(1, len(t) - LENGTH + 1), step):
            yield *_laid_out([t[at:at + step + LENGTH - 1] if len(t) > LONG else t]), base + at
            if len(t) <= LONG:
                break
        base += len(t)


def _encoded(b: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]


def _docs_row(batch: int, ids: np.ndarray, hashes: np.ndarray, texts: list[bytes]) -> tuple:
    sizes = np.array([len(t) for t in texts], np.int64)
    return _row(DOCS, batch, batch, ids.astype("<i8"), hashes.astype("<i8"), (np.cumsum(sizes) - sizes).astype("<i8"))


def _anchors(parts: int):
    """Minimizers of every document, packed by hash part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _encoded(b)
            all_ids, all_hashes = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), b.column("text_hash").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in _batches(texts):
                ids, hashes = all_ids[lo:hi], all_hashes[lo:hi]
                batch = _batch_id(ids, hashes)
                docs = _docs_row(batch, ids, hashes, texts[lo:hi])
                rows, tags, places = [docs], [], []
                for data, starts, ends, offset in _layouts(texts[lo:hi]):
                    where, _, _, h = stretches(data, starts, ends)
                    tags.append(h)
                    places.append(where + offset)
                h, place = np.concatenate(tags), np.concatenate(places)
                order = np.argsort(h, kind="stable")
                h, place = h[order], place[order]
                id_ = ids[np.searchsorted(np.frombuffer(docs[5], "<i8"), place, side="right") - 1]
                fresh = np.ones(len(h), bool)
                fresh[1:] = h[1:] != h[:-1]
                lead = np.flatnonzero(fresh)
                if len(lead):
                    known = np.repeat(np.minimum.reduceat(id_, lead) != np.maximum.reduceat(id_, lead), np.diff(np.append(lead, len(h))))
                    if known.any():
                        rows.append(_row(SETTLED, batch, batch, place[known].astype("<u4")))
                    # one minimizer of a settled group goes on, marked; of the rest all
                    go = ~known | fresh
                    h, place, known = h[go], place[go], known[go]
                    for p, at in _by_part((h % np.uint64(parts)).astype(np.int64)):
                        rows.append(_row(GROUPED, p, batch, (h[at] >> np.uint64(32)).astype("<u4"), place[at].astype("<u4"), np.packbits(known[at])))
                yield from _table(rows).to_batches()

    return run


def _unpacked(table: pa.Table):
    for batch, a, b, c, d in zip(*(table.column(x).to_pylist() for x in ("batch", *"abcd")), strict=True):
        yield batch, a, b, c, d


def _per_batch(batch_of: np.ndarray, names: list[int], *columns: np.ndarray) -> list[tuple]:
    return [_row(SETTLED, names[p], names[p], *(c[at] for c in columns)) for p, at in _by_part(batch_of)]


def _shared(table: pa.Table) -> pa.Table:
    """Minimizers that different documents have, back to their batches (a repeated id only adds candidates)."""
    if table.column("kind")[0].as_py() != GROUPED:
        return table
    names, tags, places, marks, batch_of = [], [], [], [], []
    for batch, a, b, c, _ in _unpacked(table):
        n = len(a) // 4
        batch_of.append(np.full(n, len(names), np.int64))
        names.append(batch)
        tags.append(np.frombuffer(a, "<u4"))
        places.append(np.frombuffer(b, "<u4"))
        marks.append(np.unpackbits(np.frombuffer(c, np.uint8), count=n).astype(bool))
    tag, place, mark, batch_of = (np.concatenate(x) for x in (tags, places, marks, batch_of))
    order = np.argsort(tag, kind="stable")
    tag, place, mark, batch_of = (x[order] for x in (tag, place, mark, batch_of))
    lead = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
    # what different documents of one batch have is marked, so those that nobody marked need another batch
    shared = np.minimum.reduceat(batch_of, lead) != np.maximum.reduceat(batch_of, lead)
    keep = np.repeat(shared, np.diff(np.append(lead, len(tag)))) & ~mark
    return _table(_per_batch(batch_of[keep], names, place[keep].astype("<u4")))


def _per_document(item: str):
    """Of one batch: a row per document with its items - places, or stretches united."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        docs = table.filter(pa.array(kind == DOCS)).slice(0, 1)
        rest = table.filter(pa.array(kind == SETTLED))
        ids, hashes, starts = (np.frombuffer(docs.column(c)[0].as_py(), "<i8") for c in "abc")
        out: list[tuple] = []
        if rest.num_rows:
            one = np.frombuffer(b"".join(rest.column("a").to_pylist()), "<u4").astype(np.int64)
            order = np.argsort(one, kind="stable")
            one = one[order]
            doc = np.searchsorted(starts, one, side="right") - 1
            two = np.frombuffer(b"".join(rest.column("b").to_pylist()), "<u4")[order] - starts[doc] if item == "stretches" else None
            one = one - starts[doc]
            edges = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                d = int(doc[a])
                blob = np.unique(one[a:b]) if two is None else np.stack(unite(one[a:b], two[a:b]), axis=1)
                out.append((int(ids[d]), int(hashes[d]), blob.astype("<u4").tobytes()))
        return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["doc_id", "text_hash", "items"])

    return run


def unite(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and adjacent stretches, sorted by start, as one."""
    far = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > far[:-1]
    lead = np.flatnonzero(new)
    return starts[lead], far[np.append(lead[1:], len(starts)) - 1]


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of slices, one after the other."""
    return data[np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


def numbered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each slice's string, a slice of each string): equal hashes are checked byte by byte."""
    h = sizes.astype(np.uint64)
    longest_first = np.argsort(-sizes, kind="stable")
    falling = sizes[longest_first]
    for k in range(int(falling[0]) if len(falling) else 0):
        # slices are short: one step for the k-th byte of all that have one
        at = longest_first[: np.searchsorted(-falling, -k, side="left")]
        h[at] = h[at] * np.uint64(0x9E3779B97F4A7C15) + data[starts[at] + k]
    h = mix(h)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    like = first[number]
    other = np.flatnonzero(like != np.arange(len(h)))
    if (sizes[other] != sizes[like[other]]).any() or (_gather(data, starts[other], sizes[other]) != _gather(data, starts[like[other]], sizes[other])).any():
        # two strings with one hash: by the strings themselves
        raw, known = data.tobytes(), {}
        number = np.array([known.setdefault(raw[s:s + n], len(known)) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        first = np.unique(number, return_index=True)[1]
    return number, first


def _cut_stretches(parts: int):
    """Stretches around shared minimizers, packed by minimizer; copies within the batch settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _encoded(b)
            all_ids, all_hashes = b.column("doc_id").to_numpy(), b.column("text_hash").to_numpy()
            shared = b.column("items").to_pylist()
            for lo, hi in _batches(texts):
                ids, hashes = all_ids[lo:hi], all_hashes[lo:hi]
                batch = _batch_id(ids, hashes)
                docs = _docs_row(batch, ids, hashes, texts[lo:hi])
                begin = np.frombuffer(docs[5], "<i8")
                wanted = np.concatenate([np.frombuffer(x, "<u4") + base for x, base in zip(shared[lo:hi], begin, strict=True)])
                rows = [docs]
                for data, starts, ends, offset in _layouts(texts[lo:hi]):
                    where, first, last, h = stretches(data, starts, ends)
                    keep = np.isin(where + offset, wanted)
                    if not keep.any():
                        continue
                    first, size, h = first[keep], last[keep] + LENGTH - first[keep], h[keep]
                    id_ = ids[np.searchsorted(begin, first + offset, side="right") - 1]
                    number, one = numbered(data, first, size)
                    least = np.full(len(one), np.iinfo(np.int64).max)
                    np.minimum.at(least, number, id_)
                    gone = id_ > least[number]
                    if gone.any():
                        at = first[gone] + offset
                        rows.append(_row(SETTLED, batch, batch, at.astype("<u4"), (at + size[gone]).astype("<u4")))
                    first, size, h, id_ = first[~gone], size[~gone], h[~gone], id_[~gone]
                    for p, at in _by_part((h % np.uint64(parts)).astype(np.int64)):
                        head = np.stack([(h[at] >> np.uint64(32)).astype(np.int64), first[at] + offset], axis=1).astype("<u4")
                        rows.append(_row(GROUPED, p, batch, size[at].astype("<u1"), head, id_[at].astype("<i8"), _gather(data, first[at], size[at])))
                yield from _table(rows).to_batches()

    return run


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` symbols (at least), by doubling from packed sevens; and these."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k:n + k]
    sevens, done = key, 7
    while True:
        order = np.argsort(key)
        if done >= depth:
            return order, sevens
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])).astype(np.uint64) + np.uint64(1)
        later = np.zeros(n, np.uint64)
        later[: n - done] = rank[done:]
        key = (rank << np.uint64(32)) | later
        done *= 2


def prefix_classes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, starts of classes): suffixes of a class share their first ``length`` symbols.

    Breadth-first backward extension: ``border[i]`` tells that suffixes i-1 and i have a common prefix below
    the current length.  An interval of strings of length l + 1 is followed up only if extending found its right
    border with common prefix l, so every border is found once, by increasing value.  Common prefixes below 7
    are read off the packed first symbols, which stand for the first seven, widest, rounds.
    """
    n = len(symbols)
    order, sevens = suffix_array(symbols, length)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    forward = np.empty(n, np.int64)
    forward[by_symbol] = np.arange(n)
    lead = symbols[order]
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    left, right, known = np.array([0]), np.array([n - 1]), 0
    if length >= 7:
        packed = sevens[order]
        apart = packed[1:] ^ packed[:-1]
        border[1:n] = apart != 0
        starts = np.flatnonzero(border[:n])
        ends = np.append(starts[1:], n) - 1
        live = np.zeros(len(starts), bool)
        live[:-1] = apart[ends[:-1]] >> np.uint64(9) == 0  # a right border of common prefix 6
        left, right, known = starts[live], ends[live], 7
    for _ in range(known, length):
        if not len(left):
            break
        sizes = right - left + 1
        owner = np.repeat(np.arange(len(left)), sizes)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left, sizes)
        moved = np.sort((forward[rows] << 32) | owner)
        place, owner = moved >> 32, moved & 0xFFFFFFFF
        new = np.ones(len(place), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (np.diff(place) != 1) | (lead[place[1:]] != lead[place[:-1]])
        first = np.flatnonzero(new)
        left, right = place[first], place[np.append(first[1:], len(place)) - 1]
        fresh = ~border[right + 1]
        left, right = left[fresh], right[fresh]
        border[right + 1] = True
    return order, np.flatnonzero(border[:n])


def _expand(table: pa.Table) -> pa.Table:
    """Stretches of a part: the strings that a lesser document holds too, back to their batches."""
    if table.column("kind")[0].as_py() != GROUPED:
        return table
    names, sizes, heads, ident, blobs, batch_of = [], [], [], [], [], []
    for batch, a, b, c, d in _unpacked(table):
        sizes.append(np.frombuffer(a, np.uint8).astype(np.int64))
        heads.append(np.frombuffer(b, "<u4").reshape(-1, 2).astype(np.int64))
        ident.append(np.frombuffer(c, "<i8"))
        blobs.append(d)
        batch_of.append(np.full(len(sizes[-1]), len(names), np.int64))
        names.append(batch)
    sizes, heads, ident, batch_of = (np.concatenate(x) for x in (sizes, heads, ident, batch_of))
    tag, start = heads[:, 0], heads[:, 1]
    data = np.frombuffer(b"".join(blobs), np.uint8)
    string, sample = numbered(data, np.cumsum(sizes) - sizes, sizes)
    least = np.full(len(sample), np.iinfo(np.int64).max)
    np.minimum.at(least, string, ident)
    # a tag of one string alone: its least document keeps it
    order = np.argsort(tag, kind="stable")
    lead = np.flatnonzero(np.concatenate([[True], tag[order][1:] != tag[order][:-1]]))
    alone = np.empty(len(tag), bool)
    alone[order] = np.repeat(np.minimum.reduceat(string[order], lead) == np.maximum.reduceat(string[order], lead), np.diff(np.append(lead, len(tag))))
    whole = np.flatnonzero(alone & (ident > least[string]))
    out = [(batch_of[whole], start[whole], start[whole] + sizes[whole])]
    some = np.flatnonzero(~alone)
    if len(some):
        out.append(_common(data, (np.cumsum(sizes) - sizes)[sample], sizes, string, sample, least, start, ident, batch_of, some))
    who, begin, end = (np.concatenate(x) for x in zip(*out, strict=True))
    return _table(_per_batch(who, names, begin.astype("<u4"), end.astype("<u4")))


def _common(data, places, sizes, string, sample, least, start, ident, batch_of, some) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(batch, begin, end) of what goes from the occurrences ``some``, by classes of the suffixes of their strings."""
    used, own = np.unique(string[some], return_inverse=True)
    lengths = sizes[sample[used]]
    bases = np.cumsum(lengths + 1) - (lengths + 1)
    # symbols 1 to 256 are bytes, 0 parts the stretches
    raw = np.zeros(int((lengths + 1).sum()), np.uint16)
    raw[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(used)), lengths)] = _gather(data, places[used], lengths).astype(np.uint16) + 1
    order, lead = prefix_classes(raw, LENGTH)
    of_symbol = np.repeat(np.arange(len(used)), lengths + 1)
    lowest = np.minimum.reduceat(least[used][of_symbol[order]], lead)
    holder = np.empty(len(raw), np.int64)
    holder[order] = np.repeat(lowest, np.diff(np.append(lead, len(raw))))
    # strings of every occurrence: those whose holder is a lesser document go
    windows = sizes[some] - LENGTH + 1
    owner = np.repeat(np.arange(len(some)), windows)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    gone = np.flatnonzero(holder[bases[own[owner]] + step] < ident[some][owner])
    new = np.ones(len(gone), bool)
    new[1:] = (np.diff(gone) != 1) | (owner[gone[1:]] != owner[gone[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(gone)) - 1 if len(gone) else first
    who = some[owner[gone[first]]]
    return batch_of[who], start[who] + step[gone[first]], start[who] + step[gone[last]] + LENGTH


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for b in batches:
        rows = []
        for doc_id, text, items in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "items")), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans = np.frombuffer(items or b"", "<u4").reshape(-1, 2).tolist()
            at, kept = 0, []
            for s, e in spans:
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            left = b"".join(kept)
            rows.append((doc_id, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def remove_repeats(documents: DataFrame, broadcast_ids: int = BROADCAST_IDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): ``kept`` are the remaining bytes."""
    spark = documents.sparkSession
    ship_package(spark)
    size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(n_parts(spark), -(-int(size) // part_bytes))
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    named = docs.where("doc_id IS NOT NULL AND octet_length(text) >= 50")
    found = named.mapInArrow(_anchors(parts), _PACKED).groupBy("kind", "key").applyInArrow(_shared, _PACKED)
    wanted = materialize(found.groupBy("batch").applyInArrow(_per_document("places"), "doc_id long, text_hash long, items binary")
                         .dropDuplicates(["doc_id", "text_hash"]), "suffix-places")
    cut = named.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "items").mapInArrow(_cut_stretches(parts), _PACKED)
    gone = cut.groupBy("kind", "key").applyInArrow(_expand, _PACKED).groupBy("batch").applyInArrow(_per_document("stretches"), "doc_id long, text_hash long, items binary")
    gone = materialize(gone.groupBy("doc_id", "text_hash").agg(F.min("items").alias("items")), "suffix-spans")
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    ids = materialize(gone.select("doc_id").distinct(), "suffix-ids")
    if ids.count() > broadcast_ids:
        return docs.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text", "items").mapInArrow(_apply, columns)
    # documents that lose nothing are not shuffled
    hit = docs.join(F.broadcast(ids), "doc_id", "left_semi").join(gone.hint("merge"), ["doc_id", "text_hash"], "left").select("doc_id", "text", "items")
    rest = docs.join(F.broadcast(ids), "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast("binary").alias("items"))
    return hit.unionByName(rest).mapInArrow(_apply, columns)
