"""N-gram Jaccard join: parity sketches, pigeonhole buckets per size band, exact verification.

Two sets with Jaccard similarity t or more differ in at most D = (1-t)/(1+t) (|A|+|B|) shingles.  A parity
sketch has a bit per hash bucket, the XOR of its tokens; each differing token flips one bit at most, so
the sketches' Hamming distance bounds the symmetric difference from below.  Cut into more than D blocks, two
similar sets' sketches agree on a block.

* Size bands grow by 1/t, so a partner's band is a set's own or a neighbour's; sets are sketched in the
  layout of their own band and of the next.  A layout has D+1 blocks and some slack; blocks are ranges of the
  shingle hash, and a block travels as a 64-bit linear fingerprint of its parities.
* Buckets of up to ``COLD`` sets propose all their pairs.  Larger ones are hot; where one batch of texts shows a bucket to be hot, its members
  go on beside the bucket, which gets one mark.  Similar sets agree on more blocks than the slack, so a set with no more hot
  blocks than that meets each partner in a cold bucket; only sets with more are compared within hot buckets, and of
  their n hot blocks (in one order for all) only in the first n - slack, among which similar sets still share one.  The empty block has no
  bucket: sets that show more empty blocks than the slack, which may agree on nothing else, also go by their prefix,
  the least shingles of which similar sets share one (an exact bound).
* Sets of hot buckets are first compared with the set of their first bucket that has most hot blocks.  Where verified links leave several components in a
  hot bucket, its sets meet again by their rarest shingles: in one order of all shingles, by their number among these sets, similar sets share one of their first
  (an exact bound, by classes of both sizes).  What most of a family holds comes last, so a key of many sets holds only such as consist of common shingles almost wholly.
* In each key of several components one (that of most sets) is set apart.  Members of all others are compared with
  each other, chunk by chunk, and with the sets of the one, each of which takes part once and not once a key.  The nearest by sketch go first, in rounds that
  allow more each until nothing is left out.
* Proposed pairs whose whole sketches are too far apart go; the rest are verified on the texts' exact
  shingle sets, links that would join nothing new last, so that groups of near copies need no all-pairs check.

Equal sets are one node from the start.  Nodes carry a 64-bit hash of their set; a second one is kept with it, and sets that agree in
the first only are told apart and verified as any others.

Defined cases: texts without words have no shingles and are linked with nothing; very long texts are sets like any; a null ``doc_id`` row
takes part in no link and is its own component (null); rows that repeat a ``doc_id`` are
judged row by row; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.runtime import components, drop_kept, materialize, n_parts, release_memory, ship_package
from newsflow.llm.shingles import drop_powers, mix, shingle_sets

COLD = 8
#: Sets that one task compares with one another, at most twice as many.
CHUNK = 512
#: Bytes of text whose fingerprints meet in one group, about.
PART_BYTES = 8 << 20
#: Fingerprints that a task holds before it passes them on.
HELD = 400_000
#: Bits of a whole sketch per member, at least.
SKETCH_BITS = 4
#: Up to so many ids (8 bytes each) are sent to every executor; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
SHINGLE_WORDS = 5
#: Counters of shingles, and rows that they travel in.  Shingles of one counter count as one; that is an order as exact as any.
SLOTS, SLOT_PIECES = 1 << 20, 64
#: Size classes for keys of rare shingles grow by 1/20.
FINE = 20


class Bands:
    """Size bands and block layouts for a threshold of num/den."""

    def __init__(self, num: int = 80, den: int = 100):
        self.num, self.den = num, den
        self.upper, self.fine = [1], [1]

    def differ(self, total: int) -> int:
        """The largest symmetric difference of similar sets with ``total`` members together."""
        return total * (self.den - self.num) // (self.den + self.num)

    def most(self, n: int) -> int:
        """The size of the largest partner."""
        return n * self.den // self.num

    def band(self, n: int) -> int:
        while self.upper[-1] < n:
            self.upper.append(max(self.upper[-1] + 1, self.most(self.upper[-1])))
        return int(np.searchsorted(self.upper, n))

    def prefix(self, n: int) -> int:
        """How many of its least shingles a set shows so that similar sets show one in common: they have num/den of n."""
        return n + (-n * self.num) // self.den + 1

    def fine_class(self, n: int) -> int:
        while self.fine[-1] < n:
            self.fine.append(max(self.fine[-1] + 1, self.fine[-1] * (FINE + 1) // FINE))
        return int(np.searchsorted(self.fine, n))

    def rare(self, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(class, class, side, length) for each class of partners: of the shingles in one order, similar sets have one in common among so many first ones.
        The side is 1 for the lower class, 2 for the higher, 3 for both."""
        own, least = self.fine_class(n), -(-n * self.num // self.den)
        for other in range(self.fine_class(least), self.fine_class(self.most(n)) + 1):
            partner = max(least, self.fine[other - 1] + 1 if other else 1)
            yield min(own, other), max(own, other), 3 if own == other else 1 + (own > other), n + (-(n + partner) * self.num) // (self.num + self.den) + 1

    def slack(self, layout: int) -> int:
        return 3 + self.differ(2 * self.upper[layout]) // 8

    def blocks(self, layout: int) -> int:
        return self.differ(2 * self.upper[layout]) + 1 + self.slack(layout)

    def layouts(self, n: int) -> list[tuple[int, int, int]]:
        """(layout, its blocks, how many of them a set of n members shows)."""
        home, largest, out = self.band(n), self.most(n), []
        self.band(self.upper[home] + 1)
        within = self.differ(n + min(self.upper[home], largest))
        if within:
            out.append((home, self.blocks(home), within + 1 + self.slack(home)))
        if largest > self.upper[home]:
            out.append((home + 1, self.blocks(home + 1), min(self.differ(n + largest) + 1 + self.slack(home + 1), self.blocks(home + 1))))
        return out


def _rest() -> None:
    """At the end of a task or group: an idle worker keeps little."""
    drop_powers()
    release_memory()


def sketch_bits(n: int) -> int:
    return 1 << max(6, (SKETCH_BITS * n - 1).bit_length())


def whole_sketch(hashes: np.ndarray) -> bytes:
    """The parity sketch of a set, some bits per member."""
    bits = sketch_bits(len(hashes))
    at = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer bits: halves XORed."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


def names_of(hashes: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two signed 64-bit names of a set (the first of ``bits`` bits)."""
    size = np.uint64(len(hashes))
    sums = np.array([mix(hashes).sum(dtype=np.uint64) ^ size, mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + size], np.uint64)
    one, two = mix(sums).view(np.int64).tolist()
    return (one if bits >= 64 else one & ((1 << bits) - 1)), two


def block_fingerprints(hashes: np.ndarray, scrambled: np.ndarray, layout: int, blocks: int, shown: int) -> tuple[np.ndarray, int]:
    """Fingerprints of the non-empty ones of the first ``shown`` blocks, and how many are empty."""
    place = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    place = place[: np.searchsorted(place, shown)]
    if not len(place):
        return np.zeros(0, np.uint64), shown
    starts = np.flatnonzero(np.diff(place, prepend=place[0] + np.uint64(1)))
    parity = np.bitwise_xor.reduceat(scrambled[: len(place)], starts)
    key = np.array([layout], np.uint64) * np.uint64(0xA0761D6478BD642F) + place[starts] * np.uint64(0xE7037ED1A0B428DB)
    return mix(parity ^ mix(key)), shown - len(starts)


def prefix_fingerprints(hashes: np.ndarray, layout: int, most: int) -> np.ndarray:
    """Fingerprints of a set's ``most`` least shingles, each by itself."""
    return mix(mix(hashes[:most]) ^ mix(np.array([layout], np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)))


def set_fingerprints(hashes: np.ndarray, bands: Bands) -> Iterator[tuple[int, np.ndarray, int]]:
    """(layout, fingerprints, empty blocks): similar sets share a fingerprint in a layout, or are equal."""
    layouts = bands.layouts(len(hashes)) if len(hashes) else []
    if not layouts:
        return
    scrambled = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    for layout, blocks, shown in layouts:
        found, empty = block_fingerprints(hashes, scrambled, layout, blocks, shown)
        if empty > bands.slack(layout):
            found = np.concatenate([found, prefix_fingerprints(hashes, layout, bands.prefix(len(hashes)))])
        yield layout, found, empty


#: Rows between the two steps, packed by bucket part: a row per part and group of texts.
_SIGNED = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("node", pa.binary()), ("layout", pa.binary()), ("empty", pa.binary()), ("entry", pa.binary()), ("sig", pa.binary())])
_SIGNED_SQL = "kind byte, part int, node binary, layout binary, empty binary, entry binary, sig binary"
_FOUND = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("layout", pa.int32()), ("empty", pa.int32()), ("n", pa.int64()), ("other", pa.int64()), ("sketch", pa.binary())])
_FOUND_SQL = "kind byte, a long, b long, layout int, empty int, n long, other long, sketch binary"
#: Kinds of packed rows, and of what is found.
COLD_PART, HOT_PART, SETS = 0, 1, 2
PAIR, HOT, SET = 0, 1, 2
#: The layout of a mark: its bucket is hot whatever else it holds.
MARK = 0xFFFF


def bucket_id(sig: np.ndarray, parts: int) -> np.ndarray:
    return ((sig >> np.uint64(16) << np.uint64(16)) | (sig % np.uint64(parts) & np.uint64(0xFFFF))).view(np.int64)


def _sign(words: int, parts: int, num: int, den: int, bits: int):
    """Sets, and fingerprints of every set (48 bits and the part)."""

    def row(kind: int, part: int, *blobs: bytes) -> tuple:
        return (kind, part, *blobs, *[b""] * (5 - len(blobs)))

    def packed(sigs: list, owners: list, entries: list) -> Iterator[tuple]:
        sig, owner = np.concatenate(sigs), np.concatenate(owners)
        node, layout, empty = (np.array(x) for x in zip(*entries, strict=True))
        order = np.argsort(sig, kind="stable")
        sig, owner = sig[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        sizes = np.diff(np.append(starts, len(sig)))
        hot = np.repeat(sizes > COLD, sizes)
        if hot.any():
            own, entry = np.unique(owner[hot], return_inverse=True)
            ids = bucket_id(sig[hot], parts)
            yield row(HOT_PART, int(sig[-1] % np.uint64(parts)), node[own].astype("<i8").tobytes(), layout[own].astype("<u2").tobytes(), empty[own].astype("<i4").tobytes(),
                      entry.astype("<u4").tobytes(), ids.astype("<i8").tobytes())
            marks = sig[starts[sizes > COLD]]
            node, layout, empty = np.append(node, 0), np.append(layout, MARK), np.append(empty, 0)
            sig, owner = np.concatenate([sig[~hot], marks]), np.concatenate([owner[~hot], np.full(len(marks), len(node) - 1)])
        part = (sig % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        sig, owner, part = (sig[order] >> np.uint64(16)), owner[order], part[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own, entry = np.unique(owner[a:b], return_inverse=True)
            yield row(COLD_PART, int(part[a]), node[own].astype("<i8").tobytes(), layout[own].astype("<u2").tobytes(), empty[own].astype("<i4").tobytes(),
                      entry.astype("<u4").tobytes(), sig[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SIGNED, strict=True)], schema=_SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        bands = Bands(num, den)
        sigs, owners, entries, held, seen = [], [], [], 0, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, known = batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                names, sizes, sketches = [], [], []
                for h, named in zip(shingle_sets(batch.column("text").to_pylist(), words), known.tolist(), strict=True):
                    name = names_of(h, bits)
                    names.append(name)
                    sizes.append(len(h))
                    sketches.append(whole_sketch(h) if len(h) else b"")
                    if not named or name in seen:
                        continue
                    seen.add(name)
                    for layout, f, empty in set_fingerprints(h, bands):
                        sigs.append(f)
                        owners.append(np.full(len(f), len(entries), np.int64))
                        entries.append((name[0], layout, empty))
                        held += len(f)
                    if held > HELD:
                        yield out(list(packed(sigs, owners, entries)))
                        sigs, owners, entries, held, seen = [], [], [], 0, set()
                lengths = np.array([len(x) for x in sketches], "<u4")
                part = int(np.array(names[0], np.int64).view(np.uint64)[1] % np.uint64(parts))
                yield out([row(SETS, part, np.array(names, "<i8").tobytes(), ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes(), np.array(sizes, "<i8").tobytes(), lengths.tobytes(), b"".join(sketches))])
        if held:
            yield out(list(packed(sigs, owners, entries)))
        del sigs, owners, entries, seen
        _rest()

    return run


def _found(kind: int, a: np.ndarray, b: np.ndarray, layout: np.ndarray | None = None, empty: np.ndarray | None = None) -> pa.Table:
    k = len(a)
    none = np.zeros(k, np.int32)
    return pa.table([np.full(k, kind, np.int8), a.astype(np.int64), b.astype(np.int64), none if layout is None else layout.astype(np.int32), none if empty is None else empty.astype(np.int32),
                     pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], schema=_FOUND)


def _sets(table: pa.Table) -> pa.Table:
    """A row per document: a = doc_id, b = node, other = its second name."""
    out = []
    for names, ids, sizes, lengths, sketches in zip(*(table.column(c).to_pylist() for c in ("node", "layout", "empty", "entry", "sig")), strict=True):
        name = np.frombuffer(names, "<i8").reshape(-1, 2)
        k = len(name)
        known = np.frombuffer(ids, np.uint8)[8 * k:].astype(bool)
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<u4"))]).astype(np.int32)
        sketch = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(ends), pa.py_buffer(sketches)])
        none = np.zeros(k, np.int32)
        out.append(pa.table([np.full(k, SET, np.int8), pa.array(np.frombuffer(ids[: 8 * k], "<i8"), pa.int64(), mask=~known), np.ascontiguousarray(name[:, 0]), none, none, np.frombuffer(sizes, "<i8"), np.ascontiguousarray(name[:, 1]), sketch], schema=_FOUND))
    return pa.concat_tables(out)


def _bucket(table: pa.Table) -> pa.Table:
    """What a group of packed rows holds; see ``_in_bucket``."""
    out = _in_bucket(table)
    release_memory()
    return out


def _in_bucket(table: pa.Table) -> pa.Table:
    """PAIR: pairs of a cold bucket (a < b).  HOT: a hot bucket a and its member b.  SET: see above."""
    kind = table.column("kind")[0].as_py()
    if kind == SETS:
        return _sets(table)
    nodes, layouts, empties, owners, sigs, base = [], [], [], [], [], 0
    part = table.column("part")[0].as_py() & 0xFFFF
    for node, layout, empty, entry, sig in zip(*(table.column(c).to_pylist() for c in ("node", "layout", "empty", "entry", "sig")), strict=True):
        nodes.append(np.frombuffer(node, "<i8"))
        layouts.append(np.frombuffer(layout, "<u2"))
        empties.append(np.frombuffer(empty, "<i4"))
        owners.append(np.frombuffer(entry, "<u4").astype(np.int64) + base)
        if kind == HOT_PART:
            sigs.append(np.frombuffer(sig, "<i8"))
        else:
            wide = np.zeros((len(sig) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(sig, np.uint8).reshape(-1, 6)
            sigs.append(wide.view("<u8").ravel())
        base += len(nodes[-1])
    node, layout, empty, owner, sig = (np.concatenate(x) for x in (nodes, layouts, empties, owners, sigs))
    if kind == HOT_PART:
        return _found(HOT, sig, node[owner], layout[owner], empty[owner])
    order = np.argsort(sig, kind="stable")
    sig, owner = sig[order], owner[order]
    same = np.zeros(len(sig), bool)
    same[1:] = sig[1:] == sig[:-1]
    shared = same.copy()
    shared[:-1] |= same[1:]
    shared |= layout[owner] == MARK
    sig, owner = sig[shared], owner[shared]
    order = np.lexsort((node[owner], layout[owner] == MARK, sig))
    sig, owner = sig[order], owner[order]
    mark = layout[owner] == MARK
    # equal texts are one node, many marks are one
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[owner[1:]] != node[owner[:-1]]) | (mark[1:] != mark[:-1])
    sig, owner, mark = sig[fresh], owner[fresh], mark[fresh]
    who = node[owner]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(sig)))
    marked = np.logical_or.reduceat(mark, starts) if len(starts) else np.zeros(0, bool)
    left, right = [], []
    for m in range(2, COLD + 1):
        members = who[starts[(sizes == m) & ~marked][:, None] + np.arange(m)[None, :]]
        for i in range(m):
            for j in range(i + 1, m):
                left.append(members[:, i])
                right.append(members[:, j])
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0) if left else np.zeros((0, 2), np.int64)
    hot = np.repeat((sizes > COLD) | marked, sizes) & ~mark
    ids = ((sig[hot] << np.uint64(16)) | np.uint64(part)).view(np.int64)
    return pa.concat_tables([_found(PAIR, pairs[:, 0], pairs[:, 1]), _found(HOT, ids, who[hot], layout[owner[hot]], empty[owner[hot]])])


def _near_by_sketch(num: int, den: int):
    """Keeps pairs whose sketches may belong to similar sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for b in batches:
            n1, n2 = b.column("n1").to_pylist(), b.column("n2").to_pylist()
            keep = [max(x, y) <= bands.most(min(x, y)) and hamming(s, t) <= bands.differ(x + y)
                    for x, y, s, t in zip(n1, n2, b.column("s1").to_pylist(), b.column("s2").to_pylist(), strict=True)]
            kept = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], schema=schema)
        _rest()

    return run


def _verify(words: int, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                one, two = shingle_sets(b.column("t1").to_pylist(), words), shingle_sets(b.column("t2").to_pylist(), words)
                keep = []
                for x, y in zip(one, two, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(den * common >= num * (len(x) + len(y) - common))
                kept = b.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], schema=schema)
        _rest()

    return run


def _own_texts(words: int):
    """Of the texts of a doc_id those of the node's set, by its second name too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                names = [names_of(h)[1] for h in shingle_sets(b.column("text").to_pylist(), words)]
                yield b.filter(pa.array([x == y for x, y in zip(names, b.column("other").to_pylist(), strict=True)], pa.bool_())).select(["node", "text"])
        _rest()

    return run


def _own_sets(words: int):
    """Of the sets of a doc_id the node's, by its second name too."""
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows = [(n, h.astype("<u8").tobytes()) for n, o, h in zip(b.column("node").to_pylist(), b.column("other").to_pylist(), shingle_sets(b.column("text").to_pylist(), words), strict=True) if names_of(h)[1] == o]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.binary())], schema=schema)
        _rest()

    return run


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's sets fall on each counter, in pieces."""
    counts = np.zeros(SLOTS, np.int64)
    for b in batches:
        hashes = np.frombuffer(b"".join(b.column("hashes").to_pylist()), "<u8")
        counts += np.bincount((hashes & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    pieces = [np.flatnonzero(x) for x in np.split(counts, SLOT_PIECES)]
    at = [k for k, x in enumerate(pieces) if len(x)]
    size = SLOTS // SLOT_PIECES
    if at:
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([pieces[k].astype("<u4").tobytes() for k in at], pa.binary()), pa.array([counts[k * size + pieces[k]].astype("<i8").tobytes() for k in at], pa.binary())], names=["piece", "slots", "counts"])


def _sum_slots(table: pa.Table) -> pa.Table:
    sums = np.zeros(SLOTS // SLOT_PIECES, np.int64)
    for slots, counts in zip(table.column("slots").to_pylist(), table.column("counts").to_pylist(), strict=True):
        sums[np.frombuffer(slots, "<u4")] += np.frombuffer(counts, "<i8")
    return pa.table([table.column("piece")[:1], pa.array([np.minimum(sums, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], names=["piece", "counts"])


def _rare_keys(num: int, den: int, counts: np.ndarray):
    """A set's keys: its first shingles in order of their counters, for each class of partners; the last two bits are the side.  What is alone on its counter meets nothing."""
    schema = pa.schema([("node", pa.int64()), ("keys", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for b in batches:
            out = []
            for raw in b.column("hashes").to_pylist():
                hashes = np.frombuffer(raw, "<u8")
                count = counts[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((hashes, count))
                hashes, alone = mix(hashes[order]), int((count < 2).sum())
                found = [mix(hashes[alone:k] ^ mix(np.array([x << 32 | y], np.uint64))) << np.uint64(2) | np.uint64(side) for x, y, side, k in bands.rare(len(hashes)) if k > alone]
                out.append(np.concatenate(found).astype("<u8").tobytes() if found else b"")
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(out, pa.binary())], schema=schema)
        _rest()

    return run


def _deal_keys(parts: int):
    """Keys packed by part: a row per part and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("keys").to_pylist()
            key = np.frombuffer(b"".join(raw), "<u8")
            if not len(key):
                continue
            owner = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
            part = ((key >> np.uint64(2)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
            columns = [key[order].astype("<u8"), *(b.column(c).to_numpy()[owner[order]].astype("<i8") for c in ("node", "component"))]
            blobs = [pa.array([x[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(part[order][edges[:-1]], pa.int32()), *blobs], names=["part", "keys", "nodes", "components"])
        release_memory()

    return run


def _mixed(table: pa.Table) -> pa.Table:
    """(bucket, node, component) of the keys that sets of several components show, from both sides."""
    key, node, component = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<i8") for c in ("keys", "nodes", "components"))
    order = np.argsort(key, kind="stable")
    key, side, node, component = key[order] >> 2, key[order] & 3, node[order], component[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = (np.minimum.reduceat(component, starts) < np.maximum.reduceat(component, starts)) & (np.bitwise_or.reduceat(side, starts) == 3)
    kept = np.repeat(several, np.diff(np.append(starts, len(key))))
    out = pa.table([key[kept], node[kept], component[kept]], names=["bucket", "node", "component"])
    release_memory()
    return out


def _across(num: int, den: int, most: int):
    """Within a group of sets on sides 1 and 2 (or both, 3): each set's ``most`` nearest sets of the other side and of other
    components that their sketches allow, and whether there were more."""

    def run(table: pa.Table) -> pa.Table:
        node, comp, side, n = (table.column(c).to_numpy() for c in ("node", "component", "side", "n"))
        raw = table.column("sketch").to_pylist()
        width = np.array([len(x) for x in raw])
        by_width = {w: np.flatnonzero((width == w) & (side >= 2)) for w in np.unique(width).tolist()}
        stacks = {w: np.frombuffer(b"".join(raw[j] for j in js), np.uint8).reshape(-1, w) for w, js in by_width.items()}
        left, right, more = [], [], False
        for i in np.flatnonzero(side & 1):
            mine = np.frombuffer(raw[i], np.uint8)
            hits, far = [], []
            for w, js in by_width.items():
                if not len(js) or max(w, len(mine)) > 2 * min(w, len(mine)):
                    continue  # sizes that differ so much are never similar
                fits = (comp[js] != comp[i]) & ((side[js] != side[i]) | (node[js] > node[i])) & (den * np.minimum(n[js], n[i]) >= num * np.maximum(n[js], n[i]))
                if not fits.any():
                    continue
                theirs, size = stacks[w][fits], min(w, len(mine))
                if w > size:
                    theirs = theirs[:, :size] ^ theirs[:, size:]
                apart = np.bitwise_count(theirs ^ fold(mine, size)).sum(axis=1, dtype=np.int64)
                close = apart <= (n[js][fits] + n[i]) * (den - num) // (den + num)
                hits.append(js[fits][close])
                far.append(apart[close])
            found = np.concatenate(hits) if hits else np.zeros(0, np.int64)
            if len(found) > most:
                found = found[np.argsort(np.concatenate(far), kind="stable")[:most]]
                more = True
            left.append(np.minimum(node[found], node[i]))
            right.append(np.maximum(node[found], node[i]))
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0) if left else np.zeros((0, 2), np.int64)
        return pa.table([pairs[:, 0], pairs[:, 1], np.full(len(pairs), more)], names=["a", "b", "more"])

    return run


class JaccardJoin:
    """One run of the join over ``documents``."""

    def __init__(self, documents: DataFrame, words: int = SHINGLE_WORDS, num: int = 80, den: int = 100, broadcast_ids: int = BROADCAST_IDS, name_bits: int = 64, part_bytes: int = PART_BYTES):
        self.spark = documents.sparkSession
        ship_package(self.spark)
        self.documents, self.words, self.num, self.den, self.broadcast_ids = documents.select("doc_id", "text"), words, num, den, broadcast_ids
        size = self.documents.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        parts = max(n_parts(self.spark), -(-int(size) // part_bytes))
        signed = self.documents.mapInArrow(_sign(words, parts, num, den, name_bits), _SIGNED_SQL)
        found = materialize(signed.groupBy("kind", "part").applyInArrow(_bucket, _FOUND_SQL), "join-buckets")
        sets = found.where(F.col("kind") == SET).select(F.col("a").alias("doc_id"), F.col("b").alias("node"), "n", "other", "sketch")
        self.pairs = found.where(F.col("kind") == PAIR).select("a", "b")
        self.hot = found.where(F.col("kind") == HOT).select(F.col("a").alias("bucket"), F.col("b").alias("node"), "layout", "empty")
        twice = materialize(sets.where("n > 0").groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y").select("node"), "join-twice")
        if twice.limit(1).count():
            # sets of one first name: each gets a name of both, and every proposal for the one holds for all of them
            own = materialize(sets.join(twice, "node", "left_semi").select("node", "other", F.xxhash64("node", "other").alias("name")).distinct(), "join-names")
            sets = sets.join(own, ["node", "other"], "left").withColumn("node", F.coalesce("name", "node")).drop("name")
            told = lambda df, c: df.join(own.select(F.col("node").alias(c), "name"), c, "left").withColumn(c, F.coalesce("name", c)).drop("name")
            among = own.select("node", F.col("name").alias("a")).join(own.select("node", F.col("name").alias("b")), "node").where("a < b").select("a", "b")
            self.pairs = told(told(self.pairs, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(among)
            self.hot = told(self.hot, "node")
        self.sets = sets
        self.nodes = materialize(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("other").alias("other"), F.min_by("sketch", "doc_id").alias("sketch")), "join-nodes")

    def unsafe(self) -> DataFrame:
        """(node, buckets): sets with more hot blocks than their layout's slack, and the hot buckets in which they have to be compared."""
        bands = Bands(self.num, self.den)
        largest = self.hot.agg(F.max("layout")).first()[0]
        if largest is None:
            return self.hot.select("node", F.array("bucket").alias("buckets"))
        while len(bands.upper) <= largest:
            bands.band(bands.upper[-1] + 1)
        slack = F.element_at(F.array(*[F.lit(bands.slack(k)) for k in range(largest + 1)]), F.col("layout") + 1)
        each = self.hot.groupBy("node", "layout").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"), F.max("empty").alias("empty"))
        need = F.size("buckets") - F.greatest(slack - F.col("empty"), F.lit(0))
        return materialize(each.where(need > 0).select("node", F.slice("buckets", F.lit(1), need).alias("buckets")), "join-hot")

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and sketches allow."""
        side = lambda k: self.nodes.select(F.col("node").alias("ab"[k - 1]), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        return materialize(pairs.join(side(1), "a").join(side(2), "b").mapInArrow(_near_by_sketch(self.num, self.den), "a long, b long"), "join-close")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links among ``pairs``, on the texts."""
        wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.nodes.select("node", "doc_id", "other"), "node"), "join-wanted")
        ids = F.broadcast(wanted) if wanted.count() <= self.broadcast_ids else wanted
        # a repeated doc_id brings other texts along; only those of the node stay, once
        texts = self.documents.join(ids, "doc_id").select("node", "other", "text").mapInArrow(_own_texts(self.words), "node long, text string")
        texts = materialize(texts.groupBy("node").agg(F.min("text").alias("text")), "join-texts")
        side = lambda k: texts.select(F.col("node").alias("ab"[k - 1]), F.col("text").alias(f"t{k}"))
        return materialize(pairs.join(side(1), "a").join(side(2), "b").mapInArrow(_verify(self.words, self.num, self.den), "a long, b long").distinct(), "join-links")

    def rare_keys(self, hot: DataFrame, component: DataFrame) -> DataFrame:
        """(node, keys): keys of rare shingles of the sets whose hot buckets hold several components."""
        label = hot.join(component, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.explode("buckets").alias("bucket"))
        mixed = label.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
        wanted = materialize(label.join(mixed, "bucket").select("node").distinct().join(self.nodes.select("node", "doc_id", "other"), "node"), "join-several")
        ids = F.broadcast(wanted) if wanted.count() <= self.broadcast_ids else wanted
        sets = materialize(self.documents.join(ids, "doc_id").select("node", "other", "text").mapInArrow(_own_sets(self.words), "node long, hashes binary"), "join-sets")
        sums = sets.select("hashes").mapInArrow(_count_slots, "piece int, slots binary, counts binary").groupBy("piece").applyInArrow(_sum_slots, "piece int, counts binary")
        counts = np.zeros((SLOT_PIECES, SLOTS // SLOT_PIECES), "<u4")
        for r in sums.collect():  # a table of fixed size
            counts[r["piece"]] = np.frombuffer(r["counts"], "<u4")
        keys = sets.mapInArrow(_rare_keys(self.num, self.den, counts.ravel()), "node long, keys binary")
        # a repeated doc_id brings a set along once more
        return materialize(keys.groupBy("node").agg(F.min("keys").alias("keys")), "join-keys")

    def mixed(self, keys: DataFrame, component: DataFrame) -> DataFrame:
        """(bucket, node, component): the keys that sets of several components show."""
        size = keys.agg(F.sum(F.octet_length("keys")).alias("n")).first()["n"] or 0
        parts = max(n_parts(self.spark), -(-3 * int(size) // PART_BYTES))
        label = keys.join(component, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "keys")
        dealt = label.mapInArrow(_deal_keys(parts), "part int, keys binary, nodes binary, components binary")
        return materialize(dealt.groupBy("part").applyInArrow(_mixed, "bucket long, node long, component long"), "join-keyed")

    def across(self, each: DataFrame, most: int) -> DataFrame:
        """(a, b, more): pairs of sets of one key between components, each set's ``most`` nearest per chunk."""
        counted = each.groupBy("bucket", "component").agg(F.count("*").alias("m"))
        one = counted.groupBy("bucket").agg(F.max_by("component", F.struct("m", "component")).alias("one"), F.count("*").alias("k"), F.sum("m").alias("all"), F.max("m").alias("m")).where("k > 1")
        one = materialize(one.select("bucket", "one", (F.col("all") - F.col("m")).alias("others")), "join-mixed")
        others = materialize(each.join(one, "bucket").where("component <> one"), "join-others")
        # the sets beside the one, with each other: a bucket's are dealt to chunks, a group holds two of them
        sketch = self.nodes.select("node", "n", "sketch")
        rows = others.where("others > 1").withColumn("chunks", F.ceil(F.col("others") / CHUNK).cast("int"))
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int")).withColumn("with", F.explode(F.expr("sequence(0, chunks - 1)")))
        rows = rows.select("node", "component", "bucket", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"),
                           F.when(F.col("chunk") == F.col("with"), 3).when(F.col("chunk") < F.col("with"), 1).otherwise(2).cast("byte").alias("side"))
        found = rows.join(sketch, "node").groupBy("bucket", "lo", "hi").applyInArrow(_across(self.num, self.den, most), "a long, b long, more boolean")
        # with the sets of the one: both sides are dealt to chunks
        met = materialize(others.select("node", "component", "one").distinct(), "join-met")
        large = each.select("node", F.col("component").alias("one")).distinct().join(met.select("one").distinct(), "one")
        dealt = lambda rows, name: rows.groupBy("one").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
        both = materialize(dealt(large, "p").join(dealt(met, "q"), "one"), "join-chunks")
        at = lambda k: F.pmod(F.xxhash64("node"), k).cast("int")
        every = lambda k: F.explode(F.expr(f"sequence(0, {k} - 1)"))
        large = large.join(both, "one").select("node", F.col("one").alias("component"), "one", at("p").alias("x"), every("q").alias("y"), F.lit(2).cast("byte").alias("side"))
        small = met.join(both, "one").select("node", "component", "one", every("p").alias("x"), at("q").alias("y"), F.lit(1).cast("byte").alias("side"))
        beside = large.unionByName(small).join(sketch, "node").groupBy("one", "x", "y").applyInArrow(_across(self.num, self.den, most), "a long, b long, more boolean")
        return materialize(found.unionByName(beside).groupBy("a", "b").agg(F.bool_or("more").alias("more")), "join-across")

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id)."""
        hot = self.unsafe()
        first = hot.groupBy("node").agg(F.min(F.element_at("buckets", 1)).alias("bucket"), F.max(F.size("buckets")).alias("m"))
        # the set with the most hot blocks differs least from what a family has in common
        centre = first.groupBy("bucket").agg(F.max_by("node", F.struct("m", "node")).alias("centre"), F.count("*").alias("k")).where("k > 1")
        star = first.join(centre, "bucket").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        pairs = self.close(self.pairs.unionByName(star).distinct())
        # one pair per node first: most groups of near copies are joined by these
        first = pairs.groupBy(F.col("b")).agg(F.min("a").alias("a")).select("a", "b")
        links = self.verified(first)
        joined = components(links)
        rest = self._apart(pairs.join(first, ["a", "b"], "left_anti"), joined)
        links = links.unionByName(self.verified(rest))
        joined = components(links)
        keys, most = self.rare_keys(hot, joined), 4
        while True:
            found = self.across(self.mixed(keys, joined), most)
            fresh = materialize(found.select("a", "b").join(pairs, ["a", "b"], "left_anti"), "join-rest")
            if fresh.limit(1).count():
                links, pairs = materialize(links.unionByName(self.verified(fresh)), "join-links"), pairs.unionByName(fresh)
                joined = components(links)
            if not found.where("more").limit(1).count():
                return self._labelled(joined)
            most *= 32

    def _apart(self, pairs: DataFrame, component: DataFrame) -> DataFrame:
        side = lambda k: component.select(F.col("node").alias("ab"[k - 1]), F.col("component").alias(f"c{k}"))
        both = pairs.join(side(1), "a", "left").join(side(2), "b", "left")
        return materialize(both.where(F.coalesce("c1", "a") != F.coalesce("c2", "b")).select("a", "b"), "join-rest")

    def _labelled(self, component: DataFrame) -> DataFrame:
        joined = self.nodes.select("node", "doc_id").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = joined.groupBy("component").agg(F.min("doc_id").alias("least"))
        by_node = joined.join(least, "component").select("node", "least")
        out = self.sets.join(by_node, "node", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(documents: DataFrame, words: int = SHINGLE_WORDS, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the least doc_id reachable by links."""
    return JaccardJoin(documents, words, num, den).run()
