"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that also starts earlier in the corpus.

1. Anchors. Among the GRAM-byte strings of a window of LENGTH bytes, that of smallest hash (the first, on ties) is the
   window's anchor: equal windows have equal anchors. Consecutive windows with one anchor make a region. Nothing but
   windows with equal anchors can match, so regions are dealt by anchor.
2. Regions with equal bytes: all but the earliest are repeats throughout. An anchor left with one region can't match.
3. The other regions, some thousands of bytes of each anchor, go into suffix arrays by the difference-cover algorithm:
   triples at two of three positions are sorted, equal ones get equal names, the names are sorted by recursion, the
   remaining third is sorted by first symbol and the rank behind it and merged. Neighbours in the array whose first LENGTH
   bytes agree are repeats but for the earliest.
4. Spans meet their document again, are merged and cut out.

Shuffled are hashes of regions (one per about 30 bytes, equal ones of a task merged before), bytes of regions whose anchor
has several, and compressed texts. An anchor with more than HOT regions is split into narrower ranges of windows, in rounds,
until each part is small: a passage with a million different surroundings doesn't meet in one suffix array.

Earlier means smaller doc_id, a null one being smallest, or an earlier start in the same document. Rows that share an id but
not the text are ordered by a hash of it; of rows equal in both, one counts as first. Null texts are empty. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, staged, table, text_bytes

LENGTH = 100
GRAM = 32
#: Regions of one anchor that go into one suffix array, and about how many bytes go there together.
HOT, CHUNK = 8_000, 600_000
#: Bytes that are hashed together, and regions among which a task merges equal ones.
SLAB, MERGED = 400_000, 400_000
#: Bytes of regions that are handed over together.
FETCHED = 1_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_NULL = -(2**63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Finds the regions of byte strings: anchors by rolling hash and sliding minimum, regions by prefix sums."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.windows = length, gram, length - gram + 1
        self.byte = _mixed(np.arange(1, 257, dtype=_U) * _U(_BASE))
        self.power = _powers(_BASE, 1)
        self.inverse = self.power

    def _rolling(self, a: np.ndarray) -> np.ndarray:
        h, n, power = a, 1, _BASE
        while n < self.gram:
            h = h[:-n] * _U(power) + h[n:]
            power, n = power * power % 2**64, 2 * n
        return _mixed(h)

    def regions(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, windows, anchor hash, content hash) of each region of the pieces of `buf` that end at `ends`."""
        n = len(buf)
        if n < self.length:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        if len(self.power) <= n:
            self.power = _powers(_BASE, n + 1)
            self.inverse = _powers(pow(_BASE, -1, 2**64), n + 1)
        a = self.byte[buf]
        gram = self._rolling(a)
        key = (gram & ~_U(0xFFFFFF)) | np.arange(len(gram), dtype=_U)
        width, low = 1, key
        while 2 * width <= self.windows:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: n - self.length + 1], low[self.windows - width :][: n - self.length + 1])
        anchor = (low & _U(0xFFFFFF)).astype(np.int64)
        valid = np.ones(n - self.length + 1, bool)
        for end in ends[:-1]:
            valid[max(0, end - self.length + 1) : end] = False
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        start = np.flatnonzero(new & valid)
        last = np.ones(len(anchor), bool)
        last[:-1] = new[1:] | ~valid[1:]
        windows = np.flatnonzero(last & valid) - start + 1
        p = anchor[start]
        return start, windows, gram[p].view(np.int64), self.content(a, start, windows, p)

    def content(self, a: np.ndarray, start: np.ndarray, windows: np.ndarray, p: np.ndarray) -> np.ndarray:
        prefix = np.zeros(len(a) + 1, _U)
        np.cumsum(a * self.power[: len(a)], out=prefix[1:])
        body = (prefix[start + windows + self.length - 1] - prefix[start]) * self.inverse[start]
        return _mixed(body ^ _mixed(((p - start) * 4096 + windows).astype(_U))).view(np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of whole numbers >= 1 (fewer than 2^21, values below 2^21) by the difference cover {1, 2} modulo 3."""
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    wide = np.int64(max(int(t.max()) + 1, n + 3))
    s = np.concatenate([t, np.zeros(4, np.int64)]).astype(np.int64)
    one = np.arange(1, n + (n % 3 == 1), 3)  # of length 1 modulo 3, an empty suffix parts the two halves of names
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    top = np.int64(t.max()) + 1
    triple = (s[sample] * top + s[sample + 1]) * top + s[sample + 2]
    order = np.argsort(triple, kind="stable")
    ranked = triple[order]
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]]))
    if name[order[-1]] < len(sample):
        order = suffix_array(name)
        name[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name
    order = sample[order]
    order = order[order < n]
    rest = np.arange(0, n, 3)
    by_one = s[rest] * wide + rank[rest + 1]
    by = np.argsort(by_one, kind="stable")
    rest, by_one = rest[by], by_one[by]
    ones, twos = order[order % 3 == 1], order[order % 3 == 2]
    below = np.searchsorted(s[ones] * wide + rank[ones + 1], by_one)
    # Behind a suffix at 2 modulo 3 two symbols pass before the next sampled one.
    below += np.searchsorted((s[twos] * top + s[twos + 1]) * wide + rank[twos + 2], (s[rest] * top + s[rest + 1]) * wide + rank[rest + 2])
    out = np.empty(n, np.int64)
    place = below + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = order
    return out


def repeated_starts(pieces: list[bytes], windows: np.ndarray, keys: list[np.ndarray], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(piece, first, last) ranges of starts whose string of `length` bytes also starts earlier in one of the pieces.

    Starts 0..windows-1 of each piece count; `keys` order the pieces, most significant first, then the start does.
    """
    sizes = np.array([len(x) for x in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.frombuffer(b"\0".join(pieces) + b"\0" * 8, np.uint8)
    symbols = raw[: begin[-1]].astype(np.int64) + 1
    symbols[begin[1:] - 1] = 257 + np.arange(len(pieces))  # each piece ends in a symbol of its own
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    asked = np.arange(begin[-1]) - begin[owner] < windows[owner]
    order = suffix_array(symbols)
    order = order[asked[order]]
    word = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,))
    same = np.arange(len(order) - 1)
    for at in [*range(0, length - 7, 8), length - 8]:
        same = same[word[order[same] + at] == word[order[same + 1] + at]]
    if not len(same):
        return []
    member = np.zeros(len(order), bool)
    member[same] = member[same + 1] = True
    joined = np.zeros(len(order), bool)
    joined[same + 1] = True
    run = np.cumsum(~joined)[member]
    at = order[member]
    own = owner[at]
    by = np.lexsort((at - begin[own], *(k[own] for k in reversed(keys)), run))
    later = np.ones(len(by), bool)
    later[0] = False
    later[1:] = run[by][1:] == run[by][:-1]
    found = np.sort(at[by[later]])
    first = np.flatnonzero(np.diff(found, prepend=-9) != 1)
    last = np.append(first[1:], len(found)) - 1
    own = owner[found[first]]
    return list(zip(own.tolist(), (found[first] - begin[own]).tolist(), (found[last] - begin[own]).tolist(), strict=True))


#: at: start * 256 + windows. kind 0: windows that are repeats; 1: a region to be settled under `anchor`.
_ROWS = "kind int, anchor long, content long, doc long, tie long, at long"
_NAMES = ["kind", "anchor", "content", "doc", "tie", "at"]
_TYPES = [pa.int32(), *[pa.int64()] * 5]


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(columns[-1]), kind, np.int32), *columns]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def merge_equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (anchor, content, doc, tie, at) with equal first two columns keeps the earliest; returns (kept, the others)."""
    key = rows[:, 0] ^ rows[:, 1] * np.int64(0x5851F42D4C957F2D)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    again = np.zeros(len(rows), bool)
    again[1:] = ranked[1:] == ranked[:-1]
    again[:-1] |= again[1:]
    some = rows[order[again]]
    some = some[np.lexsort(some.T[::-1])]
    later = np.zeros(len(some), bool)
    later[1:] = (some[1:, :2] == some[:-1, :2]).all(axis=1)
    return np.concatenate([rows[order[~again]], some[~later]]), some[later]


def _pieces(batches, slab: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Texts joined into buffers of about `slab` bytes; longer ones in overlapping slabs. Yields buffer, ends, (doc, tie, offset)."""
    held, whose, size = [], [], 0
    for batch in batches:
        for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
            for at in range(0, max(0, len(text) - length + 1), slab):
                piece = text[at : at + slab + length - 1]
                held.append(piece)
                whose.append((doc, tie, at))
                size += len(piece)
                if size >= slab:
                    yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), whose
                    held, whose, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), whose


@lean
def _hash_regions(batches):
    hasher, kept, count = Hasher(), [], 0

    def flush():
        first, later = merge_equal(np.concatenate(kept))
        yield _rows(1, *first.T)
        if len(later):
            yield _rows(0, _mixed(later[:, 2].view(_U)).view(np.int64), later[:, 4], *later.T[2:])

    for buf, ends, whose in _pieces(batches, SLAB, LENGTH):
        start, windows, anchor, content = hasher.regions(buf, ends)
        piece = np.searchsorted(ends, start, side="right")
        doc, tie, offset = np.array(whose, np.int64).reshape(-1, 3)[piece].T
        begin = np.concatenate([[0], ends[:-1]])[piece]
        kept.append(np.stack([anchor, content, doc, tie, (start - begin + offset) * 256 + windows], axis=1))
        count += len(start)
        if count >= MERGED:
            yield from flush()
            kept, count = [], 0
    if count:
        yield from flush()


def _settle(with_bytes: bool):
    """Streams rows sorted by anchor, content, doc, tie, at: later equal regions are repeats; anchors of one region end here."""
    names = [*_NAMES, "bytes"] if with_bytes else _NAMES
    types = [*_TYPES, pa.binary()] if with_bytes else _TYPES

    def run(batches):
        held = None  # the last row that began a new region, as a batch of one, and whether its anchor has others
        shared = False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kind, anchor, content = (batch.column(k).to_numpy() for k in range(3))
            prior = held.column(1)[0].as_py() if held is not None else None
            prior_content = held.column(2)[0].as_py() if held is not None else None
            same_anchor, same_content = np.empty(n, bool), np.empty(n, bool)
            same_anchor[0], same_content[0] = anchor[0] == prior, content[0] == prior_content
            same_anchor[1:], same_content[1:] = anchor[1:] == anchor[:-1], content[1:] == content[:-1]
            settled = kind == 0
            repeat = ~settled & same_anchor & same_content
            # Repeats that were settled before stand under random anchors of their own; they neither begin nor join a region.
            first = np.flatnonzero(~repeat & ~settled)
            joins = np.zeros(n, bool)
            joins[first] = same_anchor[first]
            keep = np.zeros(n, bool)
            keep[first] = joins[first]
            if len(first):
                keep[first[:-1]] |= joins[first[1:]]
                if held is not None and joins[first[0]] and not shared:
                    yield pa.RecordBatch.from_arrays(held.columns, names)
            done = settled | repeat
            if done.any():
                rows = batch.filter(pa.array(done))
                columns = [pa.array(np.zeros(rows.num_rows, np.int32)), *rows.columns[1:6]]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(rows.num_rows, pa.binary())] if with_bytes else columns, names)
            if keep.any():
                rows = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(rows.columns, types, strict=True)], names)
            if len(first):
                held, shared = batch.slice(int(first[-1]), 1), bool(keep[first[-1]])

    return run


def settle(rows: DataFrame, with_bytes: bool = False) -> DataFrame:
    order = ["anchor", "content", "doc", "tie", "at"]
    schema = _ROWS + ", bytes binary" * with_bytes
    return rows.repartition("anchor").sortWithinPartitions(*order).mapInArrow(_settle(with_bytes), schema)


def packed_texts(docs: DataFrame, text_col: str, id_col: str, tied: bool) -> DataFrame:
    """(doc_id, doc, tie, z): texts as UTF-8, compressed, so that moving them costs little."""
    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [press.compress(t) for t in text_bytes(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], ["doc_id", "doc", "tie", "z"])

    return _keyed(docs, text_col, id_col, tied).select("doc_id", "doc", "tie", "text").mapInArrow(pack, "doc_id long, doc long, tie long, z binary")


def _keyed(docs: DataFrame, text_col: str, id_col: str, tied: bool) -> DataFrame:
    text = F.col(text_col)
    tie = F.xxhash64(F.coalesce(text, F.lit(""))) if tied else F.lit(0).cast("long")
    doc = F.col(id_col).cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(_NULL)).alias("doc"), tie.alias("tie"), text.alias("text"))


@lean
def _fetch(batches):
    """Bytes of the regions asked for, from (anchor, doc, tie, ats, z), some FETCHED bytes at a time."""
    def flush(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), [*_TYPES, pa.binary()], strict=True)], [*_NAMES, "bytes"])

    unpack, held, size = zstandard.ZstdDecompressor(), [], 0
    for batch in batches:
        for anchors, doc, tie, ats, z in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            text = unpack.decompress(z)
            for anchor, at in zip(anchors, ats, strict=True):
                held.append((1, anchor, 0, doc, tie, at, text[at >> 8 : (at >> 8) + (at & 255) + LENGTH - 1]))
                size += len(held[-1][6])
                if size >= FETCHED:
                    yield flush(held)
                    held, size = [], 0
    if held:
        yield flush(held)


def _narrow(cell: int):
    """Cuts regions where the distance from window to anchor passes a multiple of `cell`; a part's key is the anchor, the
    cell, and the bytes that all windows of the cell share, which windows must have in common to be equal."""
    def run(batches):
        for batch in batches:
            out = []
            for anchor, doc, tie, at, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "tie", "at", "bytes")), strict=True):
                start, far = at >> 8, _anchor_offset(body)
                near = far - (at & 255) + 1  # the first window is farthest from the anchor
                for low in range(near // cell * cell, far + 1, cell):
                    most, least = min(far, low + cell - 1), max(near, low)
                    first, number = far - most, most - least + 1
                    own = body[first : first + number + LENGTH - 1]
                    core = body[far - low : far - low - cell + 1 + LENGTH]
                    new = hashlib.blake2b(core + low.to_bytes(2), digest_size=8, key=(anchor & 2**64 - 1).to_bytes(8)).digest()
                    content = hashlib.blake2b(own, digest_size=8).digest()
                    out.append((1, int.from_bytes(new, signed=True), int.from_bytes(content, signed=True), doc, tie, (start + first) * 256 + number, own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*_TYPES, pa.binary()], strict=True)], [*_NAMES, "bytes"])

    return run


def _anchor_offset(body: bytes) -> int:
    """Where in the region the anchor of its first window is."""
    hasher = Hasher()
    gram = hasher._rolling(hasher.byte[np.frombuffer(body[:LENGTH], np.uint8)])
    return int(((gram & ~_U(0xFFFFFF)) | np.arange(len(gram), dtype=_U)).argmin())


@lean
def _sort_suffixes(batches):
    """Suffix arrays over the regions of whole anchors, in chunks; rows come sorted by anchor."""
    def solve(rows):
        anchors, docs, ties, ats, bodies = zip(*rows, strict=True)
        at = np.array(ats, np.int64)
        keys = [np.array(docs, np.int64), np.array(ties, np.int64), at >> 8]
        found = repeated_starts(list(bodies), at & 255, keys)
        return [(0, 0, 0, docs[k], ties[k], ((ats[k] >> 8) + first) * 256 + last - first + 1) for k, first, last in found]

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "tie", "at", "bytes")), strict=True):
            if size >= CHUNK and row[0] != held[-1][0]:
                if out := solve(held):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held and (out := solve(held)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)


def repeats(docs: DataFrame, texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, tie, at): ranges of windows (start * 256 + number) that also start earlier, from keyed `docs` and their packed texts."""
    rows = staged(settle(docs.select("doc", "tie", "text").mapInArrow(_hash_regions, _ROWS)), "regions")
    spans = [rows.where("kind = 0")]
    asked = rows.where("kind = 1").groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "at")).alias("r"))
    wide = asked.join(texts, ["doc", "tie"]).select("r.anchor", "doc", "tie", "r.at", "z").mapInArrow(_fetch, _ROWS + ", bytes binary")
    wide = staged(wide, "region-bytes")
    for cell in (64, 32, 16, 8, 4, 2, 1):  # with cells of one window a key means one string, of which one region stays
        large = wide.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot)
        large = staged(large.select("anchor"), "hot-anchors")
        if large.isEmpty():
            break
        parts = staged(settle(wide.join(large, "anchor", "left_semi").mapInArrow(_narrow(cell), _ROWS + ", bytes binary"), True), "narrow")
        spans.append(parts.where("kind = 0").drop("bytes"))
        wide = staged(wide.join(large, "anchor", "left_anti").unionByName(parts.where("kind = 1")), "region-bytes")
    spans.append(wide.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_suffixes, _ROWS))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out.select("doc", "tie", "at")


def cut(text: bytes, ats, length: int = LENGTH) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left) of a text whose windows `ats` are repeats."""
    if ats is None or not len(ats):
        return 0, 0, text
    at = np.sort(np.array(ats, np.int64))
    start, end = at >> 8, (at >> 8) + (at & 255) + length - 1
    end = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    low, high = start[first].tolist(), end[np.append(first[1:], len(at)) - 1].tolist()
    kept = b"".join(text[a:b] for a, b in zip([0, *high], [*low, len(text)], strict=True))
    return len(text) - len(kept), len(low), kept


SCHEMA = "doc_id long, doc long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, with `with_text` also the bytes left (`kept`)."""
    small_batches(docs.sparkSession)
    tied = bool(docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").head(1))
    texts = packed_texts(docs, text_col, id_col, tied)
    spans = repeats(_keyed(docs, text_col, id_col, tied), texts, hot).groupBy("doc", "tie").agg(F.collect_list("at").alias("ats"))

    def apply(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, doc, tie, z, ats in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                text = unpack.decompress(z)
                removed, runs, kept = cut(text, ats)
                rows.append((doc_id, doc, tie, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 6, pa.string(), pa.binary()], strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    found = texts.join(spans, ["doc", "tie"], "left").select("doc_id", "doc", "tie", "z", "ats").mapInArrow(apply, SCHEMA)
    if tied:  # rows equal in id and text: all but one are copies throughout
        nth = F.row_number().over(Window.partitionBy("doc", "tie").orderBy("n_bytes"))
        copy = (F.col("nth") > 1) & (F.col("n_bytes") >= LENGTH)
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        found = found.withColumn("nth", nth).select(
            "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
            F.when(copy, empty).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: `docs` with the text that is left and its length; a character cut in two goes. Rows without repeats stay as they are.

    The columns beside the text meet the texts left by doc_id and a hash of the text, so rows that share an id keep their own.
    """
    small_batches(spark)
    tied = bool(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").head(1))
    texts = packed_texts(docs, "text", "doc_id", tied)
    keyed = _keyed(docs, "text", "doc_id", tied)
    spans = repeats(keyed, texts).groupBy("doc", "tie").agg(F.collect_list("at").alias("repeat_ats"))
    tie = F.xxhash64(F.coalesce("text", F.lit(""))) if tied else F.lit(0).cast("long")
    rows = docs.withColumns({"repeat_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)), "repeat_tie": tie})
    spans = spans.withColumnsRenamed({"doc": "repeat_doc", "tie": "repeat_tie"})
    rows = rows.join(spans, ["repeat_doc", "repeat_tie"], "left")
    if tied:
        nth = F.row_number().over(Window.partitionBy("repeat_doc", "repeat_tie").orderBy(F.length("text")))
        whole = F.array(F.lit(0).cast("long"))  # stands for: the whole text
        copy = (F.col("repeat_nth") > 1) & (F.octet_length("text") >= LENGTH)
        rows = rows.withColumn("repeat_nth", nth).withColumn("repeat_ats", F.when(copy, whole).otherwise(F.col("repeat_ats")))

    @F.pandas_udf("string")
    def left(text: pd.Series, ats: pd.Series) -> pd.Series:
        def one(t, found):
            if t is None or found is None:
                return t
            return "" if len(found) == 1 and not found[0] else cut(t.encode("utf-8", "replace"), found)[2].decode("utf-8", "ignore")

        return pd.Series([one(t, f) for t, f in zip(text, ats, strict=True)], dtype=object)

    text = F.when(F.col("repeat_ats").isNull(), F.col("text")).otherwise(left("text", "repeat_ats"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("repeat_ats").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
