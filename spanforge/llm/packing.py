"""Best-fit packing of token sequences.

Best-fit decreasing depends on lengths alone, and lengths are whole numbers up to the capacity. So the executors tokenise
and count pieces by length; the driver runs best-fit decreasing over that histogram, in which a run of equal documents
meets a run of equal bins in one step, and finds the tightest open bin with a segment tree over remaining capacities; the
executors then look up the bin of the k-th piece of a length. The plan is bounded by the capacity, whatever the input.

Null texts are empty; every document ends with the separator, so an empty one is one token. Repeated rows are packed once
each. Empty input: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import defaultdict, deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordIds, lean, small_batches, staged, table, task_id, text_slices

CAPACITY = 2048
#: Words whose ids a task remembers at once.
CACHE_WORDS = 300_000

#: Below this code point the word pattern is spelt out, and letters stay below it in lower case; texts with any other character
#: go to the tokenizer whole.
_PLAIN = 0x180


def _classes() -> re.Pattern:
    chars = [chr(k) for k in range(_PLAIN)]
    letters = "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "L")
    digits = "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "N")
    return re.compile(rf"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digits}]|[^\s\x1c-\x1f{letters}{digits}]+")


class WordTokenizer:
    """The ids of `tokenizers` for a word-end BPE file, with each distinct word merged once per task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for piece, k in vocabulary.items() if piece.endswith("</w>")]] = True
        self.words = WordIds(self._word_ids, CACHE_WORDS)
        self.runs = WordIds(self._run_ids, CACHE_WORDS, pc.utf8_split_whitespace)  # no word holds white space
        self.split = _classes().findall
        self.odd = re.compile(r"[^\x00-\x1b\x20-\x84\x86-įı-ſ]|<\|").search

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words in one text, a blank between them: merges stay within a word, whose last token is marked as such."""
        (joined,) = self._ids([" ".join(words)])
        ends = np.flatnonzero(self.last[joined]) + 1
        if len(ends) == len(words) and ends[-1] == len(joined):
            return joined, np.diff(ends, prepend=0)
        found = self._ids(words)
        return np.concatenate(found), np.array([len(x) for x in found])

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._joined_ids(words[at : at + 1000]) for at in range(0, len(words), 1000)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def _run_ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs without white space, from those of their words."""
        ids, cut = self.words([" ".join(self.split(run)) or None for run in runs])
        return ids, np.diff(cut)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        return [x for part in text_slices(texts) for x in self._encode(part)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        odd = [self.odd(t) is not None for t in texts]
        whole = iter(self._ids([t for t, own in zip(texts, odd, strict=True) if own]))
        ids, cut = self.runs([None if own else t.lower() for t, own in zip(texts, odd, strict=True)])
        return [(next(whole) if own else ids[a:b]).tobytes() for own, a, b in zip(odd, cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that its tasks share the words."""
    return WordTokenizer(path)


class CapacityTree:
    """A segment tree over remaining capacities 0..n that counts open bins; finds the smallest capacity >= x with one."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += bins
            k >>= 1

    def tightest(self, least: int) -> int | None:
        k = least + self.size
        if self.count[k]:
            return least
        while k > 1:  # up to the first right sibling that holds a bin, then down its left edge
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """Best-fit decreasing over `histogram` (length to count).

    Returns for each length rows (rank, bin, per_bin, offset): pieces of that length from `rank` on go to `bin` onward,
    `per_bin` to each, the first at `offset`. Equal to placing the documents one by one, longest first, each into the
    tightest open bin: pieces of one length fill a bin for as long as they fit, since it stays the tightest.
    """
    tree, open_bins, plan, bins = CapacityTree(capacity), defaultdict(deque), defaultdict(list), 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                need = -(-left // (room // length))
                open_bins[room].append((bins, bins + need))
                tree.add(room, need)
                bins += need
            low, high = open_bins[room].popleft()
            per = room // length
            full = min(high - low, left // per)
            used = [(full, per)] if full else []
            if full < high - low and left - full * per:
                used.append((1, min(per, left - full * per)))
            for number, each in used:
                plan[length].append((rank, low, each, capacity - room))
                rest = room - each * length
                open_bins[rest].append((low, low + number))
                tree.add(rest, number)
                low, rank, left = low + number, rank + number * each, left - number * each
            tree.add(room, -sum(n for n, _ in used))
            if low < high:
                open_bins[room].appendleft((low, high))
    return {length: np.array(rows, np.int64) for length, rows in plan.items()}


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, separator: int = 0, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Tokenises and cuts: one row per piece, with the number it has among its task's pieces of equal length."""
    @lean
    def cut(batches):
        tokenizer, seen, task = word_tokenizer(tokenizer_path), defaultdict(int), task_id()
        end = np.array([separator], "<u4").tobytes()
        for batch in batches:
            rows = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, encoded in zip(ids, tokenizer.encode([t or "" for t in texts]), strict=True):
                encoded += end
                for piece, at in enumerate(range(0, len(encoded), 4 * capacity)):
                    own = encoded[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(own), task, seen[n]))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, tokenizer_path: str, separator: int = 0, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every piece with its sequence_id and its offset there; sequences hold at most `capacity` tokens and have no gaps."""
    cut = staged(pieces(docs, tokenizer_path, separator, capacity, text_col, id_col), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # `capacity` rows at most
    plan = best_fit_plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @lean
    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                runs, k = plan[int(length[own[0]])], rank[own]
                run = runs[np.searchsorted(runs[:, 0], k, side="right") - 1]
                nth = k - run[:, 0]
                sequence[own] = run[:, 1] + nth // run[:, 2]
                offset[own] = run[:, 3] + nth % run[:, 2] * length[own]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return pack(table(spark, sf_dir, "documents") if docs is None else docs, public_tokenizers.path("word_bpe_49k.json"))
