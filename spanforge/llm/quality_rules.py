"""Quality rules: a base filter, then a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of words of every text are hashed into buckets, whose number grows with the corpus. The raw multinomial
counts all documents; the trusted one counts all documents that `labels` marks as good, but for one in CALIBRATION, by a
hash of the id. A document's score is the mean over its n-grams of log p_trusted - log p_raw. The good documents that were
left out set the threshold: below their median by SPREADS times the distance from the median to their highest tenth, the
side that rare languages don't stretch. So it moves with how trusted text scores in this corpus, not with the share of bad
documents.

Null and empty texts have no words, so the base rule fails them. Repeated rows get a row each; a null id is never trusted.
Without trusted documents both multinomials are the raw one, and without good ones left out there is no threshold: then
only the base rule decides. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_bytes, tree_sum

#: Least and greatest number of buckets.
BUCKETS, MOST_BUCKETS = 1 << 15, 1 << 21
#: One of so many documents marked good is left out of the trusted counts and helps to set the threshold.
CALIBRATION = 4
SPREADS = 4.5
#: Ids of good documents that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Scores are sorted into bins of this width, so many, around zero.
BIN, BINS = 1e-4, 200_000
#: Scores are compared after rounding to this many decimals, so that the order of a sum can't turn a verdict.
DECIMALS = 9
#: N-grams added to the trusted count of a bucket and to the count expected of it, so that few n-grams say little.
PSEUDO = 8
_SYMBOLS = b"#*$%&|<>"


def _word_ids(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    seen: dict[bytes, int] = {}
    add = seen.setdefault
    return np.fromiter((add(w, len(seen)) for w in words), np.int64, len(words)), seen


def _buckets(ids: np.ndarray, seen: dict[bytes, int], buckets: int) -> np.ndarray:
    """The buckets of all words and all pairs of neighbouring words."""
    word = np.fromiter(map(zlib.crc32, seen), np.uint64, len(seen))[ids] if len(seen) else np.zeros(0, np.uint64)
    pair = (word[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (word[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = np.concatenate([word * np.uint64(0xD6E8FEB86659FD93), pair * np.uint64(0xFF51AFD7ED558CCD)])
    return (mixed >> np.uint64(33)).astype(np.int64) % buckets


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in windows of three that are found twice or more in the text, the first finding included."""
    if len(ids) < 4:
        return 0
    if distinct < 1 << 21:
        key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
        key = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measure(text: bytes, buckets: int = BUCKETS) -> tuple[tuple[int, ...], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the buckets of the n-grams."""
    words = text.split()  # bytes split at 0x20 and 0x09-0x0D, as the word pattern does
    ids, seen = _word_ids(words)
    joined = b"".join(words)
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    return (len(words), chars, symbols, duplicate_lines(text), repeated_words(ids, len(seen))), _buckets(ids, seen, buckets)


def buckets_for(texts: int) -> int:
    """A power of two that grows with the number of texts."""
    return min(MOST_BUCKETS, max(BUCKETS, 1 << texts.bit_length()))


def counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Raw and trusted bucket counts over all of `docs` (columns text, trusted): 2 x buckets."""
    def count(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            texts, trusted = text_bytes(batch.column(0)), batch.column(1).to_pylist()
            for of in (0, 1):
                if own := [_buckets(*_word_ids(t.split()), buckets) for t, good in zip(texts, trusted, strict=True) if good or not of]:
                    total[of] += np.bincount(np.concatenate(own), minlength=buckets)
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    found = tree_sum(docs.select("text", "trusted").mapInArrow(count, "part binary"))
    return np.zeros((2, buckets), np.int64) if found is None else found.reshape(2, buckets)


def log_ratio(count: np.ndarray, pseudo: float = PSEUDO) -> np.ndarray:
    """log p_trusted - log p_raw of each bucket, over the same scale: the trusted count against the count that the raw
    multinomial expects of as many n-grams, both smoothed by `pseudo`; zeros without trusted n-grams."""
    if not count[1].sum():
        return np.zeros(count.shape[1])
    expected = count[0] * (count[1].sum() / count[0].sum())
    return np.log(count[1] + pseudo) - np.log(expected + pseudo)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Base figures, score and verdict of every document."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.bool_()]

    def score(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                base, own = measure(text, len(ratio))
                failed = base_failed(base)
                mean = mean_ratio(ratio, own)
                rows.append((doc, *base, failed, mean, not failed and mean >= threshold))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(score, SCHEMA)


def base_failed(base: tuple[int, ...]) -> bool:
    return base[0] < 50 or 100 * base[4] > 50 * base[0]


def mean_ratio(ratio: np.ndarray, own: np.ndarray) -> float:
    return round(float(ratio[own].mean()), DECIMALS) if len(own) else 0.0


def lower_bound(bins: np.ndarray, spreads: float = SPREADS) -> float:
    """The threshold that a histogram of scores sets; minus infinity if it is empty."""
    if not bins.sum():
        return -np.inf
    upto = np.cumsum(bins)
    at = lambda share: (int(np.searchsorted(upto, share * upto[-1])) - BINS // 2) * BIN
    return at(0.5) - spreads * max(BIN, at(0.9) - at(0.5))


def calibrated(good: DataFrame, ratio: np.ndarray, spreads: float = SPREADS) -> float:
    """The threshold from the scores of the texts in `good` (column text) that pass the base rule."""
    def bin_scores(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                base, own = measure(text, len(ratio))
                if not base_failed(base):
                    total[min(BINS - 1, max(0, int(np.floor(mean_ratio(ratio, own) / BIN)) + BINS // 2))] += 1
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    found = tree_sum(good.select("text").mapInArrow(bin_scores, "part binary"))
    return -np.inf if found is None else lower_bound(found, spreads)


def marked_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` as (text, trusted, left_out): whether labels.quality marks the id as good and it is counted, or sets the threshold.

    An id that is labelled both ways isn't good.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("good_id")).agg(F.min("quality").alias("q")).where("q = 1").select("good_id")
    ids = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id") == F.col("good_id"), "left")
    out = F.pmod(F.xxhash64("good_id"), F.lit(CALIBRATION)) == 0
    return rows.select("text", (F.col("good_id").isNotNull() & ~out).alias("trusted"), (F.col("good_id").isNotNull() & out).alias("left_out"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    marked = marked_good(docs, table(spark, sf_dir, "labels"))
    ratio = log_ratio(counts(marked, buckets_for(docs.count())))
    return judge(docs, ratio, calibrated(marked.where("left_out"), ratio))
