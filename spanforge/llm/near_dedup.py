"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A shingle is five words; a text of fewer words is one shingle. Its weight is its count times the mean inverse document
frequency of its words, from document counts of all texts over hashed words, in a table that grows with their number. Each
text gets BANDS x ROWS samples; texts that agree in a band meet in its bucket.

Equal texts are one node throughout, whatever their number. The hub of a bucket is the node whose buckets hold most nodes
altogether: of a text and its near copies the text itself. Each node is compared with one hub, those left apart with the
other hubs of their buckets and with a hub of the nodes outside a bucket's largest component. Nodes of buckets that aren't
one component then are searched for the rest by prefixes.
With shingles in a common order, rare ones first, two sets as alike as the threshold share one among their first, and what
follows it weighs enough in both; the pairs of a shingle are dealt by classes of the lighter set's weight, so that a
common shingle doesn't bring all its texts together. That bound is exact: every pair of a bucket is in one component, ruled
out by a bound or compared. Verification is exact, on whole texts. Classes are the components of the verified links. A pair
at the threshold shares a band with probability 0.9998, and more than half of the bands on average.

A class's id is its smallest doc_id (null if all of its rows lack one). Null texts are empty; empty texts are equal to each
other. Rows that share an id but not the text are nodes of their own. Empty input gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_staged, lean, small_batches, staged, table, text_bytes, tree_sum

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
#: Ratio of the weights at either end of a class of sets in the prefix search.
SIZE_STEP = 1.08
#: Rows of a slot from which on pairs are bounded by PARTS (a power of two) sums of weights before their texts are compared.
CROWDED, PARTS = 64, 128
#: Bounds on sums of weights are loosened by this share, so that rounding rules out no pair.
SLACK = 1e-6
#: Least and greatest size of the table of document counts, which grows with the number of texts.
BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 22
#: Bytes that are hashed together, and the longest word whose hash comes from sums over them.
PIECE, LONG_WORD = 1 << 18, 1 << 12
#: Elements that are sampled together: arrays of this length stay in the processor's cache.
AT_ONCE = 1 << 14

_U = np.uint64
#: The exponent of 1.0 in a 32-bit float, with the first 8 bits of its fraction.
_EXPONENT = 127 << 8
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(32))


@cache
def _byte_values() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, and powers of the base with their inverses modulo 2^64."""
    power = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(PIECE, base, _U)]))
    return _mix(np.arange(1, 257, dtype=_U) * _U(_BASE)), power(_BASE), power(pow(_BASE, -1, 2**64))


def _hash_piece(text: bytes) -> np.ndarray:
    """Hashes of the words of at most PIECE bytes by prefix sums of a polynomial; of words over LONG_WORD bytes by their digest."""
    value, power, inverse = _byte_values()
    a = np.frombuffer(text, np.uint8)
    space = np.ones(len(a) + 2, bool)
    space[1:-1] = _SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    prefix = np.zeros(len(a) + 1, _U)
    np.cumsum(value[a] * power[: len(a)], out=prefix[1:])
    out = (prefix[end] - prefix[start]) * inverse[start]
    for k in np.flatnonzero(end - start > LONG_WORD):
        out[k] = _digest(text[start[k] : end[k]])
    return out


def _digest(word: bytes) -> np.uint64:
    return _U(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest()))


def word_hashes(text: bytes) -> np.ndarray:
    """64 bits of each word of a text, in order. Words are what is between ASCII white space; any length of text and word."""
    if len(text) <= PIECE:
        return _hash_piece(text)
    out, held, size = [], [], 0
    for word in text.split():
        if held and (size + len(word) >= PIECE or len(word) > LONG_WORD):
            out.append(_hash_piece(b" ".join(held)))
            held, size = [], 0
        if len(word) > LONG_WORD:
            out.append(np.array([_digest(word)]))
        else:
            held.append(word)
            size += len(word) + 1
    return np.concatenate([*out, _hash_piece(b" ".join(held))])


class Shingler:
    """Weighted shingle sets."""

    def __init__(self, idf: np.ndarray | None = None, words: int = WORDS):
        self.idf, self.n = idf, words

    def buckets(self, text: bytes, size: int = BUCKETS) -> np.ndarray:
        """The distinct places of a text's words in a table of document counts."""
        return np.unique((_mix(word_hashes(text)) % _U(size)).astype(np.int64))

    def weighted(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ascending shingle hashes, weights)."""
        word = word_hashes(text)
        if not len(word):
            return word, np.zeros(0, np.float32)
        word = _mix(word)
        size = min(self.n, len(word))
        count = len(word) - size + 1
        idf = self.idf[(word % _U(len(self.idf))).astype(np.int64)]
        shingle, mean = np.zeros(count, _U), np.zeros(count)
        for k in range(size):
            shingle = shingle * _U(0x9E3779B97F4A7C15) + word[k : k + count]
            mean += idf[k : k + count]
        found, first, times = np.unique(_mix(shingle), return_index=True, return_counts=True)
        return found, (times * (mean[first] / size)).astype(np.float32)


def _gamma_quantiles(p: np.ndarray) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, by bisection."""
    low, high = np.zeros(len(p)), np.full(len(p), 64.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = -np.expm1(-middle) - middle * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


@cache
def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Gamma variates for 13 uniform bits, and logarithms of gamma variates for the leading 13 bits of a 24-bit uniform as a
    float, which are as fine near zero as elsewhere: the smallest of many variates decides."""
    plain = _gamma_quantiles((np.arange(1 << 13) + 0.5) / (1 << 13))
    fine = (((np.arange(24 << 8) + _EXPONENT) << 15) + (1 << 14)).astype(np.int32).view(np.float32)
    return plain.astype(np.float32), np.log(_gamma_quantiles(fine.astype(float) * 2.0**-24)).astype(np.float32)


def samples(shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray, number: int = BANDS * ROWS) -> np.ndarray:
    """Improved consistent weighted sampling: for each set (from its start to the next) and hash function the chosen (shingle, t), hashed.

    Two weighted sets choose equally with the probability of their weighted Jaccard similarity.
    """
    gamma, log_gamma = _gamma_tables()
    log_weight = np.log(weight)
    place = np.arange(len(shingle), dtype=np.int64)
    out = np.empty((len(starts), number), np.int64)
    seeds = _mix(np.arange(1, 2 * number + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).reshape(number, 2)
    for k in range(number):
        x = (shingle ^ seeds[k, 0]) * (seeds[k, 1] | _U(1))
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        high = (x >> _U(32)).astype(np.int32)
        x ^= x >> _U(29)
        low = x.astype(np.uint32).view(np.int32)
        r = gamma.take(low & np.int32(0x1FFF))
        beta = ((low >> np.int32(13)) & np.int32(0xFFFF)).astype(np.float32)
        beta *= np.float32(2.0**-16)
        uniform = (high & np.int32(0xFFFFFF) | np.int32(1)).astype(np.float32).view(np.int32)
        cost = log_gamma.take((uniform >> np.int32(15)) - np.int32(_EXPONENT))
        t = log_weight / r
        t += beta
        np.floor(t, out=t)
        beta -= t
        beta -= np.float32(1)
        beta *= r
        cost += beta  # log c - r (t - beta) - r
        bits = cost.view(np.int32)
        ranked = (bits ^ ((bits >> np.int32(31)) & np.int32(0x7FFFFFFF))).astype(np.int64) << 32 | place
        best = np.minimum.reduceat(ranked, starts) & 0xFFFFFFFF
        out[:, k] = _mix(shingle[best] ^ (t[best].astype(np.int64).view(_U) * _U(0xC2B2AE3D27D4EB4F))).view(np.int64)
    return out


def bands(chosen: np.ndarray) -> np.ndarray:
    """One key per band of ROWS samples."""
    keys = chosen.view(_U).reshape(len(chosen), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=_U), keys.shape[:2])
    for k in range(ROWS):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + keys[:, :, k])
    return out.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller weights over sum of larger ones; 1 for two empty sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=float))
    either = float(a[1].sum(dtype=float)) + float(b[1].sum(dtype=float)) - shared
    return shared / either if either > 0 else 1.0


def places(texts: int) -> int:
    """Size of the table of document counts: twice the texts as a power of two, which words of a natural vocabulary don't fill."""
    return min(MOST_BUCKETS, max(BUCKETS, 1 << (2 * texts).bit_length()))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log(1 + N / df) of each place in the table, over all texts of `docs` (column text)."""
    size = places(docs.count())

    @lean
    def count(batches):
        shingler, total = Shingler(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                total[shingler.buckets(text, size)] += 1
                total[size] += 1
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    total = tree_sum(docs.select("text").mapInArrow(count, "part binary"))
    if total is None:
        return np.ones(size, np.float32)
    return np.log1p(total[size] / np.maximum(1, total[:size])).astype(np.float32)


def text_key(text: Column) -> Column:
    """128 bits of a whole text; equal texts are one node."""
    return F.md5(F.coalesce(text, F.lit("")))


def _signed(idf: np.ndarray):
    @lean
    def run(batches):
        shingler = Shingler(idf)

        def flush(held):
            sizes = np.array([len(s) for _, s, _ in held])
            starts, weight = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.concatenate([w for _, _, w in held])
            keys = bands(samples(np.concatenate([s for _, s, _ in held]), weight, starts))
            total = np.add.reduceat(weight.astype(float), starts)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in held]), pa.array(total), pa.array(list(keys), pa.list_(pa.int64()))], ["key", "total", "bands"])

        for batch in batches:
            held, size = [], 0
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                shingle, weight = shingler.weighted(text)
                if len(shingle):
                    held.append((key, shingle, weight))
                    size += len(shingle)
                if size >= AT_ONCE:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    return run


def _compare(idf: np.ndarray, threshold: float):
    @lean
    def run(batches):
        shingler, unpack, last = Shingler(idf), zstandard.ZstdDecompressor(), (None, None)
        for batch in batches:
            good = []
            for centre, z, own in zip(*(batch.column(c).to_pylist() for c in ("centre", "centre_z", "z")), strict=True):
                if last[0] != centre:
                    last = centre, shingler.weighted(unpack.decompress(z))
                good.append(weighted_jaccard(last[1], shingler.weighted(unpack.decompress(own))) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("centre"), batch.column("key"), pa.array(good, pa.bool_())], ["centre", "key", "near"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([press.compress(t) for t in text_bytes(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], ["key", "doc_id", "z"])

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key string, doc_id long, z binary")


def links(docs: DataFrame, firsts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(centre, key): verified links between nodes of `docs` (columns key, doc_id, text), enough of them to join all that are
    linked through a bucket. `firsts` (key, first) has the smallest doc_id of each node."""
    idf = inverse_frequencies(docs)
    signed = docs.select("key", "text").mapInArrow(_signed(idf), "key string, total double, bands array<long>")
    nodes = staged(signed.groupBy("key").agg(F.any_value(F.struct("total", "bands")).alias("s")).select("key", "s.*"), "signatures")
    met = nodes.select("key", "total", F.posexplode("bands").alias("band", "bucket"))
    shared = met.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    at = F.collect_list(F.struct("band", "bucket")).alias("at")  # a node has BANDS of them at most
    members = met.join(shared, ["band", "bucket"]).groupBy("key").agg(F.any_value("total").alias("total"), F.sum("n").alias("degree"), at)
    members = staged(members, "members", nodes.count() // 2_000)
    drop_staged(nodes)
    number = members.count()
    # Of a node's copies the first one's text is moved: no task gets all copies.
    heads = members.select("key").join(firsts, "key").select("key", F.col("first").alias("doc_id"))
    texts = _texts(docs).alias("t").join(heads.alias("h"), (F.col("t.key") == F.col("h.key")) & F.col("t.doc_id").eqNullSafe(F.col("h.doc_id"))).select("t.key", "z")
    texts = staged(texts.groupBy("key").agg(F.any_value("z").alias("z")), "candidates", number // 2_000)
    alike = (threshold * (1 - SLACK)) * F.greatest("total", "centre_total") <= F.least("total", "centre_total")  # else one set outweighs the other

    def tested(pairs: DataFrame, most: int) -> DataFrame:
        with_texts = pairs.select("centre", "key").join(texts, "key").join(texts.select(F.col("key").alias("centre"), F.col("z").alias("centre_z")), "centre")
        return staged(with_texts.select("centre", "key", "centre_z", "z").mapInArrow(_compare(idf, threshold), "centre string, key string, near boolean"), "tested", most // 2_000)

    def hubs(rows: DataFrame) -> DataFrame:
        """Of each bucket the node that shares most with others: of a text and its near copies the text, which is nearest to all."""
        best = rows.groupBy("band", "bucket").agg(F.max(F.struct("degree", "key", "total", "root")).alias("h"))
        return best.select("band", "bucket", F.col("h.degree").alias("centre_degree"), F.col("h.key").alias("centre"), F.col("h.total").alias("centre_total"), F.col("h.root").alias("centre_root"))

    def best_hub(rows: DataFrame) -> DataFrame:
        """One pair per node: the node and the first hub of its buckets that isn't in its component."""
        met = rows.join(hubs(rows), ["band", "bucket"]).where((F.col("root") != F.col("centre_root")) & alike)
        return met.groupBy("key").agg(F.max(F.struct("centre_degree", "centre")).alias("h")).select(F.col("h.centre").alias("centre"), "key")

    alone = members.withColumn("root", F.col("key")).select("key", "total", "degree", "root", F.inline("at"))
    done = [tested(best_hub(alone), number)]

    def found() -> DataFrame:
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out.where("near").select("centre", "key")

    def apart(name: str) -> DataFrame:
        """All nodes of buckets that aren't one component: key, total, degree, root, band, bucket, and the bucket's largest component."""
        rooted = members.join(components(found()), "key", "left").select("key", "total", "degree", F.coalesce("root", "key").alias("root"), F.inline("at"))
        sizes = rooted.groupBy("band", "bucket", "root").agg(F.count("*").alias("size")).groupBy("band", "bucket")
        several = sizes.agg(F.max(F.struct("size", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1")
        return staged(rooted.join(several.select("band", "bucket", F.col("largest.root").alias("most")), ["band", "bucket"]), name, number // 2_000)

    left = apart("apart")
    if left.isEmpty():
        return found()
    # Second: the other hubs of a node's buckets, and a hub of those outside the largest component.
    others = left.join(hubs(alone), ["band", "bucket"]).where((F.col("key") != F.col("centre")) & alike).select("centre", "key").distinct()
    rooted = left.select("key", "root").distinct()
    others = others.join(rooted, "key").join(rooted.select(F.col("key").alias("centre"), F.col("root").alias("centre_root")), "centre").where("root != centre_root")
    others = others.select("centre", "key").join(done[0].select("centre", "key"), ["centre", "key"], "left_anti")
    others = others.unionByName(best_hub(left.where("root != most"))).distinct()
    done.append(tested(others, number))
    left = apart("left")
    open_nodes = staged(left.select("key", "root").distinct(), "open", number // 20_000)
    if open_nodes.isEmpty():
        return found()
    pairs = prefix_pairs(texts, open_nodes, idf, threshold)
    pairs = staged(pairs.join(done[0].unionByName(done[1]).select("centre", "key"), ["centre", "key"], "left_anti"), "pairs")
    done.append(tested(pairs, pairs.count()))
    return found()


def _rarity(idf: np.ndarray, size: int):
    @lean
    def run(batches):
        shingler, unpack, total = Shingler(idf), zstandard.ZstdDecompressor(), np.zeros(size, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = [shingler.weighted(unpack.decompress(z))[0] % _U(size) for z in batch.column(0).slice(at, 256).to_pylist()]
                place, times = np.unique(np.concatenate(own).astype(np.int64), return_counts=True)
                total[place] += times.astype(np.int32)
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    return run


def _size_class(total: np.ndarray | float) -> np.ndarray:
    return np.floor(np.log(total) / np.log(SIZE_STEP)).astype(np.int64)


def prefix(shingle: np.ndarray, weight: np.ndarray, rarity: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(shingles, weight from each on, weight of all) of the first shingles of a set, one of which any set as alike shares.

    If the first shared shingle came later, all that is shared would weigh less than `threshold` of the set. Shingles that
    no other set has, by the table of counts, are left out.
    """
    count = rarity[(shingle % _U(len(rarity))).astype(np.int64)]
    by = np.lexsort((shingle, count))
    rest = np.cumsum(weight[by][::-1].astype(float))[::-1]
    kept = (rest >= threshold * rest[0] * (1 - SLACK)) & (count[by] > 1)
    return shingle[by[kept]], rest[kept], float(rest[0])


def slots(shingle: np.ndarray, rest: np.ndarray, total: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot, whether it is asked, weight from there on, class): where a set is found as the lighter one of a pair, and where it asks
    as the heavier one. A slot is a shingle and a class of the lighter set's weight.

    With s the share threshold / (1 + threshold) of both weights that a pair has in common at least, the lighter set's first
    shared shingle has 2 s of its own weight from there on, and the heavier set's `rest` bounds the lighter one's weight by
    rest / s - total.
    """
    share = threshold / (1 + threshold)
    own = rest >= 2 * share * total * (1 - SLACK)
    lightest = _size_class(threshold * total * (1 - SLACK))
    heaviest = _size_class(np.maximum(threshold * total, np.minimum(total, rest / share - total)) * (1 + SLACK))
    number = heaviest - lightest + 1
    of = np.repeat(np.arange(len(rest)), number)
    asked = lightest + np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    classes = np.concatenate([np.full(int(own.sum()), _size_class(total)), asked])
    base = np.concatenate([shingle[own], shingle[of]])
    return _mix(base ^ _mix(classes.view(_U) * _U(0x9E3779B97F4A7C15))).view(np.int64), np.arange(len(base)) >= own.sum(), np.concatenate([rest[own], rest[of]]), classes


def _prefixes(idf: np.ndarray, rarity: np.ndarray, threshold: float):
    @lean
    def run(batches):
        shingler, unpack = Shingler(idf), zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                firsts = [prefix(*shingler.weighted(unpack.decompress(z)), rarity, threshold) for z in part.column(0).to_pylist()]
                own = [slots(*x, threshold) for x in firsts]
                of = pa.array(np.repeat(np.arange(len(own)), [len(x[0]) for x in own]))
                total = pa.array([t for _, _, t in firsts], pa.float64())
                columns = [pa.array(np.concatenate([x[k] for x in own]), t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns[:2], part.column(1).take(of), part.column(2).take(of), columns[2], total.take(of), columns[3]], ["slot", "asks", "node", "part", "rest", "total", "class"])

    return run


def parts_of(shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weight of a set in each of PARTS parts of the hash range: two sets have no more in common than the sum of the smaller ones."""
    return np.bincount((shingle >> _U(64 - PARTS.bit_length() + 1)).astype(np.int64), weight.astype(float), PARTS)


def _sketched(idf: np.ndarray):
    @lean
    def run(batches):
        shingler, unpack = Shingler(idf), zstandard.ZstdDecompressor()
        for batch in batches:
            own = [parts_of(*shingler.weighted(unpack.decompress(z))).astype(np.float32) for z in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.float32()))], ["part_of", "parts"])

    return run


def prefix_pairs(texts: DataFrame, nodes: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(centre, key): all pairs of `nodes` (key, root) of unlike root that may be as alike as `threshold`; `texts` (key, z).

    The table of shingle counts only orders the shingles, rare ones first; any order gives right results. Nodes and their
    components (column part) are numbers here: a node has hundreds of rows.
    """
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "numbered")
    numbers = nodes.join(nodes.groupBy("root").agg(F.min("node").alias("part")), "root").select("key", "node", "part")
    texts = staged(texts.join(numbers, "key").select("z", "node", "part"), "apart")
    size = 1 << min(22, max(16, (32 * texts.count()).bit_length()))
    rarity = tree_sum(texts.select("z").mapInArrow(_rarity(idf, size), "part binary"), "int32")
    firsts = staged(texts.mapInArrow(_prefixes(idf, rarity, threshold), "slot long, asks boolean, node long, part long, rest double, total double, class long"), "prefixes")
    # Nodes of a slot's largest component never meet each other.
    sizes = firsts.groupBy("slot", "part").agg(F.count("*").alias("n"), F.max("asks").alias("some"), F.min("asks").alias("all")).groupBy("slot")
    largest = sizes.agg(F.max(F.struct("n", "part")).alias("largest"), F.sum("n").alias("rows"), F.count("*").alias("parts"), F.max("some").alias("some"), F.min("all").alias("all"))
    several = staged(largest.where("parts > 1 AND some AND NOT all").select("slot", F.col("largest.part").alias("most"), (F.col("rows") >= CROWDED).alias("crowded")), "slots")
    # A pair meets at the first shingle that both have: what either has before it (few, of one class) tells.
    before = F.collect_list("slot").over(Window.partitionBy("node", "asks", "class").orderBy(F.desc("rest")).rowsBetween(Window.unboundedPreceding, -1))
    held = staged(firsts.join(several, "slot").withColumn("before", before).drop("class"), "shared")
    drop_staged(firsts)
    # Where many sets meet, what two have in common is bounded by the smaller of their weights in each part of the hash range.
    crowd = texts.join(held.where("crowded").select("node").distinct(), "node").select("node", "z")
    parts = staged(crowd.mapInArrow(_sketched(idf), "part_of long, parts array<float>"), "parts")
    held = held.join(parts, F.col("crowded") & (F.col("node") == F.col("part_of")), "left").drop("part_of", "crowded")
    asking = held.where("asks").select("slot", F.col("most").alias("other_most"), *[F.col(c).alias(f"other_{c}") for c in ("node", "part", "rest", "total", "before", "parts")])
    found, inside = held.where("NOT asks"), F.col("part") == F.col("most")
    enough = F.least("rest", "other_rest") >= (F.col("total") + F.col("other_total")) * (threshold / (1 + threshold) * (1 - SLACK))
    both = F.aggregate(F.zip_with("parts", "other_parts", lambda x, y: F.least(x, y)), F.lit(0.0), lambda a, x: a + x)
    enough &= F.coalesce(both >= (F.col("total") + F.col("other_total")) * (threshold / (1 + threshold) * (1 - 10 * SLACK)), F.lit(True))
    met = found.where(~inside).join(asking, "slot").unionByName(found.where(inside).join(asking.where("other_part != other_most"), "slot"))
    met = met.where((F.col("part") != F.col("other_part")) & enough & ~F.arrays_overlap("before", "other_before"))
    met = met.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()
    named = lambda column: nodes.select(F.col("node").alias(column), F.col("key").alias(f"key_{column}"))
    return met.join(named("a"), "a").join(named("b"), "b").select(F.least("key_a", "key_b").alias("centre"), F.greatest("key_a", "key_b").alias("key"))


def components(edges: DataFrame) -> DataFrame:
    """(key, root): each node of `edges` (centre, key) with the smallest node of its component.

    Each round takes the smallest root among the neighbours, then the root's root, so rounds grow with the logarithm of the longest path.
    """
    few = 2 * edges.count() // 100_000
    both = staged(edges.select(F.col("centre").alias("a"), F.col("key").alias("b")).union(edges.select("key", "centre")).distinct(), "links", few)
    roots = staged(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("b")).select("key", F.least("key", "b").alias("root")), "roots", few)
    while True:
        offered = both.join(roots.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("offer"))
        lower = roots.join(offered, "key").select("key", F.col("root").alias("was"), F.least("root", "offer").alias("root"))
        up = roots.select(F.col("key").alias("root"), F.col("root").alias("higher"))
        new = staged(lower.join(up, "root").select("key", "was", F.least("root", "higher").alias("root")), "roots", few)
        changed = not new.where("was != root").isEmpty()
        roots = new.select("key", "root")
        if not changed:
            return roots


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, root, class_id) of every node; `key` is text_key of the text, `root` the same for all nodes of a class."""
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    nodes = staged(keyed.groupBy("key").agg(F.min("doc_id").alias("first")), "texts")
    rooted = nodes.join(components(links(keyed, nodes, threshold)), "key", "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    rooted = staged(rooted, "nodes")
    heads = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    return rooted.join(heads, "root").select("key", "root", "first", "class_id")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    return keyed.join(classes(docs).select("key", "class_id"), "key").select("doc_id", "class_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the smallest id, columns as they were.

    Documents meet the kept ids by text and id, so that the copies of one text don't meet in one task.
    """
    own = lambda key, doc: F.concat_ws("/", key, doc.cast("long").cast("string"))
    head = classes(docs).where(F.col("first").eqNullSafe(F.col("class_id"))).groupBy("root", "class_id").agg(F.min("key").alias("head_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own(text_key(F.col("text")), F.col("doc_id")).alias("own"))
    rows = rows.join(head.select(own(F.col("head_key"), F.col("class_id")).alias("own")), "own")
    once = F.row_number().over(Window.partitionBy("own").orderBy("own"))
    return rows.withColumn("nth", once).where("nth = 1").select("row.*")
