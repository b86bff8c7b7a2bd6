"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Each block of vectors posts its rows in one inverted file per
pivot, with the place that the pivot has in the row's order. A query reads the files of its own nearest pivots, which sums
up the footrule distance of the two orders, takes the best share of the block and ranks it by the true cosine. An exact check
follows: of the rest it ranks those rows that neither the triangle inequality of angles to GUARDS pivots nor the cosine in
single precision puts farther off than the k-th found, so what the share leaves out is no nearer.

Vectors and queries are dealt into blocks by a hash of their id, so equal vectors spread evenly and a task holds two blocks,
whatever the input. A block's pivots are the only fitted part: of four times PIVOTS of its rows PIVOTS that lie far from each
other, however narrow the cone they are in.

Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors are compared with those of
their own length. They are scaled by a power of two, so that squares neither overflow nor vanish. A row that repeats an id
and its vector counts once; an id with several vectors has a result for each as a query and stands for each as a candidate,
and a query's candidates never have its own id. Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

PIVOTS = 512
#: How many of its nearest pivots represent a vector.
PREFIX = 96
#: Share of a block that the footrule distance leaves for the true measure.
SHARE = 0.1
BLOCK = 16_384
#: Pivots whose angles bound the rows beyond the share, and what the bounds are loosened by against rounding: radians, and
#: the cosine of unit vectors in single precision.
GUARDS, SLACK, SINGLE = 32, 1e-6, 1e-4

_U = np.uint64


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component between a half and one; all other bits stay."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _order(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's `prefix` nearest pivots, nearest first."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix]


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def spread(unit: np.ndarray, number: int) -> np.ndarray:
    """`number` of the vectors, each the farthest from those before it; fewer only if the others equal one of them."""
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < number and near.min() < 1 - 1e-12:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def seeds(ids: np.ndarray, number: int) -> np.ndarray:
    """The places of `number` rows by a hash of their ids."""
    mixed = (ids.astype(np.int64).view(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    return np.argsort(mixed ^ (mixed >> _U(29)), kind="stable")[:number]


class PermutationBlock:
    """The inverted files of one block; rows must be scaled and ascend by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: int = PIVOTS, prefix: int = PREFIX):
        self.ids, self.x, self.norm = ids, x, np.sqrt((x * x).sum(axis=1))
        unit = _unit(x)
        self.pivots = spread(unit[seeds(ids, 4 * pivots)], pivots)
        self.prefix = min(prefix, len(self.pivots))
        self.single = unit.astype(np.float32)
        self.angles = _angles(unit, self.pivots[:GUARDS])
        order = _order(unit, self.pivots, self.prefix)
        rows, place = np.divmod(np.arange(order.size), self.prefix)
        by = np.argsort(order.ravel(), kind="stable")
        cut = np.searchsorted(order.ravel()[by], np.arange(len(self.pivots) + 1))
        self.files = [(rows[by[a:b]], place[by[a:b]]) for a, b in zip(cut, cut[1:], strict=False)]

    def by_footrule(self, query_id: int, q: np.ndarray, most: int) -> np.ndarray:
        """The rows of the `most` least footrule distances, the query's own id aside."""
        agreed = np.zeros(len(self.ids))  # prefix minus the displacement, summed: the footrule distance from the other end
        for place, pivot in enumerate(_order(_unit(q[None, :]), self.pivots, self.prefix)[0]):
            rows, at = self.files[pivot]
            agreed[rows] += self.prefix - np.abs(at - place)
        others = np.flatnonzero(self.ids != query_id)
        if most >= len(others):
            return others
        own = agreed[others]
        bar = np.partition(own, len(own) - most)[len(own) - most]
        above = np.flatnonzero(own > bar)
        return others[np.concatenate([above, np.flatnonzero(own == bar)[: most - len(above)]])]

    def search(self, query_id: int, q: np.ndarray, k: int, share: float = SHARE, check: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest, the query's own id aside: first among the best rows by footrule distance, then,
        with `check`, among those that the bounds don't rule out."""
        found = self.by_footrule(query_id, q, max(k, int(share * len(self.ids))))
        cosine = self._cosines(found, q)
        rest = self.ids != query_id
        rest[found] = False
        if check and rest.any() and len(cosine) >= k:
            unit = _unit(q[None, :])
            least = np.partition(cosine, len(cosine) - k)[len(cosine) - k]
            rest &= np.abs(self.angles - _angles(unit, self.pivots[:GUARDS])).max(axis=1) <= np.arccos(np.clip(least, -1, 1)) + SLACK
            rest &= self.single @ unit[0].astype(np.float32) >= least - SINGLE
            more = np.flatnonzero(rest)
            found, cosine = np.concatenate([found, more]), np.concatenate([cosine, self._cosines(more, q)])
        top = np.lexsort((self.ids[found], -cosine))[:k]
        return self.ids[found[top]], cosine[top]

    def _cosines(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (self.x[rows] * q).sum(axis=1) / (self.norm[rows] * np.sqrt((q * q).sum()))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors of doubles that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, scaled vectors, which vector of its id) of the distinct rows, by id and then by components."""
    ids = t.column("vec_id").to_numpy()
    x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    by = np.argsort(ids, kind="stable")
    if (ids[by][1:] == ids[by][:-1]).any():
        by = np.lexsort((*x.T[::-1], ids))
        new = np.concatenate([[True], (ids[by][1:] != ids[by][:-1]) | (x[by][1:] != x[by][:-1]).any(axis=1)])
        by = by[new]
    ids = ids[by]
    return ids, scaled(x[by]), np.arange(len(ids)) - np.searchsorted(ids, ids)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """The k nearest of each row for which `is_query` (over vec_id and v) holds: query_id, rank, vec_id, score."""
    rows = staged(usable(vectors, id_col, vector_col).withColumns({"d": F.size("v"), "q": F.coalesce(is_query, F.lit(False))}), "vectors")
    # m different lengths need m * m / 2 components in the corpus: this table is small.
    blocks = rows.groupBy("d").agg(F.ceil(F.count("*") / block).cast("int").alias("across"), F.ceil(F.count_if("q") / block).cast("int").alias("down")).where("down > 0")
    rows = rows.join(F.broadcast(blocks), "d")
    deal = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.select("vec_id", "v", "d", deal(1, "across").alias("a"), every("down").alias("b"))
    right = rows.where("q").select("vec_id", "v", "d", every("across").alias("a"), deal(2, "down").alias("b"))
    right = right.toDF(*right.columns)  # columns of its own beside `left`

    def match(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if len(own) and len(asked):
            ids, x, _ = _matrix(own)
            index = PermutationBlock(ids, x, pivots, prefix)
            for query_id, q, nth in zip(*_matrix(asked), strict=True):
                found, cosine = index.search(query_id, q, k, share)
                for column, values in zip(out, (np.full(len(found), query_id), np.full(len(found), nth), found, cosine), strict=True):
                    column.append(values)
        flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "nth": pa.array(flat[1].astype(np.int64)), "d": pa.array(np.full(len(flat[0]), x.shape[1] if len(flat[0]) else 0, np.int32)), "vec_id": pa.array(flat[2].astype(np.int64)), "score": pa.array(flat[3].astype(float))})

    near = left.groupBy("d", "a", "b").cogroup(right.groupBy("d", "a", "b")).applyInArrow(match, "query_id long, nth long, d int, vec_id long, score double")
    # Results of one block each meet per query: k rows from a block.
    rank = F.row_number().over(Window.partitionBy("query_id", "nth", "d").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
