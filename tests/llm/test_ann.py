import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import ann


def _brute(ids, x, queries, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        cosine = unit @ unit[i]
        keep = ids != q
        order = np.lexsort((ids[keep], -cosine[keep]))[:k]
        out[q] = [(int(a), float(b)) for a, b in zip(ids[keep][order], cosine[keep][order], strict=True)]
    return out


def test_recall_and_scores(spark):
    """On clustered vectors dealt into several blocks, against brute force."""
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(12, 32))[rng.integers(0, 12, 5000)] + 0.9 * rng.normal(size=(5000, 32))).astype(np.float32).astype(float)
    x[100:400] = x[100]  # a vector with many copies
    ids = np.arange(5000)
    rows = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank string")
    found = ann.search(rows, F.col("vec_id") % 50 == 0, block=2000).orderBy("query_id", "rank").collect()
    expected = _brute(ids, x, [i for i in range(0, 5000, 50)])
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == expected.keys()
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in expected[q]}) for q in got)
    assert hits / (5 * len(got)) >= 0.9
    assert [a for a, _ in got[100]] == [101, 102, 103, 104, 105] and abs(got[100][0][1] - 1) < 1e-12  # ties: smaller ids first
    for q, own in got.items():
        for v, score in own:
            assert abs(score - x[v] @ x[q] / (np.linalg.norm(x[v]) * np.linalg.norm(x[q]))) < 1e-12


def test_narrow_cones_and_groups_larger_than_the_share():
    """A mean cosine of 0.9 leaves all pivots; a group of half of the rows is searched whole."""
    rng = np.random.default_rng(1)
    noise = rng.normal(size=(4000, 32))
    cone = 3 * np.ones(32) + noise
    for jitter in (None, 1e-3, 1e-4):
        x = cone.copy() if jitter is None else noise.copy()
        if jitter is not None:
            x[rng.permutation(4000)[:2000]] = noise[0] + jitter * rng.normal(size=(2000, 32))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert len(ann.spread(unit[:1024], 256)) == 256
        ids, queries = np.arange(4000), list(range(0, 4000, 80))
        index = ann.PermutationBlock(ids, ann.scaled(x), 256)
        expected = _brute(ids, x, queries)
        for q in queries:
            assert index.search(q, ann.scaled(x[q][None, :])[0], 5)[0].tolist() == [a for a, _ in expected[q]]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [3.0, 3.0]), (None, [1.0, 1.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)]  # 6 has no other vector of its length
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(df.where("vec_id = 7"), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_rows_lengths_and_magnitudes(spark):
    rows = [(50, [1.0, 0.0])] * 2 + [(50, [0.0, 1.0]), (1, [2e200, 0.0]), (2, [1e-170, 1e-170]), (2, [1e-170, 1e-170]), (2, [-1.0, 0.0]), (3, [5e-324, 0.0]), (100, [1.0, 1.0, 1.0]), (4, [3.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = [(r.query_id, r.vec_id, round(r.score, 12)) for r in ann.search(df, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "score", "rank").collect()]
    half, third = round(0.5**0.5, 12), round(3**-0.5, 12)
    one = [(50, 1, 1.0), (50, 3, 1.0), (50, 2, half)]  # of the vector (1, 0)
    two = [(50, 2, half), (50, 1, 0.0), (50, 2, 0.0)]  # of the vector (0, 1): ties go to the smaller id, the id's other vector is no candidate
    assert sorted(found) == sorted([*one, *two, (100, 4, third)])


def test_the_footrule_stage_alone():
    """Without the exact check the share that the footrule distance admits holds nine of ten neighbours."""
    rng = np.random.default_rng(2)
    x = ann.scaled(rng.normal(size=(12, 32))[rng.integers(0, 12, 6000)] + 0.9 * rng.normal(size=(6000, 32)))
    index = ann.PermutationBlock(np.arange(6000), x)
    expected = _brute(np.arange(6000), x, range(0, 6000, 60))
    hits = sum(len(set(index.search(q, x[q], 5, check=False)[0].tolist()) & {a for a, _ in own}) for q, own in expected.items())
    assert hits / (5 * len(expected)) >= 0.9
