import hashlib
import os
from collections import defaultdict

import numpy as np

from spanforge.llm import near_dedup as nd


def _sets(texts):
    shingler, total = nd.Shingler(), np.zeros(nd.BUCKETS)
    for t in texts:
        total[shingler.buckets(t.encode())] += 1
    own = nd.Shingler(np.log1p(len(texts) / np.maximum(1, total)))
    return [own.weighted(t.encode()) for t in texts]


def _brute(texts):
    """Class of each text: components of equal texts and pairs of weighted Jaccard similarity 0.8 or more."""
    sets, parent = _sets(texts), list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if texts[a] == texts[b] or nd.weighted_jaccard(sets[a], sets[b]) >= nd.THRESHOLD:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(texts))]


def _corpus():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n))
    texts, notice = [], prose(40)
    for _ in range(25):
        base = prose(int(rng.integers(5, 120)))
        texts += [base, base]
        for edits in (1, 2, 4, 9):
            own = base.split()
            for k in rng.integers(0, len(own), edits):
                own[k] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [prose(60) + " " + notice for _ in range(20)] + ["", "a", "a", "one two", "x " * 500, "x " * 501]
    return texts


def test_classes_against_brute_force(spark):
    texts = _corpus()
    docs = spark.createDataFrame([(100 + k, t, "k") for k, t in enumerate(texts)], "doc_id long, text string, key string").repartition(6)
    found = {r.key: (r.root, r.class_id) for r in nd.classes(docs).collect()}
    expected = _brute(texts)
    got = [found[hashlib.md5(t.encode()).hexdigest()][1] for t in texts]
    assert got == [100 + k for k in expected]


def test_pairs_in_a_large_family_of_one_template(spark, monkeypatch):
    """Texts of one template are 0.7 alike; pairs among them that are 0.8 alike meet mostly in buckets of the whole family."""
    monkeypatch.setattr(nd, "CROWDED", 2)  # all candidates are bounded by parts
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    template, texts = word(400), []
    for _ in range(250):
        own = word(13)
        texts += [" ".join(template + own), " ".join(template + own[:7] + word(6)), " ".join(template + word(13))]
    shingles = _sets(texts)
    column = {s: k for k, s in enumerate(sorted({int(s) for own, _ in shingles for s in own}))}
    dense = np.zeros((len(texts), len(column)), np.float32)
    for k, (own, weight) in enumerate(shingles):
        dense[k, [column[int(s)] for s in own]] = weight
    parent = list(range(len(texts)))
    total = dense.sum(axis=1, dtype=float)
    for k in range(len(texts)):
        mine = np.flatnonzero(dense[k])
        both = np.minimum(dense[:k, mine], dense[k, mine]).sum(axis=1, dtype=float)
        for other in np.flatnonzero(both >= nd.THRESHOLD * (total[:k] + total[k] - both)):
            parent[k] = min(parent[k], parent[other])
    assert 150 < len(texts) - len(set(parent)) <= 260
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found = {r.first: r.class_id for r in nd.classes(docs).collect()}
    assert [found[k] for k in range(len(texts))] == parent


def test_samples_agree_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(0)
    shingles = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    weight = rng.uniform(0.5, 3, 400).astype(np.float32)
    other = weight.copy()
    other[:120] *= 0.3
    one, two = (shingles, weight), (shingles, other)
    expected = nd.weighted_jaccard(one, two)
    chosen = nd.samples(np.concatenate([shingles, shingles]), np.concatenate([weight, other]), np.array([0, 400]), 2000)
    assert abs((chosen[0] == chosen[1]).mean() - expected) < 0.04
    assert (nd.samples(shingles, weight, np.array([0]), 36) == chosen[0, :36]).all()


def test_components_on_a_long_path(spark):
    edges = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(40)] + [("900", "901")], "centre string, key string")
    found = {r.key: r.root for r in nd.components(edges).collect()}
    assert {found[f"{k:03d}"] for k in range(41)} == {"000"} and found["901"] == "900" and len(found) == 43


def test_edges_and_keeping_one(spark):
    rows = [(7, "the same text here today", 1), (3, "the same text here today", 2), (None, "the same text here today", 3), (3, "the same text here today", 2), (9, None, 4), (8, "", 5), (None, "lonely words without an id", 6), (3, "another text with that id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars) for r in nd.keep_one(spark, docs, "").collect())
    assert kept == [(-1, 6), (3, 2), (3, 7), (8, 5)]
    assert nd.keep_one(spark, docs.limit(0), "").count() == 0
    assert nd.classes(docs.limit(0)).count() == 0
    multi = defaultdict(int)
    for texts in _brute(["a b c d e", "a b c d e", "f"]), :
        for t in texts:
            multi[t] += 1
    assert sorted(multi.values()) == [1, 2]


def test_word_hashes_of_any_length():
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"abc\xc3\xa9"), n)) for n in (1, 2, 5, 30, nd.LONG_WORD, nd.LONG_WORD + 1) for _ in range(6)] + [b"y" * nd.PIECE, b"z" * (2 * nd.PIECE)]
    for n in (0, 1, 7, 900):
        chosen = [words[k] for k in rng.integers(0, len(words), n)]
        text = b"".join([b" ", b"\n", b"\t\r ", b"\x0b"][int(rng.integers(4))] + w for w in chosen)
        hashes = nd.word_hashes(text)
        seen = dict(zip(text.split(), hashes.tolist(), strict=True))
        assert [seen[w] for w in chosen] == hashes.tolist() and len(set(seen.values())) == len(seen)


def test_prefixes_miss_no_pair():
    """Of all pairs as alike as the threshold the lighter set has a slot that the heavier one asks for, or no one needs it."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
    sets = []
    for _ in range(60):
        own = np.union1d(base[rng.random(len(base)) < rng.uniform(0.6, 1)], rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64))
        sets.append((own, (0.5 + (own % 7)).astype(np.float32)))
    rarity = np.zeros(1 << 16, np.int32)
    for own, _ in sets:
        np.add.at(rarity, (own % np.uint64(1 << 16)).astype(int), 1)
    found = [nd.slots(*nd.prefix(*x, rarity, 0.8), 0.8) for x in sets]
    own, asked = [set(s[~a].tolist()) for s, a, *_ in found], [set(s[a].tolist()) for s, a, *_ in found]
    near = 0
    for a in range(len(sets)):
        for b in range(a):
            if nd.weighted_jaccard(sets[a], sets[b]) >= 0.8:
                near += 1
                both = np.minimum(nd.parts_of(*sets[a]).astype(np.float32), nd.parts_of(*sets[b]).astype(np.float32)).sum(dtype=float)
                total = float(sets[a][1].sum(dtype=float) + sets[b][1].sum(dtype=float))
                assert both >= total * (0.8 / 1.8) * (1 - 10 * nd.SLACK)
                assert own[a] & asked[b] or own[b] & asked[a]
    assert near > 20


def test_rows_of_the_prefix_search_are_numbers(spark, monkeypatch):
    """A node has hundreds of rows there: with keys in them they were a third larger. What is read no more is removed."""
    rng, rows, real = np.random.default_rng(5), {}, nd.staged
    monkeypatch.setattr(nd, "staged", lambda df, name, files=None: rows.setdefault(name, real(df, name, files)))
    word = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    template, texts = word(400), []
    for _ in range(60):
        own = word(13)
        texts += [" ".join(template + own), " ".join(template + own[:7] + word(6)), " ".join(template + word(13))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    idf = nd.inverse_frequencies(docs)
    z = docs.select(nd.text_key(docs.text).alias("key"), "doc_id", "text").transform(nd._texts).select("key", "z").localCheckpoint()
    nodes = z.selectExpr("key", "key AS root")
    pairs = {tuple(r) for r in nd.prefix_pairs(z, nodes, idf, nd.THRESHOLD).select("centre", "key").collect()}
    sets = {hashlib.md5(t.encode()).hexdigest(): nd.Shingler(idf).weighted(t.encode()) for t in texts}
    keys = sorted(sets)
    alike = {(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :] if nd.weighted_jaccard(sets[a], sets[b]) >= nd.THRESHOLD}
    assert alike and alike <= pairs
    kinds = {f.dataType.simpleString() for name in ("prefixes", "shared") for f in rows[name].schema}
    assert kinds <= {"bigint", "boolean", "double", "array<bigint>"}
    gone = [f.removeprefix("file://") for f in rows["prefixes"].inputFiles()]
    assert gone and not any(map(os.path.exists, gone))
