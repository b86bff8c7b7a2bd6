import hashlib

import numpy as np
import pytest

from spanforge.llm import suffix_dedup as sd


def brute(rows, length=sd.LENGTH):
    """(n_bytes, n_removed, n_spans, kept_sha256) of rows in their order of precedence."""
    seen, out = set(), []
    for text in rows:
        covered = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            if window in seen:
                covered[i : i + length] = True
            seen.add(window)
        kept = bytes(b for b, c in zip(text, covered, strict=True) if not c)
        runs = int((covered & ~np.concatenate([[False], covered[:-1]])).sum()) if len(text) else 0
        out.append((len(text), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 40, 41, 42, 300])
def test_suffix_array(n):
    rng = np.random.default_rng(n)
    for letters in (1, 2, 26):
        t = rng.integers(1, letters + 1, n)
        assert sd.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def _corpus():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(30), prose(80)
    texts = [prose(60), base, base, prose(10) + passage + prose(10), passage, "ab " * 200, "ab " * 150, "", "x" * 99, "x" * 100, "x" * 101, "x" * 101]
    texts += [prose(6) + passage[k:] + prose(5) for k in range(12)]
    for k in range(12):
        words = base.split()
        words[k * 5] = word()
        texts.append(" ".join(words))
    texts += [prose(3) + passage[5:110] + prose(3), (prose(40) + "\n") * 3]
    return texts


@pytest.mark.parametrize("hot", [sd.HOT, 3])
def test_against_brute_force(spark, hot):
    """The same figures whether anchors are split (`hot` regions at most in one suffix array) or not."""
    texts = _corpus()
    rows = spark.createDataFrame([(7 + k, t, "a") for k, t in enumerate(texts)], "doc_id long, text string, at string").repartition(5)
    expected = dict(zip(range(7, 7 + len(texts)), brute([t.encode() for t in texts]), strict=True))
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(rows, hot=hot).collect()}
    assert found == expected


def test_nulls_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefgh "), 400))
    other = "".join(rng.choice(list("abcdefgh "), 300))
    rows = spark.createDataFrame([(1, text), (1, text), (1, other), (None, text), (2, None), (3, "x" * 50), (3, "x" * 50)], "doc_id long, text string")
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed) for r in sd.dedup(rows).collect())
    assert found == sorted([(-1, 400, 0), (1, 400, 400), (1, 400, 400), (1, 300, 0), (2, 0, 0), (3, 50, 0), (3, 50, 0)])
    assert sd.dedup(rows.limit(0)).count() == 0


def test_long_texts_are_cut_into_slabs(monkeypatch):
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 5000, np.uint8))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc": [1], "tie": [0], "text": [text.decode()]})
    whole = [len(b) for b, _, _ in sd._pieces([batch], 10_000, 100)]
    slabs = [(len(b), w[0][2]) for b, _, w in sd._pieces([batch], 1000, 100)]
    assert whole == [5000] and slabs[0] == (1099, 0) and sum(n - 99 for n, _ in slabs) == 4901
