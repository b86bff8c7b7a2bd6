import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import language_id, quality_classifier, quality_rules, toxicity
from spanforge.llm.common import tree_sum

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")


def _checked(found, labels, column, modulus, rest):
    assert found.doc_id.is_unique and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % modulus == rest for d in found.doc_id]).all()
    assert (found.predicted == (found.score >= 0.5)).all()
    both = found[found.held_out].join(labels, on="doc_id", how="inner")
    return (both.predicted == both[column]).mean(), both


def test_quality_on_held_out_labels(spark, labels):
    found = quality_classifier.op3_quality_classifier(spark, SF).toPandas()
    accuracy, both = _checked(found, labels, "quality", 3, 1)
    assert len(found) == 1000 and accuracy >= 0.95
    assert both[both.quality == 1].predicted.mean() >= 0.97


def test_toxicity_on_held_out_labels(spark, labels):
    found = toxicity.op6_toxicity(spark, SF.replace("0.01", "0.1")).toPandas()
    big = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet").toPandas().set_index("doc_id")
    accuracy, both = _checked(found, big, "toxic", 5, 0)
    assert accuracy >= 0.97
    assert both[both.toxic == 1].predicted.mean() >= 0.85 and both[both.toxic == 0].predicted.mean() <= 0.02


def test_language_on_held_out_documents(spark):
    found = language_id.op10_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    both = found.merge(docs[["doc_id", "lang"]], on="doc_id")
    assert (both.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in both.doc_id]).all()
    out = both[both.held_out]
    assert (out.lang == out.lang_pred).mean() >= 0.97 and both.score.between(0, 1).all()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "x", "en"), (1, "same", "x", "en"), (None, "no id", None, "en"), (3, "", "y", None), (4, "a " * 60000, "z", "de"), (5, "same", "x", "fr"), (5, "same", "x", "fr"), (6, "\x00 12 34 !!", "q", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, lang string")


@pytest.mark.parametrize("part", [quality_classifier, toxicity])
def test_classifier_edges(spark, odd, part):
    """Nulls, repeats, clashing columns; labels that are null, repeated, one-sided or absent."""
    from pyspark.sql import functions as F

    column = "quality" if part is quality_classifier else "toxic"
    for rows in ([(1, 1), (1, 0), (5, None), (None, 1), (4, 1)], [(4, 1), (5, 1)], []):
        labels = spark.createDataFrame(rows, f"doc_id long, {column} int")
        model = part.fit(odd, labels, part.held_out)
        scores = [r[0] for r in odd.select(part.score(model, F.col("text"))).collect()]
        assert len(scores) == 8 and all(0 <= s <= 1 for s in scores)
    model = part.fit(odd.limit(0), labels, part.held_out)
    assert odd.limit(0).select(part.score(model, F.col("text"))).count() == 0


def test_toxicity_features_see_disguise_and_address():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "lowe*": 4.0})
    plain, hidden, stem, clean = toxicity.features(["you idiot", "you 1d.i0t", "der loweian mann", "you 1st"], lexicon)
    assert plain[1] == hidden[1] == stem[1] == 1 and clean[1] == 0
    assert plain[8] == hidden[8] == 1 and stem[8] == 0
    assert hidden[7] == 1 and plain[7] == 0


def test_language_edges(spark, odd):
    from pyspark.sql import functions as F

    net = language_id.Network.new(["de", "en"])
    found = {(r.doc_id, r.lang_pred == "und", r.score == 0) for r in language_id.predict(odd, net, language_id.held_out(F.col("doc_id"))).collect()}
    assert {(1, True, True), (3, True, True), (6, True, True), (1, False, False), (None, False, False), (4, False, False)} <= found
    nothing = language_id.predict(odd, language_id.fit(odd.limit(0), language_id.held_out), language_id.held_out(F.col("doc_id"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == 8
    assert language_id.predict(odd.limit(0), net, language_id.held_out(F.col("doc_id"))).count() == 0


def test_backpropagation_against_finite_differences():
    net = language_id.Network.new(["a", "b", "c"], hidden=3, seed=1)
    for part in (net.w, net.u):
        part[:] = [p.astype(float) for p in part]
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 100, (7, 4)).astype(np.uint8), rng.integers(0, 3, 4)
    _, grads = language_id.gradients(net, x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in [np.unravel_index(int(k), p.shape) for k in rng.integers(0, p.size, 4)] + [np.unravel_index(int(np.abs(g).argmax()), p.shape)]:
            kept = p[at]
            p[at] = kept + 1e-5
            up, _ = language_id.gradients(net, x, y)
            p[at] = kept - 1e-5
            down, _ = language_id.gradients(net, x, y)
            p[at] = kept
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_positions_pool_like_single_windows():
    net = language_id.Network.new(["a", "b"], seed=2)
    texts = [b"", b"abc", b"x" * 200, "héllo wörld".encode() * 30]
    pooled = net.documents(texts, window=96, width=3)
    for text, row in zip(texts, pooled, strict=True):
        total = np.zeros(2)
        for at in range(0, len(text), 96):
            own = text[at : at + 96]
            p = net.positions(np.frombuffer(own.ljust(96, b"\0"), np.uint8)[:, None])
            total += p[[k for k, b in enumerate(own) if b & 0xC0 != 0x80], :, 0].sum(axis=0)
        assert np.allclose(row, total / max(1, len(text.decode())), atol=1e-5)


def _brute_rules(text):
    import re
    from collections import Counter

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_rules_base_figures_against_brute_force():
    rng = np.random.default_rng(0)
    pieces = ["a", "b", "é", " ", "\x1c", "\x85", " ", "\n", "\t", "\r", "\x0b", "#", "a b c", "漢", "<x>"]
    for _ in range(300):
        text = "".join(rng.choice(pieces, int(rng.integers(0, 60))))
        assert quality_rules.measure(text.encode())[0] == _brute_rules(text), repr(text)


def test_rules_score_and_verdict_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = {r.doc_id: r for r in quality_rules.op7_quality_rules(spark, SF).collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    left_out = {r.doc_id for r in labels.where("quality = 1").where(F.pmod(F.xxhash64("doc_id"), F.lit(quality_rules.CALIBRATION)) == 0).collect()}
    assert 0.15 < len(left_out) / len(good) < 0.35
    raw, trusted = np.zeros(quality_rules.BUCKETS, int), np.zeros(quality_rules.BUCKETS, int)
    own = {}
    for r in docs.collect():
        own[r.doc_id] = quality_rules.measure((r.text or "").encode())
        np.add.at(raw, own[r.doc_id][1], 1)
        if r.doc_id in good - left_out:
            np.add.at(trusted, own[r.doc_id][1], 1)
    ratio = np.log(trusted + quality_rules.PSEUDO) - np.log(raw * trusted.sum() / raw.sum() + quality_rules.PSEUDO)
    passed = lambda base: base[0] >= 50 and 100 * base[4] <= 50 * base[0]
    calm = np.sort([np.floor(round(ratio[at].mean(), 9) / 1e-4) * 1e-4 for doc, (base, at) in own.items() if doc in left_out and passed(base)])
    median, high = (calm[int(np.ceil(share * len(calm))) - 1] for share in (0.5, 0.9))
    threshold = median - quality_rules.SPREADS * (high - median)
    assert len(found) == 1000
    for doc, (base, at) in own.items():
        r = found[doc]
        score = ratio[at].mean() if len(at) else 0.0
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*base, failed)
        assert abs(r.score - score) < 1e-8 and r.kept == (not failed and round(score, 9) >= threshold - 1e-12)
    marked = labels.toPandas().set_index("doc_id").quality
    assert np.mean([found[d].kept for d in marked[marked == 1].index if not found[d].base_failed]) >= 0.95
    assert not any(found[d].kept for d in marked[marked == 0].index)


def test_rules_edges(spark, odd):
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, None)], "doc_id long, quality int")
    for docs, rows in ((odd, 8), (odd.limit(0), 0)):
        marked = quality_rules.marked_good(docs, labels)
        ratio = quality_rules.log_ratio(quality_rules.counts(marked))
        assert quality_rules.judge(docs, ratio, quality_rules.calibrated(marked.where("left_out"), ratio)).count() == rows
    assert quality_rules.lower_bound(np.zeros(quality_rules.BINS, int)) == -np.inf
    assert quality_rules.buckets_for(0) == quality_rules.BUCKETS and quality_rules.buckets_for(10**9) == quality_rules.MOST_BUCKETS and quality_rules.buckets_for(70_000) == 1 << 17
    assert quality_rules.log_ratio(np.array([[3, 1], [0, 0]])).tolist() == [0, 0]


def test_a_rare_language_is_learnt(spark):
    """One document in a thousand, beyond the even share of the others."""
    rows = [(k, "the cat and the dog sat on the warm mat by the fire " * 3, "en") for k in range(1500)] + [(k + 2000, "żółw łąka jeść pięść źdźbło gęś " * 4, "pl") for k in range(2)] + [(None, "x y z", "de"), (9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    net = language_id.fit(docs, lambda c: F.lit(False), rows=40, windows=400)
    assert net.langs == ["en", "pl"]
    found = {r.lang_pred for r in language_id.predict(docs.where("lang = 'pl'"), net, F.lit(False)).collect()}
    assert found == {"pl"}


def test_tree_sum(spark):
    parts = spark.createDataFrame([(np.array([k, 1]).tobytes(),) for k in range(50)], "part binary").repartition(20)
    assert tree_sum(parts).tolist() == [1225, 50] and tree_sum(parts.limit(0)) is None
