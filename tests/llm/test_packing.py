import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanforge.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def _brute(lengths, capacity):
    """Best-fit decreasing, one document at a time: (bins, histogram of what is left)."""
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(bins, n)
        left = bins.pop(k) if k < len(bins) else capacity
        bisect.insort(bins, left - n)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_document_by_document(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 400))).tolist()
    plan = packing.best_fit_plan(Counter(lengths), capacity)
    used, places = defaultdict(int), defaultdict(list)
    for n, runs in plan.items():
        ends = [*runs[1:, 0].tolist(), lengths.count(n)]
        for (rank, low, per, offset), end in zip(runs.tolist(), ends, strict=True):
            for k in range(end - rank):
                places[low + k // per].append((offset + k % per * n, n))
                used[low + k // per] += n
    for own in places.values():
        assert sorted(own)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False))
    assert sorted(capacity - x for x in used.values()) == _brute(lengths, capacity)


def test_capacity_tree():
    tree = packing.CapacityTree(10)
    for c in (3, 7, 7, 10):
        tree.add(c, 1)
    assert [tree.tightest(x) for x in (1, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, 10, 10]
    tree.add(10, -1)
    assert tree.tightest(8) is None


def test_ids_equal_the_library():
    texts = ["", "Hello, WORLD's it's 123 ½ ß İ", "a\x1cb c", "tab\tnew\nline  two", "漢字 <|endoftext|> x", "née Ünï'd 'll!!'s", "don't!'s we've @@@ #1"] * 2
    own = packing.WordTokenizer(PATH)
    expected = [x.ids for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == expected


def test_runs_are_cut_once_and_frequent_words_stay(monkeypatch):
    """Runs between white space go through the pattern when they are new; ids equal the library's, also once words were forgotten."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 60)
    own, cut, merged = packing.WordTokenizer(PATH), [], []
    split, encode = own.split, own.words.encode
    own.split = lambda text: (cut.append(text), split(text))[1]
    own.words.encode = lambda words: (merged.extend(words), encode(words))[1]
    texts = [f"Often,\u00a0 it's seen\tNo.{k} (rare{k}) often, 漢{k}\x1c" if k % 9 == 0 else f" often,\u00a0 it's seen\tNo.{k} (rare{k}) OFTEN,\n" for k in range(200)]
    library = Tokenizer.from_file(PATH)
    for text in texts:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert cut.count("often,") == cut.count("it's") == 1 and merged.count("often") == 1 and len(own.runs.known) <= 70


def test_white_space_parts_runs_as_the_pattern_does():
    own = packing.WordTokenizer(PATH)
    library = Tokenizer.from_file(PATH)
    texts = [f"ab{c}cd {c}'s{c}1" for c in map(chr, range(0x300))]  # capitals such as Ɓ turn into letters beyond ɏ
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_pack(spark):
    rows = [(1, "word " * 3000, "c"), (1, "word", "c"), (None, None, "d"), (4, "", "e"), *((10 + k, "some text here " * (k % 30), "f") for k in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(4)
    found = packing.pack(docs, PATH).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc, text, _ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for at in range(0, len(ids), 2048):
            expected[doc, at // 2048, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    assert got == expected
    ordered = found.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 2048
    assert found.sequence_id.nunique() == len(_brute(found.length.tolist(), 2048))
    assert packing.pack(docs.limit(0), PATH).count() == 0
