import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from spanforge.llm import sentencepiece_unigram as su

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "a", "  two  blanks \n\n next line\n", "Atreea erinannd ed eranreou outien", "über größe naïve Ñandú 漢字😀 x\ty",
    "trailing ", "line\n indented", "a\n", "\n", " \n ", "x" * 3000, "weird \x00 \x07 bytes", "don't stop-me; now!?  (really)",
]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes):
    at = 0
    while at < len(data):
        begin = at
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 2:
            n, at = _varint(data, at)
            body, at = data[at : at + n], at + n
        elif kind == 0:
            body, at = _varint(data, at)
        else:
            n = {1: 8, 5: 4}[kind]
            body, at = data[at : at + n], at + n
        yield tag >> 3, body, data[begin:at]


def _put(number: int, body: bytes) -> bytes:
    n, size = len(body), b""
    while n > 127:
        size += bytes([n & 127 | 128])
        n >>= 7
    return bytes([number << 3 | 2]) + size + bytes([n]) + body


@pytest.fixture(scope="module")
def public_unigram():
    """The library's own unigram encoder over the same pieces and log scores."""
    model, out, k = su.load(PATH), b"", 0
    for number, body, raw in _fields(open(PATH, "rb").read()):
        if number == 1:
            parts = [r for f, _, r in _fields(body) if f != 2]
            out += _put(1, b"".join([parts[0], b"\x15" + struct.pack("<f", model.score[k]), *parts[1:]]))
            k += 1
        elif number == 2:
            out += _put(2, b"".join(b"\x18\x01" if f == 3 else r for f, _, r in _fields(body)))
        else:
            out += raw
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def _cost(model, ids):
    return sum(model.score[i] for i in ids)


def test_same_paths_as_the_library(public_unigram):
    own = su.Encoder(su.load(PATH))
    for text, found in zip(TEXTS, own.encode(TEXTS), strict=True):
        ids, expected = np.frombuffer(found, "<u4").tolist(), public_unigram.encode(text)
        if ids != expected:  # rounding may turn a tie; the cost may not differ
            assert _cost(own.model, ids) == pytest.approx(_cost(own.model, expected), abs=1e-3), text


def test_brute_force_on_short_words():
    model = su.load(PATH)
    keys = {p.replace(b" ", su.MARK.encode()): k for k, p in enumerate(model.plain) if model.score[k] < 0}

    def best(word):
        if not word:
            return 0.0
        costs = [model.score[keys[word[:k].encode()]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k].encode() in keys]
        return max(costs) if word[0].encode() in keys else max([*costs, model.unknown + best(word[1:])])

    for word in ("▁hello", "▁erinan", "▁tionth", "▁ñandú", "▁漢x"):
        ids = su.viterbi(model, [word.encode()])[0]
        covered = [i for i in ids if i not in set(model.byte_ids.tolist())]
        assert best(word) == pytest.approx(sum(model.score[i] for i in covered) + model.unknown * sum(c.encode() not in keys for c in word))


def test_paths_of_words_of_all_lengths():
    """Words that are searched as columns of one table get the paths of the search over edges, in any order of lengths."""
    rng, model = np.random.default_rng(3), su.load(PATH)
    letters = np.array(list("aeinrstdlo.,'-19 Aéßñ漢字😀\x00\n▁"))
    words = ["".join(rng.choice(letters, int(n))).encode() for n in rng.choice([0, 1, 2, 4, 9, 15, 16, 20, 47, 48, 49, 90], 1500)]
    ids, size = su.paths(model, words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [x.tolist() for x in su.viterbi(model, words)]


def test_frequent_words_are_searched_once(monkeypatch):
    monkeypatch.setattr(su, "CACHE_WORDS", 60)
    own, searched = su.Encoder(su.load(PATH)), []
    encode = own.words.encode
    monkeypatch.setattr(own.words, "encode", lambda words: (searched.extend(words), encode(words))[1])
    texts = [f"often  seen {k} often\nseen rare{k} rarer{k}" for k in range(200)]
    plain = su.Encoder(su.load(PATH))
    for text in texts:
        assert own.encode([text]) == plain.encode([text]) and own.decode(np.frombuffer(own.encode([text])[0], "<u4")) == text
    assert searched.count("often") == searched.count("▁seen") == searched.count("\nseen") == 1 and len(own.words.known) <= 70


def test_round_trip():
    own = su.Encoder(su.load(PATH))
    for text, found in zip(TEXTS, own.encode(TEXTS), strict=True):
        assert own.decode(np.frombuffer(found, "<u4")) == text


def test_frames(spark):
    rows = spark.createDataFrame([(1, "ab c", "x"), (1, "ab c", "y"), (2, None, None), (None, "", "z")], "doc_id long, text string, ids string")
    found = su.round_trip(rows, PATH).collect()
    assert len(found) == 4 and all(r.round_trip for r in found)
    texts = {r.doc_id: r.text for r in su.decode(su.encode(rows, PATH), PATH).collect()}
    assert texts == {1: "ab c", 2: "", None: ""}
    assert su.round_trip(rows.limit(0), PATH).count() == 0
