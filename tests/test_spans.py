import re

import pytest
from pyspark.sql import functions as F

from spanforge.functions import spans
from spanforge.plans import rules


def _cursor(text, patterns, most=10**9):
    """The leftmost match, of those the longest, again and again: what a scan has to equal."""
    compiled, at, out = [re.compile(p) for p in patterns], 0, []
    while len(out) < most:
        found = [m for m in (c.search(text, at) for c in compiled) if m and m.end() > m.start()]
        if not found:
            return out
        m = min(found, key=lambda m: (m.start(), -m.end()))
        out.append((m.start(), m.end(), m[0]))
        at = m.end()
    return out


def _spans(spark, texts, column):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", column(F.col("text")).alias("s"))
    return [[tuple(x) for x in r.s] for r in rows.orderBy("k").collect()]


@pytest.mark.parametrize("key", ["SN", "SSN", "DN", "PN", "BN", "IP", "EML", "AN", "MN"])
def test_scan_equals_the_cursor(spark, key):
    import random

    rng, rule = random.Random(key), rules.load().types[key]
    patterns = rules.expand(rules.merge(rules.read_document(rules.RULES / "entities.yaml"), {}), rules.read_document(rules.RULES / "entities.yaml")["macros"])["types"][key]["patterns"]
    pieces = {
        "AN": ["서울 강남구 역삼동", "경기 성남시 ", "테헤란로 12", "군 금촌읍 금촌리 5", "서울", "특별시", " ", "강남구", "성남시", "역삼동", "테헤란로", "12", "-", "3", "\n", "번지", "읍", "리", "길"],
        "EML": ["a@b.co", "x_1@ex-a.com", " ", " ", "a", "b1", ".", "@", "-", "ex", "com", " ", "😀", "co"], "IP": ["10.0.0.1", "1:2:af", " ", " ", "1", "25", "255", ".", ":", "af", " ", "10", "😀"],
        "PN": ["A", "M", "1234567", "8", " ", "가", "9"],
    }.get(key, ["1", "12", "900101", "1234567", "-", " ", "0", "10", "02", "+82", ".", "가", "\t", "😀"] + (["공", "일", "이"] if key in ("SN", "MN") else []))
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 22))) for _ in range(400)] + ["", "\u0001 1 \u0002"]
    scan = lambda t: spans.scan_longest(t, list(rule.longest), rule.pattern, needs=rule.needs) if rule.longest else spans.scan(t, rule.pattern, needs=rule.needs)
    got = _spans(spark, texts, scan)
    assert got == [_cursor(t, patterns) for t in texts]
    assert sum(map(len, got)) > 10


def test_limits_and_nulls(spark):
    assert _spans(spark, ["aa a aaa", None], lambda t: spans.scan(t, "a+", max_len=2)) == [[(0, 2, "aa"), (3, 4, "a")], []]
    assert _spans(spark, ["a a a"], lambda t: spans.scan(t, "a+", limit=2)) == [[(0, 1, "a"), (2, 3, "a")]]
    assert _spans(spark, ["ab", "b"], lambda t: spans.scan(t, "b", needs="a")) == [[(1, 2, "b")], []]


def _lists(spark, values, column):
    rows = spark.createDataFrame([(k, [(a, b, "x") for a, b in v]) for k, v in enumerate(values)], f"k int, s {spans.SPANS}").select("k", column(F.col("s")).alias("r"))
    return [[(x.start, x.end) for x in r.r] for r in rows.orderBy("k").collect()]


def test_selection(spark):
    values = [[(0, 5), (3, 8), (5, 6), (0, 5)], [(0, 2), (0, 6), (6, 7)], []]
    assert _lists(spark, values, spans.finalized) == [[(0, 5), (5, 6)], [(0, 6), (6, 7)], []]
    assert _lists(spark, values, spans.shortest_first) == [[(0, 5), (5, 6)], [(0, 2), (6, 7)], []]
    assert _lists(spark, [[(0, 5), (5, 9), (9, 10)]], lambda s: spans.without_overlap(s, [F.array(spans.span(F.lit(5), F.lit(6), F.lit("y")))])) == [[(0, 5), (9, 10)]]


def test_split_lines(spark):
    found = spark.createDataFrame([([(2, 12, " ab\n\n cde ")],)], f"s {spans.SPANS}").select(spans.split_lines(F.col("s")).alias("r")).head().r
    assert [tuple(x) for x in found] == [(3, 5, "ab"), (8, 11, "cde")]


def test_sentences_like_the_pattern(spark):
    texts = ["One. Two! Three", "...", "", "a\n\nb?c", ".x. y"]
    expected = [[(m.start(), m.end(), m[0]) for m in re.finditer(r"[^.!?\n]+(?:[.!?]+|\n+|$)", t, re.M)] or ([(0, len(t), t)] if t else []) for t in texts]
    assert _spans(spark, texts, spans.sentences) == expected


def test_remap(spark):
    from spanforge.operators.detect import detect

    text = "﻿call 010​-1234-‌5678⁠ now"
    row = detect(spark.createDataFrame([(text,)], "text string")).head()
    (found,) = row.MN
    assert text[found.start : found.end] == found.matchString == "010​-1234-‌5678⁠"
