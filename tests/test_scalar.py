import pytest
from pyspark.sql import functions as F

from spanforge.functions import scalar


def _apply(spark, function, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").withColumn("r", function(F.col("v")))
    return [r.r for r in rows.orderBy("k").collect()]


@pytest.mark.parametrize(("function", "good", "bad"), [
    (scalar.rrn_checksum, ["900101-1234568", "9001011234568", "구공공일공일-1234568"], ["900101-1234567", "801231-2345678", "90010112345", ""]),
    (scalar.rrn_structure, ["900101-1234567", "000229-3000000", "960229-2234567"], ["901301-1234567", "900230-1234567", "900101-9234567", "010229-3234567", "1"]),
    (scalar.ssn_structure, ["123-45-6789", "123456789"], ["000-12-3456", "666-12-3456", "912-12-3456", "123-00-1234", "123-45-0000", "12345678"]),
    (scalar.phone_structure, ["010-1234-5678", "+82-10-1234-5678", "공일공-1234-5678", "02-123-4567"], ["12-345-6789", "000000000", "+1234567", "0101234567890", ""]),
    (scalar.email_structure, ["a@b.co", "a.b+c@d-e.example.org"], ["a@b", ".a@b.co", "a.@b.co", "a..b@c.co", "a@-b.co", "a@b-.co", "a@b..co", "a@.b.co", "ab.co", "@b.co", "a@b.c"]),
    (scalar.ip_structure, ["1.2.3.4", "::1", "1:2:3:4:5:6:7:8", "fe80::1", "::ffff:1.2.3.4", "1::"], ["0.0.0.0", "255.255.255.255", "::", "1.2.3", "256.1.1.1", "01.2.3.4", "1:2:3", "1::2::3", "12345::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "x"]),
])
def test_validators(spark, function, good, bad):
    assert _apply(spark, function, good) == [True] * len(good)
    assert _apply(spark, function, bad) == [False] * len(bad)
    assert _apply(spark, function, [None]) in ([None], [False])


def test_ip_structure_like_the_standard_library(spark):
    import ipaddress
    import random

    rng = random.Random(0)
    values = ["".join(rng.choice(["1", "f", "0", ":", "::", ".", "10", "255"]) for _ in range(rng.randint(1, 14))) for _ in range(400)]

    def expected(v):
        try:
            own = ipaddress.ip_address(v)
        except ValueError:
            return False
        return v not in ("0.0.0.0", "255.255.255.255") and not own.is_unspecified

    assert _apply(spark, scalar.ip_structure, values) == [expected(v) for v in values]


def test_small_ones(spark):
    assert _apply(spark, scalar.mask, ["abcd", "abcde", None]) == ["abcd", "ab...de", None]
    assert _apply(spark, lambda v: scalar.truncate(v, 3), ["abc", "abcd"]) == ["abc", "abc..."]
    assert _apply(spark, scalar.request_id, ["", None, "x"]) == ["empty", "empty", "9dd4e461"]
    assert _apply(spark, scalar.strip_zero_width, ["a​b﻿⁠c"]) == ["abc"]
    assert _apply(spark, scalar.trim_address, ["서울 강남구 역삼동 1 연락처: 2", "서울 a 구분 x", "서울 b [작성일 1]", "서울 c ,;", "연락처: 1"]) == ["서울 강남구 역삼동 1", "서울 a", "서울 b", "서울 c", "연락처: 1"]
    assert _apply(spark, scalar.row_signature, ["> a@b 1.2.3.4 1-2/3 45 x1 --", "", " ".join("1" for _ in range(30))]) == ["> <EML> <IP> <NUMH> <NUM> <TXT> <ETC>", "", " ".join(["<NUM>"] * 24)]
    assert _apply(spark, lambda v: scalar.line_at(v, F.lit(3)), ["ab\ncd\nef", "abcd", "ab\n"]) == ["cd", "abcd", ""]
    assert _apply(spark, lambda v: scalar.line_index(v, F.lit(3)), ["ab\ncd\nef", "abcd"]) == [1, 0]
    assert _apply(spark, scalar.escape_html, ["<a b=\"c\">'&"]) == ["&lt;a b=&quot;c&quot;&gt;&#039;&amp;"]
    assert _apply(spark, scalar.looks_like_header, ["Name", "", "a@b", "12345a", "x" * 65, "주소"]) == [True, False, False, False, False, True]
