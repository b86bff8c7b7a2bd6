"""Scalar Column functions: digit text, checksums, structure tests, masking, line and token measures.

All of them are built-in expressions and stay in the JVM. Null input gives null unless a docstring says otherwise.
Offsets are code points, as Spark's string functions count them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

#: Digit words and the digits they stand for, in the same order.
DIGIT_WORDS, DIGITS = "공영일이삼사오육륙칠팔구", "001234566789"
#: Weights of the twelve digits before a resident number's check digit.
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
#: Characters that are invisible and dropped before detection.
ZERO_WIDTH = "\ufeff\u200b\u200c\u200d\u2060"
#: Labels that end an address which ran into the next field.
ADDRESS_TAIL = (
    r"(?iU)(?:\s*(?:지원시간|영업시간|문의|문의전화|연락처|대표번호|대표전화|전화|팩스|담당자|이메일|\(?TEL\)?|\(?PHONE\)?|\(?FAX\)?)\s*:"
    r"|\s+(?:구분|상세(?:\s*내용)?|내용|작성일|등록부작성일|가족관계등록부작성일)(?:\s|:|$)"
    r"|\s*\[[^\]]*(?:작성일|등록부작성일|가족관계등록부작성일|구분|상세|내용)[^\]]*\])"
)


def digits_only(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\D", "")


def digit_words_to_digits(s: Column) -> Column:
    return F.translate(s, DIGIT_WORDS, DIGITS)


def _digits(s: Column) -> Column:
    return digits_only(digit_words_to_digits(F.trim(s)))


def _digit(s: Column, k: int) -> Column:
    return F.substring(s, k, 1).try_cast("int")


def rrn_checksum(s: Column) -> Column:
    """Whether a resident number's thirteenth digit is its check digit."""
    def holds(d: Column) -> Column:
        total = sum((_digit(d, k + 1) * w for k, w in enumerate(RRN_WEIGHTS)), F.lit(0))
        return (F.length(d) == 13) & F.coalesce((11 - total % 11) % 10 == _digit(d, 13), F.lit(False))

    return let(_digits(s), holds)


def rrn_structure(s: Column) -> Column:
    """Whether a resident number has a valid birth date; its seventh digit tells the century."""
    def holds(d: Column) -> Column:
        century = F.when(F.substring(d, 7, 1).isin("1", "2", "5", "6"), "19").otherwise("20")
        date = F.try_to_date(F.concat(century, F.substring(d, 1, 6)), "yyyyMMdd")
        return (F.length(d) == 13) & F.substring(d, 7, 1).between("1", "8") & date.isNotNull()

    return let(_digits(s), holds)


def ssn_structure(s: Column) -> Column:
    d = digits_only(F.trim(s))
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~area.isin("000", "666") & ~area.startswith("9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def phone_structure(s: Column) -> Column:
    """International: 8 to 15 digits. Domestic: begins with zero, 9 to 11 digits that aren't all the same."""
    raw = F.trim(s)
    d = digits_only(digit_words_to_digits(raw))
    domestic = F.substring(raw, 1, 1).isin("0", "공", "영") & F.length(d).between(9, 11) & (F.length(F.replace(d, F.substring(d, 1, 1))) > 0)
    return F.when(raw.startswith("+"), F.length(d).between(8, 15)).otherwise(domestic)


def email_structure(s: Column) -> Column:
    raw = F.trim(s)
    domain = F.substring_index(raw, "@", -1)
    local = raw.substr(F.lit(1), F.length(raw) - F.length(domain) - 1)
    dots = lambda x: ~x.startswith(".") & ~x.endswith(".") & ~x.contains("..") & (F.length(x) > 0)
    labels = F.split(domain, r"\.")
    edges = F.forall(labels, lambda x: (x != "") & ~x.startswith("-") & ~x.endswith("-"))
    return raw.contains("@") & dots(local) & dots(domain) & (F.size(labels) >= 2) & edges & F.length(F.element_at(labels, -1)).between(2, 24)


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def ip_structure(s: Column) -> Column:
    """IPv4 or IPv6 (with one run of groups left out, a trailing IPv4, or a zone), but not an unspecified or broadcast address."""
    raw = F.trim(s)
    four = raw.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    body = F.regexp_replace(F.regexp_replace(raw, "%[^%]+$", ""), rf"(?<=:){_OCTET}(?:\.{_OCTET}){{3}}$", "0:0")
    groups = F.size(F.filter(F.split(body, ":"), lambda g: g != ""))
    gaps = F.size(F.split(body, "::")) - 1
    shape = body.rlike("^[0-9A-Fa-f:]+$") & F.forall(F.split(body, ":"), lambda g: F.length(g) <= 4) & ~body.contains(":::")
    ends = (~body.rlike("^:[^:]")) & (~body.rlike("[^:]:$"))
    six = raw.contains(":") & shape & ends & F.when(gaps == 1, groups <= 7).otherwise((gaps == 0) & (groups == 8))
    zero = F.regexp_replace(body, "[0:]", "") == ""
    return (four & ~raw.isin("0.0.0.0", "255.255.255.255")) | (six & ~zero)


def trim_address(s: Column) -> Column:
    """An address without the label that follows it."""
    at = F.regexp_instr(s, F.lit(ADDRESS_TAIL))
    cut = F.when(at > 1, s.substr(F.lit(1), at - 1)).otherwise(s)
    return F.regexp_replace(cut, "[ ,;:/]+$", "")


def strip_zero_width(s: Column) -> Column:
    return F.translate(s, ZERO_WIDTH, "")


def mask(s: Column) -> Column:
    """First and last two characters; short values as they are."""
    return F.when(F.length(s) <= 4, s).otherwise(F.concat(F.substring(s, 1, 2), F.lit("..."), s.substr(F.length(s) - 1, F.lit(2))))


def truncate(s: Column, limit: int) -> Column:
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit), F.lit("...")))


def request_id(s: Column) -> Column:
    """Eight hex digits of the text's md5; `empty` for null and empty texts."""
    return F.when(F.coalesce(s, F.lit("")) == "", "empty").otherwise(F.substring(F.md5(s), 1, 8))


def distinct_list(csv: Column) -> Column:
    """The items of a comma-separated list, trimmed and in capitals, each once where it comes first; no empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(csv, ","), lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def fold_case(s: Column) -> Column:
    return F.lower(s)


def digit_ratio(s: Column) -> Column:
    return F.when(F.length(s) == 0, 0.0).otherwise(F.regexp_count(s, F.lit(r"(?U)\d")) / F.length(s))


def token_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"(?U)\S+"))


def line_index(text: Column, position: Column) -> Column:
    """Line feeds before a position."""
    head = text.substr(F.lit(1), position)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def line_start(text: Column, position: Column) -> Column:
    head = text.substr(F.lit(1), position)
    return F.length(head) - F.length(F.substring_index(head, "\n", -1))


def line_at(text: Column, position: Column) -> Column:
    """The whole line around a position."""
    return F.concat(F.substring_index(text.substr(F.lit(1), position), "\n", -1), F.substring_index(text.substr(position + 1, F.length(text)), "\n", 1))


def row_signature(line: Column) -> Column:
    """Kinds of a row's first 24 tokens; the first test that holds names the kind."""
    tokens = F.filter(F.split(F.trim(line), r"(?U)\s+"), lambda t: t != "")
    kind = lambda t: (
        F.when(t == ">", ">").when(t.contains("@"), "<EML>").when(t.rlike(r"(?U)^\d{1,3}(?:\.\d{1,3}){3}$"), "<IP>")
        .when(t.rlike(r"(?U)^\d+(?:[-/]\d+)+$"), "<NUMH>").when(t.rlike(r"(?U)^\d+$"), "<NUM>").when(t.rlike("[A-Za-z가-힣]"), "<TXT>").otherwise("<ETC>")
    )
    return F.array_join(F.slice(F.transform(tokens, kind), 1, 24), " ")


def looks_like_header(cell: Column) -> Column:
    """A short cell with a letter, few digits and no at sign."""
    s = F.trim(cell)
    return (s != "") & (F.length(s) <= 64) & ~s.contains("@") & s.rlike("[A-Za-z가-힣]") & (digit_ratio(s) < 0.4)


def keyword_norm(score: Column, indicators: int) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score / indicators)) if indicators > 0 else F.lit(0.0)


def embedding_norm(difference: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), difference / 2))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def contains_phrase(text: Column, phrase: str) -> Column:
    return F.contains(F.lower(text), F.lit(phrase.lower()))


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """The first of `phrases` that the text holds, in any case of letters; empty if none."""
    if not phrases:
        return F.lit("")
    found = F.when(contains_phrase(text, phrases[0]), phrases[0])
    for p in phrases[1:]:
        found = found.when(contains_phrase(text, p), p)
    return found.otherwise("")


def keyword_score(text: Column, indicators: list[str], others: list[str]) -> Column:
    """Indicators that the text holds less the other phrases that it holds."""
    count = lambda phrases: sum((contains_phrase(text, p).cast("int") for p in phrases if p), F.lit(0))
    return count(indicators) - count(others)


def escape_html(s: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        s = F.replace(s, F.lit(plain), F.lit(name))
    return s
