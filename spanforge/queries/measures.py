"""Scalar functions, normalisation and presentation, each with SQL over the same derived texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, spans
from ..operators import detect, tools
from ..sources import fixtures as fx

_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_W = " + ".join(f"CAST(substr(d, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(scalar.RRN_WEIGHTS))
_RRN_BASE = f"SELECT doc_id, value, {_DIGITS} AS d FROM ({fx.RRN_DIGITS.sql()}) AS t"


def values(base: fx.Derived, **columns):
    """The value column of a derived table with computed columns beside it."""
    return lambda spark, sf_dir: base.df(spark, sf_dir).select("doc_id", *[c().alias(n) for n, c in columns.items()])


def documents(**columns):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *[c().alias(n) for n, c in columns.items()])


_KOREAN = fx.derived("customer", "", ("k AS doc_id", "'번호 ' || translate(CAST(k AS STRING), '0123456789', '공일이삼사오육칠팔구') || '륙영' AS value"))
_PHONE_VALUES = fx.derived("customer", "", ("k AS doc_id", f"CASE k % 6 WHEN 0 THEN '010-' || {fx.pad('k', 8)} WHEN 1 THEN '+82' || {fx.pad('k', 7)} WHEN 2 THEN '+1' || CAST(k AS STRING) WHEN 3 THEN '000000000' WHEN 4 THEN '공이' || {fx.pad('k', 8)} ELSE '12' || {fx.pad('k', 8)} END AS value"))
_PHONE_SQL = f"""WITH b AS (SELECT doc_id, value, regexp_replace(translate(value, '공영일이삼사오육륙칠팔구', '001234566789'), '[^0-9]', '', 'g') AS d FROM ({_PHONE_VALUES.sql()}) AS t)
SELECT doc_id, CASE WHEN value[1] = '+' THEN length(d) BETWEEN 8 AND 15 ELSE value[1] IN ('0', '공', '영') AND length(d) BETWEEN 9 AND 11 AND replace(d, d[1], '') <> '' END AS valid FROM b"""
_MAIL_SQL = f"""WITH b AS (SELECT doc_id, value, string_split(value, '@') AS p FROM ({fx.MAILS.sql()}) AS t),
c AS (SELECT doc_id, value, p, p[len(p)] AS domain, substr(value, 1, length(value) - length(p[len(p)]) - 1) AS local FROM b)
SELECT doc_id, len(p) > 1 AND local <> '' AND domain <> '' AND NOT regexp_matches(local, '^\\.|\\.$|\\.\\.') AND NOT regexp_matches(domain, '^\\.|\\.$|\\.\\.') AND len(string_split(domain, '.')) >= 2
 AND len(list_filter(string_split(domain, '.'), lambda x: x = '' OR starts_with(x, '-') OR ends_with(x, '-'))) = 0 AND length(string_split(domain, '.')[-1]) BETWEEN 2 AND 24 AS valid FROM c""".replace("\\\\", "\\")
_IP_SQL = f"""SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN doc_id % 300 <= 255 WHEN 3 THEN true WHEN 5 THEN true ELSE false END AS valid FROM ({fx.ADDRESSES.sql()}) AS t"""
_SSN_VALUES = fx.Derived("orders", (*fx.SSN_VALUES.selects, ("doc_id", "area || '-' || grp || '-' || serial AS value")))
_SSN_SQL = f"SELECT doc_id, substr(value, 1, 3) NOT IN ('000', '666') AND value[1] <> '9' AND substr(value, 5, 2) <> '00' AND substr(value, 8) <> '0000' AS valid FROM ({_SSN_VALUES.sql()}) AS t"
_TAILS = fx.Derived("customer", (("c_custkey AS k",), ("k AS doc_id", "'서울 강남구 역삼동 ' || CAST(k AS STRING) AS address"), ("doc_id", "address", "address || CASE doc_id % 4 WHEN 0 THEN ' 연락처: 02-1' WHEN 1 THEN ' 구분 x' WHEN 2 THEN ' [작성일 2024]' ELSE ' ,;' END AS value")))
_ROWS = fx.derived("customer", "", ("k AS doc_id", "CASE k % 5 WHEN 0 THEN 'kim 12 3-4 a@b.c' WHEN 1 THEN '> 1.2.3.4 --' WHEN 2 THEN '  x   ' || CAST(k AS STRING) || '  가 ' WHEN 3 THEN '' ELSE '1/2/3 4.5' END AS value"))
_ROWS_SQL = f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '<TXT> <NUM> <NUMH> <EML>' WHEN 1 THEN '> <IP> <ETC>' WHEN 2 THEN '<TXT> <NUM> <TXT>' WHEN 3 THEN '' ELSE '<NUMH> <ETC>' END AS signature, CAST(CASE doc_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE 2 END AS INT) AS tokens FROM ({_ROWS.sql()}) AS t"
_LINES = fx.derived("customer", "", ("k AS doc_id", "'first' || chr(10) || 'second ' || CAST(k AS STRING) || chr(10) || 'third' AS value", "CAST(k % 18 AS INT) AS place"))
_LINES_SQL = f"""SELECT doc_id, CAST(length(substr(value, 1, place)) - length(replace(substr(value, 1, place), chr(10), '')) AS INT) AS line,
 string_split(value, chr(10))[1 + length(substr(value, 1, place)) - length(replace(substr(value, 1, place), chr(10), ''))] AS line_text FROM ({_LINES.sql()}) AS t"""
_HTML = fx.derived("customer", "", ("k AS doc_id", "'<a href=\"x\">' || CAST(k AS STRING) || ' & co</a>' AS value"))
_HTML_SQL = f"SELECT doc_id, '&lt;a href=&quot;x&quot;&gt;' || CAST(doc_id AS STRING) || ' &amp; co&lt;/a&gt;' AS escaped FROM ({_HTML.sql()}) AS t"
_SCORES = fx.derived("customer", "", ("k AS doc_id", "CAST(k % 401 - 200 AS DOUBLE) / 100 AS value"))
_CLAMP = "greatest(-1.0, least(1.0, value))"
_COLOUR_SQL = f"""WITH v AS (SELECT doc_id, CASE WHEN {_CLAMP} <= 0 THEN ({_CLAMP} + 1) / 2 ELSE {_CLAMP} END AS v FROM ({_SCORES.sql()}) AS t)
SELECT doc_id, CASE WHEN v < 0.5 THEN 'rgba(' || CAST(floor(220 + 30 * (v / 0.5) + 0.5) AS BIGINT) || ',' || CAST(floor(38 + 166 * (v / 0.5) + 0.5) AS BIGINT) || ',' || CAST(floor(38 + (-17) * (v / 0.5) + 0.5) AS BIGINT) || ',0.35)'
 ELSE 'rgba(' || CAST(floor(250 + (-213) * ((v - 0.5) / 0.5) + 0.5) AS BIGINT) || ',' || CAST(floor(204 + (-105) * ((v - 0.5) / 0.5) + 0.5) AS BIGINT) || ',' || CAST(floor(21 + 214 * ((v - 0.5) / 0.5) + 0.5) AS BIGINT) || ',0.28)' END AS colour FROM v"""


def zw_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect(fx.ZERO_WIDTH.df(spark, sf_dir))
    return found.select("doc_id", F.inline("MN")).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("matchString").alias("match_text"))


_ZW_SQL = f"SELECT doc_id, CAST(6 AS INT) AS span_start, CAST(21 AS INT) AS span_end, substr(text, 7, 15) AS match_text FROM ({fx.ZERO_WIDTH.sql()}) AS t"


def flatten_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = detect.detect(fx.RRN.df(spark, sf_dir), include_invalid=True)
    flat = tools.flatten({k: F.col(k) for k in ("SN", "SN_INVALID", "BN")})
    return docs.select("doc_id", F.inline(flat)).select("doc_id", "type", "tag", F.col("start").alias("span_start"), "isValid")


_FLAT_SQL = "SELECT o_orderkey AS doc_id, 'SN' AS type, CASE WHEN o_orderkey % 4 = 2 THEN 'SN_INVALID' ELSE 'SN' END AS tag, CAST(CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 0 END AS INT) AS span_start, o_orderkey % 4 <> 2 AS \"isValid\" FROM orders"


def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = detect.detect(fx.PN.df(spark, sf_dir))
    return docs.select("doc_id", tools.highlight(F.col("text"), tools.flatten({"PN": F.col("PN")})).alias("html"))


_HIGHLIGHT_SQL = f"""WITH p AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 9 WHEN 1 THEN 3 END AS s FROM ({fx.PN.sql()}) AS t)
SELECT doc_id, CASE WHEN s IS NULL THEN text ELSE substr(text, 1, s) || '<mark class="pii pii-PN" title="PN [' || s || ',' || (s + 9) || ']">' || substr(text, s + 1, 9) || '</mark>' || substr(text, s + 10) END AS html FROM p"""


def rrn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fx.RRN.df(spark, sf_dir).withColumn("grp", (F.col("doc_id") % 50).cast("int")).groupBy("grp").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    return texts.select("grp", F.inline(F.array(tools.check_numbers(F.col("text")))))


_BATCH_SQL = """SELECT CAST(o_orderkey % 50 AS INT) AS grp, CAST(count(*) FILTER (WHERE o_orderkey % 4 IN (0, 2)) AS INT) AS found, CAST(count(*) FILTER (WHERE o_orderkey % 4 = 0) AS INT) AS valid,
 CAST(count(*) FILTER (WHERE o_orderkey % 4 = 2) AS INT) AS invalid FROM orders GROUP BY 1"""

_MASK_SQL = "SELECT doc_id, CASE WHEN length(value) <= 4 THEN value ELSE substr(value, 1, 2) || '...' || right(value, 2) END AS masked, CASE WHEN length(value) <= 6 THEN value ELSE substr(value, 1, 6) || '...' END AS truncated FROM"

QUERIES = {
    "kor_digits": (values(_KOREAN, digits=lambda: scalar.digits_only(scalar.digit_words_to_digits(F.col("value")))), f"SELECT doc_id, CAST(doc_id AS STRING) || '60' AS digits FROM ({_KOREAN.sql()}) AS t"),
    "rrn_checksum": (values(fx.RRN_DIGITS, valid=lambda: scalar.rrn_checksum(F.col("value"))), f"WITH b AS ({_RRN_BASE}) SELECT doc_id, CASE WHEN length(d) <> 13 THEN false ELSE (11 - ({_W}) % 11) % 10 = CAST(substr(d, 13, 1) AS INT) END AS valid FROM b"),
    "rrn_structure": (values(fx.RRN_DIGITS, valid=lambda: scalar.rrn_structure(F.col("value"))), f"WITH b AS ({_RRN_BASE}) SELECT doc_id, length(d) = 13 AND substr(d, 7, 1) BETWEEN '1' AND '8' AND try_strptime(CASE WHEN substr(d, 7, 1) IN ('1', '2', '5', '6') THEN '19' ELSE '20' END || substr(d, 1, 6), '%Y%m%d') IS NOT NULL AS valid FROM b"),
    "ssn_structure": (values(_SSN_VALUES, valid=lambda: scalar.ssn_structure(F.col("value"))), _SSN_SQL),
    "phone_structure": (values(_PHONE_VALUES, valid=lambda: scalar.phone_structure(F.col("value"))), _PHONE_SQL),
    "email_structure": (values(fx.MAILS, valid=lambda: scalar.email_structure(F.col("value"))), _MAIL_SQL),
    "ip_structure": (values(fx.ADDRESSES, valid=lambda: scalar.ip_structure(F.col("value"))), _IP_SQL),
    "an_trim": (values(_TAILS, trimmed=lambda: scalar.trim_address(F.col("value"))), f"SELECT doc_id, address AS trimmed FROM ({_TAILS.sql()}) AS t"),
    "zw_strip": (values(fx.ZERO_WIDTH, plain=lambda: scalar.strip_zero_width(F.col("text"))), f"SELECT doc_id, replace(replace(replace(text, chr(8203), ''), chr(8204), ''), chr(8288), '') AS plain FROM ({fx.ZERO_WIDTH.sql()}) AS t"),
    "zw_remap": (zw_remap, _ZW_SQL),
    "mask_match": (values(fx.MAILS, masked=lambda: scalar.mask(F.col("value")), truncated=lambda: scalar.truncate(F.col("value"), 6)), f"{_MASK_SQL} ({fx.MAILS.sql()}) AS t"),
    "request_id": (documents(request_id=lambda: scalar.request_id(F.col("text"))), "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'empty' ELSE substr(md5(text), 1, 8) END AS request_id FROM documents"),
    "digit_ratio": (documents(digits=lambda: F.regexp_count(F.col("text"), F.lit(r"\d")), ratio=lambda: F.round(scalar.digit_ratio(F.col("text")), 9)), "SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS INT) AS digits, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) / length(text) END, 9) AS ratio FROM documents"),
    "row_signature": (values(_ROWS, signature=lambda: scalar.row_signature(F.col("value")), tokens=lambda: scalar.token_count(F.col("value"))), _ROWS_SQL),
    "line_at": (values(_LINES, line=lambda: scalar.line_index(F.col("value"), F.col("place")), line_text=lambda: scalar.line_at(F.col("value"), F.col("place"))), _LINES_SQL),
    "html_escape": (values(_HTML, escaped=lambda: scalar.escape_html(F.col("value"))), _HTML_SQL),
    "score_colour": (values(_SCORES, colour=lambda: tools.colour(F.col("value"))), _COLOUR_SQL),
    "keyword_norm": (values(_SCORES, keyword=lambda: scalar.keyword_norm(F.floor(F.col("value")), 4), embedded=lambda: scalar.embedding_norm(F.col("value"))), f"SELECT doc_id, greatest(-1.0, least(1.0, floor(value) / 4)) AS keyword, greatest(-1.0, least(1.0, value / 2)) AS embedded FROM ({_SCORES.sql()}) AS t"),
    "flatten_spans": (flatten_spans, _FLAT_SQL),
    "highlight": (highlight, _HIGHLIGHT_SQL),
    "rrn_batch": (rrn_batch, _BATCH_SQL),
    "span_remap": (lambda spark, sf_dir: fx.ZERO_WIDTH.df(spark, sf_dir).select("doc_id", F.size(spans.kept_positions(F.col("text"), scalar.ZERO_WIDTH)).alias("kept")), f"SELECT doc_id, CAST(length(text) - 3 AS INT) AS kept FROM ({fx.ZERO_WIDTH.sql()}) AS t"),
}
