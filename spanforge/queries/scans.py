"""Scan and filter queries over derived texts, with positional SQL: each start is tried with an anchored pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, spans
from ..operators import detect
from ..plans import rules
from ..sources import fixtures as fx
from ..sources.fixtures import Derived

_OUT = ("doc_id", "span_start", "span_end", "match_text")
_D = "(?:[0-9]|공|영|일|이|삼|사|오|육|륙|칠|팔|구)"
_DC = "[0-9공영일이삼사오육륙칠팔구]"
_KOREAN = "translate(m, '공영일이삼사오육륙칠팔구', '001234566789')"


def _renamed(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("matchString").alias("match_text"))


def scan_query(key: str, base: Derived, ruleset: str = "default", invalid: bool = False):
    """Spans of one type by its rule alone."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = rules.load(ruleset).types[key]
        found = detect.detect_type(F.col("text"), rule)
        if rule.checksum:
            found = detect.valid_numbers(found, not invalid)
        return _renamed(base.df(spark, sf_dir).select("doc_id", F.inline(found)))

    return run


def table_scan(key: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = rules.load().types[key]
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return _renamed(docs.select("doc_id", F.inline(detect.detect_type(F.col("text"), rule))))

    return run


def positional(base: str, pattern: str, before: str, after: str, where: str = "true", fold: bool = False, width: int = 64) -> str:
    """SQL for spans that `pattern` has at a start not behind `before` and that `after` doesn't follow; `fold` keeps those that begin at or after the last one's end."""
    plain = f"""WITH t AS ({base}), p AS (SELECT doc_id, text, unnest(range(length(text))) AS i FROM t),
m AS (SELECT doc_id, i, text, regexp_extract(substr(text, i + 1, {width}), '^({pattern})(?:{after}|$)', 1) AS m FROM p WHERE NOT regexp_matches(substr(text, i, 1), '^{before}$') OR i = 0),
f AS (SELECT doc_id, i AS s, i + length(m) AS e, m, text FROM m WHERE m <> '' AND ({where}))
"""
    out = "SELECT doc_id, CAST(s AS INT) AS span_start, CAST(e AS INT) AS span_end, m AS match_text FROM "
    return plain + (out + "f" if not fold else fold_sql("f", "doc_id", out))


def fold_sql(source: str, key: str, out: str) -> str:
    return f""", g AS (SELECT {key}, list({{'s': s, 'e': e, 'm': m}} ORDER BY s, e DESC) AS l FROM {source} GROUP BY {key}),
h AS (SELECT {key}, list_reduce(list_transform(l, lambda x: {{'last': x.e, 'kept': [x]}}), lambda a, x: CASE WHEN x.kept[1].s >= a.last THEN {{'last': x.last, 'kept': list_concat(a.kept, x.kept)}} ELSE a END) AS r FROM g)
{out} (SELECT {key}, unnest(r.kept).s AS s, unnest(r.kept).e AS e, unnest(r.kept).m AS m FROM h) AS u"""


_RRN_DIGITS = f"regexp_replace({_KOREAN}, '[^0-9]', '', 'g')"
_RRN_OK = "((11 - (" + " + ".join(f"CAST(substr({_RRN_DIGITS}, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(scalar.RRN_WEIGHTS)) + f") % 11) % 10 = CAST(substr({_RRN_DIGITS}, 13, 1) AS INT))"
_RRN_DATE = f"(substr({_RRN_DIGITS}, 7, 1) BETWEEN '1' AND '8' AND try_strptime(CASE WHEN substr({_RRN_DIGITS}, 7, 1) IN ('1', '2', '5', '6') THEN '19' ELSE '20' END || substr({_RRN_DIGITS}, 1, 6), '%Y%m%d') IS NOT NULL)"
_SSN_OK = "substr(regexp_replace(m, '[^0-9]', '', 'g'), 1, 3) NOT IN ('000', '666') AND m[1] <> '9' AND substr(regexp_replace(m, '[^0-9]', '', 'g'), 4, 2) <> '00' AND substr(regexp_replace(m, '[^0-9]', '', 'g'), 6) <> '0000'"
_BN = r"\d{2,4}[-\s]?\d{2,6}[-\s]?\d{4,7}|\d{6}[-\s]?\d{2}[-\s]?\d{6}"
_BN_STRICT = r"\d{2,4}[-\s]+\d{2,6}[-\s]+\d{4,7}|\d{6}[-\s]+\d{2}[-\s]+\d{6}"
_MN = rf"\+(?:[1-9]\d{{0,2}})(?:[-.\s]\d{{1,4}}){{2,4}}|(?:(?:0|공|영)(?:(?:1|일)(?:0|공|영|1|일|6|육|륙|7|칠|8|팔|9|구)|(?:2|이)|(?:3|삼|4|사|5|오|6|육|륙|7|칠|8|팔|9|구){_D}))[-.\s]?{_D}{{3,4}}[-.\s]?{_D}{{4}}"

_EML_SQL = r"""WITH t AS (SELECT doc_id, text FROM documents WHERE contains(text, '@')), p AS (SELECT doc_id, text, unnest(range(length(text))) AS i FROM t),
c AS (SELECT doc_id, i, regexp_extract(substr(text, i + 1, 400), '^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+') AS m FROM p WHERE i = 0 OR NOT regexp_matches(substr(text, i, 1), '^[A-Za-z0-9._%+\-]$')),
d AS (SELECT doc_id, i, regexp_extract(m, '^([A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?:[^A-Za-z0-9._%+\-]|$)', 1) AS m FROM c WHERE m <> '')
SELECT doc_id, CAST(i AS INT) AS span_start, CAST(i + length(m) AS INT) AS span_end, m AS match_text FROM d WHERE m <> ''"""
_O = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP_SQL = rf"""WITH t AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '\d\.\d|[0-9A-Fa-f]:[0-9A-Fa-f]')), p AS (SELECT doc_id, text, unnest(range(length(text))) AS i FROM t),
m AS (SELECT doc_id, i, CASE WHEN i > 0 AND regexp_matches(substr(text, i, 1), '^[\d.]$') THEN '' ELSE regexp_extract(substr(text, i + 1, 16), '^((?:{_O}\.){{3}}{_O})(?:[^\d.]|$)', 1) END AS a,
 CASE WHEN i > 0 AND regexp_matches(substr(text, i, 1), '^[A-Fa-f0-9:]$') THEN '' ELSE regexp_extract(substr(text, i + 1, 48), '^((?:[A-Fa-f0-9]{{1,4}}:){{2,7}}[A-Fa-f0-9]{{1,4}})(?:[^A-Fa-f0-9:]|$)', 1) END AS b
 FROM p WHERE regexp_matches(substr(text, i + 1, 1), '^[0-9A-Fa-f]$')),
f AS (SELECT doc_id, i, CASE WHEN a <> '' THEN a ELSE b END AS m FROM m WHERE a <> '' OR b <> '')
SELECT doc_id, CAST(i AS INT) AS span_start, CAST(i + length(m) AS INT) AS span_end, m AS match_text FROM f"""
_AN_SQL = f"SELECT doc_id, CAST(4 AS INT) AS span_start, CAST(4 + length(address) AS INT) AS span_end, address AS match_text FROM ({fx.AN.sql()}) AS x WHERE address <> ''"


def post_mn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones after the filters, against resident numbers in the same text."""
    rule = rules.load().types
    docs = fx.PHONES.df(spark, sf_dir)
    found = detect.detect_type(F.col("text"), rule["MN"])
    numbers = detect.valid_numbers(detect.detect_type(F.col("text"), rule["SN"]))
    return _renamed(docs.select("doc_id", F.inline(detect.filter_phones(found, F.col("text"), rule["MN"], [numbers]))))


def post_bn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts after all filters of the default ruleset."""
    found = detect.detect(fx.BN.df(spark, sf_dir))
    return _renamed(found.select("doc_id", F.inline("BN")))


def _digits_of(m: str) -> str:
    return f"length(regexp_replace({m}, '[^0-9]', '', 'g'))"


_POST_BN_SQL = positional(fx.BN.sql(), _BN, "[0-9]", "[^0-9]", fold=True).replace("SELECT doc_id, CAST(s AS INT)", "SELECT doc_id, CAST(s AS INT)") + f" WHERE {_digits_of('m')} BETWEEN 10 AND 14 AND NOT (doc_id % 6 = 5 AND m[1] = '0')"


def bn_reject_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected account spans without those that overlap an accepted span; spans are rows of a table."""
    rows = fx.INTERVALS.df(spark, sf_dir).select("doc_id", "n", F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.lit("x").alias("matchString")).alias("x"))
    lists = rows.groupBy("doc_id").agg(F.collect_list(F.when(F.col("n") % 2 == 0, F.col("x"))).alias("rejected"), F.collect_list(F.when(F.col("n") % 2 == 1, F.col("x"))).alias("accepted"))
    return lists.select("doc_id", F.inline(detect.reject_cleanup(F.col("rejected"), [F.col("accepted")]))).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


_CLEAN_SQL = f"""WITH t AS ({fx.INTERVALS.sql()}), f AS (SELECT DISTINCT doc_id, s, e, '' AS m FROM t AS a WHERE n % 2 = 0 AND NOT EXISTS (SELECT 1 FROM t AS b WHERE b.doc_id = a.doc_id AND b.n % 2 = 1 AND a.s < b.e AND b.s < a.e))
""" + fold_sql("f", "doc_id", "SELECT doc_id, CAST(s AS INT) AS span_start, CAST(e AS INT) AS span_end FROM")


def _interval_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.INTERVALS.df(spark, sf_dir).select("doc_id", F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.lit("x").alias("matchString")).alias("x"))
    return rows.groupBy("doc_id").agg(F.collect_list("x").alias("found"))


def non_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval_lists(spark, sf_dir).select("doc_id", F.inline(spans.finalized(F.col("found")))).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def ui_non_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval_lists(spark, sf_dir).select("doc_id", F.inline(spans.shortest_first(F.col("found")))).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def dedup_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.INTERVALS.df(spark, sf_dir).select("doc_id", F.col("s").alias("span_start"), F.col("e").alias("span_end")).dropDuplicates()


def cap_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three spans of each document by position."""
    found = F.slice(spans.by_position(F.array_distinct("found")), 1, 3)
    return _interval_lists(spark, sf_dir).select("doc_id", F.inline(found)).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def counts_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each type over e-mail, number and account texts."""
    frames = [fx.PHONES, fx.DN, fx.PN]
    docs = frames[0].df(spark, sf_dir)
    for f in frames[1:]:
        docs = docs.unionByName(f.df(spark, sf_dir))
    long = detect.detect_spans(docs, ["doc_id"])
    return long.groupBy("type").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("documents"))


_PHONE_N = "count(*) FILTER (WHERE k % 6 < 5)"
_COUNTS_SQL = """WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT 'MN' AS type, count(*) AS spans, count(DISTINCT k) AS documents FROM c WHERE k % 6 < 5
UNION ALL SELECT 'DN', count(*), count(DISTINCT k) FROM c WHERE k % 5 < 3
UNION ALL SELECT 'PN', count(*), count(DISTINCT k) FROM c WHERE k % 4 < 2
UNION ALL SELECT 'BN', count(*), count(DISTINCT k) FROM (SELECT k FROM c WHERE k % 6 = 5 UNION ALL SELECT k FROM c WHERE k % 5 = 3) AS b"""


def prune_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = detect.detect_spans(fx.RRN.df(spark, sf_dir), ["doc_id"], include_invalid=True)
    return detect.prune(long).groupBy("type").agg(F.count("*").alias("spans"))


_PRUNE_SQL = "SELECT 'SN' AS type, count(*) AS spans FROM orders WHERE o_orderkey % 4 <> 2"

_BOUND = f"[^{_DC[1:]}"
QUERIES = {
    "det_eml": (table_scan("EML"), _EML_SQL),
    "det_ip": (table_scan("IP"), _IP_SQL),
    "det_ssn": (scan_query("SSN", fx.SSN), positional(fx.SSN.sql(), r"\d{3}-\d{2}-\d{4}|\d{9}", "[0-9]", "[^0-9]", _SSN_OK)),
    "det_sn": (scan_query("SN", fx.RRN), positional(fx.RRN.sql(), f"{_D}{{6}}-{_D}{{7}}|{_D}{{13}}", _DC, _BOUND, _RRN_OK)),
    "det_sn_invalid": (scan_query("SN", fx.RRN, invalid=True), positional(fx.RRN.sql(), f"{_D}{{6}}-{_D}{{7}}|{_D}{{13}}", _DC, _BOUND, f"NOT {_RRN_OK} AND {_RRN_DATE}")),
    "det_dn": (scan_query("DN", fx.DN), positional(fx.DN.sql(), r"\d{2}-\d{2}-\d{6}-\d{2}|\d{2}\s+\d{2}\s+\d{6}\s+\d{2}|\d{12}", "[0-9]", "[^0-9]", "regexp_matches(m, '[1-9]')")),
    "det_pn": (scan_query("PN", fx.PN), positional(fx.PN.sql(), r"[A-Za-z]{1,2}\d{7,8}", "[A-Za-z0-9]", "[^A-Za-z0-9]")),
    "det_mn": (scan_query("MN", fx.PHONES), positional(fx.PHONES.sql(), _MN, _DC, _BOUND)),
    "det_bn": (scan_query("BN", fx.BN), positional(fx.BN.sql(), _BN, "[0-9]", "[^0-9]", fold=True)),
    "det_bn_strict": (scan_query("BN", fx.BN, "strict"), positional(fx.BN.sql(), _BN_STRICT, "[0-9]", "[^0-9]", fold=True)),
    "det_an": (scan_query("AN", fx.AN), _AN_SQL),
    "post_mn": (post_mn, positional(fx.PHONES.sql(), _MN, _DC, _BOUND)),
    "post_bn": (post_bn, _POST_BN_SQL),
    "bn_reject_cleanup": (bn_reject_cleanup, _CLEAN_SQL),
    "non_overlap": (non_overlap, f"WITH f AS (SELECT DISTINCT doc_id, s, e, '' AS m FROM ({fx.INTERVALS.sql()}) AS t)" + fold_sql("f", "doc_id", "SELECT doc_id, CAST(s AS INT) AS span_start, CAST(e AS INT) AS span_end FROM")),
    "ui_non_overlap": (ui_non_overlap, (f"WITH f AS (SELECT DISTINCT doc_id, s, e, '' AS m FROM ({fx.INTERVALS.sql()}) AS t)" + fold_sql("f", "doc_id", "SELECT doc_id, CAST(s AS INT) AS span_start, CAST(e AS INT) AS span_end FROM")).replace("ORDER BY s, e DESC", "ORDER BY s, e")),
    "dedup_spans": (dedup_spans, f"SELECT DISTINCT doc_id, s AS span_start, e AS span_end FROM ({fx.INTERVALS.sql()}) AS t"),
    "cap_per_type": (cap_per_type, f"SELECT doc_id, s AS span_start, e AS span_end FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS r FROM (SELECT DISTINCT doc_id, s, e FROM ({fx.INTERVALS.sql()}) AS t) AS u) AS v WHERE r <= 3"),
    "counts_per_type": (counts_per_type, _COUNTS_SQL),
    "prune_output": (prune_output, _PRUNE_SQL),
}
