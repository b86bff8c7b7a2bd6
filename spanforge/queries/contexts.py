"""Context, long-text and evaluation queries, each with SQL where the semantics can be written as such."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, spans
from ..operators import chunks, context, detect, tools
from ..plans import rules
from ..sources import fixtures as fx
from ..sources import formats
from . import scans


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans.sentences(F.col("text"))
    return _read(spark, sf_dir, "documents").withColumn("s", s).select("doc_id", F.size("s").alias("sentences"), F.aggregate("s", F.lit(0), lambda a, x: a + x["end"] - x["start"]).alias("chars"), F.coalesce(F.try_element_at("s", F.lit(2))["matchString"], F.lit("")).alias("second"))


_SENTENCES_SQL = r"""WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|\n+|$)') AS l FROM documents),
f AS (SELECT doc_id, CASE WHEN len(l) = 0 AND text <> '' THEN [text] ELSE l END AS l FROM s)
SELECT doc_id, CAST(len(l) AS INT) AS sentences, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS INT) AS chars, coalesce(l[2], '') AS second FROM f"""

#: Seven numbered sentences, a span in the k-th.
_SEVEN = fx.derived("customer", "", ("k AS doc_id", "CAST(k % 7 AS INT) AS n", "'S0 aa. S1 aa. S2 aa. S3 aa. S4 aa. S5 aa. S6 aa.' AS text"), ("doc_id", "n", "text", "CAST(n * 7 + 1 AS INT) AS s"))


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _SEVEN.df(spark, sf_dir).withColumn("b", spans.context_bounds(spans.sentences(F.col("text")), F.col("s"), F.col("s") + 2, 1))
    return docs.select("doc_id", F.col("b")["start"].alias("window_start"), F.col("b")["end"].alias("window_end"))


_WINDOW_SQL = f"SELECT doc_id, CAST(CASE WHEN n <= 1 THEN 0 ELSE 7 * (n - 1) - 1 END AS INT) AS window_start, CAST(CASE WHEN n >= 5 THEN 48 ELSE 7 * (n + 1) + 6 END AS INT) AS window_end FROM ({_SEVEN.sql()}) AS t"


def clip_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _SEVEN.df(spark, sf_dir).select("doc_id", spans.clip_around(F.col("text"), F.lit(0), F.col("s"), F.col("s") + 2, 10).alias("clipped"))


_CLIP_SQL = f"SELECT doc_id, substr(text, CAST(least(length(text) - 10, greatest(0, s + 1 - 5)) AS INT) + 1, 10) AS clipped FROM ({_SEVEN.sql()}) AS t"


def label_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _SEVEN.df(spark, sf_dir).select("doc_id", context.label_window(F.col("text"), F.col("s"), F.col("s") + 2, 8).alias("window_text"))


_LABEL_SQL = f"SELECT doc_id, substr(text, greatest(0, s - 8) + 1, least(length(text), s + 10) - greatest(0, s - 8)) AS window_text FROM ({_SEVEN.sql()}) AS t"


def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase scores of every document for the passport type's phrases and four everyday words."""
    return _read(spark, sf_dir, "documents").select("doc_id", scalar.keyword_score(F.col("text"), ["the", "passport", "license"], ["und", "que"]).alias("score"))


_KEYWORD_SQL = "SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ("the", "passport", "license")) + " - " + " - ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ("und", "que")) + " AS score FROM documents"


def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = context.settings(rules.load().context, "PN")
    docs = detect.detect(fx.PN.df(spark, sf_dir)).select("doc_id", "text", F.inline("PN"))
    option = lambda name, default: F.lit(options["hybrid"].get(name, default))
    near = context.label_window(F.col("text"), F.col("start"), F.col("end"), option("label_window", 12))
    score = context.rule_score(near, F.col("matchString"), F.lit(""), F.lit(context.label_pattern(options["labels"])), option)
    return docs.select("doc_id", F.round(score, 6).alias("score"))


_RULE_SQL = f"SELECT doc_id, 0.55 AS score FROM ({fx.PN.sql()}) AS t WHERE doc_id % 4 < 2".replace("0.55", "CAST(0.55 AS DOUBLE)")


def _table_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passports of small tables with their line, their place in it and the lines above."""
    docs = context.with_lines(detect.detect(fx.TABLES.df(spark, sf_dir)).select("doc_id", "text", "PN"))
    rows = docs.select("doc_id", "lines", "line_starts", F.inline("PN")).withColumn("line", context.line_of(F.col("start")))
    place = F.col("start") - F.element_at("line_starts", F.col("line") + 1)
    return rows.select("doc_id", F.element_at("lines", F.col("line") + 1).alias("line_text"), place.alias("line_place"), context.lines_above(F.col("line")).alias("above"))


def header_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.with_header(_table_spans(spark, sf_dir), None, whole_line=False).select("doc_id", F.col("header_hint").alias("hint"))


_HINT_SQL = f"SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'Passport No' ELSE 'Passport' END AS hint FROM ({fx.TABLES.sql()}) AS t"


def header_line_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table_spans(spark, sf_dir).withColumn("above_cells", F.transform("above", context.cells))
    return rows.select("doc_id", context.line_header(F.col("above"), F.col("above_cells"), F.lit("(?iU)passport")).alias("hint"))


_LINE_HINT_SQL = f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Name' || chr(9) || 'Passport' || chr(9) || 'Total' WHEN 1 THEN 'Name   Passport No   Total' ELSE 'Name Passport' END AS hint FROM ({fx.TABLES.sql()}) AS t"

#: Table rows as measured: an order is a document, its lines have one of three shapes and may stand on one line.
_MEASURED = fx.Derived("lineitem", (("l_orderkey AS doc_id", "'BN' AS type", "CAST(l_linenumber * 1000000 + l_partkey AS INT) AS start", "CAST(l_linenumber + l_partkey % 3 AS INT) AS line", "CASE l_suppkey % 3 WHEN 0 THEN '<NUM> <TXT>' WHEN 1 THEN '<TXT>' ELSE '<NUM>' END AS signature", "CAST(1 + l_suppkey % 2 AS INT) AS tokens", "CAST(l_partkey % 5 AS STRING) AS value"),))


def repeat_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = rules.load().context["hybrid"]
    rows = context.with_repeats(_MEASURED.df(spark, sf_dir), ["doc_id", "type"], lambda name, default: F.lit(options.get(name, default)))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("repeat_bonus") > 0).alias("bonuses"), F.round(F.sum("repeat_ratio"), 6).alias("ratios"), F.max("unique_count").alias("unique_count"))


_REPEAT_SQL = f"""WITH r AS (SELECT *, CASE WHEN tokens >= 2 AND signature <> '' THEN signature END AS sig FROM ({_MEASURED.sql()}) AS t),
a AS (SELECT *, count(sig) OVER (PARTITION BY doc_id, sig) AS c, count(sig) OVER (PARTITION BY doc_id) AS n,
 CASE WHEN line = lag(line) OVER (PARTITION BY doc_id, sig ORDER BY line, start) + 1 THEN 0 ELSE 1 END AS opens FROM r),
b AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, sig ORDER BY line, start ROWS UNBOUNDED PRECEDING) AS island FROM a),
d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sig, island) AS run FROM b),
e AS (SELECT doc_id, value, sig IS NOT NULL AND c >= 2 AND run >= 2 AS bonus, c / n AS ratio FROM d)
SELECT doc_id, count(*) FILTER (WHERE bonus) AS bonuses, round(sum(CASE WHEN bonus THEN ratio ELSE 0.0 END), 6) AS ratios, CAST(count(DISTINCT value) AS INT) AS unique_count FROM e GROUP BY doc_id"""


def repeat_same_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.with_repeats(_MEASURED.df(spark, sf_dir), ["doc_id", "type"], lambda name, default: F.lit(default))
    return rows.where(F.col("value_count") >= 2).select("doc_id", "value", "value_count").distinct()


_SAME_SQL = f"SELECT doc_id, value, count(*) AS value_count FROM ({_MEASURED.sql()}) AS t GROUP BY doc_id, value HAVING count(*) >= 2"


def force_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", scalar.first_phrase(F.col("text"), ["GNU General", "Apache License", "the "]).alias("phrase"))


_FORCE_SQL = "SELECT doc_id, CASE WHEN contains(lower(text), 'gnu general') THEN 'GNU General' WHEN contains(lower(text), 'apache license') THEN 'Apache License' WHEN contains(lower(text), 'the ') THEN 'the ' ELSE '' END AS phrase FROM documents"

#: A small dictionary of the shape that `rules.bank_patterns` reads from a file.
BANKS = [("First", [r"\d{3}[-\s]?\d{3}[-\s]?\d{6}"]), ("계좌", [r"\d{6}-\d{2}-\d{6}"])]


def bank_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = detect.detect(fx.BN.df(spark, sf_dir)).select("doc_id", "text", F.inline("BN"))
    return docs.select("doc_id", context.bank_bonus(F.col("text"), F.col("matchString"), BANKS, 0.25).alias("bonus"))


_BANK_SQL = "SELECT c_custkey AS doc_id, CAST(CASE WHEN c_custkey % 6 = 1 THEN 0.25 ELSE 0.0 END AS DOUBLE) AS bonus FROM customer WHERE c_custkey % 6 < 4"


def context_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected passport and account spans with what decided."""
    docs = detect.detect(fx.PN.df(spark, sf_dir))
    rows = context.explain_context(docs, ["doc_id"]).where("type = 'PN'")
    return rows.select("doc_id", "context_accept_by", "context_pass", F.round("context_score_norm", 6).alias("norm"), F.round("context_hybrid_score", 6).alias("hybrid"))


#: passport: one of four phrases, label and digits; 여권: one of four phrases, label and digits.
_LADDER_SQL = f"SELECT doc_id, 'hybrid' AS context_accept_by, true AS context_pass, CAST(0.25 AS DOUBLE) AS norm, CAST(0.8 AS DOUBLE) AS hybrid FROM ({fx.PN.sql()}) AS t WHERE doc_id % 4 < 2"

_BARE = fx.derived("customer", "", ("k AS doc_id", f"CASE k % 3 WHEN 0 THEN 'ref M' || {fx.pad('k', 8)} || ' only' WHEN 1 THEN '면허 11-22-' || {fx.pad('k', 6)} || '-33' ELSE 'test sample 11-22-' || {fx.pad('k', 6)} || '-33' END AS text"))


def context_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.explain_context(detect.detect(_BARE.df(spark, sf_dir)), ["doc_id"])
    return rows.where(~F.col("context_pass")).select("doc_id", "type", F.round("context_hybrid_score", 6).alias("hybrid"))


#: A bare passport number has digits only (0.1); a licence number with 면허 alone has digits (0.2); with test and sample 0.2 less two sixths.
_REJECTED_SQL = f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'PN' ELSE 'DN' END AS type, CAST(CASE doc_id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 ELSE round(0.2 - 2.0 / 6, 6) END AS DOUBLE) AS hybrid FROM ({_BARE.sql()}) AS t"


def embed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with that of the smallest id, as the embedding filter computes it."""
    v = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = v.orderBy("vec_id").limit(1).select(F.col("v").alias("w"))
    norm = lambda c: F.sqrt(scalar.dot(c, c))
    return v.crossJoin(F.broadcast(first)).select("vec_id", F.round(scalar.dot(F.col("v"), F.col("w")) / (norm(F.col("v")) * norm(F.col("w"))), 6).alias("score"))


_EMBED_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), w AS (SELECT v AS w FROM v ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_sum(list_transform(list_zip(v, w), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(w, lambda x: x * x)))), 6) AS score FROM v, w"""


def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 3,000 characters of every document."""
    docs = _read(spark, sf_dir, "documents").withColumn("r", chunks.split_ranges(F.col("text"), 3000, 200))
    return docs.select("doc_id", F.posexplode("r")).select("doc_id", F.col("pos").alias("nth"), F.col("col")["start"].alias("range_start"), F.col("col")["end"].alias("range_end"))


_SPLIT_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
r AS (SELECT doc_id, text, n, 0 AS nth, 0 AS s, CAST(NULL AS BIGINT) AS e FROM d
 UNION ALL SELECT doc_id, text, n, nth + 1, e2 - 200, NULL FROM (SELECT *, s + CASE WHEN s + 3000 < n AND cut > 1000 THEN cut + CASE WHEN cut = para THEN 2 ELSE 1 END ELSE least(n, s + 3000) - s END AS e2 FROM
  (SELECT *, CASE WHEN para > 0 THEN para ELSE line END AS cut FROM (SELECT *, coalesce(length(b) - strpos(reverse(b), chr(10) || chr(10)) - 1, -1) * CASE WHEN contains(b, chr(10) || chr(10)) THEN 1 ELSE 0 END - CASE WHEN contains(b, chr(10) || chr(10)) THEN 0 ELSE 1 END AS para,
   CASE WHEN contains(b, chr(10)) THEN length(b) - strpos(reverse(b), chr(10)) ELSE -1 END AS line FROM (SELECT *, substr(text, s + 1, least(n, s + 3000) - s) AS b FROM r) AS x) AS y) AS z) AS q WHERE e2 < n),
f AS (SELECT doc_id, nth, s, s + CASE WHEN n <= 3000 THEN n WHEN s + 3000 < n AND cut > 1000 THEN cut + CASE WHEN cut = para THEN 2 ELSE 1 END ELSE least(n, s + 3000) - s END AS e FROM
  (SELECT *, CASE WHEN para > 0 THEN para ELSE line END AS cut FROM (SELECT *, CASE WHEN contains(b, chr(10) || chr(10)) THEN length(b) - strpos(reverse(b), chr(10) || chr(10)) - 1 ELSE -1 END AS para,
   CASE WHEN contains(b, chr(10)) THEN length(b) - strpos(reverse(b), chr(10)) ELSE -1 END AS line FROM (SELECT *, substr(text, s + 1, least(n, s + 3000) - s) AS b FROM r) AS x) AS y) AS z)
SELECT doc_id, CAST(nth AS INT) AS nth, CAST(s AS INT) AS range_start, CAST(e AS INT) AS range_end FROM f"""

_CHUNKED = fx.Derived("lineitem", (("l_orderkey AS doc_id", "'BN' AS type", "CAST(l_linenumber * 50 AS INT) AS chunk_start", "CAST(l_partkey % 100 AS INT) AS start", "CAST(l_partkey % 100 + 1 + l_suppkey % 4 AS INT) AS e"), ("doc_id", "type", "chunk_start", "start", "e", "CAST(start + chunk_start AS STRING) || '-' || CAST(e + chunk_start AS STRING) AS m")))


def merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _CHUNKED.df(spark, sf_dir).select("doc_id", "type", "chunk_start", "start", F.col("e").alias("end"), F.col("m").alias("matchString"))
    return chunks.merge_chunks(rows, ["doc_id"], 4).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("matchString").alias("match_text"))


_MERGE_SQL = f"SELECT doc_id, s AS span_start, e AS span_end, m AS match_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS r FROM (SELECT DISTINCT doc_id, CAST(start + chunk_start AS INT) AS s, CAST(e + chunk_start AS INT) AS e, m FROM ({_CHUNKED.sql()}) AS t) AS u) AS v WHERE r <= 4"


def fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails and addresses of every document; those of 50,000 characters or more keep 100 of a type at most."""
    docs = detect.detect(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = chunks.fast_path(docs, ["EML", "IP", "BN"])
    return cut.select("doc_id", F.size("EML").alias("mails"), F.size("IP").alias("ips"), ((F.length("text") >= 50_000) & (F.size("BN") > 0)).alias("has_accounts"))


_FAST_SQL = f"""WITH m AS (SELECT doc_id, count(*) AS n FROM ({scans.QUERIES['det_eml'][1]}) AS t GROUP BY doc_id), i AS (SELECT doc_id, count(*) AS n FROM ({scans.QUERIES['det_ip'][1]}) AS t GROUP BY doc_id)
SELECT d.doc_id, CAST(least(coalesce(m.n, 0), CASE WHEN length(text) >= 50000 THEN 100 ELSE 500 END) AS INT) AS mails, CAST(least(coalesce(i.n, 0), CASE WHEN length(text) >= 50000 THEN 100 ELSE 500 END) AS INT) AS ips,
 false AS has_accounts FROM documents AS d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id"""


def ruleset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.rulesets(spark).select("name", F.size("steps").alias("steps"), F.length("version").alias("version_length"))


_RULESETS_SQL = "SELECT * FROM (VALUES ('default', CAST(12 AS INT), CAST(16 AS INT)), ('strict', CAST(11 AS INT), CAST(16 AS INT))) AS t(name, steps, version_length)"


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content fingerprints of the library's rulesets."""
    return spark.createDataFrame([(b.name, b.version) for b in rules.list_rulesets()], "name string, version string")


_FINGERPRINT_SQL = " UNION ALL ".join(f"SELECT '{b.name}' AS name, substr(sha256(string_agg(parse_filename(filename) || chr(10) || content || chr(10) || chr(10), '' ORDER BY filename)), 1, 16) AS version FROM read_text({sorted(b.mtimes)!r})" for b in rules.list_rulesets())


def step_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts if phones are scanned behind the filter that would part them, beside a step that only this query knows."""
    def marked(df: DataFrame, text, columns: dict[str, str]) -> DataFrame:
        columns["WORD"] = "WORD"
        return df.withColumn("WORD", spans.scan(text, "id|card"))

    bundle = replace(rules.load(), steps=["BN", "post_bn", "MN", "word", "unknown"])
    docs = detect.detect(fx.BN.df(spark, sf_dir), bundle, custom={"word": marked})
    return docs.select("doc_id", F.size("WORD").alias("words"), F.inline_outer("BN")).select("doc_id", "words", F.col("matchString").alias("match_text"))


_STEP_SQL = f"""WITH b AS ({scans.positional(fx.BN.sql(), scans._BN, "[0-9]", "[^0-9]", fold=True)}), k AS (SELECT doc_id, match_text FROM b WHERE length(regexp_replace(match_text, '[^0-9]', '', 'g')) BETWEEN 10 AND 14)
SELECT t.doc_id, CAST(contains(text, 'card') AS INT) + CAST(contains(text, 'id') AS INT) AS words, match_text FROM ({fx.BN.sql()}) AS t LEFT JOIN k ON k.doc_id = t.doc_id"""

#: Runs of capitals that are longer than the limit of five.
_RUNS = fx.derived("customer", "", ("k AS doc_id", "CAST(k % 17 AS INT) AS a", "CAST(k % 7 AS INT) AS b"), ("doc_id", "a", "b", "repeat('A', a) || ' x ' || repeat('B', b) AS text"))


def cursor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that are too long are cut, and the scan goes on behind the cut."""
    found = spans.scan_longest(F.col("text"), ["[A-Z]+"], "[A-Z]+", max_len=5, cut=True)
    return _RUNS.df(spark, sf_dir).select("doc_id", F.inline(found)).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("matchString").alias("match_text"))


_CURSOR_SQL = f"""WITH r AS (SELECT doc_id, text, a, b FROM ({_RUNS.sql()}) AS t), p AS (SELECT doc_id, text, unnest(range(0, a, 5)) AS s, a AS e FROM r UNION ALL SELECT doc_id, text, a + 3 + unnest(range(0, b, 5)), a + 3 + b FROM r)
SELECT doc_id, CAST(s AS INT) AS span_start, CAST(least(s + 5, e) AS INT) AS span_end, substr(text, CAST(s + 1 AS INT), CAST(least(5, e - s) AS INT)) AS match_text FROM p"""

_BROKEN = fx.derived("customer", "", ("k AS doc_id", "'x <ab' || chr(10) || '  cd ' || CAST(k AS STRING) || '  ' || chr(10) || chr(10) || 'e> y' AS text"))


def newline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans over several lines as trimmed spans of one line each."""
    found = spans.split_lines(spans.scan(F.col("text"), "<[^>]*>"))
    return _BROKEN.df(spark, sf_dir).select("doc_id", F.inline(found)).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("matchString").alias("match_text"))


_BROKEN_SQL = f"""WITH t AS (SELECT doc_id, text, string_split(regexp_extract(text, '<[^>]*>'), chr(10)) AS l FROM ({_BROKEN.sql()}) AS t), p AS (SELECT doc_id, text, trim(unnest(l)) AS m FROM t)
SELECT doc_id, CAST(strpos(text, m) - 1 AS INT) AS span_start, CAST(strpos(text, m) - 1 + length(m) AS INT) AS span_end, m AS match_text FROM p WHERE m <> ''"""


def self_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each type in the example text."""
    docs = detect.detect(spark.createDataFrame([(1, detect.SELF_TEST)], "doc_id int, text string"), include_invalid=True)
    long = detect.long_form(docs, ["doc_id"], [k for k in docs.columns if k not in ("doc_id", "text")])
    return long.groupBy("type").agg(F.count("*").alias("n"), F.min("matchString").alias("found"))


#: The number in the example has a false check digit; its date is one.
_SELF_SQL = "SELECT CASE t WHEN 'SN' THEN 'SN_INVALID' ELSE t END AS type, CAST(1 AS BIGINT) AS n, m AS found FROM (SELECT unnest(['DN', 'PN', 'MN', 'SSN', 'EML', 'IP', 'SN', 'AN']) AS t, unnest(['11-22-333333-44', 'M12345678', '010-1234-5678', '123-45-6789', 'test.user+aa@company.co.kr', '192.168.0.10', '900101-1234567', '서울특별시 강남구 테헤란로 123-4']) AS m) AS x"


def list_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types named in comma-separated lists, each once."""
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(scalar.distinct_list(F.concat_ws(",", F.replace("p_type", F.lit(" "), F.lit(" , ")), F.lit(" ,"), F.replace(F.lower("p_type"), F.lit(" "), F.lit(",")))), "|").alias("items"))


_LIST_SQL = "SELECT p_partkey, list_aggregate(list_transform(list_sort(list_transform(list_distinct(l), lambda x: {'at': list_position(l, x), 'x': x})), lambda y: y.x), 'string_agg', '|') AS items FROM (SELECT p_partkey, string_split(upper(p_type), ' ') AS l FROM part) AS t"


def context_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and rejected spans of each type over passports and bare numbers."""
    docs = fx.PN.df(spark, sf_dir).unionByName(_BARE.df(spark, sf_dir).select((-F.col("doc_id")).alias("doc_id"), "text"))
    return detect.context_totals(context.explain_context(detect.detect(docs), ["doc_id"]))


_TOTALS_SQL = "SELECT 'PN' AS type, count(*) FILTER (WHERE c_custkey % 4 < 2) AS kept, count(*) FILTER (WHERE c_custkey % 3 = 0) AS rejected FROM customer UNION ALL SELECT 'DN', 0, count(*) FILTER (WHERE c_custkey % 3 > 0) FROM customer"

#: One text for each of the decisions that a passport or resident number can meet.
_DECIDED = fx.derived("customer", "", ("k AS doc_id", f"{fx.pad('k % 10000', 4)} AS d"), ("doc_id", """CASE doc_id % 4 WHEN 0 THEN '등본 900101-1234568' WHEN 1 THEN 'a M1111' || d || ' x' || chr(10) || 'b M2222' || d || ' y' || chr(10) || 'c M3333' || d || ' z'
 WHEN 2 THEN 'ref M1111' || d ELSE 'passport M1111' || d END AS text"""))


def context_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that a phrase, a run of equal rows or labels and digits let pass, and spans that nothing does."""
    rows = context.explain_context(detect.detect(_DECIDED.df(spark, sf_dir)), ["doc_id"]).where("type IN ('SN', 'PN')")
    return rows.groupBy("doc_id", "type", "context_accept_by", "context_pass").agg(F.count("*").alias("n"), F.round(F.max("context_hybrid_score"), 6).alias("hybrid"), F.max("context_repeat_bonus").alias("bonus"))


#: Digits 0.1; the repeat bonus 0.35 lets a run pass before labels count; passport: one of four phrases, label 0.45 and digits.
_DECIDED_SQL = f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'SN' ELSE 'PN' END AS type, CASE doc_id % 4 WHEN 0 THEN 'force_phrase' WHEN 1 THEN 'hybrid_base' ELSE 'hybrid' END AS context_accept_by, doc_id % 4 <> 2 AS context_pass,
 CAST(CASE doc_id % 4 WHEN 1 THEN 3 ELSE 1 END AS BIGINT) AS n, CAST(CASE doc_id % 4 WHEN 1 THEN 0.35 WHEN 2 THEN 0.1 WHEN 3 THEN 0.8 END AS DOUBLE) AS hybrid, CAST(CASE doc_id % 4 WHEN 1 THEN 0.35 ELSE 0 END AS DOUBLE) AS bonus FROM ({_DECIDED.sql()}) AS t"""


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("nth"), F.col("p_name").alias("title"), F.col("p_type").alias("content"), (F.col("p_retailprice") % 1).alias("score"))
    return tools.search(parts, "STEEL", 25).select("nth", F.round("ranked", 6).alias("ranked"))


_SEARCH_SQL = "SELECT p_partkey AS nth, round(p_retailprice % 1 + CASE WHEN contains(lower(p_name || ' ' || p_type), 'steel') THEN 0.2 ELSE 0.0 END, 6) AS ranked FROM part ORDER BY p_retailprice % 1 + CASE WHEN contains(lower(p_name || ' ' || p_type), 'steel') THEN 0.2 ELSE 0.0 END DESC, nth LIMIT 25"

_EVAL = fx.Derived("lineitem", (("l_returnflag AS type", "CASE WHEN (l_quantity + l_partkey % 17) > 30 THEN 1 ELSE 0 END AS label", "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 50 - 0.1 END AS score"),))


def eval_sweep(by: list[str]):
    return lambda spark, sf_dir: tools.sweep(_EVAL.df(spark, sf_dir), "score", -0.2, 0.8, 0.01, by).select(*by, *[F.round(c, 9).alias(c) for c in ("threshold", "precision", "recall", "f1")])


def _sweep_sql(by: str) -> str:
    group = f"{by}, " if by else ""
    return f"""WITH e AS (SELECT * FROM ({_EVAL.sql()}) AS t WHERE score IS NOT NULL), g AS (SELECT round(-0.2 + k * 0.01, 4) AS threshold FROM range(101) AS r(k)),
c AS (SELECT {group} threshold, sum(CASE WHEN score >= threshold THEN label ELSE 0 END) AS tp, count(*) FILTER (WHERE score >= threshold) AS chosen, sum(label) AS positive FROM e, g GROUP BY {group} threshold),
m AS (SELECT {group} threshold, CASE WHEN chosen = 0 THEN 0.0 ELSE tp / chosen END AS p, CASE WHEN positive = 0 THEN 0.0 ELSE tp / positive END AS r FROM c),
f AS (SELECT {group} threshold, p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM m),
b AS (SELECT *, row_number() OVER ({f'PARTITION BY {by}' if by else ''} ORDER BY f DESC, threshold) AS n FROM f)
SELECT {group} CAST(round(threshold, 9) AS DOUBLE) AS threshold, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM b WHERE n = 1"""


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = tools.latency(_read(spark, sf_dir, "events"), "value", ["event_type"])
    return figures.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most", "p50", "p95", "p99")])


_LATENCY_SQL = "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type"


def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.status_histogram(_read(spark, sf_dir, "orders"), "o_orderstatus")


def long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents by way of chunks, as one table: a document keeps the ruleset's number of spans of a type (500),
    a chunk of a text of 50,000 characters or more 200 of them."""
    bundle = rules.load()
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", (F.length("text") >= 50_000).alias("split"))
    parts = chunks.explode_chunks(docs, chunk=50_000, overlap=2_000)
    found = [detect.detect_spans(parts.where(of), ["doc_id", "chunk_start"], bundle, limit=limit) for of, limit in (("not split", bundle.limit), ("split", min(200, bundle.limit)))]
    return chunks.merge_chunks(found[0].unionByName(found[1]), ["doc_id"], bundle.limit).select("doc_id", "type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("matchString").alias("match_text"))


def embed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding filter with a deterministic embedder that hashes letters."""
    def letters(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 32))
        for k, t in enumerate(texts):
            np.add.at(out[k], [ord(c) % 32 for c in t.lower() if not c.isspace()] or [0], 1.0)
        return out

    docs = detect.detect(fx.PN.df(spark, sf_dir))
    return context.explain_context(docs, ["doc_id"], method="embed", embedder=letters).select("doc_id", "type", "context_method", "context_pass", F.round("context_score", 6).alias("score"))


QUERIES = {
    "sentence_split": (sentence_split, _SENTENCES_SQL), "context_window": (context_window, _WINDOW_SQL), "clip_snippet": (clip_snippet, _CLIP_SQL), "label_window": (label_window, _LABEL_SQL),
    "keyword_score": (keyword_score, _KEYWORD_SQL), "rule_score": (rule_score, _RULE_SQL), "header_hint": (header_hint, _HINT_SQL), "header_line_hint": (header_line_hint, _LINE_HINT_SQL),
    "repeat_bonus": (repeat_bonus, _REPEAT_SQL), "repeat_same_match": (repeat_same_match, _SAME_SQL), "force_phrase": (force_phrase, _FORCE_SQL), "bank_bonus": (bank_bonus, _BANK_SQL),
    "context_ladder": (context_ladder, _LADDER_SQL), "context_rejected": (context_rejected, _REJECTED_SQL), "embed_score": (embed_score, _EMBED_SQL), "embed_filter": (embed_filter, None),
    "split_ranges": (split_ranges, _SPLIT_SQL), "merge_chunks": (merge_chunks, _MERGE_SQL), "fast_path": (fast_path, _FAST_SQL), "long_text": (long_text, None),
    "step_order": (step_order, _STEP_SQL), "cursor_scan": (cursor_scan, _CURSOR_SQL), "newline_split": (newline_split, _BROKEN_SQL), "self_test": (self_test, _SELF_SQL),
    "list_dedup": (list_dedup, _LIST_SQL), "context_totals": (context_totals, _TOTALS_SQL), "context_decisions": (context_decisions, _DECIDED_SQL),
    "ruleset_list": (ruleset_list, _RULESETS_SQL), "fingerprint": (fingerprint, _FINGERPRINT_SQL), "search_topk": (search_topk, _SEARCH_SQL),
    "eval_sweep": (eval_sweep([]), _sweep_sql("")), "eval_sweep_by_type": (eval_sweep(["type"]), _sweep_sql("type")),
    "latency_percentiles": (latency_percentiles, _LATENCY_SQL), "status_histogram": (status_histogram, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"),
}
