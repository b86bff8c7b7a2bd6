from pyspark.sql import functions as F

from spanforge.operators import chunks, context, detect, tools
from spanforge.plans import rules
from spanforge.queries import contexts
from spanforge.streaming.detect import detect_stream, write_spans


def _found(spark, texts, **options):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    out = {}
    for r in detect.detect_spans(docs, ["doc_id"], **options).collect():
        out.setdefault(r.doc_id, set()).add((r.type, r.matchString))
    return [out.get(k, set()) for k in range(len(texts))]


def test_samples(spark):
    texts = [
        "연락처는 010.1234.1258 입니다.", "주민번호 900101-1234568", "ssn 123-45-6789, mail a.b@example.org and 10.1.2.3", "여권 M12345678", "면허 11-22-333333-44",
        "서울특별시 강남구 테헤란로 123-4 연락처: 1", None, "", "no entity here",
    ]
    assert _found(spark, texts) == [
        {("MN", "010.1234.1258")}, {("SN", "900101-1234568")}, {("SSN", "123-45-6789"), ("EML", "a.b@example.org"), ("IP", "10.1.2.3")}, {("PN", "M12345678")}, {("DN", "11-22-333333-44")},
        {("AN", "서울특별시 강남구 테헤란로 123-4")}, set(), set(), set(),
    ]


def test_an_invalid_number_may_come_back_as_an_account(spark):
    text = "번호 900101-1234567"
    assert _found(spark, [text]) == [{("BN", "900101-1234567")}]
    assert _found(spark, [text], include_invalid=True) == [{("SN_INVALID", "900101-1234567")}]
    long = spark.createDataFrame([("SN_INVALID", 1), ("BN_CTX_REJECTED", 1), ("SN", 1)], "type string, n int")
    assert [r.type for r in detect.prune(long).collect()] == ["SN"]


def test_an_address_before_a_full_stop_is_no_match(spark):
    assert _found(spark, ["mail a@b.co.", "mail a@b.co,"]) == [set(), {("EML", "a@b.co")}]


def test_signs_behind_an_address_end_it(spark):
    texts = ["mail a@b.co%%% x", "a@b.co_", "a@b.co+1", "a@b.co%.", "a@b.co1%", "a@b.co-%", "%a@b.co%"]
    assert _found(spark, texts) == [{("EML", "a@b.co")}] * 4 + [set()] * 3


def test_strict_ruleset_and_limit(spark):
    assert _found(spark, ["계좌 11012345678901", "계좌 110-1234-5678901"], ruleset="strict") == [set(), {("BN", "110-1234-5678901")}]
    assert [len(x) for x in _found(spark, ["a@b.co c@d.co e@f.co"], limit=2)] == [2]
    assert _found(spark, ["call 0.0.0.0 now"], strict_structure=True) == [set()]


def test_meta_and_counts(spark):
    bundle = rules.load()
    docs = detect.counts(detect.with_meta(detect.detect(spark.createDataFrame([("a@b.co",)], "text string"), bundle), bundle), ["EML", "IP"])
    row = docs.head()
    assert (row.EML_CNT, row.IP_CNT, row.ruleset_name, row.ruleset_version) == (1, 0, "default", bundle.version)


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"mail u{k}@example.org, 10.0.0.{k}") for k in range(20)], "doc_id int, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = detect_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), ["doc_id"])
    write_spans(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(detect.detect_spans(docs, ["doc_id"]).collect())


def _explained(spark, texts, **options):
    docs = detect.detect(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string"))
    return {(r.doc_id, r.type, r.start): r for r in context.explain_context(docs, ["doc_id"], **options).collect()}


def test_context_decisions(spark):
    found = _explained(spark, [
        "passport M12345678", "ref M12345678", "등본 900101-1234568", "Name\tPassport\nkim\tM12345678", "a M11111111 x\nb M22222222 y\nc M33333333 z", "a M11111111 x\n\nb M22222222 y",
    ])
    by = {k[0]: (r.context_accept_by, r.context_pass, round(r.context_hybrid_score or 0, 6)) for k, r in found.items() if k[0] not in (4, 5)}
    assert by == {0: ("hybrid", True, 0.8), 1: ("hybrid", False, 0.1), 2: ("force_phrase", True, 0), 3: ("hybrid", True, 1.2)}
    assert found[3, "PN", 18].context_header_hint == "Passport"
    runs = [r for k, r in found.items() if k[0] == 4]
    assert len(runs) == 3 and all(r.context_accept_by == "hybrid_base" and r.context_repeat_bonus == 0.35 and r.context_repeat_unique_count == 3 for r in runs)
    assert all(r.context_repeat_bonus == 0 and not r.context_pass for k, r in found.items() if k[0] == 5)
    kept = context.keep_in_context(detect.detect(spark.createDataFrame([(0, "ref M12345678 a@b.co")], "doc_id int, text string")), ["doc_id"]).collect()
    assert [(r.type, r.matchString) for r in kept] == [("EML", "a@b.co")]


def test_bank_bonus(spark):
    found = _explained(spark, ["First bank 123-456-789012"], banks=[("First", [r"\d{3}-\d{3}-\d{6}"])])
    (row,) = found.values()
    assert row.bank_bonus == 0.25 and row.context_accept_by == "hybrid_base" and round(row.context_hybrid_score, 6) == 0.45


def test_embedding_mode_and_its_fallback(spark):
    import numpy as np

    def embedder(texts):
        return np.array([[1.0, 0.0] if "passport" in t.lower() or "여권" in t else [0.0, 1.0] for t in texts])

    texts = ["passport M12345678", "ref M12345678"]
    found = _explained(spark, texts, method="embed", embedder=embedder)
    scores = {k[0]: (r.context_method, r.context_score, r.context_score_norm) for k, r in found.items()}
    assert scores == {0: ("embed", 1.0, 0.5), 1: ("embed", 0.0, 0.0)}
    assert {r.context_method for r in _explained(spark, texts, method="embed").values()} == {"keyword"}


def test_long_texts(spark):
    text = ("word " * 30 + "a@b.co\n") * 60
    docs = spark.createDataFrame([(1, text), (2, "x" * 2500), (3, None), (4, "c@d.co")], "doc_id int, text string")
    ranges = {r.doc_id: [tuple(x) for x in r.r or []] for r in docs.select("doc_id", chunks.split_ranges(F.col("text"), 1000, 100).alias("r")).collect()}
    assert ranges[2] == [(0, 1000), (900, 1900), (1800, 2500)] and ranges[4] == [(0, 6)] and not ranges[3]
    assert all(b - a <= 1000 for a, b in ranges[1]) and ranges[1][-1][1] == len(text) and all(text[b - 1] == "\n" for _, b in ranges[1])
    found = detect.detect_spans(chunks.explode_chunks(docs, chunk=1000, overlap=100), ["doc_id", "chunk_start"])
    merged = chunks.merge_chunks(found, ["doc_id"])
    whole = detect.detect_spans(docs, ["doc_id"])
    assert sorted(map(tuple, merged.select("doc_id", "type", "start", "end").collect())) == sorted(map(tuple, whole.select("doc_id", "type", "start", "end").collect()))
    assert chunks.merge_chunks(found, ["doc_id"], 5).where("doc_id = 1").count() == 5
    fast = chunks.fast_path(detect.detect(docs), ["EML", "AN"], at_least=2000, limit=3).orderBy("doc_id").select(F.size("EML")).collect()
    assert [r[0] for r in fast] == [3, 0, 0, 1]


def test_long_text_keeps_as_many_spans_as_the_reference(spark, tmp_path):
    """Texts that aren't split keep 500 spans of a type, chunks 200, documents of chunks 500."""
    mails = lambda n, gap: "".join(f"u{k}@b.co\n" + "word " * gap for k in range(n))
    docs = spark.createDataFrame([(1, mails(300, 0)), (2, mails(600, 0)), (3, mails(300, 1) + "word " * 10_000), (4, mails(1200, 20))], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = contexts.long_text(spark, str(tmp_path)).where("type = 'EML'").groupBy("doc_id").count()
    assert dict(map(tuple, found.collect())) == {1: 300, 2: 500, 3: 200, 4: 500}


def test_display(spark):
    docs = detect.detect(spark.createDataFrame([("<M12345678> 900101-1234567",)], "text string"), include_invalid=True)
    html = docs.select(tools.highlight(F.col("text"), tools.flatten({k: F.col(k) for k in ("PN", "SN_INVALID")}))).head()[0]
    assert html == '&lt;<mark class="pii pii-PN" title="PN [1,10]">M12345678</mark>&gt; <mark class="pii pii-SN_INVALID pii-sn-invalid" title="SN_INVALID [12,26]">900101-1234567</mark>'


def test_search(spark):
    docs = spark.createDataFrame([(0, "a", "x", 0.5), (1, "B q", "y", 0.4), (2, "c", "Q", 0.4), (3, "d", "", None)], "nth int, title string, content string, score double")
    assert [r.nth for r in tools.search(docs, " q ", 3).collect()] == [1, 2, 0] and [r.nth for r in tools.search(docs, "", 2).collect()] == [0, 1]


def test_sweep_takes_the_lowest_of_the_best_thresholds(spark):
    rows = spark.createDataFrame([("a", 1, 0.3), ("a", 1, 0.5), ("a", 0, 0.1), ("b", 1, 0.1), ("b", 0, 0.9), ("b", 1, None)], "type string, label int, score double")
    found = {r.type: (r.threshold, r.precision, r.recall, r.f1) for r in tools.sweep(rows, "score", 0.0, 1.0, 0.1, ["type"]).collect()}
    assert found["a"] == (0.2, 1.0, 1.0, 1.0) and found["b"][0] == 0.0 and found["b"][1:3] == (0.5, 1.0)
    (whole,) = tools.sweep(rows, "score", 0.0, 1.0, 0.1).collect()
    assert (whole.threshold, round(whole.precision, 6), whole.recall) == (0.0, 0.6, 1.0)


def test_match_scores_fall_back_to_explained_spans(spark):
    items = spark.createDataFrame([("1", "PN", 1, "M1"), ("2", "BN", 0, "9")], "id string, type string, label int, match string")
    schema = "id string, type string, start int, end int, matchString string, context_score_norm double, context_hybrid_score double"
    found = spark.createDataFrame([("1", "PN", 0, 2, "M1", 0.1, 0.2), ("1", "PN", 5, 7, "M1", 0.9, 0.9)], schema)
    explained = spark.createDataFrame([("2", "BN", 0, 1, "9", 0.3, 0.4)], schema)
    assert {r.id: (r.context_score_norm, r.context_hybrid_score) for r in tools.match_scores(items, found, explained).collect()} == {"1": (0.1, 0.2), "2": (0.3, 0.4)}


def test_observed_and_defaults(spark):
    from spanforge.sources import formats

    docs, watch = detect.observed(detect.detect(spark.createDataFrame([("a@b.co",), ("c@d.co e@f.co",)], "text string")), "spans", ["EML"])
    docs.collect()
    assert watch.get == {"rows": 2, "EML": 3}
    kind = "start int, end int, matchString string, isValid boolean, context_score double, context_score_norm double, context_hybrid_score double, context_method string, context_accept_by string, context_pass boolean, detected_by string"
    rows = spark.createDataFrame([([(0, 1, "x", None, 0.5, None, None, None, None, None, None)],)], f"s array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
    (item,) = rows.select(formats.with_defaults(F.col("s"))).head()[0]
    assert (item.isValid, item.context_score, item.context_method, item.context_pass) == (False, 0.5, "", False)
