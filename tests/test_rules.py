import json

import pytest

from spanforge.plans import rules
from spanforge.sources import formats


def test_lookup_and_versions(tmp_path):
    assert rules.load("default").steps[-1] == "post_context" and "post_context" not in rules.load("strict").steps
    assert rules.load("unknown").name == "default"
    (tmp_path / "_ruleset_x.json").write_text(json.dumps({"ruleset_name": "x", "steps": ["A"], "rule_files": {"a": "a.yaml"}}))
    (tmp_path / "a.yaml").write_text("macros: {N: '[0-9]', TWO: '{N}{N}'}\ntypes: {A: {patterns: ['{TWO}-{N}']}, B: {enabled: false, patterns: [x]}}\ncontext: {per_type: {A: {threshold: 2}}}\ncontext_A: {window_sentences: 5}\n")
    bundle = rules.load("x", tmp_path)
    assert bundle.types["A"].pattern == "(?U)[0-9][0-9]-[0-9]" and list(bundle.types) == ["A"] and bundle.types["A"].max_len == 240
    assert bundle.context["per_type"]["A"] == {"threshold": 2, "window_sentences": 5}
    assert rules.load("x", tmp_path, {"N": "[1-9]"}).types["A"].pattern == "(?U)[1-9][1-9]-[1-9]"
    assert not rules.stale(bundle) and len(bundle.version) == 16
    (tmp_path / "a.yaml").write_text("types: {A: {patterns: [b]}}")
    assert rules.load("x", tmp_path).version != bundle.version
    (tmp_path / "a.yaml").unlink()
    assert rules.stale(bundle)
    with pytest.raises(FileNotFoundError):
        rules.find_ruleset(tmp_path, "y")


def test_banks_and_thresholds(tmp_path, spark):
    (tmp_path / "banks.json").write_text(json.dumps({"1": {"institution": "One", "patterns": ["x"]}, "2": {"institution": "Two", "patterns": []}}))
    assert rules.bank_patterns(tmp_path / "banks.json") == [("One", ["x"])]
    (tmp_path / "context.yaml").write_text("context: {per_type: {PN: {sim_threshold: 0.1}}}")
    formats.update_thresholds(tmp_path / "context.yaml", {"PN": 0.2}, {"BN": 0.5}, 0.4)
    assert rules.read_document(tmp_path / "context.yaml")["context"] == {"per_type": {"PN": {"sim_threshold": 0.2}, "BN": {"hybrid": {"accept_threshold": 0.5}}}, "hybrid": {"accept_threshold": 0.4}}
    assert [r.name for r in formats.rulesets(spark).collect()] == ["default", "strict"]


def test_files(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps({"items": [{"id": "1", "type": "PN", "match": "M", "label": 1, "text": "t"}]}))
    assert [tuple(r) for r in formats.read_items(spark, f"{tmp_path}/items.json").collect()] == [("1", "PN", "M", 1, "t")]
    scores = spark.createDataFrame([("1", "PN", 1, "M", 0.5, None)], formats.SCORES)
    formats.write_csv(scores, f"{tmp_path}/scores")
    assert formats.read_scores(spark, f"{tmp_path}/scores").collect() == scores.collect()
    (tmp_path / "req.json").write_text('{"doc_id": "a", "text": "x"}\n')
    assert [tuple(r) for r in formats.read_requests(spark, f"{tmp_path}/req.json").collect()] == [("a", "x", 500, "default")]
    assert formats.health(spark).head().ok
