"""Context filter: scores every span of the target types by what stands around it and keeps or rejects it.

What a span needs of the text is cut out within the document's row; then spans become rows, so that each measure is a plain
expression and repeats are window functions over (document, type). No text goes through a shuffle. Decisions in order: enough equal values, a phrase
that forces acceptance, phrases plus bonuses, phrases plus bonuses plus labels, column headers and digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, spans
from ..plans import rules
from ..plans.rules import Bundle
from .detect import TYPES, long_form, typed

CELL = "struct<start:int,end:int,matchString:string>"


def settings(context: dict, key: str) -> dict:
    """The effective options of a type: the section's defaults, then the type's, its hybrid options over the section's."""
    own = context.get("per_type", {}).get(key, {})
    hybrid = {**(context.get("hybrid") or {}), **(own.get("hybrid") or {})}
    indicators = own.get("indicator_phrases") or []
    return {
        "indicators": indicators, "others": own.get("non_pii_phrases") or context.get("default_non_pii_phrases") or [],
        "threshold": own.get("threshold", context.get("threshold", 1)), "sim_threshold": own.get("sim_threshold", context.get("sim_threshold", 0.55)),
        "around": int(own.get("window_sentences", context.get("window_sentences", 2))), "max_chars": int(own.get("embed_max_chars", context.get("embed_max_chars", 256))),
        "force": own.get("force_pass_phrases") or [], "force_scope": own.get("force_pass_scope", "snippet"), "same": int(own.get("repeat_same_match_force_pass_min_count", 0)),
        "labels": (own.get("hybrid") or {}).get("label_patterns", [re.escape(x) for x in indicators]), "hybrid": hybrid,
        "banks": own.get("bank_patterns") or [], "bank_weight": own.get("bank_pattern_weight", 0.25),
    }


def label_pattern(labels: list[str]) -> str | None:
    """One Java regex that finds any of the labels."""
    return "(?U)" + "|".join(f"(?:{x})" for x in labels) if labels else None


#: A cell between tabs, between gaps of two blanks, or a single word.
_TABBED, _GAPPED, _WORD = r"(?:^|(?<=\t))[^\t]*", r"(?U)\S(?:.*?\S)?(?=\s{2,}|$)", r"(?U)\S+"


def cells(line: Column) -> Column:
    """The cells of a row with their place in it: between tabs, else between gaps of two blanks, else single words."""
    gapped = F.regexp_count(line, F.lit(_GAPPED)) >= 2
    return spans.scan_line(F.when(line.contains("\t"), spans.mark(line, _TABBED)).when(gapped, spans.mark(line, _GAPPED)).otherwise(spans.mark(line, _WORD)))


def with_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the text's lines and where each begins (lines, line_starts)."""
    docs = docs.withColumn("lines", F.split(text_col, "\n"))
    return docs.withColumn("line_starts", spans.running(F.col("lines"), lambda x: F.length(x) + 1))


def line_of(start: Column) -> Column:
    """The number of the line, from 0, that holds a position of a text `with_lines`."""
    return F.size(F.filter(F.col("line_starts"), lambda p: p <= start)) - 1


def lines_above(line: Column, most: int = 64, distance: int = 8000) -> Column:
    """Lines over a line of a text `with_lines`, nearest first: `most` at most, none that ends more than `distance` characters above."""
    begin = F.element_at("line_starts", line + 1)
    near = F.size(F.filter(F.slice(F.col("line_starts"), F.greatest(F.lit(2), line + 2 - most), F.least(line, F.lit(most))), lambda p: begin - p < distance))
    return F.reverse(F.slice(F.col("lines"), line + 1 - near, near))


def line_header(above: Column, above_cells: Column, labels: Column) -> Column:
    """The nearest line above with two header-like cells that a label matches."""
    headers = lambda k: F.size(F.filter(F.element_at(above_cells, k), lambda c: scalar.looks_like_header(c["matchString"]))) >= 2
    good = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(above))), lambda k: (F.size(above) > 0) & F.regexp_like(F.element_at(above, k), labels) & headers(k))
    return F.coalesce(F.trim(F.try_element_at(above, F.try_element_at(good, F.lit(1)))), F.lit(""))


def with_header(rows: DataFrame, labels: Column | None, whole_line: bool = True) -> DataFrame:
    """Rows (line_text, line_place, above) with `header_hint`, the header of the column at `line_place`: the nearest line above
    whose cell at the same place, or else whose header-like cell at the least distance, looks like one; empty for rows of
    fewer than two cells. A whole header line instead, where the column's is empty or matches no label.

    Each step is a column of its own: nested functions of functions cost far more to plan than to run.
    """
    place = F.col("line_place")
    rows = rows.withColumns({"own_cells": cells(F.col("line_text")), "above_cells": F.transform("above", cells)})
    inside = F.filter(F.sequence(F.lit(1), F.size("own_cells")), lambda k: (F.element_at("own_cells", k)["start"] <= place) & (place <= F.element_at("own_cells", k)["end"]))
    rows = rows.withColumns({"inside": F.try_element_at(inside, F.lit(1)), "away": F.transform("own_cells", lambda c: F.abs(c["start"] - place))})
    nearest = F.array_position("away", F.array_min("away"))
    rows = rows.withColumn("cell", F.when(F.size("own_cells") >= 2, F.coalesce("inside", nearest.cast("int"))))

    def candidate(own: Column) -> Column:
        same = F.coalesce(F.try_element_at(own, F.col("cell"))["matchString"], F.lit(""))
        headers = F.transform(F.filter(own, lambda c: scalar.looks_like_header(c["matchString"])), lambda c: F.struct(F.abs(c["start"] - place).alias("away"), c["start"].alias("start"), c["matchString"].alias("text")))
        return F.when(scalar.looks_like_header(same), same).otherwise(F.coalesce(F.array_min(headers)["text"], F.lit("")))

    rows = rows.withColumn("candidates", F.filter(F.transform("above_cells", candidate), lambda c: c != ""))
    rows = rows.withColumn("header_hint", F.when(F.col("cell").isNotNull(), F.coalesce(F.try_element_at("candidates", F.lit(1)), F.lit(""))).otherwise(""))
    if whole_line and labels is not None:
        hint = F.col("header_hint")
        rows = rows.withColumn("line_hint", F.when((hint != "") & F.regexp_like(hint, labels), "").otherwise(line_header(F.col("above"), F.col("above_cells"), labels)))
        rows = rows.withColumn("header_hint", F.when(F.col("line_hint") != "", F.col("line_hint")).otherwise(hint)).drop("line_hint")
    return rows.drop("own_cells", "above_cells", "inside", "away", "cell", "candidates")


def label_window(text: Column, start: Column, end: Column, width: Column | int) -> Column:
    first = F.greatest(F.lit(0), start - width)
    return text.substr(first + 1, F.least(F.length(text), end + width) - first)


def rule_score(near: Column, match: Column, hint: Column, labels: Column, option: Callable[[str, object], Column]) -> Column:
    """Weights of a label near the span (in its `label_window`), of a label in the header, and of a value that is mostly digits, in this order."""
    weight, header, digits = option("label_weight", 0.3), option("table_header_weight", 0.0), option("digit_weight", 0.2)
    above = (hint != "") & F.regexp_like(hint, labels)
    score = F.when(F.regexp_like(near, labels), weight).otherwise(0.0) + F.when(above, F.when(header > 0, header).otherwise(weight)).otherwise(0.0)
    return score + F.when(scalar.digit_ratio(match) >= option("digit_min_ratio", 0.6), digits).otherwise(0.0)


def bank_bonus(snippet: Column, match: Column, banks: list[tuple[str, list[str]]], weight: float) -> Column:
    """`weight` where the snippet names an institution one of whose patterns the whole value has."""
    hit = F.lit(False)
    for name, patterns in banks:
        own = "(?U)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"
        hit |= scalar.contains_phrase(snippet, name) & F.trim(match).rlike(own)
    return F.when(hit, float(weight)).otherwise(0.0)


def with_repeats(rows: DataFrame, partition: list[str], hybrid: Callable[[str, object], Column]) -> DataFrame:
    """Rows (value, tokens, signature, line) with value_count, unique_count, repeat_count, repeat_ratio and repeat_bonus.

    Rows of one signature on lines that follow each other make a run; a second row on the same line breaks it.
    """
    own = Window.partitionBy(*partition)
    eligible = (F.col("tokens") >= hybrid("repeat_boost_structure_min_tokens", 1)) & (F.col("signature") != "")
    rows = rows.withColumn("sig", F.when(eligible, F.col("signature")))
    by_sig = Window.partitionBy(*partition, "sig")
    ordered = by_sig.orderBy("line", "start")
    rows = rows.withColumns({
        "value_count": F.when(F.col("value") != "", F.count("*").over(Window.partitionBy(*partition, "value"))).otherwise(0),
        "first_of_value": (F.col("value") != "") & (F.row_number().over(Window.partitionBy(*partition, "value").orderBy("line", "start")) == 1),
        "repeat_count": F.count("*").over(own),
        "sig_count": F.count("sig").over(by_sig), "eligible": F.count("sig").over(own),
        "island": F.sum(F.when(F.col("line") == F.lag("line").over(ordered) + 1, 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
    })
    rows = rows.withColumn("unique_count", F.count_if("first_of_value").over(own).cast("int")).drop("first_of_value")
    run = F.count("*").over(Window.partitionBy(*partition, "sig", "island"))
    ratio = F.col("sig_count") / F.nullif("eligible", F.lit(0))
    consecutive, structure = hybrid("repeat_boost_require_consecutive", False), hybrid("repeat_boost_require_structure", False)
    enough = F.col("sig").isNotNull() & (F.col("sig_count") >= hybrid("repeat_boost_min_count", 5)) & (F.col("unique_count") >= hybrid("repeat_boost_unique_min", 1))
    shape = ~structure | consecutive | ((F.col("sig_count") >= hybrid("repeat_boost_structure_min_count", 2)) & (ratio >= hybrid("repeat_boost_structure_min_ratio", 0.6)))
    runs = ~consecutive | (run >= hybrid("repeat_boost_consecutive_min_count", 2))
    on = hybrid("repeat_boost_enabled", False) & (hybrid("repeat_boost_weight", 0.0) > 0) & enough & shape & runs
    return rows.withColumns({"repeat_bonus": F.when(on, hybrid("repeat_boost_weight", 0.0)).otherwise(0.0), "repeat_ratio": F.when(on, ratio).otherwise(0.0)}).drop("sig", "sig_count", "eligible", "island")


def by_type(keys: list[str], of: Callable[[str], Column], kind: Column | None = None) -> Column:
    """An expression for each type, chosen by `kind`, the column `type` unless given."""
    kind = F.col("type") if kind is None else kind
    out = F.when(kind == keys[0], of(keys[0]))
    for k in keys[1:]:
        out = out.when(kind == k, of(k))
    return out


def embedding_scores(rows: DataFrame, keys: list[str], options: dict[str, dict], embedder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """`rows` with column `embedding_score`: greatest cosine with an indicator less the greatest with another phrase.

    Each distinct snippet is embedded once, in Arrow batches; the phrases are embedded on the driver.
    """
    def unit(texts: list[str]) -> np.ndarray:
        x = np.asarray(embedder(texts), float)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    @F.pandas_udf("array<double>")
    def embed(column: pd.Series) -> pd.Series:
        return pd.Series(list(unit(column.tolist()))) if len(column) else pd.Series([], dtype=object)

    def score(key: str) -> Column:
        best = lambda phrases: F.array_max(F.array(*[scalar.dot(F.col("embedded"), F.array(*map(F.lit, v.tolist()))) for v in unit(phrases)])) if phrases else F.lit(0.0)
        return best(options[key]["indicators"]) - best(options[key]["others"])

    once = rows.where(F.trim("clipped") != "").select("clipped").distinct().withColumn("embedded", embed("clipped"))
    return rows.join(once, "clipped", "left").withColumn("embedding_score", F.when(F.col("embedded").isNotNull(), by_type(keys, score))).drop("embedded")


def explain_context(df: DataFrame, id_cols: list[str], ruleset: str | Bundle = "default", text_col: str = "text", prefix: str = "", method: str = "keyword", embedder: Callable[[list[str]], np.ndarray] | None = None, banks: list[tuple[str, list[str]]] | None = None, force_keyword: bool = False) -> DataFrame:
    """One row per span of the target types in `df` (as `detect` leaves it), kept or not, with all scores.

    Without an embedder, `embed` falls back to keywords. In embedding mode spans with a blank snippet are left out.
    """
    bundle = ruleset if isinstance(ruleset, Bundle) else rules.load(ruleset)
    context = bundle.context
    keys = [k for k in context.get("target_keys", []) if f"{prefix}{k}" in df.columns]
    if not keys:
        raise ValueError("no column of a target type")
    options = {k: settings(context, k) for k in keys}
    embed = method == "embed" and embedder is not None and not force_keyword
    # Settings of the row's type are literals; each measure is one expression over them, whatever the number of types.
    own = lambda of, kind=None: by_type(keys, lambda k: F.lit(of(options[k])), kind)
    words = lambda name: by_type(keys, lambda k: F.array(*map(F.lit, options[k][name])).cast("array<string>"))
    setting = lambda o, name, default: float(o["hybrid"].get(name, default)) if isinstance(default, float) else o["hybrid"].get(name, default)
    hybrid = lambda name, default: own(lambda o: setting(o, name, default))
    labels = own(lambda o: label_pattern(o["labels"]) or "(?!)")
    most, distance = (int((context.get("hybrid") or {}).get(n, d)) for n, d in (("table_header_max_lines", 64), ("table_header_max_distance_chars", 8000)))

    found = F.concat(*[typed(F.col(f"{prefix}{k}"), k) for k in keys])
    rows = df.select(*id_cols, F.coalesce(F.col(text_col), F.lit("")).alias("text"), found.alias("found")).where(F.size("found") > 0)
    text = F.col("text")
    rows = with_lines(rows.withColumn("sentences", F.transform(spans.sentences(text), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))))
    forced = {k: o["force"] for k, o in options.items() if o["force"] and o["force_scope"] == "text"}
    rows = rows.withColumns({f"forced_{k}": scalar.first_phrase(text, phrases) for k, phrases in forced.items()}) if forced else rows

    # What a span needs of the text is cut out within the document's row, so that neither text nor lines are copied per span.
    def placed(x: Column) -> Column:
        bounds = spans.context_bounds(F.col("sentences"), x["start"], x["end"], own(lambda o: o["around"], x["type"]))
        return F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["matchString"].alias("matchString"), line_of(x["start"]).alias("line"), bounds.alias("bounds"))

    def surrounded(x: Column) -> Column:
        width = own(lambda o: setting(o, "label_window", 12), x["type"])
        return F.struct(
            *[x[c].alias(c) for c in ("type", "start", "end", "matchString", "line", "bounds")],
            text.substr(x["bounds"]["start"] + 1, x["bounds"]["end"] - x["bounds"]["start"]).alias("snippet"),
            F.element_at("lines", x["line"] + 1).alias("line_text"), (x["start"] - F.element_at("line_starts", x["line"] + 1)).alias("line_place"),
            lines_above(x["line"], most, distance).alias("above"), label_window(text, x["start"], x["end"], width).alias("near"),
        )

    rows = rows.withColumn("found", F.transform("found", placed)).withColumn("found", F.transform("found", surrounded))
    rows = rows.select(*id_cols, *[f"forced_{k}" for k in forced], F.inline("found"))
    start, end, match, snippet = F.col("start"), F.col("end"), F.col("matchString"), F.col("snippet")
    rows = rows.withColumns({"value": scalar.fold_case(F.trim(match)), "lower_snippet": F.lower(snippet), "tokens": scalar.token_count(F.col("line_text")), "signature": scalar.row_signature(F.col("line_text"))})
    held = lambda phrases: F.filter(phrases, lambda p: F.contains(F.col("lower_snippet"), F.lower(p)))
    if embed:
        rows = rows.withColumn("clipped", spans.clip_around(snippet, F.col("bounds")["start"], start, end, own(lambda o: o["max_chars"])))
        rows = embedding_scores(rows, keys, options, embedder).where(F.col("embedding_score").isNotNull()).drop("clipped")
        rows = rows.withColumns({"context_score": F.col("embedding_score"), "context_score_norm": scalar.embedding_norm(F.col("embedding_score"))}).drop("embedding_score")
    else:
        rows = rows.withColumn("context_score", (F.size(held(words("indicators"))) - F.size(held(words("others")))).cast("double"))
        number = own(lambda o: len(o["indicators"]))
        rows = rows.withColumn("context_score_norm", F.when(number > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("context_score") / F.nullif(number, F.lit(0))))).otherwise(0.0))
    rows = with_header(rows, labels, bool((context.get("hybrid") or {}).get("table_header_line_fallback", True)))
    in_snippet = F.coalesce(F.try_element_at(held(words("force")), F.lit(1)), F.lit(""))
    force = by_type(keys, lambda k: F.col(f"forced_{k}") if k in forced else in_snippet) if forced else in_snippet
    known = banks or options.get("BN", {}).get("banks", [])
    weight = bundle.types["BN"].options.get("bank_pattern_weight", 0.25) if "BN" in bundle.types else 0.25
    rows = rows.withColumns({
        "force_phrase": force,
        "bank": F.when(F.col("type") == "BN", bank_bonus(snippet, match, known, weight)).otherwise(0.0),
        "header_hint": F.when(hybrid("table_header_enabled", True), F.col("header_hint")).otherwise(""),
    })
    rows = rows.withColumn("rule", rule_score(F.col("near"), match, F.col("header_hint"), labels, hybrid))
    rows = rows.drop("near", "above", "line_text", "line_place", "bounds", "lower_snippet", *[f"forced_{k}" for k in forced])
    rows = with_repeats(rows, [*id_cols, "type"], hybrid)
    base = F.col("context_score_norm") + F.col("bank") + F.col("repeat_bonus")
    total = F.col("context_score_norm") + F.col("rule") + F.col("bank") + F.col("repeat_bonus")
    accept, on = hybrid("accept_threshold", 0.2).cast("double"), hybrid("enabled", False)
    same = (own(lambda o: o["same"]) > 1) & (F.col("value_count") >= own(lambda o: o["same"]))
    by = F.when(same, "repeat_same_match").when(F.col("force_phrase") != "", "force_phrase").when(on & (base >= accept), "hybrid_base").when(on, "hybrid").when(F.col("bank") > 0, "bank_pattern").otherwise("embed" if embed else "keyword")
    rows = rows.withColumn("context_accept_by", by)
    plain = F.col("context_score") >= own(lambda o: float(o["sim_threshold"] if embed else o["threshold"]))
    decided = F.col("context_accept_by")
    early = decided.isin("repeat_same_match", "force_phrase")
    rows = rows.withColumns({
        "context_hybrid_score": F.when(early | ~on, F.lit(None)).when(decided == "hybrid_base", base).otherwise(total),
        "context_pass": early | decided.isin("hybrid_base", "bank_pattern") | F.when(decided == "hybrid", total >= accept).otherwise(F.when(on, F.lit(False)).otherwise(plain)),
        "context_header_hint": F.when((decided == "hybrid") & (F.col("header_hint") != ""), F.col("header_hint")),
        "context_method": F.lit("embed" if embed else "keyword"), "context_window": own(lambda o: o["around"]),
        "detected_by": F.when(F.col("type") == "DN", "hyperscan:dn").otherwise(F.concat(F.lit("regex:"), F.lower("type"))),
        "context_force_pass_phrase": F.nullif("force_phrase", F.lit("")), "context_repeat_bonus": F.col("repeat_bonus"),
        "context_repeat_count": F.col("repeat_count"), "context_repeat_unique_count": F.col("unique_count"), "context_repeat_structure_ratio": F.col("repeat_ratio"),
        "context_repeat_same_match_count": F.when(decided == "repeat_same_match", F.col("value_count")), "context_snippet": F.col("snippet"),
    })
    return rows.select(*id_cols, "type", "start", "end", "matchString", *sorted(c for c in rows.columns if c.startswith("context_")), "detected_by", F.col("rule").alias("rule_score"), F.col("bank").alias("bank_bonus"))


def keep_in_context(df: DataFrame, id_cols: list[str], ruleset: str | Bundle = "default", **options) -> DataFrame:
    """Accepted spans of all types in long form: those of the target types that pass, those of the other types as they are."""
    bundle = ruleset if isinstance(ruleset, Bundle) else rules.load(ruleset)
    prefix = options.get("prefix", "")
    target = [k for k in bundle.context.get("target_keys", []) if f"{prefix}{k}" in df.columns]
    rest = [k for k in TYPES if k not in target and f"{prefix}{k}" in df.columns]
    kept = explain_context(df, id_cols, bundle, **options).where("context_pass").select(*id_cols, "type", "start", "end", "matchString")
    return kept.unionByName(long_form(df, id_cols, rest, prefix)) if rest else kept
