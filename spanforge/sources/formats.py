"""Sources and sinks: labelled evaluation items, scores, tuned thresholds, and request rows."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import rules

ITEMS = "items array<struct<id string, type string, match string, label int, text string>>"
SCORES = "id string, type string, label int, match string, context_score_norm double, context_hybrid_score double"
REQUEST = "doc_id string, text string, max_results_per_type int, ruleset string"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Labelled items of a JSON document {items: [...]}."""
    return spark.read.schema(ITEMS).json(path, multiLine=True).select(F.inline("items"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORES).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One JSON request per line; an absent ruleset is `default`, an absent limit 500."""
    return spark.read.schema(REQUEST).json(path).na.fill({"ruleset": "default", "max_results_per_type": 500})


def write_response(df: DataFrame, path: str) -> None:
    """Span columns as JSON lines; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def with_defaults(found: Column) -> Column:
    """Scored spans with the defaults of a fixed wire format for what is absent: false, zero, empty."""
    fields = {"isValid": F.lit(False), "context_score": F.lit(0.0), "context_score_norm": F.lit(0.0), "context_hybrid_score": F.lit(0.0), "context_method": F.lit(""), "context_accept_by": F.lit(""), "context_pass": F.lit(False), "detected_by": F.lit("")}

    def item(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["matchString"].alias("matchString"), *[F.coalesce(x[k], v).alias(k) for k, v in fields.items()])

    return F.transform(found, item)


def rulesets(spark: SparkSession, folder: str | Path = rules.RULES) -> DataFrame:
    """name, version, updated_at, steps of every ruleset in a folder."""
    rows = [(b.name, b.version, b.updated_at, b.steps) for b in rules.list_rulesets(folder)]
    return spark.createDataFrame(rows, "name string, version string, updated_at string, steps array<string>")


def health(spark: SparkSession, service: str = "spanforge", version: str = "1") -> DataFrame:
    return spark.createDataFrame([(True, service, version)], "ok boolean, service string, version string")


def update_thresholds(path: str | Path, per_type: dict[str, float], per_type_hybrid: dict[str, float], hybrid: float | None = None) -> None:
    """Writes tuned thresholds into the context section of a YAML file; comments are lost."""
    doc = rules.read_document(path)
    context = doc.setdefault("context", {})
    if hybrid is not None:
        context.setdefault("hybrid", {})["accept_threshold"] = hybrid
    for key, value in per_type.items():
        context.setdefault("per_type", {}).setdefault(key, {})["sim_threshold"] = value
    for key, value in per_type_hybrid.items():
        context.setdefault("per_type", {}).setdefault(key, {}).setdefault("hybrid", {})["accept_threshold"] = value
    Path(path).write_text(yaml.safe_dump(doc, allow_unicode=True, sort_keys=False), "utf-8")
