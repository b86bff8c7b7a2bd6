"""Quality classifier: histogram gradient-boosted trees over document statistics.

Empty and null texts are scored like any other (all statistics zero); repeated rows are scored once each; columns beside
the text never enter a score. A null id is not held out and teaches nothing.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbdt
from .common import fit_sample, small_batches, table, text_bytes

#: At most so many labelled rows are learnt from.
FIT_ROWS = 12_000

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>@^~=+_\\/{}[]")] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of document statistics per UTF-8 text: sizes, shares of byte classes, repetition of words, windows and lines."""
    out = np.zeros((len(texts), 22))
    for k, text in enumerate(texts):
        n = len(text)
        if not n:
            continue
        h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        w, m = max(1, len(words)), max(1, len(lines))
        upper, lower = h[65:91].sum(), h[97:123].sum()
        spaces = h[9:14].sum() + h[32]
        longest = max(map(len, words), default=0)
        out[k] = (
            np.log1p(n), np.log1p(len(words)), (n - spaces) / w, min(longest, 200),
            upper / (upper + lower + 1), h[48:58].sum() / n, h[_SYMBOLS].sum() / n, h[_STOPS].sum() / w, h[33] / w, h[44] / w,
            h[124] / w, h[128:].sum() / n, spaces / n, h[10] / w, h[:9].sum() + h[14:32].sum() > 0,
            len(set(words)) / w, sum(map(eq, words, words[1:])) / w,
            1 - len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2) if len(words) > 2 else 0,
            len(lines), 1 - len(set(lines)) / m, len(words) / m, (h[60] + h[62] + h[123] + h[125]) / w,
        )
    return out


def _measured(batches):
    for batch in batches:
        x = statistics(text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_pydict({"fit_id": batch.column("fit_id"), "fit_label": batch.column("fit_label"), "x": list(x)}, schema=pa.schema([("fit_id", pa.int64()), ("fit_label", pa.float64()), ("x", pa.list_(pa.float64()))]))


def fit(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", rows: int = FIT_ROWS, text_col: str = "text", id_col: str = "doc_id") -> gbdt.Trees:
    """Trees for `label`, from at most `rows` labelled documents outside `held_out(id)`. Only their statistics reach the driver."""
    chosen = fit_sample(docs.select(id_col, F.col(text_col).alias("text")), labels, label, held_out, rows, id_col)
    seen = (
        chosen.select(F.col("fit_id").cast("long"), "fit_label", "text").mapInArrow(_measured, "fit_id long, fit_label double, x array<double>")
        .groupBy("fit_id").agg(F.min(F.struct("fit_label", "x")).alias("r")).orderBy("fit_id").select("r.*").limit(rows).toPandas()
    )
    x = np.stack(seen.x.to_list()) if len(seen) else np.zeros((0, 22))
    return gbdt.fit(x, seen.fit_label.to_numpy(float))


def score(model: gbdt.Trees, text: Column) -> Column:
    """Probability of label 1 for each text."""
    @F.pandas_udf("double")
    def quality(column: pd.Series) -> pd.Series:
        return pd.Series(model.probability(statistics([b"" if t is None else t.encode("utf-8", "replace") for t in column])))

    return quality(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), held_out)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier doesn't reject, columns as they were."""
    small_batches(spark)
    model = fit(docs, table(spark, sf_dir, "labels"), held_out)
    return docs.where(score(model, F.col("text")) >= 0.5)
