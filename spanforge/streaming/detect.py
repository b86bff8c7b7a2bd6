"""Detection on streams: it looks at one row at a time, so the batch transform is the streaming one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect_spans


def detect_stream(stream: DataFrame, id_cols: list[str], ruleset: str = "default", **options) -> DataFrame:
    """Long-form spans of a streaming DataFrame; no state, no watermark needed."""
    return detect_spans(stream, id_cols, ruleset, **options)


def write_spans(spans: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet what is available now, exactly once, and stops."""
    return spans.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
