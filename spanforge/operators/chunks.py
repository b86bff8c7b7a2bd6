"""Long texts: cut at paragraphs or lines with an overlap, detect per chunk, merge by offset.

Chunks are rows, so a long document is read by many tasks; merging groups a document's spans, never its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans

RANGES = "array<struct<start:int,end:int>>"


def split_ranges(text: Column, chunk: int = 50_000, overlap: int = 2_000) -> Column:
    """Ranges of at most `chunk` characters: each ends behind its last blank line, or else its last line feed, if that is
    beyond a third of it; the next begins `overlap` characters before. Null and empty texts have none."""
    overlap = max(0, min(overlap, chunk - 1))
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    state = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast(RANGES).alias("found"))

    def after(s: Column, size: Column) -> Column:
        end = s["at"] + size
        back = F.greatest(F.lit(0), end - overlap)
        return F.struct(F.when(back <= s["at"], end).otherwise(back).alias("at"), (end >= n).alias("done"), F.array_append(s["found"], F.struct(s["at"].alias("start"), end.alias("end"))).alias("found"))

    def size(s: Column, body: Column) -> Column:
        last = lambda mark: F.length(body) - F.length(F.substring_index(body, mark, -1)) - len(mark)
        marks = F.struct(last("\n\n").alias("paragraph"), last("\n").alias("line"))
        cut = lambda m: F.when(m["paragraph"] > 0, m["paragraph"] + 2).otherwise(m["line"] + 1)
        far = lambda m: F.when(m["paragraph"] > 0, m["paragraph"]).otherwise(m["line"]) > chunk // 3
        return spans.let(marks, lambda m: F.when((s["at"] + chunk < n) & far(m), cut(m)).otherwise(F.length(body)))

    def step(s: Column, _: Column) -> Column:
        body = text.substr(s["at"] + 1, F.lit(chunk))
        return F.when(s["done"] | (s["at"] >= n), s).otherwise(spans.let(spans.let(body, lambda b: size(s, b)), lambda k: after(s, k)))

    rounds = F.sequence(F.lit(1), F.greatest(F.lit(8), F.floor(n / chunk) * 4 + 8).cast("int"))
    cut = F.aggregate(rounds, state, step)["found"]
    return F.when(n <= 0, F.array().cast(RANGES)).when(n <= chunk, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))).otherwise(cut)


def explode_chunks(df: DataFrame, text_col: str = "text", chunk: int = 50_000, overlap: int = 2_000, most: int | None = None) -> DataFrame:
    """`df` with one row per chunk: chunk_start, chunk_end and the chunk as the text. `most`: chunks of a document that are read."""
    ranges = split_ranges(F.col(text_col), chunk, overlap)
    ranges = ranges if most is None else F.slice(ranges, 1, most)
    rows = df.select("*", F.explode(ranges).alias("chunk_range"))
    start, end = F.col("chunk_range")["start"], F.col("chunk_range")["end"]
    return rows.withColumns({"chunk_start": start, "chunk_end": end, text_col: F.col(text_col).substr(start + 1, end - start)}).drop("chunk_range")


def merge_chunks(found: DataFrame, id_cols: list[str], limit: int | None = None) -> DataFrame:
    """Long-form spans of chunks (with chunk_start) as spans of their documents, each once, the first `limit` of a type.

    Spans in an overlap that differ in extent all stay.
    """
    moved = found.withColumns({"start": F.col("start") + F.col("chunk_start"), "end": F.col("end") + F.col("chunk_start")})
    once = moved.select(*id_cols, "type", "start", "end", "matchString").dropDuplicates()
    if limit is None:
        return once
    order = Window.partitionBy(*id_cols, "type").orderBy("start", "end", "matchString")
    return once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).drop("nth")


def fast_path(df: DataFrame, types: list[str], text_col: str = "text", at_least: int = 50_000, only: tuple[str, ...] = ("SN", "SN_INVALID", "SSN", "DN", "PN", "MN", "EML", "IP"), limit: int = 100) -> DataFrame:
    """Span columns of texts of `at_least` characters: other types than `only` are left out, the rest is cut to `limit`."""
    long = F.length(text_col) >= at_least
    return df.withColumns({k: F.when(long, F.slice(k, 1, limit) if k in only else F.array().cast(df.schema[k].dataType)).otherwise(F.col(k)) for k in types})
