"""Evaluation and presentation: threshold sweeps, latency figures, search, flattening and highlighting of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, spans


def sweep(rows: DataFrame, score: str, low: float, high: float, step: float, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of `score >= threshold` for the threshold of the best F1, the lowest on ties.

    Rows without a score are left out. Each row goes to the thresholds at or below its score only as counts: rows are
    counted per threshold they reach first, then summed from above, so no row meets the whole grid.
    """
    by = by or []
    steps = int(round((high - low) / step)) + 1
    grid = [round(low + k * step, 4) for k in range(steps)]
    # Thresholds that the row passes: about (score - low) / step, made exact by a look at the thresholds around.
    edge = lambda k: F.element_at(F.array(*map(F.lit, grid)), k)
    about = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor((F.least(F.greatest(F.col(score), F.lit(low - step)), F.lit(high + step)) - low) / step).cast("int") + 1))
    reached = F.when((about > 0) & (F.col(score) < edge(F.greatest(about, F.lit(1)))), about - 1).when((about < steps) & (F.col(score) >= edge(F.least(about + 1, F.lit(steps)))), about + 1).otherwise(about)
    seen = rows.where(F.col(score).isNotNull()).groupBy(*by, reached.alias("k")).agg(F.sum("label").alias("positive"), F.count("*").alias("n"))
    every = rows.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("k"), F.element_at(F.array(*map(F.lit, grid)), F.col("id").cast("int")).alias("threshold"))
    groups = (seen.select(*by).distinct() if by else rows.sparkSession.range(1).select()).crossJoin(F.broadcast(every))  # the grid is fixed
    filled = groups.join(seen, [*by, "k"], "left").na.fill(0, ["positive", "n"])
    above = Window.partitionBy(*by).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    totals = seen.groupBy(*by).agg(F.sum("positive").alias("all_positive"))
    filled = filled.withColumns({"tp": F.sum("positive").over(above), "chosen": F.sum("n").over(above)})
    filled = filled.join(totals, by) if by else filled.crossJoin(F.broadcast(totals))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    filled = filled.withColumns({"precision": ratio(F.col("tp"), F.col("chosen")), "recall": ratio(F.col("tp"), F.col("all_positive"))})
    filled = filled.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("f1"), "threshold"))
    return filled.withColumn("nth", best).where("nth = 1").select(*by, "threshold", "precision", "recall", "f1")


def match_scores(items: DataFrame, spans_found: DataFrame, explained: DataFrame | None = None) -> DataFrame:
    """Labelled items (id, type, label, match) with the scores of the first span of equal text, or of the first explained one of equal type and text."""
    first = lambda d, keys: d.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end"))).where("nth = 1")
    scores = ["context_score_norm", "context_hybrid_score"]
    one = first(spans_found, ["id", "matchString"]).select("id", F.col("matchString").alias("match"), *scores)
    out = items.join(one, ["id", "match"], "left")
    if explained is not None:
        two = first(explained, ["id", "type", "matchString"]).select("id", "type", F.col("matchString").alias("match"), *[F.col(c).alias(f"explained_{c}") for c in scores])
        out = out.join(two, ["id", "type", "match"], "left").withColumns({c: F.coalesce(c, f"explained_{c}") for c in scores})
    return out.select("id", "type", "label", "match", *scores)


def latency(rows: DataFrame, value: str, by: list[str], seconds: Column | None = None) -> DataFrame:
    """Mean, extremes and interpolated percentiles of a latency column, and the rate if `seconds` is given."""
    quantile = lambda p: F.percentile(value, F.lit(p))
    figures = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), quantile(0.5).alias("p50"), quantile(0.95).alias("p95"), quantile(0.99).alias("p99")]
    if seconds is not None:
        figures.append((F.count("*") / seconds).alias("per_second"))
    return rows.groupBy(*by).agg(*figures)


def status_histogram(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def search(docs: DataFrame, query: str, k: int = 5, bonus: float = 0.2) -> DataFrame:
    """The k documents (nth, title, content, score) of the highest score, raised where title or content holds the query; ties by nth. An empty query: the first k."""
    q = query.strip().lower()
    if not q:
        return docs.orderBy("nth").limit(k)
    text = F.lower(F.concat_ws(" ", "title", "content"))
    ranked = F.coalesce("score", F.lit(0.5)) + F.when(F.contains(text, F.lit(q)), bonus).otherwise(0.0)
    return docs.withColumn("ranked", ranked).orderBy(F.desc("ranked"), "nth").limit(k)


TAGGED = "struct<type:string,tag:string,start:int,end:int,matchString:string,isValid:boolean>"


def flatten(columns: dict[str, Column]) -> Column:
    """One array of struct<type, tag, start, end, matchString, isValid> of all types; SN_INVALID counts as type SN."""
    def own(key: str, found: Column) -> Column:
        name = {"email": "EML", "eml": "EML", "email_CTX_REJECTED": "EML_CTX_REJECTED", "eml_CTX_REJECTED": "EML_CTX_REJECTED"}.get(key, key)
        kind = "SN" if name == "SN_INVALID" else name
        valid = F.lit({"SN": True, "SN_INVALID": False}.get(name)).cast("boolean")
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("tag"), x["start"].alias("start"), x["end"].alias("end"), x["matchString"].alias("matchString"), valid.alias("isValid")))

    return F.concat(*[own(k, v) for k, v in columns.items()])


def display_spans(tagged: Column) -> Column:
    """Of spans of all types those that are shown: by start, then end, none over another."""
    return spans.shortest_first(tagged, TAGGED)


def highlight(text: Column, tagged: Column) -> Column:
    """The text as HTML with each span of `display_spans` in a mark element."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("html"))
    part = lambda a, b: scalar.escape_html(text.substr(a + 1, b - a))

    def step(s: Column, x: Column) -> Column:
        name = F.regexp_replace(x["tag"], "[^a-zA-Z0-9_-]", "")
        kind = F.concat(F.lit("pii pii-"), name, F.when(x["tag"].isin("SN", "SN_INVALID"), F.when(F.coalesce(x["isValid"], F.lit(False)), " pii-sn-valid").otherwise(" pii-sn-invalid")).otherwise(""), F.when(x["tag"].endswith("_CTX_REJECTED"), " pii-ctx-rejected").otherwise(""))
        mark = F.concat(F.lit('<mark class="'), kind, F.lit('" title="'), name, F.lit(" ["), x["start"].cast("string"), F.lit(","), x["end"].cast("string"), F.lit(']">'), part(x["start"], x["end"]), F.lit("</mark>"))
        return F.struct(x["end"].alias("at"), F.concat(s["html"], part(s["at"], x["start"]), mark).alias("html"))

    done = F.aggregate(display_spans(tagged), begin, step)
    return F.concat(done["html"], part(done["at"], F.length(text)))


def colour(score: Column) -> Column:
    """A background for a score: red over yellow to blue."""
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))
    v = F.when(v <= 0, (v + 1) / 2).otherwise(v)
    # The three colours and the two opacities.
    low, middle, high = (220, 38, 38), (250, 204, 21), (37, 99, 235)
    blend = lambda a, b, t: F.concat_ws(",", *[F.floor(x + (y - x) * t + 0.5).cast("string") for x, y in zip(a, b, strict=True)])
    first = F.concat(F.lit("rgba("), blend(low, middle, v / 0.5), F.lit(",0.35)"))
    return F.when(v < 0.5, first).otherwise(F.concat(F.lit("rgba("), blend(middle, high, (v - 0.5) / 0.5), F.lit(",0.28)")))


def table_rows(long: DataFrame, id_cols: list[str]) -> DataFrame:
    """Long-form spans as the columns of a result table, in order of their place."""
    span = F.concat(F.lit("["), F.col("start").cast("string"), F.lit(","), F.col("end").cast("string"), F.lit("]"))
    return long.select(*id_cols, "type", scalar.escape_html(F.col("matchString")).alias("match"), span.alias("span"), "start").orderBy(*id_cols, "start", "type").drop("start")


def check_numbers(text: Column) -> Column:
    """struct<found, valid, invalid> of the resident numbers in a text of pasted lines."""
    found = spans.scan(text, r"[0-9]{6}-[0-9]{7}")
    valid = F.size(F.filter(found, lambda x: scalar.rrn_checksum(x["matchString"])))
    return F.struct(F.size(found).alias("found"), valid.alias("valid"), (F.size(found) - valid).alias("invalid"))
