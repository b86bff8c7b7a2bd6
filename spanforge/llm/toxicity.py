"""Toxicity: boosted trees over dense features, with isotonic calibration.

The lexicon is learnt: whole words and word beginnings that occur in far more toxic than clean examples. Features are
lexicon densities, hits close to second-person words, capitals, punctuation and obfuscation (characters swapped or put
between letters). One half of the examples makes the lexicon, the other the trees, of which a part calibrates.

Null and empty texts have zero features and get a score like any other. Repeated rows are scored once each, columns beside
the text never enter a score, a null id is not held out and teaches nothing. No or one-sided examples: the prior.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbdt
from .common import fit_sample, small_batches, staged, table

#: At most so many labelled rows are learnt from.
FIT_ROWS = 16_000
#: Largest lexicon, and the lengths of the word beginnings in it.
TERMS, STEMS = 300, (4, 5, 6)
CACHE_WORDS = 300_000
#: Second-person words of the corpus's languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr euch tu te toi vous votre vos usted ustedes tú ti vosotros".split())
#: Characters that stand in for letters.
SWAPPED = str.maketrans("0134578@$!€", "oieastbasie")
NEAR = 5
FEATURES = 17


def _letters(word: str) -> str:
    return re.sub(r"[\W\d_]+", "", word)


def terms(word: str) -> list[str]:
    """What a word may match in the lexicon: itself and its beginnings, marked with a star."""
    core = word.strip(".,;:!?\"'()[]…-*_")
    return [core, *(core[:n] + "*" for n in STEMS if len(core) > n)] if core else []


@dataclass
class Lexicon:
    """Weights of terms; `code` sorts a word into hit (1), disguised hit (2), second person (4), odd spelling (8)."""

    weight: dict[str, float]
    seen: dict[str, tuple[int, float]] = field(default_factory=dict)

    def _match(self, word: str) -> float:
        return max((self.weight.get(t, 0.0) for t in terms(word)), default=0.0)

    def code(self, word: str) -> tuple[int, float]:
        found = self._match(word)
        core = word.strip(".,;:!?\"'()[]…-*_")
        if found:
            return 1, found
        if core in SECOND_PERSON:
            return 4, 0.0
        if core and not core.isalpha():
            odd = 8 * (sum(map(str.isalpha, core)) * 2 >= len(core))
            hidden = max(self._match(_letters(core)), self._match(_letters(core.translate(SWAPPED))))
            return (2 | odd, hidden) if hidden else (odd, 0.0)
        return 0, 0.0

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = self.code(w)
        pairs = list(map(seen.__getitem__, words))
        return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs])

    def __getstate__(self):
        return {"weight": self.weight, "seen": {}}


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """One row of dense features per whole text."""
    out = np.zeros((len(texts), FEATURES))
    for k, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        code, weight = lexicon.codes(words)
        n = len(words)
        hits = np.flatnonzero(code & 3)
        second = np.flatnonzero(code & 4)
        near = 0
        if len(hits) and len(second):
            after = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(second[np.minimum(after, len(second) - 1)] - hits), np.abs(second[np.maximum(after - 1, 0)] - hits))
            near = int((gap <= NEAR).sum())
        h = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        size, upper, lower = h.sum(), h[65:91].sum(), h[97:123].sum()
        singles = sum(len(w) == 1 and w.isalpha() for w in words)
        out[k] = (
            np.log1p(n), len(hits), len(hits) / n, weight.sum() / n, weight.max(), len(set(map(words.__getitem__, hits))), (code & 1).sum() / n,
            (code & 2).sum() / 2, near, near / n, len(second) / n, upper / (upper + lower + 1), h[33] / n, h[63] / n,
            (h[33:48].sum() + h[58:65].sum()) / size, (code & 8).sum() / 8 / n, singles / n,
        )
    return out


def learn_lexicon(examples: DataFrame, most: int = TERMS) -> Lexicon:
    """From (fit_label, text): the `most` terms with the largest frequency times log odds among toxic examples."""
    def count(batches):
        of = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {t for w in set((text or "").lower().split()) for t in terms(w)}
                of[label >= 0.5].update(own)
                of[label >= 0.5][""] += 1
        rows = [(t, of[1][t], of[0][t]) for t in of[0].keys() | of[1].keys()]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 50_000], strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["term", "toxic", "clean"])

    counted = examples.select("fit_label", "text").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = staged(counted, "terms")
    total = counted.where("term = ''").head()
    if total is None or not total["toxic"] or not total["clean"]:
        return Lexicon({})
    odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1))
    best = counted.where(F.col("term") != "").where(F.col("toxic") >= max(4, total["toxic"] // 100)).select("term", "toxic", odds.alias("odds")).where("odds > 2").orderBy(F.desc(F.col("odds") * F.col("toxic")), "term").limit(most)
    return Lexicon({r["term"]: r["odds"] for r in best.collect()})


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    trees: gbdt.Trees
    calibrated: gbdt.Isotonic

    def probability(self, texts: list[str]) -> np.ndarray:
        return self.calibrated(self.trees.probability(features(texts, self.lexicon)))


def fit(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", rows: int = FIT_ROWS, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Lexicon, trees and calibration for `label` from at most `rows` labelled documents outside `held_out(id)`.

    Equal texts teach once. The driver gets the lexicon and the features of the examples, not their texts.
    """
    sample = fit_sample(docs.select(id_col, F.col(text_col).alias("text")), labels, label, held_out, rows, id_col)
    one = F.struct("fit_id", "fit_label", "text")
    examples = staged(sample.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).agg(F.min(one).alias("r")).select("r.*"), "toxic-examples")
    part = F.pmod(F.xxhash64("fit_id", F.lit(7)), F.lit(10))
    lexicon = learn_lexicon(examples.where(part < 5))

    def measured(batches):
        for batch in batches:
            x = features([t or "" for t in batch.column("text").to_pylist()], lexicon)
            yield pa.RecordBatch.from_arrays([batch.column("fit_id"), batch.column("fit_label"), batch.column("part"), pa.array(list(x), pa.list_(pa.float64()))], ["fit_id", "fit_label", "part", "x"])

    rest = examples.where(part >= 5).select(F.col("fit_id").cast("long"), "fit_label", part.alias("part"), "text")
    seen = rest.mapInArrow(measured, "fit_id long, fit_label double, part long, x array<double>").orderBy("fit_id").limit(rows).toPandas()
    x = np.stack(seen.x.to_list()) if len(seen) else np.zeros((0, FEATURES))
    y, grow = (seen.fit_label.to_numpy(float) >= 0.5).astype(float), seen.part.to_numpy() < 8
    trees = gbdt.fit(x[grow], y[grow], trees=50, depth=3, least=0.5)
    return Model(lexicon, trees, gbdt.isotonic(trees.probability(x[~grow]), y[~grow]))


def score(model: Model, text: Column) -> Column:
    """Calibrated probability of label 1 for each text."""
    @F.pandas_udf("double")
    def toxicity(column: pd.Series) -> pd.Series:
        return pd.Series(model.probability([t or "" for t in column]))

    return toxicity(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), held_out)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that aren't toxic, columns as they were."""
    small_batches(spark)
    model = fit(docs, table(spark, sf_dir, "labels"), held_out)
    return docs.where(score(model, F.col("text")) < 0.5)
