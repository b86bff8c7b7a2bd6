"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

A text's UTF-8 bytes are cut into windows, the last one padded. Two gated recurrent layers read each window from either
end; every position gets a distribution over the learnt languages, and a document's probabilities are the mean over all of
its positions that begin a character. Training is backpropagation through time over windows of a bounded sample of documents.

`und` with score 0 is the answer for texts that are null or without a letter, and for all if there is nothing to learn from.
Repeated rows are predicted once each; null languages and ids teach nothing; empty input gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, table, text_bytes

#: At most so many documents are learnt from, shared evenly among the languages, and so many windows of all of their texts.
FIT_ROWS, FIT_WINDOWS = 4_000, 24_000
HIDDEN = 8
WINDOW, FIT_WINDOW = 96, 48
#: Windows that are read side by side.
WIDTH = 2_048

_LETTER = re.compile(r"[^\W\d_]").search


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Per direction: w (3H x 256) byte columns, u (3H x H) recurrence; gates in the order update, reset, candidate.

    out (L x 2H) and bias (L) turn the two states of a position into scores of the languages.
    """

    langs: list[str]
    w: list[np.ndarray]
    u: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
        return Network(langs, [draw(3 * hidden, 256) for _ in range(2)], [draw(3 * hidden, hidden) for _ in range(2)], draw(len(langs), 2 * hidden), np.zeros((len(langs), 1), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.w, *self.u, self.out, self.bias]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T x L x B) at every position of the windows x (T x B bytes)."""
        steps, width = x.shape
        hidden = self.u[0].shape[1]
        scores = np.empty((steps, len(self.langs), width), np.float32)
        for side in (0, 1):
            # The sigmoid of a is tanh(a / 2) / 2 + 1 / 2: the gates' halves go into the weights.
            half = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), hidden)[:, None]
            w, u = self.w[side] * half, self.u[side] * half
            out = self.out[:, side * hidden : (side + 1) * hidden]
            h = np.zeros((hidden, width), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                a, b = w.take(x[t], axis=1), u @ h
                gates = a[: 2 * hidden]
                gates += b[: 2 * hidden]
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                n = b[2 * hidden :]
                n *= gates[hidden:]
                n += a[2 * hidden :]
                np.tanh(n, out=n)
                h -= n
                h *= gates[:hidden]
                h += n
                if side == 0:
                    np.matmul(out, h, out=scores[t])
                else:
                    scores[t] += out @ h
        scores += self.bias
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def documents(self, texts: list[bytes], window: int = WINDOW, width: int = WIDTH) -> np.ndarray:
        """Mean probabilities (texts x L) over the positions where a character begins; zeros for an empty text."""
        counts = np.array([-(-len(t) // window) for t in texts])
        total = np.zeros((len(texts), len(self.langs)))
        owner = np.repeat(np.arange(len(texts)), counts)
        padded, begins = np.zeros(len(owner) * window, np.uint8), np.zeros(len(owner) * window, bool)
        at = 0
        for text, n in zip(texts, counts, strict=True):
            own = np.frombuffer(text, np.uint8)
            padded[at : at + len(own)] = own
            begins[at : at + len(own)] = (own & 0xC0) != 0x80
            at += int(n) * window
        grid, begins = padded.reshape(-1, window), begins.reshape(-1, window)
        for low in range(0, len(grid), width):
            p = self.positions(np.ascontiguousarray(grid[low : low + width].T))
            p *= begins[low : low + width].T[:, None, :]
            np.add.at(total, owner[low : low + width], p.sum(axis=0).T)
        number = np.bincount(owner, begins.sum(axis=1), len(texts)) if len(owner) else np.ones(len(texts))
        return total / np.maximum(1, number)[:, None]


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of x (T x B) with label y (B) at each, and its gradients, by backpropagation through time."""
    steps, width = x.shape
    hidden, langs = net.u[0].shape[1], len(net.langs)
    kept: list[list[tuple]] = [[], []]
    states = np.zeros((2, steps, hidden, width), net.out.dtype)
    for side in (0, 1):
        h = np.zeros((hidden, width), net.out.dtype)
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            a, b = net.w[side][:, x[t]], net.u[side] @ h
            z, r = _sigmoid(a[:hidden] + b[:hidden]), _sigmoid(a[hidden : 2 * hidden] + b[hidden : 2 * hidden])
            n = np.tanh(a[2 * hidden :] + r * b[2 * hidden :])
            kept[side].append((t, h, z, r, n, b[2 * hidden :]))
            h = (1 - z) * n + z * h
            states[side, t] = h
    both = np.concatenate([states[0], states[1]], axis=1)
    scores = np.einsum("lh,thb->tlb", net.out, both) + net.bias
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=1, keepdims=True)
    loss = float(-np.log(np.maximum(p[:, y, np.arange(width)], 1e-12)).mean())
    d = p.copy()
    d[:, y, np.arange(width)] -= 1
    d /= steps * width
    d_out, d_bias = np.einsum("tlb,thb->lh", d, both), d.sum(axis=(0, 2))[:, None]
    d_both = np.einsum("lh,tlb->thb", net.out, d)
    d_w, d_u = [], []
    for side in (0, 1):
        gw, gu, dh = np.zeros_like(net.w[side]), np.zeros_like(net.u[side]), np.zeros((hidden, width), net.out.dtype)
        at, columns = [], []
        for t, h, z, r, n, un in reversed(kept[side]):
            dh = dh + d_both[t, side * hidden : (side + 1) * hidden]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            through = np.concatenate([dz, dr, dn * r])
            gu += through @ h.T
            at.append(x[t])
            columns.append(np.concatenate([dz, dr, dn]))
            dh = dh * z + net.u[side].T @ through
        order, values = np.concatenate(at), np.concatenate(columns, axis=1)
        for k in range(3 * hidden):
            gw[k] = np.bincount(order, values[k], 256)
        d_w.append(gw)
        d_u.append(gu)
    return loss, [*d_w, *d_u, d_out, d_bias]


def train(langs: list[str], windows: np.ndarray, y: np.ndarray, steps: int = 350, batch: int = 96, rate: float = 0.02, seed: int = 0) -> Network:
    """Adam over batches that draw each language equally often; windows: N x T bytes, y: index of the language."""
    net = Network.new(langs, seed=seed)
    rng = np.random.default_rng(seed)
    own = [np.flatnonzero(y == k) for k in range(len(langs))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        label = rng.integers(0, len(langs), batch)
        chosen = np.array([own[k][rng.integers(0, len(own[k]))] for k in label])
        _, grads = gradients(net, windows[chosen].T, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        slow = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    return net


def fit(docs: DataFrame, held_out, rows: int = FIT_ROWS, windows: int = FIT_WINDOWS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network | None:
    """A network from at most `rows` documents with a language outside `held_out(id)`, as many of each language as there are
    or as its share allows; null if there are none.

    Their whole texts are cut into windows, of which each language's share, those of smallest hash, goes to the driver;
    training draws from them. An id with two languages teaches its smaller one.
    """
    def cut(batches):
        for batch in batches:
            ids, langs, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for doc, lang, text in zip(ids, langs, text_bytes(batch.column(2)), strict=True):
                for at in range(0, len(text), FIT_WINDOW):
                    out.append((doc, lang, text[at : at + FIT_WINDOW].ljust(FIT_WINDOW, b"\0"), at))
                    if len(out) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds, names = (pa.int64(), pa.string(), pa.binary(), pa.int64()), ["fit_id", "lang", "bytes", "at"]
    doc, lang = F.col(id_col).cast("long"), F.col(lang_col)
    known = docs.where(doc.isNotNull() & lang.isNotNull() & ~held_out(F.col(id_col))).groupBy(doc.alias("fit_id")).agg(F.min(lang).alias("fit_lang"))
    number = max(1, known.select("fit_lang").distinct().count())
    # The share of a language is a limit within its group, which Spark applies before it deals the rows.
    first = lambda df, by, order, most: df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= most).drop("nth")
    chosen = first(known, "fit_lang", (F.xxhash64("fit_id"), "fit_id"), max(1, rows // number))
    texts = docs.select(doc.alias("own_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("own_id") == F.col("fit_id"))
    seen = texts.select("fit_id", "fit_lang", "text").mapInArrow(cut, "fit_id long, lang string, bytes binary, at long")
    seen = first(seen, "lang", (F.xxhash64("fit_id", "at"), "fit_id", "at", "bytes"), max(1, windows // number)).orderBy("fit_id", "at", "bytes").toPandas()
    if not len(seen):
        return None
    langs = sorted(seen.lang.unique())
    found = np.frombuffer(b"".join(seen.bytes), np.uint8).reshape(-1, FIT_WINDOW)
    return train(langs, found, np.searchsorted(langs, seen.lang.to_numpy(str)))


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, net: Network | None, held_out: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The likeliest language of every whole text and its pooled probability."""
    @lean
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            known = [t if t and net is not None and _LETTER(t) else "" for t in texts]
            pooled = np.zeros((len(texts), 1))
            names = ["und"]
            if net is not None and len(texts):
                pooled, names = net.documents([t.encode("utf-8", "replace") for t in known]), net.langs
            best = pooled.argmax(axis=1) if len(texts) else np.zeros(0, int)
            pred = [names[k] if t else "und" for k, t in zip(best, known, strict=True)]
            score = [round(min(1.0, float(row.max())), 6) if t else 0.0 for row, t in zip(pooled, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col)).mapInArrow(run, SCHEMA)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, held_out), held_out(F.col("doc_id")))
