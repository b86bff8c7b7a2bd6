"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a public vocabulary file. That file's scores are merge ranks, so log scores follow Zipf's law over the
ranks: -log(1 + rank). Characters that no piece covers cost the least score minus ten and become byte pieces.
Blanks are written as the marker U+2581, one before the text as well, and turn back into blanks on decoding.

No piece has a marker or line feed after another character, so the best path of a text is that of its words put together;
each new word goes through the trie once while a worker remembers it, all new words of a batch at once in numpy.

Null and empty texts give no pieces and decode to the empty text. A marker in the text decodes as a blank, which shows in
`round_trip`. Repeated rows get a row each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, small_batches, table, text_slices

MARK = "▁"
#: What a character outside the vocabulary costs more than the rarest piece.
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 300_000
#: Words of at most so many bytes are searched as columns of one table.
SHORT = 48


@dataclass(frozen=True)
class DoubleArray:
    """Transition from s by byte c: t = base[s] + c if check[t] == s. piece[s] is the piece that ends in s, or -1."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray


def build_trie(keys: dict[bytes, int]) -> DoubleArray:
    """First-fit double array of the keys; state 0 is the root."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, value in sorted(keys.items()):
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = value
    size = 2 * len(children) + 512
    base, check, piece = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    free = np.ones(size, bool)
    free[0] = False
    low, hint, queue = 1, 1, [(0, 0)]
    for node, state in queue:
        piece[state] = ends[node]
        if not children[node]:
            continue
        codes = sorted(children[node])
        while not free[low]:
            low += 1
        if len(codes) == 1 and low > codes[0]:
            at = low - codes[0]
        else:
            at, own = 0, np.array(codes)
            hint, tried = max(hint, low), 0
            while not at:
                starts = np.arange(max(1, hint - codes[0]), hint - codes[0] + 1024)
                if hint + 1400 >= len(free):
                    grow = len(free)
                    base, check, piece = (np.concatenate([x, np.full(grow, v)]) for x, v in ((base, 0), (check, -1), (piece, -1)))
                    free = np.concatenate([free, np.ones(grow, bool)])
                fits = free[starts[:, None] + own].all(axis=1)
                if fits.any():
                    at = int(starts[fits.argmax()])
                else:
                    hint, tried = hint + 1024, tried + 1
            hint = hint if not tried else max(low, at + codes[0] - 512)
        if at + 300 >= len(free):
            grow = len(free)
            base, check, piece = (np.concatenate([x, np.full(grow, v)]) for x, v in ((base, 0), (check, -1), (piece, -1)))
            free = np.concatenate([free, np.ones(grow, bool)])
        base[state] = at
        for c in codes:
            free[at + c], check[at + c] = False, state
            queue.append((children[node][c], at + c))
    return DoubleArray(base, check, piece)


@dataclass(frozen=True)
class Model:
    """A vocabulary for Viterbi: trie and score of the pieces, ids of the 256 byte pieces, and what each id decodes to."""

    trie: DoubleArray
    score: np.ndarray
    byte_ids: np.ndarray
    plain: list[bytes]

    @property
    def unknown(self) -> float:
        return float(self.score.min()) - UNKNOWN_PENALTY


@lru_cache(maxsize=1)
def load(path: str) -> Model:
    """Pieces of a vocabulary file; log scores from their ranks."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    n = file.get_piece_size()
    keys, score, byte_ids, plain = {}, np.zeros(n), np.zeros(256, np.int64), [b""] * n
    for k in range(n):
        piece = file.id_to_piece(k)
        if file.is_byte(k):
            byte_ids[int(piece[3:5], 16)] = k
            plain[k] = bytes([int(piece[3:5], 16)])
        elif not (file.is_control(k) or file.is_unknown(k) or file.is_unused(k)):
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"piece {k} spans words")
            keys[piece.encode()] = k
            score[k] = -np.log1p(-min(0.0, file.get_score(k)))
            plain[k] = piece.replace(MARK, " ").encode()
    return Model(build_trie(keys), score, byte_ids, plain)


def paths(model: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The best path of each word, as `viterbi` finds it: (ids of all words, number of ids of each)."""
    length = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-length, kind="stable")
    split = int(np.searchsorted(-length[order], -SHORT))
    size, ids = np.zeros(len(words), np.int64), []
    for part in [order[:split], *(order[at : at + 8192] for at in range(split, len(words), 8192))]:
        own = [words[k] for k in part.tolist()]
        found, size[part] = short_paths(model, own, length[part]) if len(part) and length[part[0]] <= SHORT else _joined(viterbi(model, own))
        ids.append(found)
    # From the order of lengths to that of `words`.
    flat, at = np.concatenate(ids), np.zeros(len(words), np.int64)
    at[order] = np.cumsum(size[order]) - size[order]
    end = np.cumsum(size)
    return flat[np.repeat(at - (end - size), size) + np.arange(len(flat))], size


def _joined(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, "<u4"), *found]), np.array([len(x) for x in found], np.int64)


def short_paths(model: Model, words: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`paths` of words that come longest first: a column each, so that those with a byte at an offset are the first ones.

    Offsets ascend, so a place's best path is known before pieces start there, and of equal paths the one whose last piece
    is longer came first. The bytes of an uncovered character are steps of their own.
    """
    n, most, trie = len(words), int(length[0]), model.trie
    text = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in words), np.uint8).reshape(n, most).T.astype(np.int64)
    opens = (text & 0xC0) != 0x80
    active = np.searchsorted(-length, -np.arange(most + 1))  # words longer than the offset
    best, back = np.full((most + 1, n), -np.inf), np.zeros((most + 1, n), np.int64)
    by = np.zeros((most + 1, n), np.int64)
    best[0] = 0
    for at in range(most):
        first = live = np.flatnonzero(opens[at, : active[at]])
        state, bare, depth = np.zeros(len(live), np.int64), np.ones(n, bool), 0
        # Bytes of the character that begins here.
        wide = 1 + (text[at, first] >= 0xC0) + (text[at, first] >= 0xE0) + (text[at, first] >= 0xF0)
        alone = np.zeros(n, np.int64)
        alone[first] = wide
        while len(live) and at + depth < most:
            inside = np.searchsorted(live, active[at + depth])
            live, state = live[:inside], state[:inside]
            step = trie.base[state] + text[at + depth, live]
            ok = np.flatnonzero(trie.check[step] == state)
            live, state, depth = live[ok], step[ok], depth + 1
            piece = trie.piece[state]
            hit = np.flatnonzero(piece >= 0)
            if not len(hit):
                continue
            own, piece = live[hit], piece[hit]
            if depth <= 4:
                bare[own[alone[own] == depth]] = False
            value, target = best[at, own] + model.score[piece], at + depth
            better = np.flatnonzero(value > best[target, own])
            own = own[better]
            best[target, own], back[target, own], by[target, own] = value[better], depth, piece[better]
        for width in range(1, 5):
            own = first[(wide == width) & bare[first]]
            if len(own):
                value = best[at, own] + model.unknown
                for k in range(1, width):  # no piece ends within a character
                    back[at + k, own], by[at + k, own] = 1, model.byte_ids[text[at + k - 1, own]]
                own = own[value > best[at + width, own]]
                value = best[at, own] + model.unknown
                best[at + width, own], back[at + width, own], by[at + width, own] = value, 1, model.byte_ids[text[at + width - 1, own]]
    live, place, size, steps = np.flatnonzero(length > 0), length.copy(), np.zeros(n, np.int64), []
    while len(live):
        steps.append((live, by[place[live], live]))
        place[live] -= back[place[live], live]
        size[live] += 1
        live = live[place[live] > 0]
    end = np.cumsum(size)
    ids = np.zeros(int(end[-1]), "<u4")
    for k, (own, piece) in enumerate(steps):
        ids[end[own] - 1 - k] = piece
    return ids, size


def viterbi(model: Model, words: list[bytes]) -> list[np.ndarray]:
    """The best path of each word (UTF-8, markers in place): piece ids, byte pieces for uncovered characters.

    All words advance together: one trie step for all starts at once, then one relaxation for each offset. Ties go to the
    path whose last piece is longer.
    """
    if not words:
        return []
    lengths = np.array([len(w) for w in words])
    text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(lengths)])
    word = np.repeat(np.arange(len(words)), lengths)
    n, trie = len(text), model.trie
    opens = (text & 0xC0) != 0x80
    stop = start[word + 1] if n else np.zeros(0, np.int64)
    chars = np.flatnonzero(opens)
    after = np.minimum(np.append(chars[1:], n), stop[chars]) if n else chars
    froms, tos, ids = [], [], []
    alone = np.zeros(n, bool)
    at, state, depth = chars, np.zeros(len(chars), np.int64), 0
    next_char = np.zeros(n, np.int64)
    next_char[chars] = after
    while len(at):
        inside = at + depth < stop[at]
        at, state = at[inside], state[inside]
        step = trie.base[state] + text[at + depth]
        ok = trie.check[step] == state
        at, state, depth = at[ok], step[ok], depth + 1
        hit = trie.piece[state] >= 0
        froms.append(at[hit])
        tos.append(at[hit] + depth)
        ids.append(trie.piece[state[hit]])
        alone[at[hit][next_char[at[hit]] == at[hit] + depth]] = True
    bare = chars[~alone[chars]]
    froms.append(bare)
    tos.append(next_char[bare])
    ids.append(np.full(len(bare), -1))
    a, b, p = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)
    cost = np.where(p >= 0, model.score[p], model.unknown)
    # Nodes: byte offset k of word w is start[w] + w + k, so that a word's end differs from the next one's start.
    source, target = a + word[a], b + word[a]
    offset = b - start[word[a]]
    order = np.lexsort((source, target, offset))
    source, target, p, cost = source[order], target[order], p[order], cost[order]
    best, came, by = np.full(n + len(words), -np.inf), np.full(n + len(words), -1), np.full(n + len(words), -1)
    best[start[:-1] + np.arange(len(words))] = 0
    cut = np.flatnonzero(np.diff(offset[order], prepend=-1))
    for low, high in zip(cut, [*cut[1:], len(source)], strict=True):
        t, value = target[low:high], best[source[low:high]] + cost[low:high]
        first = np.flatnonzero(np.diff(t, prepend=-1))
        most = np.maximum.reduceat(value, first)
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
        top = np.flatnonzero(value == most[run])
        top = top[np.diff(run[top], prepend=-1) > 0]
        best[t[top]], came[t[top]], by[t[top]] = value[top], source[low + top], p[low + top]
    out: list[np.ndarray] = []
    for k, w in enumerate(words):
        node, first, path = int(start[k + 1] + k), int(start[k] + k), []
        while node != first:
            origin = int(came[node])
            if by[node] >= 0:
                path.append((int(by[node]),))
            else:
                path.append(tuple(model.byte_ids[list(w[origin - first : node - first])].tolist()))
            node = origin
        out.append(np.array([i for group in reversed(path) for i in group], "<u4"))
    return out


class Encoder:
    """Encodes texts word by word, each distinct word once."""

    def __init__(self, model: Model):
        self.model, self.words = model, WordIds(lambda words: paths(model, [self._spelt(w) for w in words]), CACHE_WORDS)
        self.plain = pa.array(model.plain, pa.large_binary())

    @staticmethod
    def split(text: str) -> str | None:
        """Words as cache keys, a blank between them: a marker before each is understood, but not before one that begins with a line feed."""
        if not text:
            return None
        if text[0] != " " and "  " not in text and " \n" not in text and MARK not in text:
            return text.replace("\n", " \n")
        marked = re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+", MARK + text.replace(" ", MARK))
        return " ".join(x[1:] if x[0] == MARK and x[1:2] != "\n" else x for x in marked)

    @staticmethod
    def _spelt(key: str) -> bytes:
        return (key if key[:1] == "\n" else MARK + key).encode("utf-8", "replace")

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin; their end comes last."""
        return self.words([self.split(t) for t in texts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        out = []
        for part in text_slices(texts):
            ids, cut = self.ids(part)
            out += [ids[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return out

    def texts(self, ids: np.ndarray, cut: np.ndarray) -> list[str]:
        """The text of each sequence: pieces and bytes put together, markers as blanks, the one before the text dropped."""
        _, offsets, data = self.plain.take(pa.array(ids)).buffers()
        at = np.frombuffer(offsets, np.int64)[cut].tolist() if len(ids) else [0] * len(cut)
        data = memoryview(data or b"")
        return [str(data[a:b], "utf-8", "replace").removeprefix(" ") for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of one sequence."""
        return self.texts(ids, np.array([0, len(ids)]))[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, model) -> Encoder:
    """One per worker process and vocabulary, so that its tasks share the words. `model`: a broadcast Model."""
    if path not in _encoders:
        _encoders[path] = Encoder(model.value)
    return _encoders[path]


SCHEMA = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the piece ids of every text."""
    model = docs.sparkSession.sparkContext.broadcast(load(path))  # a vocabulary, whatever the input

    def run(batches):
        own = encoder(path, model)
        for batch in batches:
            found = own.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, "<i4") for x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(load(path))  # a vocabulary, whatever the input

    def run(batches):
        own = encoder(path, model)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encodes and decodes every text: counts, the crc32 of the ids and the sha256 of the decoded text."""
    model = docs.sparkSession.sparkContext.broadcast(load(path))  # a vocabulary, whatever the input

    def run(batches):
        own = encoder(path, model)
        is_byte = np.zeros(len(own.model.plain), bool)
        is_byte[own.model.byte_ids] = True
        for batch in batches:
            rows, ids = [], iter(batch.column(0).to_pylist())
            for texts in text_slices([t or "" for t in batch.column(1).to_pylist()]):
                found, cut = own.ids(texts)
                n_bytes = np.append(0, np.cumsum(is_byte[found]))[cut]
                for text, back, a, b, k in zip(texts, own.texts(found, cut), cut[:-1].tolist(), cut[1:].tolist(), np.diff(n_bytes).tolist(), strict=True):
                    rows.append((next(ids), b - a, k, zlib.crc32(found[a:b]), hashlib.sha256(back.encode()).hexdigest(), back == text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, SCHEMA)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
