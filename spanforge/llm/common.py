"""Helpers that every training-data operator shares: reading tables, staging in the shared folder, tree sums."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: 2,048 documents of a few KB stay far below a worker's memory.
ARROW_ROWS = 2048

#: In a local folder Hadoop starts a `chmod` for each new file and folder and each file of checksums beside one, and until such a
#: child has begun its own program all memory of the executor counts twice. Staged tables do without the files of checksums;
#: their pages carry checksums, which are verified. Other stores are left as they are.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_VERIFIED = {"parquet.page.write-checksum.enabled": "true", "parquet.page.verify-checksum.enabled": "true"}

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, whatever store `sf_dir` is in; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """This session's own folder below spark.checkpoint.dir, removed when the driver ends.

    Where the setting is absent (tests, notebooks) a temporary folder is used, in local mode only.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir")
        if not base and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = base or tempfile.mkdtemp(prefix="staging-")
        root = f"{base.rstrip('/')}/staging-{uuid.uuid4().hex}"
        _roots[sc.applicationId] = root
        atexit.register(_remove, spark, root)
    return _roots[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str = "stage", files: int | None = None) -> DataFrame:
    """`df` written to the shared folder and read back: cuts lineage, survives lost executors, is computed once.

    `files`: at most so many tasks and files, one at least, for a table whose rows were counted or bounded before.
    """
    spark = df.sparkSession
    df = df if files is None else df.coalesce(max(1, files))
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **_PLAIN, **_VERIFIED).parquet(path)
    return spark.read.options(**_VERIFIED).schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Removes the files behind a `staged` frame once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/staging-" in path:
            _remove(df.sparkSession, path)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches at ARROW_ROWS rows, so that a batch of long texts fits in a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_slices(texts: list[str], chars: int = 4_000_000) -> list[list[str]]:
    """`texts` in order, in runs of about `chars` characters (a longer text is its own run): what a run needs beside it stays small."""
    out, size = [[]], 0
    for text in texts:
        if out[-1] and size + len(text) > chars:
            out.append([])
            size = 0
        out[-1].append(text)
        size += len(text)
    return out


class WordIds:
    """Ids of texts word by word, each new word encoded once.

    `encode`: (all ids, number of ids of each word) of a list of words. `split`: a column of texts to lists of words; blanks
    part them if it is left out. Beyond `most` words those used most stay, half as many; which ones are known changes no result.
    """

    def __init__(self, encode, most: int, split=None):
        self.encode, self.most = encode, most
        self.split = split or (lambda texts: pc.split_pattern(texts, " "))
        self.known = pa.array([], pa.large_string())
        self.ids, self.start = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.size, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, and where each word's ids end there."""
        size = self.size[numbers]
        end = np.cumsum(size)
        place = np.repeat(self.start[numbers] - (end - size), size)
        place += np.arange(len(place))
        return self.ids[place], end

    def _forget(self) -> None:
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.most // 2:
            kept = np.sort(kept[np.argpartition(self.uses[kept], -(self.most // 2))[-(self.most // 2) :]])
        self.ids, end = self._gathered(kept)
        self.known, self.size, self.uses = self.known.take(pa.array(kept)), self.size[kept], self.uses[kept] // 2
        self.start = end - self.size

    def _learn(self, words: pa.Array) -> None:
        ids, size = self.encode(words.to_numpy(zero_copy_only=False).tolist())
        self.known = pa.concat_arrays([self.known, words])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.ids = np.concatenate([self.ids, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.size = np.concatenate([self.size, size])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's begin; their end comes last. Null: no words."""
        if len(self.size) > self.most:
            self._forget()
        words = self.split(pa.array(texts, pa.large_string()))
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        coded = words.flatten().dictionary_encode()
        place = pc.index_in(coded.dictionary, self.known)
        number = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.size) + np.arange(len(new))
            self._learn(coded.dictionary.take(pa.array(new)))
        found = number[coded.indices.to_numpy()]
        self.uses += np.bincount(found, minlength=len(self.size))
        ids, end = self._gathered(found)
        return ids, np.append(0, end)[np.append(0, np.cumsum(counts))]


def give_back() -> None:
    """Hands memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """A function for mapInArrow that hands back what its task has freed: workers are used again, by stages that need
    their memory otherwise."""
    @wraps(run)
    def own(batches):
        yield from run(batches)
        give_back()

    return own


def task_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def tree_sum(parts: DataFrame, dtype: str = "int64") -> np.ndarray | None:
    """Sums `parts` (column `part` binary, one fixed-length vector per task of `dtype`) in two rounds; null if there is none.

    About sqrt(tasks) vectors meet in a task of either round; the driver gets one vector.
    """
    def add(batches):
        total = None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                vector = np.frombuffer(blob, dtype)
                total = vector.copy() if total is None else total + vector
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    groups = max(1, int(parts.rdd.getNumPartitions() ** 0.5))
    rows = parts.repartition(groups).mapInArrow(add, "part binary").repartition(1).mapInArrow(add, "part binary").collect()
    return np.frombuffer(rows[0][0], dtype) if rows else None


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, rows: int, id_col: str = "doc_id", kind: str = "double") -> DataFrame:
    """`docs` with columns fit_id and fit_label (of `kind`) for at most `rows` labelled ids outside `held_out(id)`, those of smallest hash.

    The labelled ids are the only thing that is broadcast, and `rows` bounds them. Null ids and labels are no examples;
    an id labelled twice counts once, with its smaller label.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("fit_id")).agg(F.min(F.col(label)).cast(kind).alias("fit_label"))
        .orderBy(F.xxhash64("fit_id"), "fit_id").limit(rows)
    )
    return docs.join(F.broadcast(chosen), docs[id_col] == chosen["fit_id"])
