"""What the operators of this folder share: tables, the shared folder, Arrow batches, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.sources.folders import remove, shared_dir

#: Characters of text that a Python worker holds at once, so memory does not follow the partition.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables written in each scratch() that is open, the innermost last.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written in it go at its end; what is to stay longer is written with up."""
    paths: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), paths))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            remove(spark, path)


def written(df: DataFrame, name: str, up: int = 0) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there, and losing executors loses nothing. It outlives `up` scratches."""
    spark, open_ = df.sparkSession, _SCRATCH.get()
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if up < len(open_):
        open_[-1 - up].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(df: DataFrame) -> DataFrame:
    """df, once the shuffle files of jobs that are over may go: Spark deletes them when the driver collects its garbage, else at some later time."""
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches again, cut where a slice's text (column number text) passes `most` bytes; a single longer text is a slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        total, start = np.cumsum(sizes), 0
        while start < len(total):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: For bytes.translate: 1 for white space, else 0; A-Z as a-z.
_SPACE = bytes(c in b" \t\n\v\f\r" for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_POWERS = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The odd base's powers and their inverses modulo 2**64."""
    if len(_POWERS["p"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("p", int(_ODD)), ("q", _inverse(int(_ODD)))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ([^\\x20\\x09-\\x0D]+, A-Z as a-z) of some texts, and where each text's words start.

    The result has len(texts) + 1 offsets. All texts are hashed at once from prefix sums over their bytes.
    """
    text = b" ".join(texts) + b" "
    if lower:
        text = text.translate(_LOWER)
    raw, space = np.frombuffer(text, np.uint8), np.frombuffer(text.translate(_SPACE), bool)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, stop = edge[::2], edge[1::2]
    p, q = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.multiply(_BYTE[raw], p[: len(raw)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    words = mix((sums[stop] - sums[start]) * q[start] + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return words, np.concatenate(([0], np.searchsorted(start, ends))).astype(np.int64)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one flat array of word hashes (windows over a text's end are the caller's to leave out)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - n + 1 + k]
    return mix(total)
