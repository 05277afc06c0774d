"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words and their shapes (runs of capitals, small letters and digits, other characters as they
are), and marks for repeated words, hashed to columns. Log counts, weighted and normalised, are projected on the
leading singular vectors of a labelled sample. Those sample vectors are broadcast (SAMPLE rows of RANK numbers bound
their size); a block of documents is multiplied with all of them, and the NEIGHBOURS most similar vote with their
similarity as weight.

Null or empty texts and texts without words score 0. Null ids stay (held out), repeated rows each give a row, other
columns are not read. With no labelled rows every text scores 0; of one class only, that class.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import id_text, slices
from kgspark.llm.training import held_out, labelled_sample

WORD_COLUMNS, SHAPE_COLUMNS, RANK, NEIGHBOURS, BLOCK = 4096, 1024, 48, 15, 512
COLUMNS = WORD_COLUMNS + SHAPE_COLUMNS
SAMPLE = {0: 1500, 1: 1500}
SHAPE = [(re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_a]+"), "A"), (re.compile(r"\d+"), "0")]
CACHE_WORDS = 300_000


def shape(word: str) -> str:
    for pattern, to in SHAPE:
        word = pattern.sub(to, word)
    return word


class Terms:
    """Columns of words, remembered by a worker."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.columns: list[tuple[int, int]] = []

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and count of every term of each text."""
        if len(self.columns) > CACHE_WORDS:
            self.__init__()
        words = [t.split() for t in texts]
        flat = [w for ws in words for w in ws]
        for w in set(flat).difference(self.index):
            self.index[w] = len(self.columns)
            self.columns.append((zlib.crc32(w.lower().encode()) % WORD_COLUMNS, WORD_COLUMNS + 1 + zlib.crc32(shape(w).encode()) % (SHAPE_COLUMNS - 1)))
        ids = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        table = np.array(self.columns, np.int64).reshape(-1, 2)
        again = np.flatnonzero((ids[1:] == ids[:-1]) & (row[1:] == row[:-1])) + 1
        column = np.concatenate((table[ids, 0], table[ids, 1], np.full(len(again), WORD_COLUMNS)))
        key, n = np.unique(np.concatenate((row, row, row[again])) * COLUMNS + column, return_counts=True)
        return key // COLUMNS, key % COLUMNS, n


def weighted(row: np.ndarray, column: np.ndarray, n: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
    """Log counts times the columns' weights; words and shapes each get length 1."""
    value = np.log1p(n) * weights[column]
    kind = row * 2 + (column >= WORD_COLUMNS)
    length = np.sqrt(np.bincount(kind, value**2, rows * 2))
    return (value / np.maximum(length[kind], 1e-12)).astype(np.float32)


@dataclass
class Model:
    """weights: of the columns; axes: COLUMNS x RANK; vectors: one of length 1 for each sample row; labels: theirs."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, row: np.ndarray, column: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, self.axes.shape[1]), np.float32)
        if len(row):
            value = weighted(row, column, n, self.weights, rows)
            begin = np.flatnonzero(np.concatenate(([True], np.diff(row) > 0)))
            out[row[begin]] = np.add.reduceat(self.axes[column] * value[:, None], begin)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def fit(sample: list[tuple[str, int]], seed: int = 3) -> Model:
    """Truncated SVD of the sample by random projection and three power iterations."""
    texts, labels = [t for t, _ in sample], np.array([y for _, y in sample], np.float32)
    row, column, n = Terms().counts(texts)
    share = np.bincount(column, minlength=COLUMNS) / max(1, len(texts))
    weights = np.log(2 / (share + 1 / (len(texts) + 1))).clip(0.1).astype(np.float32)
    if not len(row):
        return Model(weights, np.zeros((COLUMNS, 1), np.float32), np.zeros((len(texts), 1), np.float32), labels)
    dense = np.zeros((len(texts), COLUMNS), np.float32)
    dense[row, column] = weighted(row, column, n, weights, len(texts))
    rank = min(RANK, len(texts))
    basis = np.random.default_rng(seed).normal(size=(COLUMNS, rank + 10)).astype(np.float32)
    for _ in range(3):
        basis = dense.T @ np.linalg.qr(dense @ basis)[0]
    _, _, axes = np.linalg.svd(np.linalg.qr(dense @ basis)[0].T @ dense, full_matrices=False)
    model = Model(weights, np.ascontiguousarray(axes[:rank].T, np.float32), np.zeros((0, rank), np.float32), labels)
    model.vectors = model.project(row, column, n, len(texts))
    return model


def vote(model: Model, vectors: np.ndarray) -> np.ndarray:
    """Exact cosine products with all labelled vectors, a block of documents at a time."""
    out = np.zeros(len(vectors))
    k = min(NEIGHBOURS, len(model.labels))
    for at in range(0, len(vectors) if k else 0, BLOCK):
        cosine = vectors[at : at + BLOCK] @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** 4
        out[at : at + BLOCK] = (weight * model.labels[near]).sum(1) / weight.sum(1)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the weighted share of good texts among the neighbours."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, model = Terms(), sent.value
        for part in slices(batches, 1):
            texts = part.column(1).to_pylist()
            row, column, n = terms.counts(texts)
            some = np.bincount(row, minlength=len(texts)) > 0
            scores = np.where(some, vote(model, model.project(row, column, n, len(texts))), 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels.quality of rows that are not held out."""
    model = fit(labelled_sample(docs, labels, "quality", SAMPLE))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
