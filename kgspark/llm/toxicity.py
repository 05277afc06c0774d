"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of itself and its character n-grams, hashed to buckets; its vector is their embeddings' mean, and
a segment of SEGMENT words is its words' mean, which a linear softmax maps to the two classes. Embeddings and softmax
are trained jointly in numpy (AdaGrad). Words that were never seen share n-grams with words that were. A document is as
toxic as its most toxic segment, so long texts do not wash out a passage; training learns from the same segment. One mean
over the whole text was tried: see the README for its figures.

Null or empty texts and texts without words score 0. Null ids stay (held out), repeated rows each give a row, other
columns are not read. With no labelled rows, or rows of one class only, every text scores that class's share (else 0).
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

BUCKETS, DIM, SEGMENT, NGRAMS = 1 << 16, 8, 12, (3, 4, 5)
EPOCHS, WARM, RATE, BATCH = 12, 4, 1.0, 256
#: What AdaGrad's sums start from: rare n-grams move little, those of many toxic documents far.
DAMPING = 1e-4
#: Rows of each class that the fit takes at most.
SAMPLE = {0: 4000, 1: 2000}
WORDS = re.compile(r"\w+")
#: Words whose share a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 300_000
#: Words whose buckets are Python lists at once.
BAG_WORDS = 5_000


def buckets(word: str) -> list[int]:
    """The word's own bucket and those of its n-grams, ends marked."""
    raw = f"<{word}>"
    return [zlib.crc32(raw.encode()) % BUCKETS, *(zlib.crc32(raw[i : i + n].encode()) % BUCKETS for n in NGRAMS for i in range(len(raw) - n + 1))]


@dataclass
class Model:
    """embeddings: BUCKETS x DIM; weights: DIM x 2 and bias: 2 of the softmax; constant: the score where nothing was learned."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    constant: float | None = None

    def shares(self) -> np.ndarray:
        """What each bucket adds to the difference of the two logits: the softmax is linear, so averaging may follow it."""
        return self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])


class Bags:
    """Distinct words with their buckets as flat arrays."""

    def __init__(self, words: list[str]):
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for k in range(0, len(words), BAG_WORDS):
            bags = [buckets(w) for w in words[k : k + BAG_WORDS]]
            sizes.append(np.array([len(b) for b in bags], np.int32))
            parts.append(np.fromiter((x for b in bags for x in b), np.int32))
        self.n, self.flat = np.concatenate(sizes).astype(np.int64), np.concatenate(parts)
        self.at = np.cumsum(self.n) - self.n

    def means(self, by_bucket: np.ndarray) -> np.ndarray:
        return np.add.reduceat(by_bucket[self.flat], self.at) / self.n if len(self.n) else np.zeros(0)


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] numbers, then those from begin[1], and so on."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def gradients(model: Model, ids: np.ndarray, share: np.ndarray, of: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The weighted cross entropy of some segments, summed, and its gradients: rows of the embeddings and theirs, the softmax's weights, its bias.

    ids, share, of: buckets, what each is of its segment's mean, and its segment (rising).
    """
    hidden = np.add.reduceat(model.embeddings[ids] * share[:, None], np.flatnonzero(np.diff(of, prepend=-1)))
    z = hidden @ model.weights + model.bias
    z -= z.max(1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
    error = (np.exp(log_p) - np.eye(2, dtype=z.dtype)[label]) * weight[:, None]
    back = error @ model.weights.T
    rows, place = np.unique(ids, return_inverse=True)
    by_row = np.stack([np.bincount(place, back[of, d] * share, len(rows)) for d in range(back.shape[1])], 1)
    return float(-(weight * log_p[np.arange(len(label)), label]).sum()), rows, by_row, hidden.T @ error, error.sum(0)


def train(sample: list[tuple[str, int]], seed: int = 7) -> Model:
    """Each epoch takes every document's segment that scores highest so far (at first, all of toxic ones) and a random one of clean ones."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-0.5, 0.5, (BUCKETS, DIM)).astype(np.float32) / DIM, np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    index: dict[str, int] = {}
    texts, labels = [], []
    for text, y in sample:  # a text's words become numbers at once: as objects they would take many times the text's size
        words = np.fromiter((index.setdefault(w, len(index)) for w in WORDS.findall(text.lower())), np.int32)
        if len(words):
            texts.append(words), labels.append(y)
    if len(set(labels)) < 2:
        model.constant = float(labels[0]) if labels else 0.0
        return model
    flat, label = np.concatenate(texts), np.array(labels)
    bags, size = Bags(list(index)), np.array([len(w) for w in texts])
    del texts
    parts = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(size) - size, parts) + nth * SEGMENT
    count = np.minimum(SEGMENT, np.repeat(size, parts) - nth * SEGMENT)
    first = np.cumsum(parts) - parts
    seen_e, seen_w, seen_b = (np.full(x.shape, DAMPING, np.float32) for x in (model.embeddings, model.weights, model.bias))
    model.weights[:] = rng.normal(0, 0.3, model.weights.shape)
    for epoch in range(EPOCHS):
        logit = np.add.reduceat(bags.means(model.shares())[flat], begin) / count
        order = np.lexsort((-logit, doc))
        top, random = order[first], first + rng.integers(0, parts)
        chosen = np.concatenate((np.flatnonzero(label[doc] == 1), random) if epoch < WARM else (top, random[label == 0]))
        chosen = rng.permutation(chosen[(label[doc[chosen]] == 0) | (epoch < WARM) | np.isin(chosen, top)])
        balance = np.where(label[doc[chosen]] == 1, 0.5 / max(1, (label[doc[chosen]] == 1).sum()), 0.5 / max(1, (label[doc[chosen]] == 0).sum())) * len(chosen)
        for k in range(0, len(chosen), BATCH):
            seg = chosen[k : k + BATCH]
            word = flat[spread(begin[seg], count[seg])]
            own = np.repeat(np.arange(len(seg)), count[seg])
            ids = bags.flat[spread(bags.at[word], bags.n[word])]
            share = np.repeat(1.0 / (bags.n[word] * count[seg][own]), bags.n[word]).astype(np.float32)
            of = np.repeat(own, bags.n[word])
            _, rows, by_row, *others = gradients(model, ids, share, of, label[doc[seg]], balance[k : k + BATCH].astype(np.float32))
            for value, seen, grad in zip((model.weights, model.bias), (seen_w, seen_b), others, strict=True):
                grad = grad / len(seg)
                seen += grad**2
                value -= RATE * 0.2 * grad / np.sqrt(seen)
            seen_e[rows] += by_row**2
            model.embeddings[rows] -= RATE * by_row / np.sqrt(seen_e[rows])
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.by_bucket, self.bias = model, model.shares(), float(model.bias[1] - model.bias[0])
        self.known: dict[str, float] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [WORDS.findall(t.lower()) for t in texts]
        size = np.array([len(w) for w in words], np.int64)
        if self.model.constant is not None:
            return np.where(size > 0, self.model.constant, 0.0)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        flat = [w for ws in words for w in ws]
        new = list(set(flat).difference(self.known))
        self.known.update(zip(new, Bags(new).means(self.by_bucket).tolist(), strict=True))
        out = np.zeros(len(texts))
        if flat:
            value = np.fromiter(map(self.known.__getitem__, flat), np.float64, len(flat))
            parts = -(-size // SEGMENT)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = np.repeat(np.cumsum(size) - size, parts) + nth * SEGMENT
            mean = np.add.reduceat(value, begin) / np.minimum(SEGMENT, np.repeat(size, parts) - nth * SEGMENT)
            some = np.flatnonzero(parts)
            best = np.maximum.reduceat(mean, (np.cumsum(parts) - parts)[some])
            out[some] = 1 / (1 + np.exp(-np.clip(best + self.bias, -500, 500)))
        return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the probability that the text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels.toxic of rows that are not held out."""
    model = train(labelled_sample(docs, labels, "toxic", SAMPLE))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
