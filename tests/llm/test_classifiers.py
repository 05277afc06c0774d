import random
import zlib

import numpy as np
from kgspark.llm import quality_knn, toxicity, training
from tests.llm.conftest import prose


def labelled(spark, make, n=240):
    rng = random.Random(5)
    rows = [(i, make(i, y), "x", 0.0) for i in range(n) for y in [i % 2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in rng.sample(range(n), n - 20)], "doc_id long, quality int, toxic int")
    return docs, labels


def accuracy(rows, label):
    held = [r for r in rows if r.held_out]
    assert held and all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == label(r.doc_id) for r in held) / len(held)


def test_toxicity_learns_stems(spark):
    stems = ["grumblok", "snarvel", "wretchim"]

    def make(i, toxic):
        words = prose(i, 150).split()
        if toxic:
            for k in range(3):
                words.insert(17 * k + i % 40, stems[(i + k) % 3] + "aeiou"[(i * 7 + k) % 5] * (i % 3))
        return " ".join(words)

    docs, labels = labelled(spark, make)
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 240 and accuracy(rows, lambda i: i % 2) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    model = toxicity.train([(make(i, i % 2), i % 2) for i in range(200)])
    clean, misspelt, long = toxicity.Scorer(model)([prose(900, 60), prose(900, 60) + " you grumbllok snarvell", prose(901, 5000)])
    assert misspelt > 0.5 > max(clean, long)


def test_quality_learns_shapes(spark):
    def make(i, bad):
        return " | ".join(prose(i, 80).split()) if bad and i % 4 == 1 else "".join(w + "!! " for w in prose(i, 80).upper().split()) if bad else prose(i, 30 + i)

    docs, labels = labelled(spark, make)
    rows = quality_knn.classify(docs, labels).collect()
    assert len(rows) == 240 and accuracy(rows, lambda i: 1 - i % 2) >= 0.95


def test_odd_rows_and_empty_tables(spark, docs):
    table = docs([None, "", " \n", "good words here", "good words here", prose(1, 20_000)], [None, 1, 2, 3, 3, 4])
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality_knn):
        rows = module.classify(table, nothing).collect()
        assert len(rows) == 6 and all(r.score == 0 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [True]
        assert module.classify(table.limit(0), nothing).count() == 0
    one = spark.createDataFrame([(i, 1, 1) for i in (1, 3, 4, 5, 6, None)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality_knn):
        rows = module.classify(table, one).collect()
        assert all(r.score == (0 if r.doc_id in (None, 1, 2) else 1) for r in rows)


def test_sample_leaves_out_held_out_rows(spark, docs):
    ids = list(range(60))
    sample = training.labelled_sample(docs([f"text {i}" for i in ids]), spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int"), "toxic", {0: 10, 1: 100})
    learned = {int(t.split()[1]): y for t, y in sample}
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in learned)
    assert sum(y == 0 for y in learned.values()) == 10 and all(y == i % 2 for i, y in learned.items())


def test_sample_takes_an_id_once_and_long_texts(spark, docs, monkeypatch):
    """An id that stands 1500 times, with labels repeated too, is one row; texts of any length count until a class is full."""
    one, *three = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5][:4]
    ids = [one] * 1500 + three
    table = docs(["same text"] * 1500 + [prose(1, 30_000), "short", "also short"], ids).repartition(3)
    labels = spark.createDataFrame([(i, 1, 1) for i in [one, one, *three, three[0]]], "doc_id long, quality int, toxic int")
    sample = training.labelled_sample(table, labels, "toxic", {0: 5, 1: 5})
    assert sorted(len(t) for t, _ in sample) == sorted([9, 5, 10, len(prose(1, 30_000))])
    monkeypatch.setattr(training, "CLASS_CHARS", 1000)
    assert sorted(t for t, _ in training.labelled_sample(table, labels, "toxic", {0: 5, 1: 5})) == ["also short", "same text", "short"]


def test_votes_equal_a_loop_over_all_cosines():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 6)).astype(np.float32)
    known = rng.normal(size=(90, 6)).astype(np.float32)
    vectors, known = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (vectors, known))
    labels = rng.integers(0, 2, 90).astype(np.float32)
    model = quality_knn.Model(np.ones(1), np.zeros((1, 6)), known, labels)
    want = []
    for v in vectors.astype(np.float64):
        near = sorted(((float(v @ k), float(y)) for k, y in zip(known.astype(np.float64), labels, strict=True)), reverse=True)[: quality_knn.NEIGHBOURS]
        weight = [max(c, 1e-6) ** 4 for c, _ in near]
        want.append(sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight))
    assert np.allclose(quality_knn.vote(model, vectors), want, atol=1e-4)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=(30, 3)), rng.normal(size=(3, 2)), rng.normal(size=2))
    of = np.repeat(np.arange(5), [4, 1, 7, 3, 6])
    ids, share = rng.integers(0, 30, len(of)), rng.random(len(of))
    label, weight = np.array([0, 1, 1, 0, 1]), rng.random(5) + 0.5
    _, rows, by_row, weights, bias = toxicity.gradients(model, ids, share, of, label, weight)
    whole = np.zeros((30, 3))
    whole[rows] = by_row
    for value, grad in ((model.embeddings, whole), (model.weights, weights), (model.bias, bias)):
        for at in np.ndindex(value.shape):
            was = value[at]
            loss = []
            for step in (1e-5, -1e-5):
                value[at] = was + step
                loss.append(toxicity.gradients(model, ids, share, of, label, weight)[0])
            value[at] = was
            assert abs((loss[0] - loss[1]) / 2e-5 - grad[at]) < 1e-6


def test_scores_equal_a_plain_reading():
    """The score of the worst segment, word by word and bucket by bucket."""
    model = toxicity.train([(prose(i, 60) + (" grumblok" if i % 2 else ""), i % 2) for i in range(40)])
    for text in (prose(7, 100), prose(8, 23) + " grumblock snarvel", "one"):
        words = toxicity.WORDS.findall(text.lower())
        vectors = [np.mean([model.embeddings[b] for b in toxicity.buckets(w)], axis=0) for w in words]
        best = 0.0
        for k in range(0, len(words), toxicity.SEGMENT):
            z = np.mean(vectors[k : k + toxicity.SEGMENT], axis=0) @ model.weights + model.bias
            best = max(best, 1 / (1 + np.exp(z[0] - z[1])))
        assert abs(toxicity.Scorer(model)([text])[0] - best) < 1e-5
