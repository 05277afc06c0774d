import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.llm import decontaminate as d
from tests.llm.conftest import prose


def brute_tiles(p, t, least):
    """Greedy string tiling by comparing all places."""
    free_p, free_t, tiles = [True] * len(p), [True] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return sorted(tiles)
        for k in range(n):
            free_p[i + k] = free_t[j + k] = False
        tiles.append((i, j, n))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=22))
def test_tiles_equal_greedy_string_tiling(p, t):
    tiles = d.tiling(np.array(p, np.uint64), np.array(t, np.uint64), 2)
    assert sorted((i, j, n) for n, i, j in tiles) == brute_tiles(p, t, 2)


def test_long_tiles_equal_greedy_string_tiling():
    """Passages of an item in another order, some broken, in a longer text."""
    rng = np.random.default_rng(1)
    for _ in range(5):
        p = rng.integers(0, 60, 45)
        cuts = np.sort(rng.choice(45, 4, replace=False))
        parts = np.split(p, cuts)
        t = np.concatenate([x for k in rng.permutation(5) for x in (parts[k], rng.integers(0, 60, 4), parts[k][: len(parts[k]) // 2])])
        tiles = d.tiling(p.astype(np.uint64), t.astype(np.uint64), 3)
        assert tiles and sorted((i, j, n) for n, i, j in tiles) == brute_tiles(p.tolist(), t.tolist(), 3)


def test_many_equal_items_go_to_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 2000)
    benchmark = spark.createDataFrame([(i, prose(1, 20)) for i in range(60)] * 2, "item_id long, text string")
    sizes = [len(b.ids) for b in d.blocks(benchmark)]
    assert sum(sizes) == 60 and max(sizes) < 25


def test_table(spark, docs):
    items = [prose(100 + i, 40) for i in range(5)] + ["alpha beta gamma", "", None]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(None, prose(100, 40), 2)], "item_id long, text string, doc_id long")
    words = items[1].split()
    reordered = " ".join(words[25:] + ["between"] * 3 + words[:12] + ["x"] + words[12:25])
    texts = [prose(1, 200) + " " + items[0].upper().replace(".", " !") + " " + prose(2, 100), reordered, prose(3, 300), " ".join(items[2].split()[:8]) + " " + prose(4, 100), None, "", "so alpha, beta gamma", prose(5, 15_000) + items[3], " ".join(items[4].split()[:22])]
    table = docs(texts + [reordered], [*range(len(texts)), 1])
    rows = d.contaminated(table, benchmark).collect()
    assert sorted((r.doc_id, r.item_id if r.item_id is not None else -1) for r in rows) == [(0, -1), (0, 0), (1, 1), (1, 1), (6, 5), (7, 3), (8, 4)]
    assert all(abs(r.coverage - sum(t.words for t in r.tiles) / r.n_words) < 1e-9 and r.coverage >= 0.5 for r in rows)
    kept = d.clean(table, benchmark)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]


def test_blocks_give_the_same(spark, docs, monkeypatch):
    rng = random.Random(3)
    items = [prose(i, 30) for i in range(30)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = docs([prose(50 + i, 60) + " " + (items[rng.randrange(30)] if i % 2 else "") for i in range(20)])
    whole = sorted((r.doc_id, r.item_id) for r in d.contaminated(table, benchmark).collect())
    monkeypatch.setattr(d, "BLOCK_BYTES", 2000)
    assert sorted((r.doc_id, r.item_id) for r in d.contaminated(table, benchmark).collect()) == whole and len(whole) == 10
    assert d.clean(table, benchmark).count() == 10


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs(["a b c"]), none).count() == 0 and d.clean(docs(["a b c"]), none).count() == 1
    some = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert d.contaminated(docs([]), some).count() == 0 and d.clean(docs([]), some).count() == 0
