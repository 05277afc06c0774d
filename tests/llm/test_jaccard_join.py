import random
import re

import numpy as np
import pytest

from kgspark.llm import jaccard_join as j
from kgspark.llm.components import components
from tests.llm.conftest import prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(ids, texts):
    """n_shingles and component_id of each row, from all pairs."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(sets)):
        groups.setdefault(find(k), []).append(ids[k])
    least = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(zip(ids, sets, strict=True))]


def edited(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=1):
    rng = random.Random(seed)
    common = prose(77, 60)
    texts = [None, "", " \n ", "one two", "ONE\ttwo", "one two three", prose(500, 6000)]
    for g in range(12):
        base = prose(g, rng.choice([30, 60, 150, 400]))
        texts += [base] * rng.randint(1, 3) + [edited(base, rng, rng.randint(0, max(1, len(base.split()) // 25))) for _ in range(8)]
    texts += [common + " " + prose(1000 + i, rng.randint(5, 200)) for i in range(60)]
    chain = prose(2000, 120)
    for _ in range(12):  # neighbours of the chain link, its ends do not
        texts.append(chain := edited(chain, rng, 2))
    rng.shuffle(texts)
    ids = [None if k == 5 else k % (len(texts) - 3) for k in range(len(texts))]
    return ids, texts


def linked(docs, ids, texts):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.link(docs(texts, ids)).collect()), key=str)


def test_equals_brute_force(docs):
    ids, texts = corpus()
    assert linked(docs, ids, texts) == sorted(brute(ids, texts), key=str)


def test_hot_shingles_trees_blocks_and_joins_change_nothing(docs, monkeypatch):
    ids, texts = corpus(2)
    for name, value in (("HOT", 4), ("NODE_PAIRS", 2), ("GROUP_ROWS", 10), ("BROADCAST_ROWS", -1), ("SALTS", 3), ("DEALS", 2)):
        monkeypatch.setattr(j, name, value)
    assert linked(docs, ids, texts) == sorted(brute(ids, texts), key=str)


def test_one_of_each(docs):
    ids, texts = corpus(3)
    ids = [i if i is not None else 10_000 for i in ids]
    table = docs(texts, ids)
    want = {i for i, n, c in brute(ids, texts) if n == 0 or i == c} - {i for i, n, c in brute(ids, texts) if n and i != c}
    kept = j.one_of_each(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == want
    assert j.one_of_each(docs(["a b", "a b", None], [None, None, 3])).count() == 3
    assert j.one_of_each(docs(["a b c", "a b c"], [4, 4])).count() == 1


def test_empty_table(docs):
    assert j.link(docs([])).count() == 0 and j.one_of_each(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_forest_equals_all_pairs_of_each_group(seed, monkeypatch):
    """What the trees leave of groups of any size is what the bounds leave of all pairs; every link is among it."""
    monkeypatch.setattr(j, "NODE_PAIRS", 50)
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 150))
    start = np.unique(np.append(0, rng.choice(n, min(n, 10))))
    base = [np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) for size in rng.integers(5, 400, 6)]
    sets = []
    for _ in range(n):
        b = base[rng.integers(6)]
        cut = rng.integers(0, len(b) // 4 + 1)
        sets.append(np.unique(np.concatenate((b[cut:], rng.integers(0, 2**63, cut).astype(np.uint64)))))
    points, sizes = np.stack([j.point(x) for x in sets]), np.array([len(x) for x in sets])
    comp, rank, half = rng.integers(0, 8, n), rng.integers(0, 2, n), rng.integers(0, 2, n) if seed % 2 else np.full(n, -1)
    got = [tuple(sorted(p)) for p in zip(*(x.tolist() for x in j.group_pairs(start, comp, points, sizes, rank, half)), strict=True)]
    want, links = set(), set()
    for begin, end in zip(start.tolist(), [*start[1:].tolist(), n], strict=True):
        for a in range(begin, end):
            for b in range(begin, a):
                if comp[a] == comp[b] or half[a] >= 0 and half[a] == half[b]:
                    continue
                if j.enough(len(np.intersect1d(sets[a], sets[b])), sizes[a], sizes[b]):
                    links.add((b, a))
                left = min(sizes[a] - rank[a], sizes[b] - rank[b])
                if (100 + j.THRESHOLD) * left >= j.THRESHOLD * (sizes[a] + sizes[b]) and len(j.survivors(np.array([a]), np.array([b]), points, sizes)):
                    want.add((b, a))
    assert len(got) == len(set(got)) and set(got) == want
    assert seed or links and links <= want


def test_forest_leaves_out_whole_nodes():
    """Unlike sets are ruled out far above the points: far fewer pairs of nodes are bounded than there are pairs of rows."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.multinomial(300, p, 250) for p in rng.dirichlet(np.full(j.DIMENSIONS, 0.05), 8)]).astype(np.uint8)
    forest = j.Forest(np.array([0]), np.arange(2000), points, np.full(2000, 300), np.full(2000, 300), np.full(2000, -1))
    bounded, possible = [], forest.possible
    forest.possible = lambda a, b: bounded.append(len(a)) or possible(a, b)
    kept = sum(len(i) for i, _ in forest.self_join())
    assert kept < sum(bounded) < 0.2 * 2000 * 1999 / 2


def test_all_hot_keys_of_near_copies_are_salted(docs):
    """Of many copies with a word or two changed, no key stays that HOT classes or more share and that is not salted."""
    rng = random.Random(9)
    base = prose(31, 200)
    table = docs([edited(base, rng, 2) for _ in range(120)]).select("doc_id", "text")
    last, salted = j.hot_keys(table)
    assert np.isin(last, salted).all()
    counts = {}
    for r in j.described(table, last, salted).collect():
        for key, salt in zip(r["keys"] or [], r["salted"] or [], strict=True):
            counts[key] = counts.get(key, 0) + (not salt)
    assert max(counts.values()) < 2 * j.HOT


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101), (101, 102), (102, 100)], [(i, i // 2) for i in range(1, 64)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes, want = {x for e in links if e[0] != e[1] for x in e}, {}
    for n in sorted(nodes):
        group, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for a, b in links:
                for y in ({a, b} - group if x in (a, b) else ()):
                    group.add(y), todo.append(y)
        want[n] = min(group)
    assert got == want
