import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.llm import passages as p
from kgspark.llm.common import scratch
from tests.llm.conftest import prose


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=0, max_size=60, unique=True), st.integers(2, 8))
def test_windows_hold_every_long_passage_once(values, least):
    """Each passage of `least` tokens or more lies in exactly one window, around its minimum."""
    found = list(zip(*(x.tolist() for x in p.compact_windows(np.array(values, np.uint64), np.array([0]), np.array([len(values)]), least)), strict=True))
    for i in range(len(values)):
        for k in range(i + least - 1, len(values)):
            holding = [c for a, c, b in found if a <= i <= c <= k <= b]
            assert len(holding) == 1 and values[holding[0]] == min(values[i : k + 1])


def test_windows_of_several_texts_stay_apart():
    """What is found in texts that lie in one array is what is found in each; short texts and tokens that are no centres have none."""
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 3, 60, 45, 46, 47, 300, 1)]
    for x in parts:
        x[rng.random(len(x)) < 0.2] = p.NEVER
    parts.append(np.full(70, p.NEVER))
    ends = np.cumsum([len(x) for x in parts])
    begin = ends - [len(x) for x in parts]
    got = list(zip(*(x.tolist() for x in p.compact_windows(np.concatenate(parts), begin, ends)), strict=True))
    want = [(int(a + s), int(c + s), int(b + s)) for x, s in zip(parts, begin, strict=True) for a, c, b in zip(*p.compact_windows(x, np.array([0]), np.array([len(x)])), strict=True)]
    assert got == want and len(want) > 10


def test_packed_tokens():
    tokens = np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64)
    assert (p.unpacked(p.packed(tokens)) == (tokens >> np.uint64(40))).all() and not len(p.unpacked(p.packed(tokens[:0])))


def shared_grams(texts):
    """Row numbers that share a run of 50 words with another text or have a copy."""
    where = {}
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        for i in range(len(words) - 49):
            where.setdefault(tuple(words[i : i + 50]), set()).add(k)
    return {k for rows in where.values() if len(rows) > 1 for k in rows}


def test_repeated_passages_are_found(docs):
    rng = random.Random(6)
    shared = [prose(500 + i, rng.randint(52, 90)) for i in range(6)]
    texts = [prose(i, rng.randint(0, 200)) + " " + (shared[i % 6] if i % 3 else "") + " " + prose(1000 + i, rng.randint(0, 200)) for i in range(60)]
    near = shared[0].split() * 1 + prose(900, 100).split()
    texts += [" ".join(near), " ".join(w if k % 45 else f"other{k}" for k, w in enumerate(near)), None, "", prose(1, 40), prose(1, 40), prose(2, 60), prose(2, 60).upper(), "word " * 400, prose(3000, 8000) + " " + shared[1]]
    rows = p.repeated(docs(texts)).collect()
    got = {r.doc_id for r in rows}
    want = shared_grams(texts)
    assert want <= got and {60, 61} <= got
    assert not got - want - {60, 61}
    for r in rows:
        words, other = (texts[i].split() for i in (r.doc_id, r.partner_id))
        assert r.partner_id != r.doc_id and r.n_words >= 50 and r.start_word + r.n_words <= len(words) and 0.8 <= r.similarity <= 1
        assert r.partner_start < len(other)
        if r.similarity == 1 and r.n_words < 200:
            assert [w.lower() for w in words[r.start_word : r.start_word + r.n_words]] == [w.lower() for w in other[r.partner_start : r.partner_start + r.n_words]]


def test_near_duplicates_of_brute_force(docs):
    """Of texts with a few words changed, those with long similar passages are found (recall 0.9 or more)."""
    rng = random.Random(8)
    base = [prose(i, 120) for i in range(40)]
    texts = base + [" ".join(f"x{rng.random()}" if rng.random() < 0.012 else w for w in t.split()) for t in base]
    rows = p.repeated(docs(texts)).collect()
    pairs = {(r.doc_id, r.partner_id) for r in rows}
    assert sum((i + 40, i) in pairs or (i, i + 40) in pairs for i in range(40)) >= 36


def test_repeated_rows_null_ids_and_empty_table(docs):
    text = prose(5, 70)
    assert p.repeated(docs([text, text], [3, 3])).count() == 0
    rows = p.repeated(docs([text, text, text], [3, None, 4])).collect()
    assert {(r.doc_id, r.partner_id) for r in rows} == {(3, 4), (4, 3), (None, 3)}
    assert p.repeated(docs([])).count() == 0


def test_hot_leader_is_salted(docs, monkeypatch):
    monkeypatch.setattr(p, "PER_LEADER", 3)
    monkeypatch.setattr(p, "GROUP_ROWS", 10)
    monkeypatch.setattr(p, "BROADCAST_ROWS", -1)
    shared = prose(9, 80)
    texts = [prose(i, 30) + " " + shared + " " + prose(100 + i, 20) for i in range(25)]
    assert {r.doc_id for r in p.repeated(docs(texts)).collect()} == set(range(25))


@pytest.mark.parametrize("group_rows", [5000, 20])
def test_near_passages_with_a_frequent_line_in_smaller_texts(docs, monkeypatch, group_rows):
    """Of texts that share a near passage around a line of many others, each is verified against one that has the passage, not only the line."""
    monkeypatch.setattr(p, "GROUP_ROWS", group_rows)
    line = prose(77, 30)
    common = [prose(i, 40) + " " + line + " " + prose(500 + i, 40) for i in range(120)]
    near = []
    for i in range(30):
        words = f"{prose(2000 + i, 15)} {line} {prose(3000 + i, 15)}".split()
        for k in range(2):
            near.append(" ".join([*prose(4000 + 2 * i + k, 30).split(), *(f"other{i}" if k and n == 30 else w for n, w in enumerate(words)), *prose(5000 + 2 * i + k, 30).split()]))
    pairs = {(r.doc_id, r.partner_id) for r in p.repeated(docs(common + near)).collect()}
    assert sum((120 + 2 * i, 121 + 2 * i) in pairs or (121 + 2 * i, 120 + 2 * i) in pairs for i in range(30)) >= 29


def test_group_size_changes_no_row(docs, monkeypatch):
    """Rounds in tables, in tasks, or in both, whatever a Bloom filter lets through and however copies are dealt out: the same rows."""
    line, rng = prose(77, 30), random.Random(3)
    texts = [prose(i, 40) + " " + line + " " + prose(500 + i, 40) for i in range(20)]
    for i in range(3):
        left, right = prose(2000 + i, 40).split(), prose(3000 + i, 40).split()
        for k in range(14):
            words = [*left[rng.randint(0, 30) :], *line.split(), *right[: rng.randint(10, 40)]]
            words[rng.randrange(len(words))] = f"other{i}x{k}"
            texts.append(" ".join([prose(4000 + 20 * i + k, 30), *words, prose(5000 + 20 * i + k, 30)]))
    twice = [prose(i, 30) + " " + prose(900, 60) + " " + prose(700 + i, 30) for i in (9001, 9002)]
    rows = docs(texts + twice)
    want = sorted(p.repeated(rows).collect())
    for size in (1, 30):
        monkeypatch.setattr(p, "GROUP_ROWS", size)
        assert sorted(p.repeated(rows).collect()) == want
    monkeypatch.setattr(p.Sketch, "may_have", lambda self, v: np.ones(len(v), bool))
    assert sorted(p.repeated(rows).collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr(p, "GROUP_ROWS", 1)
    assert sorted(p.repeated(rows.repartition(7)).collect()) == want


@pytest.mark.parametrize("group_rows", [1, 3, 40])
def test_rounds_in_tables_are_those_of_a_task(spark, monkeypatch, group_rows):
    """Near families that one round does not finish, in groups of several sizes: the same pairs as in one task."""
    rng, width = np.random.default_rng(8), 2 * p.LEAST - 1
    rows = []
    for v, (families, members) in enumerate([(12, 9), (5, 3), (1, 2), (30, 1)]):
        line = rng.integers(1, 1 << 16, 24)
        for _ in range(families):
            base = rng.integers(1, 1 << 16, width)
            for _ in range(members):
                own = base.copy()
                reach = int(rng.integers(p.LEAST, width))
                at = int(rng.integers(0, width - reach + 1))
                own[:at], own[at + reach :] = rng.integers(1, 1 << 16, at), rng.integers(1, 1 << 16, width - at - reach)
                own[rng.integers(0, width, 3)] = rng.integers(1, 1 << 16, 3)
                own[p.LEAST - 12 : p.LEAST + 12] = line
                rows.append((v, int(rng.integers(-(1 << 62), 1 << 62)), 0, len(rows), 2, own.astype(np.uint16).tobytes()))
    rows = spark.createDataFrame(rows, "v long, cls long, a int, c int, b int, around binary")
    want = set(p.met_in_tasks(rows, rows.select("v", "cls")).collect())
    monkeypatch.setattr(p, "GROUP_ROWS", group_rows)
    assert want and set(p.met_in_tables(rows).collect()) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # joins by v, whose partitions an exchange by v would take over
    try:
        assert set(p.met_in_tables(rows).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    some = rows.where("c % 2 = 0")
    assert set(p.met_in_tasks(rows, some.select("v", "cls")).collect()) == set(p.met_in_tasks(some.unionByName(some), some.select("v", "cls")).collect())


def contexts_of(rng):
    """Seven contexts: 1, 3 and 6 are alike, and 2 and 5; 7 shares a line with all of a second group."""
    width = 2 * p.LEAST - 1
    texts = rng.integers(1, 1 << 16, (4, width)).astype(np.uint16)
    rows = texts[[0, 1, 2, 1, 3, 2, 1]].copy()
    rows[6, :30] = rng.integers(1, 1 << 16, 30)
    rows[5, p.LEAST + 5 :] = rows[5, p.LEAST + 4 : -1].copy()  # a word put in
    return rows


def test_rows_that_are_alike_meet():
    rows = contexts_of(np.random.default_rng(4))
    x, y = p.met_in_columns(np.zeros(7, int), rows)
    met = {frozenset(e) for e in zip(x.tolist(), y.tolist(), strict=True)}
    assert {frozenset({2, 5}), frozenset({1, 3}), frozenset({1, 6})} <= met <= {frozenset(e) for e in [(2, 5), (1, 3), (1, 6), (3, 6)]}
    apart = p.met_in_columns(np.array([0, 0, 0, 1, 1, 1, 1]), rows)  # nothing meets across groups
    assert {frozenset(e) for e in zip(*(k.tolist() for k in apart), strict=True)} == {frozenset({3, 6})}


def test_rows_meet_whatever_line_their_group_has_in_common():
    """200 contexts with one line of 24 tokens around the centre, 40 of them in pairs with a longer passage: each of the pairs is found, and nothing else."""
    rng = np.random.default_rng(5)
    rows = rng.integers(1, 1 << 16, (200, 2 * p.LEAST - 1)).astype(np.uint16)
    rows[:, p.LEAST - 12 : p.LEAST + 12] = rng.integers(1, 1 << 16, 24)
    order = rng.permutation(200)
    for i, j in zip(order[:20], order[20:40], strict=True):
        at = rng.integers(0, 20)
        rows[j, p.LEAST - 13 - at : p.LEAST + 32 - at + 1] = rows[i, p.LEAST - 13 - at : p.LEAST + 32 - at + 1]
    x, y = p.met_in_columns(np.zeros(200, int), rows)
    assert {frozenset(e) for e in zip(x.tolist(), y.tolist(), strict=True)} == {frozenset(e) for e in zip(order[:20].tolist(), order[20:40].tolist(), strict=True)}


def test_matches_follow_the_diagonal():
    """Passages of long texts of one word need no more than a band of matches; diagonals are counted alike by listing and by convolution."""
    one = np.full(100_000, 7, np.uint32)
    tracemalloc.start()
    assert [m[1] for m in p.passages(one, one, [(0, 0)])] == [100_000]
    assert sum(n for _, n, *_ in p.further(np.concatenate([one, one]), one, [(0, 100_000)])) >= 99_000
    assert tracemalloc.get_traced_memory()[1] < 1_000_000_000
    tracemalloc.stop()
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 4, 300) * rng.integers(0, 2, 300) - 1, rng.integers(0, 3, 120)
    want = np.zeros(420, int)
    for i in range(300):
        for j in range(120):
            want[i - j + 120] += x[i] == y[j] and x[i] >= 0
    listed = p.diagonals(x, y)
    p.MATCHES, kept = 50, p.MATCHES
    counted = p.diagonals(x, y)
    p.MATCHES = kept
    assert (listed == want).all() and (counted == want).all()


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_recall_by_similarity_band(docs):
    """Pairs of passages of 55 to 200 words with words changed, put in and left out, half of them around a common line, within groups of two to five."""
    rng = random.Random(12)
    line = prose(700, 12).split()
    texts, pairs = [], []
    for k in range(110):
        words = prose(800 + k, rng.randint(55, 200)).split()
        if k % 2:
            at = rng.randrange(len(words))
            words[at:at] = line
        near = [list(words) for _ in range(rng.randint(1, 4))]
        for other in near:
            for _ in range(max(1, round(len(words) * rng.choice([0.008, 0.015, 0.02])))):
                i, what = rng.randrange(len(other)), rng.random()
                other[i : i + 1] = [] if what < 0.15 else [other[i], f"in{rng.random()}"] if what < 0.3 else [f"new{rng.random()}"]
        first = len(texts)
        for own in [words, *near]:
            texts.append(" ".join([*prose(5000 + len(texts), rng.randint(0, 80)).split(), *own, *prose(9000 + len(texts), rng.randint(0, 80)).split()]))
        pairs += [(first, first + 1 + i, similarity(words, other)) for i, other in enumerate(near)]
    rows = p.repeated(docs(texts)).collect()
    linked = {(r.doc_id, r.partner_id) for r in rows}
    near = {d: {b for a, b in linked if a == d} for d in {a for a, _ in linked}}
    for low, high, least in ((0.8, 0.85, 0.9), (0.85, 0.9, 0.95), (0.9, 1.01, 0.98)):
        band = [(a, b) for a, b, s in pairs if low <= s < high]
        found = sum(b in near.get(a, ()) or any(b in near[c] for c in near.get(a, ())) for a, b in band)
        print(f"similarity {low} to {high}: {found} of {len(band)}")
        assert len(band) > 20 and found >= least * len(band)


def test_every_verified_pair_is_listed_for_both_texts(docs):
    shared = prose(9, 80)
    rows = p.repeated(docs([prose(i, 30) + " " + shared + " " + prose(100 + i, 20) for i in range(12)])).collect()
    pairs = {(r.doc_id, r.partner_id) for r in rows}
    assert len(pairs) >= 22 and all((b, a) in pairs for a, b in pairs)


def test_copies_are_members_of_a_text(docs):
    shared, copy = prose(9, 80), prose(10, 70)
    texts = [shared + " " + copy] * 3 + [shared + " " + prose(11, 70)] * 2
    rows = p.repeated(docs(texts, [4, 5, 6, 7, 8])).collect()
    assert {(r.doc_id, r.text_id, r.copies) for r in rows} == {(4, 4, 3), (5, 4, 3), (6, 4, 3), (7, 7, 2), (8, 7, 2)}
    assert {(4, 7), (7, 4), (5, 7), (8, 4)} <= {(r.text_id if r.doc_id in (4, 7) else r.doc_id, r.partner_id) for r in rows}


def test_all_places_of_a_passage_are_listed(docs):
    shared = prose(9, 60)
    texts = [" ".join([prose(1, 30), shared, prose(2, 90), shared, prose(3, 20), shared]), " ".join([prose(4, 200), shared, prose(5, 10), shared])]
    rows = p.repeated(docs(texts)).collect()
    starts = {(r.doc_id, r.start_word) for r in rows if r.n_words >= 60}
    assert {(0, 30), (0, 180), (0, 260), (1, 200), (1, 270)} <= starts and len(rows) == 5
    assert all(r.similarity == 1 and texts[r.partner_id].split()[r.partner_start] == shared.split()[0] for r in rows)


def test_further_places_with_words_changed_and_of_one_word():
    rng = np.random.default_rng(1)
    span = rng.integers(0, 1 << 32, 70).astype(np.uint32)
    near = np.concatenate([span[:33], rng.integers(0, 1 << 32, 5).astype(np.uint32), span[38:]])
    x = np.concatenate([span, near, rng.integers(0, 1 << 32, 500).astype(np.uint32), span[:60], span[10:]])
    places = sorted(p.further(x, span, [(0, 70)]))
    assert [(s, n) for s, n, *_ in places] == [(70, 70), (640, 60), (700, 60)]
    one = np.full(1000, 7, np.uint32)
    assert sum(n for _, n, *_ in p.further(one, one[:100], [(0, 100)])) >= 850


def test_tables_on_the_way_go_before_the_result(docs, monkeypatch):
    """When passages are a table, what led to them takes no disk any more; the number of parts changes no row."""
    names = []
    written = p.written
    monkeypatch.setattr(p, "written", lambda df, name, up=0: names.append((name, out := written(df, name, up))) or out)
    shared = prose(9, 80)
    texts = docs([prose(i, 30) + " " + shared + " " + prose(100 + i, 20) for i in range(9)])
    with scratch(texts.sparkSession):
        want = p.repeated(texts)
        there = set()
        for name, table in names:
            try:
                there |= {name} if table.inputFiles() and table.count() >= 0 else set()
            except Exception:  # its files are gone
                pass
        assert there == {"passage-rows", "passages", "passage-classes"}
        want = sorted(want.collect())
    monkeypatch.setattr(p, "PARTS", 1)
    assert want and sorted(p.repeated(texts).collect()) == want


def test_text_classes_follow_the_words_and_their_order():
    one, two = prose(1, 60).split(), prose(2, 60).split()
    texts = [one, two, one, one[::-1], [], one[:-1], one + two[:1], two]
    words, at = p.word_hashes([" ".join(t).encode() for t in texts])
    got = p.text_classes(words, at).tolist()
    assert [got.index(c) for c in got] == [0, 1, 0, 3, 4, 5, 6, 1]
    alone = [p.text_classes(*p.word_hashes([" ".join(t).encode()]))[0] for t in texts]
    assert alone == got


def test_first_places_of_texts_that_repeat_tokens():
    rng = np.random.default_rng(2)
    doc = np.sort(rng.integers(0, 40, 5000))
    tokens = rng.integers(0, 300, 5000).astype(np.uint64)
    seen = set()
    assert p.first_places(tokens, doc).tolist() == [(t, d) not in seen and not seen.add((t, d)) for t, d in zip(tokens.tolist(), doc.tolist(), strict=True)]
    assert p.first_places(tokens[:0], doc[:0]).tolist() == []
