"""Exact Jaccard join of documents over 5-word shingles by R-trees of count vectors.

Documents with equal shingle sets are one class; classes are joined.
1. Two sets with a similarity of THRESHOLD share one of the first shingles of both, in any order of all shingles. The order
   is by hash, with shingles that many classes have in that prefix last (found by counting, all documents, repeated ROUNDS
   times); whatever that list holds, the join stays exact. Classes that share a prefix shingle meet in its group, which is
   salted if many do.
2. In each group every class is compared with one of it, chosen by a hash of class and key, and links found there are
   contracted to components: members of a large group of near copies need not all be compared with one another.
3. Shingles are hashed into DIMENSIONS groups; a class's counts by group are a point, and the sum of the coordinate minima of
   two points bounds their overlap, and so do their shingles from the group's on, which is tried as if it were the first they share.
   The points of every group, of any size, are packed in an R-tree down to single points. A tree is joined with itself: pairs of
   nodes whose boxes' upper corners, sizes or components rule all pairs below out are left with them. What pairs of points survive are
   bounded once more by points of as many dimensions as the sets are large, and the rest verified on the sets themselves.
Groups of over GROUP_ROWS points are cut in blocks, and pairs of blocks are searched. Lists that go to all tasks are bounded
(HOT_KEYS keys) or checked (BROADCAST_ROWS ids; beyond it the tables are joined by shuffling).

Words are [^\\x20\\x09-\\x0D]+ with A-Z as a-z; a text of fewer than five words is one shingle. Null or empty texts, and texts
without words, have no shingles and link with nothing. Rows repeated with their id, and rows without id, are documents of
their own; a component's id is its least id, and null only where all its ids are. Shingles and classes are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import free_name, id_text, mix, ngram_hashes, slices, word_hashes, written
from kgspark.llm.components import components

SHINGLE, THRESHOLD, DIMENSIONS = 5, 80, 128
#: A shingle in the prefixes of this many classes is hot. Hot ones are put last, ROUNDS times, at most so many; a last count finds what is hot then.
HOT, HOT_KEYS, ROUNDS, SALTS = 30, 1 << 18, 3, 64
GROUP_ROWS, BROADCAST_ROWS = 20_000, 1_000_000
#: Pairs of nodes that are bounded at once.
NODE_PAIRS = 1 << 16
#: Groups of up to TOGETHER rows that have much the same classes are dealt to DEALS tasks; pairs that a task remembers so as not to list them again.
TOGETHER, DEALS, MOST_TOLD = 4_000, 64, 1_000_000
#: A coordinate of this value stands for any larger count: its point is never pruned.
FULL = 255


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes([t.encode() for t in texts])
    grams, out = ngram_hashes(words, SHINGLE), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            own = np.sort(grams[a : b - SHINGLE + 1])
            same = own[1:] == own[:-1]
            out.append(own[np.concatenate(([True], ~same))] if same.any() else own)
        else:
            out.append(mix(ngram_hashes(words[a:b], b - a) + np.uint64(b - a)) if b > a else grams[:0])
    return out


def class_id(shingles: np.ndarray) -> int:
    """A 64-bit hash of the set, from its size, sum and exclusive or."""
    total = int(shingles.sum(dtype=np.uint64)) * 0x9E3779B97F4A7C15 + int(np.bitwise_xor.reduce(shingles)) * 0xC2B2AE3D27D4EB4F + len(shingles)
    total &= (1 << 64) - 1
    total = (total ^ total >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    total ^= total >> 32
    return total - (1 << 64) if total >> 63 else total


def among(shingles: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which shingles are among some others, which are sorted."""
    return some[np.minimum(np.searchsorted(some, shingles), len(some) - 1)] == shingles if len(some) else np.zeros(len(shingles), bool)


def prefix(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order."""
    p = len(shingles) + (-THRESHOLD * len(shingles)) // 100 + 1
    last = among(shingles, hot)
    return np.concatenate((shingles[~last], shingles[last]))[:p] if last.any() else shingles[:p]


def point(shingles: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts by group: the hash's lowest bits, so that half as many groups are sums of two."""
    return np.minimum(np.bincount((shingles & np.uint64(dimensions - 1)).astype(np.int64), minlength=dimensions), FULL).astype(np.uint8)


def fine_point(shingles: np.ndarray) -> np.ndarray:
    """A point with so many dimensions that a group holds two shingles or fewer on average."""
    return point(shingles, max(DIMENSIONS, 1 << max(0, len(shingles) // 2 - 1).bit_length()))


def enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b that share `overlap` reach the threshold."""
    return 100 * overlap >= THRESHOLD * (a + b - overlap)


class Forest:
    """R-trees over the points of the rows of many groups, all built at once, a level at a time.

    A node is split in halves: by half (see self_join) if it has rows of both, by set size if sizes may rule links out, else at the median of its widest
    coordinate. Each node has the upper corner of its box, the range of set sizes, the most that a set has left from the group's
    shingle on, and the ranges of components and halves.
    """

    def __init__(self, start: np.ndarray, comp: np.ndarray, points: np.ndarray, sizes: np.ndarray, rest: np.ndarray, half: np.ndarray):
        begin, rows, n = np.asarray(start, np.int64), np.arange(len(comp)), 0
        end = np.append(begin[1:], len(comp))
        columns: list[list[np.ndarray]] = [[] for _ in range(9)]
        self.roots = len(begin)
        while len(begin):
            size, flat = end - begin, rows[np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin) + np.arange((end - begin).sum())]
            at = np.cumsum(size) - size
            own = points[flat]
            corner, low, high = np.maximum.reduceat(own, at), np.minimum.reduceat(sizes[flat], at), np.maximum.reduceat(sizes[flat], at)
            ranges = [f.reduceat(x[flat], at) for x in (comp, half) for f in (np.minimum, np.maximum)]
            more = size > 1
            first_child = np.where(more, n + len(begin) + 2 * (np.cumsum(more) - 1), -1)
            for column, x in zip(columns, (corner, low, high, np.maximum.reduceat(rest[flat], at), *ranges, np.where(more, first_child, -1 - flat[at])), strict=True):
                column.append(x)
            n += len(begin)
            widest = np.argmax(corner - np.minimum.reduceat(own, at), 1)
            by = own[np.arange(len(flat)), np.repeat(widest, size)].astype(np.int64)
            by = np.where(np.repeat(high * THRESHOLD > low * 100, size), sizes[flat], by)
            by = np.where(np.repeat(ranges[2] != ranges[3], size), half[flat], by)
            rows = flat[np.lexsort((by, np.repeat(np.arange(len(begin)), size)))]
            middle = at + size // 2
            mixed = np.flatnonzero((ranges[2] != ranges[3]) & more)  # these are cut where the halves meet
            if len(mixed):
                middle[mixed] = at[mixed] + np.add.reduceat((half[flat] == np.repeat(ranges[2], size)).astype(np.int64), at)[mixed]
            begin, end = np.stack([at, middle], 1)[more].ravel(), np.stack([middle, at + size], 1)[more].ravel()
        self.corner, self.low, self.high, self.rest, self.comp_low, self.comp_high, self.half_low, self.half_high, self.child = (np.concatenate(c) for c in columns)
        self.full = (self.corner == FULL).any(1)

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes may have a link below them: by component, half, size, what is left, and the sum of coordinate minima."""
        keep = np.flatnonzero(
            ((self.comp_low[a] != self.comp_high[b]) | (self.comp_high[a] != self.comp_low[b]))
            & ((self.half_low[a] < 0) | (self.half_low[a] != self.half_high[b]) | (self.half_high[a] != self.half_low[b]))
            & (100 * self.high[a] >= THRESHOLD * self.low[b]) & (100 * self.high[b] >= THRESHOLD * self.low[a])
            & ((100 + THRESHOLD) * np.minimum(self.rest[a], self.rest[b]) >= THRESHOLD * (self.low[a] + self.low[b]))
        )
        x, y = a[keep], b[keep]
        bound = np.minimum(self.corner[x], self.corner[y]).sum(1, dtype=np.int64)
        return keep[enough(bound, self.low[x], self.low[y]) | self.full[x] | self.full[y]]

    def self_join(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one tree and different components that no box rules out, each once; where half is 0 or 1, only of different halves."""
        stack = [(np.arange(self.roots), np.arange(self.roots))]
        while stack:
            a, b = stack.pop()
            if len(a) > NODE_PAIRS:
                stack += [(a[NODE_PAIRS:], b[NODE_PAIRS:])]
                a, b = a[:NODE_PAIRS], b[:NODE_PAIRS]
            keep = self.possible(a, b)
            a, b = a[keep], b[keep]
            x, y = self.child[a], self.child[b]
            done = (x < 0) & (y < 0) & (a != b)
            if done.any():
                yield -1 - x[done], -1 - y[done]
            one, two = (a == b) & (x >= 0), a != b
            left, right, both = two & (x >= 0) & (y < 0), two & (x < 0) & (y >= 0), two & (x >= 0) & (y >= 0)
            pairs = [(x[one], x[one]), (x[one] + 1, x[one] + 1), (x[one], x[one] + 1)]
            pairs += [(x[left] + k, b[left]) for k in (0, 1)] + [(a[right], y[right] + k) for k in (0, 1)] + [(x[both] + k, y[both] + m) for k in (0, 1) for m in (0, 1)]
            a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
            if len(a):
                stack.append((a, b))


def survivors(i: np.ndarray, j: np.ndarray, points: np.ndarray, sizes: np.ndarray, full: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of rows the bound cannot rule out."""
    fits = (100 * np.minimum(sizes[i], sizes[j]) >= THRESHOLD * np.maximum(sizes[i], sizes[j])).nonzero()[0]
    i, j = i[fits], j[fits]
    bound = np.minimum(points[i], points[j]).sum(1, dtype=np.int64)
    full = (points == FULL).any(1) if full is None else full
    return fits[enough(bound, sizes[i], sizes[j]) | full[i] | full[j]]


def group_pairs(start: np.ndarray, comp: np.ndarray, points: np.ndarray, sizes: np.ndarray, rank: np.ndarray, half: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of rows of one group (start: where groups begin) and different components; half: where it is not -1, only pairs of different halves.

    rank: the place of the group's shingle in a row's order. Of the first shingle that two sets share, no more than what follows is shared;
    a pair that fails this meets again at an earlier shingle if it links.
    """
    found = list(Forest(start, comp, points, sizes, sizes - rank, np.full(len(comp), -1) if half is None else half).self_join())
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *side]) for side in zip(*found, strict=True)) if found else (none, none)


def _prefixes(docs: DataFrame, hot: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The keys of all documents' prefixes; with `before`, only of those that putting `hot` last brings in."""
    sent = docs.sparkSession.sparkContext.broadcast((hot, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot, before), seen = sent.value, set()
        for part in slices(batches, 1):
            out = []
            for s in shingle_sets(part.column(1).to_pylist()):
                if not len(s) or (c := class_id(s)) in seen:
                    continue
                seen.add(c)
                keys = prefix(s, hot)
                out.append(keys if before is None else np.setdiff1d(keys, prefix(s, before), assume_unique=True))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["key"])

    return docs.mapInArrow(run, "key long")


def hot_keys(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys that are put last, and those that are salted: the same, and what is hot once they are last."""
    hot, before = np.zeros(0, np.uint64), None
    for k in range(ROUNDS + 1):
        many = _prefixes(docs, hot, before).groupBy("key").count().where(F.col("count") >= HOT).orderBy(F.desc("count"), "key").limit(HOT_KEYS)
        new = np.setdiff1d(np.array([r[0] for r in many.collect()], np.int64).view(np.uint64), hot)
        if not len(new) or k == ROUNDS or len(hot) + len(new) > HOT_KEYS:
            break
        hot, before = np.union1d(hot, new), hot
    return hot, np.union1d(hot, new)


def described(docs: DataFrame, hot: np.ndarray, salted: np.ndarray) -> DataFrame:
    """doc_id, cls, n; for the first row of a class in a task also point, fine, keys and whether they are salted."""
    sent = docs.sparkSession.sparkContext.broadcast((hot, salted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot, salted), seen = sent.value, set()
        for part in slices(batches, 1):
            rows = []
            for s in shingle_sets(part.column(1).to_pylist()):
                cls = class_id(s) if len(s) else None
                if cls is None or cls in seen:
                    rows.append((cls, len(s), None, None, None, None))
                    continue
                seen.add(cls)
                keys = prefix(s, hot)
                rows.append((cls, len(s), point(s).tobytes(), fine_point(s).tobytes(), keys.view(np.int64), among(keys, salted)))
            cls, n, points, fine, keys, salt = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(points, pa.binary()), pa.array(fine, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(salt, pa.list_(pa.bool_()))], ["doc_id", "cls", "n", "point", "fine", "keys", "salted"])

    return docs.mapInArrow(run, "doc_id long, cls long, n long, point binary, fine binary, keys array<long>, salted array<boolean>")


def _points(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIMENSIONS)


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that size and count vectors cannot rule out."""
    both = pairs.join(classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa")), "a").join(classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, k = b.num_rows, np.arange(b.num_rows)
                sizes = np.concatenate((b.column(2).to_numpy(), b.column(3).to_numpy()))
                keep = survivors(k, k + n, np.concatenate((_points(b.column(4)), _points(b.column(5)))), sizes)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], ["a", "b"])

    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def finely_bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the points of many dimensions cannot rule out; of two lengths, the longer is folded."""
    both = pairs.join(classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("fine").alias("pa")), "a").join(classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("pb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k, (na, nb, x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                full = x.max() == FULL or y.max() == FULL
                x, y = (v.reshape(-1, min(len(x), len(y))).sum(0, dtype=np.int64) for v in (x, y))
                keep += [k] if full or enough(np.minimum(x, y).sum(), na, nb) else []
            if keep:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], ["a", "b"])

    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of classes (a, b) whose shingle sets reach the threshold."""
    pairs = written(finely_bounded(pairs, classes), "candidates")
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    rows = written(classes.join(wanted, "cls", "left_semi").select("cls", F.col("rep").alias("doc_id")), "wanted")
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sets = shingle_sets(part.column(1).to_pylist())
            right = np.array([len(s) > 0 and class_id(s) == c for s, c in zip(sets, part.column(0).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(right)), pa.array([s.tobytes() for s, r in zip(sets, right, strict=True) if r], pa.binary())], ["cls", "shingles"])

    texts = docs.join(rows, docs["doc_id"].eqNullSafe(rows["doc_id"])).select("cls", "text")  # an id may have several texts
    sets = written(texts.mapInArrow(shingles, "cls long, shingles binary").dropDuplicates(["cls"]), "shingles")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for k, (x, y) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep += [k] if enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) else []
            if keep:
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), part.column(1).take(pa.array(keep))], ["a", "b"])

    return written(both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), "links")


def tree_candidates(groups: DataFrame, classes: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that R-trees over the groups' points cannot rule out; groups: key, cls, at (the key's rank)."""
    full = groups.join(component.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = full.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows"), F.min(F.xxhash64("cls")).alias("sign")).where("low < high").select("key", "rows", "sign")
    rows = full.join(mixed, "key").join(classes.select("cls", "n", "point"), "cls")
    block = F.pmod(F.xxhash64("cls"), F.ceil(F.col("rows") / GROUP_ROWS)).cast("int")
    parts = F.when(F.col("rows") <= GROUP_ROWS, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("half")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.ceil(F.col("rows") / GROUP_ROWS).cast("int") - 1), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j"), F.when(k == block, -1).when(block < k, 0).otherwise(1).alias("half")))
    )  # a block meets itself (half -1: all pairs) and each other block (pairs of different halves)
    # groups of much the same classes meet in a few tasks, which list their pairs once
    deal = F.when(F.col("rows") <= TOGETHER, F.xxhash64("sign", F.pmod(F.xxhash64("key"), F.lit(DEALS)))).otherwise(F.col("key"))
    dealt = rows.select("key", "cls", "component", "n", "at", "point", deal.alias("deal"), F.explode(parts).alias("p")).select("key", "p.i", "p.j", "p.half", "cls", "component", "n", "at", "point", "deal")
    dealt = dealt.repartition("deal", "i", "j").sortWithinPartitions("deal", "key", "i", "j", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        told = np.zeros((0, 3), np.int64)  # pairs of the last deal

        def searched(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            ids, cls = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(3)], 1), t.column(4).to_numpy()
            fresh = np.concatenate(([True], (ids[1:] != ids[:-1]).any(1) | (cls[1:] != cls[:-1])))  # copies of a class come once
            ids, t = ids[fresh], t.filter(pa.array(fresh)).combine_chunks()
            start = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(1))))
            cls = t.column(4).to_numpy()
            i, j = group_pairs(start, t.column(5).to_numpy(), _points(t.column(8)), t.column(6).to_numpy(), t.column(7).to_numpy(), t.column(3).to_numpy())
            nonlocal told
            deal = t.column(9).to_numpy()
            pairs = np.unique(np.stack([deal[i], np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], 1), axis=0)
            known = told[told[:, 0] == deal[0]]
            both, count = np.unique(np.concatenate((known, known, pairs)), axis=0, return_counts=True)
            new = both[count == 1]
            told = np.concatenate((known, new))
            told = told[told[:, 0] == deal[-1]][-MOST_TOLD:]
            return pa.RecordBatch.from_arrays([pa.array(new[:, 1]), pa.array(new[:, 2])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held = pa.concat_tables([held, pa.Table.from_batches([b])]) if held is not None else pa.Table.from_batches([b])
            ids = np.stack([held.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            last = int(np.flatnonzero((ids != ids[-1]).any(1))[-1]) + 1 if (ids != ids[-1]).any() else 0
            if last:
                yield searched(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield searched(held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (equal sets) and component_id (least id reachable by links) of every document."""
    docs = id_text(docs, id_col, text_col)
    rows = written(described(docs, *hot_keys(docs)), "described")
    classes = written(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("point").alias("point"), F.min("fine").alias("fine")), "classes")
    place = F.posexplode(F.arrays_zip("keys", "salted")).alias("at", "k")
    salt = F.when(F.col("k.salted"), F.pmod(F.xxhash64("cls"), F.lit(SALTS))).otherwise(-1)
    postings = rows.select("cls", place).select(F.col("k.keys").alias("key"), "cls", "at", salt.alias("salt"))
    own = W.partitionBy("key", "salt")
    head = F.min_by("cls", F.xxhash64("key", "cls"))
    met = postings.withColumns({"least": F.min("cls").over(own), "most": F.max("cls").over(own), "head": head.over(own)}).where("least < most OR salt >= 0").select("key", "cls", "at", "salt", "head")
    met = written(met, "groups")
    heads = met.where("salt >= 0").select("key", "head").distinct()  # links the salts of a hot key
    across = heads.join(heads.groupBy("key").agg(F.min_by("head", F.xxhash64("key", "head")).alias("least")), "key").select(F.col("head").alias("a"), F.col("least").alias("b"))
    stars = met.select(F.col("cls").alias("a"), F.col("head").alias("b")).unionByName(across).where("a <> b").distinct()
    first = verified(bounded(stars, classes), docs, classes)
    component = components(first.toDF("u", "v"))
    second = verified(tree_candidates(met.select("key", "cls", "at"), classes, component), docs, classes)
    component = components(first.unionByName(second).toDF("u", "v"))
    least = classes.join(component.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    ids = least.select("component", "rep").groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = written(least.select("cls", "component").join(ids, "component").select("cls", "component_id"), "by-class")
    return rows.select("doc_id", "n", "cls").join(by_class.hint("merge"), "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the least id of each component only, all columns as they came.

    Documents without shingles stay, and so do those without id (nothing tells them apart). An id that several rows have
    stays or goes as a whole; of its rows with equal texts one stays.
    """
    linked = written(link(docs, id_col, text_col), "linked")
    left, twice = free_name(docs, "gone"), free_name(docs, "twice")
    gone = written(linked.where("n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias(left)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    own = F.col(f"`{id_col}`").cast("long")
    kept = docs.join(gone, own == F.col(left), "left_anti")
    repeated = written(linked.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(twice)), "repeated-ids")
    if repeated.isEmpty():
        return kept
    same = own == F.col(twice)
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))
