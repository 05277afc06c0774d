"""Near-duplicate passages of documents by compact windows.

Tokens are the 5-word shingles of a text. For each of HASHES hash functions the Cartesian tree over the tokens' hashes
groups all passages of MIN_WORDS words or more: the passages that contain a node's token and lie within its subtree share
their minimum, so one compact window (first, centre, last) stands for them all. A token's later occurrences in its text
are no centres, but further places of a verified passage in either text are looked up and listed. Minima of one text only are left out by a Bloom filter of bounded size before windows are shuffled.
Windows of different texts that share hash function and minimum are joined, each with the least text that has it, with the
least that shares the SIDE tokens after the centre too, and with the least that shares those before it: of a passage of 50 words, one
side of the centre has SIDE tokens. So a group of copies costs its size, not its square. The least text may hold the minimum in
a common line only, so in groups of three texts or more what stands around the centres is compared as well. Texts that have the same SIDE
tokens on both sides are one there, and the least of them stands for all. Of the others, at every STEP-th of the LEAST tokens
before and after the centre, those that have one token there meet: each is held against the least and the greatest that has it, and pairs
with a passage in common around the centre are kept; those without a partner try again among themselves, until no pair is found.
Pairs of texts whose windows
overlap for ENOUGH hash functions on nearly one diagonal, or that share a side, are verified: tokens that both texts
have near the diagonal make a passage if their share of the union is THRESHOLD % or more over MIN_WORDS words.

Equal word sequences are one text: copies of MIN_WORDS words or more are reported as a passage of the whole text.
Words are [^\\x20\\x09-\\x0D]+ with A-Z as a-z. Null or empty texts and texts below MIN_WORDS words have no passages. Rows
repeated with their id count as one document; rows without id are reported only as a copy of others' text, never as a
partner. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import freed, id_text, mix, ngram_hashes, scratch, slices, word_hashes, written

SHINGLE, MIN_WORDS, THRESHOLD = 5, 50, 80
HASHES, ENOUGH, SIDE, STEP = 4, 2, 22, 3
#: Tokens by which the diagonals of one passage may differ (words put in or left out).
DRIFT = 12
#: Windows that share a minimum and are handled in one task at most; larger groups are joined.
GROUP_ROWS = 5_000
#: Windows whose contexts a worker holds at once.
CONTEXT_ROWS = 10_000
#: Words that a word may be moved by within the LEAST tokens around a centre (words put in or left out).
MOVED = 2
#: Tokens by which partners may differ to a side and count as equal there.
NARROW = 6
#: Matches that are listed at once; tokens that give more are counted by convolution. Matches for each token of two texts that are listed for all diagonals.
MATCHES, LISTED = 1 << 22, 4
#: Pairs with one leader that are verified in a task before the next salt begins; ids that go to all tasks at most.
PER_LEADER, BROADCAST_ROWS = 500, 1_000_000
#: Parts in which pairs are verified one after the other, so that disk holds the shuffled tokens of one.
PARTS = 4
LEAST = MIN_WORDS - SHINGLE + 1  # a passage's tokens
#: Equal tokens that a passage of LEAST tokens has at least.
EQUAL = int(np.ceil(LEAST * 2 * THRESHOLD / (100 + THRESHOLD)))
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def slid(values: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """of (minimum or maximum) over values[i : i + n] for each i that has so many: spans of powers of two, laid over each other."""
    out, span = values, 1
    while 2 * span <= n:
        out = of(out[:-span], out[span:])
        span *= 2
    return of(out[: len(values) - n + 1], out[n - span : len(values) - span + 1]) if n > span else out


def compact_windows(values: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, centre and last of all nodes of the Cartesian trees over values[begin:end] (ends disjoint, rising) whose subtree has `least` tokens.

    Values are distinct but for NEVER, which is no centre. A token is a centre if it is the minimum of some passage of `least` tokens, so if its value
    is the largest of the sliding minima around it. The next smaller token on either side, where its subtree ends, is a centre too.
    """
    none = np.zeros(0, np.int64)
    long = end - begin >= least
    begin, end = begin[long], end[long]
    if not len(begin):
        return none, none, none
    values = values + (values != NEVER)  # 0 stands for no passage
    whole = np.zeros(len(values) + 1, np.int8)  # whether `least` tokens of one text begin here
    whole[begin] += 1
    whole[end - least + 1] -= 1
    low = np.where(np.cumsum(whole[: len(values) - least + 1]).astype(bool), slid(values, least, np.minimum), np.uint64(0))
    edge = np.zeros(least - 1, values.dtype)
    most = slid(np.concatenate((edge, low, edge)), least, np.maximum)
    centre = np.flatnonzero((most == values) & (values != NEVER) & (most != 0))
    text, own = np.searchsorted(begin, centre, "right") - 1, values[centre]
    smaller = []
    for step in (-1, 1):  # the nearest centre of the text with a smaller value: over larger ones by their own nearest, however far those have come
        to = np.arange(len(centre)) + step
        to[(to < 0) | (to >= len(centre))] = -1
        to[(to >= 0) & (text[to] != text)] = -1
        active = np.flatnonzero((to >= 0) & (own[to] > own))
        while len(active):
            to[active] = to[to[active]]
            active = active[(to[active] >= 0) & (own[to[active]] > own[active])]
        smaller.append(to)
    left, right = smaller
    return np.where(left >= 0, centre[left] + 1, begin[text]), centre, np.where(right >= 0, centre[right] - 1, end[text] - 1)


def first_places(tokens: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a token is its document's first of its kind; doc rises."""
    key = mix(tokens ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    in_order = np.sort(key)
    often = np.zeros(1 << 22, bool)
    often[in_order[1:][in_order[1:] == in_order[:-1]] >> np.uint64(42)] = True
    some = np.flatnonzero(often[key >> np.uint64(42)])  # all that stand in a document again, and a few more
    order = some[np.argsort(tokens[some], kind="stable")]
    again = (tokens[order][1:] == tokens[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = np.ones(len(tokens), bool)
    out[order[1:][again]] = False
    return out


def side_hashes(words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """32-bit hashes of the words of a token and SIDE more from each start; what reaches over the array's ends is for the caller to mask."""
    total = np.zeros(len(start), np.uint64)
    for k in range(SHINGLE + SIDE):
        total = total * np.uint64(0x9FB21C651E98DF25) + words[np.clip(start + k, 0, len(words) - 1)]
    return (mix(total) >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Sketch:
    """A set of 64-bit hashes as a Bloom filter of at most CHUNKS parts: what it lacks is not in the set."""

    PART, CHUNKS = 1 << 18, 1024  # bits of a part; parts

    def __init__(self, parts: dict[int, bytes], chunks: int):
        self.chunks = chunks
        self.bits = np.zeros((chunks, self.PART // 8), np.uint8)
        for k, part in parts.items():
            self.bits[k] = np.frombuffer(part, np.uint8)

    @classmethod
    def of(cls, keys: DataFrame) -> Sketch:
        """keys: v long. Parts are made by tasks; the driver gets 32 KB for each."""
        chunks, n = 1, keys.count()
        while chunks < cls.CHUNKS and chunks * cls.PART < 16 * n:
            chunks *= 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for batch in batches:
                v = batch.column(0).to_numpy().view(np.uint64)
                part, places = cls.places(v, chunks)
                for k in np.unique(part).tolist():
                    bits = parts.setdefault(k, np.zeros(cls.PART // 8, np.uint8))
                    for place in places:
                        mine = place[part == k]
                        np.bitwise_or.at(bits, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([b.tobytes() for b in parts.values()], pa.binary())], ["chunk", "bits"])

        made = keys.repartition(min(chunks, 64), F.col("v").bitwiseAND(F.lit(chunks - 1))).select("v").mapInArrow(run, "chunk int, bits binary")
        return cls({r.chunk: bytes(r.bits) for r in made.collect()}, chunks)

    @classmethod
    def places(cls, v: np.ndarray, chunks: int) -> tuple[np.ndarray, list[np.ndarray]]:
        return (v & np.uint64(chunks - 1)).astype(np.int64), [((v >> np.uint64(s)) & np.uint64(cls.PART - 1)).astype(np.int64) for s in (10, 28, 46)]

    def may_have(self, v: np.ndarray) -> np.ndarray:
        part, places = self.places(v, self.chunks)
        out = np.ones(len(v), bool)
        for place in places:
            out &= (self.bits[part, place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return out


def together(v: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """One key of a minimum and a text."""
    return v ^ cls


def text_classes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each text's word sequence; texts begin at at[:-1]."""
    n = np.diff(at)
    place = np.arange(len(words)) + np.repeat(n - at[:-1], n)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words ^ mix(place.astype(np.uint64))), out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]]).view(np.int64)


def words_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(part.column(1).cast(pa.binary()).to_pylist())


def contexts(tokens: np.ndarray, c: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """16 bits of the LEAST - 1 tokens before each centre, of the centre, and of the LEAST - 1 after it; 0 outside of the text's tokens (start to stop)."""
    at = c[:, None] + np.arange(1 - LEAST, LEAST)
    here = (at >= start[:, None]) & (at < stop[:, None])
    return np.where(here, np.maximum(tokens[np.where(here, at, 0)] >> np.uint64(48), np.uint64(1)), np.uint64(0)).astype(np.uint16)


def windows(docs: DataFrame, known: Sketch | None = None, context: bool = False) -> DataFrame:
    """cls, f, v (minimum), a, c, b, and hashes of the SIDE tokens after the centre and before it (null if fewer), or the tokens on both sides.

    known: only windows whose minimum it may have (with context: whose minimum and text). Without it, only cls and v.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known = sent.value
        for part in slices(batches, 1):
            words, at = words_of(part)
            cls = text_classes(words, at)
            fresh = np.zeros(len(at) - 1, bool)
            for d in np.flatnonzero(np.diff(at) >= MIN_WORDS).tolist():
                fresh[d] = int(cls[d]) not in seen
                seen.add(int(cls[d]))
            begin, end = at[:-1][fresh], at[1:][fresh] - SHINGLE + 1
            if not len(begin):
                continue
            tokens = ngram_hashes(words, SHINGLE)
            first = first_places(tokens, np.searchsorted(at, np.arange(len(tokens)), "right"))
            for f in range(HASHES):
                values = np.where(first, mix(tokens ^ mix(np.array([f + 1], np.uint64))), NEVER)
                a, c, b = compact_windows(values, begin, end)
                if known is not None:
                    may = known.may_have(together(values[c], cls.view(np.uint64)[np.searchsorted(at, c, "right") - 1]) if context else values[c])
                    a, c, b = a[may], c[may], b[may]
                if not len(c):
                    continue
                doc = np.searchsorted(at, c, "right") - 1
                ids = [pa.array(cls[doc]), pa.array(values[c].view(np.int64))]
                if known is None:
                    yield pa.RecordBatch.from_arrays(ids, ["cls", "v"])
                    continue
                start, words_left = at[doc], at[doc + 1] - c
                if context:
                    for k in range(0, len(c), CONTEXT_ROWS):
                        here = slice(k, k + CONTEXT_ROWS)
                        around = [r.tobytes() for r in contexts(tokens, c[here], start[here], at[doc + 1][here] - SHINGLE + 1)]
                        yield pa.RecordBatch.from_arrays([*(x[here] for x in ids), *(pa.array((x - start)[here].astype(np.int32)) for x in (a, c, b)), pa.array(around, pa.binary())], ["cls", "v", "a", "c", "b", "around"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(np.full(len(c), f, np.int32)), *(pa.array((x - start).astype(np.int32)) for x in (a, c, b)), pa.array(side_hashes(words, c), mask=words_left < SHINGLE + SIDE), pa.array(side_hashes(words, c - SIDE), mask=c - start < SIDE)],
                    ["cls", "v", "f", "a", "c", "b", "after", "before"],
                )

    return docs.mapInArrow(run, "cls long, v long" + ("" if known is None else ", a int, c int, b int, around binary" if context else ", f int, a int, c int, b int, after int, before int"))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, cls, n (words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            words, at = words_of(part)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text_classes(words, at)), pa.array(np.diff(at))], ["doc_id", "cls", "n"])

    return docs.mapInArrow(run, "doc_id long, cls long, n long")


def stars(met: DataFrame, key: list[str], sure: bool) -> DataFrame:
    """x, y (the least text with the key), f, cx, cy and the windows of both, for every window that shares the key with an other text's."""
    rows = met.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    lead = rows.groupBy(*key).agg(F.min("cls").alias("lead"), F.max("cls").alias("most")).where("lead < most").select(*key, "lead")
    joined = rows.join(lead, key)
    at = joined.where("cls = lead").select(*key, F.col("a").alias("ay"), F.col("c").alias("cy"), F.col("b").alias("by"))
    return joined.where("cls <> lead").join(at, key).select(F.col("cls").alias("x"), F.col("lead").alias("y"), F.lit(-1).alias("f") if sure else F.col("f"), F.col("c").alias("cx"), "cy", F.col("a").alias("ax"), F.col("b").alias("bx"), "ay", "by")


def stars_together(met: DataFrame) -> DataFrame:
    """What stars gives for v, for v and after, for v and before, and for all three, of groups that a task can hold: one exchange by v serves all."""
    window = F.struct("cls", "c", "a", "b")
    led = met.repartition("v").withColumns({name: F.min(window).over(W.partitionBy("v", *key)) for name, key in (("any", []), ("right", ["after"]), ("left", ["before"]), ("both", ["after", "before"]))})
    leads = F.array(
        F.struct(F.col("f").alias("f"), F.col("any").alias("y")),
        F.struct(F.lit(-1).alias("f"), F.when(F.col("after").isNotNull(), F.col("right")).alias("y")),
        F.struct(F.lit(-1).alias("f"), F.when(F.col("before").isNotNull(), F.col("left")).alias("y")),
        F.struct(F.lit(-1).alias("f"), F.when(F.expr("after IS NOT NULL AND before IS NOT NULL"), F.col("both")).alias("y")),
    )
    rows = led.select("cls", "c", "a", "b", F.explode(F.array_distinct(leads)).alias("l")).where("l.y.cls <> cls")
    return rows.select(F.col("cls").alias("x"), F.col("l.y.cls").alias("y"), "l.f", F.col("c").alias("cx"), F.col("l.y.c").alias("cy"), F.col("a").alias("ax"), F.col("b").alias("bx"), F.col("l.y.a").alias("ay"), F.col("l.y.b").alias("by"))


def candidates(seeds: np.ndarray, enough: int = ENOUGH) -> list[tuple[int, int]]:
    """Seeds (cx, cy) to verify: sure ones, and those whose window overlaps those of enough hash functions near one diagonal.

    seeds: rows f, cx, cy, ax, bx, ay, by.
    """
    out, diagonal = [], seeds[:, 1] - seeds[:, 2]
    for d in np.unique(diagonal).tolist():
        near = seeds[np.abs(diagonal - d) <= DRIFT]
        own = near[near[:, 1] - near[:, 2] == d]
        if (own[:, 0] < 0).any():
            out += [(int(r[1]), int(r[2])) for r in own[own[:, 0] < 0]]
            continue
        for f, cx, cy, ax, bx, ay, by in own.tolist():
            first, last = np.maximum(near[:, 3], ax), np.minimum(near[:, 4], bx)
            other, end = np.maximum(near[:, 5], ay), np.minimum(near[:, 6], by)
            if len(set(near[(last - first >= LEAST - 1 - DRIFT) & (end - other >= LEAST - 1 - DRIFT), 0].tolist()) | {f}) >= enough:
                out.append((cx, cy))
    return sorted(set(out))


class Places:
    """Where a text's tokens stand: sorted once for all texts that it is compared with."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.order = np.argsort(tokens, kind="stable")
        self.sorted = tokens[self.order]

    def matches(self, x: np.ndarray) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
        """A function of a diagonal d that gives all i, j with equal tokens and j within DRIFT of i - d, rising in i.

        Tokens that both texts have are listed once if they are about as many as the texts are long; of texts that repeat their tokens
        only the band around each diagonal is ever listed, so memory follows the texts' length however often a token stands in them.
        """
        low, high = np.searchsorted(self.sorted, x, "left"), np.searchsorted(self.sorted, x, "right")
        many = high - low
        if many.sum() <= LISTED * (len(x) + len(self.tokens)):
            i = np.repeat(np.arange(len(x)), many)
            j = self.order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]

            def near(d: int) -> tuple[np.ndarray, np.ndarray]:
                here = np.abs((i - j) - d) <= DRIFT
                return i[here], j[here]

            return near
        n = len(self.tokens)
        begin = np.flatnonzero(np.concatenate(([True], self.sorted[1:] != self.sorted[:-1])))
        keys = np.repeat(begin, np.diff(np.append(begin, n))) * n + self.order
        some = np.flatnonzero(many)
        base = low[some] * n  # a token's number is where it begins among the sorted ones

        def band(d: int) -> tuple[np.ndarray, np.ndarray]:
            middle = some - d
            fits = (middle >= -DRIFT) & (middle < n + DRIFT)
            own, at, centre = base[fits], some[fits], middle[fits]
            first = np.searchsorted(keys, own + np.maximum(centre - DRIFT, 0), "left")
            count = np.searchsorted(keys, own + np.minimum(centre + DRIFT, n - 1), "right") - first
            return np.repeat(at, count), keys[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())] - np.repeat(own, count)

        return band


def passages(x: np.ndarray, y: np.ndarray | Places, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int, int, float]]:
    """(start in x, tokens, start in y, tokens, similarity) of the passages around seeds, from token hashes x and y."""
    found: list[tuple[int, int, int, int, float]] = []
    near = None
    done: list[int] = []
    for cx, cy in seeds:
        if any(abs(cx - cy - d) <= DRIFT // 4 for d in done) or any(k <= cx < k + n and abs((cx - cy) - (k - t)) <= DRIFT for k, n, t, _, _ in found):
            continue
        done.append(cx - cy)
        if near is None:
            near = (y if isinstance(y, Places) else Places(y)).matches(x)
        px, py = near(cx - cy)
        order_near = np.lexsort((np.abs((px - py) - (cx - cy)), px))  # a token matches once, with the nearest to the diagonal
        px, py = px[order_near], py[order_near]
        once = np.flatnonzero(np.concatenate(([True], np.diff(px) > 0))) if len(px) else order_near
        px, py = px[once], py[once]
        rises = np.flatnonzero(py > np.concatenate(([-1], np.maximum.accumulate(py)[:-1]))) if len(py) else once
        found += [m for m in stretches(px[rises], py[rises]) if m not in found]
    return found


def diagonals(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many equal tokens (not below 0) x and y have at each difference of places, from -len(y) on."""
    out = np.zeros(len(x) + len(y), np.int64)
    order = np.argsort(y, kind="stable")
    in_order = y[order]
    low, high = np.searchsorted(in_order, x, "left"), np.searchsorted(in_order, x, "right")
    many = np.where(x >= 0, high - low, 0)
    often = np.flatnonzero(many > MATCHES // max(1, len(x)))
    for token in np.unique(x[often]).tolist() if many.sum() > MATCHES else []:
        size = 1 << (len(x) + len(y)).bit_length()
        both = np.fft.irfft(np.fft.rfft(x == token, size) * np.fft.rfft((y == token)[::-1], size), size)
        out[1:] += np.rint(both[: len(out) - 1]).astype(np.int64)
        many[x == token] = 0
    d = np.repeat(np.arange(len(x)), many) - order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())] + len(y)
    return out + np.bincount(d, minlength=len(out))


def further(x: np.ndarray, span: np.ndarray, taken: list[tuple[int, int]]) -> list[tuple[int, int, int, int, float]]:
    """Passages of x like those of span, as passages gives them, outside the places (start, tokens) of x that are taken."""
    free = np.isin(x, span)
    for start, n in taken:
        free[start : start + n] = False
    at = np.flatnonzero(free)
    if len(at) < EQUAL:
        return []
    text, span, out = np.where(free, x.astype(np.int64), -1), span.astype(np.int64), []
    begin = int(at[0])
    while True:
        end = begin + 2 * len(span) + DRIFT
        local = text[begin:end]
        dead = np.zeros(len(local) + len(span), bool)
        while (local >= 0).sum() >= EQUAL:
            counts = diagonals(local, span)
            counts[dead] = 0
            near = np.convolve(counts, np.ones(2 * DRIFT + 1, np.int64))[DRIFT : DRIFT + len(counts)]
            if near.max() < EQUAL:
                break
            best = int(near.argmax())
            first = max(best - DRIFT, 0)
            middle = first + int(counts[first : best + DRIFT + 1].argmax())
            got = passages(local, span, [(middle - len(span), 0)])
            if not got:
                dead[first : best + DRIFT + 1] = True
            for start, n, t, m, share in got:
                out.append((begin + start, n, t, m, share))
                local[start : start + n] = -1
        # what begins in the next half of a span, or reaches over it, is in this window
        later = np.searchsorted(at, begin + max(1, len(span) // 2))
        if later == len(at):
            return out
        begin = int(at[later])


def everywhere(x: np.ndarray, y: Places, found: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float, int]]:
    """found, and the further places of its passages in both texts; last whether it is a passage of both (0), or listed for x (1) or y (2) only."""
    out = [(*p, 0) for p in found]
    in_x, in_y = [p[:2] for p in found], [p[2:4] for p in found]
    for s, n, t, m, _ in found:
        for a, k, b, q, share in further(x, y.tokens[t : t + m], in_x):
            out.append((a, k, t + b, q, share, 1))
            in_x.append((a, k))
        for b, q, a, k, share in further(y.tokens, x[s : s + n], in_y):
            out.append((s + a, k, b, q, share, 2))
            in_y.append((b, q))
    return out


def stretches(px: np.ndarray, py: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """The longest stretch of matches that is a passage, then the longest on either side of it, and so on.

    n matches on spans of x and y tokens have a similarity of n / (x + y - n). It reaches the threshold t if and only if
    (1 + t) n - t x - t y >= 0, a sum over the matches: the first p for each q comes from running minima of that sum.
    """
    out, stack, t = [], [(0, len(px))], THRESHOLD / 100
    while stack:
        a, b = stack.pop()
        if b - a < LEAST * t * 2 / (1 + t) - 1:
            continue
        total = (1 + t) * np.arange(b - a) - t * (px[a:b] + py[a:b])
        low = np.minimum.accumulate(total)
        p = np.searchsorted(-low, -(total + (1 - t) + 1e-9))  # the first place whose sum allows this end
        q = np.arange(b - a)
        p = np.minimum(p, q)
        length = np.where(total[q] - total[p] + (1 - t) + 1e-9 >= 0, px[a + q] - px[a + p], -1)
        k = int(length.argmax())
        first, last = a + int(p[k]), a + k
        x, y = int(px[last] - px[first]) + 1, int(py[last] - py[first]) + 1
        if length[k] < 0 or min(x, y) < LEAST:
            continue
        n = last - first + 1
        out.append((int(px[first]), x, int(py[first]), y, n / (x + y - n)))
        stack += [(a, first), (last + 1, b)]
    return out


def alike(around: np.ndarray, own: np.ndarray, partner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows of contexts the first and the last LEAST tokens of which EQUAL are in common, in nearly one order; -1 where there are none."""
    first, last = np.full(len(own), -1, np.int16), np.full(len(own), -1, np.int16)
    for k in range(0, len(own), CONTEXT_ROWS):
        a, b = around[own[k : k + CONTEXT_ROWS]], np.pad(around[partner[k : k + CONTEXT_ROWS]], ((0, 0), (MOVED, MOVED)))
        same = np.zeros(a.shape, bool)
        for d in range(2 * MOVED + 1):
            same |= a == b[:, d : d + a.shape[1]]
        total = np.cumsum(np.pad(same & (a != 0), ((0, 0), (1, 0))), axis=1, dtype=np.int16)
        enough = total[:, LEAST:] - total[:, :-LEAST] >= EQUAL
        some = enough.any(1)
        first[k : k + CONTEXT_ROWS] = np.where(some, enough.argmax(1), -1)
        last[k : k + CONTEXT_ROWS] = np.where(some, enough.shape[1] - 1 - enough[:, ::-1].argmax(1), -1)
    return first, last


def widest(own: np.ndarray, partner: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of each row's partners the one that goes on furthest to the left and the one to the right (about; of equal ones the first): what others share, these do."""
    keep = []
    for side in (first // NARROW, -(last // NARROW)):
        order = np.lexsort((partner, side, own))
        keep.append(order[np.concatenate(([True], own[order][1:] != own[order][:-1]))])
    return np.unique(np.concatenate(keep))


def columns_of(width: int) -> np.ndarray:
    """Every STEP-th place of a context, but not the centre, which all have in common."""
    at = np.arange((width // 2) % STEP, width, STEP)
    return at[at != width // 2]


def met_in_columns(group: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, partner) of one group (a number for each row) that are alike: of those with one token in a column, each with the first and the last.

    Rows without a partner are compared anew among themselves, until none is found.
    """
    rows, left, right = np.arange(len(group)), [], []
    while len(rows) > 1:
        pairs = []
        for k in columns_of(around.shape[1]):
            some = rows[around[rows, k] != 0]
            key = group[some].astype(np.int64) << 16 | around[some, k]
            _, first, of = np.unique(key, return_index=True, return_inverse=True)
            last = len(key) - 1 - np.unique(key[::-1], return_index=True)[1]
            pairs += [some * len(group) + some[first[of]], some * len(group) + some[last[of]]]
        own, partner = np.divmod(np.unique(np.concatenate(pairs)), len(group))
        own, partner = own[own != partner], partner[own != partner]
        first, last = alike(around, own, partner)
        found = np.flatnonzero(first >= 0)
        if not len(found):
            break
        found = found[widest(own[found], partner[found], first[found], last[found])]
        left.append(own[found]), right.append(partner[found])
        rows = np.setdiff1d(rows, np.concatenate((left[-1], right[-1])), assume_unique=True)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


PAIR = "x long, y long, f int, cx int, cy int, ax int, bx int, ay int, by int"


def leads_on(docs: DataFrame, met: DataFrame) -> DataFrame:
    """What stars gives, for pairs of one group of three texts or more that are alike around the centre.

    Groups that no task holds have their rounds in tables until they have come down to GROUP_ROWS; the pairs are the same either way.
    """
    side = [F.coalesce(F.col(k).cast("long"), "cls").alias(k) for k in ("after", "before")]  # a text without a side is like no other
    some = written(met.where("many > 2").select("v", "cls", *side).groupBy("v", "after", "before").agg(F.min("cls").alias("cls"), F.count("*").alias("texts")).select("v", "cls", "texts"), "passage-contexts")
    groups = written(some.groupBy("v").agg(F.count("*").alias("count"), F.sum("texts").alias("texts")).where("count > 1 AND texts > 2").select("v", "count"), "passage-groups")
    keys = written(some.join(groups, "v", "left_semi").select("v", "cls"), "passage-keys")
    rows = windows(docs, Sketch.of(keys.select(F.expr("v ^ cls").alias("v"))), context=True)
    hot = groups.where(F.col("count") > GROUP_ROWS).select("v")
    if hot.isEmpty():
        return met_in_tasks(rows, keys)
    rows = freed(written(rows, "passage-around"))
    large = rows.join(keys.join(hot, "v", "left_semi"), ["v", "cls"], "left_semi").dropDuplicates(["v", "cls"])
    return met_in_tasks(rows.join(hot, "v", "left_anti"), keys.join(hot, "v", "left_anti")).unionByName(met_in_tables(written(large, "passage-large")))


def met_in_tasks(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """met_in_columns for groups that a task holds. keys (v, cls): the only rows that count, since windows come through a Bloom filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(part: pa.Table) -> pa.RecordBatch:
            v, cls = (part[n].to_numpy() for n in ("v", "cls"))
            named = part["around"].is_null().to_numpy()  # a key comes before its rows, of which there may be several
            once = 1 + np.flatnonzero(named[:-1] & ~named[1:] & (cls[1:] == cls[:-1]) & (v[1:] == v[:-1]))
            part, v, cls = part.take(pa.array(once)), v[once], cls[once]
            a, c, b = (part[n].to_numpy() for n in ("a", "c", "b"))
            around = np.frombuffer(b"".join(part["around"].to_pylist()), np.uint16).reshape(len(v), 2 * LEAST - 1)
            x, y = met_in_columns(np.cumsum(np.concatenate(([0], v[1:] != v[:-1]))) if len(v) else once, around)
            x, y = np.where(cls[x] > cls[y], x, y), np.where(cls[x] > cls[y], y, x)
            return pa.RecordBatch.from_arrays([pa.array(k) for k in (cls[x], cls[y], np.full(len(x), -1, np.int32), c[x], c[y], a[x], b[x], a[y], b[y])], ["x", "y", "f", "cx", "cy", "ax", "bx", "ay", "by"])

        held: list[pa.RecordBatch] = []  # whole groups, and the last one so far
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(k.num_rows for k in held) >= 4 * CONTEXT_ROWS:
                part = pa.Table.from_batches(held)
                v = part["v"].to_numpy()
                last = int(np.searchsorted(v, v[-1], "left"))
                if last:
                    yield pairs(part.slice(0, last))
                    held = part.slice(last).combine_chunks().to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held))

    both = rows.select("v", "cls", "a", "c", "b", "around").unionByName(keys.select("v", "cls"), allowMissingColumns=True)
    # by a hash of v: where both come from joins by v, Spark leaves an exchange by v out, though their partitions needn't match any more
    return both.repartition(F.xxhash64("v")).sortWithinPartitions("v", "cls", F.col("around").asc_nulls_first()).mapInArrow(run, PAIR)


def met_in_tables(rows: DataFrame) -> DataFrame:
    """met_in_columns for groups that no task holds: a round is an aggregation and joins that AQE may split.

    Groups that a round leaves with GROUP_ROWS rows or fewer go on in tasks; those in which it found nothing are done.
    """
    ends = ("c", "a", "b")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                around = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                at = columns_of(around.shape[1])
                row, k = np.nonzero(around[:, at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array((k.astype(np.int32) << 16) | around[row, at[k]])], ["v", "cls", "cell"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["v", "own", "partner", "first", "last"]
        for batch in batches:
            if batch.num_rows:
                around = np.concatenate([np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for n in ("aroundx", "aroundy")])
                for own, partner, shift in (("x", "y", 0), ("y", "x", batch.num_rows)):
                    k = np.flatnonzero(batch.column(f"of{own}").to_numpy(zero_copy_only=False))
                    first, last = alike(around, k + shift, k + batch.num_rows - shift)
                    keep = pa.array(k[first >= 0])
                    yield pa.RecordBatch.from_arrays([*(batch.column(n).take(keep) for n in ("v", own, partner)), *(pa.array(n[first >= 0].astype(np.int32)) for n in (first, last))], names)

    found, rest = [], []
    while True:
        met = rows.select("v", "cls", "around").mapInArrow(cells, "v long, cls long, cell int")
        least = met.groupBy("v", "cell").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least < most")
        asked = met.join(least, ["v", "cell"]).select("v", "cls", F.explode(F.array("least", "most")).alias("other")).where("cls <> other")
        asked = asked.groupBy("v", F.greatest("cls", "other").alias("x"), F.least("cls", "other").alias("y")).agg(F.max(F.expr("cls > other")).alias("ofx"), F.max(F.expr("cls < other")).alias("ofy"))
        one, two = (rows.select("v", F.col("cls").alias(n), F.col("around").alias(f"around{n}")) for n in "xy")
        both = asked.join(one, ["v", "x"]).join(two, ["v", "y"]).select("v", "x", "y", "ofx", "ofy", "aroundx", "aroundy")
        some = both.mapInArrow(compared, "v long, own long, partner long, first int, last int")
        side = lambda n, sign: F.min(F.struct((sign * F.floor(F.col(n) / NARROW)).alias("side"), "partner"))
        wide = some.groupBy("v", "own").agg(side("first", 1).alias("l"), side("last", -1).alias("r"))  # as widest has them
        pairs = written(wide.select("v", "own", F.explode(F.array_distinct(F.array("l.partner", "r.partner"))).alias("partner")), "passage-round")
        if pairs.isEmpty():
            break
        of = [rows.select("v", F.col("cls").alias(n), *[F.col(k).alias(f"{k}{n}") for k in ends]) for n in "xy"]
        named = pairs.select("v", F.greatest("own", "partner").alias("x"), F.least("own", "partner").alias("y")).distinct()
        found.append(named.join(of[0], ["v", "x"]).join(of[1], ["v", "y"]).select("x", "y", F.lit(-1).alias("f"), "cx", "cy", "ax", "bx", "ay", "by"))
        done = pairs.select("v", F.explode(F.array("own", "partner")).alias("cls")).distinct()
        left = written(rows.join(pairs.select("v").distinct(), "v", "left_semi").join(done, ["v", "cls"], "left_anti"), "passage-left")
        large = left.groupBy("v").count().where(F.col("count") > GROUP_ROWS).select("v")
        rest.append(left.join(large, "v", "left_anti"))
        rows = written(left.join(large, "v", "left_semi"), "passage-large")
        if rows.isEmpty():
            break
    out = rows.sparkSession.createDataFrame([], PAIR)
    for k in found:
        out = out.unionByName(k)
    for k in rest:
        out = out.unionByName(met_in_tasks(k, k.select("v", "cls")))
    return out


def packed(tokens: np.ndarray) -> bytes:
    """The upper 24 bits of each token."""
    return np.ascontiguousarray((tokens >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def unpacked(raw: pa.Buffer | bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 3 if isinstance(raw, bytes) else raw.size // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel().astype(np.uint32)


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """x, y, x_start, x_words, y_start, y_words, similarity, only (see everywhere) of the passages of pairs (x, y, seeds).

    24 bits of each token's hash are sent: tokens are only compared near a diagonal, where that tells them apart.
    """
    ends = pairs.select(F.col("x").alias("cls"), F.lit(False).alias("leads")).unionByName(pairs.select(F.col("y").alias("cls"), F.lit(True).alias("leads"))).groupBy("cls").agg(F.max("leads").alias("leads"))
    wanted = written(rows.join(ends, "cls").groupBy("cls", "leads").agg(F.min("doc_id").alias("doc_id")), "passage-texts")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            words, at = words_of(part)
            right = text_classes(words, at) == part.column(0).to_numpy()
            texts = [words[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(k).filter(pa.array(right)) for k in (0, 2)), pa.array([packed(ngram_hashes(w, SHINGLE)) for w, r in zip(texts, right, strict=True) if r], pa.binary())], ["cls", "leads", "tokens"])

    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("cls", "text", "leads").mapInArrow(tokens, "cls long, leads boolean, tokens binary")
    texts = freed(written(texts.dropDuplicates(["cls"]), "passage-tokens"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, Places(np.zeros(0, np.uint32))
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                y, x = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                tokens = unpacked(batch.column(4)[k].as_buffer())
                if x is None:
                    leader, own = y, Places(tokens)
                    continue
                if leader != y:
                    raise ValueError("a text of a pair is missing")
                seeds = batch.column(3)[k].values
                table = np.stack([seeds.field(n).to_numpy().astype(np.int64) for n in ("f", "cx", "cy", "ax", "bx", "ay", "by")], 1)
                out += [(x, y, s, n + SHINGLE - 1, t, m + SHINGLE - 1, share, only) for s, n, t, m, share, only in everywhere(tokens, own, passages(tokens, own, candidates(table)))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["x", "y", "x_start", "x_words", "y_start", "y_words", "similarity", "only"])

    out = None
    for part in range(PARTS):
        own = pairs.where(F.pmod("x", F.lit(PARTS)) == part)
        many = own.groupBy("y").count().select("y", F.ceil(F.col("count") / PER_LEADER).cast("int").alias("salts"))
        dealt = own.join(many, "y").select("x", "y", F.pmod(F.xxhash64("x"), "salts").cast("int").alias("salt"), "seeds")
        members = dealt.join(texts.where(F.pmod("cls", F.lit(PARTS)) == part).select(F.col("cls").alias("x"), "tokens"), "x").select("y", "salt", "x", "seeds", "tokens")
        leaders = many.join(texts.where("leads").select(F.col("cls").alias("y"), "tokens"), "y").select("y", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("x"), F.lit(None).cast(pairs.schema["seeds"].dataType).alias("seeds"), "tokens")
        both = members.unionByName(leaders).repartition("y", "salt").sortWithinPartitions("y", "salt", F.col("x").asc_nulls_first())
        found = freed(written(both.mapInArrow(check, "x long, y long, x_start long, x_words long, y_start long, y_words long, similarity double, only long"), "passages", up=1))
        out = found if out is None else out.unionByName(found)
    return out


def candidate_pairs(docs: DataFrame) -> DataFrame:
    """x, y, seeds (see candidates) of the pairs of texts to verify; the tables on the way go when it is written."""
    with scratch(docs.sparkSession):
        shared = freed(written(windows(docs).groupBy("v").agg(F.min("cls").alias("least"), F.max("cls").alias("most"), F.count("*").alias("many")).where("least < most").select("v", "many"), "passage-minima"))
        some = windows(docs, Sketch.of(shared.select("v")))
        met = freed(written(some.join(shared.hint("merge"), "v").dropDuplicates(["v", "cls"]), "passage-windows"))
        with scratch(docs.sparkSession):
            leads = freed(written(leads_on(docs, met), "passage-leads", up=1))
        hot = met.where(F.col("many") > GROUP_ROWS).drop("many")  # joined, so that AQE can split them
        found = stars_together(met.where(F.col("many") <= GROUP_ROWS).drop("many")).unionByName(leads)
        for key in (["v"], ["v", "after"], ["v", "before"], ["v", "after", "before"]):
            found = found.unionByName(stars(hot, key, len(key) > 1))
        seeds = found.groupBy("x", "y").agg(F.collect_set(F.struct("f", "cx", "cy", "ax", "bx", "ay", "by")).alias("seeds"))
        strong = (F.size(F.array_distinct(F.transform("seeds", lambda s: s["f"]))) >= ENOUGH) | F.exists("seeds", lambda s: s["f"] < 0)
        return freed(written(seeds.where(strong), "passage-pairs", up=1))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, n_words, partner_id, partner_start, similarity, text_id, copies: each passage of a document that an other one has too.

    text_id is the least id of all documents with the same words, copies their number: partners are such ids, so membership joins them with all
    documents that they stand for. Passages are listed for both texts of a verified pair; a passage that a text shares with several others is listed once for each
    partner that it was verified with. That holds for the least id of equal texts; the other copies list the whole text, with the least
    other id as partner, and each passage of their text with one partner.
    """
    docs = id_text(docs, id_col, text_col)
    rows = written(described(docs).where(f"n >= {MIN_WORDS}").distinct(), "passage-rows")
    with scratch(docs.sparkSession):
        pairs = candidate_pairs(docs)
        passages_ = verified(pairs, docs, rows)
    least = written(rows.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("copies"), F.max("n").alias("n")), "passage-classes")
    both = passages_.where("only <> 2").select(F.col("x").alias("cls"), F.col("x_start").alias("start_word"), F.col("x_words").alias("n_words"), F.col("y").alias("other"), F.col("y_start").alias("partner_start"), "similarity").unionByName(
        passages_.where("only <> 1").select(F.col("y").alias("cls"), F.col("y_start").alias("start_word"), F.col("y_words").alias("n_words"), F.col("x").alias("other"), F.col("x_start").alias("partner_start"), "similarity")
    )
    near = both.join(least.where("rep IS NOT NULL").select(F.col("cls").alias("other"), F.col("rep").alias("partner_id")), "other")
    once = near.groupBy("cls", "start_word", "n_words").agg(F.min(F.struct("other", "partner_id", "partner_start", "similarity")).alias("p")).select("cls", "start_word", "n_words", "p.*")
    owners = rows.join(least.select("cls", "rep", "copies"), "cls").select("doc_id", "cls", F.col("rep").alias("text_id"), "copies", F.col("doc_id").eqNullSafe(F.col("rep")).alias("first"))
    listed = owners.where("first").join(near, "cls").unionByName(owners.where("NOT first").join(once, "cls")).select("doc_id", "start_word", "n_words", "partner_id", "partner_start", "similarity", "text_id", "copies")
    copies = rows.join(least.where("copies > 1").select("cls", "rep", "last", "copies"), "cls").select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("n_words"), F.when(F.col("doc_id") == F.col("rep"), F.col("last")).otherwise(F.col("rep")).alias("partner_id"), F.lit(0).cast("long").alias("partner_start"), F.lit(1.0).alias("similarity"), F.col("rep").alias("text_id"), "copies")
    return listed.unionByName(copies)
