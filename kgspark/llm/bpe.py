"""BPE encoding and decoding: batched numpy merge rounds over one flat array of symbols.

The distinct words of a slice of documents lie in one flat array. A round looks up the rank of every pair of
neighbours by binary search over the sorted pair keys, takes each word's lowest rank, and merges that pair
wherever the word has it (leftmost first where occurrences overlap). Words without a known pair leave the array.

Null texts count as empty: no ids, empty decoded text. Null ids stay null, repeated rows each give a row, other
columns are not read, so their names do not matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kgspark.llm.common import id_text, slices

#: Fixed value: the pattern that splits text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that are letters or numbers for the regex module, whose Unicode is newer than the tokenizers library's, and neither for the latter.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 "
    "1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
).split()
#: The same as a set, and the pattern with letters and numbers as the library knows them; texts below the first of them need it not.
NEWER_SET = "".join("-".join(regex.escape(chr(int(x, 16))) for x in r.split("-")) for r in NEWER)
STRICT_PATTERN = PATTERN.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{NEWER_SET}])+").replace(r"\p{L}+|", rf"[^\P{{L}}{NEWER_SET}]+|").replace(r"\p{N}+|", rf"[^\P{{N}}{NEWER_SET}]+|")
RARE = regex.compile(rf"[{chr(int(NEWER[0], 16))}-\U0010FFFF]")
NONE = np.int64(1 << 40)
#: Words whose ids a worker keeps; beyond it the memory starts anew (the results are the same).
CACHE_WORDS = 200_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """A byte-level vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = dict(spec["model"]["vocab"]), byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        by_id = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        table = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.raw = np.frombuffer(b"".join(table), np.uint8)
        self.raw_len = np.array([len(t) for t in table], np.int64)
        self.raw_at = np.concatenate(([0], np.cumsum(self.raw_len)))[:-1]
        self.words, self.strict = regex.compile(PATTERN), regex.compile(STRICT_PATTERN)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        """Empties the worker's memory of words; special tokens are words of one id."""
        self.slot: dict[str, int] = {}
        self.ids, self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        symbols, word = self.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            pair = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(symbols), NONE)
            rank[:-1] = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.ranks[at], NONE)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.concatenate((first, [len(word)]))))
            live = lowest < NONE
            if not live.all():
                done.append((symbols[~live], word[~live]))
                symbols, word, rank, lowest = symbols[live], word[live], rank[live], lowest[live]
            hit = np.flatnonzero(rank == lowest)
            if len(hit) > 1:  # of overlapping occurrences (a run of one symbol) every second falls away
                run = np.concatenate(([True], np.diff(hit) > 1))
                begin = hit[np.flatnonzero(run)][np.cumsum(run) - 1]
                hit = hit[(hit - begin) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.slot]
        if not new:
            return
        ids, n = self.merge([w.encode() for w in new])
        base = len(self.slot)
        self.slot.update((w, base + k) for k, w in enumerate(new))
        self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(n) - n))
        self.ids, self.n = np.concatenate((self.ids, ids)), np.concatenate((self.n, n))

    def split(self, text: str) -> list[str]:
        return (self.strict if RARE.search(text) else self.words).findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; special tokens written in a text become their ids."""
        if len(self.slot) > CACHE_WORDS:
            self.forget()
        pieces, counts, fixed = [], [], []
        for text in texts:
            n = len(pieces)
            for k, part in enumerate(self.parts.split(text) if self.parts else [text]):
                if k % 2:
                    fixed.append((len(pieces), self.special[part]))
                    pieces.append("")
                elif part:
                    pieces += self.split(part)
            counts.append(len(pieces) - n)
        self.learn({*pieces, ""})
        slot = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        n, at = self.n[slot], self.at[slot]
        pool = self.ids
        if fixed:
            where, ids = (np.array(x, np.int64) for x in zip(*fixed, strict=True))
            at[where], n[where], pool = len(pool) + np.arange(len(ids)), 1, np.concatenate((pool, ids))
        flat = gather(pool, at, n)
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.raw, self.raw_at[ids], self.raw_len[ids]).tobytes().decode("utf-8", "replace")


def gather(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """pool[at[0]:at[0]+n[0]], pool[at[1]:at[1]+n[1]] and so on as one array."""
    total = int(n.sum())
    if not total:
        return pool[:0]
    before = np.cumsum(n) - n
    return pool[np.repeat(at - before, n) + np.arange(total)]


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids (binary: ids as little-endian unsigned 32-bit integers) and decoded (the text they stand for).

    tokenizer: path of the vocabulary file, readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for part in slices(batches, 1):
            ids = bpe.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "token_ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, token_ids binary, decoded string")


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and decoded for packed ids such as encode_decode makes; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for part in slices(batches, 1):
            texts = [bpe.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return tokens.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{ids_col}` as token_ids").mapInArrow(run, "doc_id long, decoded string")
