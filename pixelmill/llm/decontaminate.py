"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item of L words is compared with every run of L words of a document,
and with the whole of a document that is shorter (an item with words cut off).
Windows that could reach the similarity (enough of their shingles occur in some
item of that length, by running sums; none that could is left out) get a 128-bit
SimHash of their weighted shingles. The fingerprints of the items stand in
multi-index blocks, one entry a block: two fingerprints within RADIUS bits agree
within RADIUS // BLOCKS bits in one block at least, so probing each block with all
flips of so many bits finds all of them. The weighted shingle similarity of each candidate is then exact.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import SHINGLE, among, mix, shingle_hashes, utf8, word_hashes

SIMILARITY = 0.8
BITS, RADIUS, BLOCKS = 128, 32, 11
#: Bytes of item text that go to the executors at once, some 20 times as much as an index; a larger benchmark is scanned for in parts.
MOST_BYTES = 16 << 20

_CUTS = np.linspace(0, BITS, BLOCKS + 1).astype(int)
_FLIPS = [[sum(1 << w for w in where) for n in range(RADIUS // BLOCKS + 1) for where in combinations(range(int(width)), n)] for width in np.diff(_CUTS)]


def _bits(shingles: np.ndarray) -> np.ndarray:
    """n x 128 of +1 and -1 from two mixes of each shingle."""
    halves = np.stack([mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), mix(shingles + np.uint64(0x632BE59BD9B4E019))], axis=1)
    return np.unpackbits(halves.view(np.uint8).reshape(len(shingles), 16), axis=1).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return (sums > 0).astype(np.uint8)


def _block_keys(bits: np.ndarray) -> list[int]:
    return [int("".join(map(str, bits[a:b])), 2) for a, b in zip(_CUTS[:-1], _CUTS[1:], strict=True)]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def least_words(length: int, similarity: float) -> int:
    """Words of the shortest text that can reach the similarity with an item of ``length`` words."""
    k = min(SHINGLE, length)
    return k - 1 + max(1, math.ceil((length - k + 1) * similarity - 1e-9))


class Items:
    """The benchmark: shingles, and by length the fingerprints in blocks."""

    def __init__(self, rows: list[tuple[int, bytes]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.by_length: dict[int, dict] = {}
        seen: list[np.ndarray] = []
        for item, text in rows:
            words = word_hashes(text)
            if not len(words):
                continue
            s = shingle_hashes(words)
            if len(words) not in self.by_length:
                self.by_length[len(words)] = {"ids": [], "counts": [], "bits": [], "blocks": [defaultdict(list) for _ in range(BLOCKS)]}
            g = self.by_length[len(words)]
            bits = fingerprint(_bits(s).sum(0))
            for k, key in enumerate(_block_keys(bits)):
                g["blocks"][k][key].append(len(g["ids"]))
            g["ids"].append(item)
            g["counts"].append(Counter(s.tolist()))
            g["bits"].append(bits)
            seen.append(s)
        for g in self.by_length.values():
            g["bits"] = np.array(g["bits"])
            g["shingles"] = np.array(sorted({x for c in g["counts"] for x in c}), dtype="<u8")
        every = np.unique(np.concatenate(seen)) if seen else np.zeros(0, "<u8")
        self.every = every
        self.low = np.zeros(1 << 20, dtype=bool)
        self.low[(every & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.least_words = min((least_words(n, similarity) for n in self.by_length), default=0)


def matches(text: bytes, items: Items) -> list[tuple[int, int, int, float]]:
    """(item, first word, words, similarity) of the best window for each item that reaches the similarity."""
    words = word_hashes(text)
    if not items.by_length or len(words) < items.least_words:
        return []
    found: dict[int, tuple[int, int, int, float]] = {}
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in sorted(items.by_length):
        if len(words) < least_words(length, items.similarity):
            continue
        size = min(length, len(words))  # a shorter document is one window
        k = min(SHINGLE, length)
        if k not in by_size:
            s = shingle_hashes(words, k)
            at = np.flatnonzero(items.low[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
            by_size[k] = (s, at[among(s[at], items.every)] if len(at) else at)
        s, at = by_size[k]
        g, n = items.by_length[length], size - k + 1
        # Shared weight I of multisets of n and m shingles with I / (n + m - I) >= t is at least (n + m)t / (1 + t).
        need = (n + length - k + 1) * items.similarity / (1 + items.similarity) - 1e-9
        if len(at) < need:
            continue
        own_at = at[among(s[at], g["shingles"])]
        if len(own_at) < need:
            continue
        hit = np.zeros(len(s) + 1, dtype=np.int64)
        hit[own_at + 1] = 1
        sums = np.cumsum(hit)
        starts = np.flatnonzero(sums[n:] - sums[: len(sums) - n] >= need)
        for p in starts:
            window = s[p : p + n]
            bits = fingerprint(_bits(window).sum(0))
            near = {i for b, key in enumerate(_block_keys(bits)) for flip in _FLIPS[b] for i in g["blocks"][b].get(key ^ flip, ())}
            own = None
            for i in sorted(near):
                if int((g["bits"][i] != bits).sum()) > RADIUS:
                    continue
                own = own or Counter(window.tolist())
                j = weighted_jaccard(own, g["counts"][i])
                if j >= items.similarity and (i_id := g["ids"][i]) is not None and j > found.get(i_id, (0, 0, 0, 0.0))[3]:
                    found[i_id] = (i_id, int(p), size, j)
    return sorted(found.values())


def load_items(benchmark: DataFrame, similarity: float = SIMILARITY) -> Iterator[Items]:
    """Items for the executors, in as many parts as MOST_BYTES asks for, dealt by a hash of the text; each item is in one."""
    rows = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", utf8().alias("text"))
    parts = max(1, math.ceil((rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) / MOST_BYTES))
    for p in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        yield Items([(r["item_id"], bytes(r["text"])) for r in own.orderBy("item_id", "text").collect()], similarity)


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: each item that a document holds, once, by its best window.

    Null and empty texts and items match nothing; items without an id are left
    out; items of fewer than five words are one shingle; a document shorter than an
    item is compared as a whole; rows repeat as they come; extra columns are
    ignored; an empty benchmark gives an empty result; rows that repeat an item's id
    are compared each, and may be reported each where they fall in different parts.
    """
    out = None
    for items in load_items(benchmark, similarity):
        found = _found(docs, items)
        out = found if out is None else out.unionByName(found)
    return out


def _found(docs: DataFrame, items: Items) -> DataFrame:
    box = docs.sparkSession.sparkContext.broadcast(items)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                got = matches(text, box.value)
                at += [k] * len(got)
                rows += got
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())],
                names=["doc_id", "item_id", "start_word", "n_words", "similarity"],
            )

    return docs.select("doc_id", utf8().alias("text")).mapInArrow(run, f"doc_id {kind}, item_id long, start_word long, n_words long, similarity double")
