"""LM scoring: a hashed maximum-entropy model with class-factored softmax.

Word counts of the whole training part give the base score and the classes.
Frequent words (the vocabulary) are grouped by their neighbours and cut by
frequency into classes; all others are one class of that layer, which a second
layer parts into groups by hash, so that every word has a class with weights of
its own: P(token) = P(class | context) * P(group | context) * P(word | class or
group), the group's factor for the others only. Both layers are softmaxes over
hashed features of the words before (one, two together, and two skips), whichever
words these are; two words together of which one is outside the vocabulary are a
feature as they are and a second one without that word. They are trained by
distributed gradient updates: each partition takes gradient steps from the same
weights over all its training tokens, and the changes are averaged row by row in
a tree. Within a class or group words share by counts, in groups smoothed and
with a place for unseen words, so that all words and the end sum to one.

Words are known by their 64-bit hash (two of 10^8 words agree with a chance of
3e-4).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import cut, id_crc, mix, utf8

#: Words classed by neighbours; words whose counts go to the executors (a join has the rest); feature rows, half of them for features that hold other words; groups and frequency cuts.
VOCABULARY, TABLE, ROWS, GROUPS, CUTS, SIGNS = 8_192, 100_000, 1 << 14, 8, 8, 32
#: Groups of the other words by hash, and how many words there are for a group before there are more.
OTHERS, WORDS_A_GROUP = 64, 256
RATE, BATCH, FLUSH, FAN_IN = 0.25, 16_384, 300_000, 64
#: Tokens whose class chances are worked out at once, and rows of a run that are summed with those of other runs.
BLOCK, TOGETHER = 1_024, 24
ALPHA = 0.1
END = xxhash.xxh64_digest(b" end ")
PAD, OTHER = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" pad ", b" other "))
SLOT_BITS = 20
_FEATURES = 5


def count_words(texts: DataFrame) -> DataFrame:
    """word (hash), n over all texts, an end token each; partial counts are flushed at a bound."""

    def rows(seen: Counter) -> pa.RecordBatch:
        words = np.frombuffer(b"".join(map(xxhash.xxh64_digest, seen.keys())), dtype="<i8")
        return pa.RecordBatch.from_pydict({"word": pa.array(words), "n": pa.array(np.fromiter(seen.values(), np.int64, len(seen)))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        ends = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(text.lower().split())
                ends += 1
                if len(seen) >= FLUSH:
                    yield rows(seen)
                    seen = Counter()
        if seen:
            yield rows(seen)
        if ends:
            yield pa.RecordBatch.from_pydict({"word": pa.array([int.from_bytes(END, "little", signed=True)], pa.int64()), "n": pa.array([ends], pa.int64())})

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Lookup:
    """Word hashes -> places in the table (its length: not there).

    Slots by the leading bits of a hash hold the place of the first word there; a search knows the words that lost theirs.
    """

    def __init__(self, words: np.ndarray):
        self.words, self.shift = np.append(words, 0), np.uint64(64 - SLOT_BITS)
        slots = self._slots(words)
        self.places = np.full(1 << SLOT_BITS, len(words), dtype=np.int64)
        self.places[slots[::-1]] = np.arange(len(words))[::-1]
        lost = np.flatnonzero(self.places[slots] != np.arange(len(words)))
        order = np.argsort(words[lost])
        self.lost, self.lost_places = words[lost][order], lost[order]

    def _slots(self, words: np.ndarray) -> np.ndarray:
        return (words.view("<u8") >> self.shift).astype(np.int64)

    def of(self, words: np.ndarray) -> np.ndarray:
        out = self.places[self._slots(words)]
        others = np.flatnonzero((self.words[out] != words) | (out == len(self.words) - 1))
        out[others] = len(self.words) - 1
        if len(self.lost):
            sought = words[others]
            at = np.minimum(np.searchsorted(self.lost, sought), len(self.lost) - 1)
            there = self.lost[at] == sought
            out[others[there]] = self.lost_places[at[there]]
        return out


@dataclass
class Model:
    words: np.ndarray  # table, most frequent first
    counts: np.ndarray
    total: int
    distinct: int
    vocabulary: int
    classes: np.ndarray  # of each place below vocabulary, then of the others
    in_class: np.ndarray  # log10 P(word | class); 0 for the others
    scale: np.ndarray  # log10 of what divides the smoothed count of a word of each group
    bias: list[np.ndarray]  # of the classes, of the groups
    weights: list[np.ndarray]


def _encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (an end after each text), and offsets of the texts."""
    parts, lengths = [], []
    for t in texts:
        words = t.lower().split()
        parts += map(xxhash.xxh64_digest, words)
        parts.append(END)
        lengths.append(len(words) + 1)
    return np.frombuffer(b"".join(parts), dtype="<i8"), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _before(x: np.ndarray, offsets: np.ndarray, pad: np.generic) -> list[np.ndarray]:
    """What stands one, two and three before; ``pad`` before a text's first."""
    at = np.arange(len(x)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = []
    for k in (1, 2, 3):
        y = np.full(len(x), pad)
        y[k:] = x[: len(x) - k]
        y[at < k] = pad
        out.append(y)
    return out


def _features(words: np.ndarray, other: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of each token's features; ``other`` marks words outside the vocabulary, whose features have rows of their own."""
    one, two, three = _before(words.view("<u8"), offsets, PAD)
    a, b, c = _before(other, offsets, np.False_)
    pair, mixed = one * np.uint64(1 << 20) + two, a | b
    common = np.where(a, OTHER, one) * np.uint64(1 << 20) + np.where(b, OTHER, two)
    salted = [(one, a), (common, np.zeros_like(a)), (two, b), (three, c), (np.where(mixed, pair, one), np.ones_like(a))]
    half = ROWS // 2
    return np.stack([(mix(x * np.uint64(8) + np.uint64(0x51ED27 + i)) & np.uint64(half - 1)).astype(np.int64) + half * late for i, (x, late) in enumerate(salted)])


def _softmax(model_bias: np.ndarray, weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Class chances of each token; BLOCK tokens at a time, which stay in the processor's cache."""
    out = np.empty((f.shape[1], weights.shape[1]), dtype=np.float32)
    spare = np.empty((min(BLOCK, len(out)), weights.shape[1]), dtype=np.float32)
    for s in range(0, len(out), BLOCK):
        z = out[s : s + BLOCK]
        t = spare[: len(z)]
        np.take(weights, f[0, s : s + BLOCK], axis=0, out=z, mode="clip")
        for k in range(1, _FEATURES):
            z += np.take(weights, f[k, s : s + BLOCK], axis=0, out=t, mode="clip")
        z += model_bias
        if np.abs(z).max() > 60:  # else exp neither overflows nor vanishes
            z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= np.einsum("ij->i", z)[:, None]
    return out


def _row_sums(p: np.ndarray, members: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``p`` that ``members`` lists, a run from each place of ``first`` to the next.

    Step k adds the k-th row of all runs that have one; what runs hold beyond TOGETHER rows is summed run by run.
    """
    lengths = np.diff(np.append(first, len(members)))
    by_length = np.argsort(-lengths, kind="stable")
    begin, left = first[by_length], lengths[by_length]
    sums = np.take(p, members[begin], axis=0)
    for k in range(1, min(TOGETHER, int(left[0]))):
        m = int(np.searchsorted(-left, -k))  # runs of more than k rows
        sums[:m] += np.take(p, members[begin[:m] + k], axis=0)
    for i in range(int(np.searchsorted(-left, -TOGETHER))):
        sums[i] += np.take(p, members[begin[i] + TOGETHER : begin[i] + left[i]], axis=0).sum(0)
    out = np.empty_like(sums)
    out[by_length] = sums
    return out


def _chunks(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 21):
    """Lists of whole texts of about ``size`` bytes, with the batch and first row."""
    for b in batches:
        texts, first, used = [], 0, 0
        for i, t in enumerate(b.column(column).to_pylist()):
            texts.append(t)
            used += len(t)
            if used >= size:
                yield b, first, texts
                texts, first, used = [], i + 1, 0
        if texts:
            yield b, first, texts


def _signatures(texts: DataFrame, box, vocabulary: int) -> np.ndarray:
    """vocabulary x 2 SIGNS: how often each word follows and precedes each of the most frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(box.value)
        cells = np.zeros(vocabulary * 2 * SIGNS, dtype=np.int64)
        for _, _, part in _chunks(batches, 0):
            place = lookup.of(_encode(part)[0])
            a, b = place[:-1], place[1:]
            m = (a < SIGNS) & (b < vocabulary)
            cells += np.bincount(b[m] * 2 * SIGNS + a[m], minlength=len(cells))
            m = (b < SIGNS) & (a < vocabulary)
            cells += np.bincount(a[m] * 2 * SIGNS + SIGNS + b[m], minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at), "n": pa.array(cells[at])})

    got = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary * 2 * SIGNS)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(vocabulary, 2 * SIGNS)


def _classes(signs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A class for each word: groups of like neighbours (k-means), each cut by mass into CUTS."""
    x = np.sqrt((signs + 0.01) / (signs.sum(1, keepdims=True) + 0.64))
    mass = counts.astype(float)
    centers = [x[0]]
    for _ in range(GROUPS - 1):
        d = np.min([((x - c) ** 2).sum(1) for c in centers], axis=0)
        centers.append(x[np.argmax(d * np.sqrt(mass))])
    c = np.array(centers)
    for _ in range(25):
        g = np.argmin((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :], axis=1)
        for k in range(len(c)):
            if (g == k).any():
                c[k] = np.average(x[g == k], axis=0, weights=mass[g == k])
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(len(c)):
        m = np.flatnonzero(g == k)
        if len(m):
            share = np.cumsum(np.sqrt(mass[m]))
            out[m] = k * CUTS + np.minimum(CUTS - 1, (CUTS * (share - np.sqrt(mass[m])) / share[-1]).astype(int))
    return np.unique(out, return_inverse=True)[1]


class _Fit:
    """Gradient steps of a layer, away from the weights given."""

    def __init__(self, bias: np.ndarray, weights: np.ndarray):
        self.bias, self.start, self.w = bias, weights, weights.copy()
        self.seen, self.power = np.zeros(len(weights), dtype=np.float32), np.full(len(weights), 1e-8, dtype=np.float32)

    def steps(self, f: np.ndarray, goal: np.ndarray) -> None:
        for s in range(0, len(goal), BATCH):
            fb, gb = f[:, s : s + BATCH], goal[s : s + BATCH]
            p = _softmax(self.bias, self.w, fb)
            p[np.arange(len(gb)), gb] -= 1
            flat = fb.ravel().astype(np.uint16)
            order = np.argsort(flat, kind="stable")  # 16-bit keys sort by radix
            ordered = flat[order]
            first = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ 1))
            rows = ordered[first].astype(np.int64)
            change = _row_sums(p, order % len(gb), first)
            self.seen[rows] += np.diff(np.append(first, len(flat)))
            self.power[rows] += (change**2).sum(1)
            self.w[rows] -= (RATE / np.sqrt(self.power[rows]))[:, None] * change

    def made(self, s: slice) -> np.ndarray:
        """How often each row was seen, and that times its change."""
        return np.concatenate([self.seen[s, None], (self.w[s] - self.start[s]) * self.seen[s, None]], axis=1)


def _goals(m: Model, lookup: _Lookup, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each token's place, features and class; the tokens outside the vocabulary and their groups."""
    place = lookup.of(words)
    other = place >= m.vocabulary
    at = np.flatnonzero(other)
    return place, _features(words, other, offsets), m.classes[np.minimum(place, m.vocabulary)], at, words[at] & (len(m.scale) - 1)


def _changes(texts: DataFrame, box) -> DataFrame:
    """part, block, content of each partition's weight changes after gradient steps over all its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m: Model = box.value
        lookup = _Lookup(m.words)
        classes, groups = (_Fit(b, w) for b, w in zip(m.bias, m.weights, strict=True))
        for _, _, part in _chunks(batches, 0):
            words, offsets = _encode(part)
            _, f, goal, others, group = _goals(m, lookup, words, offsets)
            classes.steps(f, goal)
            groups.steps(f[:, others], group)
        if not classes.seen.any():
            return
        for block in range(0, ROWS, 256):
            s = slice(block, block + 256)
            made = np.concatenate([classes.made(s), groups.made(s)], axis=1).astype("<f4")
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "block": pa.array([block], pa.int64()), "content": pa.array([made.tobytes()], pa.binary())})

    return texts.mapInArrow(run, "part long, block long, content binary")


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(c, "<f4") for c in group["content"]], axis=0, dtype=np.float64).astype("<f4")
    return pd.DataFrame({"part": [int(group["part"].iloc[0])], "block": [int(group["block"].iloc[0])], "content": [total.tobytes()]})


def _averaged(changes: DataFrame, classes: int, groups: int) -> list[np.ndarray]:
    """Each row's mean change in both layers, weighted by how often a partition saw it; blocks are summed in a tree of partitions."""
    got = cut(changes)
    parts = (got.agg(F.max("part").alias("p")).first()["p"] or 0) + 1
    while True:
        parts = math.ceil(parts / FAN_IN)
        got = got.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part", "block").applyInPandas(_summed, "part long, block long, content binary")
        if parts == 1:
            break
        got = cut(got)
    out = [np.zeros((ROWS, n), dtype=np.float32) for n in (classes, groups)]
    for r in got.collect():
        both = np.frombuffer(r["content"], "<f4").reshape(256, classes + groups + 2)
        for layer, x in zip(out, np.split(both, [classes + 1], axis=1), strict=True):
            layer[r["block"] : r["block"] + 256] = x[:, 1:] / np.maximum(x[:, :1], 1)
    return out


def train(texts: DataFrame, counts: DataFrame, rounds: int = 1) -> Model:
    """Fit on every whole text of ``texts`` (one binary column); ``counts`` are its word counts."""
    spark = texts.sparkSession
    sums = np.zeros((OTHERS, 2), dtype=np.int64)  # counts and words by hash
    for r in counts.groupBy(F.col("word").bitwiseAND(F.lit(OTHERS - 1)).alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        sums[r["g"]] = r["n"], r["v"]
    total, distinct = sums.sum(0).tolist()
    top = counts.orderBy(F.desc("n"), "word").limit(TABLE).toPandas()
    words, n = top["word"].to_numpy(dtype=np.int64), top["n"].to_numpy(dtype=np.int64)
    k = min(VOCABULARY, len(words))
    signs = _signatures(texts, spark.sparkContext.broadcast(words), k) if k else np.zeros((0, 2 * SIGNS))
    classes = _classes(signs, n[:k]) if k else np.zeros(0, dtype=np.int64)
    rest = int(classes.max(initial=-1)) + 1
    mass = np.bincount(classes, weights=n[:k], minlength=rest + 1)[: rest + 1].astype(float)
    mass[rest] = total - n[:k].sum()
    in_class = np.append(np.log10(n[:k] / mass[classes]), 0.0)
    np.subtract.at(sums, words[:k] & (OTHERS - 1), np.stack([n[:k], np.ones_like(n[:k])], axis=1))
    groups = 1
    while groups < OTHERS and groups * 2 * WORDS_A_GROUP <= distinct - k:
        groups *= 2
    shares = sums.reshape(-1, groups, 2).sum(0) @ np.array([1, ALPHA]) + ALPHA  # an unseen word in each
    bias = [np.log(x / x.sum()).astype(np.float32) for x in (mass + 1, shares)]
    weights = [np.zeros((ROWS, len(b)), dtype=np.float32) for b in bias]
    model = Model(words, n, total, distinct, k, np.append(classes, rest), in_class, np.log10(shares), bias, weights)
    for _ in range(rounds if total else 0):
        change = _averaged(_changes(texts, spark.sparkContext.broadcast(model)), rest + 1, groups)
        model.weights = [w + c for w, c in zip(model.weights, change, strict=True)]
    return model


def _log_chances(bias: np.ndarray, weights: np.ndarray, f: np.ndarray, goal: np.ndarray) -> np.ndarray:
    out = np.empty(len(goal))
    for s in range(0, len(goal), BLOCK):
        p = _softmax(bias, weights, f[:, s : s + BLOCK])
        out[s : s + BLOCK] = np.log10(np.maximum(p[np.arange(len(p)), goal[s : s + BLOCK]], 1e-30))
    return out


def chances(m: Model, lookup: _Lookup, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's place, log10 of its smoothed count and log10 P(token | the words before).

    A token beyond the table counts as 1 in both; the caller adds log10 of its smoothed count.
    """
    place, f, goal, others, group = _goals(m, lookup, words, offsets)
    own = np.append(np.log10(m.counts + ALPHA), 0.0)[place]
    chance = _log_chances(m.bias[0], m.weights[0], f, goal) + m.in_class[np.minimum(place, m.vocabulary)]
    chance[others] += _log_chances(m.bias[1], m.weights[1], f[:, others], group) + own[others] - m.scale[group]
    return place, own, chance


def score(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    The model learns from rows whose crc32(doc_id) mod 10 is not 0. Null texts
    count as empty and hold only the end; rows repeat as they come; a null doc_id
    hashes as the empty text; extra columns are ignored; an empty table gives an
    empty result, and with no training rows every token has the smoothed chance.
    """
    spark = docs.sparkSession
    held = id_crc() % 10 == 0
    training = docs.filter(~held).select(utf8().alias("text"))
    counts = cut(count_words(training))
    model = train(training, counts, rounds)
    box = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = box.value
        lookup = _Lookup(m.words)
        for b, first, part in _chunks(batches, 3):
            words, offsets = _encode(part)
            place, own, chance = chances(m, lookup, words, offsets)
            absent = place >= len(m.words)
            cells = [np.add.reduceat(x, offsets[:-1]) for x in (own, chance, (~absent).astype(np.int64))]
            text, rare = np.repeat(np.arange(len(part)), np.diff(offsets))[absent], words[absent]
            order = np.lexsort((rare, text))
            text, rare = text[order], rare[order]
            new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (rare[1:] != rare[:-1]))[: len(rare)])
            lists = pa.array(np.searchsorted(text[new], np.arange(len(part) + 1)).astype(np.int32))
            times = np.diff(np.append(new, len(rare)))
            rows = b.slice(first, len(part))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(2), pa.array(np.diff(offsets)), pa.array(cells[2]), pa.array(cells[0]), pa.array(cells[1]), pa.ListArray.from_arrays(lists, pa.array(rare[new])), pa.ListArray.from_arrays(lists, pa.array(times))],
                names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "logs", "chance", "rare", "times"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", held.alias("held_out"), utf8().alias("text"))
    made = cut(rows.mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, chance double, rare array<long>, times array<long>"))
    cells = made.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    joined = cells.join(counts, "word", "left")
    late = joined.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("late"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("late_known"))
    out = made.drop("rare", "times").join(late, "uid", "left")
    extra, divide = F.coalesce("late", F.lit(0.0)), math.log10(model.total + ALPHA * (model.distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * divide).alias("base_score"), (F.col("chance") + extra).alias("score"),
    )
