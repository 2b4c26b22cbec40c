"""Toxicity by compression distance.

Two zstandard dictionaries are trained from labelled rows by the library's
trainer: the ordinary one from ordinary text, the toxic one from toxic text, which
comes after the ordinary segments, so that the two differ in nothing else. A text is
cut into windows of a few words; each window is compressed under both dictionaries,
and the difference in length becomes a log-likelihood ratio by histograms over
labelled windows. A logistic calibration of the windows' ratios gives the score.

Most words of a toxic text are ordinary. The trainer for the toxic segments
therefore sees the occurrences of those words only that toxic rows favour; trained
on whole toxic texts, it fills the dictionary with what all texts share (README).

Null texts count as empty; empty texts get a defined score (that of no window).
Rows repeat as they come, a null doc_id hashes as the empty text, extra columns
are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import id_crc, utf8

LOW, HIGH = -8, 14
#: Score from which a document counts as toxic.
THRESHOLD = 0.3


@dataclass
class Settings:
    window_words: int = 6
    level: int = 3
    #: Bytes of the ordinary dictionary, and ordinary words (spread over the sample) that they are trained from.
    common_bytes: int = 100_000
    common_words: int = 400_000
    #: The trainer's segment and match sizes for ordinary and for toxic segments.
    common_cover: tuple[int, int] = (32, 6)
    own_cover: tuple[int, int] = (50, 6)
    #: Words that the trainer sees for the toxic segments: all of these odds, of which so large a share is expected to be there by chance.
    odds: float = 8.0
    false_share: float = 1e-4
    #: Bounds of the labelled sample: ids of each class (about: by a hash), and windows of an id's text, spread over it.
    max_rows: int = 4_000
    max_windows: int = 2_000


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    settings: Settings
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(HIGH - LOW + 1))
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def compressors(self) -> tuple[zs.ZstdCompressor, zs.ZstdCompressor]:
        made = []
        for content in (self.toxic, self.ordinary):
            params = zs.ZstdCompressionParameters.from_level(
                self.settings.level, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False
            )
            trained = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(compression_params=params)
            made.append(zs.ZstdCompressor(dict_data=trained, compression_params=params))
        return made[0], made[1]


def windows(text: bytes, size: int) -> list[bytes]:
    """Windows of ``size`` words over the whole text; very long words make long windows, none is cut."""
    words = text.lower().split()
    return [b" " + b" ".join(words[k : k + size]) + b" " for k in range(0, len(words), size)]


def gains(made, parts: list[bytes]) -> np.ndarray:
    """Bytes by which the toxic dictionary shortens each window more than the ordinary one."""
    toxic, ordinary = made[0].compress, made[1].compress
    return np.fromiter((len(ordinary(x)) - len(toxic(x)) for x in parts), dtype=np.int64, count=len(parts))


def features(values: np.ndarray, ratios: np.ndarray) -> list[float]:
    n = len(values)
    if not n:
        return [0.0] * 7
    r = ratios[np.clip(values, LOW, HIGH) - LOW]
    top = np.sort(r)[::-1]
    first, length = r.sum() / math.sqrt(n), math.log(n)
    return [first, r.mean(), top[0], top[:3].sum() / 3, length, first * length, top[0] * length]


def _odd(ordinary: Counter, toxic: Counter, docs: list[int], s: Settings) -> list[bytes]:
    """All words that favour toxic rows by the odds, of which an expected share of ``false_share`` at most does so by chance.

    The chance that a word's rows fall to the toxic class as often as seen is a
    binomial tail; the words to keep follow by Benjamini and Hochberg.
    """
    q = docs[1] / sum(docs)
    ways: dict[tuple[int, int], float] = {}
    found = []
    for w, n in toxic.items():
        m = ordinary[w]
        if n > 1 and n / docs[1] > s.odds * m / docs[0]:
            if (n, m) not in ways:
                t = n + m
                logs = [math.lgamma(t + 1) - math.lgamma(k + 1) - math.lgamma(t - k + 1) + k * math.log(q) + (t - k) * math.log(1 - q) for k in range(n, t + 1)]
                ways[n, m] = sum(map(math.exp, logs))
            found.append((ways[n, m], w))
    found.sort()
    keep = max((i for i, (p, _) in enumerate(found, 1) if p * len(toxic) <= s.false_share * i), default=0)
    return [w for _, w in found[:keep]] or [w for w, n in toxic.items() if n / docs[1] > 2 * (ordinary[w] + 1) / docs[0]]


def trained(samples: list[bytes], size: int, cover: tuple[int, int]) -> bytes:
    """Segments that the library's trainer chooses; the samples themselves where they are too few to train from."""
    try:
        return zs.train_dictionary(size, samples, k=cover[0], d=cover[1]).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _spread(values: list, most: int) -> list:
    return values if len(values) <= most else [values[i * len(values) // most] for i in range(most)]


def dictionaries(rows: list[tuple[bytes, int]], s: Settings) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, of one length (offsets cost alike)."""
    counts, docs = (Counter(), Counter()), [0, 0]
    words: tuple[list, list] = ([], [])
    for text, y in rows:
        own = text.lower().split()
        counts[y].update(set(own))
        words[y].extend(b" " + w + b" " for w in own)
        docs[y] += 1
    odd = {b" " + w + b" " for w in _odd(counts[0], counts[1], docs, s)}
    favoured = [w for w in words[1] if w in odd]
    common = trained(_spread(words[0], s.common_words), s.common_bytes, s.common_cover)
    toxic = trained(favoured, max(1_000, sum(map(len, odd))), s.own_cover)
    return common + toxic, common + b" " * len(toxic)


def fit(rows: list[tuple[bytes, int]], share: float, settings: Settings | None = None) -> Model:
    """Train both dictionaries, the ratios and the calibration; ``share`` is the toxic share of all labels.

    Without rows of both classes the model gives every text the smoothed share.
    """
    s = settings or Settings()
    docs = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    if not all(docs):
        return Model(b" ", b" ", s, weights=np.array([math.log((share + 1e-3) / (1 - share + 1e-3))] + [0.0] * 7), mean=np.zeros(8), scale=np.ones(8))
    model = Model(*dictionaries(rows, s), s)
    cut = [(_spread(windows(text, s.window_words), s.max_windows), y) for text, y in rows]
    made = model.compressors()
    values = [gains(made, parts) for parts, _ in cut]
    shape = [np.ones(HIGH - LOW + 1), np.ones(HIGH - LOW + 1)]
    for v, (_, y) in zip(values, cut, strict=True):
        shape[y] += np.bincount(np.clip(v, LOW, HIGH) - LOW, minlength=HIGH - LOW + 1) / math.sqrt(max(1, len(v)))
    model.ratios = np.log(shape[1] / shape[1].sum()) - np.log(shape[0] / shape[0].sum())
    x = np.array([[1.0, *features(v, model.ratios)] for v in values])
    y = np.array([label for _, label in rows], dtype=float)
    weight = np.where(y == 1, share / docs[1], (1 - share) / docs[0]) * len(rows)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.mean[0], model.scale[0] = 0, 1
    x = (x - model.mean) / model.scale
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * w)
    model.weights = w
    return model


def score_texts(model: Model, made, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    x = np.array([[1.0, *features(gains(made, windows(t, model.settings.window_words)), model.ratios)] for t in texts])
    return 1 / (1 + np.exp(-np.clip(((x - model.mean) / model.scale) @ model.weights, -30, 30)))


def _shortened(text: bytes, s: Settings) -> bytes:
    return b"".join(_spread(windows(text, s.window_words), s.max_windows))


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on labelled rows of ``docs`` whose crc32(doc_id) mod 4 is not 2, in one task.

    The sample holds about ``max_rows`` ids of each class, chosen by a hash of the id,
    and of each id's text (the least, where the id repeats) at most ``max_windows``
    windows. A repeated label counts as toxic if any row says so; null labels and null
    ids are left out.
    """
    s = settings or Settings()
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    marks = marks.filter(id_crc() % 4 != 2)
    total = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    share = (total["t"] + 0.5) / (total["n"] + 1)
    if not total["n"]:
        return fit([], share, s)
    of = [min(1.0, s.max_rows / max(1, n)) for n in (total["n"] - total["t"], total["t"])]
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    picked = marks.filter(place < F.when(F.col("y") == 1, of[1]).otherwise(of[0]))
    # About 2 max_rows ids, whatever the table: they go to all executors, and texts are read for them only.
    texts = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += [(d, _shortened(t, s), y) for d, t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        rows.sort()
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit([(t, y) for _, t, y in rows], share, s))], pa.binary())})

    return pickle.loads(texts.repartition(1).mapInArrow(run, "model binary").first()["model"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; only the text is read for the score."""
    content = pickle.dumps(model)  # some 200 kB; goes with the function, so that nothing is left in the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(content)
        made = m.compressors()
        for b in batches:
            p = score_texts(m, made, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p)], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), utf8().alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
