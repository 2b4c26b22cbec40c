"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The models (bigrams over character classes of printable ASCII) are trained from
labelled samples, random strings against ordinary identifiers; a token whose
ratio is high for its length is a secret of kind ``random``.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: What the models look at: tokens of 16 or more of these characters, with a digit and a letter.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}")
#: Log-likelihood ratio asked for: in all, and for each character.
TOTAL, EACH = 12.0, 0.6

#: Parts of ordinary identifiers for the labelled samples.
PARTS = (
    "account address after array async await base before block buffer build bytes cache call channel check child class client code column "
    "config connect content context copy core count create current cursor data date default delete device domain down element email enable "
    "end entry error event example extract factory field file filter final first flag float folder form format from frame function get group "
    "handler hash header height hidden host http image index init input insert instance integer item iterator job join json key label last "
    "layer left length level limit line link list load local lock log loop main map mask match max menu merge message method min mode model "
    "module name next node null number object offset open option order output package page parent parse part password path pixel point "
    "pool post prefix process product query queue range read record region remote render report request reset result return right root "
    "row rule run sample save scale schema scope script search section select server service session set shape size slice sort source "
    "split stack start state status step stop store stream string style suffix switch table tag target task temp test text thread time "
    "title token top total train tree type union update upload url user util value vector version view web width window word work write"
).split()


def labelled_samples(n: int = 4_000, seed: int = 5) -> list[tuple[str, int]]:
    """(string, 1 random / 0 ordinary): strings over four alphabets; identifiers in four styles, some numbered."""
    r = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = (digits + "abcdef", upper + digits, upper + lower + digits, upper + lower + digits + "+/_-")
    out = []
    for i in range(n):
        out.append(("".join(r.choice(alphabets[i % 4]) for _ in range(r.randint(16, 64))), 1))
        words = [r.choice(PARTS) for _ in range(r.randint(2, 6))]
        if r.random() < 0.5:
            words.insert(r.randint(1, len(words)), str(r.choice((r.randint(0, 9), r.randint(10, 99), r.randint(1970, 2039)))))
        style = i % 4
        out.append(("_".join(words) if style == 0 else "-".join(words) if style == 1 else "/".join(words) if style == 2 else words[0] + "".join(w.title() for w in words[1:]), 0))
    return out


def train(samples: list[tuple[str, int]] | None = None) -> np.ndarray:
    """128 x 128 log ratios P(next | character, random) / P(next | character, ordinary), add-one smoothed."""
    counts = np.ones((2, 128, 128))
    for s, y in samples or labelled_samples():
        codes = np.frombuffer(f"\0{s}\0".encode("ascii", "replace"), dtype=np.uint8)
        np.add.at(counts[y], (codes[:-1], codes[1:]), 1)
    p = np.log(counts / counts.sum(2, keepdims=True))
    return p[1] - p[0]


def ratio(model: np.ndarray, token: str) -> float:
    codes = np.frombuffer(f"\0{token}\0".encode("ascii"), dtype=np.uint8)
    return float(model[codes[:-1], codes[1:]].sum())


def find(text: str, model: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text as (start, kind, end), in order of start, then kind."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    reach = list(accumulate((e for _, _, e in base), max))  # the furthest end up to each span
    starts = [s for s, _, _ in base]
    added = []
    for m in TOKEN.finditer(text):
        before = bisect_left(starts, m.end())  # spans that start before the token's end
        if before and reach[before - 1] > m.start():
            continue
        r = ratio(model, m[0])
        if r >= TOTAL and r >= EACH * len(m[0]):
            added.append((m.start(), 3, m.end()))
    return base, sorted(base + added)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row, over the whole text.

    Null and empty texts have no spans (the digest is that of the empty string);
    rows repeat as they come; extra columns are ignored.
    """
    box = docs.sparkSession.sparkContext.broadcast(train(samples))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in b.column(1).to_pylist():
                base, every = find(text, box.value)
                kinds = [k for _, k, _ in base]
                row = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c, pa.string()) for c in cols[3:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
