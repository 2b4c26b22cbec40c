"""Helpers shared by the training-data operators: scratch tables, word hashing, shingles."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and tab..carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Words per shingle.
SHINGLE = 5
#: Distinct words remembered by one worker before its cache starts afresh.
CACHE_WORDS = 1 << 18

_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; in local mode only, a temporary folder where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="pixelmill-")
        base = _local["dir"]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The scratch tables of one call: written, read back, and deleted when the call is done with them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = scratch_dir(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, self.paths.pop(id(df))[0])

    def finish(self, df: DataFrame) -> DataFrame:
        """Write the call's result and delete all other tables."""
        before = [path for path, _ in self.paths.values()]
        out = cut(df)
        for path in before:
            remove(self.spark, path)
        self.paths.clear()
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def utf8(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


class WordHashes(dict):
    """UTF-8 word -> 8 bytes of its xxh64, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_digest(word)
        return value


_hashes = WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    """One uint64 a word of the text, A-Z lowered; bytes.split() breaks at the same characters as WORD_BREAK."""
    words = text.lower().split()
    return np.frombuffer(b"".join(map(_hashes.__getitem__, words)), dtype="<u8")


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A hash for each run of n words in order; a shorter text is one shingle, no words give none."""
    if not len(words):
        return words
    k = min(n, len(words))
    rows = len(words) - k + 1
    x = np.full(rows, k, dtype="<u8")
    for i in range(k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + words[i : i + rows]
    return mix(x)


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value of x is in a sorted array."""
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x
