"""Token-ID output: flat unsigned integer files plus 64-bit document offsets, memory-mapped.

Documents are range-partitioned in ascending id order; each partition writes one
shard, ``<name>.bin`` (ids as little-endian unsigned 16 or 32-bit integers, by
the vocabulary's size) and ``<name>.idx`` (documents + 1 unsigned 64-bit offsets
into the shard). Only shards of tasks that ended count: the driver gathers one
row a shard, takes prefix sums for the shards' bases and writes ``shards.json``.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm.common import scratch_dir

END_ID = 2
#: Pieces whose ids a worker remembers, from task to task, before it starts afresh.
KNOWN_PIECES = 1 << 19
_known: dict[tuple[str, str], "_Ids"] = {}
#: Fixed value: a pre-tokenizer that drops white space and encodes each match by itself; what it matches in lower-case Latin-1.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^ \t-\r\x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Fixed value: the only normaliser under which pieces may be encoded apart.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
BEYOND = re.compile("[^\x00-\xff]")
WORD = re.compile("[^ \t-\r]+")
#: With this in a word, an added token may be in it.
ADDED = "<|"
#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - _SHOWN))}


@dataclass
class TokenFiles:
    """A written data set; shards in ascending order: (name, documents, ids, base)."""

    path: str
    dtype: str
    shards: list[tuple[str, int, int, int]]


def _open_fs(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def _in_pieces(content: str) -> bool:
    """Whether the tokenizer lowers its text, splits it by SPLIT and merges bytes, so that pieces can be encoded apart."""
    made = json.loads(content)
    first = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    splits = [(x.get("type"), x.get("pattern", {}).get("Regex"), x.get("use_regex"), x.get("add_prefix_space")) for x in first]
    added = [x["content"] for x in made.get("added_tokens", [])]
    split = splits == [("Split", SPLIT, None, None), ("ByteLevel", None, False, False)]
    return made.get("normalizer") == NORMALIZER and split and made["model"].get("type") == "BPE" and made.get("post_processor") is None and all(ADDED in x and len(x.split()) == 1 for x in added)


def pieces(text: str) -> list[str]:
    """What SPLIT would match, and whole words where they go beyond Latin-1 or may hold an added token."""
    if ADDED not in text and not BEYOND.search(text):
        return LATIN_SPLIT.findall(text.lower())
    out: list[str] = []
    for w in WORD.findall(text):
        if ADDED not in w and not BEYOND.search(w):
            out += LATIN_SPLIT.findall(w.lower())
        else:
            out.append(w)
    return out


class _Ids(dict):
    """Ids of texts as bytes; remembers those of pieces where the tokenizer allows it."""

    def __init__(self, content: str, dtype: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.dtype, self.apart = Tokenizer.from_str(content), dtype, _in_pieces(content)
        self.model, self.form = self.tokenizer.model, dtype[0] + "%d" + {"u2": "H", "u4": "I"}[dtype[1:]]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KNOWN_PIECES:
            self.clear()
        if ADDED in piece or BEYOND.search(piece):
            value = self.encoded(piece)
        else:  # already normalised and one match of SPLIT: only the model's merges are left
            found = self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_LEVEL))
            value = struct.pack(self.form % len(found), *[t.id for t in found])
        self[piece] = value
        return value

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype).tobytes()

    def of(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            yield b"".join(map(self.__getitem__, pieces(t))) if self.apart else self.encoded(t)


def write_tokens(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> TokenFiles:
    """Encode every whole text (null: empty), append ``end_id`` and write shards under ``path``.

    Ids are ascending, nulls first; rows that share an id keep an order of their
    own (by a hash of the text). ``vocabulary`` is a tokenizers JSON file, sent to
    the executors as text. An empty table gives no shards.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    dtype = "<u2" if max(Tokenizer.from_str(content).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    path = path or scratch_dir(spark)
    box = spark.sparkContext.broadcast(content)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = (hashlib.sha256(box.value.encode()).hexdigest(), dtype)
        if key not in _known:
            _known.clear()
            _known[key] = _Ids(box.value, dtype)
        ids = _known[key]
        end, wide = np.array([end_id], dtype=dtype).tobytes(), np.dtype(dtype).itemsize
        fs, root = _open_fs(path)
        fs.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
        lengths: list[int] = []
        keys: list[int] = []
        out = None
        for b in batches:
            out = out or fs.open_output_stream(f"{root}/{name}.bin")
            keys += b.column(0).to_pylist()
            for made in ids.of(b.column(1).to_pylist()):
                out.write(made + end)
                lengths.append(len(made) // wide + 1)
        if out is None:
            return
        out.close()
        offsets = np.zeros(len(lengths) + 1, dtype="<u8")
        np.cumsum(lengths, out=offsets[1:])
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(offsets.tobytes())
        with fs.open_output_stream(f"{root}/{name}.ids") as f:
            f.write(np.array([np.iinfo(np.int64).min if k is None else k for k in keys], dtype="<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([int(name[:8])], pa.int32()), "name": [name], "docs": [len(keys)], "ids": [int(offsets[-1])]})

    found = sorted(tuple(r) for r in rows.mapInArrow(run, "part int, name string, docs long, ids long").collect())
    base, listed = 0, []
    for _, name, n_docs, n_ids in found:
        listed.append((name, n_docs, n_ids, base))
        base += n_ids
    fs, root = _open_fs(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/shards.json") as f:
        f.write(json.dumps({"dtype": dtype, "end_id": end_id, "shards": listed}).encode())
    return TokenFiles(path, dtype, listed)


def _mapped(fs, root: str, name: str, dtype: str, keep: list) -> np.ndarray:
    """A shard's array, memory-mapped; from a remote store by way of a temporary copy."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", dtype=dtype, mode="r")
    folder = tempfile.mkdtemp()
    keep.append(folder)
    pafs.copy_files(f"{root}/{name}", f"{folder}/{name}", source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
    return np.memmap(f"{folder}/{name}", dtype=dtype, mode="r")


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the mapped files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files.shards:
        return spark.createDataFrame([], schema)
    path, dtype = files.path, files.dtype
    listed = spark.createDataFrame([(s[0], s[3]) for s in files.shards], "name string, base long").repartition(len(files.shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(path)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keep: list[str] = []
                ids, offsets, keys = _mapped(fs, root, f"{name}.bin", dtype, keep), _mapped(fs, root, f"{name}.idx", "<u8", keep), _mapped(fs, root, f"{name}.ids", "<i8", keep)
                o = offsets.astype(np.int64)
                sums = [zlib.crc32(ids[o[k] : o[k + 1]].astype("<u4").tobytes()) for k in range(len(keys))]
                k64 = np.array(keys)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(k64, mask=k64 == np.iinfo(np.int64).min), "start": pa.array(base + o[:-1]), "n_tokens": pa.array(np.diff(o)), "ids_crc32": pa.array(np.array(sums, dtype=np.int64))})
                for folder in keep:
                    shutil.rmtree(folder, ignore_errors=True)

    return listed.mapInArrow(run, schema)
