"""MinHash near-dedup: fast similarity sketching, banding, exact verification, components.

Texts with the same shingle set are one node from the start. A node's sketch has
T coordinates; bands of coordinates put nodes that may be similar into one bucket.
Two pivot rounds verify one pair a node against a pivot of one of its buckets and
contract what links. Buckets that still hold several components are then settled
exactly: a small one by its pairs across components, a large one by the prefixes of
its members' sets (two sets that reach the similarity share one of their rarest
shingles), so that no bucket lists the pairs of what is linked or of what shares
only frequent shingles. Pairs are left out before verification by exact bounds only
(sizes; bits in which the maps of two sets differ), so no link between candidates is
lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import Scratch, mix, shingle_hashes, utf8, word_hashes

#: Coordinates, and the chance with which a pair at the threshold may share no band.
T, MISS = 120, 1e-6
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 85
#: 64-bit words of a set's map: a bit is on where an odd number of the set's values hash to it.
MAP_WORDS = 16
#: Parts into which a group's rows are dealt by id; at most 63, the parts that a group has are bits of one long.
SALTS = 60
#: Members of a bucket up to which its pairs across components are looked at one by one.
SMALL = 24
#: Members of a prefix shingle's group that meet in one block of its pairs.
BLOCK = 200

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def band_rows(percent: int) -> int:
    """Coordinates in a band: the most with which a pair at the threshold is missed with a chance of at most MISS (85: 5, 8e-7; 80: 4, 1e-7)."""
    p = percent / 100
    return max((r for r in range(1, T + 1) if T % r == 0 and (1 - p**r) ** (T // r) <= MISS), default=1)


def sketch(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """Fast similarity sketches, one row a set of distinct 64-bit hashes.

    In round r < t each element falls into a hashed bin; in round t + b all fall
    into bin b. A bin keeps the least (round, value). A set is done after the round
    that leaves no bin empty, at the latest after 2t rounds.
    """
    n = len(sets)
    out = np.full(n * t, _FULL)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate([*sets, np.zeros(0, "<u8")]) if n else np.zeros(0, "<u8")
    for r in range(2 * t):
        if not len(flat):
            break
        h = mix(flat + np.uint64((r * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
        bins = (((h & np.uint64(0xFFFFFFFF)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if r < t else r - t
        np.minimum.at(out, owner * t + bins, (np.uint64(r) << np.uint64(32)) | (h >> np.uint64(32)))
        open_rows = (out.reshape(n, t) == _FULL).any(1)
        keep = open_rows[owner]
        if not keep.all():
            flat, owner = flat[keep], owner[keep]
    return out.reshape(n, t)


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    n, t = sketches.shape
    parts = mix(sketches).reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(t // rows, dtype="<u8") + np.uint64(1), (n, t // rows)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view("<i8")


def maps(sets: list[np.ndarray]) -> np.ndarray:
    """MAP_WORDS 64-bit integers a set; two maps differ in at most as many bits as there are shingles of one set only."""
    width = 64 * MAP_WORDS
    bits = np.zeros((len(sets), width), dtype=np.uint8)
    for row, s in zip(bits, sets, strict=True):
        row[:] = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits, axis=1).view("<i8").reshape(len(sets), MAP_WORDS)


def text_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text)))


def prefix(n: int, percent: int) -> int:
    """How many of a set's n rarest shingles hold one of any set that reaches the similarity with it."""
    return n - -(-percent * n // 100) + 1


def describe(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), bands, map for each row."""
    band = band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [text_set(t) for t in part.column(1).to_pylist()]
                keys = bands(sketch(sets), band)
                n = pa.array([len(s) for s in sets], pa.int64())
                digest = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
                mapped = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * MAP_WORDS + 1, MAP_WORDS), pa.int32()), pa.array(maps(sets).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), n, digest, listed, mapped], names=["doc_id", "n_shingles", "digest", "bands", "map"])

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, map array<long>")


def _set_table(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, v, set (sorted shingle hashes as bytes) of the nodes (node, v, digest); v tells apart the texts of an id that repeats.

    A row that repeats comes as often; the digest leaves out an id's other texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [text_set(t).tobytes() for t in part.column(3).to_pylist()]
                own = [hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(sets, part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], names=["node", "v", "set"]).filter(pa.array(own, pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), utf8().alias("text")).join(nodes.select("node", "v", "digest"), "node")
    return rows.select("node", "v", "digest", "text").mapInArrow(run, "node long, v long, set binary")


def _shingle_rows(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, v, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = np.frombuffer(x, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k)), pa.array(np.full(len(s), v)), pa.array(s)], names=["node", "v", "shingle"])

    return sets.select("node", "v", "set").mapInArrow(run, "node long, v long, shingle long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                u, v = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, comp (least id reachable) of the nodes of an edge list a, b: large and small stars in turn, until a turn changes nothing."""

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = scratch.cut(df.distinct())
        return out, tuple(out.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now, state = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, (now, new) = now, kept(small.filter("a <> b"))
        scratch.drop(before)
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("id"), F.col("b").alias("comp")).groupBy("id").agg(F.min("comp").alias("comp"))


def _able(n: Column, m: Column, x: Column, y: Column, percent: int) -> Column:
    """Whether sets of n and m shingles with maps x and y may reach the similarity: exact bounds, no estimate.

    D shingles of one set only leave a similarity of (n + m - D) / (n + m + D) at most.
    """
    apart = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(MAP_WORDS)), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(7)), F.lit(SALTS)).cast("int")


def _salts() -> Column:
    """The salts that a group has, as bits."""
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")


def _each_salt() -> Column:
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (salts & shiftleft(1L, s)) <> 0)")).alias("salt")


def _pivot_pairs(rows: DataFrame, nodes: DataFrame, percent: int, turn: int) -> DataFrame:
    """a, b: for each node one pair at most, with a pivot of its buckets that has another label.

    ``rows`` has key, node, label, salt. A bucket's members find its pivot by salt, so
    that a hot bucket meets in many tasks.
    """
    order = F.lit(0) if turn == 0 else F.xxhash64("label", F.lit(turn))
    part = rows.groupBy("key", "salt").agg(F.min(F.struct(order.alias("o"), "label", "node")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    whole = part.groupBy("key").agg(F.min("p").alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), _salts()).filter("lo <> hi")
    whole = whole.select("key", F.col("p.node").alias("pivot"), F.col("p.label").alias("to"), _each_salt())
    asked = rows.join(whole, ["key", "salt"]).filter(F.col("label") != F.col("to")).groupBy("node", "pivot").agg(F.count("*").alias("shared"))
    asked = asked.join(nodes.select("node", "n", "map"), "node").join(nodes.select(F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("map").alias("other")), "pivot")
    asked = asked.filter(_able(F.col("n"), F.col("m"), F.col("map"), F.col("other"), percent))
    best = asked.groupBy("node").agg(F.max(F.struct("shared", "pivot")).alias("x"))
    return best.select(F.col("node").alias("a"), F.col("x.pivot").alias("b"))


def _met(left: DataFrame, right: DataFrame, on: list[str], percent: int) -> DataFrame:
    """a, b of the pairs that meet on ``on`` across components and may reach the similarity; both have node, n, map, comp."""
    other = right.select(*on, *[F.col(c).alias(f"{c}_") for c in ("node", "n", "map", "comp")])
    able = (F.col("comp") < F.col("comp_")) & _able(F.col("n"), F.col("n_"), F.col("map"), F.col("map_"), percent)
    return left.join(other, on).filter(able).select(F.greatest("node", "node_").alias("a"), F.least("node", "node_").alias("b"))


def _by_prefix(large: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs across components among the nodes of ``large`` (node, v, n, map, comp) that may reach the similarity.

    Shingles are ordered by the number of these nodes that have them, the rarest first;
    what only one has fills the head of a set's prefix. A shingle that stands in many
    prefixes deals its pairs into blocks.
    """
    rows = _shingle_rows(sets.join(large.select("node"), "node", "left_semi").dropDuplicates(["node", "v"]))
    often = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    known = rows.join(often, "shingle").groupBy("node", "v").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("all"))
    head = F.expr(f"n - cast(ceil({percent} * n / 100) as bigint) + 1 - (n - size(all))")  # prefix(), without what only this set has
    known = known.join(large, ["node", "v"]).withColumn("head", head.cast("int")).filter("head > 0")
    heads = scratch.cut(known.select("node", "n", "map", "comp", F.explode(F.expr("slice(all, 1, head).shingle")).alias("shingle")))
    group = heads.groupBy("shingle").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    heads = heads.join(group.select("shingle", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "shingle")
    left = heads.withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int"))
    right = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _met(left, right, ["shingle", "block"], percent)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Documents link where 100 * intersection >= percent * union of their shingle
    sets; texts without words (null, empty) link with nothing. A text belongs to the
    least id that has it, so rows that repeat an id and are the least with their texts
    are in one group. Rows without an id link with nothing, get a null component and
    are kept. Extra columns are ignored; an empty table gives an empty result. The
    result stands in a table of its own in the scratch folder; all others are deleted.
    """
    scratch = Scratch(docs.sparkSession)
    made = scratch.cut(describe(docs, percent))
    real = made.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).withColumn("salt", _salt("doc_id"))
    same = real.groupBy("digest", "salt").agg(F.min("doc_id").alias("node")).groupBy("digest").agg(F.min("node").alias("node"), _salts())
    same = scratch.cut(same)
    firsts = real.join(same.select(F.col("node").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    firsts = firsts.select(F.col("doc_id").alias("node"), F.crc32("digest").alias("v"), "digest", F.col("n_shingles").alias("n"), "bands", "map")
    rows = firsts.select(F.explode("bands").alias("key"), "node", _salt("node").alias("salt"))
    shared = rows.groupBy("key", "salt").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("members"), _salts()).filter("members > 1")
    members = scratch.cut(rows.join(shared.select("key", "members", _each_salt()), ["key", "salt"]))
    nodes = scratch.cut(firsts.drop("bands").join(members.select("node").distinct(), "node", "left_semi"))
    sets = scratch.cut(_set_table(docs, nodes))

    label = members.withColumn("label", F.col("node"))
    one = scratch.cut(_linked(scratch.cut(_pivot_pairs(label, nodes, percent, 0)), sets, percent))
    label = members.join(one.select(F.col("a").alias("node"), F.col("b").alias("to")).distinct(), "node", "left").withColumn("label", F.coalesce("to", "node")).drop("to")
    label = scratch.cut(label)
    two = scratch.cut(_linked(scratch.cut(_pivot_pairs(label, nodes, percent, 1)), sets, percent))
    scratch.drop(label)
    comp = scratch.cut(components(one.unionByName(two), scratch).withColumnRenamed("id", "node"))

    nodes = nodes.join(comp, "node", "left").select("node", "v", "n", "map", F.coalesce("comp", "node").alias("comp"))
    tied = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ends = tied.groupBy("key", "salt").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), _salts())
    ends = ends.filter("lo <> hi").select("key", _each_salt())
    unsettled = scratch.cut(members.join(ends, ["key", "salt"]).select("key", "node", "members"))
    small = unsettled.filter(F.col("members") <= SMALL).select("key", "node").join(nodes, "node")
    large = scratch.cut(unsettled.filter(F.col("members") > SMALL).select("node").distinct().join(nodes, "node"))
    far = _met(small, small, ["key"], percent).unionByName(_by_prefix(large, sets, percent, scratch)).distinct()
    three = scratch.cut(_linked(scratch.cut(far), sets, percent))

    # The links of the last step join whole components: what is left is their graph.
    ends = comp.select(F.col("node").alias("a"), F.col("comp").alias("x")), comp.select(F.col("node").alias("b"), F.col("comp").alias("y"))
    left = three.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    last = components(left, scratch).select(F.col("id").alias("comp"), F.col("comp").alias("least"))
    groups = same.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(last, "comp", "left")
    groups = groups.select("digest", F.coalesce("least", "comp").alias("component_id"), _each_salt())
    linked = real.select("doc_id", "n_shingles", "digest", "salt").join(groups, ["digest", "salt"]).select("doc_id", "n_shingles", "component_id")
    alone = made.filter(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return scratch.finish(linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
