"""Near-duplicate records by multi-index hashing with exact verification.

Fingerprint: `SYMBOLS` minhash symbols over the set of n consecutive words. Index: the fingerprint is cut
into segments of `SEGMENT` symbols; around each segment the Hamming ball of radius 1 (over symbols) is
enumerated by its keys with one symbol left open, so two fingerprints meet in a table when any segment
differs in at most one symbol. Matches must then keep the complete Hamming distance over all symbols
(4 bits of each, packed into longs and compared with bit counts inside the join), and the survivors are
verified by the exact Jaccard similarity of their shingle sets.

At Jaccard s a segment of 4 meets with s^4 + 4 s^3 (1 - s): 0.475 at 0.6, so one of 10 with 0.998; the
complete distance of 64 symbols keeps such a pair with 0.9999. Identical shingle sets are one class
before anything is joined. Keys met once are dropped before the join, and hot keys are salted, so no
task holds more than a block of one bucket.

Null columns count as empty; records with fewer than n words have no shingles and are in no pair;
repeated rows of an id count once: the latest, by time, nulls first, and then by a hash of the content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.words import WordHashes, mix, shingle_hashes, words
from folioscope.runtime import cut

SYMBOLS, SEGMENT, INDEXED = 64, 4, 40
#: Rows of one bucket that may meet in one task; larger buckets are salted into blocks of this size.
BLOCK = 2000

_SEEDS = (mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_set(parts: list[str | None], n: int, hashes: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct shingle hashes of the parts joined by blanks."""
    hashes = WordHashes() if hashes is None else hashes
    return np.unique(shingle_hashes(hashes.of(words(" ".join(p or "" for p in parts))), n))


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS minhash values over the upper halves of the hashes; the set must not be empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 4096):
        block = _SEEDS[:, None] * x[None, i : i + 4096]
        block ^= block >> np.uint32(15)
        low = np.minimum(low, block.min(axis=1))
    return mix(low.astype(np.uint64) + (np.arange(SYMBOLS, dtype=np.uint64) << np.uint64(32)))


def ball_keys(fps: np.ndarray) -> np.ndarray:
    """Keys of the radius-1 balls of each fingerprint: per segment, the segment with each of its symbols left open."""
    seg = fps[:, :INDEXED].reshape(len(fps), -1, SEGMENT)
    place = np.arange(seg.shape[1], dtype=np.uint64)
    keys = []
    for gap in range(SEGMENT):
        h = np.broadcast_to(place + np.full(len(place), gap + 1, np.uint64) * np.uint64(0xD6E8FEB86659FD93), seg.shape[:2])
        for j in range(SEGMENT):
            if j != gap:
                h = mix(h ^ seg[:, :, j])
        keys.append(h)
    return np.concatenate(keys, 1).view(np.int64)


def packed(fps: np.ndarray) -> np.ndarray:
    """4 bits of each symbol in SYMBOLS / 16 longs a row."""
    nib = (fps & np.uint64(15)).reshape(len(fps), -1, 16)
    return (nib << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def version_of(texts: list[str]) -> Column:
    """Tells the contents of one id apart."""
    return F.xxhash64(*texts, *[F.col(t).isNull() for t in texts])


def signatures(df: DataFrame, key: str, texts: list[str], order: str | None, n: int) -> DataFrame:
    """(id, at, version, n_shingles, content, f0..f3, keys) of every row; narrow. Rows without any shingle have no keys."""
    at = F.col(order).cast("timestamp") if order else F.lit(None).cast("timestamp")
    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), at.alias("at"), version_of(texts).alias("version"), *[F.col(t).cast("string").alias(f"t{i}") for i, t in enumerate(texts)])
    names = ["id", "at", "version", "n_shingles", "content", *[f"f{i}" for i in range(SYMBOLS // 16)], "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            size, content = np.zeros(b.num_rows, np.int32), []
            fps = np.zeros((b.num_rows, SYMBOLS), np.uint64)
            for i, parts in enumerate(zip(*[b.column(j).to_pylist() for j in range(3, b.num_columns)])):
                s = shingle_set(list(parts), n, hashes)
                size[i] = len(s)
                content.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                if len(s):
                    fps[i] = fingerprint(s)
            f, keys = packed(fps), ball_keys(fps)
            ends = np.concatenate([[0], np.cumsum((size > 0) * keys.shape[1])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[size > 0].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(size), pa.array(content, pa.string()), *[pa.array(np.ascontiguousarray(f[:, j])) for j in range(f.shape[1])], lists], names=names)

    fs = ", ".join(f"f{i} bigint" for i in range(SYMBOLS // 16))
    return src.mapInArrow(run, f"id string, at timestamp, version bigint, n_shingles int, content string, {fs}, keys array<bigint>")


def shingle_table(df: DataFrame, key: str, texts: list[str], n: int) -> DataFrame:
    """(id, shingles array<bigint>) of the given rows."""
    src = df.select(F.col(key).cast("string").alias("id"), *[F.col(t).cast("string").alias(f"t{i}") for i, t in enumerate(texts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(list(p), n, hashes) for p in zip(*[b.column(j).to_pylist() for j in range(1, b.num_columns)])]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "shingles"])

    return src.mapInArrow(run, "id string, shingles array<bigint>")


def differing(a: str, b: str) -> Column:
    """Number of 4-bit symbols in which the packed fingerprints a and b differ."""
    total = None
    for i in range(SYMBOLS // 16):
        x = F.col(f"{a}.f{i}").bitwiseXOR(F.col(f"{b}.f{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = F.bit_count(x) if total is None else total + F.bit_count(x)
    return total


def most_differing(threshold: float) -> int:
    """Complete distance that a pair at the threshold keeps but for four standard deviations."""
    p = threshold + (1 - threshold) / 16
    return SYMBOLS - int(SYMBOLS * p - 4 * (SYMBOLS * p * (1 - p)) ** 0.5)


class NearDuplicates:
    """members(id, class_id) and links(class_a, class_b, jaccard) between class representatives."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links


def near_duplicates(df: DataFrame, key: str, texts: list[str], order: str | None = None, n: int = 5, threshold: float = 0.8) -> NearDuplicates:
    """Classes of equal shingle sets and every verified link between different classes."""
    fs = [f"f{i}" for i in range(SYMBOLS // 16)]
    sig = signatures(df, key, texts, order, n)
    newest = F.struct(F.col("at").isNotNull(), "at", "version")
    latest = sig.groupBy("id").agg(F.max_by(F.struct("version", "n_shingles", "content", *fs, "keys"), newest).alias("s")).select("id", "s.*").where("n_shingles > 0")
    latest = cut(latest)
    reps = latest.groupBy("content").agg(F.min("id").alias("class_id"))
    members = latest.select("id", "content").join(reps, "content").select("id", "class_id")
    rep_sig = latest.join(reps.select(F.col("class_id").alias("id")), "id", "left_semi")

    rows = rep_sig.select(F.explode("keys").alias("k"), "id")
    size = rows.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
    # all keys of a bucket carry its number of blocks; a row of the left side has one salt, of the right all
    met = cut(rows.join(size, "k").select("k", "id", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    packs = rep_sig.select("id", *fs)
    full = met.join(packs, "id")
    left = full.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    right = full.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = (
        left.alias("a")
        .join(right.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.id") < F.col("b.id")) & (differing("a", "b") <= most_differing(threshold)))
        .select(F.col("a.id").alias("class_a"), F.col("b.id").alias("class_b"))
        .distinct()
    )
    near = cut(near)
    # exact verification on the texts of the rows that are in a surviving pair, in the version that was indexed
    need = near.select(F.col("class_a").alias("id")).union(near.select(F.col("class_b").alias("id"))).distinct().join(latest.select("id", "version"), "id")
    texts_of = df.select(F.col(key).cast("string").alias("id"), version_of(texts).alias("version"), *texts).join(need, ["id", "version"], "left_semi").dropDuplicates(["id"])
    sets = shingle_table(texts_of, "id", texts, n)
    pairs = near.join(sets.select(F.col("id").alias("class_a"), F.col("shingles").alias("sa")), "class_a").join(sets.select(F.col("id").alias("class_b"), F.col("shingles").alias("sb")), "class_b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = pairs.select("class_a", "class_b", (common / (F.size("sa") + F.size("sb") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)
    return NearDuplicates(members, links)


def expand_pairs(found: NearDuplicates) -> DataFrame:
    """(a, b) with a < b: all pairs of different ids in linked or equal classes (a result of that form is asked for).

    A class of more than `BLOCK` members is divided into blocks, so that a task makes the pairs of one block
    with the class, however many copies there are.
    """
    links = cut(found.links)
    size = found.members.groupBy("class_id").agg(F.count("*").alias("c"))
    touched = links.select(F.col("class_a").alias("class_id")).union(links.select(F.col("class_b").alias("class_id"))).union(size.where("c > 1").select("class_id")).distinct()
    blocks = size.join(touched, "class_id", "left_semi").select("class_id", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    m = cut(found.members.join(blocks, "class_id"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    one, all_ = m.select("class_id", "id", block), m.select("class_id", "id", every)
    same = one.alias("x").join(all_.alias("y"), (F.col("x.class_id") == F.col("y.class_id")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    # a link meets the blocks of one class, and each of these the blocks of the other
    count = m.select("class_id", "blocks").distinct()
    either = links.join(count.select(F.col("class_id").alias("class_a"), F.col("blocks").alias("na")), "class_a").join(count.select(F.col("class_id").alias("class_b"), F.col("blocks").alias("nb")), "class_b")
    cells = either.select("class_a", "class_b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("block_a"), "nb").select("class_a", "class_b", "block_a", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block_b"))
    across = (
        cells.join(one.select(F.col("class_id").alias("class_a"), F.col("id").alias("p"), F.col("block").alias("block_a")), ["class_a", "block_a"])
        .join(one.select(F.col("class_id").alias("class_b"), F.col("id").alias("q"), F.col("block").alias("block_b")), ["class_b", "block_b"])
        .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    )
    return same.unionByName(across)
