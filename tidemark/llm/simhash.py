"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming ball.

Two fingerprints that differ in at most r bits have a common point within ceil(r/2) bits of each. So every
distinct fingerprint emits the points of its half-radius ball, the shuffle brings equal points together,
and what meets is verified. For radius 2 that is 65 points, and at most 65 distinct fingerprints can lie
around one point: no bucket grows with the data, however many documents share a fingerprint.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import bounded_batches
from tidemark.llm.graph import components
from tidemark.session import stage

SPACE = re.compile(rb"[\x20\x09-\x0D]")
CHUNK = 1 << 20  # bytes of a text that are split into words at once
BITS = 64


def word_chunks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased (A-Z), a bounded list at a time; a list ends where a word ends."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        if end < len(raw):
            found = SPACE.search(raw, end)
            end = found.start() if found else len(raw)
        yield raw[at:end].lower().split()
        at = end


def shingle_hashes(raw: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all runs of `size` words, repeats included; of the whole sequence if it is shorter."""
    digest, carry, seen = xxhash.xxh64_intdigest, [], False
    for words in word_chunks(raw):
        words = carry + words
        if len(words) >= size:
            seen = True
            runs = zip(*(words[i:] for i in range(size)), strict=False)
            yield np.fromiter((digest(b" ".join(run), 42) for run in runs), np.uint64, len(words) - size + 1)
        carry = words[len(words) - size + 1:] if len(words) >= size else words
    if not seen and carry:
        yield np.array([digest(b" ".join(carry), 42)], np.uint64)


def _mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """The hashes themselves for table 0, an independent-looking mix of them for each further table."""
    if table == 0:
        return hashes
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * table) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _ones(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each run of hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32).astype(np.int64)


def hash_runs(texts: list[bytes | None], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owners, hashes, starts): the hashes of shingles, a bounded number at a time; run i belongs to text owners[i]."""
    owners, parts, held = [], [], 0

    def taken() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(owners), np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts[:-1]])

    for i, raw in enumerate(texts):
        for part in shingle_hashes(raw or b"", size):
            owners.append(i)
            parts.append(part)
            held += len(part)
            if held >= 1 << 16:
                yield taken()
                owners, parts, held = [], [], 0
    if parts:
        yield taken()


def prints_of(texts: list[bytes | None], size: int, tables: int) -> np.ndarray:
    """(texts, tables) fingerprints as signed 64-bit numbers; a text without words has 0."""
    counts = np.zeros((len(texts), tables, BITS), np.int64)
    totals = np.zeros(len(texts), np.int64)
    for owners, hashes, starts in hash_runs(texts, size):
        np.add.at(totals, owners, np.diff(starts, append=len(hashes)))
        for t in range(tables):
            np.add.at(counts[:, t], owners, _ones(_mixed(hashes, t), starts))
    set_bits = (2 * counts > totals[:, None, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=2, bitorder="little").view("<i8")[:, :, 0]


def fingerprints(docs: DataFrame, size: int = 3, tables: int = 1) -> DataFrame:
    """(doc_id, prints array<bigint>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = prints_of(batch.column(1).to_pylist(), size, tables)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(prints) + 1, dtype=np.int32) * tables), pa.array(prints.ravel(), pa.int64())
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "prints"])

    narrow = bounded_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return narrow.mapInArrow(run, "doc_id bigint, prints array<bigint>")


def ball_masks(radius: int) -> list[int]:
    """Bit masks of up to ceil(radius / 2) bits, as signed numbers."""
    half = (radius + 1) // 2
    masks = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(table, a, b) links that connect the distinct values of `fp` in a table that differ in at most `radius` bits.

    The fingerprints around a point are linked to the smallest of them if that is near enough, which for
    an even radius it always is; otherwise, pair by pair of a bounded set.
    """
    points = prints.select("table", "fp", F.explode(F.lit(ball_masks(radius))).alias("mask")).select(
        "table", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point")
    )
    if radius % 2 == 0:
        around = Window.partitionBy("table", "point")
        met = points.select("table", F.min("fp").over(around).alias("a"), F.col("fp").alias("b")).where("a != b")
    else:
        met = points.withColumnRenamed("fp", "a").join(points.withColumnRenamed("fp", "b"), ["table", "point"])
        met = met.where("a < b").select("table", "a", "b")
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_groups(docs: DataFrame, size: int = 3, radius: int = 2, tables: int = 1) -> DataFrame:
    """(doc_id, fingerprint, component_id, class_size) of every row of `docs` (doc_id, text).

    `fingerprint` is that of the first table in 16 lowercase hex digits. Documents are linked when their
    fingerprints of one table differ in at most `radius` bits; component_id is the smallest doc_id
    reachable, class_size the number of rows in the component. More tables find more of the pairs whose
    distance lies around the radius; each is an independent mix of the same shingle hashes.

    Null, empty and blank texts have no shingle and the fingerprint zero, so they are linked with one
    another. Repeated rows stay rows. A row with a null doc_id gets a component_id from the others of its
    component, null if there is none. Other columns of `docs` are not read. No rows in, no rows out.
    """
    rows = stage(fingerprints(docs, size, tables), "prints")
    kinds = rows.groupBy("prints").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"))
    # A set of prints is a node under a hash of its own. In each table, those that share a print are linked
    # to the smallest of them, and near prints through these.
    kinds = stage(kinds.select(F.xxhash64("prints").alias("node"), "prints", "n", "low"), "kinds")
    own = kinds.select("node", F.posexplode("prints").alias("table", "fp"))
    heads = own.groupBy("table", "fp").agg(F.min("node").alias("head"))
    near = ball_links(heads.select("table", "fp"), radius)
    near = near.join(heads.select("table", F.col("fp").alias("a"), F.col("head").alias("x")), ["table", "a"]).join(
        heads.select("table", F.col("fp").alias("b"), F.col("head").alias("y")), ["table", "b"]
    ).select(F.col("x").alias("a"), F.col("y").alias("b"))
    if tables > 1:
        near = near.unionByName(own.join(heads, ["table", "fp"]).where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")))
    links = near
    roots = components(links, "a", "b")
    placed = stage(
        kinds.select("node", "n", "low").join(roots, "node", "left")
        .select("node", "n", "low", F.coalesce("root", "node").alias("root")),
        "placed",
    )
    classes = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("class_size"))
    lookup = placed.select("node", "root").join(classes, "root").drop("root")
    return rows.withColumn("node", F.xxhash64("prints")).join(lookup, "node").select(
        "doc_id",
        F.lower(F.lpad(F.hex(F.col("prints")[0]), 16, "0")).alias("fingerprint"),
        "component_id",
        "class_size",
    )
