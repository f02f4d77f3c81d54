"""SimHash near-duplicates: covering locality-sensitive hashing finds every pair in the radius.

A fingerprint has 64 bits. For radius r every bit has a random vector of r + 1 bits, and every
non-zero vector v of r + 1 bits makes a table whose mask holds the bits with an odd product
with v. Differing bits of a pair in the radius are r at most, so some v is orthogonal to all of
them: its mask leaves them out, and the pair meets in that table. No pair can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, attach, fresh, prepare, stable, utf8, with_fields
from .components import components

#: Words of a shingle, its hash's seed, and the bits two fingerprints may differ in.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a bucket that one task compares; larger buckets are dealt in pairs of blocks.
BLOCK = 4096


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's word shingles."""
    words = data.translate(LOWER).split() if data else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def covering_masks(radius: int = RADIUS, parts: int = 1, seed: int = 1) -> list[int]:
    """Masks of 64 bits, as signed numbers, so that any ``radius`` differing bits are outside of one.

    A fingerprint in equal parts has a part with at most radius // parts of them, and each part has
    2 ** (radius // parts + 1) - 1 masks: parts make fewer tables, with fewer bits in a mask.
    """
    near, width = radius // parts, 64 // parts
    vectors = np.random.default_rng(seed).integers(0, 2 ** (near + 1), size=64)
    masks = []
    for part in range(parts):
        for v in range(1, 2 ** (near + 1)):
            mask = sum(1 << i for i in range(part * width, 64 if part == parts - 1 else (part + 1) * width) if (int(vectors[i]) & v).bit_count() & 1)
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, str]:
    """docs and the fingerprint as a signed long, and that column's name."""
    prepare(docs.sparkSession)
    (name,) = fresh(docs, "fingerprint")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(x, shingle) for x in utf8(batch.column(at))], dtype=np.uint64)
            yield attach(batch, {name: pa.array(bits.view(np.int64))})

    return docs.mapInArrow(run, with_fields(docs.schema, (name, T.LongType()))), name


def linked_within(bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions of links that connect what links within the radius connect: a tree for each class.

    A class grows by its frontier; what it has reached is never compared again.
    """
    left = np.arange(len(bits))
    links = []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            near = np.bitwise_count(bits[left] ^ bits[one]) <= radius
            if near.any():
                links += [(one, x) for x in left[near]]
                frontier += left[near].tolist()
                left = left[~near]
    return links


#: A cell is a bucket of a table, or a pair of a large bucket's blocks.
CELL = ["t", "k", "i", "j"]


def cells(prints: DataFrame, masks: list[int], block: int = BLOCK) -> DataFrame:
    """prints, with distinct fp or more columns that tell its rows apart, in every cell it shares with others.

    Buckets of one row go before anything is gathered. A bucket over ``block`` is dealt to tasks
    as pairs of blocks, so no task holds more than two blocks.
    """
    own_columns = prints.columns
    keys = prints.select(*own_columns, F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "k"))
    shared = keys.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(*own_columns), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        keys.join(shared, ["t", "k"])
        .select("t", "k", *own_columns, blocks.alias("blocks"))
        .select("t", "k", *own_columns, own.alias("own"), F.explode(others).alias("other"))
        .select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *own_columns)
    )


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect exactly what pairs of fp within the radius connect.

    prints has distinct fp. Each task returns a tree of links for each cell, never all pairs.
    """
    members = cells(prints, covering_masks(radius), block)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rest):
                last = (rest[CELL] == rest[CELL].iloc[-1]).all(axis=1).to_numpy()
                yield _links(rest[~last], radius)
                rest = rest[last]
        if rest is not None and len(rest):
            yield _links(rest, radius)

    return members.repartition(*CELL).sortWithinPartitions(*CELL, "fp").mapInPandas(compare, "a long, b long").distinct()


def _links(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links of whole cells, whose rows are sorted together."""
    if rows.empty:
        return pd.DataFrame({"a": np.array([], dtype=np.int64), "b": np.array([], dtype=np.int64)})
    values = rows[CELL].to_numpy()
    fps = rows["fp"].to_numpy().astype(np.int64)
    cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rows)]])
    found = []
    two = ends - starts == 2
    a, b = fps[starts[two]], fps[starts[two] + 1]
    near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= radius
    pairs = [np.stack([a[near], b[near]], axis=1)]
    for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
        found += [(fps[s + x], fps[s + y]) for x, y in linked_within(fps[s:e].view(np.uint64), radius)]
    pairs.append(np.array(found, dtype=np.int64).reshape(-1, 2))
    both = np.concatenate(pairs)
    return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def _classes(prints: DataFrame, radius: int, block: int) -> DataFrame:
    """(fp, root) for every fp that has a link."""
    return components(fingerprint_links(prints, radius, block)).select(F.col("node").alias("fp"), F.col("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id.

    component_id is the smallest doc_id that links reach. Texts with equal fingerprints are one
    node, so copies cost no pairs. A null or empty text has fingerprint zero and links as any
    other. A repeated row has the same component; a null doc_id is in its component but is never
    its id, unless all of its ids are null. An empty table gives no rows.
    """
    rows, name = with_fingerprints(docs.select("doc_id", "text"), shingle)
    rows = stable(rows.select("doc_id", F.col(name).alias("fp")))
    prints = stable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = prints.join(_classes(prints.select("fp"), radius, block), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
