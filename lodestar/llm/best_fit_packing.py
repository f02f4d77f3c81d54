"""Best-fit packing in rounds: tasks pack what they hold, and what stays loose is merged up a tree.

A task puts its pieces best-fit into sequences and lets go of those that are full or nearly so.
Underfull sequences become items themselves: fewer tasks take them, mixed anew, and pack them
best-fit again, round by round. A task never takes more than a set number of items, so a round
that cannot shrink further stays spread out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import default_json, default_ranks, encode
from .common import prepare, stable

#: Tokens of a sequence.
WIDTH = 2048
#: A sequence with at most so many tokens left is full and leaves the rounds.
SLACK = 2
#: Tasks that meet in one in the next round, and the most items that a task takes.
FAN_IN, TASK_ITEMS = 8, 100_000
#: Rounds end when one makes fewer than this share of its items go away.
LEAST_GAIN = 0.001


def pieces_of(length: int, width: int) -> list[tuple[int, int]]:
    """(start, length): whole sequences behind a first piece that takes what is over."""
    first = length % width or width
    return [(0, min(first, length)), *((s, width) for s in range(first, length, width))]


def document_pieces(docs: DataFrame, width: int = WIDTH, ranks: str | None = None, json: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row of docs; ids end with id 0."""
    prepare(docs.sparkSession)
    ranks, json = ranks or default_ranks(), json or default_json()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text, ranks, json), 0).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(len(ids), width)):
                    rows.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
                    owner.append(i)
            piece, start, length, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], width: int) -> list[list[int]]:
    """Bins of positions in sizes, which fall: each into the bin with the least room that is enough.

    One bit for every amount of room that some bin has; the lowest bit at or over a size is the fit.
    """
    by_room: list[list[int]] = [[] for _ in range(width + 1)]
    rooms, bins = 0, []
    for i, size in enumerate(sizes):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[bin_].append(i)
        else:
            room, bin_ = width, len(bins)
            bins.append([i])
        room -= size
        if room:
            by_room[room].append(bin_)
            rooms |= 1 << room
    return bins


def _round(items: DataFrame, width: int, slack: int) -> DataFrame:
    """(room, uids, lengths) of the bins that each partition of items makes; items have the same columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        rows["first"] = [u[0] for u in rows["uids"]]
        rows = rows.sort_values(["room", "first"], ignore_index=True)  # an order of its own, however rows came
        uids, lengths = rows["uids"].tolist(), rows["lengths"].tolist()
        bins = best_fit([width - r for r in rows["room"].tolist()], width)
        out = [(np.concatenate([uids[i] for i in b]), np.concatenate([lengths[i] for i in b])) for b in bins]
        for at in range(0, len(out), 4096):
            part = out[at : at + 4096]
            yield pd.DataFrame({"room": [width - int(n.sum()) for _, n in part], "uids": [u for u, _ in part], "lengths": [n for _, n in part]})

    return items.mapInPandas(run, "room int, uids array<long>, lengths array<int>")


def pack(pieces: DataFrame, width: int = WIDTH, slack: int = SLACK, fan_in: int = FAN_IN, task_items: int = TASK_ITEMS) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length): uid distinct, 0 < length <= width.

    Every piece gets a place; offsets of a sequence have no gaps. Whole sequences take no part
    in the rounds.
    """
    full = pieces.where(F.col("length") == width).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.where(F.col("length") < width).select((F.lit(width) - F.col("length")).cast("int").alias("room"), F.array("uid").alias("uids"), F.array(F.col("length").cast("int")).alias("lengths"))
    done = []
    tasks = max(1, items.rdd.getNumPartitions())
    count = None
    while True:
        bins = stable(_round(items, width, slack))
        done.append(bins.where(F.col("room") <= slack))
        items = bins.where(F.col("room") > slack)
        before, count = count, items.count()
        if tasks == 1 or (before is not None and count > before * (1 - LEAST_GAIN)):
            done.append(items)
            break
        tasks = max(-(-tasks // fan_in), -(-count // task_items), 1)
        items = items.repartition(tasks, F.xxhash64(F.element_at("uids", 1), F.lit(tasks)))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                uids, lengths = batch["uids"].tolist(), batch["lengths"].tolist()
                offsets = [np.cumsum(n) - n for n in lengths]
                yield pd.DataFrame({"uid": np.concatenate(uids), "sequence_id": np.repeat([u[0] for u in uids], [len(u) for u in uids]), "offset": np.concatenate(offsets)})

    return full.union(out.mapInPandas(spread, "uid long, sequence_id long, offset long"))


def best_fit_packing(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than ``width`` ids are cut. A null or empty text is one piece with
    id 0. Repeated rows are packed each; a null doc_id stays null; an empty table gives no
    rows; other columns are not read. A sequence is named by its first piece.
    """
    pieces = stable(document_pieces(docs, width)).withColumn("uid", F.monotonically_increasing_id())
    return pieces.join(pack(pieces.select("uid", "length"), width), "uid").drop("uid")
