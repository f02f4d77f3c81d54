"""Token ids packed into matrix rows: best-fit decreasing with a segment tree over capacities.

A task encodes its texts and packs them window by window; nothing is shuffled and no other task
is asked. Each row of a matrix is one sequence: its ids, the cumulative lengths of its segments
and the places where positions start again. Nothing is lost: a long document becomes several
segments that say where they start, and every token can be put back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .byte_bpe import END_ID, default_json, default_ranks, encode
from .common import prepare

#: Tokens of a sequence, one matrix row.
WIDTH = 2048
#: Tokens that a task holds before it packs them.
WINDOW_TOKENS = 8 << 20


class CapacityTree:
    """Open bins by free capacity; each node knows how many are below it.

    ``take(size)`` gives a bin with the least free capacity that holds size, or None.
    """

    def __init__(self, width: int) -> None:
        self.leaves = 1 << int(width).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, free: int, change: int) -> None:
        at = free + self.leaves
        while at:
            self.count[at] += change
            at >>= 1

    def put(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        self._add(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(free capacity, bin), taken out of the tree."""
        at = size + self.leaves
        while not self.count[at]:
            while at & 1:  # up while it is a right child
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.leaves
        self._add(free, -1)
        return free, self.bins[free].pop()


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Bins of positions in sizes: larger sizes first, ties in order, each into the tightest bin."""
    tree, bins = CapacityTree(width), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            found = width, len(bins)
            bins.append([])
        free, bin_ = found
        bins[bin_].append(i)
        if free > sizes[i]:
            tree.put(free - sizes[i], bin_)
    return bins


def segments(length: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of a document's segments: whole rows, and what is left."""
    return [(s, min(width, length - s)) for s in range(0, length, width)]


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions of a row's tokens, which start at 0 in every segment."""
    cu = np.asarray(cu_seqlens)
    return np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))


def _fields(doc_id: pa.DataType) -> list[tuple[str, pa.DataType]]:
    """The columns of packed rows, for documents with ids of a type."""
    ints = pa.list_(pa.int32())
    return [("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", ints), ("position_resets", ints), ("doc_ids", pa.list_(doc_id)), ("starts", pa.list_(pa.int64()))]


def packed_ids(docs: DataFrame, width: int = WIDTH, window_tokens: int = WINDOW_TOKENS, ranks: str | None = None, json: str | None = None) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids, cu_seqlens, position_resets, doc_ids, starts.

    ids is a matrix row, little-endian unsigned 16-bit ids (the vocabulary has fewer than 65,536),
    ``width`` of them, filled up with the end id behind n_tokens. A document is its ids and the
    end id; a null or empty text is the end id alone. Segment k is ids[cu_seqlens[k] :
    cu_seqlens[k + 1]] and stands at starts[k] of document doc_ids[k]. Repeated rows are packed
    each; doc_ids are of doc_id's type, a null one stays null; an empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    ranks, json = ranks or default_ranks(), json or default_json()

    def pack(held: list[tuple], first: int, fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
        bins = best_fit_decreasing([len(x[2]) for x in held], width)
        out = []
        for k, members in enumerate(bins):
            row = np.full(width, END_ID, dtype="<u2")
            cu = [0]
            for i in members:
                ids = held[i][2]
                row[cu[-1] : cu[-1] + len(ids)] = ids
                cu.append(cu[-1] + len(ids))
            out.append((first + k, cu[-1], row.tobytes(), cu, cu[:-1], [held[i][0] for i in members], [held[i][1] for i in members]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # a document's id, where a segment starts in it, the segment's ids
        tokens, next_id, fields = 0, TaskContext.get().partitionId() << 33, None
        for batch in batches:
            fields = _fields(batch.column(0).type)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text, ranks, json), END_ID).astype("<u2")
                held += [(doc_id, s, ids[s : s + n]) for s, n in segments(len(ids), width)]
                tokens += len(ids)
            if tokens >= window_tokens:
                made = pack(held, next_id, fields)
                next_id += made.num_rows
                held, tokens = [], 0
                for at in range(0, made.num_rows, 1024):
                    yield made.slice(at, 1024)
        if held:
            made = pack(held, next_id, fields)
            for at in range(0, made.num_rows, 1024):
                yield made.slice(at, 1024)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, starts array<long>")


def write_packed(docs: DataFrame, path: str, width: int = WIDTH) -> None:
    """Write the matrices: Parquet whose ids column, put end to end, is a matrix of whole rows."""
    packed_ids(docs, width).write.parquet(path)


def matrix(rows: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The id matrix of packed rows."""
    return np.frombuffer(b"".join(rows), dtype="<u2").reshape(-1, width)
