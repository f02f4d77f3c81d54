"""Resampling of a corpus towards a target's distribution of hashed word runs.

Counts of documents by buckets are a sparse matrix, kept as blocks of compressed sparse rows in the
shared folder. Its column sums are the corpus's distribution; the product of the matrix with the
buckets' gains gives every document's weight. Neither needs a shuffle of counts: a task adds up
the columns of its blocks, and gains are one number a bucket. What is drawn are the highest
weights after Gumbel noise that a seed and the document's id decide.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import removed, written
from .common import prepare, slices, utf8
from .ranking import ranked

#: Buckets of features, words in the longest run that is a feature, and what is added to each bucket in the ratio of distributions.
BUCKETS, RUN, SMOOTHING = 10_000, 1, 1
#: Words that a document has at least to be drawn, per cent that is drawn, seed of the noise.
LEAST_WORDS, PER_CENT, SEED = 20, 10, 2024
#: A gain or weight of one is a thousandth of a natural logarithm.
UNIT = 1000
#: Bytes of text in a block of the matrix, one document at least, and in a piece whose words are held at once.
BLOCK_BYTES, PIECE = 4 << 20, 1 << 20

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, a-z and non-ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLOCKS = "ids {kind}, words array<int>, starts array<int>, buckets array<int>, counts array<int>"


def bucket_counts(text: bytes, buckets: int = BUCKETS, run: int = RUN, piece: int = PIECE) -> tuple[int, dict[int, int]]:
    """Words of a text, and how often each bucket has a run of 1 to ``run`` of them. A long text is
    taken piece by piece, cut between words; runs over a cut are kept."""
    folded, n, found, tail, at = text.translate(_FOLD), 0, Counter(), [], 0
    while at < len(folded):
        end = folded.find(b" ", at + piece)
        words = folded[at : end if end >= 0 else len(folded)].split()
        at = end if end >= 0 else len(folded)
        n += len(words)
        found.update(words)
        for size in range(2, run + 1):
            line = tail[len(tail) - min(len(tail), size - 1) :] + words
            found.update(b" ".join(line[i : i + size]) for i in range(len(line) - size + 1))
        tail = (tail + words)[-(run - 1) :] if run > 1 else []
    out: dict[int, int] = {}
    for feature, times in found.items():
        b = zlib.crc32(feature) % buckets
        out[b] = out.get(b, 0) + times
    return n, out


@dataclass
class CountMatrix:
    """A block is ids, words (of each row), starts (where rows begin in buckets and counts, and the end), buckets, counts.

    Entry b of the matrix's row i is how many of document i's runs fall into bucket b.
    """

    blocks: DataFrame
    buckets: int

    @staticmethod
    def of(rows: DataFrame, id_col: str, text: str, buckets: int = BUCKETS, run: int = RUN, name: str = "counts") -> CountMatrix:
        """The matrix of rows as a table in the shared folder: one narrow pass over the texts."""
        prepare(rows.sparkSession)
        kind = dict(rows.dtypes)[id_col]
        found = rows.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_blocks_of(buckets, run), _BLOCKS.format(kind=f"array<{kind}>"))
        return CountMatrix(written(found, name), buckets)

    def column_sums(self) -> np.ndarray:
        """How many runs of all documents fall into each bucket: one number a bucket comes to the driver."""
        found = self.blocks.select("buckets", "counts").mapInArrow(_sums(self.buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(self.buckets, dtype=np.int64)
        for r in found:
            out[r["bucket"]] = r["n"]
        return out

    def product(self, gains: np.ndarray) -> DataFrame:
        """(id, n_words, n_features, total): each row's features and the sum of their buckets' gains."""
        shared = self.blocks.sparkSession.sparkContext.broadcast(gains.astype(np.int64))
        kind = dict(self.blocks.dtypes)["ids"][len("array<") : -1]
        return self.blocks.mapInArrow(_product(shared), f"id {kind}, n_words long, n_features long, total long")


def _blocks_of(buckets: int, run: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, BLOCK_BYTES):
                words, starts, columns, counts = [], [0], [], []
                for text in utf8(batch.column(1)):
                    n, found = bucket_counts(text or b"", buckets, run)
                    keys = sorted(found)
                    words.append(n)
                    columns.extend(keys)
                    counts.extend(found[k] for k in keys)
                    starts.append(len(columns))
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int32()))
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch.column(0)]))
                yield pa.RecordBatch.from_arrays([ids, one(words), one(starts), one(columns), one(counts)], names=["ids", "words", "starts", "buckets", "counts"])

    return of


def _sums(buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            columns, counts = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            np.add.at(total, columns, counts.astype(np.int64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return of


def _product(shared: Broadcast):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids = one.column(0).flatten()
                words, starts, columns, counts = (one.column(k).flatten().to_numpy().astype(np.int64) for k in range(1, 5))
                upto = np.concatenate([[0], np.cumsum(counts * gains[columns])])  # a row's sum is a difference of two
                size = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(size[starts[1:]] - size[starts[:-1]]), pa.array(upto[starts[1:]] - upto[starts[:-1]])], names=["id", "n_words", "n_features", "total"])

    return of


def gains(target: np.ndarray, corpus: np.ndarray, smoothing: int = SMOOTHING) -> np.ndarray:
    """Logarithm of how much likelier a bucket is in the target, in whole units, rounded down."""
    t, s = target.astype(np.float64), corpus.astype(np.float64)
    added = float(smoothing * len(t))
    ratio = (t + smoothing) * (s.sum() + added) / ((s + smoothing) * (t.sum() + added))
    return np.array([math.floor(UNIT * math.log(r)) for r in ratio], dtype=np.int64)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole units, of the seed and the id alone; a null id counts as an empty text."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    return F.floor(-F.lit(float(UNIT)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED, target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): a document's weight is the mean gain of its features."""
    corpus = CountMatrix.of(docs, "doc_id", "text", buckets, run)
    wanted = CountMatrix.of(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), "id", "text", buckets, run, "target")
    found = gains(wanted.column_sums(), corpus.column_sums())
    removed(wanted.blocks)
    weight = F.when(F.col("n_features") > 0, F.expr("CASE WHEN total < 0 AND total % n_features <> 0 THEN total div n_features - 1 ELSE total div n_features END")).otherwise(F.lit(0)).cast("long")
    rows = corpus.product(found).select(F.col("id").alias("doc_id"), "n_words", "n_features", weight.alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resampled(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank; rank is null where nothing is drawn.

    Of the documents with ``least_words`` words or more, ``per_cent`` per cent (rounded down) with the
    highest scores are drawn, ties to the smaller doc_id; rank counts them from 1. A null text
    has no features and weight 0, a null doc_id has noise of its own and stands behind all others of
    its score, repeated rows are drawn each on its own, texts of any length are counted whole, an
    empty table gives no rows, and against an empty target all gains come from the smoothing.
    Other columns are not read.
    """
    scored = importance_weights(docs, target, buckets, run, seed).withColumn("_able", F.col("n_words") >= least_words)
    group = F.when(F.col("_able"), "1").otherwise("0")
    keys = scored.withColumns({"_group": group, "_score": -F.col("score"), "_null": F.col("doc_id").isNull()})
    placed = ranked(keys, ["_score", "_null", "doc_id"], "_group", "scores")
    rank = F.when(F.col("_able") & (F.col("pos") < F.floor(F.lit(per_cent) * F.col("size") / 100)), F.col("pos") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
