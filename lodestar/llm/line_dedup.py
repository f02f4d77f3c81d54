"""Line deduplication that can be undone: exact reference counts behind sharded cuckoo filters.

The count table has one row for each line key with the number of documents that hold it. A key
at or over the threshold is common; each shard of the common keys has a cuckoo filter, which
tells most lines apart without a join. What a filter lets through is settled by the table, so
results are exact. Documents come and go: their counts are added or taken away, keys that cross
the threshold enter or leave their filter, and a line whose key is no longer common is back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WHITE, attach, fresh, prepare, slices, stable, utf8, with_fields

#: Documents that hold a line before it is common.
THRESHOLD = 10
#: Least code points of a key; shorter keys (blank lines) are never dropped.
MIN_CHARS = 1
#: Keys that a filter shard is made for.
SHARD_KEYS = 1 << 16
#: Filters are broadcast up to so many bytes together; beyond it every line goes to the exact join.
BROADCAST_BYTES = 64 << 20
_SLOTS, _KICKS = 4, 500


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets, each found from the other."""

    def __init__(self, capacity: int, table: np.ndarray | None = None) -> None:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / _SLOTS / 0.8))))
        self.table = np.zeros((buckets, _SLOTS), dtype=np.uint16) if table is None else table

    @staticmethod
    def from_bytes(data: bytes) -> CuckooFilter:
        return CuckooFilter(0, np.frombuffer(data, dtype=np.uint16).reshape(-1, _SLOTS).copy())

    @staticmethod
    def of(keys: np.ndarray) -> CuckooFilter:
        """A filter of these keys, with twice the room as long as they don't fit."""
        room = len(keys)
        while not (made := CuckooFilter(room)).insert(keys):
            room *= 2
        return made

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys, which are rows of two 64-bit halves."""
        mask = np.uint64(len(self.table) - 1)
        print_ = (keys[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = keys[:, 0] & mask
        return print_, first, first ^ self._jump(print_)

    def _jump(self, print_: np.ndarray) -> np.ndarray:
        return (print_.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in; never false for one that is."""
        print_, a, b = self._places(keys)
        return ((self.table[a] == print_[:, None]) | (self.table[b] == print_[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Put keys in; false if there was no room, and then the filter has to be made anew."""
        rng = np.random.default_rng(0)
        for f, a, b in zip(*self._places(keys), strict=True):
            at = a if (self.table[a] == 0).any() else b
            for _ in range(_KICKS):
                row = self.table[at]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = f
                    break
                i = rng.integers(_SLOTS)
                f, row[i] = row[i], f
                at = at ^ self._jump(np.array([f]))[0]
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were put in."""
        for f, a, b in zip(*self._places(keys), strict=True):
            for at in (a, b):
                found = np.flatnonzero(self.table[at] == f)
                if len(found):
                    self.table[at][found[0]] = 0
                    break


def halves(keys: list[bytes]) -> np.ndarray:
    """16-byte keys as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)


def line_key(line: bytes) -> bytes:
    """White space off both ends, A-Z in lower case."""
    return line.strip(WHITE).translate(LOWER)


def _digest(key: bytes) -> bytes:
    from hashlib import blake2b

    return blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode(errors="replace")) >= min_chars)


def text_keys(data: bytes | None, min_chars: int = MIN_CHARS) -> list[bytes]:
    """Digests of a text's distinct keys."""
    return [_digest(k) for k in {line_key(x) for x in (data or b"").split(b"\n")} if _long_enough(k, min_chars)]


def shard_of(key: str, shards: int) -> F.Column:
    """The shard of a key, by its first 15 hexadecimal digits."""
    return F.pmod(F.conv(F.substring(F.hex(key), 1, 15), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _shards_of(keys: list[bytes], shards: int) -> np.ndarray:
    """The same in Python."""
    return (halves(keys)[:, 0].byteswap() >> np.uint64(4)) % np.uint64(shards)


@dataclass
class LineIndex:
    """counts: key, n. filters: shard, keys, data. A value; ``updated`` returns the next one."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    threshold: int
    min_chars: int
    shard_keys: int = SHARD_KEYS

    @staticmethod
    def build(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        """Count the lines of docs; a row is a document, so repeated rows count each."""
        counts = stable(key_counts(docs, min_chars))
        common = counts.where(F.col("n") >= threshold)
        shards = max(1, -(-common.count() // shard_keys))
        filters = stable(_filters(common, shards))
        return LineIndex(counts, filters, shards, threshold, min_chars, shard_keys)

    def updated(self, docs: DataFrame, sign: int) -> LineIndex:
        """The index with docs inserted (sign 1) or deleted (sign -1); deleted texts as they were inserted.

        A deletion that takes more from a key than was ever put in is refused with a ValueError.
        """
        delta = key_counts(docs, self.min_chars).select("key", (F.col("n") * sign).alias("d"))
        both = stable(self.counts.join(delta, "key", "full").select("key", F.coalesce("n", F.lit(0)).alias("was"), (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n")))
        if sign < 0 and both.where("n < 0").limit(1).count():
            raise ValueError("documents to delete hold lines that were not inserted as often")
        counts = both.where("n > 0").select("key", "n")
        t, shards = self.threshold, self.shards
        crossed = both.where((F.col("was") >= t) != (F.col("n") >= t)).select("key", (F.col("n") >= t).alias("enters"), shard_of("key", shards).alias("shard"))

        def change(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            n = int(old["keys"].iloc[0]) if len(old) else 0
            made = CuckooFilter.from_bytes(old["data"].iloc[0]) if len(old) else CuckooFilter(len(keys))
            fits = True
            if len(keys):
                shard = int(keys["shard"].iloc[0])
                into, out = keys.loc[keys["enters"], "key"], keys.loc[~keys["enters"], "key"]
                made.delete(halves(list(out)))
                fits = made.insert(halves(list(into)))
                n += len(into) - len(out)
            else:
                shard = int(old["shard"].iloc[0])
            return pd.DataFrame({"shard": [shard], "keys": [n], "data": [made.to_bytes() if fits else None]})

        changed = stable(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(change, "shard int, keys long, data binary"))
        if changed.where("data is null").limit(1).count():  # a shard is full: make all of them anew, with room
            common = counts.where(F.col("n") >= t)
            shards = max(1, -(-common.count() // self.shard_keys))
            changed = stable(_filters(common, shards))
        return LineIndex(counts, changed, shards, t, self.min_chars, self.shard_keys)

    def inserted(self, docs: DataFrame) -> LineIndex:
        return self.updated(docs, 1)

    def deleted(self, docs: DataFrame) -> LineIndex:
        return self.updated(docs, -1)

    def common(self) -> DataFrame:
        """(key) of the lines that go."""
        return self.counts.where(F.col("n") >= self.threshold).select("key")

    def save(self, path: str) -> None:
        """Write the index under a path of any store, for a later session."""
        head = self.counts.sparkSession.createDataFrame([(self.shards, self.threshold, self.min_chars, self.shard_keys)], "shards int, threshold int, min_chars int, shard_keys int")
        for name, df in (("counts", self.counts), ("filters", self.filters), ("index", head)):
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LineIndex:
        """The index that was saved under path."""
        head = spark.read.parquet(f"{path}/index").first()
        return LineIndex(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/filters"), head["shards"], head["threshold"], head["min_chars"], head["shard_keys"])

    def broadcast_filters(self, bound: int = BROADCAST_BYTES) -> Broadcast | None:
        """The filters by shard, or None if they are larger than bound together."""
        size = self.filters.agg(F.sum(F.length("data"))).first()[0] or 0
        if size > bound:
            return None
        return self.filters.sparkSession.sparkContext.broadcast({r["shard"]: CuckooFilter.from_bytes(r["data"]) for r in self.filters.collect()})

    def broadcast_common(self, bound: int = BROADCAST_BYTES) -> Broadcast | None:
        """The exact common keys in order, or None if they are larger than bound together."""
        common = self.common()
        if common.count() * 16 > bound:
            return None
        keys = np.array(common.toArrow().column("key").to_pylist(), dtype="S16")
        return self.counts.sparkSession.sparkContext.broadcast(np.sort(keys))


def _may_be_common(filters: dict[int, CuckooFilter], keys: list[bytes], shards: int) -> np.ndarray:
    """Which keys their shard's filter lets through."""
    found = halves(keys)
    shard = _shards_of(keys, shards)
    maybe = np.zeros(len(found), dtype=bool)
    for s in np.unique(shard).tolist():
        if s in filters:
            at = shard == s
            maybe[at] = filters[s].contains(found[at])
    return maybe


def _row_key() -> F.Column:
    return F.xxhash64("doc_id", "text")


def key_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, n): the rows of docs that hold a key. Counts are summed before they are shuffled."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                keys = [k for data in utf8(part.column(0)) for k in text_keys(data, min_chars)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    return docs.select("text").mapInArrow(run, "key binary").groupBy("key").agg(F.count("*").alias("n"))


def _filters(common: DataFrame, shards: int) -> DataFrame:
    def make(group: pd.DataFrame) -> pd.DataFrame:
        keys = halves(sorted(group["key"]))
        made = CuckooFilter.of(keys)
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "keys": [len(keys)], "data": [made.to_bytes()]})

    return common.select("key", shard_of("key", shards).alias("shard")).groupBy("shard").applyInPandas(make, "shard int, keys long, data binary")


def _candidates(docs: DataFrame, index: LineIndex, filters: Broadcast | None) -> DataFrame:
    """(row, key) of the distinct keys of each row of docs that the filters let through, all keys without filters."""
    min_chars, shards = index.min_chars, index.shards

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                rows, out = [], []
                for r, data in zip(part.column(1).to_pylist(), utf8(part.column(0)), strict=True):
                    found = text_keys(data, min_chars)
                    rows += [r] * len(found)
                    out += found
                whole = pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(out, pa.binary())], names=["row", "key"])
                yield whole.filter(pa.array(_may_be_common(filters.value, out, shards))) if filters and out else whole

    return docs.select("text", _row_key().alias("row")).mapInArrow(keys, "row long, key binary")


def common_lines(docs: DataFrame, index: LineIndex, filters: Broadcast | None) -> DataFrame:
    """(row, keys) for rows of docs with common lines: hash of the row's id and text, its common keys."""
    return _candidates(docs, index, filters).join(index.common(), "key").groupBy("row").agg(F.collect_set("key").alias("keys"))


def _among(keys: np.ndarray, sought: list[bytes]) -> np.ndarray:
    """Which sought keys are in the ordered keys."""
    if not len(keys):
        return np.zeros(len(sought), dtype=bool)
    values = np.array(sought, dtype="S16")
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _drop(text: bytes | None, gone: Callable[[list[bytes]], np.ndarray], min_chars: int) -> tuple[int, int, bytes]:
    """Lines of a text, how many of them go, and what stays."""
    lines = (text or b"").split(b"\n")
    held = [line_key(x) for x in lines]
    at = [i for i, k in enumerate(held) if _long_enough(k, min_chars)]
    if not at:
        return len(lines), 0, text or b""
    goes = np.zeros(len(lines), dtype=bool)
    goes[at] = gone([_digest(held[i]) for i in at])
    left = [x for x, g in zip(lines, goes.tolist(), strict=True) if not g]
    return len(lines), len(lines) - len(left), b"\n".join(left)


def _cut(docs: DataFrame, index: LineIndex, bound: int = BROADCAST_BYTES) -> tuple[DataFrame, list[str]]:
    """docs and n_lines, n_dropped, kept text, and those names.

    Filters and exact common keys are broadcast while each is ``bound`` bytes at most: then a row
    is cut where it is, and no text moves. Beyond that, rows whose lines all fail the filters stay
    where they are, and the others meet their common keys by the hash of their id and text, so
    that copies of a text are spread. Keys found by another row's equal hash are common too, so no
    line goes that should stay. Filters beyond the bound are not used, and every row is joined.
    """
    prepare(docs.sparkSession)
    names = fresh(docs, "n_lines", "n_dropped", "kept_text", "_row", "_keys")
    n_lines, n_dropped, kept, row, keys = names
    at, width, min_chars, shards = docs.columns.index("text"), len(docs.columns), index.min_chars, index.shards
    schema = with_fields(docs.schema, (n_lines, T.LongType()), (n_dropped, T.LongType()), (kept, T.StringType()))
    filters = index.broadcast_filters(bound)
    exact = index.broadcast_common(bound) if filters else None

    def settled(found: list[bytes]) -> np.ndarray:
        maybe = _may_be_common(filters.value, found, shards)
        if maybe.any():
            maybe[maybe] = _among(exact.value, [k for k, m in zip(found, maybe.tolist(), strict=True) if m])
        return maybe

    def cut(own: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, at):
                    drops = part.column(width).to_pylist() if own else [None] * part.num_rows
                    rows = []
                    for data, drop in zip(utf8(part.column(at)), drops, strict=True):
                        gone = set(drop or ())
                        rows.append(_drop(data, (lambda found, gone=gone: np.array([k in gone for k in found])) if own else settled, min_chars))
                    out = pa.RecordBatch.from_arrays(part.columns[:width], names=part.schema.names[:width])
                    a, b, c = zip(*rows, strict=True)
                    yield attach(out, {n_lines: pa.array(a, pa.int64()), n_dropped: pa.array(b, pa.int64()), kept: pa.array(c, pa.binary()).cast(pa.string())})

        return run

    if exact:
        return docs.mapInArrow(cut(own=False), schema), names[:3]
    found = common_lines(docs, index, filters).select(F.col("row").alias(row), F.col("keys").alias(keys))
    some, none = docs, None
    if filters:
        marked, name = _marked(docs, filters, min_chars, shards)
        some, none = marked.where(name).drop(name), marked.where(~F.col(name)).drop(name).withColumn(keys, F.lit(None).cast("array<binary>"))
    joined = some.withColumn(row, _row_key()).join(found, row, "left").select(*docs.columns, keys)
    return (joined.union(none) if filters else joined).mapInArrow(cut(own=True), schema), names[:3]


def _marked(docs: DataFrame, filters: Broadcast, min_chars: int, shards: int) -> tuple[DataFrame, str]:
    """docs and whether any line of a row passes the filters, and that column's name."""
    (name,) = fresh(docs, "_some")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                keys = [text_keys(data, min_chars) for data in utf8(part.column(at))]
                yield attach(part, {name: pa.array([bool(k) and bool(_may_be_common(filters.value, k, shards).any()) for k in keys], pa.bool_())})

    return docs.mapInArrow(run, with_fields(docs.schema, (name, T.BooleanType()))), name


def line_dedup(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_sha256.

    A null or empty text is one empty line, which stays. A repeated row is a document of its
    own. Null doc_ids stay null, an empty table gives no rows, other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    rows, (n_lines, n_dropped, kept) = _cut(docs, index or LineIndex.build(docs))
    return rows.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


def drop_common_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """docs without its common lines, in docs' own columns. Rows stay, even if no line is left;
    a text that loses nothing stays as it is, null too."""
    rows, (_, n_dropped, kept) = _cut(docs, index or LineIndex.build(docs))
    text = F.when(F.col(n_dropped) > 0, F.col(kept)).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*docs.columns)
