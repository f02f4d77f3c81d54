"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words of every text stream through the automaton, which knows at each word the longest
suffix that occurs in some item. A match as long as a window marks its words as hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import attach, fresh, prepare, slices, utf8, with_fields

#: A window: so many consecutive words of an item.
WINDOW = 13
#: Bytes of item texts in one automaton; more items make more automata, each a pass of its own.
BLOCK_BYTES = 1 << 20
#: Spans, items and keys of all hits that are broadcast, at most.
FEW_NUMBERS = 1 << 21

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, a-z and non-ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def fold(data: bytes) -> bytes:
    """The text with words in lower case and a blank for every other byte."""
    return data.translate(_FOLD)


class ItemAutomaton:
    """Generalised suffix automaton over items of words, with the windows that each state ends.

    ``ends[state]`` is the state of the window suffix, and ``short[state]`` the nearest suffix
    state that is a whole item of fewer words than a window; -1 where there is none.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(name, [self.ids.setdefault(w, len(self.ids) + 1) for w in fold(text).split()]) for name, text in items]
        for _, words in texts:
            last = 0
            for t in words:
                last = self._extend(last, t)
        self._mark(texts)

    def _extend(self, last: int, t: int) -> int:
        known = self.next[last].get(t)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, t, known)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, t, q)
        return new

    def _clone(self, p: int, t: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(t) == q:
            self.next[p][t] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _mark(self, texts: list[tuple[str, list[int]]]) -> None:
        n, size = self.window, len(self.next)
        self.ends, self.short = [-1] * size, [-1] * size
        self.items_of: dict[int, set[str]] = {}
        whole: dict[int, set[str]] = {}
        for name, words in texts:
            if 0 < len(words) < n:
                state = 0
                for t in words:
                    state = self.next[state][t]
                whole.setdefault(state, set()).add(name)
        for v in sorted(range(1, size), key=self.length.__getitem__):  # links lead to shorter states
            up = self.link[v]
            if self.length[v] >= n:
                self.ends[v] = v if self.length[up] < n else self.ends[up]
            self.short[v] = v if v in whole else self.short[up] if up > 0 else -1
        for name, words in texts:
            state = 0
            for i, t in enumerate(words):
                state = self.next[state][t]
                if i + 1 >= n:
                    self.items_of.setdefault(self.ends[state], set()).add(name)
        self.whole = whole
        self.notable = bytearray(e != -1 or s != -1 for e, s in zip(self.ends, self.short, strict=True))

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of hit words, joined and in order, and the items with a window there."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        nexts, link, length, notable = self.next, self.link, self.length, self.notable
        state = matched = 0
        for i, t in enumerate(map(self.ids.get, words, repeat(0))):
            if not t:
                state = matched = 0
                continue
            to = nexts[state].get(t)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nexts[state].get(t)
            if to is None:
                continue
            state, matched = to, matched + 1
            if notable[state]:
                self._report(state, matched, i + 1, spans, items)
        return spans, items

    def _report(self, state: int, matched: int, end: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        longest = 0
        if matched >= self.window:
            longest = self.window
            items |= self.items_of[self.ends[state]]
        s = self.short[state]
        while s > 0:
            if s != state or matched == self.length[s]:
                longest = max(longest, self.length[s])
                items |= self.whole[s]
            up = self.link[s]
            s = self.short[up] if up > 0 else -1
        if longest:
            start = end - longest
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))


def _blocks(items: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Distinct items (id, text, block) and the number of blocks of about block_bytes of text."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text").where("text is not null").distinct()
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    return (written(rows, "items") if n > 1 else rows), n


def _automaton(rows: DataFrame, k: int, window: int) -> Broadcast:
    """The automaton of a block's items, whose bytes are bounded."""
    return rows.sparkSession.sparkContext.broadcast(ItemAutomaton([(r["id"], r["text"].encode()) for r in rows.where(F.col("block") == k).collect()], window))


def _join_spans(old: list, new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*((x["start"], x["end"]) for x in old), *new]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """docs with three columns more, and their names: n_words, spans of hit words, item ids.

    Items of one block are one narrow pass over the rows, and no text moves. Of more blocks each
    is a pass of its own, which writes what it hits and ends before the next one's automaton is
    made; texts then meet their hits where they are while these are few. Every row has its own
    result, repeated rows too. A null text has no words; a null item text is no item; a null item
    id counts as the empty id. Without items there are no hits.
    """
    prepare(docs.sparkSession)
    rows, blocks = _blocks(items, block_bytes)
    if blocks == 1:
        return _with_hits(docs, _automaton(rows, 0, window), None)
    found = None
    for k in range(blocks):
        one = _block_hits(docs, rows, k, window)
        found = one if found is None else found.unionByName(one)
    return _with_hits(docs, None, found)


#: A text is known by two hashes, as its hits depend on nothing else.
_KEYS = {"k1": F.xxhash64, "k2": lambda text: F.xxhash64(F.lit(1), text)}


def _block_hits(docs: DataFrame, items: DataFrame, k: int, window: int) -> DataFrame:
    """(k1, k2, spans, items) of distinct texts that a block hits, written; its automaton is gone afterwards."""
    automaton = _automaton(items, k, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                hits = [(a, b, *automaton.value.stream(fold(data).split())) for data, a, b in zip(utf8(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True) if data]
                hits = [h for h in hits if h[2]]
                columns = [pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in h[2]] for h in hits], _ARROW_SPANS), pa.array([sorted(h[3]) for h in hits], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "spans", "items"])

    keyed = docs.select("text", *(f("text").alias(n) for n, f in _KEYS.items()))
    found = written(keyed.mapInArrow(run, T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])).dropDuplicates(["k1", "k2"]), "hits")
    automaton.destroy()
    return found


def _with_hits(docs: DataFrame, automaton: Broadcast | None, hits: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """docs with n_words, spans and items: of the automaton, or of hits (k1, k2, spans, items) of any blocks."""
    names = fresh(docs, "n_words", "hit_spans", "hit_items")
    n_words, spans, found = names
    at, width = docs.columns.index("text"), len(docs.columns)
    schema = with_fields(docs.schema, (n_words, T.LongType()), (spans, _SPANS), (found, T.ArrayType(T.StringType())))
    rows = docs
    if hits is not None:
        every = hits.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias(spans), F.array_distinct(F.flatten(F.collect_list("items"))).alias(found))
        every = written(every, "hits")
        k1, k2, salt = fresh(docs, "k1", "k2", "salt")
        keyed = docs.withColumns({k1: _KEYS["k1"](F.col("text")), k2: _KEYS["k2"](F.col("text"))})
        size = every.agg(F.coalesce(F.sum(F.size(spans) + F.size(found) + 4), F.lit(0))).first()[0]
        if size <= FEW_NUMBERS:
            rows = keyed.join(F.broadcast(every.withColumnsRenamed({"k1": k1, "k2": k2})), [k1, k2], "left")
        else:  # copies of a text are spread by where they are read
            spread = every.withColumnsRenamed({"k1": k1, "k2": k2}).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(15))))
            rows = keyed.withColumn(salt, F.spark_partition_id() % 16).join(spread, [k1, k2, salt], "left")
        rows = rows.select(*docs.columns, spans, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                counts, all_spans, all_items = [], [], []
                others = zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True) if automaton is None else repeat((None, None))
                for data, (old_spans, old_items) in zip(utf8(batch.column(at)), others, strict=automaton is None):
                    words = fold(data).split() if data else []
                    hit, ids = automaton.value.stream(words) if automaton else (_join_spans(old_spans or [], []), old_items or ())
                    counts.append(len(words))
                    all_spans.append([{"start": s, "end": e} for s, e in hit])
                    all_items.append(sorted(ids))
                kept = pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width])
                yield attach(kept, {n_words: pa.array(counts, pa.int64()), spans: pa.array(all_spans, _ARROW_SPANS), found: pa.array(all_items, pa.list_(pa.string()))})

    return rows.mapInArrow(run, schema), names


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    contaminated: at least one word in twenty is hit. Without a hit the digest is that of the
    empty string. Nulls, repeated rows and empty tables: as in ``benchmark_hits``.
    """
    rows, (n_words, spans, found) = benchmark_hits(docs.select("doc_id", "text"), items, window, block_bytes)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    out = rows.select("doc_id", F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(found)), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(fold(data))]
    out, at = [], 0
    for s, e in spans:
        out.append(data[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, data[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, words_per_hit: int = 20, max_span: int | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contamination, in docs' own columns.

    Rows with at least one hit word in words_per_hit go. If max_span is given, rows that
    stay lose every span of max_span hit words or more; else their text stays as it is.
    """
    rows, (n_words, spans, found) = benchmark_hits(docs, items, window, block_bytes)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    kept = rows.where(~((n_hit > 0) & (n_hit * words_per_hit >= F.col(n_words))))
    if max_span is None:
        return kept.drop(n_words, spans, found)
    at, schema = docs.columns.index("text"), docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for data, hit in zip(utf8(batch.column(at)), batch.column(spans).to_pylist(), strict=True):
                long = [(x["start"], x["end"]) for x in hit or [] if x["end"] - x["start"] >= max_span]
                texts.append(cut_spans(data, long) if long else data)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(schema)])

    return kept.mapInArrow(cut, with_fields(schema))
