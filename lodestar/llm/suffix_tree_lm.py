"""Language-model scoring with a probabilistic suffix tree over words.

The tree's nodes are contexts of one word, two words, and so on. A context is tried if it occurs
often enough, its suffix (the context without its first word) is a node, and its own beginning was
tried; it stays if its next-symbol distribution diverges from its suffix's by enough for what it
costs to keep. So the tree grows as deep as the test lets it, up to a depth that is a parameter. A
distribution keeps the symbols seen often enough behind the context and hands the rest of its
mass, and a discount, to its suffix's; the root is the add-one unigram distribution. A token is
scored by the longest suffix of its past that is a node.

Counting is one pass for each depth. A task sums what it has seen and sends it on in blocks of
pairs; what it sends is held against a filter of the contexts to be tried, whose size is
bounded: a fuller filter lets more pass, which the exact join behind it takes out.

The model is one table of keys and numbers: a node has what its distribution leaves to its
suffix's, an entry has what it adds to that. A text's score is the sum of what its tokens find,
so the model is looked up in two ways with one result: the most frequent keys, a bounded number,
are broadcast, and for all others texts send their questions, a block of texts at a time, to the
pieces of the model. Word counts are looked up likewise. The driver gathers the keys that are broadcast and
filters, which are bounded; no model, and no level of it, is gathered whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import removed, written
from .common import LOWER, count_limit, join_frequent, prepare, slices, utf8

#: Words of a context at most.
DEPTH = 4
#: A context, and an entry (next symbol of a context), need so many occurrences to be tried.
LEAST = 4
#: Taken from each entry's count for its suffix to spread.
DISCOUNT = 0.75
#: Nats that a context has to save for each of its entries to stay.
GAIN = 3.0
#: Word counts and model keys that are broadcast, at most; rows of a join's broadcast side; 64-bit words of a filter.
HEAD, MODEL_HEAD, OFTEN, FILTER_WORDS = 1 << 18, 3 << 20, 1 << 15, 1 << 22
#: Tokens that a task sums before it sends them, tokens of the corpus for each reducer, and reducers beyond
#: which blocks would hold few keys and Spark's own aggregation takes the keys one by one.
FLUSH_TOKENS, REDUCER_TOKENS, REDUCERS = 1 << 20, 1 << 19, 1 << 12
#: Keys of a piece of the model, about as many at most; questions, or model keys, that are sent together.
PIECE_KEYS, FLUSH_ASKED = 1 << 20, 1 << 18
#: Rows that Parquet's reader takes at once: arrays of long texts stay small.
READ_ROWS = 512
#: Documents whose crc32 modulo FOLDS is HELD are held out of training.
FOLDS, HELD = 7, 2

#: The end of a text, which is a token.
END = np.uint64(0xE7037ED1A0B428DB)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit key for an ordered pair of 64-bit keys."""
    x = (first * _A) ^ (second + _B)
    x ^= x >> np.uint64(29)
    x *= _C
    return x ^ (x >> np.uint64(32))


def entry_key(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The key of a symbol as an entry of a context; the context longer by the symbol has another."""
    return ~mix(context, symbol)


#: Words of more bytes are hashed one by one.
_LONG = 64
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the words of lower-case bytes that end in white space.

    All words are taken at once, eight bytes of each in a step.
    """
    a = np.frombuffer(data, dtype=np.uint8)
    blank = (a == 32) | ((a - np.uint8(9)) <= 4)
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(a) and not blank[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    size = ends - starts
    eights = np.ndarray((len(data),), dtype="<u8", buffer=data + bytes(8), strides=(1,))

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eights[at] & (_ALL >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))

    out = mix(eight(starts, size), size.astype(np.uint64))
    more, done = np.flatnonzero(size > 8), 8
    while len(more) and done < _LONG:
        out[more] = mix(out[more], eight(starts[more] + done, size[more] - done))
        done += 8
        more = more[size[more] > done]
    for i in more.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return starts, out


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens end to end, each text's end among them, and tokens of each text."""
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
    places, hashes = word_hashes(b"".join((t or b"") + b"\n" for t in texts).translate(LOWER))
    upto = np.searchsorted(places, np.cumsum(lengths))
    counts = np.diff(upto, prepend=0) + 1
    out = np.empty(len(hashes) + len(texts), dtype=np.uint64)
    last = np.cumsum(counts) - 1
    words = np.ones(len(out), dtype=bool)
    words[last] = False
    out[last] = END
    out[words] = hashes
    return out, counts


def keys_of(tokens: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For contexts of one word, two words, ... ``depth`` words: each token's context, and where its text has that many."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    before = np.concatenate([tokens[:1], tokens[:-1]])
    key = before
    for d in range(1, depth + 1):
        if d > 1:
            key = mix(np.concatenate([key[:1], key[:-1]]), before)
        yield key, place >= d


class Table:
    """Numbers by 64-bit key, found by the key's first bits and a step or two from there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)

    def find(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of sought keys, and which are there."""
        slot = sought >> self.shift
        at, end = self.starts[slot].astype(np.int64), self.starts[slot + np.uint64(1)]
        there = np.zeros(len(sought), dtype=bool)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == sought[left]
            there[left[hit]] = True
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        at[~there] = 0
        return at, there


class KeyFilter:
    """Three bits in one word for each key: never false for a key that was put in."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.shift = np.uint64(64 - (len(words) - 1).bit_length())

    @staticmethod
    def places(keys: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Words and bits of keys."""
        one, six, low = np.uint64(1), np.uint64(6), np.uint64(63)
        return keys >> shift, (one << (keys & low)) | (one << ((keys >> six) & low)) | (one << ((keys >> (six + six)) & low))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at, bits = self.places(keys, self.shift)
        return (self.words[at] & bits) == bits


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: pd.Series) -> np.ndarray:
    return x.to_numpy(dtype=np.int64).view(np.uint64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where their runs begin in it."""
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def _runs_of_bytes(values: np.ndarray, edges: np.ndarray) -> pa.BinaryArray:
    """The values between every two edges as one row of bytes, without a copy of them."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _flat(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The numbers in rows of bytes, end to end."""
    parts = []
    for c in column.chunks:
        _, offsets, data = c.buffers()
        ends = np.frombuffer(offsets, dtype=np.int32)[[c.offset, c.offset + len(c)]]
        parts.append(np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[1]])
    return np.concatenate(parts).view(dtype)


def counted(docs: DataFrame, pairs: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], reducers: int, least: int) -> DataFrame:
    """(first, second, n, key) of the pairs that ``pairs`` takes from texts' tokens, n >= least; the key is entry_key's.

    A task sends, for each reducer, its pairs and counts as one row of bytes; with more than
    REDUCERS of them, a row for each key, which Spark sums.
    """
    single = reducers > REDUCERS
    width = (1 << 64) // reducers + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            first, second = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            keys = mix(first, second)
            at, starts = _runs(keys)
            n = np.diff(np.append(starts, len(keys))).astype(np.uint32)
            at = at[starts]
            keys, first, second = keys[at], first[at], second[at]
            if single:
                for k in range(0, len(n), 1 << 16):
                    cut = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(first[cut])), pa.array(signed(second[cut])), pa.array(n[cut].astype(np.int64)), pa.array(signed(~keys[cut]))], names=["first", "second", "n", "key"])
                return
            # pairs of one first key are in few blocks and lie together there, so it takes little room; more reducers are more blocks
            parts = max(4, reducers.bit_length() - 4)
            dealt = mix(first, second >> np.uint64(64 - parts))
            order = np.argsort(dealt)
            cuts = np.searchsorted(dealt[order], np.array([min(width * r, (1 << 64) - 1) for r in range(1, reducers)], dtype=np.uint64))
            del dealt, keys, at, starts
            edges = np.concatenate([[0], cuts, [len(n)]])
            some = np.flatnonzero(np.diff(edges))
            edges = np.append(edges[some], len(n))
            yield from slices(pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(_runs_of_bytes(x[order], edges) for x in (first, second, n))], names=["r", "a", "b", "n"]), 1)

        for batch in batches:
            for part in slices(batch, 0):
                got = pairs(*tokens_of(utf8(part.column(0))))
                if len(got[0]):
                    held.append(got)
                    size += len(got[0])
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def total(group: pa.Table) -> pa.Table:
        first, second, n = (_flat(group.column(c), t) for c, t in (("a", np.uint64), ("b", np.uint64), ("n", np.uint32)))
        keys = mix(first, second)
        order, starts = _runs(keys)
        sums = np.add.reduceat(n[order], starts, dtype=np.int64)
        kept = sums >= least
        at = order[starts[kept]]
        return pa.table({"first": signed(first[at]), "second": signed(second[at]), "n": sums[kept], "key": signed(~keys[at])})

    if single:
        return docs.select("text").mapInArrow(send, "first long, second long, n long, key long").groupBy("first", "second", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("first", "second", "n", "key")
    return docs.select("text").mapInArrow(send, "r int, a binary, b binary, n binary").groupBy("r").applyInArrow(total, "first long, second long, n long, key long")


def is_held_out(doc_id: Column) -> Column:
    """Whether a row is held out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD


@dataclass
class SuffixTree:
    """words: w, c, key (of its pair with 0). model: key, value (to base 10), n. The key of a node is its context's, that of an
    entry is its symbol's and its context's; n is how often it was seen, depth the words of its context."""

    words: DataFrame
    model: DataFrame
    tokens: int
    distinct: int
    depth: int
    head: Broadcast  # (counts of words as a Table, all words of at least so many occurrences are here)


def _columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded number of rows, as arrays."""
    return [c.to_numpy() for c in df.toArrow().columns]


def _head(words: DataFrame, bound: int) -> Broadcast:
    """Counts of all words over a power of two, the least that leaves ``bound`` of them at most."""
    least, _ = count_limit(words, "c", bound)
    w, c = _columns(words.where(F.col("c") >= least).select("w", "c"))
    return words.sparkSession.sparkContext.broadcast((Table(w.view(np.uint64), c), least))


def _ge(head: tuple[Table, int], hashes: np.ndarray, least: int) -> np.ndarray:
    """Whether a word may have ``least`` occurrences, by what is broadcast."""
    table, threshold = head
    at, there = table.find(hashes)
    return np.where(there, table.values[at] >= least if len(table.values) else False, threshold > least)


def _filter(keys: DataFrame, column: str, bound: int) -> Broadcast:
    """A filter of the keys in a column, with 16 bits for each of them but ``bound`` words at most."""
    n = keys.count()
    size = min(bound, 1 << max(6, (n // 4).bit_length()))
    shift = np.uint64(64 - (size - 1).bit_length())

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, bits = KeyFilter.places(unsigned(b["key"]), shift)
            yield pd.DataFrame({"at": at.astype(np.int64), "bits": signed(bits)})

    at, bits = _columns(keys.select(F.col(column).alias("key")).mapInPandas(places, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")))
    words = np.zeros(size, dtype=np.uint64)
    words[at] = bits.view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(KeyFilter(words))


def train(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN, head: int = HEAD, often: int = OFTEN, filter_words: int = FILTER_WORDS) -> SuffixTree:
    """The suffix tree of all rows of docs. Null texts are empty; repeated rows count each."""
    spark = prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    reducers = max(1, -(-size // 6 // REDUCER_TOKENS))
    single = counted(docs, lambda t, c: (t, np.zeros(len(t), dtype=np.uint64)), reducers, 1)
    words = written(single.select(F.col("first").alias("w"), F.col("n").alias("c"), "key"), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = _head(words, head)
    root = (F.col("c") + 1) / F.lit(float(tokens + distinct + 1))
    end = F.lit(int(signed(np.array([END]))[0]))
    contexts = words.where((F.col("c") >= least) & (F.col("w") != end)).select(F.col("w").alias("ctx"), F.lit(0).cast("long").alias("suffix"), F.col("c").alias("all"))
    model, above = None, None
    for d in range(1, depth + 1):
        sought = _filter(contexts, "ctx", filter_words) if d > 1 else None

        def pairs(t: np.ndarray, c: np.ndarray, d: int = d, sought: Broadcast | None = sought) -> tuple[np.ndarray, np.ndarray]:
            *_, (key, inside) = keys_of(t, c, d)
            at = np.flatnonzero(inside)
            at = at[sought.value.has(key[at]) if sought else _ge(top.value, key[at], least)]
            at = at[_ge(top.value, t[at], least)]
            return key[at], t[at]

        counts = written(counted(docs, pairs, reducers, least), "counts").withColumnsRenamed({"first": "ctx", "second": "w"})
        if sought:
            sought.destroy()
        rows = join_frequent(counts, contexts, "ctx", "all", often)
        if d == 1:
            rows = join_frequent(rows, words.select("w", "c"), "w", "c", often).withColumns({"q": root, "longer": F.col("w")})
        else:  # a suffix has every entry of its contexts, as it has seen it no less often
            rows = rows.join(above.select(F.col("ctx").alias("suffix"), "w", F.col("p").alias("q"), F.bitwise_not("key").alias("longer")), ["suffix", "w"])
        rows = written(rows.select("ctx", "w", "n", "key", "all", "q", "longer"), "tried")
        removed(counts)
        states = written(_retained(rows, gain), "states")
        entries = written(_entries(rows, states, often), "entries")
        level = states.select(F.col("ctx").alias("key"), F.log10("lam").alias("value"), F.col("all").alias("n")).unionByName(entries.select("key", "value", "n")).withColumn("depth", F.lit(d))
        model = level if model is None else model.unionByName(level)
        if d > 1:
            removed(contexts)
        if d == depth:
            removed(rows)
            break
        contexts, above = written(_extended(rows.where(F.col("w") != end), states, often), "contexts"), entries
        removed(rows)
        if not contexts.limit(1).count():
            removed(contexts)
            break
    return SuffixTree(words, model, int(tokens), int(distinct), depth, top)


def _retained(rows: DataFrame, gain: float) -> DataFrame:
    """(ctx, all, lam) of contexts that pass the divergence test; lam is the mass left to the suffix.

    rows: ctx, w, n, all (the context's occurrences), q (the suffix's probability of w). What is no
    entry counts as one symbol, so the divergence is a lower bound of the full one.
    """
    n, q = F.col("n"), F.col("q")
    sums = rows.groupBy("ctx", "all").agg(F.sum("n").alias("ns"), F.sum("q").alias("qs"), F.count("*").alias("k"), F.sum(n * F.log(n / F.col("all") / q)).alias("g"))
    rest = F.col("all") - F.col("ns")
    other = F.when(rest > 0, rest * F.log(rest / F.col("all") / F.greatest(1 - F.col("qs"), F.lit(1e-12)))).otherwise(0.0)
    kept = sums.where(F.col("g") + other >= F.lit(gain) * F.col("k"))
    return kept.select("ctx", "all", ((F.col("all") - F.col("ns") + F.lit(DISCOUNT) * F.col("k")) / F.col("all")).alias("lam"))


def _entries(rows: DataFrame, states: DataFrame, often: int) -> DataFrame:
    """(ctx, w, n, key, p, value) of the nodes' entries: their probability, and by how much its logarithm is
    over what they would have without being entries."""
    inside = join_frequent(rows.drop("all"), states, "ctx", "all", often)
    handed = F.col("lam") * F.col("q")
    p = (F.col("n") - DISCOUNT) / F.col("all") + handed
    return inside.select("ctx", "w", "n", "key", p.alias("p"), F.log10(p / handed).alias("value"))


def _extended(rows: DataFrame, states: DataFrame, often: int) -> DataFrame:
    """(ctx, suffix, all) of contexts a word longer, those whose suffix is a node. A context with an entry's
    word behind it has the complement of the entry's key."""
    longer = rows.select(F.bitwise_not("key").alias("ctx"), F.col("longer").alias("suffix"), F.col("n").alias("all"))
    return join_frequent(longer, states.select(F.col("ctx").alias("suffix"), F.col("all").alias("seen")), "suffix", "seen", often).select("ctx", "suffix", "all")


def score_texts(texts: list[bytes | None], head: Table, model: Table, others: KeyFilter, tree_size: int, depth: int) -> tuple:
    """n_tokens, known, base and score of each text by what is broadcast; then what else may be known: texts,
    keys and how often, by text. A word is asked for by its pair with 0, which is no entry."""
    t, sizes = tokens_of(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at, there = head.find(t)
    base = np.full(len(t), -np.log10(tree_size))
    base[there] += np.log10(head.values[at[there]] + 1)
    value = base.copy()
    asked: list[tuple[np.ndarray, np.ndarray]] = []

    def ask(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        maybe = others.has(keys)
        asked.append((owner[places[maybe]], keys[maybe]))
        return maybe

    def look_up(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Add what is found, ask for what may be elsewhere; which of them there may be."""
        at, found = model.find(keys)
        value[places[found]] += model.values[at[found]]
        rest = np.flatnonzero(~found)
        found[rest] = ask(places[rest], keys[rest])
        return found

    rest = np.flatnonzero(~there)
    ask(rest, entry_key(t[rest], np.zeros(len(rest), dtype=np.uint64)))
    nodes = entries = None  # tokens whose shorter context may be a node; of them, those that may be its entries
    for key, inside in keys_of(t, sizes, depth):
        nodes = np.flatnonzero(inside) if nodes is None else nodes[inside[nodes]]
        node = np.zeros(len(t), dtype=bool)
        node[nodes[look_up(nodes, key[nodes])]] = True
        nodes = nodes[node[nodes]]
        entries = nodes if entries is None else entries[node[entries]]
        entries = entries[look_up(entries, entry_key(key[entries], t[entries]))]
        if not len(nodes):
            break
    n = len(texts)
    who, keys = (np.concatenate(x) for x in zip(*asked, strict=True))
    order = np.lexsort((keys, who))
    who, keys = who[order], keys[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])])) if len(keys) else np.zeros(0, dtype=np.int64)
    sums = (np.bincount(owner[there], minlength=n), np.bincount(owner, weights=base, minlength=n), np.bincount(owner, weights=value, minlength=n))
    return sizes, *sums, who[starts], keys[starts], np.diff(np.append(starts, len(keys)))


#: Rows of a stream: a piece of the model, what a block of texts asks of a piece, a text.
_PIECE, _ASKED, _TEXT = 0, 1, 2


def _streamed(kind: int, columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of a kind, null in the columns of other kinds."""
    n = len(columns["r"])
    columns |= {"kind": pa.array(np.full(n, kind, dtype=np.int32))}
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def _blocks(kind: int, block: int, bits: int, schema: pa.Schema, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys, owners and numbers as one row of bytes for each piece, in batches of bounded size."""
    r = (arrays[0] >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(r, kind="stable")
    pieces, starts = np.unique(r[order], return_index=True)
    if not len(pieces):
        return
    edges = np.append(starts, len(r))
    columns = {c: _runs_of_bytes(x[order], edges) for c, x in zip(("keys", "owners", "numbers"), arrays, strict=True)}
    columns |= {"r": pa.array(pieces.astype(np.int32)), "block": pa.array(np.full(len(pieces), block, dtype=np.int64))}
    yield from slices(_streamed(kind, columns, schema), schema.names.index("keys"))


def score(docs: DataFrame, tree: SuffixTree, model_head: int = MODEL_HEAD, filter_words: int = FILTER_WORDS, piece: int = PIECE_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    score is the log10 probability of the whole text, its end included. A null or empty text is
    its end alone. Every row has its own result; a null doc_id stays null and counts as trained
    on; an empty table gives no rows; other columns are not read.

    Words and model keys that are not broadcast are dealt into pieces by their first bits. A task
    has one piece, a bounded number of keys, and takes the questions to it one block of texts after
    the other, so however many texts ask for one key, it holds one block's. Rows are numbered in
    their partitions: docs has to be a table, or of the same rows in the same order when computed again.
    """
    spark = prepare(docs.sparkSession)
    tree_size, depth, head = tree.tokens + tree.distinct + 1, tree.depth, tree.head
    least, _ = count_limit(tree.model, "n", model_head)
    key, value = _columns(tree.model.where(F.col("n") >= least).select("key", F.col("value").cast("float")))
    model = spark.sparkContext.broadcast(Table(key.view(np.uint64), value))
    words = tree.words.where(F.col("c") < head.value[1]).select("key", F.log10(F.col("c") + 1).alias("value"), F.lit(1).alias("word"))
    rest = words.unionByName(tree.model.where(F.col("n") < least).select("key", "value", F.lit(0).alias("word")))
    others = _filter(rest, "key", filter_words)
    bits = max(3, (rest.count() // piece).bit_length())
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts_ddl = f"doc_id {kind}, tokens long, known long, base double, score double"
    ddl = f"r int, kind int, block long, keys binary, owners binary, numbers binary, {texts_ddl}"
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    last = schema.names.index("doc_id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, values, word = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
            yield from _blocks(_PIECE, 0, bits, schema, keys.view(np.uint64), word.astype(np.uint32), values)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= FLUSH_ASKED:
                yield from flush()
                held = []
        if held:
            yield from flush()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = first = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            who, keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            return _blocks(_ASKED, first, bits, schema, keys, who.astype(np.uint32), n.astype(np.uint32))

        for batch in batches:
            for b in slices(batch, 1):
                *sums, who, keys, n = score_texts(utf8(b.column(1)), head.value[0], model.value, others.value, tree_size, depth)
                rows = np.arange(row, row + b.num_rows)
                yield _streamed(_TEXT, {"r": pa.array((rows % (1 << bits)).astype(np.int32)), "block": pa.array(rows), "doc_id": b.column(0)} | dict(zip(("tokens", "known", "base", "score"), map(pa.array, sums), strict=True)), schema)
                held.append((who + (row - first), keys, n))
                row += b.num_rows
                if sum(len(h[0]) for h in held) >= FLUSH_ASKED:
                    yield from flush()
                    held, first = [], row
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["row", *schema.names[last:]], [pa.int64(), *schema.types[last:]]
        at, held, found = None, [], None
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            texts = batch.filter(pa.array(kinds == _TEXT))
            if texts.num_rows:
                yield pa.RecordBatch.from_arrays([texts.column(2), *texts.columns[last:]], names=names)
            for i in np.flatnonzero(kinds != _TEXT).tolist():
                r, block, keys, owners, numbers = (batch.column(c)[i].as_py() for c in (0, 2, 3, 4, 5))
                if r != at:
                    at, held, found = r, [], None
                # all keys of a piece have the same first bits
                keys, owners = np.frombuffer(keys, dtype=np.uint64) << np.uint64(bits), np.frombuffer(owners, dtype=np.uint32)
                if kinds[i] == _PIECE:
                    held.append((keys, np.frombuffer(numbers, dtype=np.float64), owners))
                    continue
                if found is None:
                    k, v, w = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0))
                    found, held = Table(k, np.stack([v, w], axis=1)), []
                place, there = found.find(keys)
                n, owners = np.frombuffer(numbers, dtype=np.uint32)[there].astype(np.float64), owners[there].astype(np.int64)
                (value, word), who = found.values[place[there]].T, np.unique(owners)
                slot = np.searchsorted(who, owners)
                known, base, total = (np.bincount(slot, weights=x, minlength=len(who)) for x in (n * word, n * word * value, n * value))
                out = {"row": pa.array(who + block), "known": pa.array(known.astype(np.int64)), "base": pa.array(base), "score": pa.array(total)}
                yield pa.RecordBatch.from_arrays([out.get(c, pa.nulls(len(who), t)) for c, t in zip(names, types, strict=True)], names=names)

    stream = docs.select("doc_id", "text").mapInArrow(ask, ddl).union(rest.mapInArrow(packed, ddl))
    settled = stream.repartitionById(1 << bits, F.col("r")).sortWithinPartitions("r", "kind").mapInArrow(settle, f"row long, {texts_ddl}")
    sums = settled.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")))
    return sums.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(tree.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("score").alias("score"),
    )


@contextmanager
def _read_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Parquet's reader takes so many rows at once meanwhile."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def suffix_tree_scores(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, and score all rows. The scores are a table; the model is gone."""
    with _read_rows(docs.sparkSession, READ_ROWS):
        tree = train(docs.where(~is_held_out(F.col("doc_id"))))
        scores = written(score(docs, tree), "scores")
    removed(tree.model)
    removed(tree.words)
    return scores
