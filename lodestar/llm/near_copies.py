"""One document of each group of near copies: SimHash finds candidates, word shingles settle them.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Their fingerprints then differ in few bits, so covering locality-sensitive hashing with a
wider radius than the plain SimHash query's finds them: the fingerprint is taken in two halves,
one of which has at most half of the differing bits, and each half has its covering masks. A second
fingerprint of other hashes is compared with each candidate, so that chance links stay rare in
large corpora.

Candidates make loose groups. In each group leaders are chosen from the smallest doc_id on: a text
that is a near copy of a leader goes, and the first of those left are the next leaders. So a
text goes only if it is a near copy of one that stays, and no two that stay are near copies among
the candidates. A round compares every text with a bounded number of leaders, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import removed, written
from .common import LOWER, prepare, slices, stable, utf8
from .components import components
from .simhash import BLOCK, CELL, SEED, cells, covering_masks, majority

#: Words of the shingles that decide, and the least Jaccard similarity of near copies, in parts of ten.
SHINGLE, TENTHS = 5, 8
#: Words of the fingerprints' shingles; bits that they may differ in, for the first and the second.
PRINT_SHINGLE, RADIUS, SECOND_RADIUS = 3, 9, 13
#: Parts of the fingerprint that have their own masks.
PARTS = 2
#: Leaders that a round chooses in a group at first (four times as many in the next, up to the most),
#: and shingles that they have together at most, if they are more than one.
LEADERS, MOST_LEADERS, LEADER_SHINGLES = 4, 256, 1 << 20
#: Rows of a group's part that one task holds against its leaders.
PART_ROWS = 4096
#: Rows that a join may broadcast, and shingles of leaders.
FEW, FEW_SHINGLES = 1 << 20, 1 << 22
#: Rows that a task compares at once.
_CHUNK = 1 << 16


def _windows(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of a text's word shingles; one of the whole text if it has fewer words; none without words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], dtype=np.uint64)


def _words(data: bytes | None) -> list[bytes]:
    return data.translate(LOWER).split() if data else []


def shingle_set(data: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, in order."""
    return np.unique(_windows(_words(data), shingle))


def prints_of(data: bytes | None) -> tuple[int, int, int]:
    """A key of the text's words, and both fingerprints, as unsigned numbers. Without words all are 0."""
    words = _words(data)
    if not words:
        return 0, 0, 0
    hashes = _windows(words, PRINT_SHINGLE)
    other = hashes * np.uint64(0x9E3779B97F4A7C15)
    other ^= other >> np.uint64(31)
    return xxhash.xxh64_intdigest(b" ".join(words), 7), majority(hashes), majority(other * np.uint64(0xC2B2AE3D27D4EB4F))


def _near(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (np.bitwise_count(one[0] ^ two[0]) <= RADIUS) & (np.bitwise_count(one[1] ^ two[1]) <= SECOND_RADIUS)


def _tree(fp: np.ndarray, fp2: np.ndarray) -> list[tuple[int, int]]:
    """Positions of links that connect what near pairs connect; what a class has reached is not compared again."""
    left, links = np.arange(len(fp)), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            near = _near((fp[left], fp2[left]), (fp[one], fp2[one]))
            if near.any():
                links += [(one, x) for x in left[near]]
                frontier += left[near].tolist()
                left = left[~near]
    return links


def _cell_links(cell: np.ndarray, node: np.ndarray, fp: np.ndarray, fp2: np.ndarray) -> np.ndarray:
    """Links (a, b) of whole cells, whose rows lie together: a tree for each cell that has a near pair."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    ends = np.append(starts[1:], len(cell))
    number = np.repeat(np.arange(len(starts)), ends - starts)
    some = np.zeros(len(starts), dtype=bool)
    at, step = np.arange(len(cell)), 1
    while True:  # rows that have one ``step`` further in their cell, whose cell has no near pair yet
        at = at[(at + step < ends[number[at]]) & ~some[number[at]]]
        if not len(at):
            break
        near = _near((fp[at], fp2[at]), (fp[at + step], fp2[at + step]))
        some[number[at[near]]] = True
        step += 1
    found = [(node[s + x], node[s + y]) for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True) for x, y in _tree(fp[s:e], fp2[s:e])]
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def candidate_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect exactly what near fingerprints (node, fp, fp2) connect."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            columns = {c: t.column(c).to_numpy() for c in t.column_names}
            cell = np.unique(np.stack([columns[c].astype(np.int64) for c in CELL], axis=1), axis=0, return_inverse=True)[1].ravel() if len(t) else np.zeros(0)
            keep = len(t) if last else int(np.flatnonzero(cell == cell[-1])[0])
            both = _cell_links(cell[:keep], columns["node"][:keep], columns["fp"][:keep].view(np.uint64), columns["fp2"][:keep].view(np.uint64)) if keep else np.zeros((0, 2), dtype=np.int64)
            held[:] = t.slice(keep).combine_chunks().to_batches()
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _CHUNK:
                yield from flush(last=False)
                rows = sum(x.num_rows for x in held) // 2  # a cell that goes on is not looked through each time
        if held:
            yield from flush(last=True)

    members = cells(nodes.select("node", "fp", "fp2"), covering_masks(RADIUS, PARTS), block)
    return members.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(compare, "a long, b long").distinct()


def _alike(a: Column, b: Column) -> Column:
    """Whether two sets of shingles are alike enough; two empty ones are."""
    both = F.size(F.array_intersect(a, b))
    return (10 + TENTHS) * both >= TENTHS * (F.size(a) + F.size(b))


def _first(left: DataFrame, most: int) -> DataFrame:
    """(root, node, rank) of the first rows of each group, of left (root, node, first, size): ``most`` at most, and
    LEADER_SHINGLES together if they are more than one."""
    w = Window.partitionBy("root").orderBy("first")
    first = left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    first = first.withColumn("so_far", F.sum("size").over(w)).where((F.col("rank") == 1) | (F.col("so_far") <= LEADER_SHINGLES))
    return first.select("root", "node", "rank")


def _choose(group: pd.DataFrame) -> pd.DataFrame:
    """Of a group's first rows those that are not alike to one before."""
    standing: list[np.ndarray] = []
    stays = []
    group = group.sort_values("rank")
    for one in (np.asarray(x) for x in group["set"]):
        alike = any((10 + TENTHS) * len(np.intersect1d(one, x, assume_unique=True)) >= TENTHS * (len(one) + len(x)) for x in standing)
        stays.append(not alike)
        if not alike:
            standing.append(one)
    return group[stays][["root", "node", "set"]]


def _met(rows: DataFrame, leaders: DataFrame, left: DataFrame) -> DataFrame:
    """(node, leader, set, of): rows beside all leaders of their group. Leaders are broadcast while their sets are
    small; beyond that a group is dealt in parts that each meet its leaders."""
    named = leaders.select("root", F.col("node").alias("leader"), F.col("set").alias("of"))
    if (leaders.agg(F.sum(F.size("set"))).first()[0] or 0) <= FEW_SHINGLES:
        return rows.join(F.broadcast(named), "root")
    parts = left.groupBy("root").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    dealt = named.join(parts, "root").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    own = rows.join(_beside(parts), "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return own.join(dealt, ["root", "part"])


def near_copies(members: DataFrame) -> DataFrame:
    """(node) that are near copies of a node that stays, from members (root, node, first, set).

    Sets are a table of their own, written anew when half of its rows are settled; what a round moves
    and keeps are numbers. A group's rows are spread over tasks, whatever its size.
    """
    sets = written(members.select("root", "node", "first", F.size("set").alias("size"), "set"), "sets")
    left = written(sets.drop("set"), "left")
    n = held = left.count()
    gone, most = None, LEADERS
    while n:
        if 2 * n <= held:
            fewer = written(sets.join(_beside(left.select("node")), "node", "left_semi").select(*sets.columns), "sets")
            removed(sets)
            sets, held = fewer, n
        first = sets.select("node", "set").join(_beside(_first(left, most)), "node")
        leaders = written(first.groupBy("root").applyInPandas(_choose, "root long, node long, set array<long>"), "leaders")
        rows = sets.select("root", "node", "set") if held == n else sets.select("root", "node", "set").join(_beside(left.select("node")), "node", "left_semi")
        met = _met(rows, leaders, left).where((F.col("node") == F.col("leader")) | _alike(F.col("set"), F.col("of")))
        settled = written(met.groupBy("node").agg(F.max(F.col("node") == F.col("leader")).alias("leads")), "settled")
        after = written(left.join(_beside(settled), "node", "left_anti").select(*left.columns), "left")
        for done in (leaders, left):
            removed(done)
        left, n = after, after.count()
        some = settled.where(~F.col("leads")).select("node")
        gone = some if gone is None else gone.union(some)
        most = min(4 * most, MOST_LEADERS)
    removed(sets)
    return members.limit(0).select("node") if gone is None else gone


def _beside(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows; beyond that the join is Spark's to choose."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs without near copies of others, in docs' own columns: of a group the smallest doc_id stays.

    Texts of the same words, whatever their white space and the case of A-Z, are copies; a text
    of fewer words than a shingle is one shingle; all texts without words, null too, are copies of
    each other. A null doc_id comes last; of rows with equal doc_id and text one stays, the least by
    all columns. Texts move only if they are among the candidates. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    width = len(docs.columns)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    inner = docs.toDF(*("id" if i == id_at else "text" if i == text_at else f"c{i}" for i in range(width))).withColumn("row", F.xxhash64("id", "text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                made = np.array([prints_of(x) for x in utf8(part.column(2))], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(made[:, i]) for i in range(3))], names=["id", "row", "node", "fp", "fp2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = stable(inner.select("id", "row", "text").mapInArrow(prints, f"id {kind}, row long, node long, fp long, fp2 long"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    nodes = stable(narrow.groupBy("node", "fp", "fp2").agg(F.min(order).alias("first")))
    grouped = stable(components(candidate_links(nodes, block)).join(nodes, "node").select("root", "node", "first"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                made = [shingle_set(x).view(np.int64) for x in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], names=["row", "set"])

    wanted = grouped.select(F.col("first")["row"].alias("row")).distinct()
    texts = inner.join(_beside(wanted), "row", "left_semi").select("row", "text").mapInArrow(sets, "row long, set array<long>").dropDuplicates(["row"])
    members = grouped.withColumn("row", F.col("first")["row"]).join(texts, "row").select("root", "node", "first", "set")
    kept = nodes.join(near_copies(members), "node", "left_anti").select(F.col("first")["id"].alias("id"), F.col("first")["row"].alias("row"))
    same = lambda a, b: (a["row"] == b["row"]) & a["id"].eqNullSafe(b["id"])
    times = stable(narrow.groupBy("id", "row").agg(F.count("*").alias("n")))
    losers = _beside(stable(times.join(kept, same(times, kept), "left_anti").select("id", "row")))
    out = inner.join(losers, same(inner, losers), "left_anti")
    repeated = stable(times.where("n > 1").join(kept, same(times, kept), "left_semi").select("id", "row"))
    if repeated.limit(1).count():  # one of each, and nothing of the others moves
        beside = _beside(repeated)
        w = Window.partitionBy("id", "row").orderBy(F.to_json(F.struct(*inner.columns)))
        one = out.join(beside, same(out, beside), "left_semi").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
        out = out.join(beside, same(out, beside), "left_anti").unionByName(one)
    return out.select(*(F.col("id" if i == id_at else "text" if i == text_at else f"c{i}").alias(docs.columns[i]) for i in range(width)))
