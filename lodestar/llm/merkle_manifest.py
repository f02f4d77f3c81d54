"""A Merkle manifest of a table: a tree for each group of rows, and one over the groups' roots.

What is stored is a parent's preimage, the concatenated digests of its children. A leaf joins
the preimages of its ancestors; without its own 64-character slot a preimage is the siblings, and
with another digest spliced into the slot it is what the parent is hashed from again.

Preimages stand in blocks of six levels: a block has 64 nodes at the bottom and is one node of the
next round, so a billion leaves are five rounds, each a shuffle of a 64th of the one before. A leaf finds
all its ancestors through one block a round, keyed by tree and number, so no key is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import removed, written
from .common import prepare
from .ranking import ranked

#: Hexadecimal digits of a digest, a node's slot in its parent's preimage.
SLOT = 64
#: Children of a node, and levels in a block.
ARITY, LEVELS = 2, 6
#: What a leaf of the documents table is hashed from, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value so that no two rows of values concatenate to the same text: bytes of its UTF-8, a colon, itself; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def record(columns: list[Column]) -> Column:
    """The leaf of a row."""
    return digest(*map(field, columns))


def excised(preimage: Column, slot: Column) -> Column:
    """The siblings: a preimage without one slot."""
    return F.concat(F.substring(preimage, F.lit(1), slot * SLOT), F.substring(preimage, slot * SLOT + SLOT + 1, F.length(preimage)))


def spliced(preimage: Column, slot: Column, other: Column) -> Column:
    """A preimage with another digest in one slot."""
    return F.concat(F.substring(preimage, F.lit(1), slot * SLOT), other, F.substring(preimage, slot * SLOT + SLOT + 1, F.length(preimage)))


def siblings(path: Column) -> Column:
    """All siblings of a path, from the leaf to the root, each level's from left to right."""
    return F.array_join(F.transform(path, lambda step: excised(step["preimage"], step["slot"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda below, step: digest(spliced(step["preimage"], step["slot"], below)))


@dataclass
class Manifest:
    """Blocks of preimages by round, of the groups' trees and of the crown above them.

    A block is (tree, block, size, nodes, preimages, digest): nodes are (pos, digest, and what is
    carried), preimages an array for each level, digest the block's own.
    """

    trees: list[DataFrame]
    crown: list[DataFrame]
    arity: int = ARITY

    def save(self, path: str) -> None:
        """Write all blocks; ``load`` reads them in a later session."""
        for part in ("trees", "crown"):
            for i, blocks in enumerate(getattr(self, part)):
                blocks.write.mode("overwrite").parquet(f"{path}/{part}/round={i}")
        spark = self.trees[0].sparkSession
        spark.createDataFrame([(self.arity, len(self.trees), len(self.crown))], "arity int, trees int, crown int").write.mode("overwrite").json(f"{path}/shape")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Manifest:
        shape = spark.read.json(f"{path}/shape").first()
        of = lambda part: [spark.read.parquet(f"{path}/{part}/round={i}") for i in range(shape[part])]
        return Manifest(of("trees"), of("crown"), shape["arity"])

    def roots(self) -> DataFrame:
        """(tree, subroot)."""
        return self.trees[-1].select("tree", F.col("digest").alias("subroot"))

    def root(self) -> DataFrame:
        """One row, the root; none of an empty table."""
        return self.crown[-1].select(F.col("digest").alias("root"))

    def paths(self) -> DataFrame:
        """A row for each leaf: tree, pos, digest, what is carried, path, subroot, root.

        path is an array of (preimage, slot) from the leaf's parent to the root.
        """
        top = self.crown[-1].select("tree", "block", F.array().cast("array<struct<preimage:string,slot:int>>").alias("upper"), F.col("digest").alias("root"))
        above = _descended(self.crown, top, self.arity).select(F.col("node.name").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("path").alias("upper"), "root", F.col("node.digest").alias("subroot"))
        return _descended(self.trees, above, self.arity).select("tree", "node.*", "path", "subroot", "root")


def manifest(rows: DataFrame, by: str, order: list[str], leaf: Column, carry: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS) -> Manifest:
    """The manifest of rows: trees by ``by``, leaves in the order of ``order``, then of their digests.

    Only the leaf, the order and what is carried leave the scan. A tree is known by its key: ``-``
    for null, ``=`` and the value otherwise, which sorts as null first and bytewise.
    """
    prepare(rows.sparkSession)
    carry = carry or {}
    key = F.when(F.col(by).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(by).cast("string")))
    leaves = rows.select(key.alias("tree"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(order)), leaf.alias("digest"), *(v.alias(k) for k, v in carry.items()))
    placed = ranked(leaves, [*(f"_by{i}" for i in range(len(order))), "digest"], "tree", "leaves")
    trees = _rounds(placed.select("tree", "size", F.struct("pos", "digest", *carry).alias("node")), arity, levels)
    removed(placed)
    subroots = ranked(trees[-1].select(F.lit("").alias("crown"), F.col("tree").alias("name"), "digest"), ["name"], "crown", "subroots")
    crown = _rounds(subroots.select(F.col("crown").alias("tree"), "size", F.struct("pos", "digest", "name").alias("node")), arity, levels)
    removed(subroots)
    return Manifest(trees, crown, arity)


def _rounds(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """Blocks of nodes (tree, size, node), then of the blocks' roots, until each tree is one block."""
    left = nodes.agg(F.max("size")).first()[0] or 1
    out = []
    while True:
        out.append(written(_blocks(nodes, arity, levels), "blocks"))
        if left <= arity**levels:
            return out
        left = -(-left // arity**levels)
        fewer = F.ceil(F.col("size") / arity**levels).cast("long")
        nodes = out[-1].select("tree", fewer.alias("size"), F.struct(F.col("block").alias("pos"), "digest").alias("node"))


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """A row for each arity ** levels nodes of a tree, with the preimages of the levels above them.

    A tree that has fewer nodes than a block takes as many levels as it needs, none for one node.
    """
    bottom = arity**levels
    grouped = nodes.groupBy("tree", F.expr(f"node.pos div {bottom}").alias("block")).agg(F.max("size").alias("size"), F.array_sort(F.collect_list("node")).alias("nodes"))
    height = sum(((F.col("size") > arity**k).cast("int") for k in range(1, levels)), (F.col("size") > 1).cast("int"))
    out = grouped.withColumn("_height", height).withColumn("_d0", F.transform("nodes", lambda n: n["digest"]))
    for k in range(1, levels + 1):
        below, needed = F.col(f"_d{k - 1}"), F.col("_height") >= k
        out = out.withColumn(f"_p{k}", F.when(needed, _preimages(below, arity)))
        out = out.withColumn(f"_d{k}", F.when(needed, F.transform(f"_p{k}", lambda p: F.sha2(p, 256))).otherwise(below))
    kept = F.filter(F.array(*(f"_p{k}" for k in range(1, levels + 1))), lambda p: p.isNotNull())
    return out.select("tree", "block", "size", "nodes", kept.alias("preimages"), F.get(f"_d{levels}", F.lit(0)).alias("digest"))


def _preimages(digests: Column, arity: int) -> Column:
    """The concatenated digests of each run of ``arity``."""
    last = F.floor((F.size(digests) - 1) / arity).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(digests, i * arity + 1, F.lit(arity)), ""))


def _descended(rounds: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """(tree, node, path, and more of above) of all nodes of the first round; above has (tree, block, upper) of the last one's."""
    more = [c for c in above.columns if c not in ("tree", "block", "upper")]
    for i, blocks in enumerate(reversed(rounds)):
        if i:
            above = below.select("tree", F.col("node.pos").alias("block"), F.col("path").alias("upper"), *more)
        met = blocks.select("tree", "block", "nodes", "preimages").join(above, ["tree", "block"])
        at = met.select("tree", F.posexplode("nodes").alias("_j", "node"), "preimages", "upper", *more)
        step = lambda p, k: F.struct(
            F.get(p, F.floor(F.col("_j") / F.pow(F.lit(arity), k + 1)).cast("int")).alias("preimage"), (F.floor(F.col("_j") / F.pow(F.lit(arity), k)) % arity).cast("int").alias("slot")
        )
        below = at.select("tree", "node", F.concat(F.transform("preimages", step), "upper").alias("path"), *more)
    return below


def verified_documents(docs: DataFrame, changed: Column | None = None, every: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Trees are by lang and ordered by doc_id. ``changed`` says which rows are tampered with, by default
    those whose doc_id's crc32 (of its decimal digits) ``every`` divides; it adds one to
    n_chars. A tampered leaf is hashed in the same scan and folded with the siblings of the untampered
    tree, so ``verified`` is false for it.

    Null fields are hashed as ``-``, a null lang is a tree of its own and comes first, a null doc_id
    comes first in its tree and is not tampered with, nor is a null n_chars. Equal rows are leaves
    of their own with equal digests; whichever of them stands first, rows are the same as a whole.
    Empty and very long texts are hashed like any other; an empty table gives no rows; other
    columns are not read.
    """
    if changed is None:
        changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    tampered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    other = F.when(changed & F.col("n_chars").isNotNull(), record(tampered))
    built = manifest(docs, "lang", ["doc_id"], record([F.col(c) for c in FIELDS]), {"doc_id": F.col("doc_id"), "other": other})
    out = built.paths().withColumn("folded_root", folded(F.coalesce("other", "digest"), F.col("path")))
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
