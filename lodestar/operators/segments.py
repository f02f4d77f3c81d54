"""A lexical index that changes: segments that never do, what is gone from them, and states that say which count.

Documents that come make a segment of their own: their tokens, blocks of postings, and document
frequencies. Documents that go are rows of a table beside it, with the frequencies that go with
them, so statistics are sums over segments and need no texts. A state lists the segments and what is
gone; it is written last, in one file, so a reader sees all of a change or none of it.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.text import tokenize
from ..session import cleaned, removed, written
from .layout import hinted
from .lexical import weighed_terms
from .postings import BlockedIndex, frequencies, packed, ranged, write_blocks

_STATE = "version long, body string"


@dataclass(frozen=True)
class Segment:
    """A folder of documents, blocks and terms; how many documents, and tokens, are in it; its folders of what is gone, and their sums."""

    name: str
    docs: int
    length: int
    gone: tuple[str, ...] = ()
    gone_docs: int = 0
    gone_length: int = 0

    @property
    def live(self) -> int:
        return self.docs - self.gone_docs


class SegmentedIndex:
    """An index under a path. ``documents`` are (repository_id, id, range, tokens); an id is there once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- states

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def state(self) -> tuple[int, list[Segment]]:
        """The newest version and its segments; none of a new index."""
        if not self._exists(f"{self.path}/states"):
            return 0, []
        newest = self.spark.read.schema(_STATE).json(f"{self.path}/states").orderBy(F.desc("version")).first()
        return newest["version"], [Segment(**{**s, "gone": tuple(s["gone"])}) for s in json.loads(newest["body"])]

    def _publish(self, version: int, segments: list[Segment]) -> None:
        body = json.dumps([vars(s) for s in segments if s.live > 0])
        self.spark.createDataFrame([(version, body)], _STATE).coalesce(1).write.mode("append").json(f"{self.path}/states")

    # -- reading

    def _tables(self, segments: list[Segment], name: str) -> DataFrame | None:
        found = [self.spark.read.parquet(f"{self.path}/segments/{s.name}/{name}").withColumn("segment", F.lit(s.name)) for s in segments]
        return reduce(DataFrame.unionByName, found) if found else None

    def _gone(self, segments: list[Segment], name: str) -> DataFrame | None:
        found = [self.spark.read.parquet(f"{self.path}/gone/{g}/{name}").where(F.col("segment") == s.name) for s in segments for g in s.gone]
        return reduce(DataFrame.unionByName, found) if found else None

    def documents(self, segments: list[Segment] | None = None) -> DataFrame:
        """(segment, repository_id, id, range, tokens) that are there. Segments that nothing is gone from are read as they are."""
        segments = self.state()[1] if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], "segment string, repository_id string, id string, range long, tokens array<string>")
        whole, broken = [s for s in segments if not s.gone], [s for s in segments if s.gone]
        found = [self._tables(whole, "documents")] if whole else []
        if broken:
            found.append(self._tables(broken, "documents").join(hinted(self._gone(broken, "documents").select("segment", "id")), ["segment", "id"], "left_anti"))
        return reduce(DataFrame.unionByName, found)

    def terms(self, segments: list[Segment] | None = None) -> DataFrame:
        """(term, df) of documents that are there: sums over segments, without what is gone."""
        segments = self.state()[1] if segments is None else segments
        rows, gone = self._tables(segments, "terms"), self._gone(segments, "terms")
        every = rows.select("term", "df") if gone is None else rows.select("term", "df").union(gone.select("term", -F.col("df")))
        return every.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def view(self, config: EngineConfig = DEFAULT) -> BlockedIndex:
        """What ``postings.search`` asks, as of the newest state."""
        _, segments = self.state()
        if not segments:
            raise ValueError("the index is empty")
        n = sum(s.live for s in segments)
        corpus = self.spark.range(1).select(F.lit(n).alias("n"), F.lit(sum(s.length - s.gone_length for s in segments) / n).alias("avgdl"))
        gone = self._gone(segments, "documents")
        return BlockedIndex(self._tables(segments, "blocks"), written(weighed_terms(self.terms(segments), corpus, config), "terms"), corpus, None if gone is None else gone.select("segment", "range", "id"))

    # -- changing

    def insert(self, documents: DataFrame) -> None:
        """Documents (repository_id, id, tokens) come; those whose ids are there already take their place."""
        version, segments = self.state()
        twice = not documents.groupBy("id").count().where("count > 1").isEmpty()  # ids alone
        new = self._segment(documents.dropDuplicates(["id"]) if twice else documents)
        if new is None:
            return
        ids = self.spark.read.parquet(f"{self.path}/segments/{new.name}/documents").select("id")
        self._publish(version + 1, [*self._without(segments, self._those(segments, ids)), new])

    def insert_texts(self, docs: DataFrame, id_col: str, text: str, repository: str) -> None:
        """Tokenize and insert; null ids are left out, a null text is empty."""
        self.insert(docs.where(F.col(id_col).isNotNull()).select(F.col(repository).cast("string").alias("repository_id"), F.col(id_col).alias("id"), tokenize(F.coalesce(text, F.lit(""))).alias("tokens")))

    def delete(self, ids: DataFrame) -> None:
        """Documents with these ids (id) go; ids that aren't there change nothing."""
        version, segments = self.state()
        self._publish(version + 1, self._without(segments, self._those(segments, ids.distinct())))

    def invalidate(self, repository: str) -> None:
        """All documents of a repository go."""
        version, segments = self.state()
        self._publish(version + 1, self._without(segments, self.documents(segments).where(F.col("repository_id") == repository)))

    def merge(self, fan: int = DEFAULT.segment_fan) -> bool:
        """Make one segment of the segments of a tier that has ``fan`` or more; whether there was one. Tiers are powers of ``fan``."""
        version, segments = self.state()
        tiers: dict[int, list[Segment]] = {}
        for s in segments:
            tiers.setdefault(int(math.log(max(s.live, 1), fan) + 1e-9), []).append(s)
        full = [t for _, t in sorted(tiers.items()) if len(t) >= fan]
        if not full:
            return False
        new = self._segment(self.documents(full[0]).drop("segment"))
        self._publish(version + 1, [*(s for s in segments if s not in full[0]), *([new] if new else [])])
        return True

    def vacuum(self) -> list[str]:
        """Delete segments and tables of what is gone that the newest state doesn't name; their names. No reader of an older state may be left."""
        _, segments = self.state()
        kept = {s.name for s in segments} | {g for s in segments for g in s.gone}
        out = []
        for kind in ("segments", "gone"):
            if self._exists(f"{self.path}/{kind}"):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
                files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
                for f in files.listStatus(at):
                    if f.getPath().getName() not in kept:
                        out.append(f.getPath().getName())
                        files.delete(f.getPath(), True)
        return sorted(out)

    def _segment(self, documents: DataFrame) -> Segment | None:
        """Write a segment of documents with unique ids; None if there is nothing to write."""
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        with cleaned(self.spark):
            ranged(documents.select("repository_id", "id", "tokens")).write.parquet(f"{at}/documents")
        rows = self.spark.read.parquet(f"{at}/documents")
        n = rows.count()
        if not n:
            return None
        write_blocks(packed(rows), f"{at}/blocks")
        made = self.spark.read.parquet(f"{at}/blocks")
        with cleaned(self.spark):
            frequencies(made).write.parquet(f"{at}/terms")
        return Segment(name, n, made.agg(F.sum("length")).first()[0] or 0)

    def _those(self, segments: list[Segment], ids: DataFrame) -> DataFrame | None:
        """Documents that have these ids (id), each once. Ids are joined alone, so that no tokens move but those of what is found."""
        if not segments:
            return None
        found = written(self.documents(segments).select("segment", "id").join(hinted(ids.select("id")), "id", "left_semi"), "found")
        here = {r["segment"] for r in found.select("segment").distinct().collect()}  # segments are few
        some = [s for s in segments if s.name in here]
        return self._tables(some, "documents").join(hinted(found), ["segment", "id"], "left_semi") if some else None

    def _without(self, segments: list[Segment], rows: DataFrame | None) -> list[Segment]:
        """The segments after documents are gone: their rows, and the frequencies that go, as tables of their own."""
        if rows is None:
            return segments
        name = uuid.uuid4().hex
        at = f"{self.path}/gone/{name}"
        lost = written(rows.select("segment", "id", "range", "tokens"), "lost")
        sums = {r["segment"]: r for r in lost.groupBy("segment").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("length")).collect()}  # a row a segment
        if sums:
            with cleaned(self.spark):
                lost.select("segment", "id", "range").write.parquet(f"{at}/documents")
                lost.select("segment", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("segment", "term").agg(F.count("*").alias("df")).write.parquet(f"{at}/terms")
        removed(lost)
        change = lambda s: Segment(s.name, s.docs, s.length, (*s.gone, name), s.gone_docs + sums[s.name]["n"], s.gone_length + sums[s.name]["length"])
        return [change(s) if s.name in sums else s for s in segments]
