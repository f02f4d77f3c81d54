"""Runs by their statuses: which changes hold, which are refused, and which runs are stuck.

A change is a function of the status before it: to its own status if that may follow, to the
same status otherwise. Functions of so few statuses compose, so a run with very many changes is split by
time: each split becomes one function, a prefix scan over the splits says with which status each begins, and
splits are then walked on their own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..schemas import INDEX_STATUS
from ..session import removed, written

#: A run that nothing is known of, and the statuses that nothing has to follow: a run in one of them is never stuck.
NONE, RESTING = "", ("READY", "FAILED")
STATUSES = [NONE, *INDEX_STATUS]
CHANGES = "key {key}, tie long, at timestamp_ntz, before string, after string, kind string"


def follows(before: str, after: str) -> bool:
    """Whether a run may go from a status to another: from none to QUEUED, forward by the steps, to FAILED from
    any but READY and none, and back to QUEUED from READY and FAILED."""
    steps = INDEX_STATUS[:-1]
    if after == "QUEUED":
        return before in (NONE, *RESTING)
    if after == "FAILED":
        return before in steps and before != "READY"
    return after in steps and before in steps and steps.index(after) > steps.index(before)


def changes(events: DataFrame, key: str, status: str, at: str, tie: str, stuck_after: str = DEFAULT.stuck_after, until: str | None = None) -> DataFrame:
    """(key, tie, at, before, after, kind): a row for each event and for each stuck run.

    kind is ``held`` or ``refused``, and ``stuck`` for a run that stays in a status that something has to
    follow for longer than ``stuck_after``: at is then when that time is over, tie that of the change
    to the status, and before and after are both the status. Events of a run are in order of at, then tie;
    runs are watched ``until`` a time, that of the last event by default. Unknown and null statuses
    are refused; events without a key or time are left out.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("timestamp_ntz").alias("at"), F.col(tie).cast("long").alias("tie"), F.coalesce(status, F.lit(NONE)).alias("to"))
    placed = written(rows.repartitionByRange("key", "at", "tie").sortWithinPartitions("key", "at", "tie").withColumn("row", F.monotonically_increasing_id()), "in_time").withColumn("part", F.shiftright("row", 33))
    kind = dict(rows.dtypes)["key"]
    parts = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    of_key = Window.partitionBy("key")
    split = written(parts.withColumn("parts", F.count("*").over(of_key)).where("parts > 1").select("key", "part"), "split")  # two a partition at most
    moves = placed.join(F.broadcast(split), ["key", "part"]).groupBy("key", "part").applyInPandas(_composed, f"key {kind}, part long, after array<string>")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    order = {s: i for i, s in enumerate(STATUSES)}
    places = F.transform("after", lambda s: F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), s))
    start = F.aggregate(F.collect_list(places).over(before), F.lit(0), lambda now, move: F.get(move, now))
    begun = written(moves.select("key", "part", F.get(F.array(*map(F.lit, STATUSES)), start).alias("start")), "begun")
    walked = written(placed.join(F.broadcast(begun), ["key", "part"], "left").groupBy("key", "part").applyInPandas(_walked, f"{CHANGES.format(key=kind)}, row long, part long, last boolean"), "walked")
    end = F.lit(until).cast("timestamp_ntz") if until else placed.agg(F.max("at")).first()[0]
    out = walked.where("kind <> 'stuck'").drop("row", "part", "last").unionByName(_stuck(walked, stuck_after, end).select("key", "tie", "at", "before", "after", "kind"))
    removed(split)
    return out


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """What a split makes of each status that it could begin with."""
    found = []
    targets = rows.sort_values("row")["to"]
    for now in STATUSES:
        for to in targets:
            if follows(now, to):
                now = to
        found.append(now)
    return pd.DataFrame({"key": rows["key"].iloc[:1].to_numpy(), "part": rows["part"].iloc[:1].to_numpy(), "after": [found]})


def _walked(rows: pd.DataFrame) -> pd.DataFrame:
    """Every event of a split with what came of it; ``last`` marks the last that held."""
    rows = rows.sort_values("row")
    now = rows["start"].iloc[0]
    now = NONE if now is None or now != now else now
    before, after, kind, last = [], [], [], -1
    for i, to in enumerate(rows["to"]):
        before.append(now)
        if follows(now, to):
            now, last = to, i
        kind.append("held" if last == i else "refused")
        after.append(to)
    out = rows[["key", "tie", "at", "row", "part"]].assign(before=before, after=after, kind=kind, last=[i == last for i in range(len(rows))])
    return out[["key", "tie", "at", "before", "after", "kind", "row", "part", "last"]]


def _stuck(walked: DataFrame, stuck_after: str, end: object) -> DataFrame:
    """A row for each change that held and that no other followed in time. What follows the last of a split
    is the first of the key's next split that has one."""
    held = walked.where("kind = 'held'")
    inside = Window.partitionBy("key", "part").orderBy("row")
    following = held.withColumn("next", F.lead("at").over(inside))
    firsts = held.groupBy("key", "part").agg(F.min_by("at", "row").alias("first"))
    later = firsts.select("key", "part", F.lead("first").over(Window.partitionBy("key").orderBy("part")).alias("after_part"))
    known = following.join(later, ["key", "part"]).withColumn("next", F.coalesce("next", "after_part", F.lit(end).cast("timestamp_ntz")))
    over = F.col("at") + F.expr(f"INTERVAL {stuck_after}")
    return known.where(~F.col("after").isin(*RESTING)).withColumn("at", over).where(F.col("at") < F.col("next")).select("key", "tie", "at", F.col("after").alias("before"), "after", F.lit("stuck").alias("kind"))


