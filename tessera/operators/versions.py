"""Algebra of revisions. A state has one row (table, partition, version, ...) for each pair of table and partition.

A history is the states of all revisions with a `revision` column. All of it is joins, windows and groupings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["table", "partition"]


def diff(old: DataFrame, new: DataFrame, value: str = "version") -> DataFrame:
    """Pairs that were added, removed or changed."""
    a, b = old.select(*PAIR, F.col(value).alias("old")), new.select(*PAIR, F.col(value).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, PAIR, "full_outer").withColumn("change", change).where(F.col("change").isNotNull())


def summary(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])


def reuse(base: DataFrame, captured: DataFrame) -> DataFrame:
    """`captured` (table, partition, version, digest) with the base's version wherever the content is the same."""
    old = base.select(*PAIR, F.col("version").alias("_v"), F.col("digest").alias("_d"))
    same = F.col("_d") == F.col("digest")
    return captured.join(old, PAIR, "left").withColumn("reused", F.coalesce(same, F.lit(False))).withColumn("version", F.when(F.col("reused"), F.col("_v")).otherwise(F.col("version"))).drop("_v", "_d")


def omissions(base: DataFrame, captured: DataFrame, declared: list[str]) -> DataFrame:
    """Partitions of declared tables that the base has and the capture hasn't."""
    return base.where(F.col("table").isin(declared)).join(captured.select(*PAIR), PAIR, "left_anti").select(*PAIR)


def undeclared(base: DataFrame, declared: list[str], dropped: list[str]) -> DataFrame:
    """Tables of the base that are neither declared nor dropped: a push with any of them is refused."""
    return base.select("table").distinct().where(~F.col("table").isin([*declared, *dropped]))


def apply_changes(base: DataFrame, written: DataFrame, omitted: DataFrame, selected: DataFrame) -> DataFrame:
    """Base, overlaid with each pair's latest written version, less omissions, overlaid with explicit selections."""
    latest = written.groupBy(*PAIR).agg(F.max("version").alias("version"))
    kept = base.select(*PAIR, "version").join(latest, PAIR, "left_anti").unionByName(latest)
    kept = kept.join(omitted.select(*PAIR), PAIR, "left_anti").join(selected.select(*PAIR), PAIR, "left_anti")
    return kept.unionByName(selected.select(*PAIR, "version"))


def same_state(a: DataFrame, b: DataFrame) -> bool:
    """Whether two states are equal."""
    own = [*PAIR, "version"]
    return a.select(*own).exceptAll(b.select(*own)).isEmpty() and b.select(*own).exceptAll(a.select(*own)).isEmpty()


def transitions(history: DataFrame) -> DataFrame:
    """(revision, table, partition, before, after) for every change between consecutive revisions.

    Pairs that vanish and return show both changes, so a value that comes back is not taken for one that stayed.
    """
    revisions = history.select("revision").distinct().withColumn("_next", F.lead("revision").over(Window.orderBy("revision")))
    old = history.select("revision", *PAIR, F.col("version").alias("before")).join(F.broadcast(revisions), "revision").where(F.col("_next").isNotNull())
    old = old.select(F.col("_next").alias("revision"), *PAIR, "before")
    first = F.broadcast(revisions.agg(F.min("revision").alias("_first")))
    new = history.select("revision", *PAIR, F.col("version").alias("after")).join(first, F.col("revision") > F.col("_first")).drop("_first")
    return old.join(new, ["revision", *PAIR], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def conflicts(history: DataFrame, base: int, contributed: DataFrame) -> DataFrame:
    """Contributed pairs that any revision after `base` has touched, even if they look the same again."""
    return transitions(history.where(F.col("revision") >= base)).join(contributed.select(*PAIR), PAIR).select("revision", *PAIR, "before", "after")


def change_log(history: DataFrame, limit: int = 20) -> DataFrame:
    """Newest revisions first, with the counts of their changes."""
    count = lambda c: F.count_if(c)
    changes = transitions(history).groupBy("revision").agg(
        count(F.col("before").isNull()).alias("added"), count(F.col("after").isNull()).alias("removed"),
        count(F.col("before").isNotNull() & F.col("after").isNotNull()).alias("changed"))
    every = history.select("revision").distinct()
    filled = every.join(changes, "revision", "left").select("revision", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("added", "removed", "changed")])
    return filled.orderBy(F.desc("revision")).limit(limit)


def kept_revisions(revisions: DataFrame, now: Column, grace_seconds: int, pins: DataFrame, holds: DataFrame) -> DataFrame:
    """Revisions that stay: the latest, those superseded within the grace period, pinned and held ones.

    `revisions` has (revision, superseded_at); the latest has no such time.
    """
    young = F.col("superseded_at").isNull() | (F.col("superseded_at") > now - F.make_dt_interval(secs=F.lit(grace_seconds)))
    more = pins.select("revision").unionByName(holds.select("revision")).distinct().withColumn("_stay", F.lit(True))
    return revisions.join(more, "revision", "left").where(young | F.col("_stay")).select("revision")


def gc_candidates(versions: DataFrame, history: DataFrame, kept: DataFrame, pruned: DataFrame) -> DataFrame:
    """Every written version with its class: AlreadyPruned, Protected or Eligible."""
    own = [*PAIR, "version"]
    used = history.join(kept, "revision", "left_semi").select(*own).distinct().withColumn("_used", F.lit(True))
    gone = pruned.select(*own).distinct().withColumn("_gone", F.lit(True))
    kind = F.when(F.col("_gone"), "AlreadyPruned").when(F.col("_used"), "Protected").otherwise("Eligible")
    return versions.join(used, own, "left").join(gone, own, "left").withColumn("class", kind).drop("_used", "_gone")
