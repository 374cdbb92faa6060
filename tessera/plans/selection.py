"""Build selections: which pairs of a build's outputs enter the next state. `include` needs what was made; `drop`,
`hold` and `empty` say what happens to pairs that weren't. No pair may be named twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.operators.versions import PAIR


def choose(base: DataFrame, made: DataFrame, policy: str = "changed", include: list[tuple[str, str]] = (), drop: list[tuple[str, str]] = (), hold: list[tuple[str, str]] = (), empty: list[tuple[str, str]] = (), number: int | None = None) -> DataFrame:
    """The next state's (table, partition, version).

    `changed`: all made pairs over the base; `all`: the made pairs only; `explicit`: the included made pairs over the
    base. Dropped pairs leave, held pairs keep the base's version, emptied ones get version `number`. A build never
    infers an omission. Included pairs must be among the made ones, emptied ones must not, and no pair is named twice.
    """
    named = [*include, *drop, *hold, *empty]
    if len(set(named)) != len(named):
        raise TesseraError("INVALID_ARGUMENT", "a pair is selected twice")
    if policy not in ("changed", "all", "explicit"):
        raise TesseraError("INVALID_ARGUMENT", f"no such policy: {policy}")
    pairs = lambda rows: F.struct(*PAIR).isin([F.struct(F.lit(t).alias("table"), F.lit(p).alias("partition")) for t, p in rows]) if rows else F.lit(False)
    if empty and number is None:
        raise TesseraError("INVALID_ARGUMENT", "emptied pairs need a version number")
    there = {(r["table"], r["partition"]) for r in made.where(pairs([*include, *empty])).select(*PAIR).collect()}  # of the named pairs only
    if lost := set(include) - there:
        raise TesseraError("INVALID_ARGUMENT", f"included, but not made: {sorted(lost)}")
    if both := set(empty) & there:
        raise TesseraError("INVALID_ARGUMENT", f"emptied, but made: {sorted(both)}")
    new = made.where(~pairs(hold) & ~pairs(drop)).select(*PAIR, "version")
    if policy == "explicit":
        new = new.where(pairs(include))
    old = base.select(*PAIR, "version").where(~pairs(drop))
    if policy == "all":
        old = old.where(pairs(hold))
    if empty:
        new = new.unionByName(made.sparkSession.createDataFrame([(t, p, number) for t, p in empty], "table string, partition string, version long"))
    return old.join(new.select(*PAIR), PAIR, "left_anti").unionByName(new)
