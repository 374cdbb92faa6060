"""Versioned datasets on Parquet: push, build and pull over immutable numbered revisions.

A dataset is a folder. `data/version=n-run/table=t/...` holds what a run wrote; `states/revision=n/attempt=run` is the
complete state after revision n: one row (table, partition, version, run_id, n_rows, digest, path) for each pair of
table and partition. The one small file `commits/n.json` names the run whose state counts, with its contracts and
inputs: writing it publishes the revision. It can be created only once, so of two publishers of one number one fails,
a reader sees a revision whole or not at all, and what a run that died before it has left is never read. All data work
is Spark jobs; the driver only handles state rows, of which there is one per pair.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import commits
from tessera.contract import TableContract, assert_exact_schema, empty, evolve, padded
from tessera.errors import TesseraError
from tessera.functions.order import content_digest
from tessera.functions.widening import conform
from tessera.operators import checks, versions
from tessera.plans.identity import digest_of
from tessera.plans.selection import choose

STATE = "table string, partition string, version long, run_id string, n_rows long, digest string, path string"
NOTE = "revision long, run_id string, reason string, inputs string, contracts string, at_us long"
#: Times that a push starts over because others published what it doesn't touch.
ATTEMPTS = 5


@dataclass(frozen=True)
class Published:
    revision: int
    changed: bool


class Dataset:
    """One dataset under `root`."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark, self.name, self.path = spark, name, f"{root.rstrip('/')}/{name}"

    # States and history

    def history(self) -> DataFrame:
        """The states of all revisions, with `revision`."""
        if not commits.exists(self.spark, f"{self.path}/states"):
            return self.spark.createDataFrame([], f"{STATE}, revision long")
        rows = self.spark.read.schema(f"{STATE}, revision long, attempt string").parquet(f"{self.path}/states")
        counted = self.notes().select("revision", F.col("run_id").alias("attempt"))
        return rows.join(counted, ["revision", "attempt"]).select(*[c.split()[0] for c in STATE.split(", ")], "revision")

    def notes(self) -> DataFrame:
        """One row per revision: run_id, reason, inputs and contracts as JSON, time of publication."""
        if commits.exists(self.spark, f"{self.path}/commits"):
            rows = self.spark.read.schema(NOTE).json(f"{self.path}/commits")
        else:
            rows = self.spark.createDataFrame([], NOTE)
        return rows.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")

    def latest(self) -> int:
        """The newest revision; 0, the empty state, if there is none."""
        return self.notes().agg(F.max("revision")).first()[0] or 0

    def resolve(self, revision: int | str = "latest") -> int:
        if revision == "latest":
            return self.latest()
        if revision != 0 and self.notes().where(F.col("revision") == revision).isEmpty():
            raise TesseraError("NOT_FOUND", f"{self.name} has no revision {revision}")
        return int(revision)

    def state(self, revision: int | str = "latest") -> DataFrame:
        return self.history().where(F.col("revision") == self.resolve(revision)).drop("revision")

    def contracts(self, revision: int | str = "latest") -> dict[str, TableContract]:
        row = self.notes().where(F.col("revision") == self.resolve(revision)).select("contracts").first()
        found = json.loads(row[0]) if row else {}
        return {t: TableContract(tuple(map(tuple, c["columns"])), tuple(c["partition_keys"])) for t, c in found.items()}

    # Publishing

    def push(self, tables: dict[str, tuple[DataFrame, TableContract]], not_null: dict[str, list[str]] | None = None, drop: tuple[str, ...] = (), reason: str = "push", inputs: dict | None = None, infer_omissions: bool = True, selection: dict | None = None, base: int | None = None) -> Published:
        """Publish a full snapshot of the given tables.

        Partitions with unchanged content keep their version; partitions of given tables that are gone are omitted;
        a state equal to the base publishes nothing. Tables of the base that are neither given nor dropped are a
        conflict, found before any data is read. `base` is the revision that the caller's data go back to (the latest
        at the start, if not given): pairs that this push writes or omits, and that a revision after it has touched,
        are a conflict, even if they look the same again. Other publications meanwhile are built upon.
        """
        since = self.latest() if base is None else self.resolve(base)
        written, run, folder = None, uuid.uuid4().hex, f"{self.path}/data"
        for _ in range(ATTEMPTS):
            number_before = self.latest()
            before = self.state(number_before)
            if infer_omissions and (left := [r[0] for r in versions.undeclared(before, list(tables), list(drop)).limit(20).collect()]):
                raise TesseraError("STATE_CONFLICT", f"tables {left} are neither declared nor dropped")
            known = self.contracts(number_before)
            contracts = {**{t: c for t, c in known.items() if t not in drop}, **{t: evolve(known.get(t), c) for t, (_, c) in tables.items()}}
            number = number_before + 1
            if written is None:  # one row per partition of what was written
                written = [r for t, (df, c) in tables.items() for r in self._write(t, df, c, f"{folder}/version={number}-{run}", run, (not_null or {}).get(t, []))]
            captured = self.spark.createDataFrame([(*r[:2], number, *r[2:]) for r in written], STATE)
            if selection:
                captured = self._selected(before, captured, selection, number, run)
                dropped = {tuple(x) for x in selection.get("drop", ())}
            else:
                dropped = set()
            after = versions.reuse(before, captured)
            paths = before.select(*versions.PAIR, F.col("path").alias("_path"), F.col("run_id").alias("_run"))
            pick = lambda name, old: F.when(F.col("reused"), F.col(old)).otherwise(F.col(name)).alias(name)
            after = after.join(paths, versions.PAIR, "left").select("table", "partition", "version", pick("run_id", "_run"), "n_rows", "digest", pick("path", "_path"), "reused")
            untouched = before.where(~F.col("table").isin([*drop])).join(captured.select(*versions.PAIR), versions.PAIR, "left_anti")
            if infer_omissions:
                untouched = untouched.where(~F.col("table").isin(list(tables)))
            if dropped:
                untouched = untouched.join(self.spark.createDataFrame(list(dropped), "table string, partition string"), versions.PAIR, "left_anti")
            touched = after.where(~F.col("reused")).select(*versions.PAIR)
            touched = touched.unionByName(before.join(captured, versions.PAIR, "left_anti").join(untouched, versions.PAIR, "left_anti").select(*versions.PAIR))
            if since < number_before and (hit := versions.conflicts(self.history(), since, touched).limit(20).collect()):
                raise TesseraError("STATE_CONFLICT", f"changed since revision {since}: {sorted({(r['table'], r['partition']) for r in hit})}")
            state = after.drop("reused").unionByName(untouched.select(*after.drop("reused").columns))
            paths = {(r[0], r[1]): r[5] for r in written}
            if number_before and versions.same_state(before, state) and contracts == known:
                self._forget(paths.values())
                return Published(number_before, False)
            unchanged = [paths[r["table"], r["partition"]] for r in after.where("reused").select(*versions.PAIR).collect() if (r["table"], r["partition"]) in paths]
            try:
                self._publish(number, state, contracts, run, reason, inputs or {})
            except TesseraError:
                continue  # another run published this number: look at what it did, and build upon it
            self._forget(unchanged)
            return Published(number, True)
        raise TesseraError("STATE_CONFLICT", f"others published {ATTEMPTS} times meanwhile")

    def _forget(self, paths: Iterable[str]) -> None:
        """Delete partitions that this run wrote and that no state names, as their content was there already."""
        for path in paths:
            commits.remove(self.spark, path)

    def _selected(self, before: DataFrame, captured: DataFrame, selection: dict, number: int, run: str) -> DataFrame:
        """The captured rows that a build selection lets in, with empty versions of the pairs it empties."""
        empties = [tuple(x) for x in selection.get("empty", ())]
        chosen = choose(before, captured, number=number, **{k: [tuple(x) for x in v] if isinstance(v, (list, tuple)) else v for k, v in selection.items()})
        rows = captured.join(chosen.select(*versions.PAIR, "version"), [*versions.PAIR, "version"], "left_semi")
        if empties:
            made = []
            for table, partition in empties:
                contract, path = self.contracts()[table], f"{self.path}/data/version={number}-{run}/empty={len(made)}"
                empty(self.spark, contract).write.mode("overwrite").parquet(path)
                made.append((table, partition, number, run, 0, "empty", path))
            rows = rows.unionByName(self.spark.createDataFrame(made, STATE))
        return rows

    def rollback(self, to: int, reason: str = "rollback") -> Published:
        """A new revision with the state of an older one."""
        number, run = self.latest() + 1, uuid.uuid4().hex
        self._publish(number, self.state(self.resolve(to)), self.contracts(to), run, reason, {})
        return Published(number, True)

    def build(self, inputs: dict[str, tuple[Dataset, str, int | str]], outputs: dict[str, tuple[str, TableContract]], not_null: dict[str, list[str]] | None = None, reason: str = "build", selection: dict | None = None) -> Published:
        """Publish the results of one SELECT per output over fixed input revisions.

        `inputs` maps an alias to (dataset, table, revision); the SQL reads `input_<alias>`, and `self_<table>` for
        this dataset's own base, and nothing else. Input revisions are resolved once and recorded with the revision.
        A dataset that this one already goes into is refused as an input. `selection` (see `plans.selection.choose`)
        says which of the made pairs enter the state.
        """
        fixed = {a: (d, t, d.resolve(r)) for a, (d, t, r) in inputs.items()}
        base = self.latest()
        for alias, (dataset, _, _) in fixed.items():
            if (way := dataset.goes_back_to(self.path)) is not None:
                raise TesseraError("INVALID_DECLARATION", f"input {alias} goes back to this dataset: {' <- '.join(way)}")
        session = own_session(self.spark)
        for alias, (dataset, table, revision) in fixed.items():
            dataset.within(session).read(table, revision).createOrReplaceTempView(f"input_{alias}")
        for table in self.contracts(base):
            self.within(session).read(table, base).createOrReplaceTempView(f"self_{table}")
        allowed = {f"input_{a}" for a in fixed} | {f"self_{t}" for t in self.contracts(base)}
        made = {t: (conform(session.sql(checks.one_select(sql, allowed)), contract), contract) for t, (sql, contract) in outputs.items()}
        cited = {a: {"dataset": d.name, "path": d.path, "table": t, "revision": r} for a, (d, t, r) in fixed.items()}
        return self.push(made, not_null, reason=reason, inputs=cited, infer_omissions=False, selection=selection, base=base)

    def within(self, session: SparkSession) -> Dataset:
        """This dataset, read by another session of the same application."""
        other = copy.copy(self)
        other.spark = session
        return other

    def provenance(self, revision: int | str = "latest") -> DataFrame:
        """(alias, dataset, path, table, input_revision) of the inputs of the runs that a revision's versions are of."""
        runs = self.state(revision).select("run_id").distinct()
        fields = "dataset string, path string, table string, revision long"
        found = self.notes().join(runs, "run_id", "left_semi").select(F.explode(F.from_json("inputs", f"map<string, struct<{fields}>>")).alias("alias", "i"))
        return found.select("alias", "i.dataset", "i.path", "i.table", F.col("i.revision").alias("input_revision")).distinct()

    def goes_back_to(self, path: str) -> list[str] | None:
        """The paths from this dataset back to `path` by the inputs of current states, breadth first; None if there are none."""
        todo, seen = [(self.path, [self.path])], {self.path}
        while todo:
            at, way = todo.pop(0)
            if at == path:
                return way
            root, _, name = at.rpartition("/")
            for row in Dataset(self.spark, root, name).provenance().select("path").distinct().collect():
                if row["path"] not in seen:
                    seen.add(row["path"])
                    todo.append((row["path"], [*way, row["path"]]))
        return None

    def _write(self, table: str, df: DataFrame, contract: TableContract, place: str, run: str, not_null: list[str]) -> list[tuple]:
        """Write a table's partitions once, check and digest what was written; (table, partition, run_id, n_rows,
        digest, path) of each."""
        assert_exact_schema(df, contract)
        folder = f"{place}/table={table}"
        keys = contract.partition_columns
        parts = df.withColumns({f"k{i}": F.col(c) for i, c in enumerate(keys)}) if keys else df
        if keys:  # rows of a partition come together; Spark splits large ones and joins small ones by their measured sizes
            parts = parts.hint("rebalance", *[f"k{i}" for i in range(len(keys))])
        writer = parts.write.mode("errorifexists")
        (writer.partitionBy(*[f"k{i}" for i in range(len(keys))]) if keys else writer).parquet(folder)
        back = self.spark.read.schema(contract.schema).option("recursiveFileLookup", "true").parquet(folder)
        shown = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), F.col(f"_{k}_")) for k in contract.partition_keys]) if keys else F.lit("")
        sub = F.concat(*[F.concat(F.lit(f"/k{i}="), F.col(c)) for i, c in enumerate(keys)]) if keys else F.lit("")
        rules = {**checks.not_null(not_null), **checks.partition_names(keys)}
        found = content_digest(back.withColumns({"_p": shown, "_sub": sub}), ["_p", "_sub"], df.columns, {n: F.count_if(c) for n, c in rules.items()}).collect()  # one row per partition
        if broken := {n: v for n in rules if (v := sum(r[n] for r in found))}:
            raise TesseraError("INVALID_ARGUMENT", f"rows that break a rule: {broken}")
        rows = [(table, r["_p"], run, r["n_rows"], r["digest"], folder + (r["_sub"] or "")) for r in found]
        return rows if rows or keys else [(table, "", run, 0, "empty", folder)]  # an empty table is an empty version, not an omission

    def _publish(self, number: int, state: DataFrame, contracts: dict[str, TableContract], run: str, reason: str, inputs: dict) -> None:
        shown = json.dumps({t: {"columns": c.columns, "partition_keys": c.partition_keys} for t, c in contracts.items()})
        state.select(*[c.split()[0] for c in STATE.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/states/revision={number}/attempt={run}")
        note = {"revision": number, "run_id": run, "reason": reason, "inputs": json.dumps(inputs), "contracts": shown, "at_us": time.time_ns() // 1000}
        if not commits.commit(self.spark, f"{self.path}/commits/{number}.json", json.dumps(note) + "\n"):
            raise TesseraError("STATE_CONFLICT", f"revision {number} of {self.name} was published by another run")

    # Reading

    def read(self, table: str, revision: int | str = "latest", partitions: list[dict[str, str]] | None = None) -> DataFrame:
        """A table of a revision; only files of the named partitions are opened (None: all, []: none).

        Older files lack trailing columns that the table gained later: they are typed nulls.
        """
        number = self.resolve(revision)
        contract = self.contracts(number).get(table)
        if contract is None:
            raise TesseraError("NOT_FOUND", f"{self.name} has no table {table} in revision {number}")
        rows = self.state(number).where(F.col("table") == table)
        if partitions is not None:
            for p in partitions:
                if sorted(p) != sorted(contract.partition_keys):
                    raise TesseraError("INVALID_ARGUMENT", f"a partition of {table} has the keys {contract.partition_keys}")
            rows = rows.where(F.col("partition").isin(["/".join(f"{k}={p[k]}" for k in contract.partition_keys) for p in partitions]))
        paths = [r["path"] for r in rows.select("path").collect()]  # one row per partition of the table
        if not paths:
            return empty(self.spark, contract)
        return padded(self.spark.read.schema(contract.schema).parquet(*paths), contract)

    def diff(self, old: int, new: int | str = "latest") -> DataFrame:
        return versions.diff(self.state(old), self.state(new))

    def log(self, limit: int = 20) -> DataFrame:
        own = versions.change_log(self.history(), limit)
        return own.join(self.notes().select("revision", "run_id", "reason", "at"), "revision").orderBy(F.desc("revision"))

    def ls(self, revision: int | str = "latest") -> DataFrame:
        """Tables of a revision: table, partitions, n_rows, columns."""
        kept = [(t, [f"{n} {k}" for n, k in c.columns]) for t, c in self.contracts(revision).items()]
        columns = self.spark.createDataFrame(kept, "table string, columns array<string>")
        sums = self.state(revision).groupBy("table").agg(F.count("*").alias("partitions"), F.sum("n_rows").alias("n_rows"))
        return columns.join(sums, "table", "left").select("table", F.coalesce("partitions", F.lit(0)).alias("partitions"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "columns")

    def show(self, revision: int | str = "latest") -> DataFrame:
        """Every pair of a revision with its version and the run that wrote it: when, why, from which inputs."""
        number = self.resolve(revision)
        runs = self.notes().select("run_id", F.col("revision").alias("written_in"), "reason", "inputs", "at")
        return self.state(number).join(runs, "run_id", "left").select(F.lit(number).alias("revision"), F.lit(max(number - 1, 0)).alias("predecessor"), *versions.PAIR, "version", "n_rows", "digest", "run_id", "written_in", "reason", "inputs", "at")

    def status(self) -> DataFrame:
        """One row: revision, tables, partitions, n_rows, pins, and attempts that never published."""
        number, state = self.latest(), self.state()
        tried = 0
        if commits.exists(self.spark, f"{self.path}/states"):
            rows = self.spark.read.schema("revision long, attempt string").parquet(f"{self.path}/states").distinct()
            tried = rows.join(self.notes().select("revision", F.col("run_id").alias("attempt")), ["revision", "attempt"], "left_anti").count()
        sums = state.agg(F.count_distinct("table").alias("tables"), F.count("*").alias("partitions"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
        return sums.select(F.lit(number).alias("revision"), "*", F.lit(self.pins().count()).alias("pins"), F.lit(tried).alias("unpublished"))

    # Retention

    def pins(self) -> DataFrame:
        """Live pins (pin_id, revision): pinned and not released since."""
        kinds = "pin_id string, revision long, released boolean"
        there = commits.exists(self.spark, f"{self.path}/pins")
        rows = self.spark.read.schema(kinds).option("recursiveFileLookup", "true").json(f"{self.path}/pins") if there else self.spark.createDataFrame([], kinds)
        return rows.groupBy("pin_id").agg(F.max("revision").alias("revision"), F.bool_or("released").alias("released")).where("NOT released").drop("released")

    def pin(self, revision: int | str, pin_id: str) -> None:
        """Keep a revision; the same id pins only once, and a released id never again."""
        number = self.resolve(revision)
        if not commits.commit(self.spark, f"{self.path}/pins/{pin_id}/pin.json", json.dumps({"pin_id": pin_id, "revision": number, "released": False})):
            if self.pins().where((F.col("pin_id") == pin_id) & (F.col("revision") == number)).isEmpty():
                raise TesseraError("REQUEST_MISMATCH", f"pin {pin_id} was used for another revision or released")

    def unpin(self, pin_id: str) -> None:
        row = self.pins().where(F.col("pin_id") == pin_id).first()
        if row is not None:
            commits.commit(self.spark, f"{self.path}/pins/{pin_id}/release.json", json.dumps({"pin_id": pin_id, "revision": row["revision"], "released": True}))

    def gc(self, grace_seconds: int = 0, holds: DataFrame | None = None) -> DataFrame:
        """Every version in the history with its class, the reasons that keep it, and its bytes on disk.

        Classes: AlreadyPruned, Protected (by the latest revision, the grace period or a pin), NeedsHoldRelease (by
        nothing but holds, a table with `revision`), NeedsRecovery (written by an attempt that never published; the
        attempt has to be known to be dead before its files go) and Eligible.
        """
        newer = F.lead("at").over(Window.orderBy("revision"))  # one row per revision
        revisions = self.notes().select("revision", newer.alias("superseded_at"))
        none = self.spark.createDataFrame([], "revision long")
        own, held = self.history(), (holds if holds is not None else none).select("revision")
        kept = versions.kept_revisions(revisions, F.current_timestamp(), grace_seconds, self.pins(), none)
        reasons = revisions.where(F.col("superseded_at").isNull()).select("revision", F.lit("latest").alias("reason"))
        reasons = reasons.unionByName(kept.join(self.pins(), "revision", "left_anti").join(reasons, "revision", "left_anti").select("revision", F.lit("grace").alias("reason")))
        reasons = reasons.unionByName(self.pins().select("revision", F.lit("pin").alias("reason"))).unionByName(held.select("revision", F.lit("hold").alias("reason")))
        key = [*versions.PAIR, "version"]
        why = own.join(reasons, "revision").groupBy(*key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
        found = versions.gc_candidates(own.select(*key, "path").distinct(), own, kept.unionByName(held).distinct(), self.pruned())
        found = found.join(why, key, "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
        only_held = (F.size("reasons") == 1) & F.array_contains("reasons", "hold") & (F.col("class") == "Protected")
        found = found.withColumn("class", F.when(only_held, "NeedsHoldRelease").otherwise(F.col("class")))
        bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
        if commits.exists(self.spark, f"{self.path}/data"):
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/data").select("path", "length")
            sizes = files.groupBy(bare(F.regexp_replace("path", "/[^/]*$", "")).alias("_at")).agg(F.sum("length").alias("bytes"))
        else:
            sizes = self.spark.createDataFrame([], "_at string, bytes long")
        known = found.withColumn("_at", bare(F.col("path"))).join(sizes, "_at", "full_outer")
        stray = F.col("class").isNull()
        return known.select(
            F.when(stray, F.regexp_extract("_at", "/table=([^/]*)", 1)).otherwise(F.col("table")).alias("table"), F.when(stray, "").otherwise(F.col("partition")).alias("partition"), "version",
            F.when(stray, F.col("_at")).otherwise(F.col("path")).alias("path"), F.when(stray, "NeedsRecovery").otherwise(F.col("class")).alias("class"), "reasons", F.coalesce("bytes", F.lit(0)).alias("bytes"),
        )

    def pruned(self) -> DataFrame:
        """Versions (table, partition, version) whose files were deleted, or are about to be."""
        kinds = "table string, partition string, version long"
        return self.spark.read.schema(kinds).parquet(f"{self.path}/pruned") if commits.exists(self.spark, f"{self.path}/pruned") else self.spark.createDataFrame([], kinds)

    def prune(self, grace_seconds: int = 0, holds: DataFrame | None = None) -> int:
        """Delete the files of eligible versions; how many versions.

        The versions are written down before anything is deleted, and checked again after that: a pin set meanwhile
        keeps its own. A prune that died midway is ended by the next.
        """
        first = self.gc(grace_seconds, holds).where("class = 'Eligible'").select(*versions.PAIR, "version", "path").collect()  # one row per version
        again = self.gc(grace_seconds, holds).where("class = 'Eligible'").select("path").distinct()
        still = {r["path"] for r in again.collect()}
        gone = [r for r in first if r["path"] in still]
        if gone:
            self.spark.createDataFrame([(r["table"], r["partition"], r["version"]) for r in gone], "table string, partition string, version long").coalesce(1).write.mode("append").parquet(f"{self.path}/pruned")
        for path in {r["path"] for r in gone} | {r["path"] for r in self.gc().where("class = 'AlreadyPruned' AND bytes > 0").select("path").collect()}:
            commits.remove(self.spark, path)
        return len(gone)

    def verify(self, revision: int | str = "latest") -> DataFrame:
        """State rows whose files no longer have the recorded content."""
        found = None
        for table, contract in self.contracts(revision).items():
            df = self.read(table, revision)
            shown = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), F.col(f"_{k}_")) for k in contract.partition_keys]) if contract.partition_keys else F.lit("")
            now = content_digest(df.withColumn("_p", shown), ["_p"], df.columns).select(F.lit(table).alias("table"), F.col("_p").alias("partition"), F.col("digest").alias("now"))
            found = now if found is None else found.unionByName(now)
        state = self.state(revision)
        if found is None:
            return state
        return state.join(found, versions.PAIR, "left").where((F.col("n_rows") > 0) & ~F.col("digest").eqNullSafe(F.col("now")))


def own_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the same settings and no views: its names clash with nobody's."""
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            session.conf.set(name, value)
    return session


class Destination:
    """Tables that pulls write. Each pull writes new generations of its tables, then one receipt that names them all;
    readers follow the newest receipt, so a pull is seen whole or not at all, and a repeated attempt finds its receipt.
    A receipt says for each target which folders make it up and which dataset it is of."""

    RECEIPT = "n long, attempt string, request string, generations map<string,array<string>>, owners map<string,string>, at_us long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def receipts(self) -> DataFrame:
        there = commits.exists(self.spark, f"{self.path}/receipts")
        return self.spark.read.schema(self.RECEIPT).json(f"{self.path}/receipts") if there else self.spark.createDataFrame([], self.RECEIPT)

    def _newest(self) -> tuple[int, dict[str, list[str]], dict[str, str]]:
        row = self.receipts().orderBy(F.desc("n")).select("n", "generations", "owners").first()
        return (row["n"], {t: list(p) for t, p in row["generations"].items()}, dict(row["owners"])) if row else (0, {}, {})

    def generations(self) -> dict[str, list[str]]:
        return self._newest()[1]

    def read(self, table: str, contract: TableContract) -> DataFrame:
        paths = self.generations().get(table)
        return padded(self.spark.read.schema(contract.schema).parquet(*paths), contract) if paths else empty(self.spark, contract)

    def pull(self, source: Dataset, plan: dict[str, dict], revision: int | str = "latest", write: str = "replace", not_null: dict[str, list[str]] | None = None, attempt: str | None = None) -> dict[str, list[str]]:
        """Write targets from a revision. `plan` maps a target to {table, partitions?, sql?, contract}.

        SQL reads `source_<table>` and `target_<target>`, the rows before any write, and nothing else: all results
        are written to new generations before the receipt makes any of them visible. `write` is `replace`, which also
        clears targets that an earlier pull of the same dataset wrote and this plan no longer names, or `append`,
        which adds a folder to the target and reads or writes nothing again.
        """
        number = source.resolve(revision)
        request = digest_of({"dataset": source.name, "revision": number, "write": write, "plan": {t: {k: v for k, v in p.items() if k != "contract"} for t, p in plan.items()}})
        attempt = attempt or uuid.uuid4().hex
        if (done := self.receipts().where(F.col("attempt") == attempt).first()) is not None:
            if done["request"] != request:
                raise TesseraError("REQUEST_MISMATCH", "the attempt was made with another request")
            return {t: list(p) for t, p in done["generations"].items()}
        if write not in ("replace", "append"):
            raise TesseraError("INVALID_ARGUMENT", f"no such write mode: {write}")
        n, before, owners = self._newest()
        if taken := [t for t in plan if owners.get(t, source.path) != source.path]:
            raise TesseraError("STATE_CONFLICT", f"targets {taken} are of another dataset")
        session = own_session(self.spark)
        for target, p in plan.items():
            source.within(session).read(p["table"], number, p.get("partitions")).createOrReplaceTempView(f"source_{p['table']}")
            rows = session.read.schema(p["contract"].schema).parquet(*before[target]) if before.get(target) else empty(session, p["contract"])
            padded(rows, p["contract"]).createOrReplaceTempView(f"target_{target}")
        allowed = {f"source_{p['table']}" for p in plan.values()} | {f"target_{t}" for t in plan}
        made = {}
        for target, p in plan.items():
            rows = session.sql(checks.one_select(p["sql"], allowed)) if p.get("sql") else session.table(f"source_{p['table']}")
            path = f"{self.path}/generations/{attempt}/{target}"
            conform(rows, p["contract"]).write.mode("overwrite").parquet(path)
            checks.require(self.spark.read.schema(p["contract"].schema).parquet(path), checks.not_null((not_null or {}).get(target, [])) or {"none": F.lit(False)})
            made[target] = [*before.get(target, []), path] if write == "append" else [path]
        if write == "replace":
            gone = {t for t, o in owners.items() if o == source.path and t not in plan}
            before, owners = {t: p for t, p in before.items() if t not in gone}, {t: o for t, o in owners.items() if t not in gone}
        after = {**before, **made}
        receipt = {"n": n + 1, "attempt": attempt, "request": request, "generations": after, "owners": {**owners, **dict.fromkeys(plan, source.path)}, "at_us": time.time_ns() // 1000}
        if not commits.commit(self.spark, f"{self.path}/receipts/{n + 1}.json", json.dumps(receipt) + "\n"):
            raise TesseraError("STATE_CONFLICT", "another pull wrote the destination meanwhile")
        return after
