"""Run a declaration: its tables through projection, derived partition columns, filters and checks into a push, a build
or a pull."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.contract import TableContract
from tessera.dataset import Dataset, Destination, Published
from tessera.errors import TesseraError
from tessera.functions.calendar import derive
from tessera.functions.widening import project
from tessera.operators import checks
from tessera.plans.declaration import Declaration, Table


def normalised(rows: DataFrame, table: Table) -> DataFrame:
    """A source's rows as the declared columns: renamed and widened exactly, partition columns derived, rows filtered."""
    if table.source.get("where"):
        rows = checks.row_predicate(rows, table.source["where"])
    if table.contract is None:
        raise TesseraError("INVALID_DECLARATION", f"table {table.name} declares no columns")
    plain = [c for c in table.columns if "derive" not in c]
    made = project(rows, plain)
    for c in table.columns:
        if "derive" in c:
            made = made.withColumn(c["name"], derive(F.col(c["derive"]["from"]), c["derive"]["unit"]))
    return made.select(*table.contract.schema.names)


def push(spark: SparkSession, declaration: Declaration, root: str, sources: dict[str, DataFrame], base: int | None = None) -> Published:
    """Publish the declared tables. A table's source is the one of its `source.table`, or of its own name."""
    if declaration.kind != "push":
        raise TesseraError("INVALID_DECLARATION", f"a {declaration.kind} declaration is no push")
    dataset = Dataset(spark, root, declaration.dataset)
    not_null = {t.name: t.not_null for t in declaration.tables}
    if declaration.inputs:  # alias: dataset/table
        parts = {a: t.split("/") for a, t in declaration.inputs.items()}
        inputs = {a: (Dataset(spark, root, p[0]), p[1], int(p[2]) if len(p) > 2 else "latest") for a, p in parts.items()}
        outputs = {t.name: (t.sql, t.contract) for t in declaration.tables}
        if any(sql is None or contract is None for sql, contract in outputs.values()):
            raise TesseraError("INVALID_DECLARATION", "each table of a build has columns and SQL")
        return dataset.build(inputs, outputs, not_null, selection=declaration.raw["build"].get("select"))
    tables = {}
    for t in declaration.tables:
        name = t.source.get("table", t.name)
        if name not in sources:
            raise TesseraError("NOT_FOUND", f"no source {name}")
        tables[t.name] = (normalised(sources[name], t), t.contract)
    return dataset.push(tables, not_null, drop=tuple(declaration.raw.get("drop") or ()), base=base)


def pull(spark: SparkSession, declaration: Declaration, root: str, destination: Destination, revision: int | str = "latest", attempt: str | None = None) -> dict[str, TableContract]:
    """Write the declared targets; their contracts. A table without columns takes the contract of the revision."""
    if declaration.kind != "pull":
        raise TesseraError("INVALID_DECLARATION", f"a {declaration.kind} declaration is no pull")
    dataset = Dataset(spark, root, declaration.dataset)
    number = dataset.resolve(revision)
    known = dataset.contracts(number)
    plan, contracts = {}, {}
    for t in declaration.tables:
        target, table = t.target or t.name, t.source.get("table", t.name)
        if table not in known:
            raise TesseraError("NOT_FOUND", f"{declaration.dataset} has no table {table} in revision {number}")
        if t.sql and t.contract is None:
            raise TesseraError("INVALID_DECLARATION", f"target {target} has SQL and needs columns")
        contracts[target] = t.contract or known[table]
        plan[target] = {"table": table, "partitions": t.partitions, "sql": t.sql, "contract": contracts[target]}
    destination.pull(dataset, plan, number, declaration.write, {t.target or t.name: t.not_null for t in declaration.tables}, attempt)
    return contracts
