"""Declarations: strict YAML into a checked record."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from tessera.contract import NAME, TableContract
from tessera.errors import TesseraError
from tessera.types import parse_type

KINDS = ("push", "pull")
MOST_BYTES, MOST_DEPTH = 64 << 20, 64


class _Strict(yaml.SafeLoader):
    """YAML without aliases, tags, merges, repeated or non-text keys; scalars as in YAML's 1.2 core."""

    def compose_node(self, parent, index):  # noqa: ANN001, ANN201
        event = self.peek_event()
        if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None) or (getattr(event, "tag", None) and event.tag != "!"):
            raise TesseraError("INVALID_DECLARATION", "aliases and tags are not allowed")
        return super().compose_node(parent, index)

    def construct_mapping(self, node, deep=False):  # noqa: ANN001, ANN201
        seen = set()
        for key, _ in node.value:
            name = self.construct_object(key, deep=True)
            if not isinstance(name, str) or name == "<<" or name in seen:
                raise TesseraError("INVALID_DECLARATION", f"key {name!r} is repeated or no text")
            seen.add(name)
        return super().construct_mapping(node, deep)


# Scalars of the core schema of YAML 1.2: no yes and no, no octals by a leading zero, no sexagesimals, no underscores.
_Strict.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
    ("bool", r"true|True|TRUE|false|False|FALSE", list("tTfF")),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", list("-+0123456789")),
    ("float", r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)", list("-+0123456789.")),
):
    _Strict.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(f"^(?:{_pattern})$"), _first)


def _whole(loader: _Strict, node: yaml.ScalarNode) -> int:
    text = node.value
    return int(text[2:], 8) if text.startswith("0o") else int(text[2:], 16) if text.startswith("0x") else int(text)


def _number(loader: _Strict, node: yaml.ScalarNode) -> float:
    return float(node.value.replace(".inf", "inf").replace(".Inf", "inf").replace(".INF", "inf").replace(".nan", "nan").replace(".NaN", "nan").replace(".NAN", "nan"))


_Strict.add_constructor("tag:yaml.org,2002:int", _whole)
_Strict.add_constructor("tag:yaml.org,2002:float", _number)


def parse(text: str) -> dict:
    """One strict YAML document."""
    if len(text.encode()) > MOST_BYTES:
        raise TesseraError("INVALID_DECLARATION", "the declaration is too large")
    try:
        value = yaml.load(text, Loader=_Strict)  # noqa: S506
    except yaml.YAMLError as e:
        raise TesseraError("INVALID_DECLARATION", str(e)) from e

    def check(v: object, depth: int) -> None:
        if depth > MOST_DEPTH or (isinstance(v, float) and not math.isfinite(v)):
            raise TesseraError("INVALID_DECLARATION", "too deep, or a number is not finite")
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            check(x, depth + 1)

    check(value, 0)
    if not isinstance(value, dict):
        raise TesseraError("INVALID_DECLARATION", "a declaration is a mapping")
    return value


@dataclass(frozen=True)
class Table:
    name: str
    contract: TableContract | None
    columns: list[dict]
    source: dict
    target: str | None = None
    partitions: list[dict] | None = None
    sql: str | None = None
    not_null: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Declaration:
    kind: str
    dataset: str
    write: str
    tables: list[Table]
    inputs: dict[str, str]
    raw: dict = field(repr=False)


def load(text: str, folder: str = ".") -> Declaration:
    """A declaration with its files read in and its names, columns, partitions and checks cross-checked."""
    raw = parse(text)

    def bad(what: str) -> TesseraError:
        return TesseraError("INVALID_DECLARATION", what)

    if raw.get("declaration_version") != 1 or raw.get("kind") not in KINDS or not NAME.fullmatch(str(raw.get("dataset", ""))):
        raise bad("declaration_version 1, a kind and a dataset name are needed")
    tables, seen, targets = [], set(), set()
    for t in raw.get("tables") or []:
        name = t.get("name", "")
        if not NAME.fullmatch(name) or name in seen:
            raise bad(f"table name {name!r} is repeated or no name")
        seen.add(name)
        columns = t.get("columns") or []
        if isinstance(columns, dict):
            columns = yaml.load((Path(folder) / columns["file"]).read_text(), Loader=_Strict)  # noqa: S506
        keys = tuple(t.get("partition_keys") or ())
        contract = TableContract(tuple((c["name"], c["type"]) for c in columns), keys) if columns else None
        for c in columns:
            if "derive" in c:
                d = c["derive"]
                if c["name"] not in [f"_{k}_" for k in keys] or d.get("unit") not in ("year", "month", "day"):
                    raise bad(f"only a partition column derives a year, month or day: {c['name']}")
                origin = next((o for o in columns if o["name"] == d.get("from")), None)
                if origin is None or not (origin["type"] == "date32" or origin["type"].startswith("timestamp")):
                    raise bad(f"{c['name']} derives from no date or timestamp")
            parse_type(c["type"])
        target = (t.get("target") or {}).get("table")
        if target and target in targets:
            raise bad(f"two tables write {target}")
        targets.add(target)
        select = t.get("select") or {}
        sql = select.get("sql") or ((Path(folder) / select["file"]).read_text() if "file" in select else None)
        tables.append(Table(name, contract, columns, t.get("source") or {}, target, t.get("partitions"), sql or (t.get("source") or {}).get("sql")))
    for check in raw.get("checks") or []:
        table = next((t for t in tables if t.name == check.get("table")), None)
        if table is None or (table.contract and not set(check["not_null"]) <= {n for n, _ in table.contract.columns}):
            raise bad(f"a check names no declared table or column: {check}")
        table.not_null.extend(check["not_null"])
    inputs = {i["as"]: i["table"] for i in (raw.get("build") or {}).get("inputs") or []}
    return Declaration(raw["kind"], raw["dataset"], raw.get("write", "replace"), tables, inputs, raw)
