"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Lit:
    value: object  # None, bool, int, float or str


@dataclass
class Typed:
    type: str  # a typed string literal: DATE '2020-01-01'
    text: str


@dataclass
class Ref:
    parts: list[str]


@dataclass
class Unary:
    op: str
    arg: object


@dataclass
class Binary:
    op: str
    left: object
    right: object


@dataclass
class IsNull:
    arg: object
    negated: bool


@dataclass
class In:
    arg: object
    items: list
    negated: bool


@dataclass
class Between:
    arg: object
    low: object
    high: object
    negated: bool


@dataclass
class Like:
    arg: object
    pattern: object
    negated: bool


@dataclass
class Case:
    operand: object | None
    branches: list[tuple[object, object]]
    otherwise: object | None


@dataclass
class Cast:
    arg: object
    type: object


@dataclass
class ArrayOf:
    items: list


@dataclass
class Call:
    name: str
    args: list


@dataclass
class TypeName:
    name: str
    array: bool = False


@dataclass
class TableRef:
    parts: list[str]
    alias: str | None = None


@dataclass
class Join:
    left: object
    right: object
    how: str  # inner, left, right, full
    on: object | None


@dataclass
class OrderKey:
    expr: object
    asc: bool = True
    nulls_first: bool | None = None


@dataclass
class Select:
    items: list  # "*" or (expr, alias)
    source: object | None = None
    where: object | None = None
    order: list[OrderKey] = field(default_factory=list)
    limit: object | None = None
    offset: object | None = None


@dataclass
class ColumnDef:
    name: str
    type: TypeName
    nullable: bool = True
    default: object | None = None
    default_sql: str | None = None


@dataclass
class CreateTable:
    parts: list[str]
    columns: list[ColumnDef]
    replace: bool


@dataclass
class CreateSchema:
    parts: list[str]
    if_not_exists: bool


@dataclass
class Insert:
    parts: list[str]
    columns: list[str] | None
    rows: list[list]
