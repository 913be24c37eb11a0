"""Scan, filter, project, sort, limit, offset and join as plain DataFrames; Catalyst plans them.

A relation's columns bear names of their own, so that no reference is ambiguous in Spark.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import Expr, sortable
from tessera.types import Type, of_spark

#: Join strategies by name, as hints on the right side; "auto" leaves the choice to Catalyst.
STRATEGIES = {"auto": None, "merge": "merge", "hash": "shuffle_hash", "broadcast": "broadcast", "nested_loop": "shuffle_replicate_nl"}
_NUMBER = itertools.count()


@dataclass
class Column_:
    qualifier: str
    name: str
    type: Type
    internal: str


@dataclass
class Relation:
    """A DataFrame and what its columns are called; ``keys`` are the columns that give unordered rows an order."""

    df: DataFrame
    columns: list[Column_]
    keys: list[str]


def scan(df: DataFrame, qualifier: str) -> Relation:
    """All columns of a table under names of their own; unused ones are pruned by Catalyst."""
    n = next(_NUMBER)
    columns = [Column_(qualifier, f.name, of_spark(f), f"t{n}_{i}") for i, f in enumerate(df.schema.fields)]
    return Relation(df.toDF(*[c.internal for c in columns]), columns, [columns[0].internal])


def one_row(spark) -> Relation:
    return Relation(spark.range(1).select(), [], [])


def filtered(r: Relation, predicate: Column) -> Relation:
    return Relation(r.df.filter(predicate), r.columns, r.keys)


def joined(left: Relation, right: Relation, how: str, on: Column | None, strategy: str = "auto") -> Relation:
    """Rows of both sides side by side; without ``on`` every pair, with outer kinds padding empty sides."""
    side = right.df.hint(STRATEGIES[strategy]) if STRATEGIES[strategy] else right.df
    df = left.df.crossJoin(side) if on is None and how == "inner" else left.df.join(side, F.lit(True) if on is None else on, how)
    return Relation(df, left.columns + right.columns, left.keys + right.keys)


def ordered(r: Relation, keys: list[tuple[Expr, bool, bool | None]]) -> Relation:
    """Sorted by (expression, ascending, nulls first); by default nulls are last ascending, first descending.

    Ties fall in order of the relations' first columns.
    """
    out = []
    for e, asc, nulls_first in keys:
        c, first = sortable(e), (not asc) if nulls_first is None else nulls_first
        out.append((c.asc_nulls_first() if first else c.asc_nulls_last()) if asc else (c.desc_nulls_first() if first else c.desc_nulls_last()))
    plain = {f.name for f in r.df.schema.fields if f.dataType.typeName() not in ("variant", "map")}
    return Relation(r.df.orderBy(*out, *[F.col(k).asc_nulls_last() for k in r.keys if k in plain]), r.columns, r.keys)


def projected(r: Relation, items: list[tuple[str, Expr]]) -> DataFrame:
    """The output; a name that occurs again gets a number."""
    from tessera.types import field

    seen: dict[str, int] = {}
    cols = []
    for name, e in items:
        n = seen[name] = seen.get(name, -1) + 1
        meta = field(name, e.type).metadata
        cols.append(e.col.alias(f"{name}_{n}" if n else name, **({"metadata": meta} if meta else {})))
    return r.df.select(*cols)


def page(df: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
