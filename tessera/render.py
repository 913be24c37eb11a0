"""Results as text, the way a client shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import Expr, text_of
from tessera.types import FLOATS, of_spark


def rendered(df: DataFrame) -> DataFrame:
    """Every column as text; null stays null."""
    cols = []
    for f in df.schema.fields:
        t = of_spark(f)
        c = text_of(Expr(F.col(f"`{f.name}`"), t)).cast("string")
        if t.kind in FLOATS:
            c = F.regexp_replace(c, "^(-?)inf$", "$1Infinity")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def lines(df: DataFrame) -> list[str]:
    """Rows as tab-separated text, null as NULL."""
    return ["\t".join("NULL" if v is None else v for v in row) for row in rendered(df).collect()]
