"""Evaluate expressions once where later steps use them many times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a generator, so the optimizer does not copy their expressions
    into every later use (which can outgrow the code size limit)."""
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def let(body, *values: Column) -> Column:
    """`body(*values)` with each value evaluated once per row, also inside nested lambdas."""
    bound = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.transform(bound, lambda x: body(*[x[f"v{i}"] for i in range(len(values))]))[0]
