"""Evaluate-once staging for long chains of derived columns.

Catalyst pushes a filter on a derived column through ``Project`` by
substituting the column's definition, so a filter on a column built from
many stages inlines every stage again (a tree, not a DAG).  Placing a stage
behind a one-row ``inline`` generator keeps its outputs opaque: a filter
above it stays above it, and each stage is evaluated once per row.

The values are computed in a projection below the generator: a generator with a
lambda function among its values is interpreted whole, a projection is compiled
but for the lambda functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, **cols: Column) -> DataFrame:
    """Add ``cols`` to ``df`` as generator outputs (one output row per row)."""
    keep = [F.col(c) for c in df.columns if c not in cols]
    packed = F.struct(*[v.alias(k) for k, v in cols.items()])
    return df.select(*keep, packed.alias("_staged")).select(*keep, F.inline(F.array("_staged")))
