"""Left lookup join that survives hot and null keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NULL_SPREAD = 64


def row_hash(df: DataFrame, width: int = 4) -> Column:
    """A hash of the first flat columns: stable when a task is run again.

    Tables lead with what identifies a row. Taking only a few columns keeps the
    rest prunable, in particular long texts further right.
    """
    flat = [
        F.col(f"`{f.name}`")
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.UserDefinedType, T.VariantType))
    ]
    return F.xxhash64(*flat[:width])


def compact(c: Column) -> Column:
    """A long text as its SHA-256, for grouping by equality without moving the text."""
    return F.when(F.length(c) > 64, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)


def compact_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns with their texts compacted."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[compact(F.col(f"`{c}`")).alias(c) if isinstance(types[c], T.StringType) else F.col(f"`{c}`") for c in cols])


def lookup_join(df: DataFrame, lookup: DataFrame, keys: Sequence[str], salts: int = 1) -> DataFrame:
    """``df`` left-joined with a table that is unique on ``keys``.

    A plain left join sends every null key, and every row of a hot key, to one
    task. Here a second join key spreads the rows: null keys over many values
    (they match nothing anyway), other keys over ``salts`` values, for which the
    lookup rows are repeated. Ask for salts where keys of ``df`` may be hot; for
    a table already unique on its key one is enough. Spark still turns this into
    a broadcast join when it measures the lookup side to be small.
    """
    keys = list(keys)
    spread = row_hash(df)
    is_null = F.lit(False)
    for key in keys:
        is_null = is_null | F.col(key).isNull()
    left = df.withColumn(
        "_spread",
        F.when(is_null, F.pmod(spread, F.lit(max(salts, _NULL_SPREAD)))).otherwise(
            F.pmod(spread, F.lit(salts))
        ),
    )
    if salts == 1:
        # written as a hash so that the optimizer keeps it as a join key
        right = lookup.withColumn("_spread", F.pmod(F.xxhash64(*keys), F.lit(1)))
    else:
        right = lookup.withColumn("_spread", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, [*keys, "_spread"], "left").drop("_spread")


def scalar(one_row: DataFrame) -> Column:
    """All columns of a one-row DataFrame as one struct, evaluated once per query."""
    return one_row.select(F.struct(*[F.col(c) for c in one_row.columns])).scalar()
