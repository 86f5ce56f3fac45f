"""Table sink."""

from __future__ import annotations

from pyspark.sql import DataFrame

from patronvoice.functions import stringify_nested


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Parquet and JSON keep nested columns; CSV gets them as JSON text and keeps blanks as they are."""
    if fmt == "csv":
        writer = stringify_nested(df).write.option("header", True).option("escape", '"')
        # Spark would trim texts otherwise
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    else:
        writer = df.write
    writer = writer.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
