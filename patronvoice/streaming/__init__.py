"""The row-wise cleaning on a stream of listings.

Cleaning a row needs no other row, so it holds no state and no watermark: new
files are cleaned as they arrive and appended, each once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from patronvoice.plans.clean import clean_rows


def clean_stream(raw: DataFrame, out_dir: str, checkpoint_dir: str, once: bool = True) -> StreamingQuery:
    """Clean a streaming DataFrame of raw listings into Parquet files.

    ``once`` takes what is there and stops; otherwise the query goes on. What has
    been written is noted in ``checkpoint_dir``, a folder that outlives the job.
    """
    writer = raw.transform(clean_rows).writeStream.format("parquet").option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if once else writer).start(out_dir)
