"""Linking of new documents as they arrive.

Linking a document depends on the verses and titles only, which are static, so
there is no state and no watermark: each micro-batch is linked by the batch
operators and written under its number, so a batch that is run again replaces
its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riwaya.functions.normalize import normalize
from riwaya.operators.linking import link_all


def link_stream(stream: DataFrame, items: DataFrame, titles: DataFrame, sink: str, checkpoint: str, least: int = 5, once: bool = True) -> StreamingQuery:
    """Link a stream of (id, text_ar) to ``items`` and ``titles`` (see :func:`link_all`) into parquet under ``sink``.

    ``once``: take what is there and stop; otherwise keep running.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        docs = df.select(F.col("id").alias("doc"), normalize("text_ar").alias("doc_text"))
        link_all(items, docs, titles, least).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
