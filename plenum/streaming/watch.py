"""Checks over an inbox folder: every text file that arrives is cut into blocks and handed to a batch check.

The check is stateless per document, so each micro-batch is an ordinary batch run; the checkpoint of
the stream remembers which files were seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plenum.sources.text import text_blocks

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, inbox: str, check: Callable[[DataFrame], DataFrame], out: str, state: str) -> StreamingQuery:
    """``check`` turns the blocks of new documents into findings, appended to ``out`` as Parquet.

    Files that are not valid UTF-8 are listed under ``out/quarantine`` instead.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).load(inbox)

    def each(batch: DataFrame, number: int) -> None:
        read = batch.select(F.col("path").alias("doc"), F.expr("if(is_valid_utf8(cast(content as string)), cast(content as string), null)").alias("body"))
        # one folder per batch number: a batch that is run again replaces its own output
        check(text_blocks(read.where("body is not null"), F.col("doc"), F.col("body"))).write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        read.where("body is null").select("doc", F.lit("not valid UTF-8").alias("reason")).write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()
