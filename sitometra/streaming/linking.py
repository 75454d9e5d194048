"""The link stage on a stream of edition files: it keeps nothing between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import LinkOptions
from ..operators import link
from ..sources import xml


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of *.xml files as they come."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return rows.option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(folder).select("path", "content")


def link_batch(files: DataFrame, options: LinkOptions = LinkOptions()) -> DataFrame:
    blocks = xml.parse_blocks(files, options.scan_commentary).withColumnRenamed("ddb_id", "DDB_ID")
    return link.link(link.find_mentions(blocks.select("*", *[F.lit("").alias(c) for c in link.META]), options), options)


def start(files: DataFrame, out: str, checkpoint: str, options: LinkOptions = LinkOptions()) -> StreamingQuery:
    """Append each batch's linked rows, a folder per batch, so a batch that is done again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        link_batch(batch, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
