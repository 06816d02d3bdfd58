"""Incremental facets: a file stream of section rows, each file handled once.

All detectors are stateless but the one that ranks within a block; a section row is a block, so it runs
per micro-batch. The checkpoint remembers which files are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellumine.operators import facets
from vellumine.sources.canonical import split_sentences


def section_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def sentences_of(sections: DataFrame) -> DataFrame:
    rows = sections.select("paper_id", F.col("section_id").alias("block_id"), F.lower("header").alias("section"), "body")
    return split_sentences(rows, F.col("body"), "paper_id", "block_id", "section").select("paper_id", "block_id", "sent_id", "text", "section")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has arrived since the last run, append its facets, stop.

    A batch writes under its own number, so a repeated batch overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        facets.all_facets(sentences_of(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
