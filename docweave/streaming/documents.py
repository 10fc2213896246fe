"""Documents as they arrive.

All operators on single documents (words, sentences, trees, patterns, quantities, selection) need no state, so they run
on these streams unchanged.  ``drain`` takes what has arrived and stops; started again with the same checkpoint it
continues behind that, each document once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markup_stream(spark: SparkSession, base: str, files: int | None = None) -> DataFrame:
    """(path, html) of the documents that arrive in a folder, at most so many files a step."""
    reader = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html")
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(base).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """The files of a Parquet table, a folder or a single file, as a stream with the schema of those there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    # streams read folders only
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Appends what has arrived to a Parquet table and returns that table."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
