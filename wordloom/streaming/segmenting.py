"""Sentences as a stream: segmentation with a fixed model, and running word counts.

Each micro-batch is written under its number, so a batch that runs again replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wordloom.functions.symbols import words
from wordloom.operators.segment import shared_index, viterbi_unigram


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A stream of the files of a table, be it a folder or one file (streams read folders)."""
    path = f"{folder}/{name}.parquet"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def segment_stream(sentences: DataFrame, costs: DataFrame, letter_cost: float, out: str, checkpoint: str):
    """Starts a query that segments a stream (utt, text) into ``out``; it ends when the input does.
    The lexicon is shared once, not with every batch."""
    shared = shared_index(costs)

    def batch(rows: DataFrame, number: int) -> None:
        viterbi_unigram(rows, costs, letter_cost, shared=shared).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return sentences.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_stream(texts: DataFrame, out: str, checkpoint: str):
    """Starts a query that keeps (word, n) of a stream with a text column; the state is partitioned
    by word, each batch writes the counts that changed."""
    counts = texts.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """(word, n): of each word the count of its last batch."""
    return spark.read.parquet(out).groupBy("word").agg(F.max_by("n", "batch").alias("n"))
