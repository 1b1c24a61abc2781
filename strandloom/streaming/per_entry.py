"""Operators that look at one entry at a time run on streams as stateless maps; counts are kept by Spark's own state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import kmers, match


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files as they come."""
    return spark.readStream.schema(schema).parquet(path)


def exact_hits(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """Hits of a stream of entries: a stream-static join, no state."""
    return match.exact(entries, patterns)


def kmer_counts(entries: DataFrame, k: int) -> DataFrame:
    """Running counts (output mode complete or update)."""
    return kmers.count(kmers.dna_words(entries, k))


def windowed_hits(hits: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Hits by pattern and time window; what comes later than the watermark is left out."""
    return hits.withWatermark(time, late).groupBy(F.window(time, width), "pattern_id").agg(F.count("*").alias("n"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything available now, to Parquet, exactly once; a second call goes on where the first stopped."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
