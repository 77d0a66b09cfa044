"""Mates paired on the fly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlake.functions.sequence import mate_name


def pair_stream(reads: DataFrame, time: str = "at", wait: str = "10 minutes") -> DataFrame:
    """``(name, seq1, seq2)`` of a stream of ``(title, seq, at)``: first mates joined with second mates of their name.

    Either side waits for the other no longer than ``wait`` of event time, which
    bounds the state; a read whose mate has not come by then is dropped.
    """
    named = reads.withColumn("name", mate_name(F.col("title"))).withWatermark(time, wait)
    first = named.where(F.col("title").endswith("/1")).select("name", F.col("seq").alias("seq1"), F.col(time).alias("t1"))
    second = named.where(F.col("title").endswith("/2")).select(F.col("name").alias("name2"), F.col("seq").alias("seq2"), F.col(time).alias("t2"))
    span = F.expr(f"t2 between t1 - interval {wait} and t1 + interval {wait}")
    return first.join(second, (F.col("name") == F.col("name2")) & span).select("name", "seq1", "seq2")
