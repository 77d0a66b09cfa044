"""Small readers: record counts, BED, binary counts. All are read by Spark, in parallel over files and splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def count_records(spark: SparkSession, path: str) -> int:
    """Number of lines that begin a record."""
    return spark.read.text(path).where(F.col("value").startswith(">")).count()


def bed(spark: SparkSession, path: str) -> DataFrame:
    """``(chrom, start, end, name)``; lines without a fourth field are named by their place."""
    rows = spark.read.text(path).where((F.length("value") > 0) & ~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    name = F.coalesce(F.get(f, F.lit(3)), F.concat_ws("-", F.concat_ws(":", f[0], f[1]), f[2]))
    return rows.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), name.alias("name"))


def binary_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, kmer_idx, value)`` of files that hold a 64-bit number of counts and then the counts, little-endian."""
    import numpy as np

    def cut(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                n = int(np.frombuffer(content, "<u8", 1)[0])
                if len(content) != 8 * (n + 1):
                    raise ValueError(f"{name} holds {len(content) // 8 - 1} counts and says {n}")
                yield pd.DataFrame({"file": name, "kmer_idx": np.arange(n), "value": np.frombuffer(content, "<u8", n, 8).astype(np.int64)}).astype({"file": object})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "file string, kmer_idx long, value long")
