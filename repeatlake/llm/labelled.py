"""Bounded training samples of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatlake.plans.storage import materialize

#: A sample's bounds, the only ones that classifiers are fitted under: its documents over all labels, and their code points.
DOCUMENTS, CODE_POINTS = 24_000, 32_000_000


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def first_by_hash(rows: DataFrame, limit: int, *columns: str) -> DataFrame:
    """At most ``limit`` rows, the smallest by a hash of ``columns``, which are to tell rows apart.

    Every task of a top-k sends up to ``limit`` rows to the driver. So rows are
    first cut at the hash under which twice as many are expected; what reaches
    the driver does not grow with the number of tasks.
    """
    n, h = rows.count(), F.xxhash64(*columns)
    near = rows if n <= 4 * limit else rows.where(h <= F.lit(int(2**65 * limit / n) - 2**63).cast("long"))
    return near.orderBy(h, *columns).limit(limit)


def sample(rows: DataFrame, label: str, each: int) -> DataFrame:
    """``(doc_id, label, h)`` of about ``each`` learnable ids of each label, in the order ``h`` of a hash of their ids.

    ``rows`` has ``doc_id`` and ``label``. However many labels there are, all are
    in it, each with fewer ids if there are more than ``DOCUMENTS // each``. An
    id with several labels has the least of them. One pass counts, one picks:
    rows over the hash under which twice as many are expected are left out
    before anything is grouped.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("doc_id", F.col(label).alias("label"), F.xxhash64("doc_id").alias("h"))
    sizes = materialize(rows.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("n")), "label-sizes")
    room = max(1, min(each, DOCUMENTS // max(1, sizes.count())))
    cut = F.least(F.lit(1.0), (2.0 * room + 40.0) / F.col("n")) * F.lit(2.0**64) - F.lit(2.0**63)
    near = rows.join(sizes.select(F.col("label").alias("of"), cut.alias("cut")), (F.col("label") == F.col("of")) & (F.col("h").cast("double") <= F.col("cut")))
    one = near.groupBy("doc_id", "h").agg(F.min("label").alias("label"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))
    return one.withColumn("place", place).where(F.col("place") <= room).drop("place")


def labelled_texts(documents: DataFrame, rows: DataFrame, label: str, each: int) -> list[tuple[str, object]]:
    """``(text, label)`` of a sample, in the order of a hash of ids, on the driver.

    Texts are whole. Of each label documents are taken until their code points
    reach its share of CODE_POINTS, at least one. Rows of one id are one
    document: the text that sorts first.
    """
    picked = materialize(sample(rows, label, each), "label-picked")
    many = max(1, picked.select("label").distinct().count())
    texts = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "h", "label").agg(F.min("text").alias("text"))
    before = Window.partitionBy("label").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.withColumn("before", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0)))
    got = texts.where(F.col("before") < CODE_POINTS // many).select("h", "text", "label").collect()
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: (r["h"], r["text"]))]
