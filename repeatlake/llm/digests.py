"""Canonical exact digests of documents, built of SQL functions alone.

The canonical form of a text is NFKC-normalised, case-folded, with every run
of white space made one space and none at either end. Its fingerprint is two
XXH64 sums of it with different seeds, 128 bits in 32 hex digits. Documents
with equal fingerprints form a bucket; inside buckets of more than one the
canonical texts themselves are compared byte by byte, and only equal ones
share a class.

A digest is equal or it is not, so the likeness of two fingerprints is 1.0
where the canonical texts are equal and else 0.0.

The edited text that queries compare with takes its second half from the next
document in descending order of ids. Ids are dealt into buckets that keep
their order, cut at approximate percentiles; the first document of each bucket
is also sent to the end of the bucket before it, so no order over all rows in
one task is needed. Whole texts are shuffled once.

Cases: null text is empty; empty text has a fingerprint like any other. A null
``doc_id`` sorts after all ids. Rows with equal ids follow each other in the
order of a hash of their texts, by which the rows of an id that many have are
dealt into several buckets. A lone document is its own next. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatlake.llm.arrow import plain_text
from repeatlake.plans.storage import materialize

BUCKETS = 1 << 20  # of ids at most: what bounds the broadcast table of bucket heads, 24 MB; larger buckets are sorted on disk
ROWS = 2000  # aimed at in a bucket
SEGMENTS = 64
MEMBERS = 1 << 20  # ids of documents whose fingerprint others have too: up to so many, about 24 MB, are broadcast
LOWEST = -(1 << 63)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, white space folded."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    # folding can undo the composition of a few letters
    again = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    stable = F.when(F.length(folded) == F.octet_length(folded), folded).otherwise(again)
    return F.trim(F.regexp_replace(stable, r"[\s\x85\xa0  -     　]+", " "))


def digest(canon: Column) -> Column:
    """32 lowercase hex digits: XXH64 with seed 42, and with the seed that XXH64 gives for 'wide'."""
    halves = (F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), canon)), 16, "0"))
    return F.lower(F.concat(*halves))


def id_buckets(ids: DataFrame) -> Column:
    """A column that deals ``(k, h)`` into at most about BUCKETS buckets, numbered in the order of ``k``, then against ``h``; about evenly.

    A key that several percentiles hit has many rows: it has buckets of its own, by ``h``.
    """
    probabilities = [i / SEGMENTS for i in range(SEGMENTS + 1)]
    row = ids.agg(F.count("*").alias("n"), F.percentile_approx("k", probabilities, 2000).alias("p")).first()
    hits = Counter(row["p"] or [0])
    cuts, total = sorted(hits), min(BUCKETS, row["n"] // ROWS)
    each = max(1, total // max(1, len(cuts) - 1))
    value, bucket, base = F.col("k").cast("double"), F.lit(0).cast("long"), 0
    for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1]):
        if hits[a] > 1:
            parts = max(1, total * hits[a] // SEGMENTS)
            turn = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * parts)
            bucket = F.when(F.col("k") >= F.lit(a).cast("long"), base + parts - 1 - F.least(F.lit(parts - 1), turn)).otherwise(bucket)
            base += parts
        after = F.col("k") > F.lit(a).cast("long") if hits[a] > 1 else F.col("k") >= F.lit(a).cast("long")
        share = F.greatest(F.lit(0), F.least(F.lit(each - 1), F.floor((value - float(a)) * each / (float(b) - float(a) or 1.0))))
        bucket = F.when(after, F.lit(base) + share).otherwise(bucket)
        base += each
    return bucket.cast("int")


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """``docs(doc_id, ...)`` with ``next_<c>`` for each of ``carried``, the first a text: its value in the next document in descending ids."""
    keyed = docs.withColumn("k", F.coalesce("doc_id", F.lit(LOWEST).cast("long"))).withColumn("h", F.xxhash64(carried[0]))
    bucket = id_buckets(keyed.select("k", "h"))
    heads = keyed.select("k", "h").groupBy(bucket.alias("b")).agg(F.max(F.struct("k", F.bitwise_not("h").alias("not_h"))).alias("head"))
    order = Window.orderBy("b")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = F.coalesce(F.lead("b").over(order), F.first("b").over(whole))
    heads = heads.select(F.col("head.k").alias("head"), F.bitwise_not("head.not_h").alias("head_h"), above.alias("above"))
    heads = materialize(heads, "digest-heads")  # at most about BUCKETS rows
    both = keyed.withColumn("b", bucket).join(F.broadcast(heads), (F.col("k") == F.col("head")) & (F.col("h") == F.col("head_h")), "left")
    sent = F.array(F.struct(F.col("b").alias("at"), F.lit(0).alias("copy")), F.struct(F.col("above").alias("at"), F.lit(1).alias("copy")))
    # what is shuffled beside whole texts is kept small: the key is made of the id again
    here = both.withColumn("to", F.explode(F.filter(sent, lambda x: x["at"].isNotNull()))).select(*docs.columns, "h", "to.at", "to.copy")
    across = Window.partitionBy("at").orderBy("copy", F.coalesce("doc_id", F.lit(LOWEST).cast("long")).desc(), "h", *carried)
    out = here.select(*docs.columns, "copy", *(F.lead(c).over(across).alias(f"next_{c}") for c in carried))
    return out.where("copy = 0").drop("copy")


def exact_classes(documents: DataFrame, id_column: str = "doc_id", printed: DataFrame | None = None) -> DataFrame:
    """``(fingerprint, class_id, canon)`` of buckets with several rows; ``printed`` is ``(doc_id, fingerprint)`` of all rows, if known.

    ``class_id`` is the smallest id with the same canonical bytes. ``canon`` is
    null where all of a bucket is byte-equal, else the text that tells its classes apart.
    """
    docs = plain_text(documents, id_column)
    if printed is None:
        printed = materialize(docs.select("doc_id", digest(canonical(F.col("text"))).alias("fingerprint")), "digest-prints")
    several = materialize(printed.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "digest-several")
    members = materialize(printed.join(several, "fingerprint", "left_semi").select("doc_id").distinct(), "digest-members")
    if members.count() <= MEMBERS:  # then no text but theirs has to move
        members = F.broadcast(members)
    texts = docs.join(members, docs["doc_id"].eqNullSafe(members["doc_id"]), "left_semi")
    texts = texts.select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    checked = texts.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), (F.min("canon") == F.max("canon")).alias("pure"))
    checked = materialize(checked, "digest-checked")
    pure = checked.where("pure").select("fingerprint", "class_id", F.lit(None).cast("string").alias("canon"))
    mixed = checked.where("not pure")
    if mixed.isEmpty():
        return pure
    apart = texts.join(mixed.select("fingerprint"), "fingerprint", "left_semi").groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("class_id"))
    return pure.unionByName(apart.select("fingerprint", "class_id", "canon"))


def fingerprint_edits(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, and the class of byte-equal canonical texts."""
    return unpacked(packed_edits(documents, id_column))


def packed_edits(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of :func:`fingerprint_edits` with digests as bytes, half as large when they are shuffled or written."""
    docs = plain_text(documents, id_column)
    printed = docs.withColumn("print", F.unhex(digest(canonical(F.col("text")))))
    paired = with_next(printed, "text", "print")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    rows = rows.withColumn("edited_print", F.unhex(digest(canonical(F.col("edited")))))
    return rows.select("doc_id", "n_chars", F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)).alias("sha"), "print", "edited_print", (F.col("print") == F.col("next_print")).alias("same_next"))


def unpacked(rows: DataFrame) -> DataFrame:
    text = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id", "n_chars", text("sha").alias("edited_sha256"), text("print").alias("fingerprint"), text("edited_print").alias("edited_fingerprint"),
        (F.col("print") == F.col("edited_print")).cast("double").alias("near_edited"), F.col("same_next").cast("double").alias("near_next"),
    )


def with_classes(documents: DataFrame, rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``rows(doc_id, fingerprint, ...)`` with ``class_id``: the smallest id with the same canonical bytes."""
    classes = materialize(exact_classes(documents, id_column, rows.select("doc_id", "fingerprint")), "digest-classes")
    same = classes.where("canon is null").select(F.col("fingerprint").alias("class_print"), F.col("class_id").alias("same_id"))
    joined = rows.join(same, rows["fingerprint"] == same["class_print"], "left").drop("class_print")
    apart = classes.where("canon is not null")
    if apart.isEmpty():
        return joined.select(*rows.columns, F.coalesce("same_id", "doc_id").alias("class_id"))
    # fingerprints that different texts share: each row's class is that of its own bytes
    ids = rows.join(apart.select("fingerprint").distinct(), "fingerprint", "left_semi").select(F.col("doc_id").alias("member")).distinct()
    docs = plain_text(documents, id_column)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["member"]), "left_semi").select("doc_id", canonical(F.col("text")).alias("canon"))
    own = texts.withColumn("fingerprint", digest(F.col("canon"))).join(apart, ["fingerprint", "canon"]).groupBy("doc_id", "fingerprint").agg(F.min("class_id").alias("own_id"))
    own = materialize(own, "digest-apart").select(F.col("doc_id").alias("own_doc"), F.col("fingerprint").alias("own_print"), "own_id")
    found = joined.join(own, joined["doc_id"].eqNullSafe(own["own_doc"]) & (joined["fingerprint"] == own["own_print"]), "left")
    return found.select(*rows.columns, F.coalesce("same_id", "own_id", "doc_id").alias("class_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op6``: digests of all documents and their edited texts, and each document's exact class."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_classes(documents, unpacked(materialize(packed_edits(documents), "digest-rows")))
