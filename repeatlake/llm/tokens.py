"""Token counts of documents in flat token files that have no index.

A flat file is nothing but token ids, one document after another, each ended by
the end-of-document id. It is kept as a table of blocks, ``(shard, block, ids)``
with a fixed number of tokens in each but a shard's last. Blocks are searched
for the end id independently, with one vectorised comparison each; a block
tells how many documents end in it, where, and how many tokens trail behind its
last end. A prefix scan over these few numbers gives every block the number of
documents ended before it and the tokens carried into it, so the first end of a
block closes the document that began blocks before. The scan runs inside each
shard, by block number; shards never share a document.

Cases: a document without tokens counts 0. A shard that does not end with the
end id has an open last document, which is counted with ``ended`` false. A null
text is a document without tokens. A null ``doc_id`` is counted like any other.
Repeated rows are documents of their own. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatlake.llm.arrow import plain_text, texts
from repeatlake.llm.bpe import ByteBpe, loaded, public_path
from repeatlake.plans.storage import materialize

END_ID = 50256
BLOCK = 1 << 16  # tokens
KIND = "<u2"  # of a stored id: the vocabulary has less than 65536


class FlatBpe(ByteBpe):
    """Byte-level BPE whose fragments are ids as little-endian unsigned 16-bit numbers."""

    def _fragment(self, raw: bytes) -> bytes:
        ids = [i for token in self.pattern.findall(raw.decode("utf-8")) for i in self.parts[token.encode("utf-8")]]
        return np.array(ids, KIND).tobytes()

    def flat_ids(self, text: str) -> bytes:
        """All ids; strings of special tokens are ordinary text here, so the end id occurs in no document."""
        return b"".join(self._plain(text.encode("utf-8")))


def write_flat(documents: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, block: int = BLOCK, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Flat blocks ``(shard, block, ids)`` of all documents; and ``(shard, ordinal, doc_id)``, who was written where.

    Each task writes the shard of its partition in the order in which it reads,
    so no text is shuffled. Counting does not use the second table.
    """
    size = np.dtype(KIND).itemsize * block

    def encode(batches):
        bpe, end = loaded(FlatBpe, vocabulary or public_path("byte_bpe_50k.json")), np.array([end_id], KIND).tobytes()
        shard, held, number, written = TaskContext.get().partitionId(), bytearray(), 0, 0

        def out(blocks: list[bytes], ids: pa.Array):
            nonlocal number, written
            n, m = len(blocks), len(ids)
            numbers = [*range(number, number + n), *[None] * m]
            ordinals = [*[None] * n, *range(written, written + m)]
            number, written = number + n, written + m
            columns = [pa.array([shard] * (n + m), pa.int32()), pa.array(numbers, pa.int64()), pa.array([*blocks, *[None] * m], pa.binary()), pa.array(ordinals, pa.int64()), pa.array([*[None] * n, *ids.to_pylist()], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "ids", "ordinal", "doc_id"])

        for batch in batches:
            for k, text in enumerate(texts(batch)):
                held += bpe.flat_ids(text) + end
                if len(held) >= size:
                    whole = len(held) // size * size
                    yield out([bytes(held[s : s + size]) for s in range(0, whole, size)], batch.column(0).slice(0, 0))
                    del held[:whole]
            yield out([], batch.column(0))
        if held:
            yield out([bytes(held)], pa.array([], pa.int64()))

    written = plain_text(documents, id_column).mapInArrow(encode, "shard int, block long, ids binary, ordinal long, doc_id long")
    written = materialize(written, "flat-tokens")
    return written.where("block is not null").select("shard", "block", "ids"), written.where("ordinal is not null").select("shard", "ordinal", "doc_id")


def scan(flat: DataFrame, end_id: int = END_ID, kind: str = KIND) -> DataFrame:
    """``(shard, ordinal, start, n_tokens, ended)`` of every document in flat blocks; the end id is not counted."""

    def ends(batches):
        for batch in batches:
            found = [np.frombuffer(ids.as_buffer(), kind) == end_id for ids in batch.column(2)]
            ats, lengths = [np.flatnonzero(f) for f in found], [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(ats, pa.list_(pa.int64()))], names=["shard", "block", "length", "ends"])

    name = flat.schema["shard"].dataType.simpleString()
    found = flat.select("shard", "block", "ids").mapInArrow(ends, f"shard {name}, block long, length long, ends array<long>")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("shard")
    many = F.size("ends")
    last_end = F.when(many > 0, F.col("begin") + F.element_at("ends", -1) + 1)
    scanned = (
        found.withColumn("begin", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .withColumn("documents", F.coalesce(F.sum(many).over(before), F.lit(0)))
        .withColumn("opened", F.coalesce(F.max(last_end).over(before), F.lit(0)))  # where the document began that is open as the block begins
        .withColumn("last", F.max("block").over(whole) == F.col("block"))
    )
    tail = F.when(F.col("last") & (F.coalesce(last_end, F.col("opened")) < F.col("begin") + F.col("length")), F.array(F.col("length"))).otherwise(F.array().cast("array<bigint>"))
    ended = scanned.withColumn("tail", tail).withColumn("all", F.concat("ends", "tail"))
    each = ended.select("shard", "begin", "documents", "opened", many.alias("many"), "all", F.posexplode("all").alias("k", "at"))
    start = F.when(F.col("k") == 0, F.col("opened")).otherwise(F.col("begin") + F.element_at("all", F.greatest(F.col("k"), F.lit(1))) + 1)
    return each.select("shard", (F.col("documents") + F.col("k")).cast("long").alias("ordinal"), start.alias("start"), (F.col("begin") + F.col("at") - start).alias("n_tokens"), (F.col("k") < F.col("many")).alias("ended"))


def read_flat_files(spark, path: str, block: int = BLOCK, kind: str = KIND) -> DataFrame:
    """``(shard, block, ids)`` of raw files of ids of the given numpy ``kind``; ``shard`` is the file's path.

    Spark reads binary files whole, so files are to be of a size that a task can hold.
    """

    def cut(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_buffer()
                size = np.dtype(kind).itemsize * block
                parts = [raw[s : s + size].to_pybytes() for s in range(0, max(1, len(raw)), size)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["shard", "block", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "shard string, block long, ids binary")


def token_counts(documents: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, block: int = BLOCK, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, shard, ordinal, start, n_tokens)``: written to flat blocks, and counted by scanning these."""
    flat, names = write_flat(documents, vocabulary, end_id, block, id_column)
    counted = scan(flat, end_id)
    return names.join(counted, ["shard", "ordinal"]).select("doc_id", "shard", "ordinal", "start", "n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    """``op7``: tokens of every document, counted in flat token blocks."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
