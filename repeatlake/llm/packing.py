"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity.

Which bin an item goes to depends on its length only, so the packing is made
over the histogram of lengths, which has at most ``capacity`` rows however
large the corpus is. A segment tree over remaining capacities finds the
tightest open bin in logarithmic time; equal bins are kept as runs of bin
numbers, and a whole run takes its items in one step, exactly as placing them
one by one would. What comes out is a bounded table of placements by length
and rank. Items get their rank among those of equal length from salted groups,
so a length that a third of all items have is spread over many tasks.

Cases: a null or empty text is one piece, the end id alone. A row with a null
``doc_id`` is packed like any other. Repeated rows are packed as often as they
are there. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatlake.llm.arrow import map_rows, plain_text, texts
from repeatlake.llm.bpe import WORD_PATTERN, Memo, Vocabulary, loaded, public_path
from repeatlake.plans.storage import materialize

CAPACITY = 4096
END_ID = 1


class WordBpe(Vocabulary):
    """BPE with word ends: white space separates and is dropped, letters are lowered."""

    def __init__(self, path: str):
        super().__init__(path)
        self.pattern = regex.compile(WORD_PATTERN)
        self.words = Memo(lambda word: np.array(self._merge(word.encode("utf-8")), "<u4").tobytes())
        self.chunks = Memo(self._chunk)
        self.odd = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the library
        self.spaces = regex.compile(r"[\t-\r \x85\xa0  -     　]+")

    def _plain(self, chunk: str) -> bytes:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # lowered letter by letter
        return b"".join(map(self.words.__getitem__, self.pattern.findall(chunk.lower())))

    def _chunk(self, chunk: str) -> bytes:
        if "<|" not in chunk or not self.split_special:
            return self._plain(chunk)
        parts = self.split_special.split(chunk)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        chunks = text.split() if not self.odd.search(text) else [c for c in self.spaces.split(text) if c]
        return b"".join(map(self.chunks.__getitem__, chunks))


def pieces(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and the end id, cut where over ``capacity``."""

    def make():
        bpe = loaded(WordBpe, vocabulary or public_path("word_bpe_49k.json"))
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

        def each(batch: pa.RecordBatch):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
                ids = memoryview(bpe.encode(text) + end)
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for name, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(value)
            yield out

        return each

    return map_rows(plain_text(documents, id_column), "doc_id long, piece int, start long, length long, ids_crc32 long", make)


class Capacities:
    """A segment tree over remaining capacities 0..top that knows which have open bins."""

    def __init__(self, top: int):
        self.size = 1 << (top + 1).bit_length()
        self.tree = bytearray(2 * self.size)

    def mark(self, at: int, there: bool) -> None:
        at += self.size
        self.tree[at] = there
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]

    def tightest(self, least: int) -> int:
        """The smallest marked capacity of at least ``least``, or -1."""
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return -1


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements ``(length, first rank, bin, items a bin, offset)`` of best-fit decreasing.

    The item of rank ``first + j`` goes to bin ``bin + j // items`` at
    ``offset + (j % items) * length``. An item goes to the open bin with the
    least room that holds it (of equal ones the lowest number); after that
    the same bin is the tightest for the next of the same length as long as
    one more fits, so a bin takes as many as fit before the next bin's turn.
    """
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room: runs of bins (first, how many)
    tree, placed, bins = Capacities(capacity), [], 0

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            insort(open_runs.setdefault(room, []), (first, many))
            tree.mark(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                first, many = bins, -(-left // each)
                bins += many
            else:
                each = room // length
                first, many = open_runs[room].pop(0)
                if not open_runs[room]:
                    tree.mark(room, False)
            placed.append((length, rank, first, each, capacity - room))
            full = min(many, left // each)
            rest = min(left - full * each, each) if full < many else 0
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), many - full - bool(rest))
            left -= full * each + rest
            rank += full * each + rest
    return placed


def ranked(items: DataFrame, counts: DataFrame, group: int = 256, most: int = 1 << 16) -> DataFrame:
    """``items`` with ``rank``, 0, 1, 2... among those of equal ``length``; ``counts(length, n)`` is their histogram."""
    salts = F.least(F.greatest(F.ceil(F.col("n") / group), F.lit(1)), F.lit(most))
    salted = items.join(F.broadcast(counts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts.cast("long"))).drop("n")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("here"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = salted.withColumn("own", F.row_number().over(own) - 1)
    both = numbered.join(base, (numbered["length"] == base["b_length"]) & (numbered["salt"] == base["b_salt"]))
    return both.withColumn("rank", F.col("base") + F.col("own")).drop("b_length", "b_salt", "base", "own", "salt")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` with the ``sequence_id`` and ``offset`` that best-fit decreasing gives them by their ``length``."""
    spark = items.sparkSession
    counts = materialize(items.groupBy("length").agg(F.count("*").alias("n")), "pack-lengths")
    histogram = {r["length"]: r["n"] for r in counts.collect()}  # at most `capacity` rows
    table = np.array(best_fit(histogram, capacity), np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def make():
        t = shared.value
        lengths = t[:, 0]
        lo = np.searchsorted(lengths, np.arange(capacity + 2))

        def each(batch: pa.RecordBatch):
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for value in np.unique(length):
                here = length == value
                a, b = lo[value], lo[value + 1]
                at[here] = a + np.searchsorted(t[a:b, 1], rank[here], side="right") - 1
            place = t[at]
            j = rank - place[:, 1]
            out = {n: batch.column(batch.schema.get_field_index(n)) for n in kept}
            yield out | {"sequence_id": place[:, 2] + j // place[:, 3], "offset": place[:, 4] + j % place[:, 3] * length}

        return each

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_rows(ranked(items, counts).select(*kept, "rank"), schema, make)


def packed(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack(materialize(pieces(documents, capacity, end_id, vocabulary, id_column), "pack-pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    """``op9``: all documents in sequences of 4096 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
