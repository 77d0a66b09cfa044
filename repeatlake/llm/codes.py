"""Vectors compressed to one code a part, against small codebooks fitted over all vectors.

Components become whole numbers, ``floor(scale x)``, and a vector is cut into
``parts`` equal parts with a codebook each. A round sends every part to the
nearest entry of its codebook and replaces each entry by the floor of its
parts' mean. All arithmetic is in whole numbers, so the result does not depend on
how rows are dealt, and a recomputed task adds the same.

Each round broadcasts one kd-tree for each codebook: at most ``entries`` leaves
of as many components as a part has, whatever the table's size. Rows search the
tree together, in numpy: those that are nearer to a node's left half see it
first, then those of them whose bound to the other half is no larger than
their best distance see that one too. An equal bound is visited, because an entry
at an equal distance with a lower index may be there. Tasks add up their parts by
entry, and the driver gets one row for each component of an entry.

Cases: rows whose vector is null or holds a null or non-finite component are
left out. Vectors that are shorter than the longest, or whose length the parts
do not divide, are as if zeros followed. The first entries are those of the rows
with the smallest ids, rows of one id in the order of their vectors, null ids
last; with fewer rows than entries there are fewer entries. Repeated rows count
again. Ties go to the entry with the lower index. Components that are so large
that sums of squares leave 64 bits are computed in Python's whole numbers; an
error, or a label's sum, that a long cannot hold is null. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlake.plans.storage import discard, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LEAF = 2  # entries that a leaf of a tree holds at most
SMALL = 1 << 26  # components under it: differences under 2^27, so 2^9 squares of them fit a long


def sound_vectors(embeddings: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """``(vec_id, label, e)`` of the rows whose vector holds finite numbers alone."""
    rows = embeddings.select(F.col(id_column).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("e"))
    return rows.where(F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


class Tree:
    """A kd-tree over the entries of one codebook, for searches by many rows at once."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.root = self._node(np.arange(len(book)))

    def _node(self, members: np.ndarray):
        points = self.book[members]
        low, high = points.min(axis=0), points.max(axis=0)
        spread = high - low
        if len(members) <= LEAF or not spread.any():
            return low, high, members, None, None
        order = members[np.argsort(points[:, int(np.argmax(spread))], kind="stable")]
        half = len(order) // 2
        return low, high, members, self._node(order[:half]), self._node(order[half:])

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each row's nearest entry, the lowest of equal ones, and its squared distance."""
        best, at = np.full(len(rows), -1, rows.dtype), np.full(len(rows), len(self.book), np.int64)

        def bound(node, some):
            low, high = node[:2]
            out = np.maximum(low - rows[some], 0) + np.maximum(rows[some] - high, 0)
            return (out * out).sum(axis=1)

        def visit(node, some):
            if not len(some):
                return
            _, _, members, left, right = node
            if left is None:
                for m in members:
                    step = rows[some] - self.book[m]
                    d = (step * step).sum(axis=1)
                    won = (best[some] < 0) | (d < best[some]) | ((d == best[some]) & (m < at[some]))
                    best[some[won]], at[some[won]] = d[won], m
                return
            to_left, to_right = bound(left, some), bound(right, some)
            first = to_left <= to_right
            for near, far, mine, bounds in ((left, right, first, to_right), (right, left, ~first, to_left)):
                visit(near, some[mine])
                rest = some[mine]
                visit(far, rest[bounds[mine] <= best[rest]])

        visit(self.root, np.arange(len(rows)))
        return at, best


def floors(flat: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale x)``: int64 if sums of squares of differences fit, else Python's whole numbers."""
    scaled = np.floor(flat * float(scale)) if not len(flat) or np.abs(flat).max() * float(scale) < SMALL else None
    if scaled is not None:
        return scaled.astype(np.int64)
    return np.array([int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale)) for x in flat.tolist()], object)


def _filled(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """``(rows, width)`` whole numbers of a list column, zeros after its end."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = floors(np.asarray(column.flatten()).astype(np.float64), scale)
    out = np.zeros((len(sizes), width), flat.dtype if width <= 1 << 9 else object)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def assigned(batch: pa.RecordBatch, trees: list[Tree], width: int, scale: int):
    """For each part: its rows, the entry of each and the squared distance."""
    rows = _filled(batch.column(batch.schema.get_field_index("e")), width, scale)
    each = width // max(1, len(trees))
    for i, tree in enumerate(trees):
        own = rows[:, i * each : (i + 1) * each]
        if own.dtype != tree.book.dtype:
            own, tree = own.astype(object), Tree(tree.book.astype(object))
        yield i, own, *tree.nearest(own)


def in_limbs(x: int) -> list[int]:
    """Numbers under 2^32, the last with the sign, that make up ``x``; sums over tasks of each fit a long whatever ``x`` is."""
    out = []
    while not -(1 << 31) <= x < 1 << 31:
        out.append(x & 0xFFFFFFFF)
        x >>= 32
    return [*out, x]


def _trees(books: list[list[list[int]]]) -> list[Tree]:
    big = max((abs(x) for book in books for entry in book for x in entry), default=0) >= SMALL or len(books) * len(books[0][0]) > 1 << 9
    return [Tree(np.array(book, object if big else np.int64).reshape(len(book), -1)) for book in books]


def fit(rows: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[list[list[int]]], int]:
    """The codebooks ``[part][entry][component]`` after all rounds, and the width that vectors are filled up to; ``rows`` is ``(vec_id, e)``."""
    spark = rows.sparkSession
    longest = rows.agg(F.max(F.size("e")).alias("n")).first()["n"]
    if longest is None:
        return [], 0
    each = max(1, -(-longest // parts))
    width = each * parts
    first = rows.select("vec_id", "e").orderBy(F.col("vec_id").asc_nulls_last(), "e").limit(entries).collect()
    start = [[int(x) for x in floors(np.array(r["e"], np.float64), scale)] + [0] * (width - len(r["e"])) for r in first]
    books = [[v[i * each : (i + 1) * each] for v in start] for i in range(parts)]
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(_trees(books))

        def add(batches, shipped=shipped):
            held: dict[tuple[int, int, int], int] = {}
            for batch in batches:
                for i, own, at, _ in assigned(batch, shipped.value, width, scale):
                    for m in np.unique(at):
                        mine = own[at == m]
                        for j, x in enumerate([len(mine), *mine.sum(axis=0)]):
                            held[i, int(m), j] = held.get((i, int(m), j), 0) + int(x)
            limbs = [(*k, n, x) for k, total in held.items() for n, x in enumerate(in_limbs(total))]
            columns = [pa.array([r[c] for r in limbs], pa.int64() if c == 4 else pa.int32()) for c in range(5)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "limb", "total"])

        sums = rows.select("e").mapInArrow(add, "part int, entry int, place int, limb int, total long")
        got: dict[tuple[int, int], dict[int, int]] = {}
        for r in sums.groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total")).collect():  # a few rows for each component of an entry
            own = got.setdefault((r["part"], r["entry"]), {})
            own[r["place"]] = own.get(r["place"], 0) + (r["total"] << 32 * r["limb"])
        for (i, m), own in got.items():
            books[i][m] = [own[j + 1] // own[0] for j in range(each)]
        shipped.unpersist()
    return books, width


def printed(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components as decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """``(vec_id, label, code, error)`` of every sound row, two hex digits a part, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: from 1 to 256 entries")
    rows = materialize(sound_vectors(embeddings, id_column, vector, label), "codes-vectors")
    books, width = fit(rows, scale, parts, entries, rounds)
    spark, kinds = embeddings.sparkSession, {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shipped = spark.sparkContext.broadcast(_trees(books) if books else [])

    def encode(batches):
        for batch in batches:
            code, error = [""] * batch.num_rows, np.zeros(batch.num_rows, object)
            for _, _, at, d in assigned(batch, shipped.value, width, scale):
                code = [c + f"{m:02x}" for c, m in zip(code, at)]
                error = error + d.astype(object)
            fits = [int(x) if x < 1 << 63 else None for x in error]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(code, pa.string()), pa.array(fits, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = materialize(rows.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes-rows")
    discard(rows)
    return coded, books


def query(spark, sf_dir: str) -> DataFrame:
    """``op13``: the code and error of every sound vector, and the error of its label."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(printed(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same for vectors of one length that the parts divide: every part against every entry, one table for each round."""
    steps = [f"""
WITH sound AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT r, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v FROM sound, range({parts}) t(part)
), book0 AS MATERIALIZED (
  SELECT part, r - 1 AS entry, v FROM cut WHERE r <= {entries}
)"""]
    near = "SELECT r, part, min(struct_pack(d := list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry := entry)) AS m FROM cut c JOIN book{i} b USING (part) GROUP BY r, part"
    for i in range(rounds):
        steps.append(f"""near{i} AS MATERIALIZED ({near.format(i=i)}), mean{i} AS (
  SELECT part, entry, list(s ORDER BY place) AS v FROM (
    SELECT part, m.entry AS entry, place, CAST(floor(sum(v[place])::HUGEINT // count(*)) AS BIGINT) - CAST(sum(v[place])::HUGEINT % count(*) < 0 AS BIGINT) AS s
    FROM near{i} JOIN cut USING (r, part), range(1, 1 + (SELECT max(len(v)) FROM cut)) t(place) GROUP BY ALL) GROUP BY ALL
), book{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN mean{i} m USING (part, entry))""")
    steps.append(f"""near{rounds} AS MATERIALIZED ({near.format(i=rounds)}), coded AS (
  SELECT r, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r
), sha AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM sound JOIN coded USING (r), sha
""")
    return ", ".join(steps)
