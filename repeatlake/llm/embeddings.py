"""Embedding near-duplicates by product quantisation.

An index is fitted on a bounded sample: unit centroids of coarse cells, about
half the square root of the number of vectors, and for the residuals of their
members one codebook in each subspace. Every vector is listed in its cell with
a code in each subspace and the length of what the codes leave over. It looks
for its links in the list of its own cell and of all cells of higher numbers
that a vector within the angle could be in. A step within the angle changes the
difference of two cells' scores by at most ``sin(angle)`` times their distance,
which is what ``exact=True`` probes by, and loses nothing. Without it the reach is cut
to ``REACH`` standard errors where that is less: on the sample, how much of a
step between neighbours, and of what members differ from their cell's mean, lies along the
directions to the cells around is measured for each cell, so that vectors near
a subspace of few dimensions get the wider reach that they need. The pair is met once, from
the side of the lower cell. In a list, asymmetric distances are sums of looked-up dot
products; the leftover length bounds their error, so what is sorted out is
certainly too far.

What travels is a vector's direction in 16 bits for each component, with the
length of its rounding error. The cosine of two of them is known to within the
sum of both errors; that decides nearly every pair that the look-ups leave, and
the few that lie as near to the threshold as that are reranked by exact cosines
of the vectors themselves, in double precision.

Equal vectors are one entry with a weight. Lists and the queries that reach
them are cut into tiles by hashes, and a task works on one pair of tiles at a
time, so a hot cell is spread over many tasks. From a tile come the number of
links of each vector and a spanning forest of the links, never all pairs.

Vectors of one length are compared with each other; each length has its own index.

Cases: vectors that are null or zero, or hold null or non-finite components, link
with nothing and stay. A null ``vec_id`` takes no part and has no component.
Repeated rows link with each other. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatlake.llm.arrow import map_rows
from repeatlake.llm.labelled import first_by_hash
from repeatlake.llm.simhash import forest
from repeatlake.operators.components import connected_components
from repeatlake.plans.storage import materialize

COSINE = 0.95
SAMPLE, MEMBERS = 8192, 16  # vectors that the index is fitted on, or so many for each cell if that is more
CODES = 64
REACH, AROUND = 4.0, 8  # standard errors of a step; cells around one, along whose directions steps are measured
SLACK = 1e-4
LIST_TILE, QUERY_TILE = 2048, 8192
CHUNK = 1024


def _unit(raw: np.ndarray) -> np.ndarray:
    v = raw.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _packed(x: np.ndarray) -> list[bytes]:
    """Unit vectors in 16 bits a component, after the scale and the length of the rounding error."""
    scale = (np.abs(x).max(axis=1) / 32767).astype(np.float32)
    q = np.rint(x / scale[:, None].astype(np.float64)).astype(np.int16)
    error = np.linalg.norm(x - q * scale[:, None].astype(np.float64), axis=1) * 1.000001 + 1e-12
    head = np.stack([scale, np.nextafter(error.astype(np.float32), np.float32(1))], axis=1)
    return [h.tobytes() + r.tobytes() for h, r in zip(head, q)]


def _unpacked(packed: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rounded vectors, and the lengths of their errors."""
    raw = np.frombuffer(b"".join(p[: 8 + 2 * dim] for p in packed), np.uint8).reshape(len(packed), 8 + 2 * dim)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    return np.ascontiguousarray(raw[:, 8:]).view(np.int16) * head[:, :1].astype(np.float64), head[:, 1].astype(np.float64)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng, unit: bool) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = np.concatenate([(x[i : i + CHUNK] @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1) for i in range(0, len(x), CHUNK)])
        sums, many = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
        if unit:
            length = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(length > 0, centres / np.where(length > 0, length, 1), centres)
    return centres


def cells_for(vectors: int) -> int:
    return max(1, math.isqrt(vectors) // 2)


class Index:
    """Cells and codebooks: what grows with the square root of the table, and the vectors' length."""

    def __init__(self, sample: np.ndarray, cosine: float = COSINE, cells: int | None = None, seed: int = 7, exact: bool = False):
        rng, self.dim, self.cosine = np.random.default_rng(seed), sample.shape[1], cosine
        self.most = math.sqrt(max(0.0, 1 - cosine * cosine)) if cosine > 0 else 1.0
        self.subspaces = next(m for m in (8, 4, 2, 1) if self.dim % m == 0)
        self.cells = _kmeans(sample, max(1, min(cells or cells_for(len(sample)), len(sample) // MEMBERS)), 8, rng, unit=True)
        at = np.concatenate([(sample[i : i + CHUNK] @ self.cells.T).argmax(axis=1) for i in range(0, len(sample), CHUNK)])
        self.reach = np.full(len(self.cells), np.inf) if exact else REACH * math.sqrt(2 - 2 * cosine) * self._spread(sample, at)
        self.books = [_kmeans(part, CODES, 6, rng, unit=False) for part in np.split(sample - self.cells[at], self.subspaces, axis=1)]

    def _spread(self, sample: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each cell the standard deviation of unit steps along the directions to the cells around it, at least that of random directions."""
        out = np.full(len(self.cells), 1 / math.sqrt(self.dim))
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(len(self.cells) + 1))
        for c in range(len(self.cells)):
            own, away = sample[order[cuts[c] : cuts[c + 1]]], self.cells - self.cells[c]
            gap = np.linalg.norm(away, axis=1)
            near = np.argsort(np.where(gap > 0, gap, np.inf), kind="stable")[: min(AROUND, int((gap > 0).sum()))]
            if len(own) < 3 or not len(near):
                continue
            toward = away[near] / gap[near][:, None]
            alike = own @ own.T
            np.fill_diagonal(alike, -2)
            for steps in (own - own[alike.argmax(axis=1)], own - own.mean(axis=0)):
                length = (steps * steps).sum(axis=1)
                steps, length = steps[length > 1e-12], length[length > 1e-12]
                if len(steps) > 2:
                    out[c] = max(out[c], math.sqrt(((steps @ toward.T) ** 2 / length[:, None]).mean()))
        return out

    def code(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors of known cells the codes, and the length of what is left over."""
        rest = x - self.cells[cell]
        codes = np.empty((len(x), self.subspaces), np.uint8)
        for m, (part, book) in enumerate(zip(np.split(rest, self.subspaces, axis=1), self.books)):
            codes[:, m] = (part @ book.T - 0.5 * (book**2).sum(axis=1)).argmax(axis=1)
        found = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return codes, np.linalg.norm(rest - found, axis=1)

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors their own cells, and ``(row, cell)`` of the cells of higher numbers where their links may be."""
        cell, rows, cells = [], [], []
        for at in range(0, len(x), CHUNK):
            score = x[at : at + CHUNK] @ self.cells.T
            best = score.argmax(axis=1)
            apart = np.sqrt(np.maximum(0, 2 - 2 * (self.cells[best] @ self.cells.T)))
            reach = np.minimum(self.most, np.maximum(self.reach[best][:, None], self.reach[None, :])) * apart + 1e-9
            near = (score >= score[np.arange(len(best)), best][:, None] - reach) & (np.arange(len(self.cells)) > best[:, None])
            i, j = np.nonzero(near)
            cell.append(best)
            rows.append(i + at)
            cells.append(j)
        return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (cell, rows, cells))

    def near(self, query: np.ndarray, cell: int, codes: np.ndarray, left: np.ndarray, chunk: int = 256):
        """Index pairs (query, listed) of one cell that the look-ups do not rule out."""
        for at in range(0, len(query), chunk):
            some = query[at : at + chunk]
            # rows are listed vectors, so that a look-up copies a whole row of dot products; single precision errs by far less than SLACK
            found = np.repeat((self.cells[cell] @ some.T).astype(np.float32)[None], len(codes), axis=0)
            for m, (part, book) in enumerate(zip(np.split(some, self.subspaces, axis=1), self.books)):
                found += (book @ part.T).astype(np.float32)[codes[:, m]]
            j, i = np.nonzero(found >= (self.cosine - SLACK - left)[:, None])
            for k in range(0, len(i), 1 << 16):
                yield i[k : k + (1 << 16)] + at, j[k : k + (1 << 16)]


def sound(vector: Column) -> Column:
    """Whether a vector can link at all."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def entries(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """All rows, the distinct vectors ``(rep, many, h1, h2, dim, packed)``, and each length with how many have it.

    Vectors are told apart by 128 bits of hashes of all their components.
    """
    kind = "array<double>" if dict(embeddings.dtypes).get(vector) != "array<float>" else "array<float>"
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    rows = rows.withColumn("vector", F.when(F.col("vec_id").isNotNull() & sound(F.col("vector")), F.col("vector")))
    rows = rows.withColumn("h1", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))).withColumn("h2", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit("wide"), "vector")))

    def make():
        def each(batch: pa.RecordBatch):
            many = pa.compute.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
            packed: list = [None] * len(batch)
            for dim in np.unique(many):
                at = np.flatnonzero(many == dim)
                for k, p in zip(at, _packed(_unit(np.asarray(batch.column(3).take(pa.array(at)).flatten(), np.float64).reshape(-1, dim)))):
                    packed[k] = p
            yield {"vec_id": batch.column(0), "h1": batch.column(1), "h2": batch.column(2), "dim": many, "packed": packed}

        return each

    coded = map_rows(rows.where("vector is not null").select("vec_id", "h1", "h2", "vector"), "vec_id long, h1 long, h2 long, dim long, packed binary", make)
    reps = coded.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("dim").alias("dim"), F.first("packed").alias("packed"))
    reps = materialize(reps, "pq-entries")
    return rows, reps, [(r["dim"], r["count"]) for r in reps.groupBy("dim").count().orderBy("dim").collect()]


def fit(reps: DataFrame, dim: int, many: int, cosine: float = COSINE, exact: bool = False) -> Index:
    """An index fitted on a sample of the ``many`` distinct vectors, chosen by a hash of their ids."""
    cells = cells_for(many)
    got = first_by_hash(reps.select("rep", "packed"), max(SAMPLE, MEMBERS * cells), "rep").collect()
    return Index(_unit(_unpacked([bytes(r["packed"]) for r in got], dim)[0]), cosine, cells, exact=exact)


FIRST, SECOND, QUERY = 0, 1, 2  # parts of a tile: listed, listed in another tile of the cell, and queries of other cells


def links(reps: DataFrame, index: Index) -> DataFrame:
    """``(a, b, n)``: with a null ``b`` the weight of links that ``a`` has in one tile, else an edge, or with a null ``n`` a pair too near the threshold to tell."""
    spark, dim = reps.sparkSession, index.dim
    shared = spark.sparkContext.broadcast(index)

    def deal(batches):
        own = shared.value
        for batch in batches:
            plain = batch.column(2).to_pylist()
            x, error = _unpacked(plain, dim)
            cell, row, to = own.probes(x)
            codes, left = own.code(x, cell)
            listed = [p + c.tobytes() + e.tobytes() for p, c, e in zip(plain, codes, (left + error).astype(np.float32))]
            at = np.concatenate([np.arange(len(x)), row])
            packed = pa.array(listed + [plain[k] for k in row], pa.binary())
            rep, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            columns = [pa.array(np.concatenate([cell, to]).astype(np.int32)), pa.array(np.arange(len(at)) >= len(x)), pa.array(rep[at]), pa.array(weight[at]), packed]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "asks", "rep", "many", "packed"])

    def count(batches):
        # a row for each cell that a batch touches; the vectors themselves are dealt again below, which costs less than to write them
        for batch in batches:
            cell, _, to = shared.value.probes(_unpacked(batch.column(2).to_pylist(), dim)[0])
            size = len(shared.value.cells)
            many = np.stack([np.bincount(cell, minlength=size), np.bincount(to, minlength=size)])
            some = np.flatnonzero(many.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(many[0, some]), pa.array(many[1, some])], names=["c", "listed", "asked"])

    source = reps.select("rep", "many", "packed")
    sizes = source.mapInArrow(count, "c int, listed long, asked long").groupBy("c").agg(F.sum("listed").alias("listed"), F.sum("asked").alias("asked"))
    parts = lambda n, tile: F.greatest(F.lit(1), F.ceil(F.col(n) / tile)).cast("int")
    tiles = materialize(sizes.where("listed > 0").select("c", parts("listed", LIST_TILE).alias("lt"), parts("asked", QUERY_TILE).alias("qt")), "pq-tiles")
    dealt = source.mapInArrow(deal, "cell int, asks boolean, rep long, many long, packed binary").join(F.broadcast(tiles), F.col("cell") == F.col("c"))  # a row for each cell
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("asks"), F.col("qt")).otherwise(F.col("lt"))).cast("int")
    # the first tile of queries is worked on with the list itself, the others on their own
    spot = lambda i, j, part: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(part).alias("part"))
    lists = F.sequence(F.lit(0), F.col("lt") - 1)
    asked = F.transform(lists, lambda i: spot(i, F.when(F.col("mine") == 0, i).otherwise(-F.col("mine")), QUERY))
    pairs = F.transform(lists, lambda k: spot(F.least(k, F.col("mine")), F.greatest(k, F.col("mine")), FIRST))
    more = F.when(F.col("qt") > 1, F.sequence(F.lit(1), F.col("qt") - 1)).otherwise(F.array().cast("array<int>"))
    held = F.concat(pairs, F.transform(more, lambda q: spot(F.col("mine"), -q, FIRST)))
    tiled = dealt.withColumn("mine", mine).withColumn("s", F.explode(F.when(F.col("asks"), asked).otherwise(held)))
    part = F.when((F.col("s.part") == FIRST) & (F.col("s.j") > F.col("s.i")) & (F.col("s.j") == F.col("mine")), SECOND).otherwise(F.col("s.part")).cast("int")
    keyed = tiled.select("cell", F.col("s.i").alias("i"), F.col("s.j").alias("j"), part.alias("part"), "rep", "many", "packed")

    def join(batches):
        own = shared.value

        def tile(table: pa.Table):
            cell, part = table.column("cell")[0].as_py(), table.column("part").to_numpy()
            rep, many, packed = table.column("rep").to_numpy(), table.column("many").to_numpy(), table.column("packed").to_pylist()
            x, error = _unpacked(packed, dim)
            base, found, linked, unsure = np.flatnonzero(part == FIRST), np.zeros(len(rep), np.int64), [], []
            codes = np.frombuffer(b"".join(packed[k][8 + 2 * dim : -4] for k in base), np.uint8).reshape(len(base), -1)
            left = np.frombuffer(b"".join(packed[k][-4:] for k in base), np.float32)
            same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
            for asking, self_join in ((np.flatnonzero(part == (SECOND if (part == SECOND).any() else FIRST)), same), (np.flatnonzero(part == QUERY), False)):
                if not len(base) or not len(asking) or not same and part[asking[0]] == FIRST:
                    continue
                for i, j in own.near(x[asking], cell, codes, left + error[asking].max()):
                    a, b = asking[i], base[j]
                    if self_join:
                        a, b = a[a < b], b[a < b]
                    dot, room = np.einsum("ij,ij->i", x[a], x[b]), error[a] + error[b] + 1e-12
                    sure = (dot >= own.cosine + room) & (rep[a] != rep[b])
                    doubt = (np.abs(dot - own.cosine) < room) & (rep[a] != rep[b])
                    np.add.at(found, a[sure], many[b[sure]])
                    np.add.at(found, b[sure], many[a[sure]])
                    linked.append((a[sure], b[sure]))
                    unsure.append((rep[a[doubt]], rep[b[doubt]]))
            root = forest(len(rep), ((np.minimum(a, b), np.maximum(a, b)) for a, b in linked))
            away, some = np.flatnonzero(root != np.arange(len(rep))), np.flatnonzero(found)
            ua, ub = (np.concatenate([u[k] for u in unsure]) if unsure else np.zeros(0, np.int64) for k in (0, 1))
            first = np.concatenate([rep[some], rep[away], ua])
            second = pa.array(np.concatenate([np.zeros(len(some), np.int64), rep[root[away]], ub]), mask=np.arange(len(first)) < len(some))
            n = pa.array(np.concatenate([found[some], np.zeros(len(away) + len(ua), np.int64)]), mask=np.arange(len(first)) >= len(some) + len(away))
            return pa.RecordBatch.from_arrays([pa.array(first), second, n], names=["a", "b", "n"])

        held: list[pa.RecordBatch] = []  # of one tile
        last = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, np.int64)
            for start, end in zip(cuts, [*cuts[1:], len(keys)]):
                key = tuple(keys[start])
                if held and key != last:
                    yield tile(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, end - start))
                last = key
        if held:
            yield tile(pa.Table.from_batches(held))

    return keyed.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(join, "a long, b long, n long")


def reranked(pairs: DataFrame, rows: DataFrame, cosine: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose vectors have an exact cosine of at least ``cosine``, in double precision."""
    raw = rows.where("vector is not null").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    left, right = raw.select(F.col("vec_id").alias("a"), F.col("vector").alias("x")), raw.select(F.col("vec_id").alias("b"), F.col("vector").alias("y"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    both = pairs.join(left, "a").join(right, "b")
    return both.where(dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y")) >= cosine).select("a", "b")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector: str = "embedding", exact: bool = False) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row; ``exact`` probes every list that may hold a link."""
    rows, reps, lengths = entries(embeddings, id_column, vector)
    found, empty = None, F.lit(None).cast("long")
    for dim, many in lengths:
        alike = reps.where(F.col("dim") == dim) if len(lengths) > 1 else reps
        some = links(alike, fit(alike, dim, many, cosine, exact))
        found = some if found is None else found.unionByName(some)
    classes = reps.select("h1", "h2", F.col("rep").alias("component"), (F.col("many") - 1).alias("links"))
    if found is not None:
        found = materialize(found, "pq-links")
        edges, total = found.where("b is not null and n is not null").select("a", "b"), found.where("b is null").select("a", "n")
        unsure = found.where("n is null").select("a", "b")
        if not unsure.isEmpty():
            exact = materialize(reranked(unsure, rows, cosine), "pq-exact")
            weights = reps.select(F.col("rep").alias("w"), F.col("many").alias("n"))
            other = lambda x, y: exact.join(weights, exact[y] == weights["w"]).select(F.col(x).alias("a"), "n")
            edges, total = edges.unionByName(exact), total.unionByName(other("a", "b")).unionByName(other("b", "a"))
        groups = connected_components(edges)
        total = total.groupBy(F.col("a").alias("t")).agg(F.sum("n").alias("found"))
        joined = reps.join(groups, reps["rep"] == groups["node"], "left").join(total, F.col("rep") == F.col("t"), "left")
        classes = joined.select("h1", "h2", F.coalesce("component", "rep").alias("component"), (F.coalesce("found", F.lit(0)) + F.col("many") - 1).alias("links"))
    classes = materialize(classes, "pq-classes").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "component", "links")
    out = rows.select("vec_id", "h1", "h2").join(classes, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).otherwise(empty)
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    """``op5``: links at cosine 0.95 or more among all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
