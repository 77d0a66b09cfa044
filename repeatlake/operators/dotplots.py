"""k-mers shared by the two sequences of a pair, compared where the sequences have met."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatlake.operators import kmers
from repeatlake.plans.storage import materialize

SCHEMA = "kmer long, kind_a string, kind_b string, dots long, first_a long, first_b long"
KINDS = ("tr", "fl")


def dots(seqs: DataFrame, k: int, inner: int, outer: int, loci: DataFrame) -> DataFrame:
    """``(pair, kmer, kind_a, kind_b, dots, first_a, first_b)`` of ``seqs(locus, seq)``: loci 2n and 2n + 1 are side a and b of pair n.

    Only sequences are shuffled, for pairs of at most ``kmers.LONG`` bases; the
    k-mers of longer ones are grouped and joined. ``loci``: ``(locus, n)``, bases of every row (at least).
    """
    pair = F.floor(F.col("locus") / 2).alias("pair")
    sized = loci.groupBy(pair).agg(F.sum("n").alias("n"), F.count_distinct(F.col("locus") % 2).alias("sides"))
    rows = seqs.where("locus is not null").select(pair, (F.col("locus") % 2).cast("int").alias("side"), "locus", "seq")
    met = rows.select("pair", "side", "seq")
    far = sized.where((F.col("n") > kmers.LONG) & (F.col("sides") > 1)).select("pair")
    near = lambda x: x.groupBy("pair").applyInArrow(lambda g: _dots(g, k, inner, outer), f"pair long, {SCHEMA}")
    if far.isEmpty():
        return near(met)
    far = materialize(far, "long-pairs")
    return near(met.join(far, "pair", "left_anti")).unionByName(_dots_by_join(rows.join(far, "pair", "left_semi"), k, inner, outer))


def _kinds(table: pa.Table, side: int, k: int, inner: int, outer: int) -> list[tuple[np.ndarray, ...]]:
    """For each kind, the sorted k-mers of a side, how many windows have them and where the first lies."""
    found = []
    for of, seq in zip(table.column("side").to_pylist(), table.column("seq")):
        if of == side and seq.is_valid:
            raw = np.frombuffer(seq.as_buffer(), np.uint8)
            at, kmer = kmers.valid_windows(raw, k)
            found.append((at, kmer, np.full(len(at), len(raw) - inner - k)))
    pos, kmer, last = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    tr = (pos >= inner) & (pos <= last)
    flank = ((pos >= inner - outer) & (pos <= inner - 1) | (pos >= last + 1) & (pos <= last + outer)) & ~tr
    out = []
    for kind in (tr, flank):
        p, m = pos[kind], kmer[kind]
        order = np.lexsort((p, m))
        m, starts, n = np.unique(m[order], return_index=True, return_counts=True)
        out.append((m, n, p[order][starts]))
    return out


def _dots(table: pa.Table, k: int, inner: int, outer: int) -> pa.Table:
    a, b = (_kinds(table, side, k, inner, outer) for side in (0, 1))
    parts = []
    for i, (ma, na, fa) in enumerate(a):
        for j, (mb, nb, fb) in enumerate(b):
            both, x, y = np.intersect1d(ma, mb, assume_unique=True, return_indices=True)
            parts.append([both, np.full(len(both), KINDS[i], object), np.full(len(both), KINDS[j], object), na[x] * nb[y], fa[x], fb[y]])
    columns = [np.concatenate(c) for c in zip(*parts)]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    pair = table.column("pair")[0].as_py()
    names = ["pair", *(f.split()[0] for f in SCHEMA.split(", "))]
    return pa.Table.from_arrays([pa.array([pair] * len(columns[0]), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)


def _dots_by_join(rows: DataFrame, k: int, inner: int, outer: int) -> DataFrame:
    rows = kmers.codes(rows.withColumn("length", F.length("seq")), ["pair", "side", "length"], k)
    rows = rows.withColumn("kind", kmers.region(F.col("pos"), F.col("length"), k, inner, outer)).where("kind is not null")
    rows = rows.groupBy("pair", "side", "kmer", "kind").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first"))
    of = lambda side, name: rows.where(F.col("side") == side).select("pair", "kmer", *(F.col(c).alias(f"{c}_{name}") for c in ("kind", "n", "first")))
    n: Column = F.col("n_a") * F.col("n_b")
    return of(0, "a").join(of(1, "b"), ["pair", "kmer"]).select("pair", "kmer", "kind_a", "kind_b", n.alias("dots"), "first_a", "first_b")
