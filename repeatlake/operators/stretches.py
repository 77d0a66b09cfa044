"""k-mers of two tables brought together as stretches that share a minimizer, several k-mers to a number.

Of a k-mer of 21 bases the minimizer is the one of its 11-mers (of either strand) with
the least hash; neighbouring k-mers mostly have the same, so they go to the same bucket as one
stretch of at most 31 bases, a number of 62 bits. A k-mer has one bucket wherever it
occurs. Buckets are about 2^19 bases of the input each; stretches of a batch travel packed, a blob for each bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from repeatlake.functions import sequence as S
from repeatlake.operators import kmers

M = 11  # bases of a minimizer
TOGETHER = 1 << 20  # bases cut into stretches at a time
NONE = np.iinfo(np.int64).min  # in the place of an id that is null


def mixed(x: np.ndarray, turn: int = 0) -> np.ndarray:
    """64 bits that look random (splitmix64)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) & (1 << 64) - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def _rolled(b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(b) - k + 1
    forward, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t in range(k):
        part = b[t : t + n].astype(np.int64) & 3
        forward = forward << 2 | part
        back |= (3 - part) << 2 * t
    return forward, back


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of ``width`` neighbours."""
    n, have, out = len(x) - width + 1, 1, x
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n])


def _cut(rows: list[np.ndarray], k: int, chosen, probes: int):
    """Row, first position, number and code of each stretch of some rows' valid windows, its minimizer's hash, and which of its windows are probes (bits)."""
    digit = np.full(256, 4, np.uint8)
    digit[[ord(x) for x in S.BASES]] = range(4)
    size = np.array([len(r) + 1 for r in rows])
    b = np.full(size.sum() + k, 4, np.uint8)
    first = np.cumsum(size) - size
    for f, r in zip(first, rows):
        b[f : f + len(r)] = digit[r]
    forward, _ = _rolled(b, k)
    one, other = _rolled(b, M)
    least = _least(mixed(np.minimum(one, other)), k - M + 1)
    bad = np.concatenate([[0], np.cumsum(b > 3)])
    at = np.flatnonzero(bad[k:] == bad[: len(forward)])
    row = np.repeat(np.arange(len(rows)), size)[at] if len(at) else at
    pos = at - first[row]
    mark = np.zeros(len(at), np.int64)
    if probes and len(at):
        many = np.bincount(row, minlength=len(rows))
        i, n = np.arange(len(at)) - (np.cumsum(many) - many)[row], many[row]
        step = n // (probes - 1)
        mark = ((i == n - 1) | (i == 0) | (step > 0) & (i % np.maximum(step, 1) == 0) & (i < (probes - 1) * step)).astype(np.int64)
    if chosen:
        some = chosen(pos, size[row] - 1)
        at, row, pos, mark = at[some], row[some], pos[some], mark[some]
    if not len(at):
        return None
    turn = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])])
    start = np.flatnonzero(turn)
    place = np.arange(len(at)) - start[np.cumsum(turn) - 1]
    start = np.flatnonzero(place % (S.MAX_K - k + 1) == 0)  # as many windows as there is room for
    place = np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))
    n = np.diff(start, append=len(at))
    more = 2 * (n - 1)
    code = forward[at[start]] << more | forward[at[start] + n - 1] & (np.int64(1) << more) - 1
    return row[start], n, code, least[at[start]], np.bitwise_or.reduceat(mark << place, start)


def packed(rows: DataFrame, id: str, k: int, buckets: int, chosen=None, probes: int = 0) -> DataFrame:
    """``(bucket, n, blob)`` of ``rows(id, seq)``, and of ``mate`` where it is there: the stretches of each bucket in a batch.

    ``chosen(pos, length)`` tells which windows are wanted, default all; ``probes`` marks as many of a row as :func:`kmers.codes` does.
    """
    mates = "mate" in rows.columns

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            texts = pa.types.is_string(ids.type)
            ids = ids if texts else ids.fill_null(int(NONE)).to_numpy(zero_copy_only=False)
            mate = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8) if mates else np.zeros(batch.num_rows, np.uint8)
            for numbers, raws in kmers._rows_together(batch, batch.num_columns - 1, TOGETHER, 1):
                found = _cut(raws, k, chosen, probes)
                if found is None:
                    continue
                row, n, code, least, mark = found
                row = np.array(numbers)[row]
                bucket = (mixed(least, 1) >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                row, n, code, mark, bucket = row[order], n[order], code[order], mark[order], bucket[order]
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                blobs = []
                for low, high in zip(edge, np.append(edge[1:], len(bucket))):
                    part = slice(low, high)
                    blob = code[part].tobytes() + n[part].astype(np.uint8).tobytes() + mate[row[part]].tobytes() + mark[part].astype(np.uint16).tobytes()
                    if texts:
                        names = [x.encode() for x in ids.take(pa.array(row[part])).to_pylist()]
                        blob += np.array([len(x) for x in names], np.int32).tobytes() + b"".join(names)
                    else:
                        blob += np.diff(ids[row[part]], prepend=0).tobytes()
                    blobs.append(np.int32(len(blob)).tobytes() + pa.compress(blob, "zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge], pa.int32()), pa.array(np.diff(edge, append=len(bucket)), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "n", "blob"])

    return rows.select(id, *(["mate"] if mates else []), "seq").mapInArrow(run, "bucket int, n int, blob binary")


def _unpacked(table: pa.Table, k: int, texts: bool):
    """``(id, mate, kmer, probe)`` of all windows in the blobs of a bucket; with ``texts``, ids are numbers of the names that come with them."""
    codes, many, mates, marks, ids, names = [], [], [], [], [], []
    for n, blob in zip(table.column("n").to_pylist(), table.column("blob")):
        raw = memoryview(blob.as_buffer())
        raw = pa.decompress(raw[4:], int(np.frombuffer(raw[:4], np.int32)[0]), "zstd", asbytes=True)
        codes.append(np.frombuffer(raw, np.int64, n))
        many.append(np.frombuffer(raw, np.uint8, n, 8 * n))
        mates.append(np.frombuffer(raw, np.uint8, n, 9 * n))
        marks.append(np.frombuffer(raw, np.uint16, n, 10 * n))
        if texts:
            ends = np.cumsum(np.frombuffer(raw, np.int32, n, 12 * n)) + 16 * n
            names += [raw[a:b] for a, b in zip(np.concatenate([[16 * n], ends[:-1]]).tolist(), ends.tolist())]
        else:
            with np.errstate(over="ignore"):
                ids.append(np.cumsum(np.frombuffer(raw, np.int64, n, 12 * n)))
    if not codes:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, []
    if texts:
        names, of = np.unique(np.array(names, object), return_inverse=True)
    else:
        of = np.concatenate(ids)
    code, n, mate, mark = np.concatenate(codes), np.concatenate(many).astype(np.int64), np.concatenate(mates), np.concatenate(marks).astype(np.int64)
    rep = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
    forward = code[rep] >> 2 * (n[rep] - 1 - place) & (1 << 2 * k) - 1
    back = np.zeros(len(forward), np.int64)
    for t in range(k):
        back = back << 2 | 3 - (forward >> 2 * t & 3)
    return of[rep], mate[rep], np.minimum(forward, back), mark[rep] >> place & 1, names


def _index_of(table: pa.Table, k: int):
    """Sorted distinct k-mers of a bucket's index, where each one's loci start, and the loci, distinct and sorted for each."""
    locus, _, kmer, _, _ = _unpacked(table, k, False)
    order = np.lexsort((locus, kmer))
    locus, kmer = locus[order], kmer[order]
    new = np.concatenate([[True], (kmer[1:] != kmer[:-1]) | (locus[1:] != locus[:-1])]) if len(kmer) else np.zeros(0, bool)
    locus, kmer = locus[new], kmer[new]
    starts = np.flatnonzero(np.concatenate([[True], kmer[1:] != kmer[:-1]])) if len(kmer) else np.zeros(0, np.int64)
    return kmer[starts], starts, locus


def _classes(starts: np.ndarray, locus: np.ndarray):
    """The class of each k-mer of :func:`_index_of`, as :func:`align.locus_classes` has it: a single locus and 0, or 128 bits of the hashes of the loci."""
    if not len(starts):
        return starts, starts
    many = np.diff(starts, append=len(locus))
    c1 = np.bitwise_xor.reduceat(mixed(locus, 2), starts).view(np.int64)
    c2 = np.bitwise_xor.reduceat(mixed(locus, 3), starts).view(np.int64)
    single = (many == 1) & (locus[starts] != NONE)
    return np.where(single, locus[starts], c1), np.where(single, 0, np.where(c2 == 0, 1, c2))


def _met(index: DataFrame, reads: DataFrame, of, schema: str) -> DataFrame:
    return reads.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(of, schema)


def _table(columns, schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def class_hits(index: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """:func:`align.class_hits` of packed reads and a packed index: ``(pair_id, c1, c2, n1, n2, p1, p2)``."""
    schema = "pair_id long, c1 long, c2 long, n1 int, n2 int, p1 int, p2 int"

    def of(read, held):
        known, starts, locus = _index_of(held, k)
        pair, mate, kmer, probe, _ = _unpacked(read, k, False)
        at = np.minimum(np.searchsorted(known, kmer), max(0, len(known) - 1))
        hit = known[at] == kmer if len(known) else np.zeros(len(kmer), bool)
        c1, c2 = _classes(starts, locus)
        at, pair, mate, probe = at[hit], pair[hit], mate[hit], probe[hit]
        order = np.lexsort((c2[at], c1[at], pair))
        at, pair, mate, probe = at[order], pair[order], mate[order], probe[order]
        a, b = c1[at], c2[at]
        start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(at) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(x.astype(np.int64), start) if len(start) else start for x in (mate == 1, mate == 2, (mate == 1) & (probe > 0), (mate == 2) & (probe > 0))]
        return _table([pair[start], a[start], b[start], *sums], schema)

    from pyspark.sql import functions as F

    rows = _met(index, reads, of, schema).repartition("pair_id").groupBy("pair_id", "c1", "c2")
    return rows.agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "p1", "p2")))


def class_loci(index: DataFrame, k: int) -> DataFrame:
    """``(c1, c2, locus)`` of the classes of several loci, or of none that is known, each once."""

    def of(held):
        _, starts, locus = _index_of(held, k)
        c1, c2 = _classes(starts, locus)
        some = np.flatnonzero(c2 != 0)
        many = np.diff(starts, append=len(locus))
        _, one = np.unique(np.stack([c1[some], c2[some]]), axis=1, return_index=True) if len(some) else (None, some)
        some = some[one]
        n = many[some]
        at = np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = locus[at]
        return pa.Table.from_arrays([pa.array(np.repeat(c1[some], n)), pa.array(np.repeat(c2[some], n)), pa.array(found, pa.int64(), mask=found == NONE)], names=["c1", "c2", "locus"])

    return index.groupBy("bucket").applyInArrow(of, "c1 long, c2 long, locus long").distinct()


def read_hits(index: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """``(title, mate, kmer, n)`` of packed reads: rows of the join of their k-mers with those of the index, for each k-mer of a mate that has any."""
    schema = "title string, mate long, kmer long, n long"

    def of(read, held):
        known, starts, locus = _index_of(held, k)
        title, mate, kmer, _, names = _unpacked(read, k, True)
        at = np.minimum(np.searchsorted(known, kmer), max(0, len(known) - 1))
        hit = np.flatnonzero(known[at] == kmer) if len(known) else np.zeros(0, np.int64)
        hit = hit[np.lexsort((at[hit], mate[hit], title[hit]))]
        at, title, mate = at[hit], title[hit], mate[hit]
        start = np.flatnonzero(np.concatenate([[True], (title[1:] != title[:-1]) | (mate[1:] != mate[:-1]) | (at[1:] != at[:-1])])) if len(at) else np.zeros(0, np.int64)
        n = np.diff(start, append=len(at)) * np.diff(starts, append=len(locus))[at[start]] if len(at) else start
        text = pa.array([names[i].decode() for i in title[start]], pa.string())
        return _table([text, mate[start], known[at[start]] if len(at) else start, n], schema)

    return _met(index, reads, of, schema)


def mate_hits(index: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """``(title, mate, hits)`` of packed reads: how many of a mate's windows the index has."""
    schema = "title string, mate long, hits long"

    def of(read, held):
        known, _, _ = _index_of(held, k)
        title, mate, kmer, _, names = _unpacked(read, k, True)
        hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, kmer), len(known) - 1)] == kmer) if len(known) else np.zeros(0, np.int64)
        which, n = np.unique(title[hit] * 4 + mate[hit], return_counts=True)
        return _table([pa.array([names[i // 4].decode() for i in which], pa.string()), which % 4, n], schema)

    from pyspark.sql import functions as F

    return _met(index, reads, of, schema).groupBy("title", "mate").agg(F.sum("hits").alias("hits"))


def loci_lists(index: DataFrame, k: int, span: int | None = None) -> DataFrame:
    """``(kmer, loci)``: the sorted loci of each k-mer of a packed index; with ``span`` ``(kmer, chunk, loci)``, in chunks of as many locus numbers. A locus that is null is in no list."""

    def of(held):
        kmer, starts, locus = _index_of(held, k)
        of_kmer = np.repeat(np.arange(len(kmer)), np.diff(starts, append=len(locus)))
        null = locus == NONE
        chunk = np.where(null, NONE, locus // span) if span else np.zeros(len(locus), np.int64)
        start = np.flatnonzero(np.concatenate([[True], (of_kmer[1:] != of_kmer[:-1]) | (chunk[1:] != chunk[:-1])])) if len(locus) else np.zeros(0, np.int64)
        seen = np.concatenate([[0], np.cumsum(~null)])
        lists = pa.ListArray.from_arrays(pa.array(seen[np.append(start, len(locus))], pa.int32()), pa.array(locus[~null], pa.int64()))
        at = pa.array(chunk[start], pa.int64(), mask=chunk[start] == NONE)
        columns = {"kmer": pa.array(kmer[of_kmer[start]], pa.int64()), **({"chunk": at} if span else {}), "loci": lists}
        return pa.table(columns)

    return index.groupBy("bucket").applyInArrow(of, "kmer long, " + ("chunk long, " if span else "") + "loci array<long>")
