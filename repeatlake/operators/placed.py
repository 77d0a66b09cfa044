"""Assigned reads looked at where the sequence of their locus is: states, segments, genotypes, novel edges, baits.

Reads and the sequence of their locus meet in one group, so sequences are shuffled and
k-mers are not; a locus of many reads is several groups. For loci of one row; others are joined by k-mer (:mod:`repeatlake.operators.align`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from repeatlake.operators import kmers

MEASURES = "nt long, bs long, n_tr long, first long, second long, nk long, into long, left long, left_last long"
STATE_KINDS = {"fl": 1, "tr": 2}


def raw(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8) for x in column]


def windows(rows: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and canonical k-mer of all valid windows."""
    size = np.array([len(r) + 1 for r in rows])
    joined = np.full(size.sum() + k, ord("N"), np.uint8)
    first = np.cumsum(size) - size
    for f, r in zip(first, rows):
        joined[f : f + len(r)] = r
    at, kmer = kmers.valid_windows(joined, k)
    row = np.repeat(np.arange(len(rows)), size)[at] if len(at) else at
    return row, at - first[row], kmer


def look_up(known: np.ndarray, kmer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each k-mer is in the sorted ``known``, and where."""
    at = np.minimum(np.searchsorted(known, kmer), max(0, len(known) - 1))
    return (known[at] == kmer if len(known) else np.zeros(len(kmer), bool)), at


def held(seq: np.ndarray, k: int, inner: int, outer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted k-mers of a locus' repeat and flanks, whether some flank has each, and how often the repeat does."""
    pos, kmer = kmers.valid_windows(seq, k)
    last = len(seq) - inner - k
    tr = (pos >= inner) & (pos <= last)
    flank = ((pos >= inner - outer) & (pos <= inner - 1) | (pos >= last + 1) & (pos <= last + outer)) & ~tr
    some = tr | flank
    known, of = np.unique(kmer[some], return_inverse=True)
    return known, np.bincount(of, flank[some], len(known)) > 0, np.bincount(of, tr[some], len(known)).astype(np.int64)


class Group:
    """The reads of a group of a locus, the windows of them, and their states."""

    def __init__(self, reads: pa.Table, source: pa.Table, k: int, inner: int, outer: int):
        self.reads, self.k, self.inner = reads, k, inner
        self.seq = raw(source.column("seq"))[0]
        self.raws = raw(reads.column("seq"))
        self.known, self.flank, self.most = held(self.seq, k, inner, outer)
        self.row, self.pos, self.kmer = windows(self.raws, k)
        self.hit, self.at = look_up(self.known, self.kmer)
        self.state = np.zeros(len(self.kmer), np.int64)
        if len(self.known):
            self.state = np.where(self.hit, np.where(self.flank[self.at], STATE_KINDS["fl"], STATE_KINDS["tr"]), 0)

    def table(self, rows: np.ndarray, keep: list[str], columns: dict) -> pa.Table:
        at = pa.array(rows)
        out = {c: self.reads.column(c).take(at) for c in keep}
        return pa.table(out | {n: c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for n, c in columns.items()})

    def states(self, keep: list[str]) -> pa.Table:
        return self.table(self.row, keep, {"pos": self.pos, "kmer": self.kmer, "state": self.state})

    def measures(self) -> tuple[np.ndarray, dict]:
        """Reads with a window, and what :func:`align.segment` counts of each one's states."""
        n = len(self.raws)
        some = np.flatnonzero(np.bincount(self.row, minlength=n) > 0)
        k = np.flatnonzero(self.state > 0)
        row, pos, state = self.row[k], self.pos[k], self.state[k]
        turn = np.zeros(len(k), bool)
        turn[1:] = (row[1:] == row[:-1]) & (state[1:] != state[:-1])
        t = np.flatnonzero(turn)
        seen, here, of = pos[t - 1], pos[t], row[t]
        edge = np.where(here - seen > 1, (seen + 1 + here) // 2, here)
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        bs = np.zeros(n, np.int64)
        bs[row[head]] = state[head]
        nk = np.zeros(n, np.int64)
        np.maximum.at(nk, self.row, self.pos + 1)

        def bound(values, least):
            out = np.full(n, np.iinfo(np.int64).max if least else -1)
            (np.minimum if least else np.maximum).at(out, of, values)
            return out

        nt = np.bincount(of, minlength=n)
        null = lambda values, missing: pa.array(values[some], pa.int64(), mask=missing[some])
        no = nt == 0
        out = {
            "nt": pa.array(nt[some], pa.int64()), "bs": null(bs, bs == 0), "n_tr": pa.array(np.bincount(self.row[self.state == 2], minlength=n)[some], pa.int64()),
            "first": null(bound(edge, True), no), "second": null(bound(edge, False), no), "nk": pa.array(nk[some], pa.int64()),
            "into": null(bound(here, True), no), "left": null(bound(seen + 1, True), no), "left_last": null(bound(seen + 1, False), no),
        }
        return some, out

    def kept(self, least_spanning: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each read is kept, and the observed bounds of its repeat, as :func:`align.bounds` has them."""
        some, m = self.measures()
        m = {c: v.fill_null(0).to_numpy(zero_copy_only=False) for c, v in m.items()}
        nt, bs = m["nt"], m["bs"]
        kept = (nt == 0) & (bs == 2) | (nt == 1) | (nt == 2) & (bs == 1) & (m["n_tr"] >= least_spanning)
        low = np.where(bs == 2, 0, m["into"])
        high = np.where(nt == 0, m["nk"], np.where((nt == 1) & (bs == 2), m["left"], np.where(nt == 1, m["nk"], m["left_last"])))
        out = [np.zeros(len(self.raws), x.dtype) for x in (kept, low, high)]
        for o, x in zip(out, (kept, low, high)):
            o[some] = x
        return tuple(out)

    def of_locus(self, columns: dict) -> pa.Table:
        n = len(next(iter(columns.values())))
        return pa.table({"locus": pa.array([self.reads.column("locus")[0].as_py()] * n, self.reads.schema.field("locus").type)} | {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in columns.items()})

    def genotype(self) -> pa.Table:
        kept, _, _ = self.kept()
        kmer, n = np.unique(self.kmer[(self.state == 2) & kept[self.row]], return_counts=True)
        return self.of_locus({"kmer": kmer, "cnt": n})

    def novel(self) -> pa.Table:
        """Edges of kept reads between repeat k-mers, that the locus' repeat does not hold twice."""
        kept, low, high = self.kept()
        row, pos, edge = windows(self.raws, self.k + 1)
        edge, n = np.unique(edge[kept[row] & (pos >= low[row]) & (pos < high[row] - 1)], return_counts=True)
        at, own = kmers.valid_windows(self.seq, self.k + 1)
        own, many = np.unique(own[(at >= self.inner) & (at < len(self.seq) - self.inner - self.k)], return_counts=True)
        new = ~look_up(own[many >= 2], edge)[0]
        return self.of_locus({"edge": edge[new], "n": n[new]})

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Read, k-mer and how often it has it."""
        order = np.lexsort((self.kmer, self.row))
        row, kmer = self.row[order], self.kmer[order]
        start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (kmer[1:] != kmer[:-1])])) if len(row) else np.zeros(0, np.int64)
        return row[start], kmer[start], np.diff(start, append=len(row))

    def broken(self) -> pa.Table:
        """Reads that have a k-mer of the repeat oftener than the locus' genome has it."""
        row, kmer, n = self.counted()
        hit, at = look_up(self.known, kmer)
        bad = np.unique(row[hit & (self.most[at] > 0) & (n > self.most[at])]) if len(self.known) else np.zeros(0, np.int64)
        return self.table(bad, ["pair_id", "mate"], {})

    def annotated(self) -> pa.Table:
        """Run lengths of the states of all windows of each read, also of invalid ones."""
        signs = np.array(["*", ".", "="])
        all_ = [np.zeros(max(0, len(r) - self.k + 1), np.int64) for r in self.raws]
        first = np.cumsum([0, *(len(x) for x in all_)])
        flat = np.concatenate(all_)
        flat[first[self.row] + self.pos] = self.state
        texts = []
        for low, high in zip(first[:-1], first[1:]):
            part = flat[low:high]
            turn = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            texts.append("".join(f"{n}{s}" for n, s in zip(np.diff(turn, append=len(part)).tolist(), signs[part[turn]].tolist())) if len(part) else "*")
        return self.table(np.arange(len(texts)), ["pair_id", "mate"], {"annot": pa.array(texts, pa.string())})

    def profile(self) -> pa.Table:
        """Of each genome, rightness and k-mer: the least and the greatest count in a read that has it, such reads, and the sum and the sum of squares of the counts."""
        names, genome = np.unique(np.array([x or "" for x in self.reads.column("genome").to_pylist()], object), return_inverse=True)
        null = np.array([x is None for x in self.reads.column("genome").to_pylist()])
        of = (genome * 2 + self.reads.column("right").to_numpy()) * 2 + null
        row, kmer, n = self.counted()
        n = n * self.reads.column("times").to_numpy()[row]
        of = of[row]
        order = np.lexsort((kmer, of))
        of, kmer, n = of[order], kmer[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (kmer[1:] != kmer[:-1])])) if len(of) else np.zeros(0, np.int64)
        at = lambda f, x: f.reduceat(x, start) if len(start) else start
        which = of[start]
        found = {"genome": pa.array(names[which // 4], pa.string(), mask=which % 2 == 1), "right": pa.array(which // 2 % 2, pa.int32())}
        return self.of_locus(found | {"kmer": kmer[start], "mi": at(np.minimum, n), "ma": at(np.maximum, n), "n": np.diff(start, append=len(of)), "total": at(np.add, n), "squares": at(np.add, n * n)})
