"""SimHash near-duplicates: fingerprints, and a binary-trie self-join under a Hamming budget.

Fingerprints that differ in at most ``budget`` bits are linked. They are dealt
by what must then agree: of ``blocks`` equal blocks of bits at most ``budget``
can differ, so some choice of ``blocks - budget`` blocks is identical. All
fingerprints with the same choice and the same bits there form a group, and
inside each group a binary trie is joined with itself. Groups of more than
``split`` fingerprints are dealt again by more and smaller blocks, which leave
at most 16 free bits, so no task ever holds an unbounded group. Exact copies
share one fingerprint and count once.

Only a spanning forest of each group's links leaves a task, never all pairs;
components need no more.

Cases: null or empty text and text without words have the fingerprint zero,
linked like any other. A row with a null ``doc_id`` gets its fingerprint but
takes no part in links; its component is null. Repeated rows are repeated in
the result. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatlake.llm.arrow import clean_name, map_rows, plain_text, texts
from repeatlake.operators.components import connected_components
from repeatlake.plans.storage import materialize

CHUNK = 1 << 15  # shingles hashed at a time


def shingles(text: str, width: int):
    """Space-joined runs of ``width`` words, repeats included; of fewer words the whole sequence, of none nothing."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and white space is \x20 \x09-\x0D
    if not words:
        return iter(())
    if len(words) < width:
        return iter((b" ".join(words),))
    return map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(width))))


def fingerprint(text: str, width: int = 3) -> int:
    """A bit is 1 if it is 1 in over half of the shingles' XXH64 (seed 42)."""
    ones, total, some = np.zeros(64, np.int64), 0, shingles(text, width)
    digest = xxhash.xxh64_intdigest
    while True:
        h = np.fromiter((digest(s, 42) for s in itertools.islice(some, CHUNK)), np.uint64)
        if not len(h):
            break
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    bits = (ones * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, width: int = 3, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, fp)`` for every document; ``fp`` is the fingerprint as a signed long."""

    def make():
        def each(batch: pa.RecordBatch):
            fps = np.fromiter((fingerprint(t, width) for t in texts(batch)), np.uint64, len(batch))
            yield {"doc_id": batch.column(0), "fp": fps.view(np.int64)}

        return each

    return map_rows(plain_text(documents, id_column), "doc_id long, fp long", make)


def block_keys(fp: Column, blocks: int, budget: int) -> Column:
    """One key for each choice of ``blocks - budget`` blocks: the number of the choice, then their bits."""
    size = 64 // blocks
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(blocks), blocks - budget)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(fp, i * size).bitwiseAND(F.lit((1 << size) - 1).cast("long")))
        keys.append(key)
    return F.explode(F.array(*keys))


def first_choice(xor: np.ndarray, blocks: int, budget: int) -> np.ndarray:
    """The first choice of blocks that are all zero in ``xor``: the one group where a pair is reported."""
    size = 64 // blocks
    equal = [((xor >> np.uint64(i * size)) & np.uint64((1 << size) - 1)) == 0 for i in range(blocks)]
    out = np.full(len(xor), -1, np.int64)
    for number, chosen in enumerate(itertools.combinations(range(blocks), blocks - budget)):
        hit = out < 0
        for i in chosen:
            hit &= equal[i]
        out[hit] = number
    return out


def trie_join(fps: np.ndarray, a: tuple, b: tuple, budget: int, frontier: int = 1 << 17):
    """Index pairs within ``budget`` bits between the ranges ``a = (starts, ends)`` and ``b`` of ``fps[row, word]``.

    Rows are sorted within each range, and a range is the root of a binary trie
    over the bits from the highest of the first word on; a node is a subrange.
    Node pairs descend together: children on the same side cost nothing, on
    different sides one differing bit, and a pair beyond the budget is pruned.
    A range paired with itself gives each pair once. Frontiers are worked off in
    pieces of bounded size, deepest first. Yields two arrays of indices.
    """
    depths, ranks = 64 * fps.shape[1], {}

    def ones(depth: int) -> np.ndarray:
        if depth not in ranks:
            bit = (fps[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
            ranks[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        return ranks[depth]

    (a0, a1), (b0, b1) = ([np.asarray(x, np.int64) for x in side] for side in (a, b))
    stack = [(0, a0, a1, b0, b1, np.zeros(len(a0), np.int32))]
    while stack:
        depth, a0, a1, b0, b1, bits = stack.pop()
        if len(a0) > frontier:
            half = len(a0) // 2
            stack += [(depth, *(x[:half] for x in (a0, a1, b0, b1, bits))), (depth, *(x[half:] for x in (a0, a1, b0, b1, bits)))]
            continue
        live = (a1 > a0) & (b1 > b0) & (bits <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, bits = (x[live] for x in (a0, a1, b0, b1, bits))
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int32) <= budget
            yield np.minimum(i, j)[near], np.maximum(i, j)[near]
            a0, a1, b0, b1, bits = (x[~leaf] for x in (a0, a1, b0, b1, bits))
        if not len(a0) or depth == depths:
            continue
        c = ones(depth)
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = a0 == b0
        parts = [(a0, am, b0, bm, bits), (am, a1, bm, b1, bits), (a0, am, bm, b1, bits + 1), (am, a1, b0, bm, np.where(same, budget + 1, bits + 1))]
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))


def forest(n: int, pairs) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over ``pairs`` (arrays of both ends)."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            ri, rj = root[i], root[j]
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            if not len(i):
                break
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:  # pointer jumping
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _star(rep: np.ndarray, pairs) -> pa.RecordBatch:
    """Edges from every linked row to the first row of its cluster."""
    root = forest(len(rep), pairs)
    away = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(rep[away]), pa.array(rep[root[away]])], names=["a", "b"])


def by_group(rows: DataFrame, words: list[str], edges, *more: str) -> DataFrame:
    """``(a, b)`` that ``edges(key, fps, rep, *more)`` makes of whole groups of ``rows(key, words..., rep, more...)``.

    A partition is sorted by key and streamed; a batch's last group waits for
    the next batch, so memory holds a batch and a group.
    """
    names = ["key", *words, "rep", *more]

    def run(batches):
        def whole(part):
            key, *fps = part[: 1 + len(words)]
            order = np.lexsort((*[f.view(np.uint64) for f in reversed(fps)], *part[2 + len(words) :], key))
            part = [x[order] for x in part]
            fps = np.stack([f.view(np.uint64) for f in part[1 : 1 + len(words)]], axis=1)
            return edges(part[0], fps, *part[1 + len(words) :])

        held = None
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if last:
                yield whole([x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield whole(held)

    return rows.select(*names).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _ranges(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return cuts, np.concatenate([cuts[1:], [len(key)]])


def group_edges(keyed: DataFrame, blocks: int, budget: int) -> DataFrame:
    """``(a, b)`` representatives linked inside the groups of ``keyed(key, fp, rep)``; a pair counts in its first group only."""
    choices = len(list(itertools.combinations(range(blocks), blocks - budget)))
    bits = 64 // blocks * (blocks - budget)

    def edges(key, fps, rep):
        ends = _ranges(key)
        number = (key.view(np.uint64) >> np.uint64(bits)).astype(np.int64) % choices

        def own():
            for i, j in trie_join(fps, ends, ends, budget):
                mine = first_choice(fps[i, 0] ^ fps[j, 0], blocks, budget) == number[i]
                yield i[mine], j[mine]

        return _star(rep, own())

    return by_group(keyed, ["fp"], edges)


def link_fingerprints(reps: DataFrame, budget: int = 2, split: int = 1024) -> DataFrame:
    """``(a, b)`` edges that connect whatever representatives of ``reps(fp, rep)`` have links; ``fp`` distinct."""
    blocks, finer = budget + 2, max(budget + 6, 8)
    while 64 % blocks:
        blocks += 1
    while 64 % finer:
        finer += 1
    keyed = reps.select(block_keys(F.col("fp"), blocks, budget).alias("key"), "fp", "rep")
    hot = materialize(keyed.groupBy("key").count().where(F.col("count") > split).select("key"), "simhash-hot")
    if hot.isEmpty():
        return group_edges(keyed, blocks, budget)
    cold = keyed.join(hot, "key", "left_anti")
    again = keyed.join(hot, "key", "left_semi").select("fp", "rep").distinct()
    again = again.select(block_keys(F.col("fp"), finer, budget).alias("key"), "fp", "rep")
    return group_edges(cold, blocks, budget).unionByName(group_edges(again, finer, budget))


def simhash_components(documents: DataFrame, width: int = 3, budget: int = 2, split: int = 1024, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest ``doc_id`` reachable over links of at most ``budget`` bits."""
    fps = materialize(fingerprints(documents, width, id_column), "simhash-fps")
    reps = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    found = connected_components(link_fingerprints(reps, budget, split))
    classes = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    classes = materialize(classes, "simhash-classes").withColumnRenamed("fp", "class_fp")
    joined = fps.join(classes, fps["fp"] == classes["class_fp"], "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# Wide fingerprints: candidates for near-duplicates, which the sets of shingles then decide.

WORDS = ["f0", "f1", "f2", "f3"]  # 256 bits
BANDS, ROWS = 20, 4  # a key for each band of so many minima
ERRORS = 6  # standard errors between the expected bits of a pair at the threshold and the budget of candidates


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """The sorted XXH64 (seed 42) of the different shingles."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in shingles(text, width)), np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(h: np.ndarray, words: int = len(WORDS)) -> np.ndarray:
    """SimHash of a set of shingles with ``64 * words`` bits; the further words are mixed from the first hash."""
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, len(h), CHUNK):
        part = h[at : at + CHUNK]
        for k in range(words):
            x = _mixed(part + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
            ones[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((ones * 2 > len(h)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0]


FACTORS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key of each band of minima: two sets share it with the ROWS-th power of their Jaccard similarity."""
    if not len(h):
        return np.zeros(0, np.uint64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, (h[at : at + 1024, None] * FACTORS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def wide_fingerprints(documents: DataFrame, width: int = 5, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, f0, f1, f2, f3, n, keys)`` of every document; ``n`` is the number of different shingles."""

    def make():
        def each(batch: pa.RecordBatch):
            sets = [shingle_set(t, width) for t in texts(batch)]
            got = np.array([wide_fingerprint(h) for h in sets], np.uint64).reshape(-1, len(WORDS)).view(np.int64)
            keys = [band_keys(h).view(np.int64) for h in sets]
            yield {"doc_id": batch.column(0)} | {w: np.ascontiguousarray(got[:, k]) for k, w in enumerate(WORDS)} | {"n": [len(h) for h in sets], "keys": keys}

        return each

    return map_rows(plain_text(documents, id_column), "doc_id long, f0 long, f1 long, f2 long, f3 long, n long, keys array<long>", make)


def bit_budget(similarity: float, bits: int = 64 * len(WORDS), errors: float = 0) -> int:
    """Differing bits of two equally large sets whose Jaccard similarity is ``similarity``: the angle of their vectors.

    Sets of unequal size differ in fewer. ``errors`` standard errors are added.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.floor(bits * p + errors * np.sqrt(bits * p * (1 - p)) + 1e-9)) + 1


def _tiled(rows: DataFrame, key: str, settled: Column, low: str, high: str) -> DataFrame:
    """``rows`` once for each pair of tiles they are compared in, ``(t, u, side)``.

    ``low`` and ``high`` are the tiles of a key's settled rows, which are known
    to be connected, and of the others. Pairs of settled tiles are left out.
    """
    own = F.when(settled, F.pmod(F.xxhash64("rep"), low)).otherwise(F.col(low) + F.pmod(F.xxhash64("rep"), high))
    first = F.when(settled, F.col(low)).otherwise(F.lit(0).cast("long"))
    out = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(first, F.col(low) + F.col(high) - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).cast("long")
    return out.withColumn("t", F.least("own", "other")).withColumn("u", F.greatest("own", "other")).withColumn("side", side)


def link_wide(reps: DataFrame, budget: int, split: int = 1024, tile: int = 1024) -> DataFrame:
    """``(a, b)`` edges that connect whatever ``reps(f0..f3, rep, keys)`` share a key and differ in at most ``budget`` bits.

    In groups over ``split`` every row is first held against the row with the
    smallest id, in the JVM. Rows within its budget are connected and need not be
    compared with each other any more; the rest is compared with all rows of the
    group, tile by tile. So a large group of near copies costs little more than
    its size, work is in pieces of bounded size, and which rows are connected
    does not depend on ``split``.
    """
    keyed = reps.select(F.explode("keys").alias("key"), *WORDS, "rep")
    large = keyed.select("key").groupBy("key").count().where(F.col("count") > split)
    hot = materialize(large.select(F.col("key").alias("hot")), "simhash-hot")

    def inside(key, fps, rep):
        ends = _ranges(key)
        return _star(rep, trie_join(fps, ends, ends, budget))

    if hot.isEmpty():
        return by_group(keyed, WORDS, inside)
    cold = by_group(keyed.join(hot, keyed["key"] == hot["hot"], "left_anti"), WORDS, inside)
    pool = keyed.join(hot, keyed["key"] == hot["hot"], "left_semi")
    first = materialize(pool.groupBy("key").agg(F.min(F.struct("rep", *WORDS)).alias("p")).withColumnRenamed("key", "hot"), "simhash-first")
    bits = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"p.{w}"))) for w in WORDS), F.lit(0))
    marked = pool.join(first, F.col("key") == F.col("hot")).select("key", *WORDS, "rep", F.col("p.rep").alias("pivot"), (bits <= budget).alias("near"))
    marked = materialize(marked, "simhash-marked")
    star = marked.where("near and rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    tiles = lambda which: F.greatest(F.lit(1), F.ceil(F.count_if(which) / tile)).cast("long")
    open_keys = marked.groupBy(F.col("key").alias("hot")).agg(tiles(F.col("near")).alias("low"), tiles(~F.col("near")).alias("high"), F.count_if(~F.col("near")).alias("rest"))
    open_keys = materialize(open_keys.where("rest > 0").drop("rest"), "simhash-open")
    tiled = _tiled(marked.join(open_keys, F.col("key") == F.col("hot")), "key", F.col("near"), "low", "high")
    tiled = tiled.select(F.xxhash64("key", "t", "u").alias("key"), *WORDS, "rep", "side")

    def across(key, fps, rep, side):
        (start, end), pairs = _ranges(key), []
        for s, e in zip(start, end):
            middle = s + int(np.searchsorted(side[s:e], 1))
            pairs.append((s, e, s, e) if side[s] == 2 else (s, middle, middle, e))
        a0, a1, b0, b1 = np.array(pairs, np.int64).T
        return _star(rep, trie_join(fps, (a0, a1), (b0, b1), budget))

    return cold.unionByName(star).unionByName(by_group(tiled, WORDS, across, "side"))


def connecting(sets: list[np.ndarray], cluster: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float):
    """``(i, j)`` links that connect whatever of ``left`` and ``right`` rows have a Jaccard similarity of at least ``similarity``.

    A pair that is connected already (by ``cluster`` or links found before) is not compared.
    """
    many = np.array([len(h) for h in sets], np.int64)
    starts = np.cumsum(many) - many
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(words), np.int64)
    root = np.unique(cluster, return_inverse=True)[1]
    for i in left:
        j = right[(root[right] != root[i])]
        if not len(j):
            continue
        mine = ids[starts[i] : starts[i] + many[i]]
        held[mine] = 1
        if 4 * len(j) > len(sets):
            both = np.add.reduceat(held[ids], starts)[j]
        else:
            both = np.array([held[ids[starts[k] : starts[k] + many[k]]].sum() for k in j])
        held[mine] = 0
        near = j[both / (many[i] + many[j] - both) >= similarity]
        for k in near:
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                yield i, k


def exact_links(documents: DataFrame, groups: DataFrame, width: int, similarity: float, id_column: str = "doc_id", tile: int = 1024) -> DataFrame:
    """``(a, b)`` edges that connect whatever documents of one of ``groups(node, component)`` have a Jaccard similarity of at least ``similarity``.

    The sets of shingles are compared themselves. In groups over ``tile`` each
    set is first compared with that of the smallest id, which is sent to every
    tile; the sets that are not similar to it are then compared with all others,
    tile by tile. Pairs that are connected by then are not compared.
    """
    sizes = groups.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("size"))
    members = materialize(groups.join(sizes, groups["component"] == sizes["c"]).select("node", "component", "size"), "simhash-members")

    def packed_sets(some: DataFrame, *more: str) -> DataFrame:
        rows = plain_text(documents, id_column)
        rows = rows.join(some, rows["doc_id"] == some["node"]).select("component", F.col("node").alias("rep"), *more, "text")

        def make():
            def each(batch: pa.RecordBatch):
                packed = [shingle_set(t, width).tobytes() for t in texts(batch)]
                yield {c: batch.column(k) for k, c in enumerate(("component", "rep", *more))} | {"packed": packed}

            return each

        kinds = "".join(f", {c} {some.schema[c].dataType.simpleString()}" for c in more)
        return map_rows(rows, f"component long, rep long{kinds}, packed binary", make).where("length(packed) > 0")

    def edges(rep: np.ndarray, pairs) -> pa.Table:
        found = np.array(list(pairs), np.int64).reshape(-1, 2)
        return pa.table({"a": rep[found[:, 0]], "b": rep[found[:, 1]]})

    def within(group: pa.Table) -> pa.Table:
        rep = group["rep"].to_numpy()
        some = np.argsort(rep, kind="stable")
        return edges(rep, connecting([np.frombuffer(p, np.uint64) for p in group["packed"].to_pylist()], np.arange(len(rep)), some, some, similarity))

    small = packed_sets(members.where(F.col("size") <= tile).select("node", "component")).groupBy("component").applyInArrow(within, "a long, b long")
    large = members.where(F.col("size") > tile)
    if large.isEmpty():
        return small

    def against_first(batches):
        key, pivot, first = None, None, None
        for batch in batches:
            component, at, rep = (batch.column(k).to_numpy() for k in range(3))
            keep = []
            for k in range(len(batch)):
                own = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
                if (component[k], at[k]) != key:
                    key, pivot, first = (component[k], at[k]), own, rep[k]
                both = np.intersect1d(pivot, own, assume_unique=True).size if rep[k] != first else len(own)
                if rep[k] != component[k]:
                    keep.append((component[k], rep[k], bool(both / (len(pivot) + len(own) - both) >= similarity and first == component[k])))
            columns = list(zip(*keep)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))], names=["component", "node", "near"])

    tiles = F.ceil(F.col("size") / tile).cast("long")
    all_tiles, one = F.sequence(F.lit(0).cast("long"), tiles - 1), F.array(F.pmod(F.xxhash64("node"), tiles))
    spread = large.withColumn("at", F.explode(F.when(F.col("node") == F.col("component"), all_tiles).otherwise(one)))
    dealt = packed_sets(spread, "at").select("component", "at", "rep", "packed").repartition("component", "at").sortWithinPartitions("component", "at", "rep")
    first = materialize(dealt.mapInArrow(against_first, "component long, node long, near boolean"), "simhash-first")
    star = first.where("near").select(F.col("node").alias("a"), F.col("component").alias("b"))
    count = lambda which: F.greatest(F.lit(1), F.ceil(F.count_if(which) / tile)).cast("long")
    rest = first.groupBy(F.col("component").alias("c")).agg(count(F.col("near")).alias("low"), count(~F.col("near")).alias("high"), F.count_if(~F.col("near")).alias("left"))
    rest = materialize(rest.where("left > 0").drop("left"), "simhash-open")
    if rest.isEmpty():
        return small.unionByName(star)
    again = first.join(rest, F.col("component") == F.col("c")).select("component", "node", "near", "low", "high")
    tiled = _tiled(packed_sets(again, "near", "low", "high"), "component", F.col("near"), "low", "high")

    def across(group: pa.Table) -> pa.Table:
        rep, side, near = group["rep"].to_numpy(), group["side"].to_numpy(), group["near"].to_numpy(zero_copy_only=False)
        cluster = np.where(near, group["component"].to_numpy(), rep)
        sets = [np.frombuffer(p, np.uint64) for p in group["packed"].to_pylist()]
        left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
        return edges(rep, connecting(sets, cluster, left, right, similarity))

    compared = tiled.select("component", "t", "u", "side", "rep", "near", "packed").groupBy("component", "t", "u").applyInArrow(across, "a long, b long")
    return small.unionByName(star).unionByName(compared)


def near_groups(documents: DataFrame, width: int = 5, similarity: float = 0.8, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, component_id)`` of all rows with an id: near-duplicates by the similarity of their sets of shingles.

    Documents that share a key and whose 256-bit fingerprints differ in no more
    than a generous budget are candidates; inside components of candidates the
    Jaccard similarity of the sets decides. Sets with so few shingles that one
    more is too many link with equal ones only, which have the same fingerprint.
    """
    fps = materialize(wide_fingerprints(documents, width, id_column).where("doc_id is not null"), "simhash-wide")
    first = F.min(F.struct("doc_id", "n", "keys"))
    reps = fps.groupBy(*WORDS).agg(first.alias("first")).select(*WORDS, F.col("first.doc_id").alias("rep"), "first.n", "first.keys")
    reps = materialize(reps, "simhash-reps")
    fewest = int(np.ceil(similarity / (1 - similarity) - 1e-9)) if similarity < 1 else 1
    loose = connected_components(link_wide(reps.where(F.col("n") >= fewest), bit_budget(similarity, errors=ERRORS)))
    found = connected_components(exact_links(documents, loose, width, similarity, id_column))
    classes = reps.join(found, reps["rep"] == found["node"], "left").select(*WORDS, F.coalesce("component", "rep").alias("component_id"))
    return fps.select("doc_id", *WORDS).join(materialize(classes, "simhash-classes"), WORDS).select("doc_id", "component_id")


def without_near_copies(documents: DataFrame, width: int = 5, similarity: float = 0.8, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` of which the smallest id of each group stays, with all their columns.

    Rows with equal ids are one document, of which the row whose text sorts
    first stays. Rows without an id stay.
    """
    groups = near_groups(documents, width, similarity, id_column)
    kept = materialize(groups.where("doc_id = component_id").select("doc_id").distinct(), "simhash-kept")
    kept = kept.withColumnRenamed("doc_id", "__kept")
    rows = documents.join(kept, documents[id_column].cast("long") == kept["__kept"], "left_semi")
    first = Window.partitionBy(id_column).orderBy("text")
    rank = clean_name(documents, "rank")
    one = rows.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    return one.unionByName(documents.where(F.col(id_column).isNull()))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op2``: every document's fingerprint over three-word shingles and its component at two bits."""
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
