"""Read pairs against a k-mer index: simulation, filters, locus assignment, segmentation, genotypes.

Pairs are ``(pair, title, seq1, seq2)``; hits come from one equi join of the
pairs' k-mers with the index, and everything after it is grouped by pair, so a
pair's rows are shuffled once. Ties go to the smaller locus, and counts are full.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatlake.functions import sequence as S
from repeatlake.operators import kmers as K


def simulate(seqs: DataFrame, fragment: int = 500, read: int = 150, shift: int = 300) -> DataFrame:
    """Error-free pairs tiled over each sequence: every ``shift`` bases a fragment, read inwards from both ends."""
    last = F.length("seq") - fragment
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(shift))).otherwise(F.array().cast("array<int>"))
    rows = seqs.select("locus", F.explode(starts).alias("beg"), "seq")
    second = S.revcomp(F.substring("seq", F.col("beg") + fragment - read + 1, F.lit(read)))
    title = F.concat_ws(":", F.col("locus").cast("string"), F.concat_ws("-", "beg", F.col("beg") + fragment))
    return rows.select("locus", "beg", title.alias("title"), F.substring("seq", F.col("beg") + 1, F.lit(read)).alias("seq1"), second.alias("seq2"))


def mates(pairs: DataFrame) -> DataFrame:
    """``(title, mate, seq)`` of ``pairs(title, seq1, seq2)``."""
    both = F.array(*(F.struct(F.lit(i).cast("long").alias("mate"), F.col(f"seq{i}").alias("seq")) for i in (1, 2)))
    return pairs.select("title", F.explode(both).alias("m")).select("title", "m.mate", "m.seq")


def pair_kmers(pairs: DataFrame, k: int) -> DataFrame:
    """``(title, mate, pos, kmer)`` canonical, of both mates; invalid windows are left out."""
    return K.extract(mates(pairs), ["title", "mate"], k, canonical=True).withColumn("pos", F.col("pos").cast("long"))


def multiplicity(kmers: DataFrame) -> DataFrame:
    """``(title, kmer, n1, n2)``: how often each k-mer is in either mate."""
    count = lambda i: F.count_if(F.col("mate") == i).alias(f"n{i}")
    return kmers.groupBy("title", "kmer").agg(count(1), count(2))


def passing_mates(kmers: DataFrame, index_kmers: DataFrame, least: int) -> DataFrame:
    """``(title, mate, hits)`` of mates with at least ``least`` k-mers in the index; ``kmers`` may be counted by ``cnt``."""
    found = kmers.join(index_kmers.select("kmer").distinct(), "kmer", "left_semi")
    return found.groupBy("title", "mate").agg(F.sum("cnt").alias("hits") if "cnt" in kmers.columns else F.count("*").alias("hits")).where(F.col("hits") >= least)


def probe_positions(k_count: Column, probes: int = 4) -> Column:
    """Positions of evenly spaced probes, the first and last included."""
    step = F.floor(k_count / (probes - 1))
    return F.array(*(F.lit(i) * step for i in range(probes - 1)), k_count - 1)


def sampled_prefilter(kmers: DataFrame, index_kmers: DataFrame, probes: int = 4, least: int = 1) -> DataFrame:
    """Titles of pairs both mates of which hit the index with at least ``least`` of ``probes`` evenly spaced k-mers."""
    return prefiltered(probed(kmers, probes), index_kmers, least)


def probed(kmers: DataFrame, probes: int = 4) -> DataFrame:
    """The rows of ``kmers(title, mate, pos, kmer)`` that are a mate's evenly spaced probes."""
    sizes = Window.partitionBy("title", "mate")
    ranked = kmers.withColumn("i", F.row_number().over(sizes.orderBy("pos")) - 1).withColumn("n", F.count("*").over(sizes))
    return ranked.where(F.array_contains(probe_positions(F.col("n"), probes).cast("array<bigint>"), F.col("i").cast("long")))


def prefiltered(asked: DataFrame, index_kmers: DataFrame, least: int = 1) -> DataFrame:
    """Titles of pairs both mates of which have at least ``least`` of the k-mers ``asked(title, mate, kmer)`` in the index."""
    hits = asked.join(index_kmers.select("kmer").distinct(), "kmer", "left_semi").groupBy("title", "mate").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= least).groupBy("title").agg(F.count("*").alias("mates")).where("mates = 2").select("title")


def pair_codes(pairs: DataFrame, k: int, probes: int = 4) -> DataFrame:
    """``(pair_id, mate, pos, kmer, probe)`` of both mates: canonical k-mers as numbers, with the windows a pair is sampled by."""
    mates = F.array(*(F.struct(F.lit(i).cast("long").alias("mate"), F.col(f"seq{i}").alias("seq")) for i in (1, 2)))
    rows = pairs.select("pair_id", F.explode(mates).alias("m")).select("pair_id", "m.mate", "m.seq")
    return K.codes(rows, ["pair_id", "mate"], k, probes=probes).withColumn("pos", F.col("pos").cast("long"))


def locus_classes(index: DataFrame) -> DataFrame:
    """``(kmer, c1, c2)``: k-mers with the same loci have the same class; no list is gathered.

    The class of a single locus, a number, is that locus and 0; of more it is 128 bits of the hashes of the loci, the last 64 not 0.
    ``index`` is distinct; its rows are shuffled as they are, for hardly any k-mer occurs twice in one task.
    """
    rows = index.select("kmer", "locus").repartition("kmer").groupBy("kmer").agg(F.count("locus").alias("n"), F.count("*").alias("all"), F.max("locus").alias("one"), F.bit_xor(F.xxhash64("locus")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("wide"), "locus")).alias("h2"))
    single = (F.col("n") == 1) & (F.col("all") == 1)
    h2 = F.when(F.col("h2") == 0, 1).otherwise(F.col("h2"))
    return rows.select("kmer", F.when(single, F.col("one").cast("long")).otherwise(F.col("h1")).alias("c1"), F.when(single, F.lit(0).cast("long")).otherwise(h2).alias("c2"))


def class_loci(classes: DataFrame, index: DataFrame) -> DataFrame:
    """``(c1, c2, locus)``: the loci of each class, those of its smallest k-mer where there are more than one."""
    single = classes.where("c2 = 0").select("c1", "c2").distinct().select("c1", "c2", F.col("c1").cast(index.schema["locus"].dataType).alias("locus"))
    first = classes.where("c2 <> 0").groupBy("c1", "c2").agg(F.min("kmer").alias("kmer"))
    return single.unionByName(first.join(index.select("kmer", "locus"), "kmer").select("c1", "c2", "locus"))


def first_of_alike(loci: DataFrame) -> DataFrame:
    """``loci(c1, c2, locus)`` with only the smallest of the loci that are in the same classes.

    Such loci have the same hits of every pair, and ties go to the smallest, so an
    assignment needs no other: copies of a locus do not multiply its pairs.
    """
    signs = loci.groupBy("locus").agg(F.bit_xor(F.xxhash64("c1", "c2")).alias("s1"), F.bit_xor(F.xxhash64(F.lit("wide"), "c1", "c2")).alias("s2"))
    first = signs.groupBy("s1", "s2").agg(F.min("locus").alias("locus")).select("locus")
    return loci.join(first, "locus", "left_semi")


def class_hits(kmers: DataFrame, classes: DataFrame) -> DataFrame:
    """``(pair_id, c1, c2, n1, n2, p1, p2)``: k-mers of either mate that each class has, and how many of them are probes.

    A k-mer meets one class, however many loci it has, and everything of a pair
    is in one partition after one shuffle.
    """
    hit = kmers.select("pair_id", "mate", "probe", "kmer").join(classes, "kmer").drop("kmer").repartition("pair_id")
    of = lambda i, more=F.lit(True): F.count_if((F.col("mate") == i) & more)
    return hit.groupBy("pair_id", "c1", "c2").agg(of(1).alias("n1"), of(2).alias("n2"), of(1, F.col("probe")).alias("p1"), of(2, F.col("probe")).alias("p2"))


def filtered_hits(counts: DataFrame, least: int, sampled: int = 1) -> DataFrame:
    """``(pair_id, c1, c2, n1, n2)`` of :func:`class_hits` after both filters.

    A pair stays if of either mate at least ``sampled`` of the probes are in the
    index; of it a mate stays if at least ``least`` of all its k-mers are.
    """
    pair = Window.partitionBy("pair_id")
    for c in ("n1", "n2", "p1", "p2"):
        counts = counts.withColumn(f"all_{c}", F.sum(c).over(pair))
    kept = counts.where((F.col("all_p1") >= sampled) & (F.col("all_p2") >= sampled))
    for i in (1, 2):
        kept = kept.withColumn(f"n{i}", F.when(F.col(f"all_n{i}") >= least, F.col(f"n{i}")).otherwise(0))
    return kept.where("n1 + n2 > 0").select("pair_id", "c1", "c2", "n1", "n2")


def expanded(counts: DataFrame, loci: DataFrame) -> DataFrame:
    """``(pair_id, locus, m1, m2)``: the hits of classes given to each of their loci."""
    return counts.join(loci, ["c1", "c2"]).groupBy("pair_id", "locus").agg(F.sum("n1").alias("m1"), F.sum("n2").alias("m2"))


def kept_mates(counts: DataFrame) -> DataFrame:
    """``(pair_id, mate)`` of mates that passed both filters."""
    both = counts.groupBy("pair_id").agg((F.sum("n1") > 0).alias("k1"), (F.sum("n2") > 0).alias("k2"))
    mates = F.filter(F.array(*(F.when(F.col(f"k{i}"), F.lit(i).cast("long")) for i in (1, 2))), lambda x: x.isNotNull())
    return both.select("pair_id", F.explode(mates).alias("mate"))


def locus_hits(counts: DataFrame, index: DataFrame) -> DataFrame:
    """``(title, locus, m1, m2)``: hits of either mate in each locus; ``index`` is ``(kmer, locus)``, distinct."""
    return counts.join(index, "kmer").groupBy("title", "locus").agg(F.sum("n1").alias("m1"), F.sum("n2").alias("m2"))


def best_loci(hits: DataFrame, top: int, by: str = "title") -> DataFrame:
    """The ``top`` loci of each pair by hits, the smaller locus first among equals; with their rank from 1."""
    order = Window.partitionBy(by).orderBy((F.col("m1") + F.col("m2")).desc(), "locus")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def assign(hits: DataFrame, least: int, by: str = "title", qc: DataFrame | None = None) -> DataFrame:
    """``(title, locus, m1, m2)`` of pairs whose best locus has enough hits from both mates, or twice as many in all, and is in ``qc(locus, ok)`` if given."""
    best = hits.groupBy(by).agg(F.max_by(F.struct("locus", "m1", "m2"), F.struct(F.col("m1") + F.col("m2"), -F.col("locus"))).alias("b")).select(by, "b.*")
    if qc is not None:
        best = best.join(qc.where("ok").select("locus").distinct(), "locus", "left_semi").select(by, "locus", "m1", "m2")
    return best.where((F.col("m1") >= least) & (F.col("m2") >= least) | (F.col("m1") + F.col("m2") >= 2 * least))


def states(assigned_kmers: DataFrame, sets: DataFrame) -> DataFrame:
    """``state`` of each position of assigned pairs: 1 flank (it wins), 2 repeat, 0 neither. ``sets`` is ``(locus, kmer, kind)``."""
    kinds = sets.groupBy("locus", "kmer").agg(F.max(F.when(F.col("kind") == "fl", 1).otherwise(0)).alias("fl"))
    joined = assigned_kmers.join(kinds, ["locus", "kmer"], "left")
    return joined.withColumn("state", F.when(F.col("fl") == 1, 1).when(F.col("fl") == 0, 2).otherwise(0).cast("long")).drop("fl")


def segment(state_rows: DataFrame, least_spanning: int = 40, by: str = "title", observed: bool = False) -> DataFrame:
    """One row for each mate: number of changes ``nt``, first known state ``bs``, bounds ``[si, ei)`` and whether it is kept.

    With ``observed``, also ``[seen_si, seen_ei)``: from the first to after the last repeat k-mer, without the unknown tracts at boundaries.

    Changes are counted between known states. Kept are reads within the repeat,
    reads that cross one boundary, and reads that span it with at least
    ``least_spanning`` repeat positions. A boundary lies where the new state
    begins, or halfway into the unknown tract before it.
    """
    mate = Window.partitionBy(by, "mate")
    so_far = mate.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("state") > 0, F.col("state"))
    rows = state_rows.withColumn("known", known)
    rows = rows.withColumn("before", F.last("known", True).over(so_far)).withColumn("seen", F.last(F.when(F.col("known").isNotNull(), F.col("pos")), True).over(so_far))
    turn = F.col("known").isNotNull() & F.col("before").isNotNull() & (F.col("known") != F.col("before"))
    edge = F.when(turn, F.when(F.col("pos") - F.col("seen") > 1, F.floor((F.col("seen") + 1 + F.col("pos")) / 2)).otherwise(F.col("pos")))
    marked = rows.withColumn("turn", turn).withColumn("edge", edge.cast("long"))
    out = marked.groupBy(by, "mate").agg(
        F.first("locus").alias("locus"),
        F.count_if("turn").alias("nt"), F.min_by("known", F.when(F.col("known").isNotNull(), F.col("pos"))).alias("bs"), F.count_if(F.col("state") == 2).alias("n_tr"),
        F.min("edge").alias("first"), F.max("edge").alias("second"), (F.max("pos") + 1).alias("nk"),
        F.min(F.when(F.col("turn"), F.col("pos"))).alias("into"), F.min(F.when(F.col("turn"), F.col("seen") + 1)).alias("left"), F.max(F.when(F.col("turn"), F.col("seen") + 1)).alias("left_last"),
    )
    return bounds(out, least_spanning, by, observed)


def bounds(out: DataFrame, least_spanning: int = 40, by: str = "title", observed: bool = False) -> DataFrame:
    """The rows of :func:`segment` of what was counted of each mate."""
    nt, bs = F.col("nt"), F.col("bs")
    kept = (nt == 0) & (bs == 2) | (nt == 1) | (nt == 2) & (bs == 1) & (F.col("n_tr") >= least_spanning)
    kept = F.coalesce(kept, F.lit(False))
    si = F.when(bs == 2, F.lit(0)).otherwise(F.col("first"))
    ei = F.when(nt == 0, F.col("nk")).when((nt == 1) & (bs == 2), F.col("first")).when(nt == 1, F.col("nk")).otherwise(F.col("second"))
    seen_si = F.when(bs == 2, F.lit(0)).otherwise(F.col("into"))
    seen_ei = F.when(nt == 0, F.col("nk")).when((nt == 1) & (bs == 2), F.col("left")).when(nt == 1, F.col("nk")).otherwise(F.col("left_last"))
    ends = [("si", si), ("ei", ei), *([("seen_si", seen_si), ("seen_ei", seen_ei)] if observed else [])]
    return out.select(by, "locus", "mate", "nt", "bs", "n_tr", kept.alias("kept"), *(F.when(kept, x.cast("long")).alias(n) for n, x in ends))


def novel_edges(edges: DataFrame, segments: DataFrame, known: DataFrame, by: str = "title") -> DataFrame:
    """``(locus, edge, n)``: how often kept mates hold an edge between two of their repeat k-mers that their locus does not know.

    ``edges`` is ``(by, mate, pos, edge)``, valid windows of one base more than a
    k-mer, numbered by their start in the read, so that there is none over an
    unknown base; ``segments`` come with observed bounds, of which the last k-mer
    has no edge behind it; ``known`` is ``(locus, edge)``. Edges are counted before they are compared with what is known.
    """
    inside = segments.where("kept and seen_ei - 1 > seen_si").select(by, "mate", "locus", "seen_si", "seen_ei")
    found = edges.join(inside, [by, "mate"]).where("pos >= seen_si and pos < seen_ei - 1").groupBy("locus", "edge").agg(F.count("*").alias("n"))
    return found.join(known.select("locus", "edge").distinct(), ["locus", "edge"], "left_anti")


def genotype(state_rows: DataFrame, segments: DataFrame, by: str = "title") -> DataFrame:
    """``(locus, kmer, cnt)``: repeat positions of kept mates."""
    return state_rows.where("state = 2").join(segments.where("kept").select(by, "mate"), [by, "mate"], "left_semi").groupBy("locus", "kmer").agg(F.count("*").alias("cnt"))


def summary(segments: DataFrame) -> DataFrame:
    """``(locus, nmapread, kmc)``: mates kept, and windows within their bounds."""
    return segments.where("kept").groupBy("locus").agg(F.count("*").alias("nmapread"), F.sum(F.col("ei") - F.col("si")).alias("kmc"))


def pair_stages(pairs: DataFrame, counts: DataFrame, least: int, sampled: int = 1) -> DataFrame:
    """``(pair_id, sub, kf1, kf2)`` of every pair of ``pairs``, by its :func:`class_hits`: whether the sampled filter removes it, and which mates of the others the hit filter removes."""
    sums = counts.groupBy("pair_id").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "p1", "p2")))
    rows = pairs.select("pair_id").join(sums, "pair_id", "left").na.fill(0, ["n1", "n2", "p1", "p2"])
    sub = (F.col("p1") < sampled) | (F.col("p2") < sampled)
    return rows.select("pair_id", sub.alias("sub"), *((~sub & (F.col(f"n{i}") < least)).alias(f"kf{i}") for i in (1, 2)))


#: How states are written, unknown, flank and repeat.
STATES = ("*", ".", "=")


def annotation(states: DataFrame, windows: DataFrame) -> DataFrame:
    """``(pair_id, mate, annot)``: run lengths of the states ``(pair_id, mate, pos, state)`` of all ``windows(pair_id, mate, nk)``; one without a k-mer is unknown."""
    seen = states.groupBy("pair_id", "mate").agg(F.map_from_entries(F.collect_list(F.struct("pos", "state"))).alias("at"))
    letters = F.array(*(F.lit(x) for x in STATES))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nk") - 1), lambda i: F.get(letters, F.coalesce(F.element_at("at", i), F.lit(0)).cast("int")))
    rows = windows.join(seen, ["pair_id", "mate"], "left").withColumn("at", F.coalesce("at", F.create_map().cast("map<bigint,bigint>")))
    return rows.select("pair_id", "mate", F.when(F.col("nk") > 0, S.run_lengths(every)).otherwise(F.lit("*")).alias("annot"))


def provenance(stages: DataFrame, assigned: DataFrame, qc: DataFrame, baited: DataFrame, segments: DataFrame) -> DataFrame:
    """One row for each pair with the flag of each filter, nothing dropped.

    ``stages`` as of :func:`pair_stages`, ``assigned(pair_id, locus)``, ``qc(locus,
    ok)``, ``baited(pair_id, mate)`` mates that break a bait, ``segments`` of both
    mates of assigned pairs. ``dst0`` is the locus that was found, ``dst`` what is left
    of it; ``hf`` mates that found none, ``qc`` pairs of a bad locus, ``bf`` and ``bait``
    broken baits of mates and pairs, ``af`` mates without a clear repeat, ``rm`` mates
    that do not count; ``out`` pairs that are written.
    """
    bait = baited.groupBy("pair_id").agg(*(F.bool_or(F.col("mate") == i).alias(f"b{i}") for i in (1, 2)))
    of = lambda i, c: F.max(F.when(F.col("mate") == i, F.col(c))).alias(f"{c}{i}")
    mates = segments.groupBy("pair_id").agg(*(of(i, c) for i in (1, 2) for c in ("kept", "nt", "bs", "si", "ei")))
    rows = stages.join(assigned.select("pair_id", F.col("locus").alias("dst0")), "pair_id", "left").join(bait, "pair_id", "left").join(mates, "pair_id", "left")
    rows = rows.join(qc.where("not ok").select(F.col("locus").alias("dst0"), F.lit(True).alias("bad")), "dst0", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = F.col("dst0").isNotNull()
    rows = rows.withColumns({"hf1": ~found & ~F.col("sub") & ~F.col("kf1"), "hf2": ~found & ~F.col("sub") & ~F.col("kf2"), "qc": no("bad"), "out": found & ~no("bad")})
    rows = rows.withColumns({"bf1": F.col("out") & no("b1"), "bf2": F.col("out") & no("b2")}).withColumn("bait", F.col("bf1") | F.col("bf2"))
    rows = rows.withColumns({f"af{i}": F.col("out") & ~F.col("bait") & ~F.col(f"kf{i}") & ~no(f"kept{i}") for i in (1, 2)})
    rows = rows.withColumns({f"rm{i}": F.col(f"kf{i}") | F.col("bait") | F.col(f"af{i}") for i in (1, 2)})
    rows = rows.withColumn("dst", F.when(F.col("out") & ~(F.col("rm1") & F.col("rm2")), F.col("dst0")))
    early = {i: F.col(f"kf{i}") | F.col("bait") for i in (1, 2)}
    shown = {f"{c}{i}": F.when(~early[i], F.coalesce(f"{c}{i}", F.lit(0)) if c in ("nt", "bs") else F.col(f"{c}{i}")) for i in (1, 2) for c in ("nt", "bs", "si", "ei")}
    return rows.withColumns(shown).drop("b1", "b2", "bad", "kept1", "kept2")


def counters(rows: DataFrame) -> DataFrame:
    """The run's eleven counters, in one pass over :func:`provenance` rows with ``short``: reads, and how many of them each step removed or let through."""
    many = lambda *flags: F.sum(functools.reduce(lambda a, b: a + b, (f.cast("long") for f in flags)))
    two, c = lambda flag: 2 * F.count_if(flag), F.col
    return rows.agg(
        (2 * F.count("*")).alias("reads"), two(c("short")).alias("short"), two(c("sub")).alias("sampled_filter"), many(c("kf1"), c("kf2")).alias("kmer_filter"),
        many(c("bf1") & ~c("kf1"), c("bf2") & ~c("kf2")).alias("bait_filter"), F.lit(0).cast("long").alias("quality_filter"), many(c("hf1"), c("hf2")).alias("locus_filter"),
        many(c("qc") & ~c("kf1"), c("qc") & ~c("kf2")).alias("qc_filter"), two(c("out")).alias("entered"), two(c("out")).alias("feasible"), many(c("out") & ~c("rm1"), c("out") & ~c("rm2")).alias("assigned"),
    )


def kam(rows: DataFrame, pairs: DataFrame, annotations: DataFrame) -> DataFrame:
    """The fifteen columns of the assignment record, mate 2 before mate 1, of the pairs that are written; ``pairs(pair_id, title, src, seq1, seq2, qual1, qual2)``."""
    of = lambda i: F.max(F.when(F.col("mate") == i, F.col("annot"))).alias(f"annot{i}")
    both = rows.where("out").join(pairs, "pair_id").join(annotations.groupBy("pair_id").agg(of(1), of(2)), "pair_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    flag = lambda c: F.col(c).cast("int").cast("string")
    stats = lambda i: F.concat_ws(":", *(flag(f"{c}{i}") for c in ("kf", "hf", "bf")), F.lit("0"), flag(f"af{i}"), flag(f"rm{i}"), F.lit("0"), F.lit("0"), text(f"si{i}"), text(f"nt{i}"), text(f"bs{i}"), F.lit("."))
    length = lambda i: F.coalesce(F.col(f"ei{i}") - F.col(f"si{i}"), F.lit(0)).cast("long").alias(f"len{i}")
    return both.select(
        text("src").alias("src"), text("dst").alias("dst"), text("dst0").alias("dst0"), length(2), length(1), F.lit("kf:hf:bf:qf:af:rm:qn:qm:si:nt:bs:ti").alias("tag"),
        stats(2).alias("stats2"), stats(1).alias("stats1"), *(F.coalesce(f"annot{i}", F.lit("*")).alias(f"annot{i}") for i in (2, 1)), "title", "seq2", text("qual2").alias("qual2"), "seq1", text("qual1").alias("qual1"),
    )


def bait_rejected(kmers: DataFrame, assigned: DataFrame, bait: DataFrame, by: str = "title", mates: bool = False) -> DataFrame:
    """Titles (with ``mates``, titles and mates) in which some k-mer of a mate occurs less often than ``mi`` or more often than ``ma`` of its locus' bait."""
    seen = kmers.join(assigned.select(by, "locus"), by).groupBy(by, "locus", "mate", "kmer").agg(F.count("*").alias("n"))
    return bait_broken(seen, bait, by, mates)


def bait_broken(seen: DataFrame, bait: DataFrame, by: str = "title", mates: bool = False) -> DataFrame:
    """As :func:`bait_rejected`, of k-mers that are counted: ``seen(by, locus, mate, kmer, n)``."""
    return seen.join(bait, ["locus", "kmer"]).where((F.col("n") < F.col("mi")) | (F.col("n") > F.col("ma"))).select(by, *(["mate"] if mates else [])).distinct()


def pair_mates(reads: DataFrame) -> DataFrame:
    """``(name, seq1, seq2)`` of reads ``(title, ord, seq)`` that share a name: the later one first; without a mate left out."""
    named = reads.withColumn("name", S.mate_name(F.col("title")))
    both = named.groupBy("name").agg(F.count("*").alias("n"), F.max_by("seq", "ord").alias("seq1"), F.min_by("seq", "ord").alias("seq2"))
    return both.where("n = 2").drop("n")
