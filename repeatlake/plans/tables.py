"""The driver's tables seen as sequences, reads, intervals and genotypes, in Spark and as named DuckDB subqueries.

Documents stand for sequences (``doc_id`` locus, ``lang`` haplotype, ``source``
genome); tiled pairs of a sequence are reads; line items are genotypes (supplier
= sample, part = locus, line number = k-mer, quantity = count); events are
intervals on one chromosome for each user.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatlake.functions import sequence as S
from repeatlake.operators import align, kmers, placed, profiles, stretches
from repeatlake.plans.storage import materialize

K = 11  # of k-mer tables
READ_K = 21  # of reads and their index
INNER, OUTER = 100, 100  # flank within a sequence, and starts beside the repeat that are indexed
LEAST = 10  # hits of a mate


def rc(x: str) -> str:
    return f"reverse(translate({x},'ACGT','TGCA'))"


def ca(x: str) -> str:
    return f"least({x},{rc(x)})"


def _windows(seqs: str, k: int, keep: str) -> str:
    return f"SELECT {keep}, CAST(t.pos AS BIGINT) AS pos, substr(seq, CAST(t.pos AS BIGINT)+1, {k}) AS kmer FROM {seqs}, unnest(range(0, length(seq)-{k}+1)) AS t(pos)"


#: Named subqueries; each may use those that it mentions.
CTE = {
    "seqs": f"SELECT doc_id AS locus, lang AS hap, source AS genome, translate(regexp_replace(text,'[^A-Za-z0-9]','','g'),'{S.LETTERS}','{S.AS_BASES}') AS seq FROM documents WHERE text IS NOT NULL",
    "km": f"SELECT * FROM ({_windows('seqs', K, 'locus, hap, genome, length(seq) AS len')}) WHERE NOT contains(kmer,'N')",
    "counts": f"SELECT locus, {ca('kmer')} AS kmer, count(*) AS cnt FROM km GROUP BY ALL",
    "strands": f"SELECT locus, seq FROM seqs UNION ALL SELECT locus, {rc('seq')} FROM seqs",
    "gw": f"SELECT * FROM ({_windows('strands', K, 'locus, seq')}) WHERE NOT contains(kmer,'N')",
    "gbits": f"SELECT locus, kmer, substr(seq, pos+{K}+1, 1) AS nxt, substr(kmer,2)||substr(seq, pos+{K}+1, 1) AS follows FROM gw",
    "graph": "SELECT locus, kmer, CAST(bit_or(CASE WHEN nxt IN ('A','C','G','T') AND follows<>kmer THEN 1 << CAST(instr('ACGT',nxt)-1 AS INTEGER) ELSE 0 END) AS BIGINT) AS out_mask FROM gbits GROUP BY ALL",
    "region": f"SELECT locus, hap, genome, pos, {ca('kmer')} AS kmer, CASE WHEN pos>={INNER} AND pos<=len-{INNER}-{READ_K} THEN 'tr' WHEN (pos>={INNER}-{OUTER} AND pos<={INNER}-1) OR (pos>=len-{INNER}-{READ_K}+1 AND pos<=len-{INNER}-{READ_K}+{OUTER}) THEN 'fl' END AS kind FROM ({_windows('seqs', READ_K, 'locus, hap, genome, length(seq) AS len')}) WHERE NOT contains(kmer,'N')",
    "sets": "SELECT locus, hap, genome, pos, kind, kmer FROM region WHERE kind IS NOT NULL",
    "idx": "SELECT DISTINCT kmer, locus FROM sets",
    "sim": f"SELECT locus, CAST(t.beg AS BIGINT) AS beg, locus||':'||t.beg||'-'||(t.beg+500) AS title, substr(seq, t.beg+1, 150) AS seq1, {rc('substr(seq, t.beg+351, 150)')} AS seq2 FROM seqs, unnest(range(0, length(seq)-500+1, 300)) AS t(beg)",
    "mates": "SELECT title, CAST(1 AS BIGINT) AS mate, seq1 AS seq FROM sim UNION ALL SELECT title, CAST(2 AS BIGINT), seq2 FROM sim",
    "pk": f"SELECT title, mate, pos, {ca('kmer')} AS kmer FROM ({_windows('mates', READ_K, 'title, mate')}) WHERE NOT contains(kmer,'N')",
    "mult": "SELECT title, kmer, count(*) FILTER (mate=1) AS n1, count(*) FILTER (mate=2) AS n2 FROM pk GROUP BY ALL",
    "ranked": "SELECT title, mate, kmer, row_number() OVER (PARTITION BY title, mate ORDER BY pos)-1 AS i, count(*) OVER (PARTITION BY title, mate) AS n FROM pk",
    "pre": "SELECT title FROM ranked WHERE i IN (0, n//3, 2*(n//3), n-1) AND kmer IN (SELECT kmer FROM idx) GROUP BY title HAVING count(DISTINCT mate)=2",
    "passing": f"SELECT title, mate FROM pk WHERE kmer IN (SELECT kmer FROM idx) AND title IN (SELECT title FROM pre) GROUP BY ALL HAVING count(*)>={LEAST}",
    "good": "SELECT title, mate, pos, kmer FROM pk JOIN passing USING (title, mate)",
    "multg": "SELECT title, kmer, count(*) FILTER (mate=1) AS n1, count(*) FILTER (mate=2) AS n2 FROM good GROUP BY ALL",
    "hits": "SELECT title, locus, CAST(sum(n1) AS BIGINT) AS m1, CAST(sum(n2) AS BIGINT) AS m2 FROM multg JOIN idx USING (kmer) GROUP BY ALL",
    "best": "SELECT *, row_number() OVER (PARTITION BY title ORDER BY m1+m2 DESC, locus) AS rank FROM hits",
    "asg": f"SELECT title, locus, m1, m2 FROM best WHERE rank=1 AND ((m1>={LEAST} AND m2>={LEAST}) OR m1+m2>={2 * LEAST})",
    "kinds": "SELECT locus, kmer, max(CASE WHEN kind='fl' THEN 1 ELSE 0 END) AS fl FROM sets GROUP BY ALL",
    "st": "SELECT title, a.locus, mate, pos, good.kmer, CAST(CASE WHEN fl=1 THEN 1 WHEN fl=0 THEN 2 ELSE 0 END AS BIGINT) AS state FROM good JOIN asg a USING (title) LEFT JOIN kinds n ON n.locus=a.locus AND n.kmer=good.kmer",
    "st1": "SELECT *, CASE WHEN state>0 THEN state END AS known, last_value(CASE WHEN state>0 THEN state END IGNORE NULLS) OVER w AS before, last_value(CASE WHEN state>0 THEN pos END IGNORE NULLS) OVER w AS seen FROM st WINDOW w AS (PARTITION BY title, mate ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "st2": "SELECT *, (known IS NOT NULL AND before IS NOT NULL AND known<>before) AS turn, CASE WHEN known IS NOT NULL AND before IS NOT NULL AND known<>before THEN CASE WHEN pos-seen>1 THEN (seen+1+pos)//2 ELSE pos END END AS edge FROM st1",
    "seg0": "SELECT title, locus, mate, count(*) FILTER (turn) AS nt, arg_min(known, CASE WHEN known IS NOT NULL THEN pos END) AS bs, count(*) FILTER (state=2) AS n_tr, min(edge) AS fst, max(edge) AS snd, max(pos)+1 AS nk FROM st2 GROUP BY ALL",
    "seg1": "SELECT *, coalesce((nt=0 AND bs=2) OR nt=1 OR (nt=2 AND bs=1 AND n_tr>=40), false) AS kept FROM seg0",
    "seg": "SELECT title, locus, mate, nt, bs, n_tr, kept, CASE WHEN kept THEN CASE WHEN bs=2 THEN 0 ELSE fst END END AS si, CASE WHEN kept THEN CASE WHEN nt=0 THEN nk WHEN nt=1 AND bs=2 THEN fst WHEN nt=1 THEN nk ELSE snd END END AS ei FROM seg1",
    "obs": "SELECT title, locus, mate, CASE WHEN s.bs=2 THEN 0 ELSE t.into_ END AS lo, CASE WHEN s.nt=0 THEN t.nk WHEN s.nt=1 AND s.bs=2 THEN t.out1 WHEN s.nt=1 THEN t.nk ELSE t.out2 END AS hi FROM seg s JOIN (SELECT title, mate, min(pos) FILTER (turn) AS into_, min(seen+1) FILTER (turn) AS out1, max(seen+1) FILTER (turn) AS out2, max(pos)+1 AS nk FROM st2 GROUP BY ALL) t USING (title, mate) WHERE s.kept",
    "known_edges": f"SELECT locus, edge FROM (SELECT locus, {ca('kmer')} AS edge FROM ({_windows('seqs', READ_K + 1, 'locus, length(seq) AS len')}) WHERE NOT contains(kmer,'N') AND pos>={INNER} AND pos<len-{INNER}-{READ_K}) GROUP BY ALL HAVING count(*)>=2",
    "read_edges": f"SELECT title, mate, pos, {ca('kmer')} AS edge FROM ({_windows('mates', READ_K + 1, 'title, mate')}) WHERE NOT contains(kmer,'N')",
    "novel": "SELECT o.locus, e.edge, count(*) AS n FROM read_edges e JOIN obs o ON o.title=e.title AND o.mate=e.mate WHERE e.pos>=o.lo AND e.pos<o.hi-1 AND NOT EXISTS (SELECT 1 FROM known_edges k WHERE k.locus=o.locus AND k.edge=e.edge) GROUP BY ALL",
    "bait": "SELECT locus, kmer, CAST(1 AS BIGINT) AS mi, max(n) AS ma FROM (SELECT locus, kmer, genome, count(*) AS n FROM sets WHERE kind='tr' GROUP BY ALL) GROUP BY ALL",
    "broken": "SELECT DISTINCT s.title, s.mate FROM (SELECT pk.title, a.locus, mate, pk.kmer, count(*) AS n FROM pk JOIN asg a ON a.title=pk.title GROUP BY ALL) s JOIN bait b ON b.locus=s.locus AND b.kmer=s.kmer WHERE s.n<mi OR s.n>ma",
    "flow0": "SELECT s.title, s.seq1, s.seq2, s.locus AS src, a.locus AS dst0, p.title IS NULL AS sub, p.title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM passing x WHERE x.title=s.title AND x.mate=1) AS kf1, p.title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM passing x WHERE x.title=s.title AND x.mate=2) AS kf2, coalesce(a.locus%7=3, false) AS qc, EXISTS (SELECT 1 FROM broken x WHERE x.title=s.title AND x.mate=1) AS b1, EXISTS (SELECT 1 FROM broken x WHERE x.title=s.title AND x.mate=2) AS b2, g1.kept AS kept1, g2.kept AS kept2, g1.nt AS nt1, g2.nt AS nt2, g1.bs AS bs1, g2.bs AS bs2, g1.si AS si1, g2.si AS si2, g1.ei AS ei1, g2.ei AS ei2 FROM sim s LEFT JOIN pre p ON p.title=s.title LEFT JOIN asg a ON a.title=s.title LEFT JOIN (SELECT * FROM seg WHERE mate=1) g1 ON g1.title=s.title LEFT JOIN (SELECT * FROM seg WHERE mate=2) g2 ON g2.title=s.title",
    "flow1": "SELECT *, dst0 IS NOT NULL AND NOT qc AS out_, dst0 IS NULL AND NOT sub AND NOT kf1 AS hf1, dst0 IS NULL AND NOT sub AND NOT kf2 AS hf2, dst0 IS NOT NULL AND NOT qc AND b1 AS bf1, dst0 IS NOT NULL AND NOT qc AND b2 AS bf2 FROM flow0",
    "flow": "SELECT *, bf1 OR bf2 AS baited, out_ AND NOT (bf1 OR bf2) AND NOT kf1 AND NOT coalesce(kept1,false) AS af1, out_ AND NOT (bf1 OR bf2) AND NOT kf2 AND NOT coalesce(kept2,false) AS af2 FROM flow1",
    "noted0": f"SELECT a.title, m.mate, CAST(t.pos AS BIGINT) AS pos, CASE WHEN fl=1 THEN '.' WHEN fl=0 THEN '=' ELSE '*' END AS c FROM asg a JOIN mates m ON m.title=a.title, unnest(range(0, length(m.seq)-{READ_K}+1)) AS t(pos) LEFT JOIN pk ON pk.title=a.title AND pk.mate=m.mate AND pk.pos=t.pos LEFT JOIN kinds n ON n.locus=a.locus AND n.kmer=pk.kmer",
    "noted": "SELECT title, mate, string_agg(n||c, '' ORDER BY s) AS annot FROM (SELECT title, mate, c, min(pos) AS s, count(*) AS n FROM (SELECT *, pos-row_number() OVER (PARTITION BY title, mate, c ORDER BY pos) AS run FROM noted0) GROUP BY title, mate, c, run) GROUP BY ALL",
    "geno": "SELECT CAST(l_suppkey AS BIGINT) AS sample, CAST(l_partkey AS BIGINT) AS locus, CAST(l_linenumber AS BIGINT) AS kmer_idx, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "depth": "SELECT CAST(s_suppkey AS BIGINT) AS sample, 10.0 + abs(s_acctbal)/1000.0 AS depth FROM supplier",
    "inv": "SELECT DISTINCT CAST(p_partkey AS BIGINT) AS locus, CAST(i AS BIGINT) AS kmer_idx, 1.0 + (p_size % 5) AS ikmc FROM part, unnest(range(1,4)) AS t(i)",
    "iv": "SELECT 'u'||user_id AS chrom, CAST(event_id*10 AS BIGINT) AS start, CAST(event_id*10 + 10 + 40*(event_id%17) AS BIGINT) AS \"end\", CAST(event_id AS BIGINT) AS name FROM events",
    "iw": "SELECT 'u'||user_id AS chrom, CAST(event_id*10 - 500 AS BIGINT) AS start, CAST(event_id*10 + 300 AS BIGINT) AS \"end\", event_type AS name FROM events",
    "edges": f"SELECT locus, {ca('kmer')} AS edge, count(*) AS cnt FROM ({_windows('seqs', K + 1, 'locus')}) WHERE NOT contains(kmer,'N') GROUP BY ALL",
}


def sql(body: str) -> str:
    """``body`` after the subqueries that it needs."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in CTE:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|,)\s*\(?{name}\b", text):
                add(CTE[name])
                need.append(name)

    add(body)
    extra = ", ".join(f"{n} AS ({CTE[n]})" for n in need)
    if not extra:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {extra}, " + body[15:]
    return f"WITH {extra}, " + body[5:] if body.startswith("WITH ") else f"WITH {extra} {body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a plain scan dealt to all cores, where the scan has fewer files than there are cores.

    A file may be a single row group, which only one task can read; expanding its
    rows to windows there would leave the other cores idle. Larger tables are not
    shuffled: their files already make enough tasks.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if len(rows.inputFiles()) < cores else rows


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    """``(locus, hap, genome, seq)``."""
    d = spread(table(spark, sf, "documents").where("text is not null").select("doc_id", "lang", "source", "text"))
    # exploded, so that the sequence is a plain column which no later expression computes again
    seq = F.explode(F.array(S.from_text(F.col("text"))))
    return d.select(F.col("doc_id").alias("locus"), F.col("lang").alias("hap"), F.col("source").alias("genome"), seq.alias("seq"))


def loci(spark, sf) -> DataFrame:
    """``(locus, n)``: every row's locus, and characters of its text, which its sequence has at most."""
    return table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("locus"), F.length("text").alias("n"))


def counts(spark, sf) -> DataFrame:
    return kmers.count(seqs(spark, sf), K, loci=loci(spark, sf))


def sets(spark, sf) -> DataFrame:
    """``(locus, hap, genome, pos, kind, kmer)`` of repeats and flanks."""
    return kmers.regions(seqs(spark, sf), READ_K, INNER, OUTER, "hap", "genome")


def coded_sets(spark, sf) -> DataFrame:
    """``(locus, kmer)`` of repeats and flanks, k-mers as numbers."""
    rows = kmers.codes(seqs(spark, sf).withColumn("length", F.length("seq")), ["locus", "length"], READ_K)
    return rows.where(kmers.region(F.col("pos"), F.col("length"), READ_K, INNER, OUTER).isNotNull()).select("locus", "kmer")


def stretches_of_regions(span: int):
    """Counts in stretches of ``span`` starts, of the k-mers of repeats and flanks (:func:`kmers.region`)."""
    return lambda found, k: kmers.stretches(span)(kmers.in_region(found, k, INNER, OUTER), k)


def index(spark, sf) -> DataFrame:
    """``(kmer, locus)`` of repeats and flanks, distinct, k-mers as numbers; loci of one row are not shuffled for that."""
    whole, parted = kmers.split_loci(seqs(spark, sf), loci(spark, sf))
    inside = lambda found, k: kmers.counted_windows(kmers.in_region(found, k, INNER, OUTER), k)
    out = kmers.distinct_in_rows(whole, ["locus"], READ_K, "n long", inside).select("kmer", "locus")
    if parted is None:
        return out
    rows = kmers.codes(parted.withColumn("length", F.length("seq")), ["locus", "length"], READ_K)
    return out.unionByName(rows.where(kmers.region(F.col("pos"), F.col("length"), READ_K, INNER, OUTER).isNotNull()).select("kmer", "locus").distinct())


def buckets(spark, sf) -> int:
    """How many buckets k-mers are brought together in, about 2^19 characters of text each."""
    return max(8, -(-(loci(spark, sf).agg(F.sum("n")).first()[0] or 0) // (1 << 19)))


def _in_region(pos, length):
    last = length - INNER - READ_K
    return (pos >= INNER) & (pos <= last) | (pos >= INNER - OUTER) & (pos <= INNER - 1) | (pos >= last + 1) & (pos <= last + OUTER)


def packed_index(spark, sf, many: int) -> DataFrame:
    """The k-mers of repeats and flanks as stretches (:mod:`repeatlake.operators.stretches`), not yet distinct."""
    return stretches.packed(seqs(spark, sf), "locus", READ_K, many, _in_region)


def packed_reads(spark, sf, many: int) -> DataFrame:
    """The k-mers of read pairs by title, as stretches."""
    return stretches.packed(align.mates(sim(spark, sf)), "title", READ_K, many)


def repeats(spark, sf) -> DataFrame:
    """``(hap, genome, kmer, cnt)`` of repeats, k-mers as numbers, added up within a row; the same k-mer of several rows is several rows here too."""
    whole, parted = kmers.split_loci(seqs(spark, sf), loci(spark, sf))
    inside = lambda found, k: kmers.counted_windows(kmers.in_region(found, k, INNER, 0), k)
    out = kmers.distinct_in_rows(whole, ["hap", "genome"], READ_K, "cnt long", inside)
    if parted is None:
        return out
    rows = kmers.codes(parted.withColumn("length", F.length("seq")), ["hap", "genome", "length"], READ_K)
    return out.unionByName(rows.where(kmers.region(F.col("pos"), F.col("length"), READ_K, INNER, 0) == "tr").select("hap", "genome", "kmer", F.lit(1).cast("long").alias("cnt")))


def read_counts(spark, sf) -> DataFrame:
    """``(title, mate, kmer, cnt)`` of read pairs, k-mers as numbers; pairs whose title is theirs alone are counted where they are."""
    whole, parted = kmers.split_loci(seqs(spark, sf), loci(spark, sf))
    out = kmers.distinct_in_rows(align.mates(align.simulate(whole)), ["title", "mate"], READ_K, "cnt long", kmers.counted_windows)
    if parted is None:
        return out
    rows = kmers.codes(align.mates(align.simulate(parted)), ["title", "mate"], READ_K)
    return out.unionByName(rows.groupBy("title", "mate", "kmer").agg(F.count("*").alias("cnt")))


def read_probes(spark, sf) -> DataFrame:
    """``(title, mate, kmer)``: the evenly spaced k-mers by which pairs are sampled, as numbers."""
    whole, parted = kmers.split_loci(seqs(spark, sf), loci(spark, sf))
    out = kmers.codes(align.mates(align.simulate(whole)), ["title", "mate"], READ_K, probes=4).where("probe").select("title", "mate", "kmer")
    if parted is None:
        return out
    return out.unionByName(align.probed(kmers.codes(align.mates(align.simulate(parted)), ["title", "mate"], READ_K)).select("title", "mate", "kmer"))


def sim(spark, sf) -> DataFrame:
    return align.simulate(seqs(spark, sf))


def pk(spark, sf) -> DataFrame:
    return align.pair_kmers(sim(spark, sf), READ_K)


READS = 4096  # pairs of a locus that are looked at together


class Mapping:
    """Read pairs against the index: each table that is used more than once is written once, k-mers as numbers, pairs by number."""

    def __init__(self, spark, sf):
        self.pairs = materialize(sim(spark, sf).withColumn("pair_id", F.monotonically_increasing_id()), "pairs")
        self.kmers = align.pair_codes(self.pairs, READ_K)  # made where they are read, which costs less than to write them
        self.source = materialize(seqs(spark, sf), "kinds")  # kinds of k-mers are told from sequences; read often
        self.many, self.of = buckets(spark, sf), (spark, sf)
        self.index = stretches.packed(self.source, "locus", READ_K, self.many, _in_region)
        reads = stretches.packed(align.mates(self.pairs.select(F.col("pair_id").alias("title"), "seq1", "seq2")), "title", READ_K, self.many, probes=4)
        self.class_hits = materialize(stretches.class_hits(self.index, reads, READ_K), "class-hits")
        self.counts = align.filtered_hits(self.class_hits, LEAST)
        self.loci = self._loci()

    def _loci(self) -> DataFrame:
        """``(c1, c2, locus)`` of the classes that pairs have hit."""
        hit = self.counts.select("c1", "c2").distinct()
        several = stretches.class_loci(self.index, READ_K).join(hit.where("c2 <> 0"), ["c1", "c2"], "left_semi")
        single = hit.where("c2 = 0").select("c1", "c2", F.col("c1").alias("locus"))
        return materialize(single.unionByName(several), "loci")

    @functools.cached_property
    def split(self) -> tuple[DataFrame, DataFrame | None]:
        return kmers.split_loci(self.source, loci(*self.of))

    @functools.cached_property
    def kinds(self) -> DataFrame:
        """``(locus, kmer, fl, ma)`` of loci of several rows or long ones: whether some flank of the locus has the k-mer, and how often a genome's repeat has it at most."""
        rows = kmers.codes(self.split[1].withColumn("length", F.length("seq")), ["locus", "genome", "length"], READ_K)
        rows = rows.withColumn("kind", kmers.region(F.col("pos"), F.col("length"), READ_K, INNER, OUTER)).where("kind is not null")
        each = rows.groupBy("locus", "kmer", "genome").agg(F.max((F.col("kind") == "fl").cast("int")).alias("fl"), F.count_if(F.col("kind") == "tr").alias("n"))
        return materialize(each.groupBy("locus", "kmer").agg(F.max("fl").alias("fl"), F.max("n").alias("ma")), "kinds-by-kmer")

    def placed(self, found: DataFrame, of, schema: str, *more: str) -> DataFrame:
        """``of`` the :class:`placed.Group` of each locus of one row and its reads, those of ``found(pair_id, locus, ...)``; groups of about ``READS`` pairs."""
        parts = self.assigned().groupBy("locus").agg(F.ceil(F.count("*") / READS).alias("parts"))
        source = self.split[0].select("locus", "seq").join(parts, "locus").select("locus", "seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        reads = self.mates_of(found.join(parts, "locus").withColumn("part", F.pmod(F.xxhash64("pair_id"), F.col("parts"))), *more)
        names = [f.split()[0] for f in schema.split(", ")]

        def one(reads_, source_):
            if not reads_.num_rows or not source_.num_rows:
                return pa.table({n: pa.array([], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (f.split() for f in schema.split(", "))})
            return of(placed.Group(reads_, source_, READ_K, INNER, OUTER)).select(names)

        columns = ["locus", "part", "pair_id", "mate", *more, "seq"]
        return reads.select(*columns).groupBy("locus", "part").cogroup(source.groupBy("locus", "part")).applyInArrow(one, schema)

    def summed(self, found: DataFrame, of, schema: str, together, *more: str) -> DataFrame:
        """:meth:`placed`, with what it makes of the loci that are several groups put ``together``; that of others is not shuffled."""
        large = self.assigned().groupBy("locus").agg(F.count("*").alias("n")).where(F.col("n") > READS).select("locus")
        if large.isEmpty():
            return self.placed(found, of, schema, *more)
        large = materialize(large, "large-loci")
        small = self.placed(found.join(large, "locus", "left_anti"), of, schema, *more)
        return small.unionByName(together(self.placed(found.join(large, "locus", "left_semi"), of, schema, *more)))

    def profile(self) -> DataFrame:
        """:func:`profiles.profile` of all mates of assigned pairs, by the genome they are from and whether their locus is the right one."""
        genomes = self.source.select(F.col("locus").alias("src"), "genome")
        found = self.pairs.select("pair_id", F.col("locus").alias("src")).join(self.assigned().select("pair_id", "locus"), "pair_id").join(genomes, "src")
        found = found.withColumn("right", (F.col("src") == F.col("locus")).cast("int")).groupBy("pair_id", "locus", "genome", "right").agg(F.count("*").alias("times"))
        every = ("genome", "right", "locus", "kmer")
        sums = lambda x: x.groupBy(*every).agg(F.min("mi").alias("mi"), F.max("ma").alias("ma"), *(F.sum(c).alias(c) for c in ("n", "total", "squares")))
        out = self.summed(found, lambda g: g.profile(), "genome string, right int, locus long, kmer long, mi long, ma long, n long, total long, squares long", sums, "genome", "right", "times")
        spread = F.sqrt(F.col("n") * F.col("squares") - F.col("total") * F.col("total")) / F.col("n")  # of whole numbers, so that nothing is lost
        out = out.select("genome", (F.col("right") == 1).alias("right"), "locus", "kmer", "mi", "ma", (F.col("total") / F.col("n")).alias("mean"), spread.alias("sd"))
        rest = self.elsewhere(found)
        if rest is None:
            return out
        rows = self.codes_of(rest.withColumn("right", F.col("right") == 1).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "again"))
        return out.unionByName(profiles.profile(rows, "pair_id"))

    def elsewhere(self, found: DataFrame) -> DataFrame | None:
        """What of ``found`` is of loci of several rows or long ones; None where there are no such loci."""
        return None if self.split[1] is None else found.join(self.split[1].select("locus").distinct(), "locus", "left_semi")

    def mates_of(self, found: DataFrame, *more: str) -> DataFrame:
        """``(pair_id, mate, seq, ...)`` of the pairs of ``found(pair_id, ...)``, or of their mates where it has them: reads are joined, not their k-mers."""
        both = F.array(*(F.struct(F.lit(i).cast("long").alias("mate"), F.col(f"seq{i}").alias("seq")) for i in (1, 2)))
        reads = self.pairs.select("pair_id", *(c for c in more if c not in found.columns), F.explode(both).alias("m"))
        return reads.select("pair_id", *(c for c in more if c not in found.columns), "m.mate", "m.seq").join(found, ["pair_id", *(["mate"] if "mate" in found.columns else [])])

    def codes_of(self, found: DataFrame) -> DataFrame:
        """``(pair_id, mate, ..., pos, kmer)`` of :meth:`mates_of`."""
        rows = self.mates_of(found)
        return kmers.codes(rows, [c for c in rows.columns if c != "seq"], READ_K).withColumn("pos", F.col("pos").cast("long"))

    def broken(self, mates: bool = False) -> DataFrame:
        """Pairs, or their mates, that break the bait of their locus: k-mers of its repeat, at most as often as some genome has them."""
        found = self.assigned().select("pair_id", "locus")
        out, rest = self.placed(found, lambda g: g.broken(), "pair_id long, mate long"), self.elsewhere(found)
        out = out if mates else out.select("pair_id").distinct()
        if rest is None:
            return out
        seen = kmers.distinct_in_rows(self.mates_of(rest), ["pair_id", "locus", "mate"], READ_K, "n long", kmers.counted_windows)
        bait = self.kinds.where("ma > 0").select("locus", "kmer", F.lit(1).cast("long").alias("mi"), "ma")
        return out.unionByName(align.bait_broken(seen, bait, "pair_id", mates))

    def hits(self) -> DataFrame:
        return align.expanded(self.counts, self.loci)

    def assigned(self) -> DataFrame:
        """``(pair_id, locus, m1, m2)``, written once."""
        if not hasattr(self, "_assigned"):
            self._assigned = materialize(align.assign(align.expanded(self.counts, align.first_of_alike(self.loci)), LEAST, "pair_id"), "assigned")
        return self._assigned

    def good(self) -> DataFrame:
        """``(pair_id, mate, locus)`` of assigned pairs' mates that passed the filters."""
        return align.kept_mates(self.counts).join(self.assigned().select("pair_id", "locus"), "pair_id")

    def _states(self, found: DataFrame, *more: str) -> DataFrame:
        """States of the k-mers of ``found(pair_id, mate, locus)``, by joins."""
        rows = self.mates_of(found, *more)
        known = kmers.codes(rows, [c for c in rows.columns if c != "seq"], READ_K).withColumn("pos", F.col("pos").cast("long")).join(self.kinds, ["locus", "kmer"], "left")
        state = F.when(F.col("fl") == 1, 1).when(F.col("fl") == 0, 2).otherwise(0).cast("long")
        return known.select("pair_id", *more, "locus", "mate", "pos", "kmer", state.alias("state"))

    def states(self) -> DataFrame:
        """``(title, locus, mate, pos, kmer, state)`` of mates that passed the filters."""
        keep = ["title", "locus", "mate"]
        out = self.placed(self.good(), lambda g: g.states(keep), "title string, locus long, mate long, pos long, kmer long, state long", "title")
        rest = self.elsewhere(self.good())
        return out if rest is None else out.unionByName(self._states(rest, "title").drop("pair_id"))

    def segments(self) -> DataFrame:
        def one(g):
            some, counted = g.measures()
            return g.table(some, ["pair_id", "locus", "mate"], counted)

        out = align.bounds(self.placed(self.good(), one, f"pair_id long, locus long, mate long, {placed.MEASURES}"), by="pair_id")
        rest = self.elsewhere(self.good())
        return out if rest is None else out.unionByName(align.segment(self._states(rest), by="pair_id"))

    def genotype(self) -> DataFrame:
        """``(locus, kmer, cnt)`` of repeat positions of kept mates."""
        out = self.summed(self.good(), lambda g: g.genotype(), "locus long, kmer long, cnt long", lambda x: x.groupBy("locus", "kmer").agg(F.sum("cnt").alias("cnt")))
        rest = self.elsewhere(self.good())
        if rest is None:
            return out
        states = materialize(self._states(rest), "states")  # read twice
        return out.unionByName(align.genotype(states, align.segment(states, by="pair_id"), "pair_id"))

    def novel_edges(self) -> DataFrame:
        """``(locus, edge, n)`` of the reads' edges within repeats that the graph does not know: those that the repeats of a locus hold less than twice."""
        out = self.summed(self.good(), lambda g: g.novel(), "locus long, edge long, n long", lambda x: x.groupBy("locus", "edge").agg(F.sum("n").alias("n")))
        rest = self.elsewhere(self.good())
        if rest is None:
            return out
        rows = kmers.codes(self.split[1].withColumn("length", F.length("seq")), ["locus", "length"], READ_K + 1)
        inner = rows.where((F.col("pos") >= INNER) & (F.col("pos") < F.col("length") - INNER - READ_K))
        known = inner.groupBy("locus", F.col("kmer").alias("edge")).agg(F.count("*").alias("n")).where("n >= 2").select("locus", "edge")
        of = rest.select("pair_id").distinct()
        edges = align.pair_codes(self.pairs.join(of, "pair_id", "left_semi"), READ_K + 1).withColumnRenamed("kmer", "edge")
        return out.unionByName(align.novel_edges(edges, align.segment(self._states(rest), by="pair_id", observed=True), known, "pair_id"))

    def annotations(self) -> DataFrame:
        """``(pair_id, mate, annot)``: states of all windows of both mates of assigned pairs, whether a mate passed or not."""
        found = self.assigned().select("pair_id", "locus")
        out, rest = self.placed(found, lambda g: g.annotated(), "pair_id long, mate long, annot string"), self.elsewhere(found)
        if rest is None:
            return out
        windows = self.mates_of(rest).select("pair_id", "mate", (F.length("seq") - READ_K + 1).cast("long").alias("nk"))
        return out.unionByName(align.annotation(self._states(rest).select("pair_id", "mate", "pos", "state"), windows))

    def provenance(self) -> DataFrame:
        """Every pair with the flags of all filters, among them a quality mask that leaves every seventh locus out, and the bait."""
        qc = self.assigned().select("locus").distinct().select("locus", (F.col("locus") % 7 != 3).alias("ok"))
        return align.provenance(align.pair_stages(self.pairs, self.class_hits, LEAST), self.assigned(), qc, self.broken(mates=True), self.segments())

    def titled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with titles in the place of numbers of pairs."""
        return rows.join(self.pairs.select("pair_id", "title"), "pair_id").select("title", *(c for c in rows.columns if c != "pair_id"))


def named(rows: DataFrame) -> DataFrame:
    """``rows`` with k-mers as text."""
    return rows.withColumn("kmer", S.decode(F.col("kmer"), READ_K))


def geno(spark, sf) -> DataFrame:
    g = table(spark, sf, "lineitem")
    return g.groupBy(F.col("l_suppkey").cast("long").alias("sample"), F.col("l_partkey").cast("long").alias("locus"), F.col("l_linenumber").cast("long").alias("kmer_idx")).agg(F.sum("l_quantity").alias("value"))


def depth(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("sample"), (F.lit(10.0) + F.abs("s_acctbal") / 1000.0).alias("depth"))


def invariant(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("long").alias("locus"), F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<bigint>")).alias("kmer_idx"), (F.lit(1.0) + F.col("p_size") % 5).alias("ikmc")).distinct()


def intervals(spark, sf) -> DataFrame:
    e, i = table(spark, sf, "events"), F.col("event_id").cast("long")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("chrom"), (i * 10).alias("start"), (i * 10 + 10 + 40 * (i % 17)).alias("end"), i.alias("name"))


def wider(spark, sf) -> DataFrame:
    e, i = table(spark, sf, "events"), F.col("event_id").cast("long")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("chrom"), (i * 10 - 500).alias("start"), (i * 10 + 300).alias("end"), F.col("event_type").alias("name"))


def edges(spark, sf) -> DataFrame:
    return kmers.count(seqs(spark, sf), K + 1, loci=loci(spark, sf)).withColumnRenamed("kmer", "edge")


def coded_edges(spark, sf) -> DataFrame:
    """``(locus, edge, cnt)``, edges as numbers."""
    return kmers.tally(seqs(spark, sf), K + 1, loci(spark, sf)).withColumnRenamed("kmer", "edge")
