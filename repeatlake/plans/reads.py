"""Queries over reads, intervals, genotypes and loci, each with the DuckDB SQL for its rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from repeatlake.functions import sequence as S
from repeatlake.operators import align, boundary, bubbles, dotplots, intervals, kmers, loci, predict, profiles, scorers, stretches
from repeatlake.plans import tables as T
from repeatlake.plans.storage import materialize, temporary
from repeatlake.plans.tables import LEAST, READ_K, ca
from repeatlake.sources import formats

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = T.sql(sql)
        return f

    return add


@query("SELECT locus, beg, title, seq1, seq2 FROM sim")
def simulate_reads(spark, sf):
    return T.sim(spark, sf).withColumn("beg", F.col("beg").cast("long"))


@query("SELECT title AS name, seq2 AS seq1, seq1 AS seq2 FROM sim WHERE title IN (SELECT title FROM sim GROUP BY title HAVING count(*)=1)")
def mate_pairing(spark, sf):
    mates = F.array(*(F.struct(F.concat("title", F.lit(f"/{i}")).alias("title"), F.lit(i).alias("ord"), F.col(f"seq{i}").alias("seq")) for i in (1, 2)))
    reads = T.sim(spark, sf).select(F.explode(mates).alias("r")).select("r.*")
    return align.pair_mates(reads)


@query("SELECT title, kmer, mate, count(*) AS n FROM pk JOIN idx USING (kmer) GROUP BY ALL")
def read_index_join(spark, sf):
    many = T.buckets(spark, sf)
    return T.named(stretches.read_hits(T.packed_index(spark, sf, many), T.packed_reads(spark, sf, many), READ_K)).select("title", "kmer", "mate", "n")


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY title, mate ORDER BY pos)-1 AS i, count(*) OVER (PARTITION BY title, mate) AS n FROM pk), q AS (SELECT * FROM r WHERE i IN (0, n//3, 2*(n//3), n-1)), h AS (SELECT title, mate, count(*) AS hits FROM q WHERE kmer IN (SELECT kmer FROM idx) GROUP BY ALL) SELECT title FROM h WHERE hits>=1 GROUP BY title HAVING count(*)=2"
)
def sampled_prefilter(spark, sf):
    return align.prefiltered(T.read_probes(spark, sf), T.index(spark, sf))


@query(f"SELECT title, mate, count(*) AS hits FROM pk WHERE kmer IN (SELECT kmer FROM idx) GROUP BY ALL HAVING count(*)>={LEAST}")
def kmer_hit_filter(spark, sf):
    many = T.buckets(spark, sf)
    return stretches.mate_hits(T.packed_index(spark, sf, many), T.packed_reads(spark, sf, many), READ_K).where(F.col("hits") >= LEAST)


@query("SELECT title, kmer, n1, n2 FROM mult")
def pair_kmer_multiplicity(spark, sf):
    return align.multiplicity(T.pk(spark, sf))


@query("SELECT title, locus, m1, m2 FROM hits")
def locus_hits(spark, sf):
    m = T.Mapping(spark, sf)
    return m.titled(m.hits())


@query("SELECT title, locus, m1, m2, rank FROM best WHERE rank<=2")
def top2_loci(spark, sf):
    m = T.Mapping(spark, sf)
    return m.titled(align.best_loci(m.hits(), 2, "pair_id"))


@query("SELECT title, locus, m1, m2 FROM asg")
def locus_assign(spark, sf):
    m = T.Mapping(spark, sf)
    return m.titled(m.assigned())


@query("SELECT title, locus, mate, pos, state FROM st")
def tr_flank_state(spark, sf):
    return T.Mapping(spark, sf).states().drop("kmer")


@query("SELECT title, locus, mate, nt, bs, n_tr, kept, si, ei FROM seg")
def tr_segment(spark, sf):
    m = T.Mapping(spark, sf)
    return m.titled(m.segments())


@query("SELECT st.locus, kmer, count(*) AS cnt FROM st JOIN seg USING (title, mate) WHERE state=2 AND kept GROUP BY ALL")
def genotype_kmers(spark, sf):
    return T.named(T.Mapping(spark, sf).genotype())


@query("SELECT locus, count(*) AS nmapread, CAST(sum(ei-si) AS BIGINT) AS kmc FROM seg WHERE kept GROUP BY locus")
def locus_summary(spark, sf):
    return align.summary(T.Mapping(spark, sf).segments())


@query("SELECT CAST(src AS VARCHAR) AS src, CASE WHEN baited OR ((kf1 OR af1) AND (kf2 OR af2)) THEN '.' ELSE CAST(dst0 AS VARCHAR) END AS dst, CAST(dst0 AS VARCHAR) AS dst0, CAST(CASE WHEN kf2 OR baited THEN 0 ELSE coalesce(ei2-si2,0) END AS BIGINT) AS len2, CAST(CASE WHEN kf1 OR baited THEN 0 ELSE coalesce(ei1-si1,0) END AS BIGINT) AS len1, 'kf:hf:bf:qf:af:rm:qn:qm:si:nt:bs:ti' AS tag, kf2::INT||':'||hf2::INT||':'||bf2::INT||':0:'||af2::INT||':'||(kf2 OR baited OR af2)::INT||':0:0:'||CASE WHEN kf2 OR baited THEN '.:.:.' ELSE coalesce(si2::VARCHAR,'.')||':'||coalesce(nt2,0)||':'||coalesce(bs2,0) END||':.' AS stats2, kf1::INT||':'||hf1::INT||':'||bf1::INT||':0:'||af1::INT||':'||(kf1 OR baited OR af1)::INT||':0:0:'||CASE WHEN kf1 OR baited THEN '.:.:.' ELSE coalesce(si1::VARCHAR,'.')||':'||coalesce(nt1,0)||':'||coalesce(bs1,0) END||':.' AS stats1, n2.annot AS annot2, n1.annot AS annot1, flow.title, seq2, repeat('I', length(seq2)) AS qual2, seq1, repeat('I', length(seq1)) AS qual1 FROM flow JOIN (SELECT title, annot FROM noted WHERE mate=1) n1 ON n1.title=flow.title JOIN (SELECT title, annot FROM noted WHERE mate=2) n2 ON n2.title=flow.title WHERE out_")
def kam_records(spark, sf):
    """The assignment record of every pair that found a sound locus, with all flags."""
    m = T.Mapping(spark, sf)
    quality = lambda i: F.repeat(F.lit("I"), F.length(f"seq{i}")).alias(f"qual{i}")
    pairs = m.pairs.select("pair_id", "title", F.split("title", ":")[0].alias("src"), "seq1", "seq2", quality(1), quality(2))
    return align.kam(m.provenance(), pairs, m.annotations())


@query("SELECT '>'||sim.title||':'||asg.locus||'/1' AS title1, seq1, '>'||sim.title||':'||asg.locus||'/2' AS title2, seq2 FROM (SELECT title, seq1, seq2 FROM sim) sim JOIN asg USING (title)")
def extract_reads(spark, sf):
    m = T.Mapping(spark, sf)
    both = m.pairs.select("pair_id", "title", "seq1", "seq2").join(m.assigned().select("pair_id", "locus"), "pair_id")
    name = lambda i: F.concat(F.lit(">"), "title", F.lit(":"), F.col("locus").cast("string"), F.lit(f"/{i}"))
    return both.select(name(1).alias("title1"), "seq1", name(2).alias("title2"), "seq2")


@query("SELECT 2*count(*) AS reads, 2*count(*) FILTER (length(seq1)<{K} OR length(seq2)<{K}) AS short, 2*count(*) FILTER (sub) AS sampled_filter, count(*) FILTER (kf1)+count(*) FILTER (kf2) AS kmer_filter, count(*) FILTER (bf1 AND NOT kf1)+count(*) FILTER (bf2 AND NOT kf2) AS bait_filter, CAST(0 AS BIGINT) AS quality_filter, count(*) FILTER (hf1)+count(*) FILTER (hf2) AS locus_filter, count(*) FILTER (qc AND NOT kf1)+count(*) FILTER (qc AND NOT kf2) AS qc_filter, 2*count(*) FILTER (out_) AS entered, 2*count(*) FILTER (out_) AS feasible, count(*) FILTER (out_ AND NOT (kf1 OR baited OR af1))+count(*) FILTER (out_ AND NOT (kf2 OR baited OR af2)) AS assigned FROM flow".replace("{K}", str(READ_K)))
def filter_funnel(spark, sf):
    """How many reads each step of the flow removed or let through."""
    m = T.Mapping(spark, sf)
    short = m.pairs.select("pair_id", ((F.length("seq1") < READ_K) | (F.length("seq2") < READ_K)).alias("short"))
    return align.counters(m.provenance().join(short, "pair_id"))


BAIT = "(SELECT locus, kmer, CAST(1 AS BIGINT) AS mi, max(n) AS ma FROM (SELECT locus, kmer, genome, count(*) AS n FROM sets WHERE kind='tr' GROUP BY ALL) GROUP BY ALL)"


@query(f"SELECT DISTINCT title FROM (SELECT title, a.locus, mate, kmer, count(*) AS n FROM pk JOIN asg a USING (title) GROUP BY ALL) s JOIN {BAIT} b ON b.locus=s.locus AND b.kmer=s.kmer WHERE s.n<mi OR s.n>ma")
def bait_filter(spark, sf):
    m = T.Mapping(spark, sf)
    return m.titled(m.broken())


PROFILED = "(SELECT g.genome, a.locus=CAST(split_part(title,':',1) AS BIGINT) AS \"right\", a.locus, title, mate, kmer FROM pk JOIN asg a USING (title) JOIN (SELECT locus, genome FROM seqs) g ON g.locus=CAST(split_part(title,':',1) AS BIGINT))"
PROFILE = f"(SELECT genome, \"right\", locus, kmer, min(n) AS mi, max(n) AS ma, avg(n) AS mean, stddev_pop(n) AS sd FROM (SELECT *, count(*) AS n FROM {PROFILED} GROUP BY ALL) GROUP BY ALL)"


@query(f"SELECT genome, \"right\", locus, kmer, mi, ma, round(mean,6) AS mean, round(sd,6) AS sd FROM {PROFILE}")
def kmer_profile(spark, sf):
    return T.named(T.Mapping(spark, sf).profile()).withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query(
    f"WITH p AS (SELECT * FROM {PROFILE}), w AS (SELECT locus, kmer, min(mean) AS lo, max(mean) AS hi FROM p WHERE NOT \"right\" GROUP BY ALL), b AS (SELECT w.locus, w.kmer, bool_or(coalesce(hi>=mean-2*sd AND lo<=mean+2*sd, false)) AS near, min(mi) AS mi, max(ma) AS ma FROM w LEFT JOIN (SELECT * FROM p WHERE \"right\") r ON r.locus=w.locus AND r.kmer=w.kmer GROUP BY ALL) SELECT locus, kmer, coalesce(mi,255) AS mi, coalesce(ma,0) AS ma FROM b WHERE NOT near"
)
def fps_kmers(spark, sf):
    return T.named(profiles.bait(materialize(T.Mapping(spark, sf).profile(), "profile")))  # read twice


@query("SELECT e.locus, count(*) AS n FROM edges e WHERE cnt=1 AND NOT EXISTS (SELECT 1 FROM edges f WHERE f.edge=e.edge AND f.locus<>e.locus) GROUP BY e.locus")
def novel_edges(spark, sf):
    """Edges seen once that no other locus has, by locus."""
    return kmers.alone(T.coded_edges(spark, sf), "edge").where("cnt = 1").groupBy("locus").agg(F.count("*").alias("n"))


@query("SELECT locus, edge, n FROM novel")
def read_novel_edges(spark, sf):
    """Edges of read pairs, inside the observed bounds of their repeats, that the graph of their locus does not know."""
    return T.Mapping(spark, sf).novel_edges().withColumn("edge", S.decode(F.col("edge"), READ_K + 1))


@query("SELECT locus, edge, n FROM novel WHERE n>=5")
def read_bubbles_dump(spark, sf):
    """Novel edges of reads seen at least five times, written as bubble text and read back."""
    place = f"{temporary(spark, 'bubbles')}/text"
    formats.write_kmer_rows(T.Mapping(spark, sf).novel_edges().withColumnRenamed("edge", "kmer"), place, ["n"], least=5)
    return formats.kmer_rows(spark, place, ["n"]).select("locus", S.decode(F.col("kmer"), READ_K + 1).alias("edge"), "n")


@query("SELECT c.locus, c.kmer, coalesce(p.cnt,0) AS pan FROM counts c LEFT JOIN (SELECT kmer, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts WHERE cnt>=2 GROUP BY kmer) p USING (kmer)")
def map_pan_counts(spark, sf):
    rows = kmers.tally(T.seqs(spark, sf), T.K, T.loci(spark, sf))
    pan = rows.where("cnt >= 2").groupBy("kmer").agg(F.sum("cnt").alias("pan"))
    # at most 4^11 / 2 k-mers, about two million, however many sequences there are
    found = rows.select("locus", "kmer").join(F.broadcast(pan), "kmer", "left")
    return found.select("locus", S.decode(F.col("kmer"), T.K).alias("kmer"), F.coalesce("pan", F.lit(0)).alias("pan"))


PAIRED = f"(SELECT locus//2 AS pair, locus%2 AS side, kmer, kind, count(*) AS n, min(pos) AS fst FROM sets GROUP BY ALL)"


def _dots(spark, sf):
    return dotplots.dots(T.seqs(spark, sf), READ_K, T.INNER, T.OUTER, T.loci(spark, sf))


@query(f"SELECT a.pair, a.kmer, a.kind AS kind_a, b.kind AS kind_b, a.n*b.n AS dots, a.fst AS first_a, b.fst AS first_b FROM {PAIRED} a JOIN {PAIRED} b ON a.pair=b.pair AND a.kmer=b.kmer AND a.side=0 AND b.side=1")
def dotplot_pairs(spark, sf):
    """k-mers shared by two neighbouring loci: how many dots each makes, and where the first lies."""
    return T.named(_dots(spark, sf))


@query(f"SELECT a.pair, CAST(sum(a.n*b.n) FILTER (a.kind='tr' AND b.kind='fl') AS BIGINT) AS tr_fl, CAST(sum(a.n*b.n) FILTER (a.kind='fl' AND b.kind='tr') AS BIGINT) AS fl_tr FROM {PAIRED} a JOIN {PAIRED} b ON a.pair=b.pair AND a.kmer=b.kmer AND a.side=0 AND b.side=1 GROUP BY a.pair")
def contamination_counts(spark, sf):
    dots = _dots(spark, sf)
    part = lambda x, y: F.sum(F.when((F.col("kind_a") == x) & (F.col("kind_b") == y), F.col("dots"))).alias(f"{x}_{y}")
    return dots.groupBy("pair").agg(part("tr", "fl"), part("fl", "tr"))


@query('SELECT a.chrom, a.start, a."end", a.name, count(b.chrom) AS n FROM iv a LEFT JOIN iw b ON a.chrom=b.chrom AND a.start<b."end" AND b.start<a."end" GROUP BY ALL')
def interval_map_count(spark, sf):
    return intervals.map_count(T.intervals(spark, sf), T.wider(spark, sf), width=1000)


@query("SELECT a.name, coalesce(string_agg(DISTINCT b.name, ',' ORDER BY b.name), '.') AS hits FROM iv a LEFT JOIN iw b ON a.chrom=b.chrom AND a.start<b.\"end\" AND b.start<a.\"end\" GROUP BY a.name")
def interval_map_collapse(spark, sf):
    return intervals.map_collapse(T.intervals(spark, sf), T.wider(spark, sf), width=1000).select("name", "hits")


MERGED = 'SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 THEN 1 WHEN row_number() OVER (PARTITION BY chrom ORDER BY start, "end")=1 THEN 1 ELSE 0 END AS new FROM iw)) GROUP BY chrom, island'


@query(MERGED)
def interval_merge(spark, sf):
    return intervals.merge(T.wider(spark, sf), 100)


@query('SELECT chrom, greatest(start-250,0) AS start, "end"+250 AS "end", name FROM iv')
def interval_slop(spark, sf):
    return intervals.slop(T.intervals(spark, sf), 250)


@query('SELECT chrom, start, "end", name, lead(start) OVER (PARTITION BY chrom ORDER BY start, "end", name)-"end" AS gap FROM iv')
def interval_gaps(spark, sf):
    return intervals.gaps(T.intervals(spark, sf))


@query('SELECT chrom, start, "end", name FROM iv ORDER BY chrom, start, "end"')
def bed_sort(spark, sf):
    return T.intervals(spark, sf).orderBy("chrom", "start", "end")


@query("SELECT contig, chrom, n, total FROM (SELECT 'p'||l_partkey AS contig, l_shipmode AS chrom, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY l_partkey) AS BIGINT) AS total, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_shipmode DESC) AS r FROM (SELECT l_partkey, l_returnflag||l_linestatus AS l_shipmode FROM lineitem) GROUP BY l_partkey, l_shipmode) WHERE r=1 AND n>=0.35*total")
def contig_majority_chrom(spark, sf):
    rows = T.table(spark, sf, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("contig"), F.concat("l_returnflag", "l_linestatus").alias("chrom"))
    return intervals.majority_chromosome(rows, 0.35)


LIFT = "(SELECT l_orderkey AS name, l_returnflag AS contig, CAST(l_partkey*50 AS BIGINT) AS start, CAST(l_partkey*50+200+l_linenumber AS BIGINT) AS \"end\", CAST(CASE WHEN l_linestatus='O' THEN 1 ELSE -1 END AS BIGINT) AS strand FROM lineitem)"


@query(
    f'WITH j AS (SELECT *, coalesce(start - max("end") OVER (PARTITION BY name ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS jump FROM {LIFT}) SELECT name, min(contig) AS contig, min(start) AS start, max("end") AS "end", CASE WHEN min(strand)=max(strand) THEN min(strand) ELSE 0 END AS strand, count(*) AS parts FROM j GROUP BY name HAVING count(DISTINCT contig)=1 AND max(jump)<10000'
)
def liftover_clean(spark, sf):
    g, start = T.table(spark, sf, "lineitem"), (F.col("l_partkey") * 50).cast("long")
    strand = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).cast("long")
    return intervals.lift_clean(g.select(F.col("l_orderkey").alias("name"), F.col("l_returnflag").alias("contig"), start.alias("start"), (start + 200 + F.col("l_linenumber")).alias("end"), strand.alias("strand")))


@query("SELECT c_mktsegment AS hap, CAST(c_nationkey AS BIGINT) AS locus, CAST(CASE WHEN ok THEN sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey ROWS UNBOUNDED PRECEDING)-1 END AS BIGINT) AS ord FROM (SELECT c_mktsegment, c_nationkey, max(c_acctbal)>9000 AS ok FROM customer GROUP BY ALL)")
def ortho_map_build(spark, sf):
    rows = T.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("hap"), F.col("c_nationkey").cast("long").alias("locus")).agg((F.max("c_acctbal") > 9000).alias("present"))
    return intervals.ortho_map(rows).select("hap", "locus", "ord")


@query(
    "WITH RECURSIVE e AS (SELECT least(a,b) AS a, greatest(a,b) AS b FROM (SELECT a.l_suppkey AS a, CAST(a.l_partkey%1009 + 100000 AS BIGINT) AS b FROM lineitem a) GROUP BY ALL HAVING count(*)>=5), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, reach) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.reach=s.a) SELECT node, min(reach) AS component FROM r GROUP BY node"
)
def union_find_merge(spark, sf):
    """Suppliers and parts that are met at least five times."""
    rows = T.table(spark, sf, "lineitem")
    pairs = rows.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 1009 + 100000).cast("long").alias("b"))
    return intervals.union_find(pairs)


@query(
    "WITH RECURSIVE g AS (SELECT l_orderkey AS grp, CAST((l_orderkey//2)*10+l_linenumber AS BIGINT) AS member FROM lineitem WHERE l_quantity>=8), sp AS (SELECT grp, min(member) AS lo, max(member) AS hi, count(DISTINCT member) AS n FROM g GROUP BY grp), s AS (SELECT member AS a, lo AS b FROM g JOIN sp USING (grp) UNION SELECT lo, member FROM g JOIN sp USING (grp)), r(node, reach) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.reach=s.a), c AS (SELECT node, min(reach) AS component FROM r GROUP BY node), v AS (SELECT DISTINCT component FROM g JOIN sp USING (grp) JOIN c ON c.node=g.member WHERE hi-lo+1<>n) SELECT node AS member, component FROM c WHERE component NOT IN (SELECT component FROM v) AND EXISTS (SELECT 1 FROM s WHERE s.a=c.node AND s.b<>c.node)"
)
def merge_sets(spark, sf):
    """Line items of orders, two orders on one stretch of numbers: sets of consecutive numbers merge, others veto."""
    rows = T.table(spark, sf, "lineitem").where("l_quantity >= 8")
    member = (F.floor(F.col("l_orderkey") / 2) * 10 + F.col("l_linenumber")).cast("long")
    return intervals.merge_sets(rows.select(F.col("l_orderkey").alias("grp"), member.alias("member")))


@query("SELECT user_id, name, CAST(coalesce(d,0) AS BIGINT) AS gap, coalesce(d,0)>=3 AS wide FROM (SELECT user_id, event_id AS name, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events)")
def coverage_gaps(spark, sf):
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = T.table(spark, sf, "events").withColumn("d", F.col("event_id") - before)
    return rows.select("user_id", F.col("event_id").alias("name"), F.coalesce("d", F.lit(0)).cast("long").alias("gap"), (F.coalesce("d", F.lit(0)) >= 3).alias("wide"))


@query("SELECT sample, locus, kmer_idx, round(value/depth,8) AS value FROM geno JOIN depth USING (sample)")
def depth_normalize(spark, sf):
    return predict.depth_normalize(T.geno(spark, sf), T.depth(spark, sf)).select("sample", "locus", "kmer_idx", F.round("value", 8).alias("value"))


BIAS = "(SELECT sample, locus, level/avg(level) OVER (PARTITION BY locus) AS bias FROM (SELECT sample, locus, avg(value/ikmc) AS level FROM geno JOIN inv USING (locus, kmer_idx) GROUP BY ALL))"


@query(f"SELECT sample, locus, round(bias,8) AS bias FROM {BIAS}")
def bias_matrix(spark, sf):
    return predict.bias_matrix(T.geno(spark, sf), T.invariant(spark, sf)).withColumn("bias", F.round("bias", 8))


@query(f"SELECT sample, locus, kmer_idx, round(value/coalesce(bias,1.0),10) AS value FROM geno LEFT JOIN {BIAS} USING (sample, locus)")
def bias_correct(spark, sf):
    return predict.bias_correct(T.geno(spark, sf), T.invariant(spark, sf)).select("sample", "locus", "kmer_idx", F.round("value", 10).alias("value"))


@query(
    "SELECT s.sample, s.locus, s.total, NOT (s.total BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1)) AS outlier FROM (SELECT sample, locus, sum(value) AS total FROM geno GROUP BY ALL) s JOIN (SELECT locus, quantile_cont(total,0.25) AS q1, quantile_cont(total,0.75) AS q3 FROM (SELECT sample, locus, sum(value) AS total FROM geno GROUP BY ALL) GROUP BY locus) q USING (locus)"
)
def iqr_outliers(spark, sf):
    total = T.geno(spark, sf).groupBy("sample", "locus").agg(F.sum("value").alias("total"))
    return predict.iqr_outliers(total, "total", "locus").select("sample", "locus", "total", "outlier")


DEPTHS = "(SELECT CAST(l_suppkey AS BIGINT) AS sample, CAST(l_partkey%97 AS BIGINT) AS region, CAST(100+l_partkey%97 AS DOUBLE) AS size, avg(l_quantity) AS depth FROM lineitem GROUP BY ALL)"


@query(
    f"WITH d AS (SELECT * FROM {DEPTHS}), c AS (SELECT sample, sum(depth*size)/sum(size) AS cov FROM d GROUP BY sample), r AS (SELECT region, avg(depth/cov) AS mean, stddev_pop(depth/cov) AS sd FROM d JOIN c USING (sample) GROUP BY region), b AS (SELECT quantile_cont(mean,0.25) AS m1, quantile_cont(mean,0.75) AS m3, quantile_cont(sd,0.25) AS s1, quantile_cont(sd,0.75) AS s3 FROM r), k AS (SELECT region FROM r, b WHERE mean BETWEEN m1-1.5*(m3-m1) AND m3+1.5*(m3-m1) AND sd BETWEEN s1-1.5*(s3-s1) AND s3+1.5*(s3-s1)) SELECT sample, round(sum(depth*size)/sum(size),8) AS coverage, count(*) AS regions FROM d JOIN k USING (region) GROUP BY sample"
)
def control_coverage(spark, sf):
    region = F.col("l_partkey") % 97
    depths = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("sample"), region.cast("long").alias("region"), (region + 100).cast("double").alias("size")).agg(F.avg("l_quantity").alias("depth"))
    return predict.control_coverage(depths).withColumn("coverage", F.round("coverage", 8))


TOTALS = "(SELECT sample, locus, sum(value) AS kms, depth FROM geno JOIN depth USING (sample) GROUP BY ALL)"


def _totals(spark, sf):
    return T.geno(spark, sf).groupBy("sample", "locus").agg(F.sum("value").alias("kms")).join(T.depth(spark, sf), "sample")


@query(f"SELECT sample, locus, round(CASE WHEN est>=1 THEN est+20 ELSE est*21 END,8) AS length FROM (SELECT sample, locus, kms/(depth*1.1) AS est FROM {TOTALS})")
def length_predict(spark, sf):
    return _totals(spark, sf).select("sample", "locus", F.round(predict.predicted_length(F.col("kms"), F.col("depth"), F.lit(1.1).cast("double"), READ_K), 8).alias("length"))


@query(f"SELECT sample, locus, round(kms/(greatest(p_size+30-21+1,0)*depth),8) AS bias FROM {TOTALS} JOIN (SELECT p_partkey AS locus, p_size FROM part) USING (locus)")
def loo_bias(spark, sf):
    sizes = T.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("locus"), (F.col("p_size") + 30).alias("size"))
    return _totals(spark, sf).join(sizes, "locus").select("sample", "locus", F.round(predict.loo_bias(F.col("kms"), F.col("size"), F.col("depth"), READ_K), 8).alias("bias"))


@query(f"SELECT sample, round(avg(abs(kms-m)/m),8) AS mape FROM (SELECT sample, kms, avg(kms) OVER (PARTITION BY locus) AS m FROM {TOTALS}) GROUP BY sample")
def mape(spark, sf):
    rows = _totals(spark, sf).withColumn("m", F.avg("kms").over(Window.partitionBy("locus")))
    return rows.groupBy("sample").agg(F.round(F.avg(F.abs(F.col("kms") - F.col("m")) / F.col("m")), 8).alias("mape"))


@query("SELECT l_partkey AS locus, round(sum(l_quantity*l_extendedprice)/sum(l_quantity*l_quantity),6) AS slope, round(pow(sum(l_quantity*l_extendedprice),2)/(sum(l_quantity*l_quantity)*sum(l_extendedprice*l_extendedprice)),6) AS r2, round(sum(l_extendedprice)/(sum(l_quantity*l_extendedprice)/sum(l_quantity*l_quantity)),4) AS predicted FROM lineitem GROUP BY l_partkey")
def ols_origin(spark, sf):
    rows = T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("locus"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return predict.ols_origin(rows, "locus").select("locus", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), F.round("predicted", 4).alias("predicted"))


TESTED = "(SELECT CAST(l_partkey AS BIGINT) AS locus, CAST(l_suppkey%7 AS BIGINT) AS gene, count(*) AS n, corr(l_quantity, l_discount) AS r, stddev_pop(l_quantity) AS sx, stddev_pop(l_discount) AS sy FROM lineitem GROUP BY ALL)"


def _tests(spark, sf):
    rows = T.table(spark, sf, "lineitem").select(F.col("l_partkey").cast("long").alias("locus"), (F.col("l_suppkey") % 7).cast("long").alias("gene"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return predict.simple_regression(rows, "locus", "gene")


@query(f"SELECT locus, gene, n, round(r,6) AS slope, round(sqrt((1-r*r)/(n-2)),6) AS se FROM {TESTED} WHERE n>2 AND sx>0 AND sy>0 AND abs(r)<1-1e-9")
def eqtl_slope(spark, sf):
    return _tests(spark, sf).select("locus", "gene", "n", F.round("slope", 6).alias("slope"), F.round("se", 6).alias("se"))


# the share of the area of cos^(n - 3) beyond the angle of t, by Simpson's rule at 401 points each
ANGLES = f"(SELECT locus, gene, n, atan(abs(r)/sqrt(1-r*r)) AS angle FROM {TESTED} WHERE n>2 AND sx>0 AND sy>0 AND abs(r)<1-1e-9)"
RULE = "CASE WHEN i IN (0, 400) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END"
AREAS = f"(SELECT locus, gene, any_value(angle) AS angle, sum({RULE}*pow(greatest(cos(angle*i/400.0),0), n-3))*any_value(angle) AS below, sum({RULE}*pow(greatest(cos(angle+(pi()/2-angle)*i/400.0),0), n-3))*(pi()/2-any_value(angle)) AS beyond FROM {ANGLES}, unnest(range(0, 401)) AS u(i) GROUP BY locus, gene)"


@query(f"SELECT gene, arg_min(locus, (p, locus)) AS locus, count(*) AS tests, round(least(min(p)*count(*), 1.0), 6) AS p FROM (SELECT gene, locus, round(beyond/(below+beyond), 9) AS p FROM {AREAS}) GROUP BY gene")
def best_tr_per_gene(spark, sf):
    tests = predict.p_values(_tests(spark, sf)).withColumn("p", F.round("p", 9))
    return predict.best_per_gene(tests).withColumn("p", F.round("p", 6))


@query("WITH t AS (SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS i, (l_extendedprice-900.0)/110000.0 AS p FROM lineitem), r AS (SELECT *, p*count(*) OVER ()/count(*) OVER (ORDER BY p) AS raw FROM t) SELECT o, i, round(least(min(raw) OVER (ORDER BY p DESC),1.0),8) AS q FROM r")
def bh_fdr(spark, sf):
    """Prices on a scale of 0 to 1 taken for p-values."""
    rows = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("i"), ((F.col("l_extendedprice") - 900.0) / 110000.0).alias("p"))
    return predict.bh_fdr(rows).select("o", "i", F.round("q", 8).alias("q"))


@query(f"WITH d AS (SELECT * FROM {DEPTHS} WHERE depth>0), x AS (SELECT a.sample, b.sample AS other, avg(abs(1-a.depth/b.depth)) AS dist FROM d a JOIN d b ON a.region=b.region AND a.sample<>b.sample GROUP BY ALL) SELECT sample, arg_min(other, dist) AS nearest, round(min(dist),8) AS distance FROM x GROUP BY sample")
def nearest_sample(spark, sf):
    region = F.col("l_partkey") % 97
    rows = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("sample"), region.cast("long").alias("region")).agg(F.avg("l_quantity").alias("value"))
    return predict.nearest_sample(rows).withColumn("distance", F.round("distance", 8))


@query("SELECT CAST(p_partkey AS BIGINT) AS locus, CAST(s_suppkey AS BIGINT) AS gene, count(*) AS n FROM part JOIN lineitem ON l_partkey=p_partkey JOIN supplier ON s_suppkey=l_suppkey GROUP BY ALL")
def tr_gene_pairs(spark, sf):
    g = T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    rows = g.join(T.table(spark, sf, "part").select("p_partkey"), "p_partkey").join(T.table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey")
    return rows.groupBy(F.col("p_partkey").cast("long").alias("locus"), F.col("s_suppkey").cast("long").alias("gene")).agg(F.count("*").alias("n"))


def _haplotypes(spark, sf):
    rows = T.seqs(spark, sf).where("length(seq) >= 400")
    return rows.select(F.floor(F.col("locus") / 2).alias("locus"), F.concat_ws("-", "hap", F.col("locus").cast("string")).alias("hap"), "seq", F.lit(150).cast("long").alias("start"), (F.length("seq") - 150).cast("long").alias("end"))


FLANK, MOST, ROUNDS = 100, 300, 8  # rounds that the SQL has; bounds 150 bases from the ends cannot move oftener without failing


def _expansion(grow: bool) -> str:
    """The rounds of an expansion written out, up to ``b{ROUNDS}`` and the check of flanks after it."""
    k, n = READ_K, ROUNDS
    hit = f"(pos>=s-{FLANK} AND pos<s), (pos>e-{k} AND pos<=e+{FLANK}-{k})"
    lo, hi = hit.split(", ")
    steps = [f"hs AS (SELECT locus//2 AS locus, hap||'-'||locus AS hap, seq, CAST(length(seq) AS BIGINT) AS len FROM seqs WHERE length(seq)>=400)"]
    steps += [f"hw AS MATERIALIZED (SELECT locus, hap, pos, {ca('kmer')} AS kmer, pos>=150 AND pos<=len-150-{k} AS inside FROM ({T._windows('hs', k, 'locus, hap, len')}) WHERE NOT contains(kmer,'N'))"]
    steps += ["fw AS MATERIALIZED (SELECT locus, hap, pos, kmer FROM hw WHERE NOT inside)", "k0 AS MATERIALIZED (SELECT DISTINCT locus, kmer FROM hw WHERE inside)", "b0 AS (SELECT locus, hap, len, CAST(150 AS BIGINT) AS s, len-150 AS e, true AS ok FROM hs)"]
    for i in range(n + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT locus, hap, len, s, e, ok AND s>={FLANK} AND e+{FLANK}<=len AS ok FROM b{i})")
        if i == n:
            break
        known = f"k{i if grow else 0}"
        steps.append(f"m{i} AS MATERIALIZED (SELECT a.locus, a.hap, a.s, a.e, min(pos) FILTER {lo.replace('(', '(WHERE ', 1)} AS low, max(pos) FILTER {hi.replace('(', '(WHERE ', 1)} AS high FROM a{i} a JOIN fw w ON w.locus=a.locus AND w.hap=a.hap JOIN {known} x ON x.locus=w.locus AND x.kmer=w.kmer WHERE a.ok AND ({lo} OR {hi}) GROUP BY ALL)")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT locus, hap, len, s, e, ok AND 150-s<={MOST} AND e-(len-150)<={MOST} AS ok FROM (SELECT a.locus, a.hap, a.len, coalesce(m.low, a.s) AS s, coalesce(m.high+{k}, a.e) AS e, a.ok FROM a{i} a LEFT JOIN m{i} m ON m.locus=a.locus AND m.hap=a.hap))")
        if grow:
            steps.append(f"k{i + 1} AS MATERIALIZED (SELECT locus, kmer FROM k{i} UNION SELECT w.locus, w.kmer FROM fw w JOIN m{i} m ON m.locus=w.locus AND m.hap=w.hap WHERE (pos>=low AND pos<s) OR (pos>e-{k} AND pos<=high))")
    return "WITH " + ", ".join(steps)


@query(f"{_expansion(True)} SELECT locus, hap, s AS start, e AS \"end\", ok FROM a{ROUNDS}")
def boundary_expand(spark, sf):
    return boundary.expand(materialize(_haplotypes(spark, sf), "haplotypes"), READ_K, FLANK, MOST)


@query(f"{_expansion(False)} SELECT locus, hap, s AS start, e AS \"end\", ok FROM a{ROUNDS}")
def boundary_expand_ref_guided(spark, sf):
    return boundary.expand(materialize(_haplotypes(spark, sf), "haplotypes"), READ_K, FLANK, MOST, grow=False)


@query(f"{_expansion(True)} SELECT locus, present, failed, expanded, (NOT expanded OR ((present-failed)/2>=0.1 AND failed<2)) AND present>=1.6 AS kept FROM (SELECT locus, count(*) AS present, count(*) FILTER (NOT ok) AS failed, bool_or(s<>150 OR e<>len-150) AS expanded FROM a{ROUNDS} GROUP BY locus)")
def boundary_retention(spark, sf):
    """Which pairs of neighbouring sequences stay loci after their bounds have moved."""
    before = materialize(_haplotypes(spark, sf), "haplotypes")
    return boundary.retained(before, boundary.expand(before, READ_K, FLANK, MOST), 2)


def _ends(edges, k, canonical):
    """Distinct ``(locus, kmer)`` of the nodes that ``edges(locus, edge)``, (k+1)-mers as numbers, lead from and to."""
    both = edges.select("locus", F.explode(F.array(F.shiftright("edge", 2), F.col("edge").bitwiseAND((1 << 2 * k) - 1))).alias("kmer"))
    return (both.withColumn("kmer", F.least("kmer", S.revcomp_code(F.col("kmer"), k))) if canonical else both).distinct()


def _shared(spark, sf, canonical):
    """``(kmer)``: k-mers that more than one locus has; at most 4^11, about four million, or half of that if canonical, however many sequences there are."""
    seen = kmers.tally(T.seqs(spark, sf), T.K, T.loci(spark, sf), canonical=canonical).groupBy("kmer").agg(F.count("*").alias("n"))
    return materialize(seen.where("n > 1").select("kmer"), "shared")


def _novel(spark, sf):
    """Directed 12-mers that one locus alone has, and those of their 11-mers that other loci have too. A 12-mer is of one locus at most, so both tables have a bound."""
    rows = kmers.tally(T.seqs(spark, sf), T.K + 1, T.loci(spark, sf), canonical=False).withColumnRenamed("kmer", "edge")
    rows = materialize(kmers.alone(rows, "edge").where("locus is not null"), "novel")
    nodes = _ends(rows, T.K, False).join(_shared(spark, sf, False), "kmer", "left_semi")
    return rows.withColumn("edge", S.decode(F.col("edge"), T.K + 1)), nodes.select("locus", S.decode(F.col("kmer"), T.K).alias("kmer"))


DIRECTED = f"(SELECT locus, kmer AS edge, count(*) AS cnt FROM ({T._windows('seqs', T.K + 1, 'locus')}) WHERE NOT contains(kmer,'N') GROUP BY ALL)"


@query(
    f"WITH RECURSIVE de AS (SELECT * FROM {DIRECTED}), alone AS (SELECT edge FROM de GROUP BY edge HAVING count(*)=1), common AS (SELECT kmer FROM (SELECT DISTINCT locus, kmer FROM km) GROUP BY kmer HAVING count(*)>1), e AS (SELECT locus, substr(edge,1,{T.K}) AS a, substr(edge,2) AS b, cnt, substr(edge,1,{T.K}) IN (SELECT kmer FROM common) AS starts, substr(edge,2) IN (SELECT kmer FROM common) AS ends FROM de WHERE edge IN (SELECT edge FROM alone) AND substr(edge,1,{T.K})<>substr(edge,2)), r(locus, root, node) AS (SELECT DISTINCT locus, a, a FROM e WHERE starts UNION SELECT r.locus, r.root, e.b FROM r JOIN e ON r.locus=e.locus AND r.node=e.a WHERE NOT e.ends), w AS (SELECT r.locus, r.root, e.a, e.b, e.cnt, e.ends FROM r JOIN e ON r.locus=e.locus AND r.node=e.a), g(locus, root, node) AS (SELECT DISTINCT locus, root, b FROM w WHERE ends UNION SELECT g.locus, g.root, w.a FROM g JOIN w ON w.locus=g.locus AND w.root=g.root AND w.b=g.node), s AS (SELECT locus, root, count(*) AS nodes FROM r GROUP BY ALL), f AS (SELECT w.locus, w.root, count(*) AS reached, count(g.node) AS alive, avg(CASE WHEN g.node IS NOT NULL THEN w.cnt END) AS mean, stddev_pop(CASE WHEN g.node IS NOT NULL THEN w.cnt END) AS sd FROM w LEFT JOIN g ON g.locus=w.locus AND g.root=w.root AND g.node=w.b GROUP BY ALL) SELECT f.locus, f.root, reached, alive, nodes, round(coalesce(mean,0),6) AS mean, round(coalesce(sd,0),6) AS sd FROM f JOIN s USING (locus, root)"
)
def bubble_roots(spark, sf):
    return loci.bubbles(*_novel(spark, sf)).withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


EDGE = "(SELECT e.locus, e.edge, e.cnt, x.n=1 AS novel FROM edges e JOIN (SELECT edge, count(*) AS n FROM edges GROUP BY edge) x USING (edge))"


@query(f"SELECT e.locus, e.edge, e.cnt FROM {EDGE} e JOIN (SELECT locus, coalesce(CASE WHEN min(cnt) FILTER (NOT novel)-max(cnt) FILTER (novel)>3 THEN greatest(1, max(cnt) FILTER (novel)) ELSE greatest(1, min(cnt) FILTER (NOT novel)-2) END,1) AS th FROM {EDGE} GROUP BY locus) t USING (locus) WHERE novel AND cnt>th")
def bubble_edge_filter(spark, sf):
    """Novel edges seen oftener than a threshold between the counts of known and of novel edges of their locus."""
    rows = T.coded_edges(spark, sf)
    novel = materialize(kmers.alone(rows, "edge"), "novel")  # read twice
    # what is not novel in a locus, by count: all its edges without the novel ones
    all_, new = (x.groupBy("locus", "cnt").agg(F.count("*").alias("n")) for x in (rows, novel))
    both = all_.select("*", F.lit(0).cast("long").alias("new")).unionByName(new.select("locus", "cnt", F.lit(0).cast("long").alias("n"), F.col("n").alias("new")))
    both = both.groupBy("locus", "cnt").agg(F.sum("n").alias("n"), F.sum("new").alias("new"))
    th = both.groupBy("locus").agg(F.min(F.when(F.col("n") > F.col("new"), F.col("cnt"))).alias("low"), F.max(F.when(F.col("new") > 0, F.col("cnt"))).alias("high"))
    cut = F.when(F.col("low") - F.col("high") > 3, F.greatest(F.lit(1), F.col("high"))).when(F.col("low").isNotNull(), F.greatest(F.lit(1), F.col("low") - 2))
    th = th.select("locus", F.coalesce(cut, F.lit(1)).alias("th"))
    return novel.join(th, "locus").where("cnt > th").select("locus", S.decode(F.col("edge"), T.K + 1).alias("edge"), "cnt")


ROOT_LEAST = 2
BUBBLES = f"""
WITH RECURSIVE tr AS (SELECT DISTINCT locus, kmer FROM counts WHERE kmer IN (SELECT kmer FROM counts GROUP BY kmer HAVING count(*)>1)),
trn AS MATERIALIZED (SELECT locus, kmer AS node FROM tr UNION SELECT locus, {T.rc('kmer')} FROM tr),
fl AS (SELECT DISTINCT locus, kmer FROM km WHERE pos<{T.INNER} OR pos>len-{T.INNER}-{T.K}),
fln AS MATERIALIZED (SELECT locus, kmer AS node FROM fl UNION SELECT locus, {T.rc('kmer')} FROM fl),
alone AS (SELECT locus, edge, cnt FROM edges WHERE edge IN (SELECT edge FROM edges GROUP BY edge HAVING count(*)=1)),
de AS MATERIALIZED (SELECT locus, edge, substr(edge,1,{T.K}) AS a, substr(edge,2) AS b, cnt, EXISTS (SELECT 1 FROM trn t WHERE t.locus=d.locus AND t.node=substr(edge,1,{T.K})) AS starts, EXISTS (SELECT 1 FROM trn t WHERE t.locus=d.locus AND t.node=substr(edge,2)) AS ends, EXISTS (SELECT 1 FROM fln t WHERE t.locus=d.locus AND t.node=substr(edge,2)) AS lost FROM (SELECT locus, edge, cnt FROM alone UNION SELECT locus, {T.rc('edge')}, cnt FROM alone) d WHERE substr(edge,1,{T.K})<>substr(edge,2)),
al(locus, node) AS (SELECT DISTINCT locus, a FROM de WHERE ends UNION SELECT de.locus, de.a FROM al JOIN de ON de.locus=al.locus AND de.b=al.node AND NOT de.ends AND NOT de.lost),
sound AS MATERIALIZED (SELECT * FROM de WHERE ends OR (NOT lost AND EXISTS (SELECT 1 FROM al WHERE al.locus=de.locus AND al.node=de.b))),
roots AS MATERIALIZED (SELECT * FROM sound WHERE starts AND cnt>={ROOT_LEAST}),
re(locus, root, edge, b, stops) AS (SELECT locus, edge, edge, b, ends FROM roots UNION SELECT re.locus, re.root, g.edge, g.b, g.ends FROM re JOIN sound g ON NOT re.stops AND g.locus=re.locus AND g.a=re.b),
leaving AS (SELECT *, EXISTS (SELECT 1 FROM roots r WHERE r.locus=de.locus AND r.edge=de.edge) AS alive FROM de WHERE starts)
"""


def _entropy(k: int) -> str:
    words = f"list_transform(range(1, length(r.edge)-{k}+2), lambda i: least(substr(r.edge,i,{k}), reverse(translate(substr(r.edge,i,{k}),'ACGT','TGCA'))))"
    return f"round(-list_sum(list_transform(map_values(list_histogram({words})), lambda n: n/length(r.edge)*log2(n/length(r.edge)))),6) AS h{k}"


def _bubbles(spark, sf):
    """Edges that one locus alone has, as novel ones; its k-mers that others have too are its repeat, those near its ends its flank.

    Of repeat and flank only nodes of novel edges are asked for. Each novel edge and each k-mer that is not shared is of one
    locus, so tables after the first counts are bounded by the number of k-mers, not by the sequences.
    """
    alone = materialize(kmers.alone(T.coded_edges(spark, sf), "edge"), "novel")
    shared = F.broadcast(_shared(spark, sf, True))
    near = lambda found, k: kmers.counted_windows(kmers.near_ends(found, k, T.INNER), k)
    flank = kmers.distinct_in_rows(T.seqs(spark, sf), ["locus"], T.K, "n long", near).select("locus", "kmer").join(shared, "kmer", "left_anti")
    repeat = _ends(alone, T.K, True).join(shared, "kmer", "left_semi")
    return bubbles.Bubbles(alone, repeat, flank, T.K, ROOT_LEAST)


def _root_counts(spark, sf, found):
    """``(locus, kmer, cnt)`` of the nodes that root edges leave."""
    asked = found.roots.select("locus", F.least("a", S.revcomp_code(F.col("a"), T.K)).alias("kmer")).distinct()
    return kmers.tally(T.seqs(spark, sf), T.K, T.loci(spark, sf)).join(materialize(asked, "root-nodes"), ["locus", "kmer"], "left_semi")


def _rounded(rows, *names):
    return rows.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in names})


ROOTS = BUBBLES + f"""SELECT r.locus, r.edge, c.cnt AS c_root, r.cnt AS c_nv_e, c.cnt-n.novel AS c_ex_e, n.c_tm_e, round(r.cnt/c.cnt,6) AS r_nve_r, round(CASE WHEN c.cnt-n.novel+1<>0 THEN r.cnt/(c.cnt-n.novel+1) END,6) AS r_nve_exe, n.n_snrl, n.n_tm_e, s.n_bb_e, {", ".join(_entropy(k) for k in (1, 2, 3))}
FROM roots r JOIN (SELECT locus, a, CAST(sum(cnt) AS BIGINT) AS novel, CAST(coalesce(sum(cnt) FILTER (NOT alive),0) AS BIGINT) AS c_tm_e, count(*) FILTER (alive) AS n_snrl, count(*) FILTER (NOT alive) AS n_tm_e FROM leaving GROUP BY ALL) n ON n.locus=r.locus AND n.a=r.a
JOIN (SELECT locus, root, count(*) AS n_bb_e FROM re GROUP BY ALL) s ON s.locus=r.locus AND s.root=r.edge JOIN counts c ON c.locus=r.locus AND c.kmer={ca('r.a')}"""


@query(ROOTS.strip())
def bubble_root_features(spark, sf):
    """Features of root edges whose bubble comes back to the repeat."""
    found = _bubbles(spark, sf)
    return _rounded(found.root_features(_root_counts(spark, sf, found)), "r_nve_r", "r_nve_exe", "h1", "h2", "h3")


PATHS = BUBBLES + f"""SELECT r.locus, r.edge, s.bbs, round(s.mcov,6) AS mcov, round(s.scov,6) AS scov, coalesce(d.fcmax,0) AS fcmax, round(s.mcov-coalesce(d.fcmax,0),6) AS cdiff, coalesce(g.n3gp,0) AS n3gp, coalesce(g.n4gp,0) AS n4gp,
  EXISTS (SELECT 1 FROM re x WHERE x.locus=r.locus AND x.edge={T.rc('r.edge')}) AS bdir
FROM roots r JOIN (SELECT re.locus, root, count(*) AS bbs, avg(cnt) AS mcov, stddev_pop(cnt) AS scov FROM re JOIN de ON de.locus=re.locus AND de.edge=re.edge GROUP BY ALL) s ON s.locus=r.locus AND s.root=r.edge
LEFT JOIN (SELECT locus, max(cnt) AS fcmax FROM leaving WHERE NOT alive GROUP BY ALL) d ON d.locus=r.locus
LEFT JOIN (SELECT re.locus, root, count(*) FILTER (abs(p.cnt-c.cnt)>=3) AS n3gp, count(*) FILTER (abs(p.cnt-c.cnt)>=4) AS n4gp FROM re JOIN sound p ON p.locus=re.locus AND p.edge=re.edge JOIN sound c ON NOT p.ends AND c.locus=p.locus AND c.a=p.b GROUP BY ALL) g ON g.locus=r.locus AND g.root=r.edge"""


@query(PATHS.strip())
def bubble_path_features(spark, sf):
    """What the alive edges behind each root edge have in common, and how their counts change from edge to edge."""
    return _rounded(_bubbles(spark, sf).path_features(), "mcov", "scov", "cdiff")


WEIGHTS = {"c_nv_e": 0.5, "r_nve_r": -1.0, "n_bb_e": 0.0625, "h2": 0.25}
BIAS = -2.5


@query(BUBBLES.strip() + f"""
SELECT DISTINCT locus, edge FROM (SELECT re.locus, unnest([re.edge, {T.rc('re.edge')}]) AS edge FROM re JOIN (SELECT locus, edge AS root FROM (
{ROOTS.removeprefix(BUBBLES)}) WHERE {" + ".join(f"{w}*{c}" for c, w in WEIGHTS.items())} + ({BIAS}) > 0) x ON x.locus=re.locus AND x.root=re.root)""")
def bubble_calls(spark, sf):
    """Edges of both strands behind root edges that a scorer takes."""
    found = _bubbles(spark, sf)
    features = _rounded(found.root_features(_root_counts(spark, sf, found)), "r_nve_r", "h2")
    registry = scorers.Registry()
    registry.add("roots", scorers.Scorer(scorers.Linear(list(WEIGHTS.values()), BIAS), list(WEIGHTS)))
    return found.called(registry.score(features, "roots").where("score > 0"))


SPENT = "(SELECT CAST(l_partkey AS BIGINT) AS gene, CAST(l_suppkey AS BIGINT) AS sample, sum(l_quantity) AS y FROM lineitem GROUP BY ALL)"


@query(f"SELECT gene, sample, round(y-(regr_intercept(y, depth) OVER w + regr_slope(y, depth) OVER w*depth),6)+0 AS residual FROM {SPENT} JOIN depth USING (sample) WINDOW w AS (PARTITION BY gene) QUALIFY count(*) OVER w > 2 AND stddev_pop(depth) OVER w > 0.001")
def residualize_expression(spark, sf):
    """Quantities of each part by supplier, with the depth taken out; parts of at least three suppliers of different depth."""
    rows = T.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("gene"), F.col("l_suppkey").cast("long").alias("sample")).agg(F.sum("l_quantity").alias("y"))
    depth = T.depth(spark, sf)
    fit = rows.join(depth, "sample").groupBy("gene").agg(F.count("*").alias("n"), F.stddev_pop("depth").alias("sd")).where("n > 2 and sd > 0.001")
    out = predict.residualize(rows.join(fit.select("gene"), "gene", "left_semi"), depth, ["depth"])
    return out.withColumn("residual", F.round("residual", 6) + F.lit(0.0))


@query("SELECT sample, locus, round(CASE WHEN locus<1000 THEN value/depth/2 WHEN locus<1500 THEN value/depth/(1+sample%2) ELSE value/depth END,8) AS value FROM (SELECT sample, locus, sum(value) AS value, depth FROM geno JOIN depth USING (sample) GROUP BY ALL)")
def ploidy_correct(spark, sf):
    ratio = F.col("kms") / F.col("depth")
    value = predict.ploidy_correct(ratio, F.col("locus"), 1 + F.col("sample") % 2, 1000, 1500)
    return _totals(spark, sf).select("sample", "locus", F.round(value, 8).alias("value"))


@query(f"WITH m AS ({MERGED}), p AS (SELECT m.chrom, m.start, m.\"end\", b.start AS s, b.\"end\" AS e FROM m JOIN iw b ON b.chrom=m.chrom AND b.start<m.\"end\" AND m.start<b.\"end\"), g AS (SELECT *, coalesce(s-max(e) OVER (PARTITION BY chrom, start ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS gap FROM p) SELECT chrom, start, \"end\", max(gap) AS gap, count(*) AS support FROM g GROUP BY chrom, start, \"end\" HAVING max(gap)<=90 AND count(*)>=2")
def merged_locus_qc(spark, sf):
    parts = T.wider(spark, sf).select("chrom", "start", "end")
    merged = intervals.merge(T.wider(spark, sf), 100).select("chrom", "start", "end")
    return intervals.merge_quality(merged, parts, 90, 2)


FAR = 2.5  # deviations; of a few dozen rows none is 10 away
_FITTED = f"SELECT *, bool_and(near) OVER (PARTITION BY locus) AS calm FROM (SELECT *, abs(res-avg(res) OVER w)<{FAR}*stddev_pop(res) OVER w AS near FROM (SELECT *, y-x*(sum(x*y) OVER w0/sum(x*x) OVER w0) AS res FROM rec WINDOW w0 AS (PARTITION BY locus, r)) WINDOW w AS (PARTITION BY locus, r))"
OUTLIERS = f"WITH RECURSIVE base AS (SELECT l_partkey AS locus, l_quantity AS x, CASE WHEN l_orderkey%17=3 THEN 0 WHEN l_orderkey%23=5 THEN NULL WHEN l_orderkey%41=7 THEN l_extendedprice*9 ELSE l_extendedprice END AS y FROM lineitem), rec AS (SELECT 0 AS r, locus, x, y FROM base WHERE y IS NOT NULL AND y<>0 UNION ALL SELECT r+1, locus, x, y FROM ({_FITTED}) WHERE near AND NOT calm), last AS (SELECT locus, max(r) AS r FROM rec GROUP BY locus)"


@query(f"{OUTLIERS} SELECT b.locus, b.n AS rows, z.n AS sound, s.n-coalesce(k.n,0) AS rejected, round(k.total,4) AS total FROM (SELECT locus, count(*) AS n FROM base GROUP BY ALL) b LEFT JOIN (SELECT locus, count(*) AS n FROM base WHERE y IS NOT NULL GROUP BY ALL) z USING (locus) LEFT JOIN (SELECT locus, count(*) AS n FROM rec WHERE r=0 GROUP BY ALL) s USING (locus) LEFT JOIN (SELECT locus, count(*) AS n, sum(y) AS total FROM ({_FITTED.replace('FROM rec', 'FROM (SELECT rec.* FROM rec JOIN last USING (locus, r)) rec')}) WHERE calm GROUP BY ALL) k USING (locus)")
def outlier_rejection(spark, sf):
    """Prices by quantity, some of them zero, missing or nine times too high: rows that are left by each rule, and the sum of those that the last leaves."""
    item, order = T.table(spark, sf, "lineitem"), F.col("l_orderkey")
    y = F.when(order % 17 == 3, 0.0).when(order % 23 == 5, None).when(order % 41 == 7, F.col("l_extendedprice") * 9).otherwise(F.col("l_extendedprice"))
    rows = materialize(item.select(F.col("l_partkey").alias("locus"), F.col("l_quantity").alias("x"), y.alias("y")), "outlier-rows")
    sound, _ = predict.reject_outliers(rows, "locus", rule=0)
    left, rejected = predict.reject_outliers(rows, "locus", rule=2, far=FAR)
    out = rows.groupBy("locus").agg(F.count("*").alias("rows")).join(sound.groupBy("locus").agg(F.count("*").alias("sound")), "locus", "left").join(rejected, "locus", "left")
    return out.join(left.groupBy("locus").agg(F.round(F.sum("y"), 4).alias("total")), "locus", "left")
