"""Queries over files that are written to the shared folder and read back, and over what the other plans leave out; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repeatlake.functions import sequence as S
from repeatlake.operators import intervals, kmers
from repeatlake.plans import tables as T
from repeatlake.plans.sequences import CODE
from repeatlake.plans.storage import temporary
from repeatlake.plans.tables import K, ca
from repeatlake.sources import formats, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = T.sql(sql)
        return f

    return add


def _place(spark, name: str) -> str:
    return f"{temporary(spark, name)}/{name}"


def _code(of: str) -> str:
    return CODE.replace("kmer", of)


@query("SELECT title, seq1 AS seq, repeat('I', length(seq1)) AS qual FROM sim")
def fastq_roundtrip(spark, sf):
    """First mates written as FASTQ and read back in splits."""
    place = _place(spark, "fastq")
    formats.write_fastq(T.sim(spark, sf).select("title", F.col("seq1").alias("seq"), F.repeat(F.lit("I"), F.length("seq1")).alias("qual")), place)
    return formats.fastq_records(spark, place).select("title", "seq", "qual")


BAITED = "SELECT locus, kmer, min(n) AS mi, max(n) AS ma FROM (SELECT locus, kmer, pos//64 AS part, count(*) AS n FROM sets GROUP BY ALL) GROUP BY ALL"


@query(f"SELECT locus, {CODE} AS kmer, mi, ma FROM ({BAITED})".replace(f"range(1,{K}+1)", f"range(1,{T.READ_K}+1)"))
def bait_text_roundtrip(spark, sf):
    """Least and greatest counts of k-mers in stretches of 64 starts, written as bait text and read back."""
    place = _place(spark, "bait")

    def parted(seqs):
        rows = kmers.codes(seqs.withColumn("length", F.length("seq")), ["locus", "length"], T.READ_K)
        rows = rows.where(kmers.region(F.col("pos"), F.col("length"), T.READ_K, T.INNER, T.OUTER).isNotNull())
        n = rows.groupBy("locus", "kmer", F.floor(F.col("pos") / 64).alias("part")).agg(F.count("*").alias("n"))
        return n.groupBy("locus", "kmer").agg(F.min("n").alias("mi"), F.max("n").alias("ma"))

    formats.write_kmer_blocks(T.seqs(spark, sf), T.READ_K, place, ["mi", "ma"], T.stretches_of_regions(64), parted, T.loci(spark, sf))
    return formats.kmer_rows(spark, place, ["mi", "ma"])


@query(f"SELECT locus, {_code('kmer')} AS kmer, cnt FROM counts WHERE cnt>=3")
def kmer_text_roundtrip(spark, sf):
    """k-mers with at least three counts, written as text and read back."""
    place = _place(spark, "kmers")
    formats.write_kmer_blocks(T.seqs(spark, sf), K, place, ["cnt"], kmers.counted_windows, lambda x: kmers.tally(x, K), T.loci(spark, sf), least=3)
    return formats.kmer_rows(spark, place, ["cnt"])


@query(f"SELECT locus, {_code('edge')} AS edge, cnt FROM edges".replace(f"range(1,{K}+1)", f"range(1,{K + 1}+1)"))
def bubble_text_roundtrip(spark, sf):
    """Directed edges of both strands in a text, added up by canonical edge when read."""
    place = _place(spark, "bubbles")
    formats.write_kmer_blocks(T.seqs(spark, sf), K + 1, place, ["cnt"], kmers.counted_windows, lambda x: kmers.tally(x, K + 1, canonical=False), T.loci(spark, sf), canonical=False)
    return formats.bubble_counts(spark, place, K + 1)


@query("SELECT row_number() OVER (ORDER BY doc_id)-1 AS locus, n_chars>=500 AS ok FROM documents")
def qc_mask_roundtrip(spark, sf):
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("locus"), (F.col("n_chars") >= 500).alias("ok"))
    ranked = d.join(kmers.rank_present(d.select("locus")), "locus").select(F.col("ordinal").alias("locus"), "ok")
    place = _place(spark, "mask")
    formats.write_qc_mask(ranked, place)
    return formats.qc_mask(spark, place)


COUNTED = "SELECT CAST(l_suppkey AS BIGINT) AS sample, CAST(l_partkey AS BIGINT) AS kmer_idx, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY ALL"


@query(f"SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY kmer_idx)-1 AS kmer_idx, value, depth FROM ({COUNTED}) JOIN depth USING (sample)")
def genotype_list_roundtrip(spark, sf):
    """A binary file of counts for each sample and a list of files and depths, read back by the list."""
    from repeatlake.sources.files import binary_counts

    place = _place(spark, "genotypes")
    rows = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("sample"), F.col("l_partkey").cast("long").alias("kmer_idx")).agg(F.sum("l_quantity").cast("long").alias("value"))
    listed = formats.write_binary_counts(rows, f"{place}/files").join(T.depth(spark, sf), "sample").select("file", "depth")
    listed.write.option("sep", "\t").csv(f"{place}/list")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    files = binary_counts(spark, f"{place}/files").withColumn("name", name("file")).drop("file")
    depths = formats.genotype_list(spark, f"{place}/list").select(name("file").alias("name"), "depth")
    return files.join(depths, "name").select(F.split("name", "\\.")[0].cast("long").alias("sample"), "kmer_idx", "value", "depth")


PARTS = "(SELECT CAST(p_partkey AS BIGINT) AS p, row_number() OVER (ORDER BY p_partkey)-1 AS locus, CAST(p_size AS BIGINT) AS nk FROM part)"


@query(f"SELECT locus, nk, i AS kmer_idx, CASE WHEN i IS NOT NULL THEN 1 + (nk+i)%5 END AS ikmc FROM {PARTS} LEFT JOIN (SELECT CAST(t.i AS BIGINT) AS i FROM unnest(range(0, 3)) AS t(i)) ON nk>10 AND i<nk%4")
def invariant_meta_roundtrip(spark, sf):
    """Parts as loci of p_size k-mers, of which those over ten have up to three invariant ones."""
    p = T.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p"), F.col("p_size").cast("long").alias("nk"))
    meta = p.join(kmers.rank_present(p.select(F.col("p").alias("locus"))).withColumnRenamed("locus", "p"), "p").select(F.col("ordinal").alias("locus"), "nk")
    some = meta.where("nk > 10 and nk % 4 > 0").select("locus", "nk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nk") % 4 - 1)).alias("kmer_idx"))
    place = f"{_place(spark, 'invariant')}/kmers.ikm.meta"
    formats.write_invariant(meta, some.select("locus", "kmer_idx", (1 + (F.col("nk") + F.col("kmer_idx")) % 5).alias("ikmc")), place)
    return formats.invariant_meta(spark, place)


@query("SELECT row, col, CAST(CAST(sum(l_quantity) AS FLOAT) AS DOUBLE) AS value FROM (SELECT CAST(l_partkey AS BIGINT) AS row, CAST(l_linenumber-1 AS BIGINT) AS col, l_quantity FROM lineitem) GROUP BY ALL")
def matrix_roundtrip(spark, sf):
    """Quantities by part and line number, in files of bands of rows, column by column."""
    cells = T.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("row"), (F.col("l_linenumber") - 1).cast("long").alias("col")).agg(F.sum("l_quantity").alias("value"))
    place = _place(spark, "matrix")
    formats.write_matrix(cells, place, 7)
    return formats.matrix(spark, place)


@query("SELECT i<5 AS control, CASE WHEN i<5 THEN i ELSE i-5 END AS ord, acctbal AS value FROM (SELECT row_number() OVER (ORDER BY c_custkey)-1 AS i, c_acctbal AS acctbal FROM customer)")
def control_table_roundtrip(spark, sf):
    """Customers in the order of their keys as a table of five control regions and then loci."""
    place = _place(spark, "lsb")
    T.table(spark, sf, "customer").orderBy("c_custkey").coalesce(1).select(F.concat_ws("\t", F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string")).alias("value")).write.text(place)
    return formats.control_and_loci(spark, place, 5)


@query("SELECT locus, kmer, CAST(CASE WHEN flo>thi THEN -flo WHEN fhi<tlo THEN fhi ELSE 0 END AS BIGINT) AS threshold FROM (SELECT locus, kmer, min(cnt) FILTER (even) AS tlo, max(cnt) FILTER (even) AS thi, min(cnt) FILTER (NOT even) AS flo, max(cnt) FILTER (NOT even) AS fhi FROM (SELECT hap AS locus, kmer, cnt, locus%2=0 AS even FROM counts JOIN (SELECT locus, hap FROM seqs) USING (locus)) GROUP BY ALL) WHERE tlo IS NOT NULL AND flo IS NOT NULL")
def bait_signed_threshold(spark, sf):
    """Counts in sequences of even ids taken for true, in those of odd ids for false; one signed number for both ranges."""
    rows = kmers.tally(T.seqs(spark, sf), K, T.loci(spark, sf), "hap")
    even = F.col("locus") % 2 == 0
    side = lambda f, which, name: f(F.when(which, F.col("cnt"))).alias(name)
    both = rows.groupBy(F.col("hap").alias("h"), "kmer").agg(side(F.min, even, "tlo"), side(F.max, even, "thi"), side(F.min, ~even, "flo"), side(F.max, ~even, "fhi"))
    both = both.where("tlo is not null and flo is not null")
    threshold = formats.signed_threshold(F.col("tlo"), F.col("thi"), F.col("flo"), F.col("fhi")).cast("long")
    return both.select(F.col("h").alias("locus"), S.decode(F.col("kmer"), K).alias("kmer"), threshold.alias("threshold"))


@query(f"SELECT locus, pos, {_code('kmer')} AS raw, {_code('ca')} AS canonical FROM (SELECT locus, pos, kmer, {ca('kmer')} AS ca FROM km)")
def raw_and_canonical(spark, sf):
    return kmers.raw_and_canonical(T.seqs(spark, sf), ["locus"], K)


@query("SELECT DISTINCT locus, kmer FROM counts WHERE kmer IN (SELECT kmer FROM km WHERE genome='src1' UNION SELECT reverse(translate(kmer,'ACGT','TGCA')) FROM km WHERE genome='src1')")
def kmers_of_assembly(spark, sf):
    """k-mers of each locus that one genome has as well."""
    rows = kmers.tally(T.seqs(spark, sf), K, T.loci(spark, sf), "genome")
    one = rows.where("genome = 'src1'").select("kmer").distinct()
    # at most 4^11 / 2 k-mers, about two million, however many sequences there are; a locus may be of several genomes
    found = kmers.tally(T.seqs(spark, sf), K, T.loci(spark, sf)).join(F.broadcast(one), "kmer", "left_semi")
    return found.select("locus", S.decode(F.col("kmer"), K).alias("kmer"))


@query("SELECT o_orderkey AS name, l.n, l.l_extendedprice>=20000 AND l.l_extendedprice<60000 AND l.l_quantity>=10 AND l.l_quantity<30 AS inside, (SELECT count(*) FROM (VALUES (1.0),(5.0),(10.0),(25.0),(40.0)) v(b) WHERE b<=l.l_quantity) AS upper FROM (SELECT l_orderkey AS o_orderkey, CAST(l_linenumber AS BIGINT) AS n, l_extendedprice, l_quantity FROM lineitem) l")
def region_and_upper_bound(spark, sf):
    x, y = F.col("l_extendedprice"), F.col("l_quantity")
    inside, upper = intervals.in_box(x, y, (20000, 60000, 10, 30)), intervals.upper_bound([1.0, 5.0, 10.0, 25.0, 40.0], y)
    return T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").cast("long").alias("n"), inside.alias("inside"), upper.alias("upper"))


@query("SELECT conv_id AS title, string_agg(text, '' ORDER BY turn) AS seq FROM conversations GROUP BY conv_id HAVING length(string_agg(text, ''))>=300")
def masked_fasta_merge(spark, sf):
    """Conversations as records, their turns as lines."""
    lines = T.table(spark, sf, "conversations").select(F.col("conv_id").alias("title"), F.col("turn").alias("line"), "text")
    return kmers.joined_lines(lines, 300)


@query("SELECT genome, locus//2 AS locus, bool_or(length(seq)>=400) AS present FROM seqs GROUP BY ALL")
def genome_presence(spark, sf):
    """Whether a genome has a locus on either haplotype; two neighbouring documents are one locus."""
    return kmers.presence(T.seqs(spark, sf).select("genome", F.floor(F.col("locus") / 2).alias("locus"), "seq"), 400)


def _parts(spark, sf):
    """Line items as loci that are to be merged by order."""
    g = T.table(spark, sf, "lineitem")
    start = F.col("l_partkey") * 20
    return g.select(F.col("l_orderkey").cast("long").alias("merged"), start.cast("double").alias("start"), (start + 200 + F.col("l_linenumber")).cast("double").alias("end"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS merged, CAST(sum(size) AS BIGINT) AS parts, (max(e)-min(s)-sum(size))/sum(size) AS excess, CASE WHEN (max(e)-min(s)-sum(size))/sum(size)>5 THEN 'reject' WHEN (max(e)-min(s)-sum(size))/sum(size)<0.5 THEN 'good' ELSE 'fair' END AS verdict FROM (SELECT l_orderkey, CAST(l_partkey*20 AS DOUBLE) AS s, CAST(l_partkey*20+200+l_linenumber AS DOUBLE) AS e, CAST(200+l_linenumber AS DOUBLE) AS size FROM lineitem) GROUP BY l_orderkey")
def merge_qc(spark, sf):
    """By how much a merged locus is longer than the loci in it: over five times is rejected, under a half is good."""
    return intervals.merge_excess(_parts(spark, sf)).withColumn("parts", F.col("parts").cast("long"))


@query("SELECT o AS merged, hap, CASE WHEN ok THEN contig END AS contig, CASE WHEN ok THEN s END AS start, CASE WHEN ok THEN e END AS \"end\" FROM (SELECT l_orderkey//4 AS o, l_suppkey%3 AS hap, min(l_returnflag) AS contig, min(l_partkey*50) AS s, max(l_partkey*50+200) AS e, count(DISTINCT l_returnflag)=1 AND count(DISTINCT l_linestatus)=1 AS ok FROM lineitem GROUP BY ALL)")
def merged_beds(spark, sf):
    """The merged interval of each haplotype; null where contigs or strands differ."""
    start = F.col("l_partkey") * 50
    parts = T.table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("merged"), (F.col("l_suppkey") % 3).alias("hap"), F.col("l_returnflag").alias("chrom"), start.alias("start"), (start + 200).alias("end"), F.col("l_linestatus").alias("strand"))
    return intervals.merge_parts(parts).withColumnRenamed("chrom", "contig")


@query("SELECT locus, kmer, cnt AS n, row_number() OVER (PARTITION BY locus ORDER BY kmer)-1 AS pos FROM counts")
def zip_counts_with_index(spark, sf):
    """A file of bare counts and a file of k-mers, put together by their places in each locus."""
    place = _place(spark, "zip")
    for name, fields in (("counts", ["cnt"]), ("index", [])):
        formats.write_kmer_blocks(T.seqs(spark, sf), K, f"{place}/{name}", fields, kmers.counted_windows, lambda x: kmers.tally(x, K), T.loci(spark, sf), named=name == "index")
    both = formats.zipped(spark, f"{place}/counts", f"{place}/index", ("n", "code"))
    return both.select("locus", S.decode(F.col("code"), K).alias("kmer"), "n", "pos")


LINE = 5000


@query(f"SELECT CAST(locus AS VARCHAR) AS chrom, w * {LINE} AS start, least((w + 1) * {LINE}, length(seq)) AS \"end\", substr(seq, w * {LINE} + 1, {LINE}) AS seq FROM seqs, unnest(range(0, greatest(1, (length(seq) + {LINE - 1}) // {LINE}))) AS t(w)")
def fasta_windows(spark, sf):
    """Sequences written as FASTA with an index, and read back by windows of bytes."""
    place = _place(spark, "fasta")
    stored.write_fasta(T.seqs(spark, sf).select(F.col("locus").cast("string").alias("title"), "seq"), place)
    return stored.fasta_windows(spark, place, LINE)


@query(f"SELECT CAST(locus AS VARCHAR) AS chrom, length(seq)//3 AS start, length(seq)//3 + 40 AS \"end\", CASE WHEN length(seq)//3 + 40 <= length(seq) THEN substr(seq, length(seq)//3 + 1, 40) ELSE '' END AS seq FROM seqs WHERE locus % 10 = 3 AND length(seq) > 0")
def fasta_regions(spark, sf):
    """Forty bases of every tenth sequence by their offsets; a region beyond its sequence's end is empty. The regions are a stated list."""
    place = _place(spark, "fasta")
    rows = T.seqs(spark, sf).select(F.col("locus").cast("string").alias("title"), "seq")
    stored.write_fasta(rows, place)
    asked = rows.where("title % 10 = 3 and length(seq) > 0").select("title", F.floor(F.length("seq") / 3).alias("at")).collect()
    return stored.fasta_windows(spark, place, regions=[f"{r['title']}:{r['at']}-{r['at'] + 40}" for r in asked])


def _dense(spark, sf):
    """k-mer counts of loci numbered densely from 0, and how many there are."""
    rows = kmers.tally(T.seqs(spark, sf), K, T.loci(spark, sf))
    return rows, T.table(spark, sf, "documents").agg(F.max("doc_id")).first()[0] + 1


@query(f"SELECT locus, {_code('kmer')} AS kmer, least(cnt, 65535) AS value FROM counts")
def kmer_map_binary_roundtrip(spark, sf):
    """Counts by locus in a folder of binary maps of 16 bits a count, written and read in ranges."""
    (rows, loci), place = _dense(spark, sf), _place(spark, "kmdb")
    stored.write_kmer_set(rows.withColumn("cnt", F.least("cnt", F.lit(65535))), place, loci, 4, "cnt")
    return stored.kmer_set(spark, place)


@query(f"SELECT locus, {_code('kmer')} AS kmer FROM counts WHERE locus BETWEEN 20 AND 39 OR locus % 50 = 0")
def kmer_set_of_loci(spark, sf):
    """A binary set in one file, of which the bytes of some loci are read."""
    (rows, loci), place = _dense(spark, sf), f"{_place(spark, 'kdb')}.kdb"
    stored.write_kmer_set(rows, place, loci)
    return stored.kmer_set(spark, place, ["20-39", *range(0, loci, 50)])


@query(f"SELECT {_code('kmer')} AS kmer, list(locus::INTEGER ORDER BY locus) AS loci FROM counts GROUP BY kmer")
def kmer_index_binary_roundtrip(spark, sf):
    """k-mers with the loci that hold them, in a folder of binary indexes."""
    rows = kmers.tally(T.seqs(spark, sf), K, T.loci(spark, sf)).select("kmer", "locus")
    place, letters = _place(spark, "dbi"), T.loci(spark, sf).agg(F.sum("n")).first()[0] or 0
    stored.write_kmer_index(rows, place, max(4, -(-letters // (1 << 21))))  # about as many rows a shard at most
    return stored.kmer_set(spark, place)


@query(f"SELECT count(DISTINCT locus) AS loci, count(*) AS kmers, CAST(0 AS BIGINT) AS differing FROM counts")
def kmer_set_validated(spark, sf):
    """What a binary map holds against the rows that it was written from: rows that only one of them has."""
    (rows, loci), place = _dense(spark, sf), f"{_place(spark, 'kmdb')}.kmdb"
    rows = rows.withColumn("cnt", F.least("cnt", F.lit(65535)))
    stored.write_kmer_set(rows, place, loci, value="cnt")
    back = stored.kmer_set(spark, place).select("locus", "kmer", F.col("value").alias("cnt"))
    both = back.select("*", F.lit(1).alias("w")).unionByName(rows.select("locus", "kmer", "cnt", F.lit(-1).alias("w")))
    odd = both.groupBy("locus", "kmer", "cnt").agg(F.sum("w").alias("w"), F.max("w").alias("there"))
    return odd.agg(F.count_distinct(F.when(F.col("there") == 1, F.col("locus"))).alias("loci"), F.count_if(F.col("there") == 1).alias("kmers"), F.count_if(F.col("w") != 0).alias("differing"))
