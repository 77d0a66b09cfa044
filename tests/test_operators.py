"""Hand-made cases for operators that SQL does not check, and for rules it does not show."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from repeatlake.functions import sequence as S
from repeatlake.operators import align, boundary, intervals, kmers, loci, predict
from repeatlake.operators.components import connected_components
from repeatlake.sources import files, formats


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_codes_round_trip(spark):
    words = ["ACGT", "TTTT", "AAAA", "GATC"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    out = df.select("w", S.encode(F.col("w")).alias("c")).withColumn("d", S.decode(F.col("c"), 4)).withColumn("r", S.revcomp_code(F.col("c"), 4))
    for w, c, d, r in out.collect():
        assert d == w and c == sum("ACGT".index(b) * 4 ** (3 - i) for i, b in enumerate(w))
        back = w[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert r == sum("ACGT".index(b) * 4 ** (3 - i) for i, b in enumerate(back))
    assert df.select(S.encode(F.lit("ACNT")).alias("c")).first()["c"] is None


def test_codes_of_whole_sequences(spark, small):
    from repeatlake.plans import sequences, tables

    path, _ = small
    want = set()
    for (seq,) in tables.seqs(spark, path).select("seq").collect():
        want |= {seq[i : i + tables.K] for i in range(len(seq) - tables.K + 1) if "N" not in seq[i : i + tables.K]}
    code = lambda w: int(w.translate(str.maketrans("ACGT", "0123")), 4)
    other = lambda w: w[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert rows(sequences.QUERIES["encode_kmers_all"](spark, path)) == sorted((w, code(w)) for w in want)
    assert rows(sequences.QUERIES["decode_kmers_all"](spark, path)) == sorted((code(w), w) for w in want)
    assert rows(sequences.QUERIES["revcomp_numeric_all"](spark, path)) == sorted((w, code(other(w))) for w in want)


def test_run_lengths_of_whole_sequences(spark, small):
    import itertools

    from repeatlake.plans import sequences, tables

    path, _ = small
    brute = lambda s: "".join(f"{len(list(g))}{c}" for c, g in itertools.groupby(s))
    want = {r["locus"]: brute(r["seq"]) for r in tables.seqs(spark, path).collect() if r["seq"]}
    assert dict(map(tuple, sequences.QUERIES["rle_annotation_all"](spark, path).collect())) == want
    df = spark.createDataFrame([(1, "A" * 70000 + "CCN"), (2, ""), (3, None)], "locus long, seq string")
    assert rows(kmers.run_lengths(df.where("locus < 3"))) == [(1, "70000A2C1N"), (2, "")]


def test_windows_are_case_sensitive_and_whole(spark):
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(1000))
    df = spark.createDataFrame([(1, seq), (2, "ACgTACGT"), (3, "AC")], "locus int, seq string")
    got = [(r["locus"], r["pos"], r["kmer"]) for r in kmers.scan(df, 5).collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, i, seq[i : i + 5]) for i in range(996)]
    assert sorted(x[2] for x in got if x[0] == 2) == ["TACGT"]
    assert not [x for x in got if x[0] == 3]


def test_graph_is_closed_under_strands(spark):
    df = spark.createDataFrame([(1, "ACGTTGCAAC")], "locus int, seq string")
    nodes = {r["kmer"]: r["out_mask"] for r in kmers.graph(df, 4).collect()}
    flip = lambda w: w[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert set(nodes) == {flip(w) for w in nodes}
    for w, mask in nodes.items():
        for i, b in enumerate("ACGT"):
            if mask >> i & 1:
                assert w[1:] + b in nodes


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    pairs = chain + star + [(1, 1), (None, 3), (5, 4), (4, 5)]
    got = dict(rows(connected_components(spark.createDataFrame(pairs, "a long, b long"))))
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{i: 7 for i in range(200, 260)}, 4: 4, 5: 4}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def fold_segment(states, least):
    """The segmentation as one pass over the states of a mate."""
    known = [(i, s) for i, s in enumerate(states) if s]
    if not known:
        return False, None, None
    turns = [(a, b) for a, b in zip(known, known[1:]) if a[1] != b[1]]
    bs, nt, n_tr = known[0][1], len(turns), states.count(2)
    if not (nt == 0 and bs == 2 or nt == 1 or nt == 2 and bs == 1 and n_tr >= least):
        return False, None, None
    edges = [(a[0] + 1 + b[0]) // 2 if b[0] - a[0] > 1 else b[0] for a, b in turns]
    si = 0 if bs == 2 else edges[0]
    ei = len(states) if nt == 0 or nt == 1 and bs == 1 else edges[0] if nt == 1 else edges[1]
    return True, si, ei


def test_segment_equals_a_fold(spark):
    r, data, want = random.Random(3), [], {}
    for k in range(150):
        s = [r.choice([0, 1, 2]) if r.random() < 0.1 else x for x in [r.choice([1, 2])] * r.randint(1, 15) + [r.choice([0, 2])] * r.randint(0, 20) + [r.choice([0, 1, 2])] * r.randint(0, 9)]
        data += [(f"t{k}", 1, 1, i, x) for i, x in enumerate(s)]
        want[f"t{k}"] = fold_segment(s, 5)
    got = align.segment(spark.createDataFrame(data, "title string, locus long, mate long, pos long, state long"), 5)
    assert {x["title"]: (x["kept"], x["si"], x["ei"]) for x in got.collect()} == want


def test_reads_come_home(spark):
    """Pairs of a locus whose k-mers are its own are assigned to it."""
    r = random.Random(5)
    seqs = spark.createDataFrame([(i, "".join(r.choice("ACGT") for _ in range(1500))) for i in range(6)], "locus long, seq string")
    pairs = align.simulate(seqs)
    index = kmers.scan(seqs, 21).select(S.canonical(F.col("kmer")).alias("kmer"), "locus").distinct()
    found = align.assign(align.locus_hits(align.multiplicity(align.pair_kmers(pairs, 21)), index), 10).collect()
    assert len(found) == pairs.count() and all(int(x["title"].split(":")[0]) == x["locus"] for x in found)


def expand_slowly(seqs, starts, ends, k, flank, most, grow=True):
    """New bounds of one locus in each haplotype, round by round; all haplotypes of a round see the same k-mers."""
    turn = str.maketrans("ACGT", "TGCA")
    words = [[min(w, w[::-1].translate(turn)) if set(w) <= set("ACGT") else None for w in (s[i : i + k] for i in range(len(s) - k + 1))] for s in seqs]
    bounds, alive = [[a, b] for a, b in zip(starts, ends)], [True] * len(seqs)
    known = {w for ws, (a, b) in zip(words, bounds) for w in ws[a : max(a, b - k + 1)] if w}
    while True:
        moves = {}
        for h, ws in enumerate(words):
            a, b = bounds[h]
            alive[h] = alive[h] and a - flank >= 0 and b + flank <= len(seqs[h])
            if alive[h]:
                low = [i for i in range(a - flank, a) if ws[i] in known]
                high = [i + k for i in range(b - k + 1, b + flank - k + 1) if ws[i] in known]
                if low or high:
                    moves[h] = min(low, default=a), max(high, default=b)
        if not moves:
            return [(a, b, ok) for (a, b), ok in zip(bounds, alive)]
        for h, (low, high) in moves.items():
            a, b = bounds[h]
            if grow:
                known.update(w for w in words[h][low:a] + words[h][b - k + 1 : high - k + 1] if w)
            bounds[h] = [low, high]
            alive[h] = starts[h] - low <= most and high - ends[h] <= most


@pytest.mark.parametrize("grow", [True, False])
def test_expansion(spark, grow):
    r = random.Random(7)
    rows = []
    for locus in range(12):
        unit, unit2 = ("".join(r.choice("ACGT") for _ in range(12)) for _ in range(2))
        for hap in range(3):
            left, right = ("".join(r.choice("ACGTN" if locus % 5 == 4 else "ACGT") for _ in range(r.randint(20, 160))) for _ in range(2))
            middle = unit2 * r.randint(0, 3) + unit * r.randint(4, 9) + unit2 * r.randint(0, 9)
            if r.random() < 0.3:
                middle = middle[::-1].translate(str.maketrans("ACGT", "TGCA"))
            seq = left + middle + right
            rows.append((locus, str(hap), seq, len(left) + r.randint(0, 20), len(left) + len(middle) - r.randint(0, 20)))
    df = spark.createDataFrame(rows, "locus long, hap string, seq string, start long, end long")
    got = {(x.locus, x.hap): (x.start, x.end, x.ok) for x in boundary.expand(df, 8, 30, 60, grow).collect()}
    want = {}
    for locus in range(12):
        own = [x for x in rows if x[0] == locus]
        for x, found in zip(own, expand_slowly([x[2] for x in own], [x[3] for x in own], [x[4] for x in own], 8, 30, 60, grow)):
            want[locus, x[1]] = found
    assert got == want and {ok for _, _, ok in want.values()} == {True, False}
    assert boundary.expand(df.limit(0), 8, 30, 60).count() == 0


def test_retention(spark):
    kind = "locus long, hap string, start long, end long"
    before = [(i, str(h), 10, 20) for i in range(5) for h in range(10) if not (i == 4 and h > 6)]
    moved = {(1, "0"): (5, 20, True), **{(2, str(h)): (5, 20, False) for h in range(10)}, **{(3, str(h)): (5, 20, h == 0) for h in range(10)}}
    after = [(i, h, *moved.get((i, h), (10, 20, True))) for i, h, _, _ in before]
    got = boundary.retained(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind + ", ok boolean"), 10)
    assert {x.locus: (x.present, x.failed, x.expanded, x.kept) for x in got.collect()} == {0: (10, 0, False, True), 1: (10, 0, True, True), 2: (10, 10, True, False), 3: (10, 9, True, True), 4: (7, 0, False, False)}


def test_bubbles_keep_what_returns():
    found = loci.bubbles_of([("AAC", 3), ("ACG", 5), ("AAT", 1), ("CGG", 7)], {"AA", "GG"})
    assert found == [("AA", 4, 3, 4, 5.0, (8 / 3) ** 0.5)]


def test_student_p():
    for t, n, want in ((2.0, 10, 0.07338803), (0.5, 3, 0.65145279), (12.0, 40, 7.65e-15), (0.0, 5, 1.0)):
        assert abs(predict.student_p(t, n) - want) < 1e-4 * max(want, 1e-3)


def test_map_counts_each_overlap_once(spark):
    r = random.Random(9)
    make = lambda n: [("c", s, s + r.randint(1, 900), i) for i, s in enumerate(r.sample(range(5000), n))]
    a, b = make(60), make(80)
    kind = "chrom string, start long, end long, name long"
    got = intervals.map_count(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), width=100)
    assert {x["name"]: x["n"] for x in got.collect()} == {i: sum(s < f and t < e for _, t, f, _ in b) for _, s, e, i in a}


def test_maps_of_equal_names(spark):
    kind = "chrom string, start long, end long, name string"
    a = spark.createDataFrame([("c", 0, 10, "x"), ("c", 5, 30, "x"), ("c", 50, 60, None), ("c", 5, 30, "x")], kind)
    b = spark.createDataFrame([("c", 8, 12, "p"), ("c", 28, 52, "q"), ("c", 9, 9, "z")], kind)
    assert rows(intervals.map_count(a, b, width=7).select("start", "n")) == [(0, 2), (5, 3), (5, 3), (50, 1)]
    assert rows(intervals.map_collapse(a, b, width=7).select("start", "hits")) == [(0, "p,z"), (5, "p,q,z"), (5, "p,q,z"), (50, "q")]


def test_merged_parts(spark):
    kind = "merged long, hap string, chrom string, start long, end long, strand string"
    parts = spark.createDataFrame([(1, "h", "c", 5, 9, "+"), (2, "h", "c", 5, 9, "+"), (2, "h", "c", 20, 30, "+"), (3, "h", "c", 1, 2, "+"), (3, "h", "d", 1, 2, "+"), (4, "h", "c", 1, 2, "+"), (4, "h", "c", 4, 5, "-")], kind)
    got = {r.merged: (r.chrom, r.start, r.end) for r in intervals.merge_parts(parts).collect()}
    assert got == {1: ("c", 5, 9), 2: ("c", 5, 30), 3: (None, None, None), 4: (None, None, None)}


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x p>q\nACG\r\nTT\n>\nG\n\n>y\nGG\n>empty\n")
    (tmp_path / "b.fa").write_text(">z\nA")
    got = rows(formats.fasta_records(spark, str(tmp_path / "*.fa")).select("ord", "title", "seq"))
    assert got == [(0, "x p>q", "ACGTT"), (0, "z", "A"), (1, "", "G"), (2, "y", "GG"), (3, "empty", "")] and files.count_records(spark, str(tmp_path / "a.fa")) == 4
    (tmp_path / "a.fq").write_text("@r1\nACGT\n+\nIIII\n@none\n\n+\n\n@r/1\r\nGGCC\r\n+r\r\n@@@@\r\n@r/2\nA\n+\nJ\n\n")
    assert rows(formats.fastq_records(spark, str(tmp_path / "a.fq")).select("title", "seq", "qual")) == [("none", "", ""), ("r/1", "GGCC", "@@@@"), ("r/2", "A", "J"), ("r1", "ACGT", "IIII")]
    assert rows(align.pair_mates(formats.fastq_records(spark, str(tmp_path / "a.fq")))) == [("r", "A", "GGCC")]
    for bad in ("@a\nAC\n+\nI\n", "a\nAC\n+\nII\n", "@a\nAC\nII\n+\n", "@a\nAC\n+\n"):
        (tmp_path / "bad.fq").write_text(bad)
        with pytest.raises(Exception):
            formats.fastq_records(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "k.txt").write_text(">5\n11\t2\n9\t1\n>8\n3\t4\n")
    assert rows(formats.kmer_rows(spark, str(tmp_path / "k.txt"), ["value"], by="order")) == [(0, 9, 1), (0, 11, 2), (1, 3, 4)]
    table = formats.kmer_rows(spark, str(tmp_path / "k.txt"), ["value"]).where("value >= 2")
    assert rows(table) == [(5, 11, 2), (8, 3, 4)]
    formats.write_kmer_rows(table, str(tmp_path / "out"), ["value"])
    assert "".join(r["value"] + "\n" for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()).split() == [">5", "11", "2", ">8", "3", "4"]
    (tmp_path / "o.tsv").write_text("0\t.\n1\t0\n")
    assert set(rows(formats.ortho_table(spark, str(tmp_path / "o.tsv")).fillna(-1))) == {(0, 0, 0), (0, 1, -1), (1, 0, 1), (1, 1, 0)}
    import numpy as np

    (tmp_path / "c.ar").write_bytes(np.array([2, 7, 9], "<u8").tobytes())
    assert rows(files.binary_counts(spark, str(tmp_path / "c.ar")).select("kmer_idx", "value")) == [(0, 7), (1, 9)]
    (tmp_path / "b.bed").write_text("chr1\t5\t9\nchr1\t1\t3\tn\n")
    assert rows(files.bed(spark, str(tmp_path / "b.bed"))) == [("chr1", 1, 3, "n"), ("chr1", 5, 9, "chr1:5-9")]


def test_mates_in_a_stream(spark, tmp_path):
    from repeatlake.streaming.mates import pair_stream

    kind = "title string, seq string, at timestamp"
    data = spark.createDataFrame([("a/1", "AC"), ("b/1", "GG"), ("a/2", "TT")], "title string, seq string").withColumn("at", F.to_timestamp(F.lit("2020-01-01 00:00:00")))
    data.write.parquet(str(tmp_path / "in"))
    stream = pair_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("mates").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert rows(spark.table("mates")) == [("a", "AC", "TT")]


@pytest.mark.parametrize("rule", range(4))
def test_outliers(spark, rule):
    """Each rule against a fit that is made anew until it rejects nothing."""
    import math

    import numpy as np

    r, data = random.Random(3), []
    for g in ("a", "b", None, "even", "calm"):
        for i in range(1 if g == "even" else 400):
            x = r.choice([0.0, 1.0, 2.0, 5.0])
            y = 3 * x + r.gauss(0, 1) + (10.0 ** r.randint(2, 4) if g in ("a", "b") and r.random() < 0.02 else 0)
            data.append((g, x, r.choice([y] * 30 + [float("nan"), None, 0.0])))
    data.append(("even", 2.0, 6.0))
    df = spark.createDataFrame(data, "g string, x double, y double").repartition(3)
    want, gone = [], {}
    for g in {g for g, _, _ in data}:
        own = [(x, y) for h, x, y in data if h == g and y is not None and math.isfinite(y) and (rule in (0, 3) or x != 0 and y != 0)]
        n = len(own)
        while rule > 1 and own:
            x, y = (np.array(v) for v in zip(*own))
            res = y - x * (x @ y) / (x @ x) if x @ x else y
            near = abs(res - res.mean()) < 10 * res.std()
            own = [o for o, k in zip(own, near) if k]
            if near.all():
                break
        want += [(g, *o) for o in own]
        if n:
            gone[g] = n - len(own)
    left, rejected = predict.reject_outliers(df, "g", rule=rule)
    key = lambda t: str(t)
    assert sorted(map(tuple, left.collect()), key=key) == sorted(want, key=key)
    assert {x.g: x.rejected for x in rejected.collect()} == gone and (rule < 2 or sum(gone.values()) > 1)


def test_places_of_values(spark):
    cuts = [1.0, 2.0, 2.5, 7.0]
    got = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.5, 6.9, 7.0, 99.0)], "x double").select("x", kmers.place_of(F.col("x"), cuts).alias("n")).collect()
    assert [r.n for r in got] == [sum(c <= r.x for c in cuts) for r in got]
    rows_ = spark.range(3_000).select((F.col("id") * 7919 % 3_001).alias("locus"), F.lit(0).alias("g"))
    at = kmers.ranges(rows_, "locus", aim=100)
    cut = rows_.select("locus", at.alias("r")).groupBy("r").agg(F.min("locus").alias("a"), F.max("locus").alias("b"), F.count("*").alias("n")).orderBy("r").collect()
    assert len(cut) > 20 and all(x.b < y.a for x, y in zip(cut, cut[1:])) and max(x.n for x in cut) < 200


def test_merge_and_gaps_over_many_ranges(spark):
    """Ranges far smaller than runs, runs that bridge several, ties; a null chromosome is one of its own."""
    r = random.Random(15)
    data = [(c, s, s + r.choice([1, 5, 40, 3000 if r.random() < 0.02 else 9]), str(i)) for i in range(1500) for c, s in [(r.choice(["a", "b", None]), r.randint(0, 20_000))]]
    df = spark.createDataFrame(data, "chrom string, start long, end long, name string").repartition(3)
    merged, nexts = [], {}
    for c in ("a", "b", None):
        own = sorted((s, e, n) for x, s, e, n in data if x == c)
        run = None
        for s, e, _ in own:
            if run and s <= run[2] + 7:
                run = (c, run[1], max(run[2], e), run[3] + 1)
            else:
                merged += [run] if run else []
                run = (c, s, e, 1)
        merged.append(run)
        nexts |= {n: (t[0] - e if t else None) for (s, e, n), t in zip(own, [*own[1:], None])}
    key = lambda t: str(t)
    assert sorted(map(tuple, intervals.merge(df, 7, aim=20).collect()), key=key) == sorted(merged, key=key)
    assert {x["name"]: x["gap"] for x in intervals.gaps(df, aim=20).collect()} == nexts


@pytest.mark.parametrize("k", [4, 11, 30])
def test_loci_of_one_row_are_grouped_where_they_are(spark, monkeypatch, k):
    """Loci of one row take no shuffle of k-mers; long ones and those of several rows, which do, give the same."""
    pick = random.Random(k)
    text = lambda n: "".join(pick.choices("ACGT", k=n // 9)) * 9 + pick.choice(["", "N", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"])
    one = [(i, text(pick.choice([0, 3, 40, 900]))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame([*one, (5, text(300)), (6, one[6][1]), (None, text(90)), (None, text(90))], "locus long, seq string")
    alone = spark.createDataFrame(one, "locus long, seq string")
    ways = {"count": lambda x: kmers.count(x, k), "graph": lambda x: kmers.graph(x, k), "entropy": lambda x: kmers.entropy(x, k).withColumn("entropy", F.round("entropy", 9))}
    small = {name: rows(way(alone)) for name, way in ways.items()}
    for name in ("count", "graph"):
        assert "Exchange hashpartitioning" not in ways[name](alone)._jdf.queryExecution().executedPlan().toString()
    key = lambda t: tuple((x is not None, x) for x in t)
    mixed = {name: sorted(map(tuple, way(df).collect()), key=key) for name, way in ways.items()}
    monkeypatch.setattr(kmers, "LONG", 0)
    assert {name: rows(way(alone)) for name, way in ways.items()} == small
    assert {name: sorted(map(tuple, way(df).collect()), key=key) for name, way in ways.items()} == mixed


def test_closure_lists_a_palindrome_once(spark):
    tables = spark.createDataFrame([(1, "ACGT", 2), (1, "AAAC", 1)], "locus long, kmer string, cnt long")
    assert rows(kmers.closure(tables)) == [(1, "AAAC"), (1, "ACGT"), (1, "GTTT")]


def test_blocks_of_whole_and_of_parted_loci(spark, tmp_path, monkeypatch):
    """Blocks written where their rows are hold what blocks of shuffled rows hold, also for loci of several rows."""
    pick = random.Random(3)
    seqs = [(i, "".join(pick.choices("ACGTN", [9, 9, 9, 9, 1], k=pick.choice([2, 60, 400])))) for i in range(30)] + [(4, "ACGTACGTAC" * 9)]
    df = spark.createDataFrame(seqs, "locus long, seq string")
    want = kmers.codes(df, ["locus"], 5, canonical=False).groupBy("locus", "kmer").agg(F.count("*").alias("cnt"))
    edge = F.least("kmer", S.revcomp_code(F.col("kmer"), 5)).alias("edge")
    counts = rows(want.groupBy("locus", edge).agg(F.sum("cnt").alias("cnt")).select("locus", "edge", "cnt"))
    parted = lambda x: kmers.tally(x, 5, canonical=False)
    for long in (kmers.LONG, 0):
        monkeypatch.setattr(kmers, "LONG", long)
        place = str(tmp_path / f"blocks{long}")
        formats.write_kmer_blocks(df, 5, place, ["cnt"], kmers.counted_windows, parted, canonical=False)
        assert rows(formats.kmer_rows(spark, place, ["cnt"])) == rows(want.select("locus", "kmer", "cnt"))
        assert rows(formats.bubble_counts(spark, place, 5)) == counts
        assert "Exchange" not in formats.bubble_counts(spark, place, 5)._jdf.queryExecution().executedPlan().toString()
    again = str(tmp_path / "again")
    spark.createDataFrame([(">7\n3\t1\n9\t2\n>8\n1\t1\n>7\n3\t4",)], "value string").write.text(again)
    assert sum(r[2] for r in rows(formats.bubble_counts(spark, again, 5)) if r[0] == 7) == 7 and len(rows(formats.bubble_counts(spark, again, 5))) == 3


def test_zipped_keeps_places(spark, tmp_path):
    for name, text in (("a", ">1\n5\n\n7\n>2\n1\n>3\n1"), ("b", ">2\n8\t0\n9\t0\n>1\n6\n4\n2")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(str(tmp_path / name))
    assert rows(formats.zipped(spark, str(tmp_path / "a"), str(tmp_path / "b"), ("n", "code"))) == [(1, 0, 5, 6), (1, 2, 7, 2), (2, 0, 1, 8)]


def test_expansion_of_short_loci_writes_no_windows(spark, monkeypatch):
    r = random.Random(3)
    unit, seqs = "".join(r.choice("ACGT") for _ in range(12)), []
    for n in (5, 7, 9):
        seqs.append("".join(r.choice("ACGT") for _ in range(90)) + unit * n + "".join(r.choice("ACGT") for _ in range(90)))
    rows = [(locus, f"h{hap}", seq, 95, len(seq) - 101) for locus in (1, 2, 3) for hap, seq in enumerate(seqs)] + [(2, "h0", seqs[1], 99, 120), (None, "h0", seqs[0], 95, 140)]
    df = spark.createDataFrame(rows, "locus long, hap string, seq string, start long, end long")
    written, write = [], boundary.materialize
    monkeypatch.setattr(boundary, "materialize", lambda table, tag: written.append(tag) or write(table, tag))
    plain = lambda table: sorted(map(str, table.select("locus", "hap", "start", "end", "ok").collect()))
    once = df.where("locus in (1, 3)")
    near = plain(boundary.expand(once, 8, 30, 60))
    assert written == []
    both = plain(boundary.expand(df, 8, 30, 60))
    assert "bound-windows" in written  # of locus 2, which has a haplotype twice, and of the row without a locus
    monkeypatch.setattr(kmers, "LONG", 0)
    assert plain(boundary.expand(once, 8, 30, 60)) == near and plain(boundary.expand(df, 8, 30, 60)) == both


def test_residuals_of_one_covariate_take_no_python_group(spark):
    r = random.Random(5)
    rows = [(gene, sample, r.uniform(0, 50) + 1e6 * (gene == 4)) for gene in range(6) for sample in range(1 + 3 * gene)]
    depth = {sample: 10 + r.random() if sample > 3 else 12.5 for sample in range(15)}
    got = predict.residualize(spark.createDataFrame(rows, "gene long, sample long, y double"), spark.createDataFrame(list(depth.items()), "sample long, depth double"), ["depth"])
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    left = {(x.gene, x.sample): x.residual for x in got.collect()}
    for gene in range(6):
        own = [(s, y) for g, s, y in rows if g == gene and s in depth]
        x, y = np.column_stack([np.ones(len(own)), [depth[s] for s, _ in own]]), np.array([y for _, y in own])
        want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose([left[gene, s] for s, _ in own], want, atol=1e-6)
    assert len(left) == sum(s in depth for _, s, _ in rows)
