"""Half-open intervals ``(chrom, start, end, ...)``: overlaps, merges, gaps, lifts, merge sets, boundary expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatlake.operators.components import connected_components
from repeatlake.operators.kmers import ranges
from repeatlake.plans.storage import materialize


def binned(rows: DataFrame, width: int, name: str) -> DataFrame:
    """Rows once for each bin of ``width`` that they touch, so that overlaps become an equi join."""
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width))
    return rows.withColumn(name, F.explode(bins))


def overlaps(left: DataFrame, right: DataFrame, width: int = 10_000) -> DataFrame:
    """Pairs that overlap, each once: found in the bin where the later of the two starts lies. Right columns get the prefix ``r_``."""
    a = binned(left, width, "bin")
    b = binned(right, width, "bin")
    b = b.select(*(F.col(c).alias(f"r_{c}") for c in b.columns))
    hit = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    first = F.floor(F.greatest("start", "r_start") / width) == F.col("bin")
    return a.join(b, (F.col("chrom") == F.col("r_chrom")) & (F.col("bin") == F.col("r_bin")) & hit & first).drop("bin", "r_bin", "r_chrom")


def _mapped(left: DataFrame, right: DataFrame, width: int, value) -> DataFrame:
    """``left`` with an aggregate over the rows of ``right`` that overlap each; rows of ``left`` are told apart by all their columns, equal ones together."""
    mine = left.columns
    found = overlaps(left.distinct(), right, width).groupBy(*mine).agg(value.alias("mapped"))
    same = found.select(*(F.col(c).alias(f"of_{c}") for c in mine), "mapped")
    on = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in mine]
    return left.join(same, on, "left").select(*mine, "mapped")


def map_count(left: DataFrame, right: DataFrame, width: int = 10_000) -> DataFrame:
    """``left`` with the number of ``right`` intervals that overlap each; names need not differ."""
    return _mapped(left, right, width, F.count("*")).withColumn("n", F.coalesce("mapped", F.lit(0))).drop("mapped")


def map_collapse(left: DataFrame, right: DataFrame, width: int = 10_000) -> DataFrame:
    """``left`` with the sorted distinct names of the overlapping ``right`` intervals, ``.`` if none."""
    names = F.array_join(F.array_sort(F.collect_set(F.col("r_name"))), ",")
    return _mapped(left, right, width, names).withColumn("hits", F.coalesce("mapped", F.lit("."))).drop("mapped")


def _cut(rows: DataFrame, key: str, column: str, aim: int, *totals: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the ``range`` that ``column`` falls into, and a row of ``totals`` for each ``(key, range)``, written once."""
    cut = materialize(rows.withColumn("range", ranges(rows, column, aim)), "interval-ranges")
    return cut, materialize(cut.groupBy(F.col(key).alias("of"), F.col("range").alias("at")).agg(*totals), "interval-totals")


def _carried(cut: DataFrame, base: DataFrame, key: str) -> DataFrame:
    return cut.join(base, F.col(key).eqNullSafe(F.col("of")) & (F.col("range") == F.col("at"))).drop("of", "at")


def merge(rows: DataFrame, gap: int = 0, aim: int = 100_000) -> DataFrame:
    """Runs of intervals that start at most ``gap`` after the furthest end before them: ``(chrom, start, end, n)``.

    Intervals are worked on by ranges of starts; a range is given the furthest
    end of the ranges before it, and the number of runs that begin in them, so a chromosome is not one task.
    """
    cut, totals = _cut(rows.select("chrom", "start", "end"), "chrom", "start", aim, F.max("end").alias("last"))
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    cut = _carried(cut, totals.select("of", "at", F.max("last").over(before).alias("carried")), "chrom")
    order = Window.partitionBy("chrom", "range").orderBy("start", "end")
    reach = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    islands = cut.withColumn("new", F.coalesce((F.col("start") > reach + gap).cast("int"), F.lit(1)))
    islands = materialize(islands.withColumn("own", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("carried"), "interval-islands")
    begun = islands.groupBy(F.col("chrom").alias("of"), F.col("range").alias("at")).agg(F.sum("new").alias("begun"))
    numbered = _carried(islands, begun.select("of", "at", F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("base")), "chrom").withColumn("island", F.col("base") + F.col("own"))
    return numbered.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def slop(rows: DataFrame, flank: int) -> DataFrame:
    return rows.withColumn("start", F.greatest(F.col("start") - flank, F.lit(0))).withColumn("end", F.col("end") + flank)


def gaps(rows: DataFrame, aim: int = 100_000) -> DataFrame:
    """The distance from each interval's end to the next one's start on its chromosome; the last of a range of starts looks at the first of the next range."""
    cut, totals = _cut(rows, "chrom", "start", aim, F.min("start").alias("first"))
    cut = _carried(cut, totals.select("of", "at", F.lead("first").over(Window.partitionBy("of").orderBy("at")).alias("later")), "chrom")
    after = F.lead("start").over(Window.partitionBy("chrom", "range").orderBy("start", "end", "name"))
    return cut.withColumn("gap", F.coalesce(after, F.col("later")) - F.col("end")).select(*rows.columns, "gap")


def fetch(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Regions ``(name, chrom, start, end)`` with their upper-case bases from ``contigs(chrom, seq)``; outside or reversed ones are left out."""
    ok = (F.col("start") >= 0) & (F.col("start") < F.col("end"))
    both = regions.where(ok).join(contigs, "chrom")
    return both.select("name", "chrom", "start", "end", F.upper(F.substring("seq", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).alias("bases"))


def majority_chromosome(alignments: DataFrame, share: float = 0.6) -> DataFrame:
    """``(contig, chrom, n, total)`` of contigs most of whose alignments, at least ``share``, lie on one chromosome."""
    n = alignments.groupBy("contig", "chrom").agg(F.count("*").alias("n"))
    best = n.groupBy("contig").agg(F.max_by(F.struct("chrom", "n"), F.struct(F.col("n"), F.col("chrom"))).alias("b"), F.sum("n").alias("total"))
    return best.select("contig", "b.chrom", "b.n", "total").where(F.col("n") >= share * F.col("total"))


def lift_clean(parts: DataFrame, gap: int = 10_000) -> DataFrame:
    """One interval for each region of ``(name, contig, start, end, strand)`` lifted in parts.

    Parts on one contig that overlap or follow each other with less than
    ``gap`` become one; a region on several contigs, or with a wider gap, is
    invalid and left out. The strand is 0 where parts disagree.
    """
    order = Window.partitionBy("name").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = parts.withColumn("jump", F.coalesce(F.col("start") - reach, F.lit(0)))
    one = rows.groupBy("name").agg(
        F.countDistinct("contig").alias("contigs"), F.min("contig").alias("contig"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.max("jump").alias("jump"), F.min("strand").alias("low"), F.max("strand").alias("high"), F.count("*").alias("parts"),
    )
    strand = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0)
    return one.where((F.col("contigs") == 1) & (F.col("jump") < gap)).select("name", "contig", "start", "end", strand.cast("long").alias("strand"), "parts")


def union_find(pairs: DataFrame, sightings: int = 5) -> DataFrame:
    """``(node, component)`` over pairs ``(a, b)`` seen at least ``sightings`` times; the smallest id names a component."""
    seen = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    return connected_components(seen.where(F.col("n") >= sightings))


def merge_sets(groups: DataFrame) -> DataFrame:
    """``(member, component)`` of groups ``(grp, member)`` of neighbouring loci, merged where they share members.

    A group whose members are not consecutive vetoes everything it is connected to.
    """
    span = groups.groupBy("grp").agg(F.min("member").alias("lo"), F.max("member").alias("hi"), F.countDistinct("member").alias("n"))
    bad = span.where(F.col("hi") - F.col("lo") + 1 != F.col("n")).select("grp")
    edges = groups.join(span.select("grp", "lo"), "grp").select(F.col("member").alias("a"), F.col("lo").alias("b"))
    found = connected_components(edges)
    vetoed = groups.join(bad, "grp", "left_semi").join(found, F.col("member") == F.col("node")).select("component").distinct()
    return found.join(vetoed, "component", "left_anti").select(F.col("node").alias("member"), "component")


def ortho_map(rows: DataFrame, aim: int = 100_000) -> DataFrame:
    """``(locus, hap, ord)``: the running number of each present locus within its haplotype, null where absent. ``rows``: ``(locus, hap, present)``; counted by ranges of loci."""
    cut, totals = _cut(rows.select("locus", "hap", "present"), "hap", "locus", aim, F.count_if("present").alias("many"))
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cut = _carried(cut, totals.select("of", "at", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base")), "hap")
    own = F.sum(F.col("present").cast("long")).over(Window.partitionBy("hap", "range").orderBy("locus").rowsBetween(Window.unboundedPreceding, 0))
    return cut.select("locus", "hap", F.when(F.col("present"), F.col("base") + own - 1).alias("ord"))


def merge_quality(merged: DataFrame, parts: DataFrame, most_gap: int, least: int) -> DataFrame:
    """Merged intervals of ``merged`` that at least ``least`` of ``parts(chrom, start, end)`` support without a gap over ``most_gap``."""
    inside = overlaps(merged.withColumn("name", F.concat_ws(":", "chrom", "start")), parts.withColumn("name", F.lit("")), 10_000)
    order = Window.partitionBy("name").orderBy("r_start", "r_end")
    reach = F.max("r_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = inside.withColumn("gap", F.coalesce(F.col("r_start") - reach, F.lit(0)))
    out = gap.groupBy("chrom", "start", "end").agg(F.max("gap").alias("gap"), F.count("*").alias("support"))
    return out.where((F.col("gap") <= most_gap) & (F.col("support") >= least))


def in_box(x, y, box: tuple[float, float, float, float]):
    """Whether a point lies in the half-open box ``(x from, x to, y from, y to)``."""
    return (x >= box[0]) & (x < box[1]) & (y >= box[2]) & (y < box[3])


def upper_bound(cuts: list[float], value):
    """How many of the sorted ``cuts`` are at most ``value``: the place of the first that is greater."""
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= value)).cast("long")


def merge_excess(parts: DataFrame, most: float = 5.0, good: float = 0.5) -> DataFrame:
    """``(merged, parts, excess, verdict)`` of ``parts(merged, start, end)``: by how much the merged locus is longer than the loci in it."""
    rows = parts.groupBy("merged").agg(F.sum(F.col("end") - F.col("start")).alias("parts"), (F.max("end") - F.min("start")).alias("span"))
    excess = (F.col("span") - F.col("parts")) / F.col("parts")
    return rows.select("merged", "parts", excess.alias("excess"), F.when(excess > most, "reject").when(excess < good, "good").otherwise("fair").alias("verdict"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """``(merged, hap, chrom, start, end)`` of ``parts(merged, hap, chrom, start, end, strand)``: a haplotype's parts as one interval, null where they are on several contigs or strands. A single part stays as it is."""
    one = (F.count_distinct("chrom") == 1) & (F.count_distinct("strand") == 1)
    rows = parts.groupBy("merged", "hap").agg(one.alias("one"), F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"))
    return rows.select("merged", "hap", *(F.when(F.col("one"), F.col(c)).alias(c) for c in ("chrom", "start", "end")))
