"""Bounds of loci moved outwards over all haplotypes, as a fixpoint of joins over all loci at once.

k-mers of all haplotypes' repeats of a locus are one set. Where a k-mer of a
flank is in it, the bound moves out to the outermost such k-mer, and the k-mers that
it passes join the set; then all flanks are looked at again. Each round only
the k-mers that the round before added are joined with the windows of their locus; the
windows found once stay found, and a round picks those that lie in a flank as it is
then. All haplotypes of a round see the same set. A haplotype fails if a flank
leaves the sequence or a bound has moved by more than ``most``; it stays as it is then.

A locus whose haplotypes have at most ``kmers.LONG`` bases in all is expanded where
its sequences have met, so only they are shuffled; the rounds of longer ones are joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlake.operators import kmers
from repeatlake.plans.storage import materialize

ONE = ["locus", "hap"]


def expand(rows: DataFrame, k: int, flank: int, most: int, grow: bool = True) -> DataFrame:
    """``(locus, hap, start, end, ok)`` of ``(locus, hap, seq, start, end)`` after expansion; without ``grow`` the set stays that of the repeats given."""
    sizes = rows.groupBy("locus").agg(F.sum(F.length("seq")).alias("bases"), F.count("*").alias("rows"), F.count_distinct("hap").alias("haps"))
    far = sizes.where((F.col("bases") > kmers.LONG) | (F.col("rows") > F.col("haps")) | F.col("locus").isNull()).select("locus")
    kinds = dict(rows.dtypes)
    near = lambda x: x.groupBy("locus").applyInPandas(lambda g: _expanded(g, k, flank, most, grow), f"locus {kinds['locus']}, hap {kinds['hap']}, start long, end long, ok boolean")
    rows = rows.select(*ONE, "seq", "start", "end")
    if far.isEmpty():
        return near(rows)
    far = materialize(far, "long-loci")
    match = rows["locus"].eqNullSafe(far["locus"])
    return near(rows.join(far, match, "left_anti")).unionByName(_expand_by_joins(rows.join(far, match, "left_semi"), k, flank, most, grow))


def _expanded(group: pd.DataFrame, k: int, flank: int, most: int, grow: bool) -> pd.DataFrame:
    """The rounds of one locus, over its haplotypes' windows outside their repeats."""
    start, end = group["start"].to_numpy(np.int64, copy=True), group["end"].to_numpy(np.int64, copy=True)
    start0, end0, length = start.copy(), end.copy(), group["seq"].str.len().to_numpy(np.int64)
    pos, kmer, of, inner = [], [], [], []
    for i, seq in enumerate(group["seq"]):
        at, codes = kmers.valid_windows(np.frombuffer(seq.encode(), np.uint8), k)
        inside = (at >= start[i]) & (at <= end[i] - k)
        inner.append(codes[inside])
        pos.append(at[~inside])
        kmer.append(codes[~inside])
        of.append(np.full(len(pos[-1]), i))
    pos, kmer, of = (np.concatenate(x) for x in (pos, kmer, of))
    hit = np.isin(kmer, np.concatenate(inner))
    ok = np.ones(len(group), bool)
    while True:
        ok &= (start >= flank) & (end + flank <= length)
        s, e = start[of], end[of]
        left, right = (pos >= s - flank) & (pos < s), (pos > e - k) & (pos <= e + flank - k)
        seen = hit & ok[of]
        if not (seen & (left | right)).any():
            return pd.DataFrame({"locus": group["locus"], "hap": group["hap"], "start": start, "end": end, "ok": ok})
        low, high = start.copy(), end - k
        np.minimum.at(low, of[seen & left], pos[seen & left])
        np.maximum.at(high, of[seen & right], pos[seen & right])
        passed = left & (pos >= low[of]) | right & (pos <= high[of])
        start, end = low, high + k
        ok &= (start0 - start <= most) & (end - end0 <= most)
        if grow:
            hit |= np.isin(kmer, kmer[passed])


def _expand_by_joins(rows: DataFrame, k: int, flank: int, most: int, grow: bool) -> DataFrame:
    bounds = rows.select(*ONE, F.length("seq").alias("length"), F.col("start").alias("start0"), F.col("end").alias("end0"), "start", "end", F.lit(True).alias("ok"))
    bounds = materialize(bounds, "bounds")
    every = kmers.codes(rows.select(*ONE, "seq"), ONE, k).withColumn("pos", F.col("pos").cast("long")).join(bounds.select(*ONE, "start0", "end0"), ONE)
    inside = (F.col("pos") >= F.col("start0")) & (F.col("pos") <= F.col("end0") - k)
    near = (F.col("pos") >= F.col("start0") - most - flank) & (F.col("pos") <= F.col("end0") + most + flank)
    windows = materialize(every.where(near).select(*ONE, "pos", "kmer", inside.alias("inside")), "bound-windows")
    new = materialize(windows.where("inside").select("locus", "kmer").distinct(), "bound-kmers")
    known, outside = new, windows.where("not inside").select(*ONE, "pos", "kmer")
    found = materialize(outside.join(new, ["locus", "kmer"]).select(*ONE, "pos"), "bound-found")
    left = lambda x, until: (x >= F.col("start") - flank if until is None else x >= F.col(until)) & (x < F.col("start"))
    right = lambda x, until: (x > F.col("end") - k) & (x <= F.col("end") + flank - k if until is None else x <= F.col(until))
    while True:
        bounds = bounds.withColumn("ok", F.col("ok") & (F.col("start") >= flank) & (F.col("end") + flank <= F.col("length")))
        pos = F.col("pos")
        seen = found.join(bounds.where("ok").select(*ONE, "start", "end"), ONE).where(left(pos, None) | right(pos, None))
        moves = materialize(seen.groupBy(*ONE, "start", "end").agg(F.min(F.when(left(pos, None), pos)).alias("low"), F.max(F.when(right(pos, None), pos)).alias("high")), "bound-moves")
        if moves.isEmpty():
            return bounds.select(*ONE, "start", "end", "ok")
        after = bounds.join(moves.select(*ONE, "low", "high"), ONE, "left").withColumn("start", F.coalesce("low", "start")).withColumn("end", F.coalesce(F.col("high") + k, F.col("end"))).drop("low", "high")
        after = after.withColumn("ok", F.col("ok") & (F.col("start0") - F.col("start") <= most) & (F.col("end") - F.col("end0") <= most))
        bounds = materialize(after, "bounds")
        if grow:
            passed = outside.join(moves, ONE).where(left(pos, "low") | right(pos, "high")).select("locus", "kmer").distinct()
            new = materialize(passed.join(known, ["locus", "kmer"], "left_anti"), "bound-kmers")
            if not new.isEmpty():
                known = known.unionByName(new)
                found = found.unionByName(materialize(outside.join(new, ["locus", "kmer"]).select(*ONE, "pos"), "bound-found"))


def retained(before: DataFrame, after: DataFrame, haplotypes: int, expanded_least: float = 0.1, present_least: float = 0.8) -> DataFrame:
    """``(locus, present, failed, expanded, kept)``: loci to go on with, of the bounds before and after an expansion.

    A locus of which some bound moved needs that share of all ``haplotypes``
    present and not failed; any locus needs the other share present.
    """
    both = before.select(*ONE, F.col("start").alias("s"), F.col("end").alias("e")).join(after, ONE)
    rows = both.groupBy("locus").agg(F.count("*").alias("present"), F.count_if(~F.col("ok")).alias("failed"), F.bool_or((F.col("s") != F.col("start")) | (F.col("e") != F.col("end"))).alias("expanded"))
    left = (F.col("present") - F.col("failed")) / haplotypes
    kept = (~F.col("expanded") | (left >= expanded_least) & (F.col("failed") < haplotypes)) & (F.col("present") >= present_least * haplotypes)
    return rows.withColumn("kept", kept)
