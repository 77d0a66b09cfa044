"""Bubbles of novel edges: from which repeat nodes they leave, what of them comes back, and what describes the way.

Edges are canonical (k+1)-mers as numbers, ``(locus, edge, cnt)``; the graph has
both strands. ``repeat(locus, node)`` and ``flank(locus, node)`` are where a walk
ends: it comes back at a repeat node, and is lost at a flank node, at a tip or in
a loop of one node. A node of both is a repeat node.

Nothing is walked locus by locus. Edges that have one way in and one way out
are contracted to chains by pointer doubling, in as many rounds as the logarithm of the
longest chain; then two fixpoints run over chains, each round a join with what
the round before added: which chains lead back to a repeat, and which of those
each root edge reaches. Members of a cycle reach the same chains, so a cycle is
alive as a whole or dead as a whole, without being found first. A cycle of
inner nodes alone is reached from nowhere and left out. Joins are on locus
and node, so a locus with most of the edges is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatlake.functions import sequence as S
from repeatlake.plans.storage import materialize

AT = ["locus", "node"]


def directed(edges: DataFrame, k: int) -> DataFrame:
    """``(locus, edge, a, b, cnt)`` of both strands, without loops of one node."""
    strands = F.array_distinct(F.array(F.col("edge"), S.revcomp_code(F.col("edge"), k + 1)))
    both = edges.select("locus", F.explode(strands).alias("edge"), F.col("cnt").cast("long").alias("cnt"))
    a, b = F.shiftright("edge", 2), F.col("edge").bitwiseAND((1 << 2 * k) - 1)
    return both.select("locus", "edge", a.alias("a"), b.alias("b"), "cnt").where("a <> b")


def both_strands(nodes: DataFrame, k: int) -> DataFrame:
    """``(locus, node)`` of ``nodes(locus, kmer)`` and their other strands."""
    return nodes.select("locus", F.explode(F.array(F.col("kmer"), S.revcomp_code(F.col("kmer"), k))).alias("node")).distinct()


def chains(edges: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(locus, chain, a, b, first, first_cnt, last_cnt, n, total, squares, gap3, gap4)`` of ``directed`` edges, and the ``(locus, chain, edge)`` of each.

    A chain is named by its last edge. ``gap3`` and ``gap4`` count successive edges of it whose counts differ by that much or more.
    """
    into = edges.groupBy("locus", F.col("b").alias("node")).agg(F.count("*").alias("n_in"))
    out = edges.groupBy("locus", F.col("a").alias("node")).agg(F.count("*").alias("n_out"), F.min("edge").alias("after"), F.min("cnt").alias("after_cnt"))
    inner = into.join(out, AT).where("n_in = 1 and n_out = 1").join(stops.select(*AT), AT, "left_anti").select("locus", F.col("node").alias("b"), "after", "after_cnt")
    gap = F.abs(F.col("cnt") - F.col("after_cnt"))
    rows = edges.join(inner, ["locus", "b"], "left").select("locus", "edge", "a", "b", "cnt", "after", *(F.coalesce((gap >= n).cast("int"), F.lit(0)).alias(f"gap{n}") for n in (3, 4)))
    rows = materialize(rows, "chain-edges")
    settled = rows.where("after is null").select("locus", "edge", F.col("edge").alias("chain"), F.lit(0).cast("long").alias("far"))
    active = rows.where("after is not null").select("locus", "edge", F.col("after").alias("to"), F.lit(1).cast("long").alias("far"))
    left = active.count()
    while left:
        found = settled.select("locus", F.col("edge").alias("to"), F.col("chain").alias("next"), F.col("far").alias("more"), F.lit(True).alias("ended"))
        found = found.unionByName(active.select("locus", F.col("edge").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.lit(False).alias("ended")))
        moved = materialize(active.join(found, ["locus", "to"]).select("locus", "edge", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), "ended"), "chain-jump")
        settled = settled.unionByName(moved.where("ended").select("locus", "edge", F.col("to").alias("chain"), "far"))
        active = moved.where("not ended").select("locus", "edge", "to", "far")
        before, left = left, active.count()
        if left == before:  # every chain that ends has an edge whose way doubled to its end in this round, so only cycles are left
            break
    members = materialize(rows.join(settled, ["locus", "edge"]), "chain-members")
    last = lambda c: F.max(F.when(F.col("far") == 0, F.col(c)))
    made = members.groupBy("locus", "chain").agg(
        F.max(F.struct("far", "a", "edge", "cnt")).alias("head"), last("b").alias("b"), last("cnt").alias("last_cnt"), F.count("*").alias("n"),
        F.sum("cnt").alias("total"), F.sum(F.col("cnt") * F.col("cnt")).alias("squares"), F.sum("gap3").alias("gap3"), F.sum("gap4").alias("gap4"),
    )
    made = made.select("locus", "chain", F.col("head.a").alias("a"), "b", F.col("head.edge").alias("first"), F.col("head.cnt").alias("first_cnt"), "last_cnt", "n", "total", "squares", "gap3", "gap4")
    return materialize(made, "chains"), members.select("locus", "chain", "edge")


def alive(made: DataFrame, repeat: DataFrame, flank: DataFrame) -> DataFrame:
    """The ``chains`` that lead back to a repeat node, with ``ends``: whether they end at one."""
    marked = made.join(repeat.select("locus", F.col("node").alias("b"), F.lit(True).alias("home")), ["locus", "b"], "left")
    marked = marked.join(flank.select("locus", F.col("node").alias("b"), F.lit(True).alias("lost")), ["locus", "b"], "left")
    marked = materialize(marked.withColumn("ends", F.coalesce("home", F.lit(False))).withColumn("lost", F.coalesce("lost", F.lit(False))), "chain-ends")
    open_, new = marked.where("not ends and not lost").select("locus", "chain", "a", "b"), marked.where("ends").select("locus", "chain", "a")
    known = new.select("locus", "chain")
    while not new.isEmpty():
        reached = new.select("locus", F.col("a").alias("b")).distinct()
        new = materialize(open_.join(reached, ["locus", "b"]).select("locus", "chain", "a").join(known, ["locus", "chain"], "left_anti"), "chain-alive")
        known = known.unionByName(new.select("locus", "chain"))
    return materialize(marked.join(known, ["locus", "chain"], "left_semi").drop("home", "lost"), "chains-alive")


def reach(good: DataFrame, roots: DataFrame) -> DataFrame:
    """``(locus, root, chain)`` of every alive chain that an alive chain of ``roots(locus, chain)`` leads to before it comes back, itself included."""
    new = materialize(roots.select("locus", F.col("chain").alias("root"), "chain"), "bubble-reach")
    known = new
    ways, starts = good.where("not ends").select("locus", "chain", "b"), good.select("locus", F.col("a").alias("b"), F.col("chain").alias("to"))
    while not new.isEmpty():
        steps = new.join(ways, ["locus", "chain"]).join(starts, ["locus", "b"]).select("locus", "root", F.col("to").alias("chain")).distinct()
        new = materialize(steps.join(known, ["locus", "root", "chain"], "left_anti"), "bubble-reach")
        known = known.unionByName(new)
    return known


def word_entropy(seq: Column, k: int) -> Column:
    """Shannon entropy (bits) of a short sequence's canonical k-mers, their frequencies taken of its length."""
    words = F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: S.canonical(F.substr(seq, i, F.lit(k))))

    def summed(all_words: Column) -> Column:
        share = lambda w: F.size(F.filter(all_words, lambda x: x == w)) / F.length(seq)
        return -F.aggregate(F.array_distinct(all_words), F.lit(0.0), lambda acc, w: acc + share(w) * F.log2(share(w)))

    return F.element_at(F.transform(F.array(words), summed), 1)


class Bubbles:
    """What the searches over one set of novel edges share: chains, those alive, and what root edges reach."""

    def __init__(self, edges: DataFrame, repeat: DataFrame, flank: DataFrame, k: int, least: int = 1):
        self.k = k
        self.edges = materialize(directed(edges, k), "bubble-edges")
        self.repeat = materialize(both_strands(repeat, k), "bubble-repeat")
        self.flank = materialize(both_strands(flank, k).join(self.repeat, AT, "left_anti"), "bubble-flank")
        made, self.members = chains(self.edges, self.repeat.unionByName(self.flank))
        self.alive = alive(made, self.repeat, self.flank)
        # chains end at repeat nodes, so the first edge of a chain that starts at one is a root edge
        at_root = self.alive.join(self.repeat.select("locus", F.col("node").alias("a")), ["locus", "a"], "left_semi").where(F.col("first_cnt") >= least)
        self.roots = materialize(at_root.select("locus", "chain", "a", "first", "first_cnt"), "bubble-roots")
        self.reached = reach(self.alive, self.roots)

    def called(self, roots: DataFrame) -> DataFrame:
        """``(locus, edge)`` of both strands of all alive edges that ``roots(locus, edge)``, root edges as text, lead to."""
        named = self.roots.withColumn("text", S.decode(F.col("first"), self.k + 1)).join(roots.select("locus", F.col("edge").alias("text")).distinct(), ["locus", "text"], "left_semi")
        some = self.reached.join(named.select("locus", F.col("chain").alias("root")), ["locus", "root"], "left_semi").select("locus", "chain").distinct()
        edges = some.join(self.members, ["locus", "chain"]).select("locus", "edge")
        both = edges.select("locus", F.explode(F.array(F.col("edge"), S.revcomp_code(F.col("edge"), self.k + 1))).alias("edge")).distinct()
        return both.select("locus", S.decode(F.col("edge"), self.k + 1).alias("edge"))

    def root_features(self, repeat_counts: DataFrame) -> DataFrame:
        """A row for each root edge that is alive; ``repeat_counts`` is ``(locus, kmer, cnt)`` of canonical repeat k-mers.

        ``c_root`` the count of the node it leaves, ``c_nv_e`` its own, ``c_tm_e``
        those of the node's other novel edges that are too few or dead, ``c_ex_e`` what
        remains for its known edges; ``n_snrl`` and ``n_tm_e`` how many of either
        kind, ``n_bb_e`` how many alive edges it leads to; then entropies of its bases.
        """
        k = self.k
        leaving = self.edges.join(self.repeat.select("locus", F.col("node").alias("a")), ["locus", "a"], "left_semi")
        good = self.roots.select("locus", F.col("first").alias("edge"), F.lit(True).alias("alive"))
        marked = leaving.join(good, ["locus", "edge"], "left").withColumn("alive", F.coalesce("alive", F.lit(False)))
        node = marked.groupBy("locus", "a").agg(F.sum("cnt").alias("novel"), F.sum(F.when(~F.col("alive"), F.col("cnt")).otherwise(0)).alias("c_tm_e"), F.count_if("alive").alias("n_snrl"), F.count_if(~F.col("alive")).alias("n_tm_e"))
        size = self.reached.join(self.alive.select("locus", "chain", "n"), ["locus", "chain"]).groupBy("locus", F.col("root").alias("chain")).agg(F.sum("n").alias("n_bb_e"))
        counted = repeat_counts.select("locus", F.col("kmer").alias("canonical"), F.col("cnt").alias("c_root"))
        rows = self.roots.join(node, ["locus", "a"]).join(size, ["locus", "chain"]).withColumn("canonical", F.least("a", S.revcomp_code(F.col("a"), k))).join(counted, ["locus", "canonical"])
        c_ex = F.col("c_root") - F.col("novel")
        rows = rows.select("locus", S.decode(F.col("first"), k + 1).alias("edge"), "c_root", F.col("first_cnt").alias("c_nv_e"), c_ex.alias("c_ex_e"), "c_tm_e", (F.col("first_cnt") / F.col("c_root")).alias("r_nve_r"), F.try_divide("first_cnt", c_ex + 1).alias("r_nve_exe"), "n_snrl", "n_tm_e", "n_bb_e")
        return rows.select("*", *(word_entropy(F.col("edge"), n).alias(f"h{n}") for n in (1, 2, 3)))

    def path_features(self) -> DataFrame:
        """A row for each root edge: size, mean and deviation of the counts of the alive edges it leads to, the greatest count of a root edge that is not alive, how far the mean is from it,
        how often the counts of an edge and of one that follows differ by 3 and by 4 or more, and whether the root edge's other strand is alive too."""
        after = self.alive.select("locus", F.col("a").alias("b"), F.col("first_cnt").alias("after_cnt"))
        gap = F.abs(F.col("last_cnt") - F.col("after_cnt"))
        turns = self.alive.where("not ends").join(after, ["locus", "b"]).groupBy("locus", "chain").agg(*(F.count_if(gap >= n).alias(f"turn{n}") for n in (3, 4)))
        parts = self.alive.join(turns, ["locus", "chain"], "left").select("locus", "chain", "n", "total", "squares", *((F.col(f"gap{n}") + F.coalesce(f"turn{n}", F.lit(0))).alias(f"gap{n}") for n in (3, 4)))
        sums = self.reached.join(parts, ["locus", "chain"]).groupBy("locus", F.col("root").alias("chain")).agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares", "gap3", "gap4")))
        leaving = self.edges.join(self.repeat.select("locus", F.col("node").alias("a")), ["locus", "a"], "left_semi")
        dead = leaving.join(self.roots.select("locus", F.col("first").alias("edge")), ["locus", "edge"], "left_anti").groupBy("locus").agg(F.max("cnt").alias("fcmax"))
        # the other strand of a root edge comes back at the root, so it is the last edge of its chain, whose name it is
        other = self.reached.select("locus", F.col("chain").alias("other")).distinct().withColumn("bdir", F.lit(True))
        rows = self.roots.join(sums, ["locus", "chain"]).join(dead, "locus", "left").withColumn("other", S.revcomp_code(F.col("first"), self.k + 1)).join(other, ["locus", "other"], "left")
        mean, worst = F.col("total") / F.col("n"), F.coalesce("fcmax", F.lit(0))
        sd = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean))
        return rows.select("locus", S.decode(F.col("first"), self.k + 1).alias("edge"), F.col("n").alias("bbs"), mean.alias("mcov"), sd.alias("scov"), worst.alias("fcmax"), (mean - worst).alias("cdiff"), F.col("gap3").alias("n3gp"), F.col("gap4").alias("n4gp"), F.coalesce("bdir", F.lit(False)).alias("bdir"))
