"""What of the novel edges of a locus returns to its repeat, walked locus by locus. One locus is one group; :mod:`repeatlake.operators.bubbles` needs no groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

def bubbles_of(edges: list[tuple[str, int]], repeat: set[str]) -> list[tuple[str, int, int, int, float, float]]:
    """Of each repeat node from which novel edges leave: what of them returns to the repeat.

    ``edges`` are novel (k+1)-mers with counts. An edge is alive if it is on a
    path from a repeat node back to a repeat node: reached forwards from the
    roots and backwards from the returns. Returned: root, edges reached, alive
    edges, nodes reached, mean and deviation of the alive edges' counts.
    """
    after: dict[str, list[tuple[str, int]]] = {}
    for word, n in edges:
        if word[:-1] != word[1:]:
            after.setdefault(word[:-1], []).append((word[1:], n))
    out = []
    for root in sorted(set(after) & repeat):
        seen, stack, reached = {root}, [root], []
        while stack:
            node = stack.pop()
            for to, n in after.get(node, ()):
                reached.append((node, to, n))
                if to not in seen and to not in repeat:
                    seen.add(to)
                    stack.append(to)
        back: dict[str, list[str]] = {}
        for a, b, _ in reached:
            back.setdefault(b, []).append(a)
        good, stack = set(), [b for _, b, _ in reached if b in repeat]
        while stack:
            node = stack.pop()
            if node not in good:
                good.add(node)
                stack.extend(back.get(node, ()))
        alive = [n for _, b, n in reached if b in good]
        out.append((root, len(reached), len(alive), len(seen), float(np.mean(alive)) if alive else 0.0, float(np.std(alive)) if alive else 0.0))
    return out


def bubbles(edges: DataFrame, repeat: DataFrame) -> DataFrame:
    """Features of all bubble roots: ``edges(locus, edge, cnt)`` are novel, ``repeat(locus, kmer)`` the repeat's nodes."""
    from pyspark.sql import functions as F

    both = edges.select("locus", F.col("edge").alias("word"), "cnt").unionByName(repeat.select("locus", F.col("kmer").alias("word"), F.lit(-1).cast("long").alias("cnt")))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("word", kind="stable")
        nodes = group["cnt"] < 0
        found = bubbles_of(list(zip(group["word"][~nodes], group["cnt"][~nodes])), set(group["word"][nodes]))
        out = pd.DataFrame(found, columns=["root", "reached", "alive", "nodes", "mean", "sd"])
        out.insert(0, "locus", group["locus"].iloc[0])
        return out

    return both.groupBy("locus").applyInPandas(one, "locus long, root string, reached long, alive long, nodes long, mean double, sd double")
