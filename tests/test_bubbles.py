"""The set-oriented bubble search against a walk over random graphs full of cycles, and the scorer."""

import math
import random

import numpy as np
import pytest

from repeatlake.operators import bubbles, scorers

BASES = "ACGT"


def text(code, k):
    return "".join(BASES[code >> 2 * (k - 1 - i) & 3] for i in range(k))


def rc(word):
    return word[::-1].translate(str.maketrans(BASES, BASES[::-1]))


def code(word):
    return sum(BASES.index(c) << 2 * (len(word) - 1 - i) for i, c in enumerate(word))


def walk(edges, repeat, flank, k, least):
    """Of each root edge the set of alive edges behind it, by walks from node to node."""
    de = {}
    for e, n in edges.items():
        for x in (e, rc(e)):
            if x[:-1] != x[1:]:
                de[x] = n
    repeat, flank = ({y for x in s for y in (x, rc(x))} for s in (repeat, flank))
    after = {}
    for e in de:
        after.setdefault(e[:-1], []).append(e)

    def alive(e, seen):
        b = e[1:]
        if b in repeat:
            return True
        if b in flank or b in seen:
            return False
        return any(alive(x, seen | {b}) for x in after.get(b, ()))

    good = {e for e in de if alive(e, frozenset())}
    out = {}
    for root in good:
        if root[:-1] not in repeat or de[root] < least:
            continue
        seen, stack = {root}, [root]
        while stack:
            e = stack.pop()
            if e[1:] in repeat:
                continue
            for x in after.get(e[1:], ()):
                if x in good and x not in seen:
                    seen.add(x)
                    stack.append(x)
        out[root] = seen
    return de, repeat, good, out


@pytest.mark.parametrize("seed", range(3))
def test_bubbles_of_cyclic_graphs(spark, seed):
    rng, k = random.Random(seed), 3
    edges, repeat, flank = {}, {}, {}
    for locus in range(12):
        for _ in range(rng.randint(5, 40)):
            e = text(rng.randrange(4 ** (k + 1)), k + 1)
            edges[locus, min(e, rc(e))] = rng.randint(1, 9)
        pick = lambda n: {min(x, rc(x)) for x in (text(rng.randrange(4**k), k) for _ in range(n))}
        repeat[locus], flank[locus] = pick(5), pick(3)
    frame = spark.createDataFrame([(a, code(e), n) for (a, e), n in edges.items()], "locus long, edge long, cnt long")
    nodes = lambda sets: spark.createDataFrame([(a, code(x), 20) for a, s in sets.items() for x in s], "locus long, kmer long, cnt long")
    found = bubbles.Bubbles(frame, nodes(repeat), nodes(flank), k, 2)
    roots = {(r.locus, r.edge): r for r in found.root_features(nodes(repeat)).collect()}
    paths = {(r.locus, r.edge): r for r in found.path_features().collect()}
    want, calls = {}, set()
    for locus in range(12):
        own = {e: n for (a, e), n in edges.items() if a == locus}
        de, tr, good, reach = walk(own, repeat[locus], flank[locus] - repeat[locus], k, 2)
        leaving = [e for e in de if e[:-1] in tr]
        dead = [de[e] for e in leaving if e not in reach]
        every = set().union(*reach.values()) if reach else set()
        for root, some in reach.items():
            mine = [e for e in leaving if e[:-1] == root[:-1]]
            counts = [de[e] for e in some]
            pairs = [abs(de[x] - de[y]) for x in some if x[1:] not in tr for y in some if y[:-1] == x[1:]]
            want[locus, root] = (len(some), sum(de[e] for e in mine if e not in reach), sum(e in reach for e in mine), 20 - sum(de[e] for e in mine), round(sum(counts) / len(counts), 9), round(float(np.std(counts)), 6), max(dead, default=0), sum(p >= 3 for p in pairs), sum(p >= 4 for p in pairs), rc(root) in every)
            calls |= {(locus, y) for x in some for y in (x, rc(x))}
    got = {key: (r.n_bb_e, r.c_tm_e, r.n_snrl, r.c_ex_e, round(p.mcov, 9), round(p.scov, 6), p.fcmax, p.n3gp, p.n4gp, p.bdir) for key, r in roots.items() for p in [paths[key]]}
    assert got == want and set(paths) == set(roots) and len(want) > 10
    assert {tuple(r) for r in found.called(found.path_features()).collect()} == calls


def test_entropy_of_words(spark):
    for seq in ("AAAA", "ACGTTG", "AC"):
        for k in (1, 2):
            words = [min(seq[i : i + k], rc(seq[i : i + k])) for i in range(len(seq) - k + 1)]
            want = -sum(p * math.log2(p) for p in (words.count(w) / len(seq) for w in set(words)))
            assert abs(spark.createDataFrame([(seq,)], "s string").select(bubbles.word_entropy(bubbles.F.col("s"), k)).first()[0] - want) < 1e-12


def test_long_chain_and_lone_cycle(spark):
    """One chain of a thousand edges from repeat to repeat; a cycle that nothing leads to ends the doubling."""
    rng, k = random.Random(4), 15
    seq = "".join(rng.choice(BASES) for _ in range(1000 + k))
    ring = "".join(rng.choice(BASES) for _ in range(60))
    windows = {seq[i : i + k + 1] for i in range(1000)} | {(ring * 2)[i : i + k + 1] for i in range(60)}
    frame = spark.createDataFrame([(1, min(code(w), code(rc(w))), 3) for w in windows], "locus long, edge long, cnt long").distinct()
    canonical = lambda x: min(code(x), code(rc(x)))
    ends = spark.createDataFrame([(1, canonical(seq[:k]), 5), (1, canonical(seq[-k:]), 5)], "locus long, kmer long, cnt long")
    found = bubbles.Bubbles(frame, ends, ends.limit(0), k)
    assert {(r.bbs, r.mcov, r.scov, r.bdir) for r in found.path_features().collect()} == {(1000, 3.0, 0.0, True)} and found.roots.count() == 2


class Cubic:
    """Fitted in the test, not known to the library."""

    def __init__(self, x, y):
        self.by = np.polyfit(x, y, 3)

    def predict(self, m):
        return np.polyval(self.by, m[:, 0]) + m[:, 1]


def test_scorer(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    x = np.linspace(-2, 2, 30)
    model = Cubic(x, x**3 - x)
    registry = scorers.Registry()
    registry.add("line", scorers.Scorer(scorers.Linear([2.0, 1.0], 1.0), ["x", "n"]))
    df = spark.createDataFrame([(1.5, 2, "a"), (None, 3, "b"), (-1.0, None, "c"), (0.0, 0, "d")], "x double, n int, name string")
    assert {r["name"]: r["score"] for r in registry.score(df, "line").collect()} == {"a": 6.0, "b": None, "c": None, "d": 1.0}
    assert registry.score(df.limit(0), "line").count() == 0
    own = {r["name"]: r["mine"] for r in scorers.score(df, scorers.Scorer(model, ["x", "n"]), "mine").collect()}
    assert abs(own["a"] - (1.5**3 - 1.5 + 2)) < 1e-9 and own["b"] is None and abs(own["d"]) < 1e-9
    for bad in (scorers.Scorer(scorers.Linear([1.0]), ["none"]), scorers.Scorer(scorers.Linear([1.0]), ["name"])):
        with pytest.raises(ValueError):
            scorers.score(df, bad)
    with pytest.raises(TypeError):
        scorers.Scorer(object(), ["x"])
    with pytest.raises(ValueError):
        registry.add("line", scorers.Scorer(scorers.Linear([1.0]), ["x"]))
