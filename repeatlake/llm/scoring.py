"""Scores of documents by the pseudo-likelihood of a masked language model.

Each token is masked in turn and predicted from the two tokens on either side by
a window network in numpy: the four neighbours' vectors are summed, go through
tanh, and give the log odds of a group of classes, inside it of the token's class
and, inside the class, of the token. The sum of the conditional log-probabilities
scores a document.

Frequencies are counted over all documents: the frequent words become tokens,
and all others fall, by a hash of their last letters, into buckets that know how
often and how many different words fell there, among which a word has an equal
share. Classes hold tokens of like frequency, about the same sum of square roots
of shares of the corpus each: with as many classes as the roots of all shares add
up to, a token meets the fewest log odds. Groups are made of classes in the same
way. Tokens and buckets grow with the square root of the corpus, classes more slowly.

The network starts from whole documents of a small sample and is then trained on
every token of every document: each task takes its documents in steps from the
same start, and the changes are added up by executors, in blocks of rows, weighted
by how often a row was used. Vocabulary, classes and training grow with the corpus.

Cases: null text and text without words have no tokens, the score 0 and a null
mean. A null ``doc_id`` is scored like any other. Repeated rows are repeated. An
empty table gives an empty result. Other columns are ignored. Texts are scored
whole, in pieces of bounded size that overlap by the window.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatlake.llm.arrow import map_rows, plain_text, texts
from repeatlake.llm.bpe import Memo
from repeatlake.llm.labelled import first_by_hash
from repeatlake.plans.storage import materialize

FREQUENT, BUCKETS, CLASSES = 8000, 64, 64  # at least; FREQUENT may have fewer words to take
SIDE, HIDDEN = 2, 16
START_DOCUMENTS, START_TOKENS = 800, 200_000  # what the start is fitted to
STEP = 8192  # tokens of a step over the corpus
BLOCK = 4096  # rows of weights that are added up at a time
PIECE = 1 << 14  # tokens worked on at a time
ROWS = 1024  # tokens whose log odds within a range are held at a time, so that they stay near the processor
CHARACTERS = 1 << 22  # of texts, whole ones, whose words are looked up at a time
WORD = re.compile(r"[^\W\d_]+")


def bucket(word: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(word[-3:].encode("utf-8", "replace")) % buckets


@cache
def letters() -> np.ndarray:
    """Of every code point, whether words have it."""
    inside = np.zeros(0x110000, bool)
    for m in WORD.finditer("".join(map(chr, range(0x110000)))):
        inside[m.start() : m.end()] = True
    return inside


def words_of(some: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of texts, lower-cased; of each occurrence its place among them, in order; and how many words each text has. As ``WORD`` finds them."""
    lower = [t.lower() for t in some]
    flat = "\n".join(lower)  # no word has it
    data = np.frombuffer(flat.encode("utf-8"), np.uint8)
    points = data if flat.isascii() else np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = letters().take(points)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    many = np.diff(np.searchsorted(edges[::2], np.cumsum([0, *(len(t) + 1 for t in lower)])))
    if points is not data:
        edges = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[edges]
    ends = np.concatenate([[0], edges, [len(data)]])  # what is between words, and words, in turn
    parts = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
    at = parts.indices.to_numpy()[1::2]
    found = np.flatnonzero(np.bincount(at, minlength=len(parts.dictionary)))
    place = np.zeros(len(parts.dictionary), np.int64)
    place[found] = np.arange(len(found))
    return parts.dictionary.take(pa.array(found)).to_numpy(zero_copy_only=False).tolist(), place[at], many


def groups(batch: pa.RecordBatch):
    """``(first row, texts)``: the texts of a batch, about ``CHARACTERS`` at a time."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts(batch)):
        held.append(text)
        size += len(text)
        if size >= CHARACTERS:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def word_counts(documents: DataFrame, most: int = 100_000, id_column: str = "doc_id") -> DataFrame:
    """``(word, n)`` over all documents, lower-cased; tasks add up what they have read before anything is shuffled."""

    def count(batches):
        def out(seen: Counter):
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for _, some in groups(batch):
                words, at, _ = words_of(some)
                seen.update(dict(zip(words, np.bincount(at, minlength=len(words)).tolist())))
                if len(seen) > most:
                    yield out(seen)
                    seen = Counter()
        if seen:
            yield out(seen)

    return plain_text(documents, id_column).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ranges(share: np.ndarray, least: int) -> np.ndarray:
    """Numbers of ranges of shares: as many as the square roots of all add up to, but for empty ones, each with about as much of them."""
    root = np.sqrt(share)
    many = max(least, round(root.sum()))
    at = np.minimum(((np.cumsum(root) - root / 2) / root.sum() * many).astype(np.int64), many - 1)
    return np.cumsum(np.diff(at, prepend=at[:1]) != 0)


class Vocabulary:
    """Frequent words and buckets of the others, with classes, their groups, and shares."""

    def __init__(self, frequent: list[tuple[str, int]], rare: dict[int, tuple[int, int]], buckets: int = BUCKETS):
        frequent = sorted(frequent, key=lambda x: (-x[1], x[0]))
        self.ids, self.buckets = {w: k for k, (w, _) in enumerate(frequent)}, buckets
        self.size = len(frequent) + buckets
        n = np.array([c for _, c in frequent] + [rare.get(b, (0, 0))[0] + 1 for b in range(buckets)], float)
        order = np.argsort(-n, kind="stable")
        self.classes = np.empty(self.size, np.int64)
        self.classes[order] = _ranges(n[order] / n.sum(), CLASSES)
        self.kinds = int(self.classes.max()) + 1
        # a class is a range of places
        self.place = np.empty(self.size, np.int64)
        self.place[order] = np.arange(self.size)
        self.first = np.searchsorted(self.classes[order], np.arange(self.kinds + 1))
        mass = np.bincount(self.classes, n, self.kinds)
        self.inside = np.log(n / mass[self.classes])[order].astype(np.float32)
        # a group is a range of classes
        self.groups = _ranges(mass / mass.sum(), 1)
        sums = np.bincount(self.groups, mass)
        self.outer = np.searchsorted(self.groups, np.arange(len(sums) + 1))
        self.bases = [np.log(sums / sums.sum()).astype(np.float32), np.log(mass / sums[self.groups]).astype(np.float32), self.inside]
        self.shared = np.zeros(self.size)
        self.shared[len(frequent) :] = np.log([max(1, rare.get(b, (0, 0))[1]) for b in range(buckets)])

    def levels(self, target: np.ndarray):
        """From groups to tokens: what each target is inside of, what it is there, and where the ranges of those begin."""
        kind = self.classes[target]
        group = self.groups[kind]
        yield np.zeros(len(target), np.int64), group, np.array([0, len(self.outer) - 1])
        yield group, kind, self.outer
        yield kind, self.place[target], self.first

    def token(self, word: str) -> int:
        known = self.ids.get(word)
        return len(self.ids) + bucket(word, self.buckets) if known is None else known


def fit_vocabulary(counts: DataFrame, frequent: int | None = None) -> Vocabulary:
    """From the whole table of counts; only the frequent words and one row for each bucket reach the driver."""
    if frequent is None:
        frequent = max(FREQUENT, 2 * math.isqrt(counts.agg(F.sum("n")).first()[0] or 0))
    buckets = max(BUCKETS, frequent * BUCKETS // FREQUENT)
    # cut where a histogram of magnitudes says that enough words are left: a top-k over all words would have each task send `frequent` of them
    size = F.floor(F.log2("n") * 8).cast("int")
    room, least = frequent, 0
    for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("kinds")).orderBy(F.desc("size")).collect():
        least, room = r["size"], room - r["kinds"]
        if room <= 0:
            break
    top = counts.where(size >= least).orderBy(F.desc("n"), "word").limit(frequent)
    known = [(r["word"], r["n"]) for r in top.collect()]
    ends = F.pmod(F.crc32(F.encode(F.substring("word", -3, 3), "UTF-8")), F.lit(buckets))
    less = counts
    if known:
        word, n = min(known, key=lambda x: (x[1], [-ord(c) for c in x[0]]))
        less = counts.where((F.col("n") < n) | (F.col("n") == n) & (F.col("word") > word))
    rare = {r["b"]: (r["n"], r["kinds"]) for r in less.groupBy(ends.cast("int").alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    return Vocabulary(known, rare, buckets)


def _exponentials(z: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray | float]:
    """Puts each row's exponentials in its place; their sum, and what was taken off before: nothing where ``most``, a bound of their size, is small."""
    top: np.ndarray | float = 0.0
    if most >= 60:
        top = z.max(axis=1)
        z -= top[:, None]
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype), top


def _order(ids: np.ndarray, most: int) -> np.ndarray:
    """A stable order of numbers up to ``most``; short ones are sorted by their digits."""
    return np.argsort(ids.astype(np.uint16) if most < 1 << 16 else ids, kind="stable")


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted numbers, and where each begins."""
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[starts], starts


class Network:
    """Groups, their classes and the classes' tokens from the neighbours; the token before the start and after the end is the padding."""

    def __init__(self, words: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.words, self.pad = words, words.size
        tables = [rng.normal(0, 0.1, (words.size + 1, HIDDEN)).astype(np.float32) for _ in range(2 * SIDE)]
        outer, inner = (rng.normal(0, 0.1, (n, HIDDEN)).astype(np.float32) for n in (len(words.outer) - 1, words.kinds))
        # of the neighbours, the hidden layer, the groups, the classes, and the tokens by place
        self.params = [*tables, np.zeros(HIDDEN, np.float32), outer, words.bases[0].copy(), inner, words.bases[1].copy(), np.zeros((words.size, HIDDEN), np.float32)]

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights and bases of groups, classes or tokens."""
        at = 2 * SIDE + 1 + 2 * k
        return self.params[at], self.params[at + 1] if k < 2 else self.words.inside

    def windows(self, padded: np.ndarray) -> list[np.ndarray]:
        """The neighbours of every token of a sequence that has SIDE paddings at either end."""
        n = len(padded) - 2 * SIDE
        return [padded[k : k + n] for k in range(2 * SIDE + 1) if k != SIDE]

    def hidden(self, near: list[np.ndarray]) -> np.ndarray:
        tables, bias = self.params[: 2 * SIDE], self.params[2 * SIDE]
        hidden = tables[0].take(near[0], axis=0)
        for table, ids in zip(tables[1:], near[1:]):
            hidden += table.take(ids, axis=0)
        hidden += bias
        return np.tanh(hidden, out=hidden)

    def forward(self, near: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The hidden layer and the logarithms of the probabilities of all classes."""
        hidden = self.hidden(near)
        (own, base), (inner, bases) = self.level(0), self.level(1)
        group, logs = hidden @ own.T + base, hidden @ inner.T + bases
        total, top = _exponentials(group.copy(), math.inf)
        group -= (np.log(total) + top)[:, None]
        for k, (lo, hi) in enumerate(zip(self.words.outer, self.words.outer[1:])):
            total, top = _exponentials(logs[:, lo:hi].copy(), math.inf)
            logs[:, lo:hi] += (group[:, k] - np.log(total) - top)[:, None]
        return hidden, logs

    def inside(self, hidden: np.ndarray, k: int, within: np.ndarray, place: np.ndarray, first: np.ndarray):
        """Of each range of level ``k`` among rows in its order, some rows at a time: its places, which the rows are, their place within it, log odds and a bound of their size. The log odds stay until the next rows."""
        own, base = self.level(k)
        most = float((np.abs(own) @ np.ones(HIDDEN, np.float32) + np.abs(base)).max(initial=0))  # no unit is over 1
        starts = np.flatnonzero(np.diff(within, prepend=-1))
        ends, lows, highs = np.append(starts[1:], len(within)), first[within[starts]], first[within[starts] + 1]
        room = np.empty((np.minimum(ends - starts, ROWS) * (highs - lows)).max(initial=0), np.float32)
        for start, end, lo, hi in zip(starts.tolist(), ends.tolist(), lows.tolist(), highs.tolist()):
            for at in range(start, end, ROWS):
                rows = slice(at, min(at + ROWS, end))
                n = rows.stop - at
                z = np.matmul(hidden[rows], own[lo:hi].T, out=room[: n * (hi - lo)].reshape(n, hi - lo))
                z += base[lo:hi]
                yield lo, hi, rows, place[rows] - lo, z, most

    def by_class(self, hidden: np.ndarray, target: np.ndarray):
        """Of each class among the targets: its range of places, its rows, their tokens within it, log odds and the logarithms of their sums."""
        order = _order(self.words.classes[target], self.words.kinds)
        *_, tokens = self.words.levels(target[order])
        for lo, hi, rows, at, z, most in self.inside(hidden.take(order, axis=0), 2, *tokens):
            odds = z.copy()
            total, top = _exponentials(z, most)
            yield lo, hi, order[rows], at, odds, np.log(total) + top

    def squares(self) -> list[np.ndarray]:
        return [np.full(p.shape[:1] if k < 2 * SIDE or k == len(self.params) - 1 else p.shape, 1e-3, np.float32) for k, p in enumerate(self.params)]

    def step(self, ids: np.ndarray, target: np.ndarray, squares: list[np.ndarray], rate: float) -> None:
        """One step of Adagrad on the cross-entropy of groups, of classes inside them and of tokens inside those."""
        order, n = _order(self.words.classes[target], self.words.kinds), len(target)
        ids, target = ids.take(order, axis=1), target[order]
        hidden = self.hidden(list(ids))
        back = np.zeros_like(hidden)
        for k, level in enumerate(self.words.levels(target)):
            own, base = self.level(k)
            deep, flat = np.zeros_like(own), np.zeros_like(base)
            for lo, hi, rows, at, e, most in self.inside(hidden, k, *level):
                total, _ = _exponentials(e, most)
                e *= (1 / (n * total))[:, None]
                e.reshape(-1)[np.arange(0, e.size, hi - lo) + at] -= 1 / n
                back[rows] += e @ own[lo:hi]
                deep[lo:hi] += e.T @ hidden[rows]
                if k < 2:
                    flat[lo:hi] += np.ones(len(at), e.dtype) @ e
            at = 2 * SIDE + 1 + 2 * k
            if k < 2:
                squares[at] += deep**2
                squares[at + 1] += flat**2
                own -= rate * deep / np.sqrt(squares[at])
                base -= rate * flat / np.sqrt(squares[at + 1])
            else:
                squares[at] += np.einsum("ij,ij->i", deep, deep) / HIDDEN
                own -= np.multiply(deep, (rate / np.sqrt(squares[at]))[:, None], out=deep)
        back *= 1 - hidden**2
        grad = back.sum(axis=0)
        squares[2 * SIDE] += grad**2
        self.params[2 * SIDE] -= rate * grad / np.sqrt(squares[2 * SIDE])
        for k in range(2 * SIDE):
            order = _order(ids[k], self.pad)
            rows, starts = _runs(ids[k][order])
            grad = np.add.reduceat(back.take(order, axis=0).view(np.complex64), starts).view(np.float32)  # two columns at a time
            total = squares[k][rows] + np.einsum("ij,ij->i", grad, grad) / HIDDEN
            squares[k][rows] = total
            self.params[k][rows] = self.params[k].take(rows, axis=0) - grad * (rate / np.sqrt(total))[:, None]

    def fit(self, padded: np.ndarray, epochs: int = 2, batch: int = 2048, rate: float = 0.15, seed: int = 6) -> None:
        """Steps over all tokens of one sequence, shuffled."""
        rng, squares = np.random.default_rng(seed), self.squares()
        near, target = np.stack(self.windows(padded)), padded[SIDE : len(padded) - SIDE]
        real = np.flatnonzero(target != self.pad)
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(real), max(1, len(real) // batch)):
                self.step(near.take(some, axis=1), target[some], squares, rate)

    def logs(self, padded: np.ndarray) -> np.ndarray:
        """Conditional log-probability of every token of a padded sequence."""
        out = []
        n = len(padded) - 2 * SIDE
        for at in range(0, n, PIECE):
            part = padded[at : min(at + PIECE, n) + 2 * SIDE]
            target = part[SIDE : len(part) - SIDE]
            real, got = np.flatnonzero(target != self.pad), np.zeros(len(target))
            real = real[_order(self.words.classes[target[real]], self.words.kinds)]
            goal = target[real]
            hidden = self.hidden([w[real] for w in self.windows(part)])
            sure = -self.words.shared[goal]
            for k, level in enumerate(self.words.levels(goal)):
                for lo, hi, rows, at, z, most in self.inside(hidden, k, *level):
                    sure[rows] += z.reshape(-1).take(np.arange(0, z.size, hi - lo) + at)
                    total, top = _exponentials(z, most)
                    sure[rows] -= np.log(total) + top
            got[real] = sure
            out.append(got)
        return np.concatenate(out) if out else np.zeros(0)


def joined(sequences: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences one after another with paddings around each, and where each begins among the windows."""
    gap = np.full(SIDE, pad, np.int64)
    parts, starts, at = [gap], [], 0
    for s in sequences:
        starts.append(at)
        parts += [s, gap]
        at += len(s) + SIDE
    if sequences:
        parts.append(gap)
    return np.concatenate(parts), np.array(starts, np.int64)


def encoded(documents: DataFrame, words: Vocabulary, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, ids)``: the tokens of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def make():
        memo = Memo(shared.value.token)

        def each(batch: pa.RecordBatch):
            for first, some in groups(batch):
                found, at, many = words_of(some)
                ids = np.fromiter(map(memo.__getitem__, found), np.int32, len(found))[at]
                ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                yield {"doc_id": batch.column(0).slice(first, len(some)), "ids": pa.ListArray.from_arrays(ends, ids)}

        return each

    return map_rows(plain_text(documents, id_column), "doc_id long, ids array<int>", make)


def pieces(batches, room: int):
    """``(batch, rows, their token ids)``, of about ``room`` tokens at a time."""
    for batch in batches:
        column, at, held, size = batch.column(1), [], [], 0
        for k in range(len(batch)):
            ids = column[k].values.to_numpy().astype(np.int64)
            if len(ids):
                at.append(k)
                held.append(ids)
                size += len(ids)
            if size >= room:
                yield batch, at, held
                at, held, size = [], [], 0
        yield batch, at, held


def train_everywhere(tokens: DataFrame, start: Network, rate: float = 0.05) -> Network:
    """``start`` after every document of ``tokens``: tasks step through their documents, the weighted mean of their changes is added."""
    context = tokens.sparkSession.sparkContext
    shared = context.broadcast(start)

    def run(batches):
        from pyspark import TaskContext

        own = Network.__new__(Network)
        own.words, own.pad, own.params = shared.value.words, shared.value.pad, [p.copy() for p in shared.value.params]
        squares, rng = own.squares(), np.random.default_rng(TaskContext.get().partitionId())
        used = [np.zeros(len(p)) for p in own.params]
        for _, _, held in pieces(batches, 8 * STEP):
            if not held:
                continue
            padded, _ = joined(held, own.pad)
            target = padded[SIDE : len(padded) - SIDE]
            real = rng.permutation(np.flatnonzero(target != own.pad))
            if not len(real):
                continue
            near = np.stack(own.windows(padded))
            for some in np.array_split(real, max(1, len(real) // STEP)):
                own.step(near.take(some, axis=1), target[some], squares, rate)
            for k in range(2 * SIDE):
                used[k] += np.bincount(near[k][real], minlength=own.pad + 1)
            for k in range(2 * SIDE, len(used) - 1):
                used[k] += len(real)
            many = np.bincount(own.words.classes[target[real]], minlength=own.words.kinds)
            used[-1] += np.repeat(many, np.diff(own.words.first))
        shard = TaskContext.get().partitionId()
        for k, (p, old, n) in enumerate(zip(own.params, shared.value.params, used)):
            for at in range(0, len(p) if used[2 * SIDE][0] else 0, BLOCK):
                some, change = n[at : at + BLOCK], (p - old)[at : at + BLOCK]
                row = [[k], [at], [shard], [some.tobytes()], [change.astype(np.float32).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["param", "at", "shard", "used", "change"])

    def mean(key, parts):
        total, change = 0.0, 0.0
        for part in sorted((r for b in parts for r in b.to_pylist()), key=lambda r: r["shard"]):
            n = np.frombuffer(part["used"])
            total = total + n
            change = change + n[:, None] * np.frombuffer(part["change"], np.float32).reshape(len(n), -1)
        change = (change / np.maximum(total, 1)[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([change.tobytes()], pa.binary())], names=["param", "at", "change"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(mean(key, group.to_batches())))

    # a shard for each core and few more: what is added up is so many times the weights, whatever the table's size
    changes = tokens.coalesce(4 * context.defaultParallelism).mapInArrow(run, "param int, at int, shard int, used binary, change binary")
    model = Network.__new__(Network)
    model.words, model.pad, model.params = start.words, start.pad, [p.copy() for p in start.params]
    for r in changes.groupBy("param", "at").applyInArrow(add, "param int, at int, change binary").collect():
        rows = model.params[r["param"]][r["at"] : r["at"] + BLOCK]
        rows += np.frombuffer(r["change"], np.float32).reshape(rows.shape)
    return model


def trained(documents: DataFrame, counts: DataFrame | None = None, id_column: str = "doc_id") -> tuple[Network, DataFrame]:
    """A network over the vocabulary of all documents, trained on all of them, and their tokens."""
    table = materialize(counts if counts is not None else word_counts(documents, id_column=id_column), "lm-counts")
    start = Network(fit_vocabulary(table))
    tokens = materialize(encoded(documents, start.words, id_column), "lm-tokens")
    picked = first_by_hash(tokens.where(F.size("ids") > 0), START_DOCUMENTS, "doc_id", "ids").withColumn("h", F.xxhash64("doc_id", "ids"))
    before = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)  # of START_DOCUMENTS rows
    picked = picked.withColumn("before", F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0))).where(F.col("before") < START_TOKENS)
    padded, _ = joined([np.array(r["ids"], np.int64) for r in picked.orderBy("h").collect()], start.pad)
    if (padded != start.pad).any():
        start.fit(padded)
    return train_everywhere(tokens, start), tokens


def train(documents: DataFrame, counts: DataFrame | None = None, id_column: str = "doc_id") -> Network:
    return trained(documents, counts, id_column)[0]


def token_scores(tokens: DataFrame, model: Network) -> DataFrame:
    """``(doc_id, n_tokens, log_prob, mean_log_prob)`` of every row of ``tokens(doc_id, ids)``."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def make():
        net = shared.value

        def each(batch: pa.RecordBatch):
            total, many = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for _, at, held in pieces([batch], 4 * PIECE):
                padded, starts = joined(held, net.pad)
                logs = net.logs(padded)
                for k, s, ids in zip(at, starts, held):
                    many[k], total[k] = len(ids), logs[s : s + len(ids)].sum()
            mean = pa.array(np.divide(total, np.maximum(many, 1)), mask=many == 0)
            yield {"doc_id": batch.column(0), "n_tokens": many, "log_prob": total, "mean_log_prob": mean}

        return each

    return map_rows(tokens, "doc_id long, n_tokens long, log_prob double, mean_log_prob double", make)


def scores(documents: DataFrame, model: Network, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, log_prob, mean_log_prob)`` of every document."""
    return token_scores(encoded(documents, model.words, id_column), model)


def query(spark, sf_dir: str) -> DataFrame:
    """``op4``: the pseudo-likelihood of every document."""
    model, tokens = trained(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return token_scores(tokens, model)
