"""How far the sources of each language are from each other, by the terms that they use.

Texts are counted in Arrow batches into ``(lang, source, term, n, df)``; a task
adds up what it has seen and sends it on whenever it holds ``HELD`` entries, so
its memory does not grow with the corpus or with a hot source. Each language
keeps the terms of at least ``least`` of its documents. With ``V`` of them,
``N`` occurrences of them in a group and ``n`` of one term, the group gives that
term ``p = 1 + floor(SCALE (n + SMOOTH) / (N + SMOOTH V))``, in whole numbers.

Two sources are compared by the histogram of the pairs of counts that their
terms have. Terms that both hold are joined and tallied by ``(n, n')`` before
anything is shuffled; the cells with a zero, which nothing is stored for, follow
from the histogram of each source alone: a term of count ``n`` in one source that
is not in the joint tally is in cell ``(n, 0)``, and what is left of ``V`` in ``(0, 0)``.
So ``abs(p - p')`` is evaluated once for each cell and multiplied by its terms.
The joint tally reads a term once for each pair of sources that both hold it;
the result has a row for each pair of sources, so it has the same bound.

Cases: null text, language and source are ``''``. A group without terms, or a
language without kept terms, is in the result with all its pairs, at value 0 if
nothing is kept. A language with one source has no pairs. Ties are ordered by
the item's UTF-8 bytes. Repeated rows count again, as documents too. An empty
table gives an empty result. Very long texts are counted in pieces cut between
terms. Other columns, whatever they are called, are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatlake.plans.storage import materialize

LEAST, TOP = 30, 50
SCALE, SMOOTH = 1_000_000_000, 5
HELD = 1 << 18
PIECE = 1 << 22  # bytes of a text that are cut into terms at a time
#: Terms are runs of letters and of all that is not ASCII; in UTF-8 those are bytes of letters and bytes from 128.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def pieces(text: bytes):
    """Lists of the terms of a text, each of at most about ``PIECE`` bytes or one longer term."""
    clean = text.translate(TERMS)
    at = 0
    while at < len(clean):
        end = len(clean) if len(clean) - at <= PIECE else clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def group_counts(documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``(lang, source, term, n, df)``: occurrences of each term in each group, and the group's documents that hold it."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select(of(lang).alias("lang"), of(source).alias("source"), of(text).cast("binary").alias("text"))

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush():
            for (a, b), (n, df) in held.items():
                terms = list(n)
                for i in range(0, len(terms), 1 << 15):
                    some = terms[i : i + (1 << 15)]
                    columns = [pa.array([a] * len(some)), pa.array([b] * len(some)), pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([df[t] for t in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])
            held.clear()

        room = HELD
        for batch in batches:
            a, b, texts = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                key = (a[i].as_py(), b[i].as_py())
                n, df = held.get(key) or held.setdefault(key, (Counter(), Counter()))
                before, own = len(n), Counter()
                for words in pieces(texts[i].as_buffer().to_pybytes()):
                    own.update(words)
                n.update(own)
                df.update(own.keys())
                room -= len(n) - before
                if room <= 0:
                    yield from flush()
                    room = HELD
        yield from flush()

    found = rows.mapInArrow(run, "lang string, source string, term binary, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: str, total: str, kept: str = "v") -> Column:
    """``1 + floor(SCALE (n + SMOOTH) / (total + SMOOTH kept))``, exactly."""
    return F.expr(f"1L + ({SCALE} * cast({n} + {SMOOTH} AS decimal(20,0))) div cast({total} + {SMOOTH} * {kept} AS decimal(20,0))")


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, source, term, n, of_lang)`` of the terms that are in at least ``least`` documents of their language."""
    wide = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("df").alias("in_docs")).where(F.col("in_docs") >= least)
    return counts.select("lang", "source", "term", "n").join(wide.select("lang", "term", "of_lang"), ["lang", "term"])


def joint_cells(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(lang, a, b, na, nb, terms)``: for each pair of sources, how many kept terms have which two counts, zeros included.

    ``pairs`` is ``(lang, a, b, v, ...)``, each pair once with ``a < b``.
    """
    one = kept.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("na"))
    two = kept.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("nb"))
    both = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "na", "nb").agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("long")

    def cells(rows: DataFrame, *which) -> DataFrame:
        made = F.array(*(F.struct(na.alias("na"), nb.alias("nb"), m.alias("m")) for na, nb, m in which))
        return rows.select("lang", "a", "b", F.explode(made).alias("c")).select("lang", "a", "b", "c.*")

    m, na, nb, h = (F.col(c) for c in ("m", "na", "nb", "h"))
    alone = kept.groupBy("lang", "source", F.col("n").alias("own")).agg(F.count("*").alias("h"))
    some = pairs.where("v > 0").select("lang", "a", "b", "v")
    ours = some.join(alone.withColumnRenamed("source", "a"), ["lang", "a"])
    theirs = some.join(alone.withColumnRenamed("source", "b"), ["lang", "b"])
    parts = (
        cells(both, (na, nb, m), (na, zero, -m), (zero, nb, -m), (zero, zero, m)),
        cells(ours, (F.col("own"), zero, h), (zero, zero, -h)),
        cells(theirs, (zero, F.col("own"), h), (zero, zero, -h)),
        cells(some, (zero, zero, F.col("v"))),
    )
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("terms")).where("terms <> 0")


def audit(documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: the distance of every pair of sources of a language, and the ``top`` terms that each source uses more than its language."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept = materialize(kept_terms(materialize(group_counts(documents, lang, source, text), "divergence-counts"), least), "divergence-kept")
    groups = documents.select(of(lang).alias("lang"), of(source).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.select("lang", "term", "of_lang").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("of_all"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "of_all"])
    groups = materialize(groups, "divergence-groups")

    one = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
    pairs = one.join(two, "lang").where("a < b")
    far = F.abs(share("na", "total_a") - share("nb", "total_b")) * F.col("terms")
    sums = joint_cells(kept, pairs).join(pairs.where("v > 0"), ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(far).alias("value"))
    valued = pairs.select("lang", "a", "b").join(sums, ["lang", "a", "b"], "left").na.fill(0, ["value"])
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    compared = valued.select("lang", "value", F.explode(ways).alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    own, whole = share("n", "total"), share("of_lang", "of_all")
    above = kept.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (own - whole).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(compared).unionByName(ranked(above.where("value > 0")).where(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    """``op11``: every pair of sources of each language, and the terms that mark each source, over all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_P = "1 + ({scale} * ({n} + {smooth})::HUGEINT) // ({total} + {smooth} * v)"
_SHARE = lambda n, total: _P.format(scale=SCALE, smooth=SMOOTH, n=n, total=total)
#: The dense form: every kept term of a language in every one of its groups.
SQL = rf"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
  FROM documents
), held AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= {LEAST}
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), cells AS MATERIALIZED (
  SELECT g.lang, g.source, h.term, coalesce(c.n, 0) AS n FROM groups g JOIN held h USING (lang) LEFT JOIN counts c USING (lang, source, term)
), langs AS (
  SELECT lang, count(DISTINCT term) AS v, sum(n) AS total FROM cells GROUP BY lang
), of_lang AS (
  SELECT lang, term, {_SHARE("c.n", "total")} AS q FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL) c JOIN langs USING (lang)
), shares AS MATERIALIZED (
  SELECT c.lang, c.source, c.term, c.n, {_SHARE("c.n", "t.total")} AS p
  FROM cells c JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL) t USING (lang, source) JOIN langs USING (lang)
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), marks AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marks)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
