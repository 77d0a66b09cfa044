"""Personal data in texts, and terms that give it away, found with SQL functions alone.

Addresses and numbers are found by pattern: ``split`` gives what lies between
matches and ``regexp_extract_all`` the matches, so sums of their lengths are the
matches' places. Patterns are written so that Java neither recurses nor looks at a
run of characters once for each of its starts, whatever its length, and match
what the plain forms (``PLAIN``) match.

The rest is information-theoretic. An entity ``e`` is a value that was found (an
address in lower case, the digits of a number); a term ``t`` is a word beside
it, at most ``WINDOW`` on either side and none beyond the next match of its
kind. With ``N`` documents, ``n(e)`` of them with ``e``, ``n(t)`` with ``t``
anywhere and ``n(e, t)`` with ``t`` beside ``e``, the term tells ``PMI(e, t) = ln(N n(e, t) / (n(e) n(t)))``
of the ``IC(e) = ln(N / n(e))`` that there is to tell. Their ratio is the share
disclosed, 1 where the term occurs beside ``e`` only. Terms that disclose at least ``REMOVED``
of any entity are removed wherever they occur, those of at least ``GENERALISED``
are made general. Evidence has to come from ``CONTEXTS`` different surroundings, and two
surroundings of an entity may have at most half their terms in common on average: so
copying a text, exactly or nearly, does not make its words telling.

Whole documents are read four times at most and not shuffled, unless more than
``HOLDERS`` different texts hold a disclosing term. Evidence is at most ``2 WINDOW`` terms an entity found and is
added up before it is shuffled, so an entity or a term that many documents hold is no hot key.

Cases: null text is empty and has no spans. Repeated rows are documents of their own; copies of a text
have the same spans. Null and repeated ids stay. Spans of different kinds may overlap; a term
inside a base span is not listed again. An entity of every document can not be given away.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatlake.llm.arrow import plain_text
from repeatlake.plans.storage import materialize

KINDS = ("email", "ip", "card", "phone")
#: The patterns as they are asked for.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches in linear time: starts inside a run only after a match that ended there, and no way back. A card shorter than 13 digits would fail anyway.
QUICK = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": PLAIN["phone"],
}
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WORD, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, CONTEXTS, REMOVED, GENERALISED = 8, 3, 0.9, 0.75
HOLDERS = 100_000  # texts that hold a telling term: up to so many, and 64 code points of terms for each, are broadcast so that no text is shuffled
SPAN = "array<struct<start:bigint,stop:bigint,hit:string>>"
CUT = "\x01"  # in no address, number or word


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str, context=None) -> Column:
    """``(start, stop, hit)`` of all matches of a pattern that matches no empty text, in code points, the end exclusive.

    ``context(piece)`` is added for what precedes (``before``) and follows
    (``after``) each match. Running sums are made in about sqrt(n) blocks of sqrt(n)
    matches, because an array that grows by one is copied.
    """
    more = (lambda p: {"before": context(p)}) if context else (lambda p: {})
    named = lambda values: F.struct(*(v.alias(k) for k, v in values.items()))

    def summed(pieces: Column) -> Column:
        n = F.size(pieces)
        root = F.ceil(F.sqrt(n)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / root).cast("int")), lambda b: F.slice(pieces, b * root + 1, root))
        nothing = F.array().cast("array<bigint>")
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["gap"])).alias("out"))
        inside = F.transform(blocks, lambda block: F.aggregate(block, F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("out")), step))

        def starts(parts: Column) -> Column:
            base = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("out")), lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
            return F.flatten(F.zip_with(parts, base["out"], lambda x, b: F.transform(x["out"], lambda s: s + b)))

        def spans(at: Column) -> Column:
            put = lambda x, s: {"start": s, "stop": s + x["size"], "hit": x["hit"]} | ({"before": x["before"]} if context else {})
            return F.zip_with(pieces, at, lambda x, s: named(put(x, s)))

        return let(let(inside, starts), spans)

    gaps = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda p, m: named({"gap": F.length(p).cast("long"), "size": F.coalesce(F.length(m), F.lit(0)).cast("long"), "hit": m} | more(p)),
    )
    found = let(gaps, summed)
    if not context:
        return F.filter(found, lambda x: x["hit"].isNotNull())

    def beside(spans: Column) -> Column:
        after = F.transform(F.slice(spans, F.lit(2), F.size(spans)), lambda x: x["before"])
        return F.zip_with(spans, after, lambda x, a: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["hit"].alias("hit"), x["before"].alias("before"), a.alias("after")))

    return F.filter(let(found, beside), lambda x: x["hit"].isNotNull())


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass: every second from the right doubled, digit sums added, divisible by ten."""

    def summed(d: Column) -> Column:
        at = lambda i: F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = lambda i: F.when(i % 2 == 0, at(i)).otherwise(2 * at(i) - F.when(at(i) > 4, 9).otherwise(0))
        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + twice(i)) % 10 == 0

    return let(number, summed)


def sound(kind: str, hit: Column) -> Column:
    """Whether a match counts."""
    if kind == "ip":
        return hit.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(hit)).between(13, 19), luhn(digits(hit))).otherwise(F.lit(False))
    return F.length(digits(hit)).between(9, 15) if kind == "phone" else F.lit(True)


def entity(kind: str, hit: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(hit) if kind == "email" else hit if kind == "ip" else digits(hit))


def words(text: Column) -> Column:
    """The words of a text in lower case, at least two code points each."""
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: F.length(w) > 1)


def ends(piece: Column) -> Column:
    """The first and the last ``WINDOW`` words of a text."""
    return let(words(piece), lambda w: F.struct(F.slice(w, 1, WINDOW).alias("first"), F.slice(w, F.greatest(F.lit(1), F.size(w) - WINDOW + 1), F.lit(WINDOW)).alias("last")))


def base(text: Column, kind: str, context=None) -> Column:
    """The spans of a kind that count; what ``located`` gives, or an empty array where the pattern has no match."""
    near = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else F.lit(True)
    return F.when(near & text.rlike(QUICK[kind]), F.filter(located(text, QUICK[kind], context), lambda s: sound(kind, s["hit"])))


def keys(text: Column) -> list[Column]:
    """128 bits by which equal texts are known."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def base_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, k1, k2, <kind>, evidence)``: spans ``(start, stop)`` of each kind, and what their surroundings are evidence of.

    Evidence is text: ``entity, term, surroundings`` with ``CUT`` between them,
    each once a document; then ``entity, term``; then ``entity``, with all its
    ``surroundings``; then ``term`` beside any entity.
    """
    wide = docs.select("doc_id", *keys(F.col("text")), *(base(F.col("text"), kind, ends).alias(kind) for kind in KINDS))

    def told(kind: str) -> Column:
        def each(s: Column) -> Column:
            around = F.concat(s["before"]["last"], s["after"]["first"])
            name = entity(kind, s["hit"])
            ways = lambda pair, t: F.array(F.concat_ws(CUT, pair["name"], t, pair["place"]), F.concat_ws(CUT, pair["name"], t), F.concat_ws(CUT, F.lit(""), t))
            said = lambda pair: F.flatten(F.transform(F.array_distinct(pair["around"]), lambda t: ways(pair, t)))
            place = F.hex(F.xxhash64(around))
            return F.concat(F.array(name, F.concat_ws(CUT, name, F.lit(""), place)), let(F.struct(around.alias("around"), name.alias("name"), place.alias("place")), said))

        return F.coalesce(F.flatten(F.transform(kind, each)), F.array().cast("array<string>"))

    places = (F.coalesce(F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))), F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias(kind) for kind in KINDS)
    return wide.select("doc_id", "k1", "k2", *places, F.array_distinct(F.concat(*(told(kind) for kind in KINDS))).alias("evidence"))


def disclosing(docs: DataFrame, rows: DataFrame, contexts: int = CONTEXTS, least: float = GENERALISED) -> DataFrame | None:
    """``(term, share)`` of the terms that disclose at least ``least`` of an entity; None if no term has evidence enough."""
    said = rows.select(F.explode("evidence").alias("said")).groupBy("said").agg(F.count("*").alias("n"))
    part = F.split("said", CUT)
    said = said.select(part[0].alias("entity"), F.nullif(F.get(part, F.lit(1)), F.lit("")).alias("term"), F.get(part, F.lit(2)).alias("place"), "n")
    said = said.groupBy("entity", "term").agg(F.sum(F.when(F.col("place").isNull(), F.col("n"))).alias("n"), F.count("place").alias("contexts"))
    said = materialize(said, "private-evidence")
    total = F.lit(float(rows.count()))
    both = said.where("entity <> '' and term is not null")
    # of two of an entity's surroundings, what share of the terms do they have in common? Over half: they are copies
    alike = both.groupBy("entity").agg(F.sum("contexts").alias("held"), F.sum(F.col("contexts") * (F.col("contexts") - 1)).alias("met"))
    entities = said.where("term is null").select("entity", F.col("n").alias("n_entity"), F.col("contexts").alias("places")).where((F.col("n_entity") < total) & (F.col("places") >= contexts))
    entities = entities.join(alike, "entity").where("2 * met <= (places - 1) * held").select("entity", "n_entity")
    beside = said.where("entity = ''").select("term", F.col("n").alias("n_beside"))
    terms = both.where(F.col("contexts") >= contexts).select("entity", "term", F.col("n").alias("n_both")).join(entities, "entity").join(beside, "term")

    def share(n_term: str) -> Column:
        pmi = F.log(F.least(F.lit(1.0), F.col("n_both") / F.col(n_term)) * total / F.col("n_entity"))
        return pmi / F.log(total / F.col("n_entity"))

    # a term is in at least the documents that have it beside any entity: what that rules out need not be counted
    terms = materialize(terms.where(share("n_beside") >= least - 1e-9), "private-terms")
    if terms.isEmpty():
        return None
    wanted = terms.select("term").distinct()
    held = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    shares = terms.join(held, "term").select("term", share("n_term").alias("share"))
    return materialize(shares.where(F.col("share") >= least).groupBy("term").agg(F.max("share").alias("share")), "private-shares")


def term_spans(docs: DataFrame, shares: DataFrame) -> DataFrame:
    """``(k1, k2, term, removed)`` of the texts that hold a disclosing term: the spans of all such terms outside base spans, and of those to be removed."""
    some = docs.select(*keys(F.col("text")), F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(shares, "term")
    some = some.groupBy("k1", "k2").agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("share") >= REMOVED, F.col("term"))).alias("gone"))  # at most a document's own words
    some = materialize(some, "private-holders")
    size = some.agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("terms", " "))).alias("chars")).first()
    small = size["n"] <= HOLDERS and (size["chars"] or 0) <= 64 * HOLDERS
    texts = docs.select(*keys(F.col("text")), "text").join(F.broadcast(some) if small else some, ["k1", "k2"])
    own = F.filter(located(F.col("text"), WORD), lambda s: F.array_contains(F.col("terms"), F.lower(s["hit"])))
    taken = F.concat(*(F.coalesce(base(F.col("text"), kind), F.array().cast(SPAN)) for kind in KINDS))
    rows = texts.select("k1", "k2", "gone", own.alias("own"), taken.alias("taken"))
    apart = F.filter("own", lambda s: ~F.exists("taken", lambda b: (b["start"] < s["stop"]) & (b["stop"] > s["start"])))
    rows = rows.select("k1", "k2", "gone", apart.alias("own"))
    place = lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))
    removed = F.transform(F.filter("own", lambda s: F.array_contains(F.col("gone"), F.lower(s["hit"]))), place)
    return rows.select("k1", "k2", F.transform("own", place).alias("term"), removed.alias("removed")).groupBy("k1", "k2").agg(F.first("term").alias("term"), F.first("removed").alias("removed"))


def private_spans(documents: DataFrame, id_column: str = "doc_id", text: str = "text", contexts: int = CONTEXTS, least: float = GENERALISED) -> DataFrame:
    """``(doc_id, k1, k2, email, ip, card, phone, term, removed)`` of every row: arrays of ``(start, stop)``; ``k1, k2`` name its text."""
    docs = plain_text(documents, id_column, text)
    rows = materialize(base_rows(docs), "private-base")
    shares = disclosing(docs, rows, contexts, least)
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    if shares is None or shares.isEmpty():
        return rows.drop("evidence").withColumn("term", none).withColumn("removed", none)
    found = rows.drop("evidence").join(materialize(term_spans(docs, shares), "private-spans"), ["k1", "k2"], "left")
    return found.select(*rows.drop("evidence").columns, *(F.coalesce(c, none).alias(c) for c in ("term", "removed")))


def sanitised(documents: DataFrame, id_column: str = "doc_id", text: str = "text", contexts: int = CONTEXTS, least: float = GENERALISED) -> DataFrame:
    """``(doc_id, text)`` with base spans named by their kind, telling terms removed and less telling ones made general (``[TERM]``).

    Where spans overlap, the first stays, of those the longest.
    """
    docs = plain_text(documents, id_column, text)
    spans = private_spans(documents, id_column, text, contexts, least).dropDuplicates(["k1", "k2"]).drop("doc_id")
    both = docs.select("doc_id", "text", *keys(F.col("text"))).join(spans, ["k1", "k2"])
    mark = lambda by: lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("stop"), F.lit(by).alias("by"))
    named = [F.transform(kind, mark(f"[{kind.upper()}]")) for kind in KINDS]
    terms = F.transform("term", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("stop"), F.when(F.array_contains("removed", s), F.lit("")).otherwise(F.lit("[TERM]")).alias("by")))
    body = F.col("text")

    def put(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["done"], F.substr(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), s["by"])
        new = s["start"] >= acc["at"]
        return F.struct(F.when(new, -s["stop"]).otherwise(acc["at"]).alias("at"), F.when(new, piece).otherwise(acc["done"]).alias("done"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    return both.select("doc_id", F.aggregate(F.array_sort(F.concat(*named, terms)), start, put, lambda acc: F.concat(acc["done"], F.substr(body, (acc["at"] + 1).cast("int"), F.length(body)))).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op12``: counts and places of personal data, and of the terms that give it away, in every document."""
    rows = private_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda kind: F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))
    plain = F.array_join(F.concat(*(listed(kind) for kind in KINDS)), ",")
    every = F.array_join(F.concat(*(listed(kind) for kind in (*KINDS, "term"))), ",")
    return rows.select("doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS), F.sha2(plain, 256).alias("base_sha256"), every.alias("spans"))


_PIECES = "list_zip(string_split_regex({of}, '{p}'), list_append(regexp_extract_all({of}, '{p}'), NULL))"
_LOCATED = "SELECT {keep}, {kind} AS kind, i, z[2] AS hit, z[1] AS gap, sum(length(z[1]) + coalesce(length(z[2]), 0)) OVER (PARTITION BY r ORDER BY i) - coalesce(length(z[2]), 0) AS start FROM (SELECT *, generate_subscripts(m, 1) AS i, unnest(m) AS z FROM (SELECT *, {pieces} AS m FROM {source}))"


def _of(kind: str, keep: str = "r", source: str = "docs") -> str:
    pattern = {**PLAIN, "term": WORD}[kind].replace("(\\.", "(?:\\.").replace("([\\x20", "(?:[\\x20")
    return _LOCATED.format(keep=keep, kind=f"'{kind}'", source=source, pieces=_PIECES.format(of="text", p=pattern))


_LUHN = "list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN d[length(d) - i]::INT ELSE 2 * d[length(d) - i]::INT - CASE WHEN d[length(d) - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_WORDS = "list_filter(string_split_regex(lower({of}), '" + BETWEEN + "'), lambda w: length(w) > 1)"
SQL = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), matches AS MATERIALIZED (
  SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS d, lead(gap) OVER (PARTITION BY r, kind ORDER BY i) AS follows FROM ({" UNION ALL ".join(_of(kind) for kind in KINDS)})
), base AS MATERIALIZED (
  SELECT r, kind, start, start + length(hit) AS stop,
    kind || ':' || CASE kind WHEN 'email' THEN lower(hit) WHEN 'ip' THEN hit ELSE d END AS entity,
    list_concat({_WORDS.format(of="gap")}[-{WINDOW}:], {_WORDS.format(of="follows")}[:{WINDOW}]) AS around
  FROM matches WHERE hit IS NOT NULL AND CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS HUGEINT), 256) > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND {_LUHN}
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15 ELSE true END
), beside AS MATERIALIZED (
  SELECT r, entity, around, unnest(around) AS term FROM base
), both_ AS MATERIALIZED (
  SELECT entity, term, count(DISTINCT r) AS n_both, count(DISTINCT around) AS c FROM beside GROUP BY ALL
), apart AS (
  SELECT entity FROM both_ JOIN (SELECT entity, count(DISTINCT around) AS places FROM base GROUP BY ALL) USING (entity) GROUP BY entity HAVING 2 * sum(c * (c - 1)) <= (max(places) - 1) * sum(c)
), terms AS (
  SELECT entity, term, n_both FROM both_ WHERE c >= {CONTEXTS} AND entity IN (SELECT entity FROM apart)
), held AS (
  SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct({_WORDS.format(of="text")})) AS term FROM docs) WHERE term IN (SELECT term FROM terms) GROUP BY term
), shares AS (
  SELECT DISTINCT term FROM terms JOIN (SELECT entity, count(DISTINCT r) AS n_entity FROM base GROUP BY entity) USING (entity) JOIN held USING (term), (SELECT count(*)::DOUBLE AS n FROM docs)
  WHERE n_entity < n AND ln(least(1, n_both / n_term) * n / n_entity) / ln(n / n_entity) >= {GENERALISED}
), told AS MATERIALIZED (
  SELECT r, text FROM docs WHERE r IN (SELECT r FROM (SELECT r, unnest({_WORDS.format(of="text")}) AS term FROM docs) JOIN shares USING (term))
), found AS (
  SELECT r, kind, start, stop FROM base UNION ALL
  SELECT r, kind, start, start + length(hit) FROM ({_of("term", source="told")}) t
  WHERE lower(hit) IN (SELECT term FROM shares) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = t.r AND b.start < t.start + length(t.hit) AND b.stop > t.start)
), listed AS (
  SELECT r, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY list_position({[*KINDS, "term"]!r}, kind), start) AS spans,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY list_position({[*KINDS]!r}, kind), start) FILTER (kind <> 'term') AS plain, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in KINDS)}
  FROM found GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)}, sha256(coalesce(plain, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (r)
"""
