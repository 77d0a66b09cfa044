"""Source divergence, personal data and vector codes against brute force and their SQL, and their edge cases."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("repeatlake.llm")

from repeatlake.llm import codes, divergence, entries, privacy  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long, term string, k1 int, part string, v int"  # names that clash


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 1, "p", 2) for i, t, lang, source in rows], KIND).repartition(3)


def views(tmp_path, **tables):
    """Tables written as Parquet, and DuckDB views of them."""
    con = duckdb.connect()
    for name, df in tables.items():
        pq.write_table(df.toArrow(), tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return str(tmp_path), con


def same(got, want):
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    ids = {c: float for c in names if c.endswith("_id")}  # null ids make some frames' ids floats
    a, b = (x[names].astype(ids).sort_values(names, ignore_index=True).astype(str) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)


# Source divergence


def slow_audit(rows, least, top):
    seen = collections.defaultdict(collections.Counter)
    df = collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        seen[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        groups = {s: n for (x, s), n in seen.items() if x == lang}
        whole = sum(groups.values(), collections.Counter())

        def p(n, t, kept=kept):
            return 1 + 10**9 * (n[t] + 5) // (sum(n[x] for x in kept) + 5 * len(kept))

        for s, n in groups.items():
            pair = [(-sum(abs(p(n, t) - p(m, t)) for t in kept), other.encode(), other) for other, m in groups.items() if other != s]
            term = [(-(p(n, t) - p(whole, t)), t.encode(), t) for t in kept if n[t] and p(n, t) > p(whole, t)]
            out += [(lang, s, "pair", item, -v, r + 1) for r, (v, _, item) in enumerate(sorted(pair))]
            out += [(lang, s, "term", item, -v, r + 1) for r, (v, _, item) in enumerate(sorted(term)[:top])]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value", "rank"])


def corpus():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("Wort", "été", "x", "日本", "Ünü") for b in "abcdefgh"]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=range(1, 41), k=rng.randint(0, 30))) + rng.choice([".", "\x00", "\n-3-"]), rng.choice(["de", "en", None, ""]), rng.choice(["a", "b", "é", None, "B"])) for i in range(300)]
    return [*rows, rows[0], rows[0], (None, "Worta", "de", "a"), (7, None, "de", "empty"), (8, "", "xx", "lone"), (9, "q", "yy", "one"), (9, "q", "yy", "two"), (10, "z" * 70000 + " Worta" * 20000, "de", "long")]


def test_divergence(spark, tmp_path, monkeypatch):
    rows = corpus()
    want = slow_audit(rows, 30, 50)
    assert {"pair", "term"} == set(want.part) and (want[(want.lang == "yy")].value == 0).all()
    path, con = views(tmp_path, documents=docs(spark, rows))
    same(entries.QUERIES["op11_source_divergence"](spark, path).toPandas(), want)
    same(con.sql(entries.ORACLE_SQL["op11_source_divergence"]).df(), want)
    same(divergence.audit(docs(spark, rows), least=2, top=3).toPandas(), slow_audit(rows, 2, 3))


def test_divergence_in_pieces():
    text = b"Ab " + b"x" * 50 + b" cd" * 40
    got = [w for words in pieces_of(text, 7) for w in words]
    assert got == text.lower().split()


def pieces_of(text, size):
    old, divergence.PIECE = divergence.PIECE, size
    try:
        return list(divergence.pieces(text))
    finally:
        divergence.PIECE = old


def test_divergence_cells_sum_to_the_kept_terms(spark):
    kept = spark.createDataFrame([("l", "a", b"x", 2), ("l", "b", b"x", 2), ("l", "a", b"y", 1), ("l", "c", b"z", 1)], "lang string, source string, term binary, n long")
    pairs = spark.createDataFrame([("l", "a", "b", 3), ("l", "a", "c", 3), ("l", "b", "c", 3)], "lang string, a string, b string, v long")
    got = {(r.a, r.b, r.na, r.nb): r.terms for r in divergence.joint_cells(kept, pairs).collect()}
    assert got == {("a", "b", 2, 2): 1, ("a", "b", 1, 0): 1, ("a", "b", 0, 0): 1, ("a", "c", 2, 0): 1, ("a", "c", 1, 0): 1, ("a", "c", 0, 1): 1, ("b", "c", 2, 0): 1, ("b", "c", 0, 1): 1, ("b", "c", 0, 0): 1}


def test_divergence_of_nothing(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
    assert divergence.audit(docs(spark, [(1, None, None, None)])).count() == 0


# Personal data


def slow_spans(text, kind):
    out = []
    for m in re.finditer(privacy.PLAIN[kind], text):
        hit, d = m.group(), re.sub("[^0-9]", "", m.group())
        luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0
        if {"email": True, "ip": all(int(x) <= 255 for x in hit.split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
            out.append((m.start(), m.end()))
    return out


def private():
    rng = random.Random(5)
    rows = ["".join(rng.choices(["a", "Z", "1", "4", "@", ".", "-", "+", " ", "(", ")", "_", "%", "é", "😀", "\n", "12", "4111 1111 1111 1111", "b@c.d", "1.2.3.4"], k=rng.randint(1, 40))) for _ in range(1500)]
    fixed = [None, "", "a@b.c_d@e.f", "a@b.c@d.e.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.00001.1.1", "+1 (988) 555-2485 +1 2", "4111-1111 1111-1111", "4" * 19, "4" * 20, "1." * 2000, "x" * 5000, "a." * 2000 + "@" + ".b" * 2000, "a@" + "b." * 2000 + "b", "7" * 5000, "+" + "1 " * 3000, "1.2.3.4 " * 3000 + "é"]
    return [*fixed, *rows, rows[0]]


def test_private_spans_are_those_of_the_plain_patterns(spark):
    texts = private()
    df = docs(spark, [(i, t, "", "") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in privacy.private_spans(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        for kind in privacy.KINDS:
            assert [tuple(s) for s in got[i][kind]] == slow_spans(t or "", kind), (kind, (t or "")[:80])


def test_private_spans_of_long_runs(spark):
    """Runs that plain patterns would search from each start, or recurse in."""
    texts = ["x" * 1_000_000, "a." * 300_000 + "@b.c", "a@" + "b." * 300_000 + "b", "7" * 1_000_000, "+" + "1 " * 300_000, "1." * 300_000, "1.2.3.4 " * 20_000]
    got = {r.doc_id: r for r in privacy.private_spans(docs(spark, [(i, t, "", "") for i, t in enumerate(texts)])).collect()}
    assert [[len(got[i][k]) for k in privacy.KINDS] for i in range(7)] == [[0] * 4, [1, 0, 0, 0], [1, 0, 0, 0], [0] * 4, [0] * 4, [0, 75_000, 0, 0], [0, 20_000, 0, 0]]
    assert got[1].email[0].stop == 600_004 and got[6].ip[19_999].start == 8 * 19_999


def telling():
    """A name beside one address in four different surroundings, and once elsewhere; common words; copies of one text."""
    rng = random.Random(8)
    common = "of the and to in is was for on with as by at from it an be this which or".split() + [f"w{c}{d}" for c in "abcdef" for d in "abcdefgh"]
    some = lambda k: " ".join(rng.choices(common, k=k))
    rows = [some(rng.randint(5, 30)) for _ in range(200)]
    rows += [f"{some(3)} Zaphod é {some(4)} Zaphod@mail.example.com {some(9)}, ask Trillian {some(2)}" for _ in range(4)]
    rows += [f"{some(30)} zaphod. {some(3)} 😀 TRILLIAN", "call +1 (988) 555-2485 Marvin " + some(9), "so Zaphod@x.example.org " + some(4)]
    rows += [f"{some(8)} Arthur 10.0.0.7 {some(8)}"] * 7
    near = some(16).split()
    for k in range(9):  # near copies around one number
        words = [*near]
        words[k], words[15 - k // 3] = f"edit{'abcdefghi'[k]}", some(1)
        rows.append(" ".join([*words[:8], "Ford 10.9.8.7", *words[8:]]))
    return [*rows, None, ""]


def test_telling_terms(spark, tmp_path):
    texts = telling()
    path, con = views(tmp_path, documents=docs(spark, [(i if t else None, t, "", "") for i, t in enumerate(texts)]))
    got = entries.QUERIES["op12_private_terms"](spark, path).toPandas()
    same(got, con.sql(entries.ORACLE_SQL["op12_private_terms"]).df())
    spans = dict(zip(got.doc_id, got.spans))
    assert all("term:" in spans[i] for i in range(200, 205)) and not any("term:" in spans[i] for i in range(200))
    named = {texts[i][int(a) : int(b)].lower() for i in range(200, 205) for kind, a, b in (s.split(":") for s in spans[i].split(",")) if kind == "term"}
    assert named == {"zaphod"}  # ``trillian`` is further away; copies, exact or near, make ``arthur`` and ``ford`` no more telling
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs(spark, [(i, t, "", "") for i, t in enumerate(texts)])).collect()}
    assert "Zaphod" not in clean[200] and "[EMAIL]" in clean[200] and "[PHONE] Marvin" in clean[205] and clean[3] == texts[3] and clean[len(texts) - 2] == ""
    digest = hashlib.sha256(",".join(s for s in spans[200].split(",") if "term" not in s).encode()).hexdigest()
    assert digest == got[got.doc_id == 200].base_sha256.iloc[0]


def test_private_nothing(spark):
    assert privacy.private_spans(docs(spark, [])).count() == 0
    assert privacy.sanitised(docs(spark, [])).count() == 0
    lone = privacy.private_spans(docs(spark, [(None, "me@x.y one two", None, None)] * 4)).collect()
    assert len(lone) == 4 and all(len(r.email) == 1 and not r.term for r in lone)


# Vector codes

VECTOR = "vec_id long, embedding array<float>, label int, e string, code int, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], VECTOR).repartition(3)


def slow_codes(rows, parts=8, entries_=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    each = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = [[math.floor(4096 * int(x)) if abs(x) > 2**52 else math.floor(4096 * x) for x in v] + [0] * (each * parts - len(v)) for _, v, _ in kept]
    books = [[v[p * each : (p + 1) * each] for v in whole[:entries_]] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * each : (p + 1) * each], m)), k) for k, m in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            own = collections.defaultdict(list)
            for v in whole:
                own[near(p, v)[1]].append(v[p * each : (p + 1) * each])
            for k, members in own.items():
                new[p][k] = [sum(c) // len(members) for c in zip(*members)]
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for m in b for x in m).encode()).hexdigest()
    out, by_label = [], collections.Counter()
    for (i, _, label), v in zip(kept, whole):
        found = [near(p, v) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label, sha])
        by_label[label] += out[-1][2]
    big = lambda x: x if x < 1 << 63 else None
    return pd.DataFrame([(i, code, big(error), big(by_label[label]), s) for i, code, error, label, s in out], columns=["vec_id", "code", "error", "label_error", "codebooks_sha256"])


def floats(rng, n, width, step):
    return [[float(np.float32(rng.randint(-8, 8) * step)) for _ in range(width)] for _ in range(n)]


def test_codes(spark, tmp_path):
    rng = random.Random(2)
    # few values: equal parts, equal entries and equal distances abound
    rows = [(i, v, rng.choice([0, 1, None])) for i, v in enumerate(floats(rng, 150, 16, 1 / 4096))]
    rows += [(500 + i, v, 3) for i, v in enumerate(floats(rng, 60, 16, 0.01))] + [rows[3], rows[4]]
    rows += [(900, None, 1), (901, [None] * 16, 1), (902, [1.0] * 15 + [float("nan")], 1), (903, [float("inf")] + [0.0] * 15, 0), (None, [0.5] * 16, 0)]
    path, con = views(tmp_path, embeddings=vectors(spark, rows))
    want = slow_codes(rows)
    same(entries.QUERIES["op13_vector_codes"](spark, path).toPandas(), want)
    con.execute("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM (SELECT * FROM '" + path + "/embeddings.parquet') ORDER BY vec_id NULLS LAST")
    same(con.sql(entries.ORACLE_SQL["op13_vector_codes"]).df(), want)


def plain(coded, books):
    frame = coded.toPandas()
    return frame.drop(columns="label").assign(codebooks_sha256=codes.printed(books))


@pytest.mark.parametrize("rows", [
    [(3, [0.1] * 8, 1), (1, [0.2] * 8, None), (1, [0.1] * 8, 1)],  # fewer rows than entries, ids that repeat
    [(i, [0.25 * (i % 5)] * (1 + i % 11), i % 2) for i in range(40)],  # of several lengths, none divisible
    [(i, [3e38 if i % 3 else -3e38, 1e30 * i, 0.5] + [0.1] * 5, None) for i in range(20)] + [(99, [0.001] * 8, 5)],  # beyond 64 bits
])
def test_odd_codes(spark, rows):
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got, want = plain(*codes.compress(vectors(spark, rows))), slow_codes(rows).drop(columns="label_error")
    for frame in (got, want):
        frame["error"] = frame["error"].astype(float)
    same(got, want)


def test_tree_visits_equal_bounds():
    rng = np.random.default_rng(4)
    for _ in range(60):
        book = rng.integers(-2, 3, (rng.integers(1, 17), 3))
        rows = rng.integers(-3, 4, (200, 3))
        at, best = codes.Tree(book).nearest(rows)
        d = ((rows[:, None, :] - book[None]) ** 2).sum(2)
        assert (best == d.min(1)).all() and (at == d.argmin(1)).all()


def test_limbs():
    for x in (0, -1, 5, 2**31, -(2**31), 2**63, -(10**45), 10**45):
        assert sum(n << 32 * i for i, n in enumerate(codes.in_limbs(x))) == x


def test_codes_of_nothing(spark):
    coded, books = codes.compress(vectors(spark, []))
    assert coded.count() == 0 and books == []
    coded, books = codes.compress(vectors(spark, [(1, None, 1), (2, [float("nan")], 2)]))
    assert coded.count() == 0 and books == []
    with pytest.raises(ValueError):
        codes.compress(vectors(spark, []), entries=257)
