"""Every registered query against its SQL on small tables."""

import numpy as np
import pytest

from repeatlake.plans import formats, reads, sequences

QUERIES = {**sequences.QUERIES, **reads.QUERIES, **formats.QUERIES}
SQL = {**sequences.SQL, **reads.SQL, **formats.SQL}


def plain(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype == object:
            frame = frame.assign(**{c: frame[c].map(lambda v: str([int(x) for x in v]) if isinstance(v, (list, np.ndarray)) else str(v))})
    return frame.sort_values(list(frame.columns), ignore_index=True)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, name):
    path, con = small
    got = QUERIES[name](spark, path)
    rows = got.toPandas()
    if name not in SQL:
        assert len(rows) > 0
        return
    want = con.sql(SQL[name]).df()
    a, b = plain(rows), plain(want)
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True, atol=1e-9), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_entry_point():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(QUERIES) <= set(names)


AGAIN = "kmer_count kmer_graph kmer_entropy pan_merge pan_graph_merge map_pan_counts bubble_edge_filter novel_edges kmers_of_assembly shared_kmers kmers_except bidirectional_closure bubble_text_roundtrip bait_text_roundtrip".split()


@pytest.mark.parametrize("name", AGAIN)
def test_query_with_loci_of_several_rows(spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    source = "(SELECT doc_id, substr(text, 1, 700) AS text, lang, source, n_chars FROM '/root/testdata/sf0.001/documents.parquet')"
    con.execute(f"COPY (SELECT * FROM {source} WHERE doc_id < 40 UNION ALL SELECT doc_id - 30, text, lang, 'src1', n_chars FROM {source} WHERE doc_id BETWEEN 40 AND 49) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    a, b = plain(QUERIES[name](spark, str(tmp_path)).toPandas()), plain(con.sql(SQL[name]).df())
    assert len(a) == len(b) and list(a.columns) == list(b.columns)
    for c in a.columns:
        assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-9) if a[c].dtype.kind == "f" else (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", ["kmer_inverted_index", "kmer_index_chunks", "haplotype_merge", "read_index_join", "sampled_prefilter", "kmer_hit_filter"])
def test_index_query_with_loci_of_several_rows(spark, tmp_path, name):
    test_query_with_loci_of_several_rows(spark, tmp_path, name)


def test_probes_take_no_window_over_all_reads(spark, small):
    plan = QUERIES["sampled_prefilter"](spark, small[0])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("name", ["bubble_roots", "bubble_root_features", "bubble_path_features", "bubble_calls"])
def test_bubble_query_with_loci_of_several_rows(spark, tmp_path, name):
    test_query_with_loci_of_several_rows(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["bubble_roots", "bubble_path_features"])
def test_bubble_tables_do_not_grow_with_the_sequences(spark, small, name, monkeypatch):
    """Rows of novel edges, their nodes and their flanks: no more of them where every sequence is there three times, which leaves no edge to one locus."""
    from repeatlake.operators import bubbles, loci

    sizes = []
    seen = lambda *tables: sizes.append(sum(t.count() for t in tables))
    monkeypatch.setattr(loci, "bubbles", lambda edges, repeat: seen(edges, repeat) or edges.limit(0).selectExpr("locus", "edge root", "cnt reached", "cnt alive", "cnt nodes", "0D mean", "0D sd"))

    class Counted(bubbles.Bubbles):
        def __init__(self, edges, repeat, flank, *more):
            seen(edges, repeat, flank)
            super().__init__(edges, repeat, flank, *more)

    monkeypatch.setattr(bubbles, "Bubbles", Counted)
    docs = spark.read.parquet(f"{small[0]}/documents.parquet").cache()
    wide = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 10000)).unionByName(docs.withColumn("doc_id", docs.doc_id + 20000))
    import tempfile

    place = tempfile.mkdtemp()
    wide.write.parquet(f"{place}/documents.parquet")
    QUERIES[name](spark, small[0]).count()
    QUERIES[name](spark, place).count()
    assert 0 == sizes[1] < sizes[0]


@pytest.mark.parametrize("name", ["bait_filter", "filter_funnel"])
def test_mapping_query_with_loci_of_several_rows(spark, tmp_path, name):
    """Second rows of loci are too short for pairs, whose titles would be those of others."""
    import duckdb

    con = duckdb.connect()
    source = "'/root/testdata/sf0.001/documents.parquet'"
    con.execute(f"COPY (SELECT doc_id, substr(text, 1, 900) AS text, lang, source, n_chars FROM {source} WHERE doc_id < 40 UNION ALL SELECT doc_id - 1, substr(text, 1, 450), lang, 'src1', n_chars FROM {source} WHERE doc_id BETWEEN 11 AND 25 UNION ALL SELECT doc_id, substr(text, 200, 450), lang, 'src2', n_chars FROM {source} WHERE doc_id < 8) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    a, b = plain(QUERIES[name](spark, str(tmp_path)).toPandas()), plain(con.sql(SQL[name]).df())
    assert len(a) == len(b) and (a.astype(str) == b.astype(str)[list(a.columns)]).all(axis=None)


def test_mapping_writes_no_table_of_all_read_kmers(spark, small, monkeypatch):
    """Reads' k-mers are made where they are used, and sets of repeats and flanks are grouped in their row: no exchange by locus and k-mer before the classes."""
    from repeatlake.plans import tables

    sizes, write = {}, tables.materialize
    monkeypatch.setattr(tables, "materialize", lambda rows, tag: sizes.setdefault(tag, (rows._jdf.queryExecution().executedPlan().toString(), write(rows, tag)))[1])
    mapping = tables.Mapping(spark, small[0])
    windows = mapping.kmers.count()
    assert all(table.count() < windows for tag, (_, table) in sizes.items() if tag not in ("kinds", "classes"))
    assert "hashpartitioning(locus" not in sizes["kinds"][0] and "HashAggregate" not in sizes["kinds"][0]
