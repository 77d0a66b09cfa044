"""Queries whose shuffles and written tables were larger than their limits: what leaves a row or a group, and both ways of doing it."""

import numpy as np
import pytest

from repeatlake.operators import kmers, predict
from repeatlake.plans import reads, sequences, tables
from tests.test_queries import SQL, plain, test_query_with_loci_of_several_rows as several_rows


def same(a, b):
    a, b = (plain(x.fillna(-1)) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    assert (a.astype(str).replace(r"\.0$", "", regex=True) == b.astype(str).replace(r"\.0$", "", regex=True)).all(axis=None)


@pytest.fixture(scope="module")
def alike(tmp_path_factory):
    """Neighbouring documents that share text, some of several rows, and DuckDB's view of them."""
    import duckdb

    out, con = tmp_path_factory.mktemp("alike"), duckdb.connect()
    source = "'/root/testdata/sf0.001/documents.parquet'"
    rest = "lang, source, n_chars"
    con.execute(f"COPY (SELECT doc_id * 2 AS doc_id, substr(text, 1, 900) AS text, {rest} FROM {source} WHERE doc_id < 30 UNION ALL SELECT doc_id * 2 + 1, substr(text, 150, 700) || substr(text, 1, 200), {rest} FROM {source} WHERE doc_id < 30 UNION ALL SELECT doc_id * 2 + 2, substr(text, 100, 600), 'de', source, n_chars FROM {source} WHERE doc_id BETWEEN 5 AND 12 UNION ALL SELECT 1000, NULL, 'en', 'src1', 0 UNION ALL SELECT NULL, text, {rest} FROM {source} WHERE doc_id = 3) TO '{out}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{out}/documents.parquet'")
    return str(out), con


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dotplot_pairs", "contamination_counts"])
def test_dots_shuffle_sequences_and_no_kmers(spark, small, name):
    text = plan(reads.QUERIES[name](spark, small[0]))
    assert "hashpartitioning(pair" in text and "kmer#" not in text.split("hashpartitioning(pair")[-1] and "Join" not in text


@pytest.mark.parametrize("name", ["graph_prune"])
def test_again_with_loci_of_several_rows(spark, tmp_path, name):
    several_rows(spark, tmp_path, name)


@pytest.mark.parametrize("long", [None, 1200, 10])
@pytest.mark.parametrize("name", ["dotplot_pairs", "contamination_counts"])
def test_dots_of_texts_alike(spark, alike, name, long, monkeypatch):
    if long:
        monkeypatch.setattr(kmers, "LONG", long)
    got = reads.QUERIES[name](spark, alike[0])
    assert ("Join" in plan(got)) == bool(long)
    same(got.toPandas(), alike[1].sql(SQL[name]).df())


def test_pruned_graph_shuffles_nothing(spark, small):
    assert "hashpartitioning" not in plan(sequences.QUERIES["graph_prune"](spark, small[0]))


def test_nearest_sample_makes_no_row_of_a_pair(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(s), int(r), float(rng.integers(1, 50))) for s in range(90) for r in range(12) if rng.random() < 0.7]
    rows += [(90, 99, 1.0), (91, 0, 0.0), (92, 3, float("nan")), (93, None, 2.0)]
    frame = spark.createDataFrame(rows, "sample long, region long, value double")
    value = {(s, r): v for s, r, v in rows if v > 0 and r is not None}
    want = {}
    for a in {s for s, _ in value}:
        for b in {s for s, _ in value} - {a}:
            gaps = [abs(1 - value[a, r] / value[b, r]) for r in range(12) if (a, r) in value and (b, r) in value]
            if gaps:
                want[a] = min(want.get(a, (9e9, 0)), (round(sum(gaps) / len(gaps), 9), b))
    monkeypatch.setattr(predict, "BLOCK", 16)
    got = predict.nearest_sample(frame)
    assert "CartesianProduct" in plan(got) and "SortMergeJoin" not in plan(got) and "BroadcastHashJoin" not in plan(got)
    assert {r["sample"]: (round(r["distance"], 9), r["nearest"]) for r in got.collect()} == want


@pytest.mark.parametrize("name", ["kmer_hit_filter", "read_index_join", "top2_loci"])
def test_reads_meet_the_index_in_stretches(spark, small, name):
    assert "hashpartitioning(kmer" not in plan(reads.QUERIES[name](spark, small[0]))


@pytest.mark.parametrize("name", ["locus_hits", "top2_loci", "extract_reads", "kmer_hit_filter", "read_index_join"])
def test_reads_of_texts_alike(spark, alike, tmp_path, name):
    """Loci that share k-mers, of one row each: titles are of one pair."""
    alike[1].execute(f"COPY (SELECT * FROM documents WHERE doc_id IS NOT NULL AND lang <> 'de' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY text) = 1) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    same(reads.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", ["genotype_kmers", "kmer_profile", "read_novel_edges"])
def test_reads_meet_the_sequence_of_their_locus(spark, small, name):
    text = plan(reads.QUERIES[name](spark, small[0]))
    assert "Join" not in text.split("FlatMapCoGroupsInArrow")[0] and "hashpartitioning(locus#" in text
    assert not any("kmer#" in line or "edge#" in line for line in text.split("\n") if "hashpartitioning" in line)


@pytest.mark.parametrize("name", ["genotype_kmers", "read_novel_edges", "kmer_profile", "kam_records"])
def test_loci_of_many_reads_are_several_groups(spark, small, name, monkeypatch):
    from repeatlake.plans import tables

    monkeypatch.setattr(tables, "READS", 1)
    same(reads.QUERIES[name](spark, small[0]).toPandas(), small[1].sql(SQL[name]).df())


@pytest.mark.parametrize("name", ["genotype_kmers", "kmer_profile", "tr_segment"])
def test_loci_looked_at_by_joins_are_the_same(spark, small, name, monkeypatch):
    monkeypatch.setattr(kmers, "LONG", 700)
    same(reads.QUERIES[name](spark, small[0]).toPandas(), small[1].sql(SQL[name]).df())


@pytest.mark.parametrize("name", ["kmer_inverted_index", "kmer_index_chunks"])
def test_index_travels_in_stretches(spark, alike, name):
    got = sequences.QUERIES[name](spark, alike[0])
    assert "hashpartitioning(bucket" in plan(got) and "hashpartitioning(kmer" not in plan(got)
    want = (kmers.inverted_index if name == "kmer_inverted_index" else lambda x: kmers.index_chunks(x, 100))(tables.index(spark, alike[0]))
    rows = lambda df: sorted((str(r) for r in df.collect()))
    assert rows(got) == rows(tables.named(want)) and len(rows(got)) > 0
