"""The registered queries and the pipeline over the given tables."""

import collections

import duckdb
import pytest

import corpus_pipeline
from filingforge.llm.queries import ORACLE, QUERIES
from tools.check_oracle import TABLES, canon

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id held_out score predicted", 2: "doc_id size text_crc32 law shard slot grown_shard", 3: "doc_id held_out score predicted",
    4: "doc_id item_id n_item n_shared containment", 5: "doc_id n_bytes n_tokens over_limit",
    6: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 7: "query_id rank vec_id score", 8: "doc_id n_shingles component_id kept",
    9: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 10: "doc_id n_bytes n_removed n_spans kept_sha256",
    11: "vec_id n_links component_id kept", 12: "vec_id code error label_error codebooks_sha256",
    13: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.columns == COLUMNS[int(name[2:].split("_")[0])].split()
    rows = df.collect()
    if name.startswith(("op1_", "op2_", "op3_", "op5_", "op6_", "op8_", "op10_")):
        want = tables.execute("SELECT doc_id FROM documents").fetchall()
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(x for x, in want)
    assert rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    found = tables.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert canon(df.collect(), df.columns) == canon(found.fetchall(), names)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    before = docs.count()
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF_DIR)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.toArrow(), out.schema)
        assert 0.5 * before < docs.count() <= before
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_takes_odd_documents(spark, documents):
    from .conftest import ODD

    docs = documents([*ODD, (100, "x")])
    for empty in (False, True):
        frame = docs.limit(0) if empty else docs
        for _, step in corpus_pipeline.STAGES:
            frame = step(spark, frame, SF_DIR)
            assert empty or frame.count() > 0
