"""Registered corpus queries: their SQL, and the pipeline on the given tables."""

import corpus_pipeline
import duckdb
import pytest
from llm_fixtures import SF

from galewise.llm.registry import llm_oracles, llm_queries

TABLES = ["documents", "embeddings", "labels", "benchmark"]


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = llm_queries()[name](spark, SF).toArrow(), con.sql(llm_oracles()[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    columns = sorted(got.column_names)
    rows = [sorted(zip(*(t.column(c).to_pylist() for c in columns)), key=str) for t in (got, want)]
    assert rows[0] == rows[1]


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in llm_queries() if n.startswith("op")} == set(range(1, 14))


def test_pipeline_keeps_rows_of_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    for r in got.collect():
        own = docs[r.doc_id]
        assert (r.lang, r.source) == (own.lang, own.source)
        rest = iter(own.text.split("\n"))
        assert all(line in rest for line in r.text.split("\n"))
