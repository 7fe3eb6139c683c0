"""The registered queries and the pipeline: SQL where there is some, and what each stage does to its input."""

import glob
import os
import sys

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from cellwatch.llm import mixing, ngramjoin
from cellwatch.llm.queries import QUERIES, statements
from cellwatch.llm.shared import stored, table
from conftest import SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from check_oracle import differences  # noqa: E402


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(statements()) <= set(contract.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(statements()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.execute(statements()[name]).df()
    order = [c for c in ("doc_id", "copy", "page_id", "conv_id", "depth") if c in got.columns]
    assert not differences(got.sort_values(order), want.sort_values(order))


def test_stages_work_on_what_is_left(spark):
    docs = stored(table(spark, SMALL, "documents"), "documents")
    columns = docs.columns
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, before, SMALL), "stage")
        assert docs.columns == columns, name
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids, name
        if name == "drop near copies":
            found = ngramjoin.near_duplicates(before).collect()
            assert left == {r["component_id"] for r in found} and docs.count() == len(left)
        if name == "mix sources":
            assert docs.count() == mixing.mix(before).count()
        else:
            ids = left
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert encoded.count() == docs.count()
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(str, encoded.collect()))
