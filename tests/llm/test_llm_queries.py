"""The registered queries at the smallest size: SQL where there is some, whole tables, and the pipeline."""

from __future__ import annotations

import pytest
from compare import duck_rows, spark_rows

import __spark_entry__ as entry
from corpusloom.llm.queries import ORACLE_SQL, QUERIES
from corpusloom.llm.shared import table


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(duck.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_for_each_row(spark, sf, name):
    if not name.startswith(("op12_", "op13_")):
        whole = table(spark, sf, "pages" if name.startswith(("op7_", "op10_")) else "documents").count()
        assert QUERIES[name](spark, sf).count() == whole


def test_operator_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = table(spark, sf, "documents")
    columns = docs.columns
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept = {r[0] for r in docs.select("doc_id").collect()}
        assert kept
        assert kept <= ids
        ids = kept
        assert docs.columns[: len(columns)] == columns
        assert i == len(p.STAGES) - 1 or docs.columns == columns
    assert "piece_ids" in docs.columns
    assert docs.filter("not round_trip").isEmpty()
    assert docs.count() == p.run(spark, sf).count()


def test_pipeline_of_an_empty_table(spark, sf):
    import corpus_pipeline as p

    none = table(spark, sf, "documents").filter("false")
    for _, stage in p.STAGES:
        assert stage(spark, none, sf).count() == 0


@pytest.mark.parametrize("place", range(5))
def test_stages_leave_other_columns_alone(spark, sf, place):
    """Columns that the operators use themselves keep their values, whatever their names."""
    import corpus_pipeline as p

    extra = {"score": "-5.0D", "predicted": "77", "held_out": "'no'", "row": "'r'", "copies": "9", "node": "'n'", "size": "doc_id", "kept": "'k'", "keep_id": "0", "class_id": "'c'", "__id": "'i'", "__score": "'s'", "skey": "'y'", "norm": "'m'", "n": "'z'", "taken": "1"}
    docs = table(spark, sf, "documents").selectExpr("*", *(f"{v} as {k}" for k, v in extra.items()))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).selectExpr(*(c if c not in ("text", "source", "lang") else f"cast(null as string) as {c}" for c in docs.columns)))
    rows = {str(tuple(r)) for r in docs.collect()}
    out = p.STAGES[place][1](spark, docs, sf).select(*docs.columns).collect()
    assert out
    assert {str(tuple(r)) for r in out} <= rows
